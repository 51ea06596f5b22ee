"""Smoothings, settings, registries of rules and quirks, the cache of files."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cadentia.functions import formula, settings
from cadentia.operators import power, quality, registry
from cadentia.sources import cache


def frame(spark, values):
    return spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "workout_id int, seq int, power int")


def ema(values, alpha):
    out = None
    for v in values:
        if v is not None:
            out = float(v) if out is None else alpha * v + (1 - alpha) * out
            yield out


@pytest.mark.parametrize("alpha", [0.001, 0.3, 0.5, 0.9, 0.999, 1])
def test_exponential_means(spark, alpha, monkeypatch):
    monkeypatch.setattr(power, "DIGITS", 30)  # several blocks
    rng = random.Random(3)
    values = [None if rng.random() < 0.1 else rng.randint(0, 900) for _ in range(2000)]
    got = [r.m for r in power.exponential_means(frame(spark, values), alpha).orderBy("i").collect()]
    assert got == pytest.approx(list(ema(values, alpha)), rel=1e-9)


def test_user_weights(spark):
    got = [r.m for r in power.weighted_means(frame(spark, [100, None, 200, 400]), (1, 3)).orderBy("i").collect()]
    assert got == [100, (100 + 3 * 200) / 4, (200 + 3 * 400) / 4]
    for weights in ((), (1, -1, 1), (1, 0), (1.0,) * 3601):
        with pytest.raises(ValueError, match="weights"):
            power.weighted_means(frame(spark, [1]), weights)


def test_smoothings(spark):
    points = frame(spark, [200] * 50)
    for kind in settings.SMOOTHINGS:
        assert power.smoothed_np(points, kind).first().np == pytest.approx(200)
    assert power.smoothed_np(points.limit(0), "ExponentialMovingAverage").count() == 0
    for bad in ({"kind": "rolling"}, {"window": 0}, {"window": 3601}, {"kind": "ExponentialMovingAverage", "alpha": 0}):
        with pytest.raises(ValueError):
            power.smoothed_np(points, **bad)


def test_settings_round_trip():
    for made in (*settings.TEMPLATES.values(), settings.Settings("duration * IF", "power * 0.9", 45, "WeightedMovingAverage", {'a "b"\n\\c': ("x + 1", None), "z": ("y / 2", 'said "so"\tü\x7f')})):
        assert settings.load(settings.dump(made)) == made
    assert settings.load("") == settings.Settings() and settings.load("", settings.TEMPLATES["running"]) == settings.TEMPLATES["running"]
    assert settings.load("[calculation]\nnp_window_seconds = 60\n", settings.TEMPLATES["triathlon"]).formulas == settings.TEMPLATES["triathlon"].formulas
    one = formula.Registry()
    one.add('a "quoted" name', "x + 1")
    two = formula.Registry()
    two.load(one.dump())
    assert two.formulas == one.formulas


@pytest.mark.parametrize("text", ["[calculation]\nnp_window_seconds = 0", "[calculation]\nnp_window_seconds = 3601", '[calculation]\nsmoothing_algorithm = "Median"', '[calculation]\ntss_formula = "(a"', '[calculation]\nftp_method = ""', "[calculation", "[other]\na = 1", '[calculation]\nwindow = 3', '[[custom_formulas]]\nname = "a"', '[[custom_formulas]]\nname = "a"\nexpression = "x"\n[[custom_formulas]]\nname = "a"\nexpression = "y"', '[[custom_formulas]]\nname = "a"\nexpression = "x;"'])
def test_bad_settings(text):
    with pytest.raises(settings.SettingsError):
        settings.load(text)


def test_settings_at_work(spark):
    df = spark.createDataFrame([(1.0, 0.9, 250)], "duration double, f double, best int")
    values = {"duration": F.col("duration"), "IF": F.col("f")}
    made = settings.Settings("duration * IF * 10", "power * 0.9")
    got = df.select(settings.Settings().stress_of(values).alias("a"), made.stress_of(values).alias("b"), settings.Settings().threshold_of(F.col("best")).alias("c"), made.threshold_of(F.col("best")).alias("d"), settings.Settings(threshold="CriticalPower").threshold_of(F.col("best")).alias("e")).first()
    assert tuple(got) == pytest.approx((81.0, 9.0, 238, 225, 250))
    assert settings.Settings(smoothing="ExponentialMovingAverage").normalised(frame(spark, [100] * 5)).first().np == pytest.approx(100)


def test_registries_round_trip():
    for entries, kind in ((registry.default_rules(), "rules"), (registry.QUIRKS, "quirks")):
        again = registry.read_toml(registry.write_toml(entries, kind), kind)
        assert [{k: v for k, v in x.items() if v is not None} for x in again] == entries
    assert registry.read_toml("", "rules") == []
    assert registry.read_toml('[[rules]]\nname = "r"\nsport = "Cycling"\nfield = "power"\nlow = 0\nseverity = "Info"\naction = "Flag"\n', "rules")[0]["low"] == 0.0


@pytest.mark.parametrize(("text", "kind"), [
    ('[[quirks]]\nname = "q"\nmanufacturer = 1\nproduct = 2\nquirk = "odd"', "quirks"), ('[[quirks]]\nname = "q"\nmanufacturer = 1\nproduct = 2\nquirk = "cadence_scaling"', "quirks"), ('[[quirks]]\nname = "q"\nmanufacturer = "1"\nproduct = 2\nquirk = "left_only_power_doubling"', "quirks"),
    ('[[rules]]\nname = "r"\nsport = "Cycling"\nfield = "power"\nlow = 9\nhigh = 1\nseverity = "Info"\naction = "Flag"', "rules"), ('[[rules]]\nname = "r"', "rules"), ("[[rules", "rules"), ('[[rules]]\nname = "r"\nsport = "C"\nfield = "p"\nseverity = "Bad"\naction = "Flag"', "rules"),
])
def test_bad_entries(text, kind):
    with pytest.raises(registry.RegistryError):
        registry.read_toml(text, kind)


def test_versions(spark):
    rules = registry.default_rules()
    table = registry.version(spark, rules, "rules", dt.date(2024, 1, 1)).unionByName(registry.version(spark, [rules[0] | {"high": 1500.0}], "rules", dt.date(2024, 3, 1), (rules[1]["name"],))).unionByName(registry.version(spark, [rules[1]], "rules", dt.date(2024, 5, 1)))
    held = lambda day: {r["name"]: r.high for r in registry.as_of(table, day).collect()}
    assert held("2023-12-31") == {} and len(held("2024-01-01")) == len(rules)
    assert held("2024-03-01")[rules[0]["name"]] == 1500.0 and rules[1]["name"] not in held("2024-04-30") and rules[1]["name"] in held("2024-05-01")
    points = spark.createDataFrame([(1, "Cycling", 1800, 100)], "workout_id int, sport string, power int, heart_rate int")
    for day, broken in (("2024-01-01", 0), ("2024-03-01", 1)):
        assert quality.check_rules(points, registry.as_of(table, day), ["power"]).count() == broken


def test_quirks_one_after_the_other(spark):
    entries = [{"name": "half", "manufacturer": 1, "product": 1, "quirk": registry.CADENCE, "factor": 0.5}, {"name": "again", "manufacturer": 1, "product": 1, "quirk": registry.CADENCE, "factor": 0.5}, {"name": "off", "manufacturer": 1, "product": 1, "quirk": registry.LEFT_ONLY, "enabled": False}]
    quirks = registry.as_of(registry.version(spark, entries, "quirks", dt.date(2024, 1, 1)), "2024-01-01")
    devices = spark.createDataFrame([(1, 1, 1, None), (2, 9, 9, 5)], "workout_id int, manufacturer int, product int, firmware int")
    points = spark.createDataFrame([(1, 0, 91, 7), (1, 1, None, 8), (2, 0, 91, 9)], "workout_id int, ts_s int, cadence int, quirks int")
    out = registry.apply_quirks(points, devices, quirks)
    assert out.columns == points.columns and sorted(map(tuple, out.collect()), key=str) == [(1, 0, 23, 7), (1, 1, None, 8), (2, 0, 91, 9)]
    assert sorted((r.workout_id, r.place, r.message) for r in registry.quirk_messages(points, devices, quirks).where("place IS NOT NULL").collect()) == [(1, 0, "half: Applied cadence scaling (factor: 0.5) to 1 data points"), (1, 1, "again: Applied cadence scaling (factor: 0.5) to 1 data points")]
    assert [r.message for r in registry.quirk_messages(points, devices, quirks).where("place IS NULL").collect()] == ["No quirks applied"]
    assert registry.apply_quirks(points.limit(0), devices, quirks).count() == 0


NOW = "2024-06-01 00:00:00"


def entries(spark, rows):
    at = lambda d: dt.datetime(2024, 5, 1) + dt.timedelta(days=d)
    return spark.createDataFrame([(p, f, s, at(d), at(d)) for p, f, s, d in rows], cache.SCHEMA)


def test_look_ups(spark):
    held = entries(spark, [("a", "1", 5, 30), ("b", "2", 5, 20), ("c", "3", 5, 0), ("d", "4", 5, 29), ("e", "5", 5, 1)])
    asked = spark.createDataFrame([("a", "1"), ("b", "9"), ("c", "3"), ("x", "1"), ("d", "4"), ("d", "8"), (None, "1")], "path string, fingerprint string")
    answers, after = cache.look_up(held, asked, NOW)
    assert {(r.path, r.fingerprint): r.hit for r in answers.collect()} == {("a", "1"): True, ("b", "9"): False, ("c", "3"): False, ("x", "1"): False, ("d", "4"): False, ("d", "8"): False, (None, "1"): False}
    assert {r.path: str(r.accessed_at) for r in after.collect()} == {"a": NOW, "e": "2024-05-02 00:00:00"}


def test_room_is_made_by_age(spark):
    held = entries(spark, [("a", "1", 40, 3), ("b", "2", 30, 1), ("c", "3", 30, 1), ("d", "4", 10, 9)])
    more = lambda *rows: spark.createDataFrame(rows, "path string, fingerprint string, size long")
    left = lambda *rows, most=120: sorted(r.path for r in cache.put(held, more(*rows), NOW, most).collect())
    assert left(("x", "9", 10)) == ["a", "b", "c", "d", "x"]
    assert left(("x", "9", 11)) == ["a", "c", "d", "x"]
    assert left(("x", "9", 41)) == ["a", "d", "x"]
    assert left(("a", "9", 500)) == ["a"]
    assert [(r.size, r.fingerprint) for r in cache.put(held, more(("a", "9", 5), ("a", "8", 6)), NOW).where("path = 'a'").collect()] == [(5, "9")]
    assert cache.put(held.limit(0), more(), NOW).count() == 0


def test_incremental_imports(spark, tmp_path):
    keeper = cache.Manifest(spark, str(tmp_path / "manifest"))
    files = lambda **named: spark.createDataFrame([(k, v.encode()) for k, v in named.items()], "path string, content binary")
    go = lambda day, **named: sorted(r.path for r in keeper.incremental(files(**named), f"2024-01-{day} 00:00:00").collect())
    assert keeper.latest() == 0 and keeper.read().count() == 0
    assert go("01", a="x", b="y") == ["a", "b"] and keeper.latest() == 1
    assert go("10", a="x", b="z", c="") == ["b", "c"]
    assert go("12", b="z") == []
    assert go("15", a="x") == [] and {r.path for r in keeper.read().collect()} == {"a", "b", "c"}
    assert keeper.read(1).count() == 2 and keeper.latest() == 4
    assert spark.createDataFrame([], "path string, content binary").transform(cache.fingerprints).count() == 0
