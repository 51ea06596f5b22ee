"""FIT as a data source, and workout files in XML."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from cadentia.sources import fit, fit_format, workout_files
from tests.test_imports import ride
from tests.test_sessions import triathlon


def test_the_source_gives_the_decoder_s_rows(spark, tmp_path):
    fit_format.register(spark)
    for name, data in {"a b.fit": ride(), "tri.fit": triathlon(), "cut.fit": ride()[:300], "alien.fit": b"x", "empty.fit": b"", "notes.txt": b"y"}.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "below.fit").mkdir()
    plain, source = fit.read_fit(spark, f"{tmp_path}/*.fit"), spark.read.format("fit").load(str(tmp_path))
    assert set(source.columns) == set(plain.columns)
    rows = lambda df: sorted(map(str, (r.asDict() for r in df.select(*sorted(df.columns)).collect())))
    assert rows(source) == rows(plain) and source.count() > 70
    few = spark.read.format("fit").schema("seq int, power int").load(str(tmp_path))
    assert few.columns == ["seq", "power"] and rows(few) == rows(plain.select("seq", "power"))
    assert spark.read.format("fit").load(f"{tmp_path}/tri.fit").count() == 7 and spark.read.format("fit").load(f"file://{tmp_path}/tri.fit").count() == 7
    assert source.where(F.col("workout_id").endswith("tri.fit")).select("sport").distinct().count() == 3
    assert spark.read.format("fit").option("partitionBytes", 1).load(str(tmp_path)).rdd.getNumPartitions() == 5
    with pytest.raises(Exception, match="no such column"):
        spark.read.format("fit").schema("watts int").load(str(tmp_path)).count()
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("fit").load(f"{tmp_path}/nowhere").count()


def test_only_wanted_columns_are_built():
    built = fit.samples("p", ride(), wanted=frozenset({"power"}))
    assert "power" in built and not {"heart_rate", "distance", "elevation"} & built.keys()


def test_files_pruned_by_filters(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In
    from pyspark.sql.types import StructType

    for n in "abc":
        (tmp_path / f"{n}.fit").write_bytes(ride(3))
    of = lambda n: f"file:{tmp_path}/{n}.fit"
    reader = fit_format.FitReader(StructType.fromDDL("seq int"), {"path": str(tmp_path)})
    asked = [In(("workout_id",), (of("a"), of("b"))), EqualTo(("workout_id",), of("b")), GreaterThan(("seq",), 1)]
    assert list(reader.pushFilters(asked)) == asked and [p.paths for p in reader.partitions()] == [(of("b"),)]


def test_partitions_by_size():
    files = [(f"f{i}", 10 * i) for i in range(20)] + [("huge", 5000)]
    parts = fit_format.planned(files, 200, 5)
    assert sorted(p for part in parts for p in part) == sorted(n for n, _ in files) and ("huge",) in parts
    size = dict(files)
    assert all(sum(size[p] + 5 for p in part) <= 200 for part in parts if part != ("huge",)) and len(parts) < 16
    assert fit_format.planned([]) == []


def test_workout_files(spark, tmp_path):
    workouts = spark.createDataFrame([(1, "a <b> & \"c\"", "Running", 7, 3), (2, None, None, None, 4), (3, " ", "Cycling", 8, 0)], "workout_id long, notes string, sport string, athlete_id long, duration_seconds int").withColumn("date", F.lit("2024-05-01").cast("date"))
    points = spark.createDataFrame([(1, i, i, 100 + i, None if i == 1 else 200, 1.5, i // 2 + 1) for i in range(5)] + [(2, 0, 0, None, None, None, None)], "workout_id long, seq int, ts_s int, heart_rate int, power int, speed double, lap_number int")
    curves = spark.createDataFrame([(1, d, 300 - d) for d in range(1, 4)], "workout_id long, duration_s int, max_power int")
    path = str(tmp_path / "out")
    workout_files.write(workouts, points, path, curves)
    files = sorted((tmp_path / "out").glob("workout_id=*/*.xml"))
    assert [f.parent.name for f in files] == ["workout_id=1", "workout_id=2", "workout_id=3"]
    ns = "{http://www.peaksware.com/PWX/1/0}"
    first, second, third = (ET.parse(f).getroot().find(f"{ns}workout") for f in files)
    text = lambda e, *tags: e.findtext("/".join(ns + t for t in tags))
    assert (text(first, "title"), text(first, "notes"), text(first, "sportType"), text(first, "athlete", "name"), text(first, "time")) == ("a <b> & \"c\"",) * 2 + ("Run", "7", "2024-05-01T00:00:00+00:00")
    assert (text(second, "title"), text(second, "sportType"), text(second, "athlete", "name"), text(third, "title"), text(third, "notes")) == ("2", "Cross", "Unknown Athlete", "3", None)
    assert [e.findtext(f"{ns}name") for e in first.iter(f"{ns}segment")] == ["Lap 1", "Lap 2", "Lap 3"] and len(list(first.iter(f"{ns}peak"))) == 3
    assert len(first.findall(f"{ns}sample")) == 5 and first.findall(f"{ns}sample")[1].find(f"{ns}pwr") is None and not third.findall(f"{ns}sample")
    got = workout_files.read(spark, path).select("workout_id", "ts_s", "heart_rate", "power", "speed").collect()
    assert sorted(map(tuple, got), key=str) == sorted((tuple(r) for r in points.select("workout_id", "ts_s", "heart_rate", "power", "speed").collect()), key=str)
