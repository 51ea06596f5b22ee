"""Multi-sport files, and readings that claim rows in order."""

from __future__ import annotations

import random
import struct

from cadentia.operators import physiology, quality
from cadentia.sources import fit, sessions
from tests.test_fit import definition, fit_file


def triathlon() -> bytes:
    """Swim, ride and run: sessions at the end of the file, laps with a sport where each leg starts."""
    record = lambda t, v, d: bytes([0]) + struct.pack("<IHI", t, v, d)
    lap = lambda i, sport: bytes([1]) + struct.pack("<HB", i, sport)
    session = lambda start, sport, timer, sub: bytes([2]) + struct.pack("<IBIB", start, sport, timer, sub)
    return fit_file(
        definition(0, fit.RECORD, [(253, 4, 0x86), (6, 2, 0x84), (5, 4, 0x86)]) + definition(1, fit.LAP, [(254, 2, 0x84), (25, 1, 0x00)]) + definition(2, fit.SESSION, [(2, 4, 0x86), (5, 1, 0x00), (8, 4, 0x86), (6, 1, 0x00)])
        + lap(0, 5) + record(1000, 1000, 0) + record(1010, 1200, 1000) + lap(1, 2) + record(1020, 9000, 5000) + record(1030, 0xFFFF, 9000) + lap(2, 2) + record(1040, 8000, 0xFFFFFFFF)
        + lap(3, 1) + record(1050, 4000, 14000) + record(1060, 5000, 0xFFFFFFFF) + session(1000, 5, 15_500, 0) + session(1020, 2, 30_000, 0) + session(1050, 1, 10_000, 1)
    )


EXPECTED = [(0, 0, 1, "Swimming", 1, False), (1, 10, 1, "Swimming", 1, True), (2, 20, 2, "Cycling", 2, False), (3, 30, 2, "Cycling", 2, False), (4, 40, 2, "Cycling", 3, True), (5, 50, 3, "Running", 4, False), (6, 60, 3, "Running", 4, False)]


def test_sessions_and_transitions(spark, tmp_path):
    (tmp_path / "tri.fit").write_bytes(triathlon())
    found = fit.read_messages(spark, str(tmp_path)).cache()
    for points in (sessions.samples(found), fit.read_fit(spark, str(tmp_path))):
        got = [(r.seq, r.ts_s, r.session, r.sport, r.lap_number, r.sport_transition) for r in points.orderBy("seq").collect()]
        assert got == EXPECTED
    told = [(r.session, r.sport, r.workout_type, r.started - fit.EPOCH, r.duration_seconds) for r in sessions.sessions(found).orderBy("session").collect()]
    assert told == [(1, "Swimming", "Endurance", 1000, 15), (2, "Cycling", "Endurance", 1020, 30), (3, "Running", "Interval", 1050, 10)]
    sums = {r.session: (r.avg_pace, r.total_distance, r.samples, r.elevation_gain, r.avg_heart_rate) for r in sessions.summaries(sessions.samples(found)).collect()}
    assert sums == {1: (None, 10.0, 2, None, None), 2: (None, 90.0, 3, None, None), 3: (1000 / (4.5 * 60), 140.0, 2, None, None)}


def test_files_without_sessions_or_times(spark):
    schema = "file string, n int, number int, at long, values map<int,double>"
    rows = [("a", 0, 20, None, {3: 100.0}), ("a", 1, 20, 5000, {}), ("a", 2, 20, None, {7: 200.0}), ("b", 0, 18, None, {5: 11.0}), ("c", 0, 19, None, {254: 3.0}), ("c", 1, 20, 10, {}), ("d", 0, 18, None, None), ("d", 1, 20, 7, None)]
    out = sessions.samples(spark.createDataFrame(rows, schema)).orderBy("workout_id", "seq").collect()
    assert [(r.workout_id, r.seq, r.ts_s, r.session, r.sport, r.lap_number) for r in out] == [("a", 0, 0, 1, "Cycling", 1), ("a", 1, 0, 1, "Cycling", 1), ("a", 2, 0, 1, "Cycling", 1), ("c", 0, 0, 1, "Cycling", 4), ("d", 0, 0, 1, "Cycling", 1)]
    assert sessions.samples(spark.createDataFrame([], schema)).count() == 0
    assert [(r.file, r.sport, r.started, r.duration_seconds) for r in sessions.sessions(spark.createDataFrame(rows, schema)).orderBy("file").collect()] == [("b", "Cycling", None, 0), ("d", "Cycling", None, 0)]


def test_only_triathlons_are_bound_to_few_transitions(spark):
    rows = [(w, i, i, sport, True, lap) for w, sport, lap in ((1, "Running", 1), (2, "Triathlon", 1), (3, "Running", 0), (4, "Running", None)) for i in range(7)]
    points = spark.createDataFrame([*rows, (5, 0, 400, "Running", None, 1), (5, 1, 99, "Running", None, 502)], "workout_id int, seq int, ts_s int, sport string, sport_transition boolean, lap_number int")
    assert {r.workout_id: (r.transitions, r.lap_span, r.largest_back, r.ok) for r in quality.sequence_checks(points).collect()} == {1: (7, 0, 0, True), 2: (7, 0, 0, False), 3: (7, 0, 0, False), 4: (7, None, 0, True), 5: (0, 501, 301, False)}


def test_claims_are_those_of_a_plain_list():
    rng = random.Random(5)
    for _ in range(200):
        times = [None if rng.random() < 0.1 else rng.randint(0, 900) for _ in range(rng.randint(0, 6))]
        readings = sorted(((rng.randint(0, 900), rng.randint(0, 1)) for _ in range(rng.randint(0, 25))), key=lambda x: x[1])
        widths, entries, expected = [60.0, 300.0], list(times), []
        for t, kind in readings:
            near = [i for i, x in enumerate(entries) if x is not None and abs(x - t) < widths[kind]]
            if near:
                expected.append((near[0], False))
            else:
                expected.append((len(entries), True))
                entries.append(t)
        assert physiology.claims(times, readings, widths) == expected


def test_claim_in_order_keeps_everything(spark):
    base = spark.createDataFrame([(1, 100, 0, 7, "a"), (1, 130, 1, 8, "b"), (None, 5, 2, 9, "c"), (1, None, 3, 1, "d")], "k int, t int, o int, island int, `x y` string")
    breaths = spark.createDataFrame([(1, 120, 5, 14.0), (1, 110, 4, 12.0), (1, 400, 6, 15.0), (1, 430, 7, 16.0), (2, 1, 8, 9.0), (1, None, 9, 1.0), (1, 5, 10, None)], "k int, t int, o int, v double")
    out = physiology.claim_in_order(base, [(breaths, "v", 60)], "k", "t", "o")
    assert out.columns == ["k", "t", "o", "island", "x y", "v"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, 100, 0, 7, "a", 14.0), (1, 130, 1, 8, "b", None), (None, 5, 2, 9, "c", None), (1, None, 3, 1, "d", None), (1, 400, 6, None, None, 16.0), (2, 1, 8, None, None, 9.0)], key=str)
    assert physiology.claim_in_order(base.limit(0), [(breaths.limit(0), "v", 60)], "k", "t", "o").count() == 0
