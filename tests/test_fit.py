"""FIT files written here, read back."""

from __future__ import annotations

import struct

from cadentia.sources import fit


def definition(local, number, fields, order="<"):
    return bytes([0x40 | local, 0, order == ">"]) + struct.pack(order + "H", number) + bytes([len(fields)]) + b"".join(bytes(f) for f in fields)


def fit_file(body: bytes) -> bytes:
    return bytes([14, 32]) + struct.pack("<H", 2132) + struct.pack("<I", len(body)) + b".FIT" + b"\0\0" + body + b"\0\0"


RECORD = [(253, 4, 0x86), (3, 1, 0x02), (7, 2, 0x84), (5, 4, 0x86), (2, 2, 0x84)]


def ride() -> bytes:
    record = lambda t, hr, w, d, e: bytes([0]) + struct.pack("<IBHIH", t, hr, w, d, e)
    return fit_file(
        definition(0, fit.RECORD, RECORD) + record(1000, 120, 200, 0, 3000) + record(1001, 0xFF, 0xFFFF, 500, 3005)
        + definition(1, fit.LAP, [(253, 4, 0x86), (254, 2, 0x84)]) + bytes([1]) + struct.pack("<IH", 1001, 1)
        + definition(2, 999, [(1, 3, 0x0D)]) + bytes([2]) + b"abc"
        + bytes([0x80 | (1003 & 0x1F)]) + struct.pack("<IBHIH", 0xFFFFFFFF, 130, 210, 1000, 3010)
        + definition(3, fit.SESSION, [(5, 1, 0x00)]) + bytes([3, 2])
    )


def test_read_fit(spark, tmp_path):
    (tmp_path / "ride.fit").write_bytes(ride())
    (tmp_path / "cut.fit").write_bytes(ride()[:60])
    (tmp_path / "no.fit").write_bytes(b"not a fit file at all")
    rows = fit.read_fit(spark, f"{tmp_path}/*.fit").collect()
    got = sorted((r.seq, r.ts_s, r.heart_rate, r.power, r.distance, r.elevation, r.lap_number, r.sport) for r in rows if r.workout_id.endswith("ride.fit"))
    assert got == [(0, 0, 120, 200, 0.0, 100, 1, "Cycling"), (1, 1, None, None, 5.0, 101, 1, "Cycling"), (2, 3, 130, 210, 10.0, 102, 2, "Cycling")]
    assert sum(r.workout_id.endswith("cut.fit") for r in rows) == 1 and not any(r.workout_id.endswith("no.fit") for r in rows)


def test_big_endian_and_developer_fields():
    body = bytes([0x60, 0, 1]) + struct.pack(">H", fit.RECORD) + bytes([2, 253, 4, 0x86, 7, 2, 0x84, 1, 0, 3, 0]) + bytes([0]) + struct.pack(">IH", 77, 250) + b"xyz"
    assert list(fit.messages(fit_file(body))) == [(fit.RECORD, {253: 77, 7: 250}, {}, {})]


UUID = bytes(range(16))


def watch() -> bytes:
    """A night and a run with a developer field, as a watch writes them."""
    u32 = lambda *x: struct.pack(f"<{len(x)}I", *x)
    level = lambda t, x: bytes([1]) + u32(t) + bytes([x])
    return fit_file(
        definition(0, fit.FILE_ID, [(1, 2, 0x84), (2, 2, 0x84)]) + bytes([0]) + struct.pack("<HH", 1, 3121)
        + definition(0, fit.DEVICE_INFO, [(253, 4, 0x86), (5, 2, 0x84)]) + bytes([0]) + u32(900) + struct.pack("<H", 650) + bytes([0]) + u32(901) + struct.pack("<H", 651)
        + definition(1, fit.SLEEP_LEVEL, [(253, 4, 0x86), (0, 1, 0x00)]) + level(1000, 1) + level(1030, 2) + level(1060, 2) + level(1090, 9) + level(1120, 3)
        + definition(2, fit.BODY_BATTERY, [(253, 4, 0x86), (0, 1, 0x02)]) + bytes([2]) + u32(2000) + bytes([61]) + bytes([2]) + u32(2060) + bytes([0xFF])
        + definition(3, fit.MONITORING_INFO, [(253, 4, 0x86), (8, 2, 0x84), (9, 1, 0x02), (1, 1, 0x00)])
        + bytes([3]) + u32(3000) + struct.pack("<HBB", 45, 50, 6) + bytes([3]) + u32(3060) + struct.pack("<HBB", 9, 25, 6) + bytes([3]) + u32(3120) + struct.pack("<HBB", 0xFFFF, 0xFF, 6)
        + definition(4, fit.RESPIRATION, [(253, 4, 0x86), (0, 1, 0x02)]) + bytes([4]) + u32(3001) + bytes([14])
        + definition(5, fit.STRESS, [(1, 4, 0x86), (0, 2, 0x83)]) + bytes([5]) + u32(3010) + struct.pack("<h", 33) + bytes([5]) + u32(3020) + struct.pack("<h", -2)
        + definition(6, fit.SLEEP_ASSESSMENT, [(253, 4, 0x86), (0, 4, 0x86), (2, 4, 0x86)]) + bytes([6]) + u32(1150, 1000, 600)
        + definition(0, fit.DEVELOPER_DATA_ID, [(3, 1, 0x02), (1, 16, 0x0D), (2, 2, 0x84)]) + bytes([0, 0]) + UUID + struct.pack("<H", 7)
        + definition(1, fit.FIELD_DESCRIPTION, [(0, 1, 0x02), (1, 1, 0x02), (2, 1, 0x02), (3, 14, 0x07), (6, 1, 0x02), (7, 1, 0x01), (8, 2, 0x07)])
        + bytes([1, 0, 5, 0x84]) + b"Running Power\0" + bytes([10, 0]) + b"W\0"
        + bytes([0x60 | 2, 0, 0]) + struct.pack("<H", fit.RECORD) + bytes([1, 253, 4, 0x86, 1, 5, 2, 0]) + bytes([2]) + u32(5000) + struct.pack("<H", 2500) + bytes([2]) + u32(5001) + struct.pack("<H", 0xFFFF)
    )


def test_messages_of_a_watch(spark, tmp_path):
    (tmp_path / "watch.fit").write_bytes(watch())
    (tmp_path / "ride.fit").write_bytes(ride())
    (tmp_path / "no.fit").write_bytes(b"nothing")
    found = fit.read_messages(spark, f"{tmp_path}/*.fit").cache()
    at = lambda t: t + fit.EPOCH
    seconds = lambda df, *columns: [tuple(int(x.timestamp()) if hasattr(x, "timestamp") else x for x in (r[c] for c in columns)) for r in df.collect()]
    assert [(r.manufacturer, r.product, r.firmware) for r in fit.devices(found).collect()] == [(1, 3121, 651)]
    assert seconds(fit.sleep_segments(found).orderBy("start_time"), "stage", "start_time", "end_time") == [(x, at(t), at(t + 30)) for x, t in (("Light", 1000), ("Deep", 1030), ("Deep", 1060), ("REM", 1120))]
    assert seconds(fit.sleep_times(found), "start_time", "end_time", "segments", "deep_minutes", "rem_minutes") == [(at(1000), at(1150), 4, 1, 0)]
    assert seconds(fit.sleep_assessments(found), "start_time", "end_time", "onset_minutes") == [(at(1000), at(1150), 10)]
    assert seconds(fit.body_battery(found), "ts", "start_level", "end_level") == [(at(2000), 61, 61)]
    assert seconds(fit.hrv(found), "ts", "rmssd", "context") == [(at(3000), 45.0, "activity_6")]
    kinds = fit.physiology(found)
    assert seconds(kinds["monitoring"], "ts", "resting_hr", "recovery_minutes") == [(at(3000), 50, None)]
    assert seconds(kinds["respiration"], "ts", "respiration") == [(at(3001), 14.0)]
    assert seconds(kinds["stress"].orderBy("ts"), "ts", "stress") == [(at(3010), 33), (at(3020), 0)]
    assert seconds(fit.merged_physiology(found), "ts", "resting_hr", "respiration", "stress") == [(at(3000), 50, 14.0, 0.0)]
    uuid = "00010203-0405-0607-0809-0a0b0c0d0e0f"
    applications, fields = fit.developer_applications(found), fit.developer_fields(found)
    assert [(r.developer_index, r.uuid, r.manufacturer) for r in applications.collect()] == [(0, uuid, 7)]
    assert [(r.field_number, r.name, r.base_type, r.units, r.scale, r.offset) for r in fields.collect()] == [(5, "Running Power", 0x84, "W", 10.0, 0.0)]
    registry = spark.createDataFrame([(uuid, 5, "running_power", "watts", 1.0), ("other", 5, "x", "y", 2.0)], "uuid string, field_number int, name string, units string, scale double")
    known = fit.registered(fields, applications, registry)
    assert [(r.name, r.units, r.scale, r.registered) for r in known.collect()] == [("running_power", "watts", 1.0, True)]
    assert [(r.name, r.kind, r.value) for r in fit.developer_samples(found, fields).collect()] == [("Running Power", "RunningPower", 250.0)]
