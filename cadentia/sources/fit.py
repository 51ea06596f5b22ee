"""Decoding FIT files in parallel: one task reads whole files and yields their samples.

The format is a stream of definitions and data messages; a definition tells the
fields of the data messages that follow under its local number. Messages of unknown kinds are
skipped by their sizes; a file that breaks off keeps what was read. Python only turns bytes
into rows, once a file; what the messages mean (samples apart) are DataFrame expressions over them.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadentia.operators.admin import valid_physiology
from cadentia.operators.physiology import claim_in_order
from cadentia.sources.files import converted, metric_kind
from cadentia.sources.sessions import EPOCH, OTHER_SPORT, SPORTS

#: Base types by number: struct code and the value that means none.
BASE = {
    0x00: ("B", 0xFF), 0x01: ("b", 0x7F), 0x02: ("B", 0xFF), 0x83: ("h", 0x7FFF), 0x84: ("H", 0xFFFF), 0x85: ("i", 0x7FFFFFFF), 0x86: ("I", 0xFFFFFFFF),
    0x88: ("f", None), 0x89: ("d", None), 0x0A: ("B", 0), 0x8B: ("H", 0), 0x8C: ("I", 0), 0x0D: ("B", 0xFF), 0x8E: ("q", 0x7FFFFFFFFFFFFFFF), 0x8F: ("Q", 0xFFFFFFFFFFFFFFFF), 0x90: ("Q", 0),
}
#: Message numbers.
FILE_ID, SESSION, LAP, RECORD, DEVICE_INFO, MONITORING_INFO = 0, 18, 19, 20, 23, 103
FIELD_DESCRIPTION, DEVELOPER_DATA_ID, STRESS, SLEEP_LEVEL, RESPIRATION, SLEEP_ASSESSMENT, BODY_BATTERY = 206, 207, 227, 275, 297, 346, 370
TEXT, BYTES = 0x07, 0x0D
#: Sleep stages by level, seconds of a level's segment.
STAGES, SEGMENT_SECONDS = ("Awake", "Light", "Deep", "REM"), 30
#: Messages in one Arrow batch.
BATCH = 20_000
#: Record fields by number: name, scale, offset.
FIELDS = {
    2: ("elevation", 5, 500), 3: ("heart_rate", 1, 0), 4: ("cadence", 1, 0), 5: ("distance", 100, 0), 6: ("speed", 1000, 0), 7: ("power", 1, 0), 30: ("balance", 1, 0),
    39: ("vertical_oscillation", 10, 0), 41: ("ground_contact_time", 10, 0), 73: ("speed", 1000, 0), 78: ("elevation", 5, 500), 85: ("stride_length", 10_000, 0),
}
CHANNELS = ["elevation", "heart_rate", "cadence", "distance", "speed", "power", "balance", "vertical_oscillation", "ground_contact_time", "stride_length"]


class Message(NamedTuple):
    number: int
    values: dict[int, float]
    texts: dict[int, str]  # strings, and arrays of bytes in hexadecimal digits
    developer: dict[tuple[int, int], float]  # by index of the developer data and field number, where a description stands before


def _value(data: bytes, at: int, size: int, base: int, order: str) -> float | None:
    code, none = BASE.get(base, ("", None))
    if code and size == struct.calcsize("<" + code):
        value = struct.unpack_from(order + code, data, at)[0]
        if value != none and value == value:
            return value
    return None


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xA001 if byte & 1 else 0)
        table.append(byte)
    return table


#: Shares of each byte in the sixteen-bit checksum of polynomial 0x8005, lowest bit first.
CRC = _crc_table()


def crc16(data: bytes, value: int = 0) -> int:
    for byte in data:
        value = value >> 8 ^ CRC[(value ^ byte) & 0xFF]
    return value


class End:
    """How a file's messages ended: why not whole (None if they were), and the bytes that gave none."""

    def __init__(self) -> None:
        self.reason: str | None = None
        self.bytes_lost = 0

    def broken(self, reason: str, lost: int) -> None:
        self.reason = self.reason or reason
        self.bytes_lost += max(lost, 0)


def _next_definition(data: bytes, at: int, end: int) -> int:
    """The place of the next definition that can be one: reserved byte 0, a byte order, fields whose sizes fit their types; else the end."""
    while at + 6 <= end:
        n = data[at + 5]
        if data[at] & 0xD0 == 0x40 and data[at + 1] == 0 and data[at + 2] in (0, 1) and n and at + 6 + 3 * n <= end:
            fields = [(data[at + 7 + 3 * i], data[at + 8 + 3 * i]) for i in range(n)]
            if all(size and (base == TEXT or base in BASE and size % struct.calcsize("<" + BASE[base][0]) == 0) for size, base in fields):
                return at
        at += 1
    return end


def messages(data: bytes, told: End | None = None, salvage: bool = False) -> Iterator[Message]:
    """A file's data messages in order; none where the head isn't FIT.

    ``told`` learns why and where messages end before the file does, and whether the checksum holds. With ``salvage`` reading goes on at the next
    definition after damaged bytes, and past a head that doesn't tell the size; what was defined before no longer counts.
    """
    told = told or End()
    if len(data) < 14 or data[0] not in (12, 14) or data[8:12] != b".FIT":
        told.broken("not a FIT file", len(data))
        if not salvage or len(data) < 14:
            return
    sized = data[0] + struct.unpack_from("<I", data, 4)[0]
    at, end = data[0], min(len(data), sized)
    if told.reason is None and sized + 2 > len(data):
        told.broken("breaks off", 0)
    elif told.reason is None and crc16(data[: sized + 2]) != 0 and data[sized : sized + 2] != b"\0\0":
        told.broken("checksum", 0)
    if salvage and told.reason is not None:
        end = len(data) - (0 if told.reason == "breaks off" else 2)
        if told.reason == "not a FIT file":
            at = 0 if data[0] not in (12, 14) else data[0]
            told.bytes_lost = 0
    known: dict[int, tuple[int, str, list[tuple[int, int, int]], list[tuple[int, int, int]]]] = {}
    described: dict[tuple[int, int], int] = {}
    clock = 0
    while at < end:
        head = data[at]
        begin = at
        at += 1
        if not head & 0x80 and head & 0x40:  # a definition
            if salvage and _next_definition(data, begin, end) != begin:
                at = _next_definition(data, begin, end)
                told.broken("damaged", at - begin)
                known.clear()
                continue
            if at + 5 > end:
                told.broken("breaks off", end - begin)
                return
            order = ">" if data[at + 1] else "<"
            number = struct.unpack_from(order + "H", data, at + 2)[0]
            n = data[at + 4]
            at += 5
            if at + 3 * n > end:
                told.broken("breaks off", end - begin)
                return
            fields = [(data[at + 3 * i], data[at + 3 * i + 1], data[at + 3 * i + 2]) for i in range(n)]
            at += 3 * n
            extra = []
            if head & 0x20 and at < end:
                m = data[at]
                extra = [(data[at + 1 + 3 * i], data[at + 2 + 3 * i], data[at + 3 + 3 * i]) for i in range(m) if at + 3 + 3 * i < end]
                at += 1 + 3 * m
            known[head & 0x0F] = number, order, fields, extra
            continue
        local = head >> 5 & 3 if head & 0x80 else head & 0x0F
        if local not in known:
            at = _next_definition(data, begin, end) if salvage else end
            told.broken("damaged", at - begin)
            known.clear()
            continue
        number, order, fields, extra = known[local]
        if at + sum(x[1] for x in (*fields, *extra)) > end:
            told.broken("breaks off", end - begin)
            return
        out = Message(number, {}, {}, {})
        values = out.values
        for field, size, base in fields:
            if base == TEXT:
                out.texts[field] = data[at : at + size].split(b"\0")[0].decode("utf-8", "replace")
            elif base == BYTES and size > 1:
                out.texts[field] = data[at : at + size].hex()
            elif (value := _value(data, at, size, base, order)) is not None:
                values[field] = value
            at += size
        for field, size, index in extra:
            if (value := _value(data, at, size, described.get((index, field), -1), order)) is not None:
                out.developer[index, field] = value
            at += size
        if number == FIELD_DESCRIPTION and {0, 1, 2} <= values.keys():
            described[int(values[0]), int(values[1])] = int(values[2])
        if 253 in values:
            clock = int(values[253])
        elif head & 0x80:  # five bits of time roll on from the last full one
            clock += ((head & 0x1F) - clock) & 0x1F
            values[253] = clock
        yield out


def samples(path: str, data: bytes, told: End | None = None, salvage: bool = False, wanted: frozenset[str] | None = None) -> dict[str, list]:
    """Columns of a file's timed records, with lap, session, sport and sport change as sessions.samples has them for messages; of the channels those that are ``wanted``, or all."""
    channels = [c for c in CHANNELS if wanted is None or c in wanted]
    out: dict[str, list] = {c: [] for c in ("workout_id", "seq", "at", "lap_number", "sport_transition", *channels)}
    lap, lap_sport, found = 1, None, []
    for number, values, _, _ in messages(data, told, salvage):
        if number == LAP:
            lap = int(values[254]) + 1 if 254 in values else lap
            if 25 in values:
                sport = SPORTS.get(int(values[25]), OTHER_SPORT)
                if lap_sport not in (None, sport) and out["seq"]:
                    out["sport_transition"][-1] = True
                lap_sport = sport
        elif number == SESSION:
            found.append((int(values[2]) + EPOCH if 2 in values else None, SPORTS.get(int(values[5]), OTHER_SPORT) if 5 in values else OTHER_SPORT))
        elif number == RECORD and 253 in values:
            row = dict.fromkeys(channels)
            for field, value in values.items():
                if field in FIELDS:
                    name, scale, offset = FIELDS[field]
                    if name in row:
                        row[name] = value / scale - offset
            for c in channels:
                out[c].append(row[c])
            out["workout_id"].append(path)
            out["seq"].append(len(out["seq"]))
            out["at"].append(int(values[253]) + EPOCH)
            out["lap_number"].append(lap)
            out["sport_transition"].append(False)
    begin = found[0][0] if found and found[0][0] is not None else next(iter(out["at"]), 0)
    order = sorted(found, key=lambda x: (x[0] is not None, x[0] or 0)) or [(None, OTHER_SPORT)]
    starts = [-1 if x is None else x for x, _ in order]
    out["session"] = [max(bisect_right(starts, t), 1) for t in out["at"]]
    out["sport"] = [order[i - 1][1] for i in out["session"]]
    out["ts_s"] = [max(t - begin, 0) for t in out["at"]]
    return out


def read_fit(spark: SparkSession, path: str) -> DataFrame:
    """Samples of all FIT files at a path: workout_id (the file), seq, ts_s from its first session's start, session, sport, lap_number, sport_transition and channels; unreadable files give none."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    kinds = {"workout_id": pa.string(), "seq": pa.int32(), "at": pa.int64(), "lap_number": pa.int32(), "sport_transition": pa.bool_(), **{c: pa.float64() for c in CHANNELS}, "session": pa.int32(), "sport": pa.string(), "ts_s": pa.int32()}

    def decode(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = samples(name, data)
                yield from pa.Table.from_arrays([pa.array(found[c], kind) for c, kind in kinds.items()], names=list(kinds)).to_batches(BATCH)

    schema = "workout_id string, seq int, at long, lap_number int, sport_transition boolean, " + ", ".join(f"{c} double" for c in CHANNELS) + ", session int, sport string, ts_s int"
    whole = {c: F.col(c).cast("int") for c in ("elevation", "heart_rate", "cadence", "power", "balance", "ground_contact_time", "vertical_oscillation")}
    return files.mapInArrow(decode, schema).withColumns(whole)


# -- messages other than samples ------------------------------------------------------------------


def read_messages(spark: SparkSession, path: str, numbers: tuple[int, ...] | None = None) -> DataFrame:
    """Data messages of all FIT files at a path: file, n (place in the file), number, at (Unix seconds or null), values, texts and developer (arrays of number and value)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def decode(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for n, m in enumerate(messages(data)):
                    if numbers is None or m.number in numbers:
                        at = int(m.values[253]) + EPOCH if 253 in m.values else None
                        developer = [{"index": i, "field": f, "value": float(v)} for (i, f), v in m.developer.items()]
                        rows.append((name, n, m.number, at, [(k, float(v)) for k, v in m.values.items()], list(m.texts.items()), developer))
                    if len(rows) == BATCH:
                        yield table(rows)
                        rows = []
                if rows:
                    yield table(rows)

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    names = ["file", "n", "number", "at", "values", "texts", "developer"]
    developer = pa.list_(pa.struct([("index", pa.int32()), ("field", pa.int32()), ("value", pa.float64())]))
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.map_(pa.int32(), pa.float64()), pa.map_(pa.int32(), pa.string()), developer]
    return files.mapInArrow(decode, "file string, n int, number int, at long, values map<int,double>, texts map<int,string>, developer array<struct<index:int,field:int,value:double>>")


def _field(number: int) -> Column:
    return F.col("values")[F.lit(number)]


def _at_most(value: Column, most: int) -> Column:
    """A value, or the bound where it is larger; null stays null."""
    return F.when(value > most, F.lit(most)).otherwise(value).cast("int")


def _time(local: int | None = None) -> Column:
    """A message's time, else its local time field."""
    stamp = F.col("at") if local is None else F.coalesce(F.col("at"), _field(local).cast("long") + EPOCH)
    return F.timestamp_seconds(stamp)


def hrv(found: DataFrame, rmssd: int = 8, activity: int = 1, local: int = 0) -> DataFrame:
    """(file, ts, rmssd, context) of monitoring messages whose RMSSD is from 10 to 200; the field numbers are parameters."""
    rows = found.where(F.col("number") == MONITORING_INFO).select("file", _time(local).alias("ts"), _field(rmssd).alias("rmssd"), F.concat(F.lit("activity_"), _field(activity).cast("int")).alias("context"))
    return rows.where("ts is not null and rmssd between 10 and 200")


def sleep_segments(found: DataFrame, level: int = 0, local: int = 2) -> DataFrame:
    """(file, stage, start_time, end_time): sleep levels 0 to 3, each thirty seconds long."""
    start = _time(local)
    stage = F.element_at(F.array(*map(F.lit, STAGES)), _field(level).cast("int") + 1)
    rows = found.where((F.col("number") == SLEEP_LEVEL) & _field(level).between(0, len(STAGES) - 1))
    return rows.select("file", stage.alias("stage"), start.alias("start_time"), (start + F.make_interval(secs=F.lit(SEGMENT_SECONDS))).alias("end_time")).where("start_time is not null")


def sleep_times(found: DataFrame) -> DataFrame:
    """(file, start_time, end_time, segments, minutes by stage): one session a file, from its first segment's start to its last one's end."""
    seconds = F.unix_timestamp("end_time") - F.unix_timestamp("start_time")
    g = sleep_segments(found).groupBy("file")
    return g.agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.count("*").alias("segments"), *[F.expr(f"sum(case when stage = '{x}' then {SEGMENT_SECONDS} else 0 end) div 60").alias(f"{x.lower()}_minutes") for x in STAGES])


def sleep_assessments(found: DataFrame, start: int = 0, end: int = 1, latency: int = 2) -> DataFrame:
    """(file, start_time, end_time, onset_minutes) of assessment messages that have both times; the end is else the message's own time."""
    moment = lambda k: F.timestamp_seconds(_field(k).cast("long") + EPOCH)
    rows = found.where(F.col("number") == SLEEP_ASSESSMENT).select("file", moment(start).alias("start_time"), F.coalesce(moment(end), _time()).alias("end_time"), _at_most(F.floor(_field(latency) / 60), 65_535).alias("onset_minutes"))
    return rows.where("start_time is not null and end_time is not null")


def body_battery(found: DataFrame, level: int = 0, local: int = 1) -> DataFrame:
    """(file, ts, start_level, end_level): a reading is both levels, 100 at most."""
    reading = _at_most(_field(level), 100)
    rows = found.where(F.col("number") == BODY_BATTERY).select("file", _time(local).alias("ts"), reading.alias("start_level"), reading.alias("end_level"))
    return rows.where("ts is not null and start_level is not null")


def physiology(found: DataFrame, resting_hr: int = 9, recovery: int = 10, respiration: int = 0, stress: int = 0, stress_time: int = 1, local: int = 0) -> dict[str, DataFrame]:
    """Valid rows of three kinds: ``monitoring`` (resting_hr, recovery_minutes), ``respiration`` and ``stress``, each (file, n, ts, value columns); rows out of range are dropped. merged_physiology joins them."""
    null = F.lit(None).cast("double")
    monitoring = found.where(F.col("number") == MONITORING_INFO).select("file", "n", _time(local).alias("ts"), _at_most(_field(resting_hr), 255).alias("resting_hr"), _at_most(_field(recovery), 65_535).alias("recovery_minutes"))
    monitoring = monitoring.where("ts is not null and coalesce(resting_hr, recovery_minutes) is not null").where(valid_physiology(F.col("resting_hr"), null, null, null))
    breaths = found.where(F.col("number") == RESPIRATION).select("file", "n", _time().alias("ts"), _field(respiration).alias("respiration"))
    breaths = breaths.where("ts is not null and respiration is not null").where(valid_physiology(null, F.col("respiration"), null, null))
    score = F.when(_field(stress) < 0, 0).otherwise(_at_most(_field(stress), 100))
    asked = F.timestamp_seconds(F.coalesce(_field(stress_time).cast("long") + EPOCH, F.col("at")))
    tense = found.where(F.col("number") == STRESS).select("file", "n", asked.alias("ts"), score.alias("stress")).where("ts is not null and stress is not null")
    return {"monitoring": monitoring, "respiration": breaths, "stress": tense}


def merged_physiology(found: DataFrame) -> DataFrame:
    """(file, n, ts, resting_hr, recovery_minutes, respiration, stress): monitoring rows with the respiration less than a minute and the stress less than five away; readings without such a row are rows of their own."""
    kinds = {k: rows.withColumn("ts", F.unix_timestamp("ts")) for k, rows in physiology(found).items()}
    out = claim_in_order(kinds["monitoring"], [(kinds["respiration"], "respiration", 60), (kinds["stress"], "stress", 300)], "file", "ts", "n")
    return out.withColumn("ts", F.timestamp_seconds("ts"))


def devices(found: DataFrame) -> DataFrame:
    """(file, manufacturer, product, firmware): the first file id that has both numbers, and the last software version."""
    ids = found.where((F.col("number") == FILE_ID) & _field(1).isNotNull() & _field(2).isNotNull()).groupBy("file").agg(F.min_by(F.struct(_field(1).cast("int").alias("manufacturer"), _field(2).cast("int").alias("product")), "n").alias("id"))
    firmware = found.where((F.col("number") == DEVICE_INFO) & _field(5).isNotNull()).groupBy("file").agg(F.max_by(_field(5).cast("int"), "n").alias("firmware"))
    return ids.join(firmware, "file", "left").select("file", "id.manufacturer", "id.product", "firmware")


def developer_applications(found: DataFrame) -> DataFrame:
    """(file, developer_index, uuid, manufacturer): developer data ids with an index and sixteen bytes; the last of an index counts."""
    digits = F.col("texts")[F.lit(1)]
    uuid = F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    rows = found.where((F.col("number") == DEVELOPER_DATA_ID) & _field(3).isNotNull() & (F.length(digits) == 32))
    last = F.max_by(F.struct(uuid.alias("uuid"), _field(2).cast("int").alias("manufacturer")), "n").alias("x")
    return rows.groupBy("file", _field(3).cast("int").alias("developer_index")).agg(last).select("file", "developer_index", "x.*")


def developer_fields(found: DataFrame) -> DataFrame:
    """(file, developer_index, field_number, name, base_type, units, scale, offset): descriptions with an index, a number, a type and a name; the last of a field counts."""
    text = lambda k: F.col("texts")[F.lit(k)]
    rows = found.where((F.col("number") == FIELD_DESCRIPTION) & _field(0).isNotNull() & _field(1).isNotNull() & _field(2).isNotNull() & text(3).isNotNull())
    last = F.max_by(F.struct(text(3).alias("name"), _field(2).cast("int").alias("base_type"), text(8).alias("units"), _field(6).alias("scale"), _field(7).alias("offset")), "n").alias("x")
    return rows.groupBy("file", _field(0).cast("int").alias("developer_index"), _field(1).cast("int").alias("field_number")).agg(last).select("file", "developer_index", "field_number", "x.*")


def registered(fields: DataFrame, applications: DataFrame, registry: DataFrame) -> DataFrame:
    """Developer fields with their application's uuid and, where (uuid, field_number) is registered, the registry's name, units and scale before their own."""
    known = registry.select("uuid", "field_number", F.col("name").alias("known_name"), F.col("units").alias("known_units"), F.col("scale").alias("known_scale"))
    rows = fields.join(applications.select("file", "developer_index", "uuid"), ["file", "developer_index"], "left").join(known, ["uuid", "field_number"], "left")
    return rows.select(
        "file", "developer_index", "field_number", "uuid", F.coalesce("known_name", "name").alias("name"), F.coalesce("known_units", "units").alias("units"), F.coalesce("known_scale", "scale").alias("scale"), "offset",
        F.col("known_name").isNotNull().alias("registered"),
    )


def developer_samples(found: DataFrame, fields: DataFrame) -> DataFrame:
    """(file, n, ts, name, kind, value): values of developer fields in records, scaled, with the metric that the name stands for."""
    rows = found.where(F.col("number") == RECORD).select("file", "n", _time().alias("ts"), F.explode("developer").alias("d")).select("file", "n", "ts", F.col("d.index").alias("developer_index"), F.col("d.field").alias("field_number"), F.col("d.value").alias("raw"))
    joined = rows.join(fields, ["file", "developer_index", "field_number"])
    return joined.select("file", "n", "ts", "name", metric_kind(F.col("name")).alias("kind"), converted(F.col("raw"), F.col("scale"), F.col("offset")).alias("value"))
