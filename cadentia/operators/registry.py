"""Rules and device quirks as versioned tables: read from TOML, chosen as of a date, applied to samples."""

from __future__ import annotations

import tomllib
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadentia.functions.formula import quoted
from cadentia.operators import quality

#: Names of makers and products, and the quirks that are known from the start. A product that is named twice has the last name.
MAKERS = {1: "Garmin", 32: "Wahoo", 69: "Stages Cycling", 263: "4iiii"}
PRODUCTS = {(1, 2697): "Forerunner 945", (1, 2713): "Edge 1030", (1, 3122): "Edge 130", (1, 3589): "Forerunner 255", (32, 16): "ELEMNT BOLT", (32, 27): "ELEMNT ROAM"}
CADENCE, SPIKES, LEFT_ONLY, DYNAMICS = "cadence_scaling", "power_spike_start", "left_only_power_doubling", "running_dynamics_scaling"
QUIRKS = [
    {"name": "Edge 520 reports cadence doubled", "manufacturer": 1, "product": 2697, "quirk": CADENCE, "factor": 0.5},
    {"name": "BOLT has power spikes in first 5 seconds", "manufacturer": 32, "product": 16, "quirk": SPIKES, "threshold": 1500, "seconds": 5},
    {"name": "Left-only power should not be doubled", "manufacturer": 69, "product": 0, "quirk": LEFT_ONLY},
    {"name": "FR 945 running dynamics field scaling issues", "manufacturer": 1, "product": 2697, "firmware_from": 0, "firmware_to": 1000, "quirk": DYNAMICS, "gct": 0.1, "vo": 0.1},
]
#: What entries of each kind have: field, type, whether it must be there.
RULE_FIELDS = [("name", str, True), ("sport", str, True), ("field", str, True), ("low", float, False), ("high", float, False), ("severity", str, True), ("action", str, True)]
QUIRK_FIELDS = [
    ("name", str, True), ("manufacturer", int, True), ("product", int, True), ("firmware_from", int, False), ("firmware_to", int, False), ("quirk", str, True),
    ("factor", float, False), ("threshold", int, False), ("seconds", int, False), ("gct", float, False), ("vo", float, False), ("enabled", bool, False),
]
_TYPES = {str: "string", int: "int", float: "double", bool: "boolean"}
_ONE_OF = {"severity": ("Info", "Warning", "Error"), "action": ("Clip", "Interpolate", "Flag", "Reject"), "quirk": (CADENCE, SPIKES, LEFT_ONLY, DYNAMICS)}
_NEEDS = {CADENCE: ("factor",), SPIKES: ("threshold", "seconds"), LEFT_ONLY: (), DYNAMICS: ()}


class RegistryError(ValueError):
    """Entries that can't be taken."""


def _checked(entry: dict, fields: list) -> dict:
    names = {n for n, *_ in fields}
    if entry.keys() - names:
        raise RegistryError(f"unknown fields {sorted(entry.keys() - names)}")
    out = {}
    for name, kind, needed in fields:
        value = entry.get(name)
        if kind is float and isinstance(value, int) and not isinstance(value, bool):
            value = float(value)
        if value is None and needed or value is not None and (not isinstance(value, kind) or isinstance(value, bool) != (kind is bool)):
            raise RegistryError(f"{name} of {entry.get('name')} must be a {_TYPES[kind]}")
        if name in _ONE_OF and value not in _ONE_OF[name]:
            raise RegistryError(f"unknown {name} {value}")
        out[name] = value
    if out.get("low") is not None and out.get("high") is not None and out["low"] > out["high"]:
        raise RegistryError(f"bounds of {out['name']} are the wrong way round")
    if missing := [n for n in _NEEDS.get(out.get("quirk"), ()) if out[n] is None]:
        raise RegistryError(f"{out['name']} needs {missing[0]}")
    return out


def read_toml(text: str, kind: str) -> list[dict]:
    """Entries of ``[[rules]]`` or ``[[quirks]]``, checked; names are unique."""
    try:
        said = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise RegistryError(f"invalid TOML: {e}") from e
    entries = [_checked(x, RULE_FIELDS if kind == "rules" else QUIRK_FIELDS) for x in said.get(kind, [])]
    if len({x["name"] for x in entries}) < len(entries):
        raise RegistryError("a name is taken twice")
    return entries


def write_toml(entries: list[dict], kind: str) -> str:
    value = lambda x: quoted(x) if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else repr(x)
    return "\n".join(f"[[{kind}]]\n" + "".join(f"{k} = {value(v)}\n" for k, v in x.items() if v is not None) for x in entries)


def default_rules() -> list[dict]:
    return [dict(zip([n for n, *_ in RULE_FIELDS], (f"{r[0]} {r[1]}", *r), strict=True)) for r in quality.RULES]


def version(spark: SparkSession, entries: list[dict], kind: str, since: date, retired: tuple[str, ...] = ()) -> DataFrame:
    """Entries as rows of a registry that hold from a day on, numbered in order; names in ``retired`` end on that day. Versions are unioned to a registry."""
    fields = RULE_FIELDS if kind == "rules" else QUIRK_FIELDS
    ddl = "place int, since date, retired boolean, " + ", ".join(f"{n} {_TYPES[k]}" for n, k, _ in fields)
    rows = [(i, since, False, *_checked(x, fields).values()) for i, x in enumerate(entries)]
    rows += [(None, since, True, *(name if n == "name" else None for n, *_ in fields)) for name in retired]
    return spark.createDataFrame(rows, ddl)


def as_of(registry: DataFrame, day: str) -> DataFrame:
    """The entries that hold on a day: of each name the latest version until then, unless it is retired (which wins a day)."""
    w = Window.partitionBy("name").orderBy(F.desc("since"), F.desc("retired"))
    seen = registry.where(F.col("since") <= F.lit(day).cast("date")).withColumn("age", F.row_number().over(w))
    return seen.where("age = 1 AND NOT retired").drop("age", "retired")


# -- quirks of devices ----------------------------------------------------------------------------


def named_devices(devices: DataFrame) -> DataFrame:
    """Devices (manufacturer, product) with the names of maker and product; an unknown product of a known maker is so called, an unknown maker has none."""
    maker = F.create_map(*(F.lit(x) for pair in MAKERS.items() for x in pair))[F.col("manufacturer")]
    product = F.create_map(*(F.lit(x) for (m, p), name in PRODUCTS.items() for x in (f"{m}:{p}", name)))[F.concat_ws(":", "manufacturer", "product")]
    return devices.withColumns({"maker_name": maker, "product_name": F.when(maker.isNotNull(), F.coalesce(product, F.lit("Unknown Product")))})


def quirks_of(devices: DataFrame, quirks: DataFrame) -> DataFrame:
    """(workout_id, quirks): what is to be applied to each workout (workout_id, manufacturer, product, firmware), in the registry's order; quirks that aren't enabled are left out."""
    free = F.col("firmware_from").isNull() & F.col("firmware_to").isNull()
    inside = F.col("firmware").isNotNull() & F.coalesce(F.col("firmware") >= F.col("firmware_from"), F.lit(True)) & F.coalesce(F.col("firmware") <= F.col("firmware_to"), F.lit(True))
    matched = devices.join(quirks.where(F.coalesce("enabled", F.lit(True))), ["manufacturer", "product"]).where(free | inside)
    item = F.struct("place", "name", "quirk", "factor", "threshold", "seconds", "gct", "vo")
    return matched.groupBy("workout_id").agg(F.array_sort(F.collect_list(item)).alias("quirks"))  # at most the registry


_CHANNELS = {"power": "int", "left_power": "int", "right_power": "int", "cadence": "int", "ground_contact_time": "int", "vertical_oscillation": "int"}


def _applied(state: Column, q: Column) -> Column:
    """One quirk on a sample's channels; ``fixed`` gains what it changed, (n, gct, vo)."""
    scaled = lambda x, by: F.round(x * by, 0).cast("int")
    is_ = lambda kind: q["quirk"] == kind
    spike = is_(SPIKES) & F.coalesce((state["ts_s"] <= q["seconds"]) & (state["power"] > q["threshold"]), F.lit(False))
    left = is_(LEFT_ONLY) & state["left_power"].isNotNull() & state["right_power"].isNull()
    cadence = is_(CADENCE) & state["cadence"].isNotNull()
    gct = is_(DYNAMICS) & q["gct"].isNotNull() & state["ground_contact_time"].isNotNull()
    vo = is_(DYNAMICS) & q["vo"].isNotNull() & state["vertical_oscillation"].isNotNull()
    return F.struct(
        state["ts_s"].alias("ts_s"), F.when(left, state["left_power"]).when(~spike, state["power"]).alias("power"), F.when(~spike, state["left_power"]).alias("left_power"), F.when(~spike, state["right_power"]).alias("right_power"),
        F.when(cadence, scaled(state["cadence"], q["factor"])).otherwise(state["cadence"]).alias("cadence"),
        F.when(gct, scaled(state["ground_contact_time"], q["gct"])).otherwise(state["ground_contact_time"]).alias("ground_contact_time"),
        F.when(vo, scaled(state["vertical_oscillation"], q["vo"])).otherwise(state["vertical_oscillation"]).alias("vertical_oscillation"),
        F.concat(state["fixed"], F.array(F.struct((spike | left | cadence).cast("int").alias("n"), gct.cast("int").alias("gct"), vo.cast("int").alias("vo")))).alias("fixed"),
    )


def _repaired(points: DataFrame, devices: DataFrame, quirks: DataFrame) -> DataFrame:
    value = lambda c: F.col(f"row.`{c}`") if c in points.columns else F.lit(None)
    carried = points.select("workout_id", F.struct(*(F.col(f"`{c}`") for c in points.columns)).alias("row")).join(quirks_of(devices, quirks), "workout_id", "left")
    start = F.struct(value("ts_s").cast("int").alias("ts_s"), *(value(c).cast(k).alias(c) for c, k in _CHANNELS.items()), F.array().cast("array<struct<n:int,gct:int,vo:int>>").alias("fixed"))
    return carried.withColumn("state", F.when(F.col("quirks").isNotNull(), F.aggregate("quirks", start, _applied)))


def apply_quirks(points: DataFrame, devices: DataFrame, quirks: DataFrame) -> DataFrame:
    """Samples with the quirks of their workout's device undone, one after the other; all other columns as they were."""
    fixed = lambda c: F.when(F.col("quirks").isNotNull(), F.col(f"state.{c}").cast(points.schema[c].dataType)).otherwise(F.col(f"row.`{c}`")).alias(c)
    return _repaired(points, devices, quirks).select(*(fixed(c) if c in _CHANNELS else F.col(f"row.`{c}`") for c in points.columns))


def quirk_messages(points: DataFrame, devices: DataFrame, quirks: DataFrame) -> DataFrame:
    """(workout_id, place, message) of each quirk that is applied, and one of place null for workouts with samples where none is."""
    rows = _repaired(points, devices, quirks)
    done = rows.where("quirks IS NOT NULL").select("workout_id", F.posexplode("state.fixed").alias("i", "f"), "quirks").select("workout_id", "f.*", F.get("quirks", F.col("i")).alias("q"))
    sums = done.groupBy("workout_id", "q").agg(*(F.sum(c).alias(c) for c in ("n", "gct", "vo")))
    plain = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\.0$", "")
    parts = F.array_compact(F.array(*(F.when(F.col(c) > 0, F.format_string(f"Fixed %d {name} values", c)) for c, name in (("gct", "ground contact time"), ("vo", "vertical oscillation")))))
    said = (
        F.when(F.col("q.quirk") == CADENCE, F.format_string("Applied cadence scaling (factor: %s) to %d data points", plain("q.factor"), "n"))
        .when(F.col("q.quirk") == SPIKES, F.format_string("Removed %d power spikes in first %d seconds (threshold: %d watts)", "n", "q.seconds", "q.threshold"))
        .when(F.col("q.quirk") == LEFT_ONLY, F.format_string("Fixed %d left-only power readings (prevented incorrect doubling)", "n"))
        .when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise("No running dynamics data to fix")
    )
    told = sums.select("workout_id", F.col("q.place").alias("place"), F.concat(F.col("q.name"), F.lit(": "), said).alias("message"))
    none = rows.where("quirks IS NULL").select("workout_id").distinct().select("workout_id", F.lit(None).cast("int").alias("place"), F.lit("No quirks applied").alias("message"))
    return told.unionByName(none)
