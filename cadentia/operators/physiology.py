"""Physiology readings merged in the order in which they arrive."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def claims(times: list[float | None], readings: list[tuple[float, int]], tolerances: list[float]) -> list[tuple[int, bool]]:
    """For each reading (time, kind), in order of kind, the place of the first entry nearer than the kind's tolerance; entries are the given times, then what was appended. True where the reading is appended as a new entry itself."""
    times, out, kind_now, near = list(times), [], None, {}
    for t, kind in readings:
        width = tolerances[kind]
        if kind != kind_now:  # places by time, in cells of the tolerance's width
            kind_now, near = kind, {}
            for place, x in enumerate(times):
                if x is not None:
                    near.setdefault(x // width, []).append(place)
        cell = t // width
        found = [next((p for p in near.get(c, ()) if abs(times[p] - t) < width), None) for c in (cell - 1, cell, cell + 1)]
        place = min((p for p in found if p is not None), default=None)
        if appended := place is None:
            place = len(times)
            times.append(t)
            near.setdefault(cell, []).append(place)
        out.append((place, appended))
    return out


def claim_in_order(base: DataFrame, readings: list[tuple[DataFrame, str, float]], key: str, time: str, order: str) -> DataFrame:
    """Rows of base (key, time, order, values) with the value of each kind of reading (key, time, order, value): of kinds in turn, each reading in its order.

    A reading goes to the first row of its key nearer than its kind's tolerance, base rows in their order first, then rows that readings made; the last
    of several counts. A reading near no row becomes a row itself, so nothing is lost. Rows without a time stay as they are, readings without a time
    or a value are dropped. Rows that lie further apart than the widest tolerance don't meet, so a key is cut at such gaps: a group is one island of a key.
    """
    kinds = [name for _, name, _ in readings]
    item = F.struct(*(F.col(f"`{c}`") for c in base.columns))
    parts = [base.select(F.col(key).alias("k"), F.col(time).cast("double").alias("t"), F.lit(-1).alias("kind"), F.col(order).cast("long").alias("o"), F.lit(None).cast("double").alias("v"), item.alias("item"))]
    for number, (rows, name, _) in enumerate(readings):
        rows = rows.where(F.col(time).isNotNull() & F.col(name).isNotNull())
        parts.append(rows.select(F.col(key).alias("k"), F.col(time).cast("double").alias("t"), F.lit(number).alias("kind"), F.col(order).cast("long").alias("o"), F.col(name).cast("double").alias("v"), F.lit(None).cast(parts[0].schema["item"].dataType).alias("item")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    w = Window.partitionBy("k").orderBy("t")
    widest = max((x for *_, x in readings), default=1)
    gap = F.coalesce((F.col("t") - F.lag("t").over(w) >= widest).cast("int"), F.lit(0))
    rows = rows.withColumn("gap", gap).withColumn("island", F.sum("gap").over(w)).drop("gap")
    tolerances = [float(x) for *_, x in readings]

    def merged(table: pa.Table) -> pa.Table:
        table = table.sort_by([("kind", "ascending"), ("o", "ascending"), ("t", "ascending"), ("v", "ascending")])
        kind, t, v = (table.column(c).to_pylist() for c in ("kind", "t", "v"))
        n = sum(x < 0 for x in kind)
        values: list[list[float | None]] = [[None] * n for _ in kinds]
        made = list(range(n))  # the table's row behind each entry
        for i, (place, appended) in enumerate(claims(t[:n], list(zip(t[n:], kind[n:], strict=True)), tolerances), n):
            if appended:
                made.append(i)
                for column in values:
                    column.append(None)
            values[kind[i]][place] = v[i]
        kept = table.select(["k", "t", "o", "item"]).take(pa.array(made, pa.int64()))
        for i, column in enumerate(values):
            kept = kept.append_column(f"v{i}", pa.array(column, pa.float64()))
        return kept

    schema = T.StructType([T.StructField(n, rows.schema[n].dataType) for n in ("k", "t", "o", "item")] + [T.StructField(f"v{i}", T.DoubleType()) for i in range(len(kinds))])
    out = rows.groupBy("k", "island").applyInArrow(merged, schema)
    own = lambda c: F.col(f"item.`{c}`")
    given = {key: "k", time: "t", order: "o"}
    columns = [F.coalesce(own(c), F.col(given[c]).cast(base.schema[c].dataType)).alias(c) if c in given else own(c).alias(c) for c in base.columns]
    return out.select(*columns, *(F.col(f"v{i}").alias(name) for i, name in enumerate(kinds)))
