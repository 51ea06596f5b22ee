"""FIT files as a data source: ``spark.read.format("fit").load(folder)``.

Partitions are planned from the files' sizes: small files share one, none is cut, as a file is read from its start. A schema that names
some of the columns is all that is built; comparisons of workout_id prune files where filters are pushed down.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from cadentia.sources import fit
from cadentia.sources.files import opened

#: Columns of the source, whole numbers where the files have them.
WHOLE = ("elevation", "heart_rate", "cadence", "power", "balance", "ground_contact_time", "vertical_oscillation")
KINDS = {
    "workout_id": ("string", pa.string()), "seq": ("int", pa.int32()), "at": ("long", pa.int64()), "lap_number": ("int", pa.int32()), "sport_transition": ("boolean", pa.bool_()),
    **{c: ("int", pa.int32()) if c in WHOLE else ("double", pa.float64()) for c in fit.CHANNELS}, "session": ("int", pa.int32()), "sport": ("string", pa.string()), "ts_s": ("int", pa.int32()),
}
#: Bytes of a partition, and what opening a file counts as.
PARTITION_BYTES, OPEN_BYTES = 128 << 20, 1 << 20


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


def planned(sizes: list[tuple[str, int]], most: int = PARTITION_BYTES, opening: int = OPEN_BYTES) -> list[tuple[str, ...]]:
    """Files (path, size) in partitions of about ``most`` bytes: each, from the largest down, to the first of the last few partitions that holds it."""
    parts: list[list] = []
    for path, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        room = next((p for p in parts[-64:] if p[0] + size + opening <= most), None)
        if room is None:
            room = [0, []]
            parts.append(room)
        room[0] += size + opening
        room[1].append(path)
    return [tuple(p[1]) for p in parts]


class FitReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns = [f.name for f in schema.fields]
        if unknown := [c for c in self.columns if c not in KINDS]:
            raise ValueError(f"no such column: {', '.join(unknown)}")
        self.path, self.glob, self.most = options.get("path"), options.get("pathGlobFilter", "*.fit"), int(options.get("partitionBytes", PARTITION_BYTES))
        self.salvage = str(options.get("salvage", "false")).lower() == "true"
        self.only: set[str] | None = None
        if not self.path:
            raise ValueError("name a path to load")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Files that no row of workout_id can be from are left out; Spark still evaluates every filter."""
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) and f.attribute == ("workout_id",) else set(f.value) if isinstance(f, In) and f.attribute == ("workout_id",) else None
            if wanted is not None:
                self.only = wanted if self.only is None else self.only & wanted
            yield f

    def partitions(self) -> list[Files]:
        system, path = opened(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and fnmatch.fnmatchcase(f.base_name, self.glob)]
        prefix = self.path[: len(self.path) - len(path)] if "://" in self.path and self.path.endswith(path) else "file:" if "://" not in self.path else self.path.split("://")[0] + "://"
        named = [(prefix + f.path, f.size) for f in found]
        return [Files(p) for p in planned([x for x in named if self.only is None or x[0] in self.only], self.most)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        kinds = {c: KINDS[c][1] for c in self.columns}
        for path in partition.paths:
            system, inner = opened(path)
            with system.open_input_stream(inner) as stream:
                data = stream.read()
            found = fit.samples(path, data, salvage=self.salvage, wanted=frozenset(self.columns))
            size = len(found["seq"])
            for begin in range(0, size, fit.BATCH):
                cut = [found[c][begin : begin + fit.BATCH] for c in self.columns]
                yield pa.RecordBatch.from_arrays([pa.array([None if x is None else int(x) for x in v] if c in WHOLE else v, kinds[c]) for c, v in zip(self.columns, cut, strict=True)], names=self.columns)


class FitDataSource(DataSource):
    """Options: pathGlobFilter (*.fit), partitionBytes (128 MiB), salvage (false): go on after damaged bytes."""

    @classmethod
    def name(cls) -> str:
        return "fit"

    def schema(self) -> str:
        return ", ".join(f"{c} {kind}" for c, (kind, _) in KINDS.items())

    def reader(self, schema: StructType) -> FitReader:
        return FitReader(schema, self.options)  # names in any case


def register(spark: SparkSession) -> None:
    """Make ``fit`` known to the session, which must push filters to Python sources for it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(FitDataSource)
