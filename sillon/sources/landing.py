"""Landing zones: folders of Parquet shards, pinned at a revision, as a Spark data source for batches and streams.

``spark.read.format("landing")`` and ``spark.readStream.format("landing")`` take a folder (``path``), a revision below it,
a pattern of shards and a mapping from the names of the rows' fields to the shards' physical columns (``fields``, JSON).
Shards come in the order of names. A task reads a shard, or of a shard of more than ``SPLIT_BYTES`` the row groups whose
middle is in its range of bytes; it reads the physical columns that the mapping names and no others, batch by batch, and
a shard that lacks one is an error that names it. A stream's offset is the time and name of the last
shard that it has planned, together with the revision, so a query that starts again reads each shard once and refuses
another revision.
"""

from __future__ import annotations

import fnmatch
import json
import re
import urllib.parse
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that a task hands on together.
BATCH_ROWS = 4096
#: Bytes of a shard that a task reads where the option ``split`` names no other; row groups aren't parted.
SPLIT_BYTES = 128 << 20


def opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    if path.startswith(("file:", "/")):
        return pa.fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    return pa.fs.FileSystem.from_uri(urllib.parse.quote(path, safe="/:@?=&"))


def listed(path: str, pattern: str) -> list[tuple[int, str]]:
    """Time of change and address of the shards below a folder whose relative names fit a pattern, by name."""
    return [(time, name) for time, name, _ in _sized(path, pattern)]


def _sized(path: str, pattern: str) -> list[tuple[int, str, int]]:
    """As ``listed``, with the bytes of each shard."""
    fs, root = opened(path)
    prefix = re.match(r"^([a-z0-9+.-]+://[^/]*)?", path)[0] if not path.startswith("file:") else "file://"
    found = fs.get_file_info(pa.fs.FileSelector(root, recursive=True, allow_not_found=True))
    names = sorted((f.path, f.mtime_ns or 0, f.size or 0) for f in found if f.is_file and fnmatch.fnmatch(f.path[len(root) :].lstrip("/"), pattern))
    return [(time, f"{prefix}/{name.lstrip('/')}" if prefix == "file://" else f"{prefix}{name}", size) for name, time, size in names]


def missing_of(path: str, columns: list[str]) -> tuple[list[str], int]:
    """Which columns a shard lacks, and how many rows it has, from its footer."""
    fs, inside = opened(path)
    with fs.open_input_file(inside) as f:
        footer = pq.ParquetFile(f)
        return sorted(set(columns) - set(footer.schema_arrow.names)), footer.metadata.num_rows


@dataclass
class Shard(InputPartition):
    path: str
    #: The range of bytes in which the middles of a task's row groups are.
    begin: int
    end: int


def _tasks(path: str, size: int, split: int) -> list[Shard]:
    """The ranges of a shard."""
    return [Shard(path, at, at + split) for at in range(0, max(1, size), split)]


def _groups(footer: pq.FileMetaData, shard: Shard) -> list[int]:
    """The row groups of a shard whose middles are in its range."""
    out = []
    for k in range(footer.num_row_groups):
        chunks = [footer.row_group(k).column(c) for c in range(footer.row_group(k).num_columns)]
        first = min((c.dictionary_page_offset if c.has_dictionary_page else c.data_page_offset) for c in chunks)
        if shard.begin <= first + sum(c.total_compressed_size for c in chunks) // 2 < shard.end:
            out.append(k)
    return out


class _Zone:
    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema = schema
        self.revision = options.get("revision", "")
        self.path = "/".join(x.strip("/") if i else x.rstrip("/") for i, x in enumerate((options["path"], self.revision)) if x)
        self.pattern = options.get("pattern", "*.parquet")
        self.split = int(options.get("split", SPLIT_BYTES))
        self.fields = json.loads(options["fields"]) if options.get("fields") else {n: n for n in schema.fieldNames()}
        if unknown := sorted(set(schema.fieldNames()) - set(self.fields)):
            raise ValueError(f"no physical columns for {unknown}")

    def read(self, shard: Shard) -> Iterator[pa.RecordBatch]:
        columns = [self.fields[n] for n in self.schema.fieldNames()]
        if missing := missing_of(shard.path, columns)[0]:
            raise ValueError(f"{shard.path}: missing columns {missing}")
        arrow = to_arrow_schema(self.schema)
        fs, inside = opened(shard.path)
        with fs.open_input_file(inside) as f:
            held = pq.ParquetFile(f)
            for batch in held.iter_batches(BATCH_ROWS, row_groups=_groups(held.metadata, shard), columns=sorted(set(columns))):
                yield pa.RecordBatch.from_arrays([batch.column(c).cast(a.type) for c, a in zip(columns, arrow, strict=True)], schema=arrow)


class ZoneReader(_Zone, DataSourceReader):
    def partitions(self) -> list[Shard]:
        shards = [t for _, p, n in _sized(self.path, self.pattern) for t in _tasks(p, n, self.split)]
        if not shards:
            raise ValueError(f"{self.path}: no shard fits {self.pattern}")
        return shards


class ZoneStream(_Zone, DataSourceStreamReader):
    def _offset(self, time: int, name: str) -> dict:
        return {"revision": self.revision, "time": time, "name": name}

    def initialOffset(self) -> dict:  # noqa: N802
        return self._offset(0, "")

    def latestOffset(self) -> dict:  # noqa: N802
        return self._offset(*max(listed(self.path, self.pattern), default=(0, "")))

    def partitions(self, start: dict, end: dict) -> list[Shard]:
        if start["revision"] != self.revision:
            raise ValueError(f"the stream began at revision {start['revision']!r}, not {self.revision!r}")
        a, b = ((x["time"], x["name"]) for x in (start, end))
        return [x for t, p, n in _sized(self.path, self.pattern) if a < (t, p) <= b for x in _tasks(p, n, self.split)]


class LandingZone(DataSource):
    """The data source ``landing``. A schema must be given."""

    @classmethod
    def name(cls) -> str:
        return "landing"

    def reader(self, schema: StructType) -> ZoneReader:
        return ZoneReader(schema, self.options)

    def streamReader(self, schema: StructType) -> ZoneStream:  # noqa: N802
        return ZoneStream(schema, self.options)


def _options(path: str, fields: dict[str, str], revision: str, pattern: str, split: int) -> dict[str, str]:
    return {"path": path, "fields": json.dumps(fields), "revision": revision, "pattern": pattern, "split": str(split)}


def zone(spark: SparkSession, path: str, schema: str, fields: dict[str, str], revision: str = "", pattern: str = "*.parquet", split: int = SPLIT_BYTES) -> DataFrame:
    """The rows of a landing zone's shards."""
    spark.dataSource.register(LandingZone)
    return spark.read.format("landing").schema(schema).options(**_options(path, fields, revision, pattern, split)).load()


def zone_stream(spark: SparkSession, path: str, schema: str, fields: dict[str, str], revision: str = "", pattern: str = "*.parquet", split: int = SPLIT_BYTES) -> DataFrame:
    """The rows of a landing zone's shards as they arrive."""
    spark.dataSource.register(LandingZone)
    return spark.readStream.format("landing").schema(schema).options(**_options(path, fields, revision, pattern, split)).load()


def shard_report(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """shard, n_rows and the columns that it lacks, for the Parquet files that a pattern names; executors read the footers."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select(F.col("path").alias("shard"))  # contents aren't read

    def run(batches):
        for batch in batches:
            found = [missing_of(p, columns) for p in batch.column("shard").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.array([n for _, n in found], type=pa.int64()), pa.array([m for m, _ in found], type=pa.list_(pa.string()))], names=["shard", "n_rows", "missing"])

    return listing.mapInArrow(run, "shard string, n_rows long, missing array<string>")
