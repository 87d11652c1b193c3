"""Shared parts of the text operators: Arrow stages, shared work folder, held-out folds."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows in an Arrow batch; long texts make larger batches costly.
BATCH_ROWS = 1000
#: Bytes in an Arrow batch, where Spark heeds it.
BATCH_BYTES = 32 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Limits the Arrow batches that Python stages of this session receive."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, list]], schema: str | StructType, start: Callable | None = None, gather: Callable | None = None) -> DataFrame:
    """``mapInArrow`` of a function from a batch to columns.

    ``start``, if given, is called once for each task and its result is the function's second argument; ``gather``, if
    given, makes other batches of a task's batches.
    """
    bounded_batches(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not start and not gather:
            give_up()  # an operator without a state follows one that had one
        state = start() if start else None
        for batch in gather(batches) if gather else batches:
            if not batch.num_rows:
                continue
            out = fn(batch, state) if start else fn(batch)
            columns = [x.cast(f.type) if isinstance(x := out[f.name], pa.Array) else pa.array(x, type=f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)
        trim()

    return df.mapInArrow(run, schema)


def add_columns(df: DataFrame, fn: Callable[..., dict[str, list]], new: str, start: Callable | None = None, gather: Callable | None = None) -> DataFrame:
    """``df`` with the columns that a function of a batch returns; they replace columns of the same names."""
    names = StructType.fromDDL(new).fieldNames()
    taken = {x.lower() for x in names}
    kept = [f for f in df.schema.fields if f.name.lower() not in taken]
    schema = StructType(kept + StructType.fromDDL(new).fields)

    def run(batch, *state):
        return {f.name: batch.column(f.name) for f in kept} | fn(batch, *state)

    return map_batches(df, run, schema, start, gather)


_state: list = []


def kept(key: tuple, build: Callable):
    """What ``build`` makes, kept while this worker asks for the same ``key``.

    A worker keeps one such state: the next operator's takes the place of the last one's, which gives up its tables if
    it has a method ``release``. So the caches of several operators in a row don't add up.
    """
    if not _state or _state[0] != key:
        give_up()
        _state[:] = [key, build()]
    return _state[1]


def give_up() -> None:
    """Drops the state that this worker keeps, if any, and returns unused memory."""
    if _state:
        if hasattr(_state[1], "release"):
            _state[1].release()
        _state.clear()
        gc.collect()
        trim()


def trim() -> None:
    """Returns what this worker has freed to the system, where its allocators can: idle workers count against an executor's memory."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


#: The allocator of the C library, if Python is linked against one.
_LIBC = ctypes.CDLL(None) if os.name == "posix" else None


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The batch's texts; a null is an empty text."""
    return [x or "" for x in batch.column(name).to_pylist()]


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names, which driver and executors share.

    Where the setting is absent, as in local tests, a temporary folder of this machine takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        base = "file://" + tempfile.mkdtemp(prefix="sillon-")
        spark.sparkContext.setCheckpointDir(base)
    if "://" not in base and not base.startswith("file:"):
        base = "file://" + os.path.abspath(base) if base.startswith("/") else base
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a few numbers each that a task should write at least.
TASK_ROWS = 20_000


def packed(df: DataFrame, rows: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """``df``, of at most ``rows`` rows, in no more partitions than these fill, however many a shuffle has left."""
    return df.coalesce(max(1, -(-rows // task_rows)))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the decimal doc_id modulo ``folds``; null where doc_id is null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def fresh(columns: list[str], prefix: str = "sillon_") -> str:
    """A prefix with which no column's name begins."""
    while any(c.lower().startswith(prefix) for c in columns):
        prefix = f"_{prefix}"
    return prefix


#: Rows up to which a narrow side may be broadcast; some 50 bytes each in an executor's hash table.
BROADCAST_ROWS = 2_000_000


def small_or_plain(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows, else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= limit else df


#: Rows of one key that a task should meet; the rows of keys with more are dealt over several tasks.
HOT_ROWS = 1000


def hot_of(sizes: DataFrame) -> DataFrame | None:
    """The rows of ``sizes`` (a key and n) with more than ``HOT_ROWS``, written once; None where there are none."""
    hot = sizes.filter(F.col("n") > HOT_ROWS)
    return None if hot.isEmpty() else materialize(hot, "hot")


def dealt_join(many: DataFrame, one: DataFrame, key: str, by: str, sizes: DataFrame | None) -> DataFrame:
    """``many`` joined with ``one``, which has at most one row a key, where a few keys may hold most rows of ``many``.

    ``sizes`` (key, n) says how many rows of ``many`` each key has at most, for frequent keys at least, and None that no
    key is frequent; it should be cheap to read. Rows of keys with more than ``HOT_ROWS`` are dealt by ``by`` over parts,
    and the row of ``one`` goes to each part.
    """
    hot = sizes.filter(F.col("n") > HOT_ROWS).select(key, F.ceil(F.col("n") / HOT_ROWS).alias("sillon_parts")) if sizes is not None else None
    n = hot.count() if hot is not None else 0
    if not n:
        return many.join(one, key)
    if n <= BROADCAST_ROWS:
        hot = F.broadcast(hot)
    parts = F.coalesce("sillon_parts", F.lit(1))
    dealt = many.join(hot, key, "left").withColumn("sillon_part", F.pmod(F.xxhash64(by), parts)).drop("sillon_parts")
    copied = one.join(hot, key, "left").withColumn("sillon_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("sillon_parts")
    return dealt.join(copied, [key, "sillon_part"]).drop("sillon_part")
