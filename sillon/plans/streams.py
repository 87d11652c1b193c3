"""Queries that run as streams in several batches, whose rows are those of the same work in one batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sillon.operators import review, signal, turns
from sillon.sources.tables import table
from sillon.sources.workspace import folder, materialize

from .views import review_events, turn_frames
from .workflow import ORACLES as BATCH


def _landing(rows: DataFrame, slices: Column, n: int, per_batch: int) -> tuple[DataFrame, str]:
    """A stream of files, one for each slice (0 to n - 1), written in that order, and the folder for what comes of it."""
    spark = rows.sparkSession
    base = folder(spark, "stream")
    for k in range(n):
        rows.filter(slices == k).coalesce(1).write.mode("append").parquet(f"{base}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", per_batch).parquet(f"{base}/in"), base


def _drained(stream: DataFrame, base: str) -> DataFrame:
    """What a stream gives until its input ends."""
    stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/out")


def _streamed(rows: DataFrame, batch: Column, n: int, of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``of`` makes of a stream whose batches (0 to n - 1, as ``batch`` deals the rows) are written one after the other.

    Many tasks write a batch's files; after each the stream takes them as one batch and ends, and the next run goes on
    from its offsets and state.
    """
    spark = rows.sparkSession
    base = folder(spark, "stream")
    dealt = materialize(rows.withColumn("batch", batch), "batches")
    for k in range(n):
        dealt.filter(F.col("batch") == k).drop("batch").write.mode("append").parquet(f"{base}/in")
        stream = of(spark.readStream.schema(rows.schema).parquet(f"{base}/in"))
        stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def _numbered(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("number", F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("long"))


def streamed_turns(spark, sf_dir):
    """Frames of connections that come in three batches, most of them before their predecessors."""
    frames = _numbered(turn_frames(spark, sf_dir), "conn_id", "seq")
    batch = F.floor(F.pmod(F.lit(5) - F.col("number"), F.lit(6)) / 2)
    return _streamed(frames, batch, 3, lambda stream: turns.turns_stream(stream, 10.0, number="number"))


def streamed_reviews(spark, sf_dir):
    """The first ten events of every item in batch, the others as a stream that goes on from there."""
    events = _numbered(review_events(spark, sf_dir), "item_id", "seq")
    before = events.filter("number <= 10")
    begin = materialize(review.workflow_states(before, "number"), "states")
    later = _streamed(events.filter("number > 10"), F.pmod(F.xxhash64("seq"), F.lit(2)), 2, lambda stream: review.audit_stream(stream, number="number", begin=begin))
    return review.audit(before).unionByName(later).drop("text")


def _moments(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))


def streamed_gaps(spark, sf_dir):
    """Runs of events by session windows, four batches in the order of time; a last event without a user moves the watermark past all."""
    e = _moments(spark, sf_dir)
    last = e.agg((F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts")).select(F.lit(None).cast("long").alias("user_id"), "ts")
    stream, base = _landing(e.unionByName(last), F.when(F.col("user_id").isNull(), 4).otherwise(F.least(F.lit(3), F.floor(F.dayofmonth("ts") / 8))), 5, 1)
    found = _drained(signal.sessions(stream, "user_id", "ts", "1 hour", "1 day"), base)
    return found.filter("user_id is not null").select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


def cut_gaps(spark, sf_dir):
    """Runs that a gap of six hours or a length of two days ends, as a stream of events in any order."""
    e = _moments(spark, sf_dir).select(F.col("user_id").alias("key"), F.unix_micros("ts").alias("at"))
    return signal.measured(_streamed(_numbered(e, "key", "at"), F.pmod(F.xxhash64("at"), F.lit(2)), 2, lambda stream: signal.labelled_stream(stream, _GAP, _MOST, "number")))


_GAP, _MOST = 6 * 3_600_000_000, 48 * 3_600_000_000

QUERIES = {f.__name__: f for f in (streamed_turns, streamed_reviews, streamed_gaps, cut_gaps)}

ORACLES = {
    "streamed_turns": BATCH["turn_buffers"],
    "streamed_reviews": BATCH["review_audit"],
    "streamed_gaps": f'SELECT user_id, start, "end", n FROM ({BATCH["gap_segments"]})',
    "cut_gaps": f"""WITH RECURSIVE e AS (SELECT user_id AS key, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events),
f AS (
  SELECT key, t, k, 0::BIGINT AS segment, t AS begun FROM e WHERE k = 1
  UNION ALL
  SELECT e.key, e.t, e.k, CASE WHEN e.t - f.t >= {_GAP} OR e.t - f.begun >= {_MOST} THEN f.segment + 1 ELSE f.segment END, CASE WHEN e.t - f.t >= {_GAP} OR e.t - f.begun >= {_MOST} THEN e.t ELSE f.begun END
  FROM f JOIN e ON e.key = f.key AND e.k = f.k + 1)
SELECT key, segment, min(t) AS start, max(t) AS "end", count(*) AS n FROM f GROUP BY key, segment""",
}
