"""Streaming ingestion whose result doesn't depend on how its input is cut into batches.

Row-at-a-time ingestion lets the first acceptable row of a digest win over the whole run. Batches see a part of the rows
only, and files may come in any order, so the state that outlives a batch is a store of digests: the least number of an
acceptable row for each digest that a batch has brought. A batch joins the digests it holds with the store, judges its
rows by the lesser of the two, and adds what is new or less to the store, under its own number; a batch that runs again
sees the store as it was before it and writes the same again. Should a later batch bring an earlier row, ``outcomes``
judges anew by the store as a whole, so accepted rows and journal are the same for any batches.

The store grows with distinct digests, is read by the digests of a batch, and isn't held in memory.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sillon.operators.compiler import repeated, with_first

#: Digests of a batch up to which the store is filtered by broadcasting them; some 100 bytes each.
BROADCAST_DIGESTS = 500_000


def first_wins(stream: DataFrame, digest: str, event_time: str | None = None, delay: str | None = None) -> DataFrame:
    """The first row of each digest to arrive. With an event time, digests are forgotten after ``delay``; without, they are kept for good."""
    if event_time and delay:
        return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([digest])
    return stream.dropDuplicates([digest])


@dataclass(frozen=True)
class Landing:
    """The folders of an ingestion. Tables have a folder for each batch."""

    base: str
    digest: str = "sha256"
    order: str = "rn"

    def of(self, what: str, batch: int | None = None) -> str:
        return f"{self.base.rstrip('/')}/{what}" + ("" if batch is None else f"/batch={batch}")

    def read(self, spark: SparkSession, what: str) -> DataFrame | None:
        """A table with all its batches; None before the first."""
        try:
            return spark.read.option("basePath", self.of(what)).option("mergeSchema", "true").parquet(self.of(what))
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def known(self, spark: SparkSession, before: int | None = None) -> DataFrame | None:
        """The least number of each digest, of all batches or of those before one."""
        store = self.read(spark, "digests")
        if store is None:
            return None
        return (store if before is None else store.filter(F.col("batch") < before)).select(self.digest, "least")


def _least(parts: DataFrame, digest: str) -> DataFrame:
    return parts.groupBy(digest).agg(F.min("least").alias("least"))


def ingest(stream: DataFrame, stage: Callable[[DataFrame], DataFrame], landing: Landing, **trigger: object) -> StreamingQuery:
    """Judges each micro-batch and adds to the tables accepted, rejected and digests of ``landing``.

    ``stage`` adds the arrays one and two (``compiler.staged``). Rows keep the reasons that they had in their batch.
    """
    digest, order = landing.digest, landing.order

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = stage(batch).persist()
        try:
            fine = (F.size("one") == 0) & (F.size("two") == 0)
            found = _least(rows.filter(fine).select(digest, F.col(order).alias("least")), digest)
            stored = landing.known(spark, number)
            if stored is not None:
                wanted = rows.filter(F.size("one") == 0).select(F.col(digest).alias("sillon_wanted")).distinct()
                wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_DIGESTS else wanted
                before = _least(stored.join(wanted, stored[digest].eqNullSafe(wanted["sillon_wanted"]), "left_semi"), digest).withColumnRenamed("least", "sillon_before")
                known = _least(found.unionByName(before.withColumnRenamed("sillon_before", "least")), digest)
                new = with_first(found, before, digest).filter(F.col("sillon_before").isNull() | (F.col("least") < F.col("sillon_before"))).drop("sillon_before")
            else:
                known = new = found
            new.write.mode("overwrite").parquet(landing.of("digests", number))
            unreadable = F.col("audio_error") if "audio_error" in rows.columns else None
            again = repeated(F.size("one") == 0, F.col(order), F.col("least"), unreadable)
            judged = with_first(rows, known, digest).withColumns({"reasons": F.concat("one", again, "two"), "passed": F.size("one") == 0}).drop("one", "two", "least")
            judged.filter(F.size("reasons") == 0).write.mode("overwrite").parquet(landing.of("accepted", number))
            judged.filter(F.size("reasons") > 0).write.mode("overwrite").parquet(landing.of("rejected", number))
        finally:
            rows.unpersist()

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", landing.of("checkpoint"))
    return query.trigger(**(trigger or {"availableNow": True})).start()


def outcomes(spark: SparkSession, landing: Landing) -> DataFrame | None:
    """All rows with their reasons, by the digests of all batches: none for accepted rows. None before the first batch."""
    parts = [x for what in ("accepted", "rejected") if (x := landing.read(spark, what)) is not None]
    if not parts:
        return None
    rows = (parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)).drop("batch")
    store = landing.known(spark)
    met = with_first(rows, _least(store, landing.digest), landing.digest) if store is not None else rows.withColumn("least", F.lit(None).cast("long"))
    unreadable = F.col("audio_error") if "audio_error" in rows.columns else None
    others = F.filter("reasons", lambda r: r != "duplicate_audio")
    return met.withColumn("reasons", F.concat(repeated(F.col("passed"), F.col(landing.order), F.col("least"), unreadable), others)).drop("least", "passed")
