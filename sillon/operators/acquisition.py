"""Acquisition of catalogue sources with receipts: a run that was stopped goes on with the sources it hadn't finished.

A source's rows are judged, capped and written to a folder of that run; its receipt comes last, in one small write that
names the folder, so a source without a receipt was never acquired. A later run for the same request (revision, rate, cap)
takes a source as it is if the receipt holds: the metadata's digest is worked out anew and must be the same. The digest is
over the set of rows: sums of parts of each row's SHA-256, which tasks add up before anything is shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sillon.operators.governance import acquired, capped
from sillon.sources.config import admissible

RECEIPT = "source_id string, language string, task string, role string, resolved_revision string, sample_rate int, requested_max_samples long, imported long, skipped long, hours double, metadata_sha256 string, folder string"


@dataclass(frozen=True)
class Request:
    """What is asked of a source."""

    source_id: str
    language: str
    task: str
    role: str
    resolved_revision: str
    sample_rate: int = 16000
    requested_max_samples: int | None = None


def rows_digest(rows: DataFrame) -> str:
    """A digest of a table's rows in any order; rows that repeat count as often as they occur."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(rows.columns)]
    digest = F.sha2(F.concat_ws("\x1f", *texts), 256)
    sums = [F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)]
    total = rows.agg(F.count(F.lit(1)).alias("n"), *sums)
    return total.select(F.sha2(F.concat_ws(":", "n", *[F.coalesce(F.col(f"s{i}").cast("string"), F.lit("0")) for i in range(4)]), 256)).first()[0]


def receipts(spark: SparkSession, base: str) -> DataFrame:
    """All receipts below a folder."""
    try:
        spark.read.text(f"{base}/receipts").schema  # noqa: B018
    except AnalysisException:
        return spark.createDataFrame([], RECEIPT)
    return spark.read.schema(RECEIPT).option("recursiveFileLookup", True).json(f"{base}/receipts")


def metadata(spark: SparkSession, folder: str) -> DataFrame:
    """The imported rows that a receipt's folder holds."""
    return spark.read.parquet(f"{folder}/metadata")


def holds(spark: SparkSession, receipt: dict, request: Request) -> bool:
    """Whether a receipt stands for a request: the same revision, rate and cap, and metadata that is untouched."""
    if any(receipt[k] != v for k, v in asdict(request).items()):
        return False
    try:
        return rows_digest(metadata(spark, receipt["folder"])) == receipt["metadata_sha256"]
    except AnalysisException:
        return False


def acquire(spark: SparkSession, request: Request, rows: DataFrame, base: str, order: str = "rn", digest: str = "sha256", fine: str = "fine", duration: str = "duration") -> dict:
    """Acquires a source unless its receipt holds; the receipt, with ``reused``.

    ``rows`` (read only if needed) has the source's rows with their order, digest, duration and whether they can be used.
    """
    held = [r.asDict() for r in receipts(spark, base).filter((F.col("source_id") == request.source_id) & (F.col("language") == request.language) & (F.col("task") == request.task) & (F.col("role") == request.role)).collect()]
    for receipt in held:
        if holds(spark, receipt, request):
            return receipt | {"reused": True}
    place = "/".join((request.language, request.task, request.role, request.source_id))
    folder = f"{base}/data/{place}/{uuid.uuid4().hex}"
    outcomes = capped(rows.withColumn("sillon_source", F.lit(request.source_id)), "sillon_source", order, digest, F.coalesce(F.col(fine), F.lit(False)), request.requested_max_samples).drop("sillon_source")
    outcomes.write.parquet(f"{folder}/outcomes")
    judged = spark.read.schema(outcomes.schema).parquet(f"{folder}/outcomes")
    judged.filter("outcome = 'imported'").drop("outcome").write.parquet(f"{folder}/metadata")
    totals = acquired(judged.withColumn("sillon_source", F.lit(request.source_id)), "sillon_source", duration).first()
    counts = {"imported": totals.imported, "skipped": totals.skipped, "hours": totals.hours} if totals else {"imported": 0, "skipped": 0, "hours": 0.0}
    receipt = asdict(request) | counts | {"metadata_sha256": rows_digest(metadata(spark, folder)), "folder": folder}
    spark.createDataFrame([tuple(receipt[n] for n in _NAMES)], RECEIPT).coalesce(1).write.mode("overwrite").json(f"{base}/receipts/{place}")
    return receipt | {"reused": False}


_NAMES = [c.split()[0] for c in RECEIPT.split(", ")]


def acquire_all(spark: SparkSession, requests: list[Request], catalog: dict[str, dict], read: Callable[[Request], DataFrame], base: str, providers: set[str]) -> list[dict]:
    """Acquires the sources of a plan one after the other, after all of them were checked; their receipts.

    ``read`` gives a source's rows. A source that may not be acquired is an error before anything is read.
    """
    for r in requests:
        faults = admissible(catalog[r.source_id], r.language, r.task, r.role, providers, r.requested_max_samples, r.sample_rate)
        if faults:
            raise ValueError(f"{r.source_id}: {', '.join(faults)}")
    return [acquire(spark, r, read(r), base) for r in requests]
