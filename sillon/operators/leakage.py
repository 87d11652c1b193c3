"""Exact-hash leakage between a training and an evaluation manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def digests(rows: DataFrame) -> DataFrame:
    """Digest, rows and sorted distinct source ids of each; a digest that isn't 64 characters long is an error."""
    sha = F.lower(F.trim(F.coalesce("sha256", F.lit(""))))
    checked = F.when(F.length(sha) == 64, sha).otherwise(F.raise_error(F.concat(F.lit("missing or invalid sha256: "), sha)))
    return rows.select(checked.alias("sha256"), "source_id").groupBy("sha256").agg(F.count(F.lit(1)).alias("rows"), F.sort_array(F.collect_set("source_id")).alias("sources"))


def overlap(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Digests on both sides with the sources of each."""
    a = digests(train).select("sha256", F.col("rows").alias("train_rows"), F.col("sources").alias("train_sources"))
    b = digests(evaluation).select("sha256", F.col("rows").alias("eval_rows"), F.col("sources").alias("eval_sources"))
    return a.join(b, "sha256")


def examples(found: DataFrame, n: int = 100) -> DataFrame:
    """The first ``n`` digests in order."""
    return found.orderBy("sha256").limit(n)


def totals(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Rows on each side, digests on both, and whether there are none."""
    sides = digests(train).select("sha256", F.col("rows").alias("a"), F.lit(0).cast("long").alias("b")).unionByName(digests(evaluation).select("sha256", F.lit(0).cast("long").alias("a"), F.col("rows").alias("b")))
    met = sides.groupBy("sha256").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    sums = met.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("training_rows"), F.coalesce(F.sum("b"), F.lit(0)).alias("evaluation_rows"), F.count_if(F.expr("a > 0 and b > 0")).alias("overlap_count"))
    return sums.withColumn("passed", F.col("overlap_count") == 0)


def assert_none(train: DataFrame, evaluation: DataFrame) -> None:
    """Raises if a digest is on both sides."""
    n = totals(train, evaluation).first().overlap_count
    if n:
        raise RuntimeError(f"exact leakage between training and evaluation: {n} digest(s)")
