"""Quality reports, inventories and source summaries of an accepted manifest.

Durations are given as whole frames and a frame rate, so that sums are exact whatever their order.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sillon.functions.text import characters, code_point, family, visible


def hours(frames: str = "frames", rate: str = "rate") -> Column:
    """Hours of summed frames."""
    return F.sum(F.col(frames)).cast("double") / F.max(rate) / 3600.0


def overall(rows: DataFrame) -> DataFrame:
    """Accepted rows, hours, speakers and dialects."""
    return rows.agg(F.count(F.lit(1)).alias("accepted"), hours().alias("hours"), F.countDistinct("speaker").alias("speakers"), F.countDistinct("dialect").alias("dialects"))


def by_split(rows: DataFrame) -> DataFrame:
    """Rows, hours and speakers of each split."""
    return rows.groupBy(F.coalesce("split", F.lit("unknown")).alias("split")).agg(F.count(F.lit(1)).alias("rows"), hours().alias("hours"), F.countDistinct("speaker").alias("speakers"))


def by_dialect(rows: DataFrame) -> DataFrame:
    return rows.filter(F.coalesce("dialect", F.lit("")) != "").groupBy("dialect").agg(F.count(F.lit(1)).alias("rows"))


def speaker_leakage(rows: DataFrame) -> DataFrame:
    """Speakers of more than one split."""
    return rows.filter("speaker is not null").groupBy("speaker").agg(F.countDistinct(F.coalesce("split", F.lit("unknown"))).alias("splits")).filter("splits > 1")


def inventory(rows: DataFrame, text: str = "text") -> DataFrame:
    """How often each character occurs. Counts combine before the shuffle."""
    return rows.select(F.explode(characters(F.col(text))).alias("char")).groupBy("char").agg(F.count(F.lit(1)).alias("n"))


def most_common(chars: DataFrame, n: int) -> DataFrame:
    """The ``n`` most frequent characters; the lesser character first where counts are equal."""
    return chars.orderBy(F.desc("n"), "char").limit(n)


def outside(chars: DataFrame, alphabet: str) -> DataFrame:
    """Characters that an alphabet lacks, with their code points."""
    return chars.filter(~F.col("char").isin(list(alphabet))).select("char", "n", code_point(F.col("char")).alias("codepoint"))


def grapheme_candidates(chars: DataFrame) -> DataFrame:
    """Letters and marks."""
    return chars.filter(F.col("char").rlike(r"[\p{L}\p{M}]"))


def source_summary(rows: DataFrame) -> DataFrame:
    """Rows, hours and speakers by source family, licence and revision."""
    known = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown"))
    return rows.groupBy(family(F.col("source_id")).alias("source"), known("source_license").alias("license"), known("source_revision").alias("revision")).agg(
        F.count(F.lit(1)).alias("rows"), hours().alias("hours"), F.countDistinct(F.nullif(F.trim("speaker"), F.lit(""))).alias("speakers")
    )


def provenance(rows: DataFrame) -> DataFrame:
    """The distinct licences and revisions, one a row."""
    pairs = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.nullif(F.col(c), F.lit("")).alias("value")) for k, c in (("license", "source_license"), ("revision", "source_revision"))])).alias("x"))
    return pairs.select("x.*").filter("value is not null").distinct()


@F.arrow_udf(StringType())
def _names(chars: pa.Array) -> pa.Array:
    return pa.array([None if c is None else unicodedata.name(c, "UNNAMED") for c in chars.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def _categories(chars: pa.Array) -> pa.Array:
    return pa.array([None if c is None else unicodedata.category(c) for c in chars.to_pylist()], pa.string())


def described(chars: DataFrame) -> DataFrame:
    """Characters with code point, name, category and whether they are white space."""
    c = F.col("char")
    return chars.withColumns({"codepoint": code_point(c), "name": _names(c), "category": _categories(c), "is_whitespace": ~visible(c)})


def rounded(report: DataFrame) -> DataFrame:
    """A report as it is written: hours to four places."""
    return report.withColumn("hours", F.round("hours", 4))
