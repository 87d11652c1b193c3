"""The corpus compiler: ordered acceptance rules that keep every reason, first-wins deduplication, splits, fingerprint.

Input rows have columns rn (their order), text, speaker, dialect, source_id, sha256, duration, channels, the flags
consent_attested, transcript_reviewed, governance_approved, upstream_validated, training_only, and has_audio. If they also
have rms, clipped and offset these count as well, and so does audio_error, why the sound can't be read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sillon.functions import digests
from sillon.functions.text import assign_split, present, visible
from sillon.sources.workspace import folder, materialize


@dataclass(frozen=True)
class Policy:
    """What a language's corpus asks of a row."""

    min_seconds: float = 0.5
    max_seconds: float = 20.0
    split_by_speaker: bool = True
    require_mono: bool = True
    require_consent: bool = True
    require_review: bool = True
    required: frozenset[str] = frozenset({"dialect", "source_id"})
    fixed_split: str | None = None
    sample_rate: int | None = None
    allow_suspicious: bool = False


def reasons(rules: list[tuple[Column, str | Column]]) -> Column:
    """The reasons whose conditions hold, in the order of the rules."""
    return F.array_compact(F.array(*[F.when(c, F.lit(r) if isinstance(r, str) else r) for c, r in rules]))


def suspicious(duration: Column, rms: Column | None = None, clipped: Column | None = None, offset: Column | None = None) -> Column:
    """Whether a clip is too short or long, silent, clipped or offset."""
    out = (duration < 0.35) | (duration > 30.0)
    if rms is not None:
        out = out | (rms < 1e-4)
    if clipped is not None:
        out = out | (clipped > 0.005)
    if offset is not None:
        out = out | (F.abs(offset) > 0.05)
    return out


def first_stage(policy: Policy) -> Column:
    """Reasons that need no look at the sound."""
    rules: list[tuple[Column, str | Column]] = [(~F.col("has_audio"), "missing_audio"), (~F.coalesce(visible(F.col("text")), F.lit(False)), "empty_text")]
    if policy.split_by_speaker and policy.fixed_split is None:
        rules.append((present(F.col("speaker")).isNull() & ~F.col("training_only"), "missing_speaker"))
    if policy.require_consent:
        rules.append((~(F.col("consent_attested") | F.col("governance_approved")), "governance_not_approved"))
    if policy.require_review:
        rules.append((~(F.col("transcript_reviewed") | F.col("upstream_validated")), "transcript_not_validated"))
    rules += [(present(F.col(c)).isNull(), f"missing_{c}") for c in ("dialect", "source_id") if c in policy.required]
    return reasons(rules)


def second_stage(policy: Policy, columns: list[str] = ()) -> Column:
    """Reasons that the sound gives, without duplicates. A sound that can't be read has no other."""
    figures = [F.col(c) if c in columns else None for c in ("rms", "clipped", "offset")]
    rules: list[tuple[Column, str | Column]] = []
    if policy.require_mono:
        rules.append((F.col("channels") != 1, "multichannel_audio"))
    if policy.sample_rate:
        rules.append((F.col("sample_rate") != policy.sample_rate, F.concat(F.lit("sample_rate:"), F.col("sample_rate").cast("string"))))
    rules += [(F.col("duration") < policy.min_seconds, "too_short"), (F.col("duration") > policy.max_seconds, "too_long")]
    if not policy.allow_suspicious:
        rules.append((suspicious(F.col("duration"), *figures), "quality_flag"))
    found = reasons([(F.coalesce(c, F.lit(False)), r) for c, r in rules])
    if "audio_error" in columns:
        found = F.when(F.col("audio_error").isNotNull(), F.array(F.concat(F.lit("audio_error:"), "audio_error"))).otherwise(found)
    return found


def staged(rows: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """``rows`` with the reasons of both stages as columns one and two; the second is empty where the first isn't."""
    none = F.array().cast("array<string>")
    return rows.withColumn("one", first_stage(policy)).withColumn("two", F.when(F.size("one") == 0, second_stage(policy, rows.columns)).otherwise(none))


def repeated(passed: Column, number: Column, first: Column, unreadable: Column | None = None) -> Column:
    """``duplicate_audio`` for a row that passed the first stage and comes after the first acceptable row of its digest."""
    seen = passed & F.coalesce(number > first, F.lit(False))
    if unreadable is not None:
        seen = seen & unreadable.isNull()
    return F.when(seen, F.array(F.lit("duplicate_audio"))).otherwise(F.array().cast("array<string>"))


def with_first(rows: DataFrame, firsts: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``firsts``, one row for each key; a null is a key like any other."""
    named = firsts.withColumnRenamed(key, "sillon_key")
    return rows.join(named, rows[key].eqNullSafe(named["sillon_key"]), "left").drop("sillon_key")


def judged(rows: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """``rows`` with columns reasons and split (null where rejected).

    A digest counts as seen once a row with it is accepted, so a row is a duplicate only after an accepted one. The
    first acceptable row of each digest comes from a grouped minimum, which combines before the shuffle, and a join that
    adaptive execution splits where one digest is frequent; a window would sort a digest's rows in one task. Rows without
    a digest are alike; rows that repeat a number and a digest are judged alike.
    """
    both = staged(rows, policy)
    fine = (F.size("one") == 0) & (F.size("two") == 0)
    met = with_first(both, both.filter(fine).groupBy("sha256").agg(F.min("rn").alias("sillon_first")), "sha256")
    again = repeated(F.size("one") == 0, F.col("rn"), F.col("sillon_first"), F.col("audio_error") if "audio_error" in rows.columns else None)
    out = met.withColumn("reasons", F.concat("one", again, "two"))
    key = F.col("speaker") if policy.split_by_speaker else F.col("sha256")
    return out.withColumn("split", F.when(F.size("reasons") == 0, assign_split(key, F.col("training_only"), policy.fixed_split))).drop("one", "two", "sillon_first")


def accepted(rows: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """The accepted rows with their split."""
    return judged(rows, policy).filter(F.size("reasons") == 0).drop("reasons")


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Whether each row repeats the ``key`` of an earlier one: column repeats. Rows without a key are alike."""
    met = with_first(rows, rows.groupBy(key).agg(F.min(order).alias("sillon_first")), key)
    return met.withColumn("repeats", F.col(order) > F.col("sillon_first")).drop("sillon_first")


#: Characters of all fields of all rows up to which a fingerprint is taken from one row, and characters of a part beyond.
FINGERPRINT_CHARS, PART_CHARS = 64 << 20, 128 << 20


def fingerprint(rows: DataFrame) -> DataFrame:
    """One row: fingerprint (SHA-256 over the sorted, joined fields of all rows) and n.

    A digest over all rows in order needs them one after the other. A small manifest is put into one row; a larger one
    goes part by part through tasks that hand on the digest's state (``fingerprint_of_large``).
    """
    kept = materialize(rows.select(_identity().alias("r")).select("r.*"), "identities")
    size = kept.agg(F.sum(_chars()).alias("chars"), F.count(F.lit(1)).alias("n")).first()
    if (size.chars or 0) > FINGERPRINT_CHARS:
        return rows.sparkSession.createDataFrame([(_chained(kept, size.chars), size.n)], "fingerprint string, n long")
    return kept.agg(F.sort_array(F.collect_list(F.struct(*_IDENTITY))).alias("all"), F.count(F.lit(1)).alias("n")).select(
        F.sha2(F.concat_ws("", F.transform("all", lambda r: F.concat(F.concat_ws("\x1f", *[r[c] for c in _IDENTITY]), F.lit("\n")))), 256).alias("fingerprint"), "n"
    )


_IDENTITY = ("sha256", "text", "speaker", "dialect", "source_id", "source_license", "source_revision", "only", "split")


def _identity() -> Column:
    only = F.when(F.col("training_only"), "training-only").otherwise("split-eligible").alias("only")
    return F.struct(*[only if c == "only" else F.coalesce(F.col(c), F.lit("")).alias(c) for c in _IDENTITY])


def _chars() -> Column:
    return reduce(lambda a, b: a + b, [F.length(c) for c in _IDENTITY])


def fingerprint_of_large(rows: DataFrame) -> str:
    """The digest of ``fingerprint`` with bounded memory.

    Rows are ranged over parts of about ``PART_CHARS`` characters. One task a part, in their order, sorts its rows and takes
    the digest on from the state that the part before left; the driver sees these states (112 bytes) alone. Only where
    the crypto library can't hand on a state, the rows are streamed through the driver, partition by partition.
    """
    kept = materialize(rows.select(_identity().alias("r")).select("r.*"), "identities")
    return _chained(kept, kept.agg(F.sum(_chars())).first()[0] or 0)


def _chained(kept: DataFrame, chars: int) -> str:
    if not digests.resumable():
        whole = hashlib.sha256()
        for r in kept.orderBy(*_IDENTITY).toLocalIterator():
            whole.update("\x1f".join(r).encode() + b"\n")
        return whole.hexdigest()
    parts, path = max(1, -(-chars // PART_CHARS)), folder(kept.sparkSession, "ranges")
    kept.repartitionByRange(parts, *_IDENTITY).withColumn("part", F.spark_partition_id()).write.partitionBy("part").parquet(path)
    ranged = kept.sparkSession.read.schema(f"{', '.join(f'{c} string' for c in _IDENTITY)}, part int").parquet(path)
    line = F.concat(F.concat_ws("\x1f", *_IDENTITY), F.lit("\n")).cast("binary").alias("line")
    state = digests.Sha256().state()
    for part in range(parts):
        ordered = ranged.filter(F.col("part") == part).repartition(1).sortWithinPartitions(*_IDENTITY).select(line)
        found = ordered.mapInArrow(_step(state), "state binary").collect()
        state = bytes(found[0].state) if found else state
    return digests.Sha256(state).hexdigest()


def _step(state: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Takes a digest on by the lines of a task."""

    def run(batches):
        digest = digests.Sha256(state)
        for batch in batches:
            for line in batch.column("line"):
                digest.update(line.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([digest.state()], type=pa.binary())], names=["state"])

    return run
