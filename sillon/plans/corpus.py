"""Queries of the corpus compiler, its reports, its leakage gates and its normalizers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sillon.functions import text as T
from sillon.operators import compiler, governance, leakage, quality
from sillon.sources.tables import table

from .views import EVAL, INJECTED, JUDGED, MANIFEST, eval_manifest, manifest, split_sql

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ .,\n"


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiler.accepted(manifest(spark, sf_dir))


def quality_by_split(spark, sf_dir):
    return quality.by_split(_accepted(spark, sf_dir))


def quality_global(spark, sf_dir):
    return quality.overall(_accepted(spark, sf_dir))


def dialect_counts(spark, sf_dir):
    return quality.by_dialect(_accepted(spark, sf_dir))


def split_by_speaker(spark, sf_dir):
    return manifest(spark, sf_dir).select("rn", T.assign_split(F.col("speaker"), F.lit(False)).alias("split"))


def split_by_content(spark, sf_dir):
    return manifest(spark, sf_dir).select("rn", T.assign_split(F.col("sha256"), F.lit(False)).alias("split"))


def reject_ladder(spark, sf_dir):
    return compiler.judged(manifest(spark, sf_dir)).select("rn", F.posexplode("reasons").alias("position", "reason")).withColumn("position", F.col("position").cast("long"))


def reject_reason_counts(spark, sf_dir):
    return compiler.judged(manifest(spark, sf_dir)).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def accepted_manifest(spark, sf_dir):
    return _accepted(spark, sf_dir).select("rn", "sha256", "speaker", "dialect", "source_id", "duration", "training_only", "split")


def acceptance_totals(spark, sf_dir):
    j = compiler.judged(manifest(spark, sf_dir))
    ok = F.size("reasons") == 0
    return j.agg(F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"), F.count_if(ok & F.col("training_only")).alias("training_only"))


def dedup_first_wins(spark, sf_dir):
    return compiler.first_wins(manifest(spark, sf_dir).select("rn", "sha256"), "sha256", "rn").filter(~F.col("repeats")).select("rn", "sha256")


def duplicate_groups(spark, sf_dir):
    return manifest(spark, sf_dir).groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.min("rn").alias("first_rn")).filter("n > 1")


def char_inventory(spark, sf_dir):
    return quality.inventory(_accepted(spark, sf_dir))


def top_chars(spark, sf_dir):
    return quality.most_common(quality.inventory(_accepted(spark, sf_dir)), 20)


def unknown_graphemes(spark, sf_dir):
    return quality.outside(quality.inventory(_accepted(spark, sf_dir)), ALPHABET)


def grapheme_candidates(spark, sf_dir):
    return quality.grapheme_candidates(quality.inventory(_accepted(spark, sf_dir)))


def source_summary(spark, sf_dir):
    return quality.source_summary(_accepted(spark, sf_dir))


def provenance_sets(spark, sf_dir):
    return quality.provenance(_accepted(spark, sf_dir))


def dataset_fingerprint(spark, sf_dir):
    return compiler.fingerprint(_accepted(spark, sf_dir).withColumn("text", T.transcript(F.col("text"))))


def dataset_version(spark, sf_dir):
    return compiler.fingerprint(_accepted(spark, sf_dir).filter("language = 'en'").withColumn("text", T.transcript(F.col("text")))).select(F.concat(F.lit("en-"), F.left("fingerprint", F.lit(16))).alias("dataset_id"), F.col("n").alias("accepted"))


def _train(spark, sf_dir):
    return manifest(spark, sf_dir).select("sha256", "source_id")


def exact_leakage(spark, sf_dir):
    return leakage.overlap(_train(spark, sf_dir), eval_manifest(spark, sf_dir, injected=True)).select("sha256", "train_rows", "eval_rows", F.array_join("train_sources", ",").alias("train_sources"), F.array_join("eval_sources", ",").alias("eval_sources"))


def leakage_examples(spark, sf_dir):
    return leakage.examples(leakage.overlap(_train(spark, sf_dir), eval_manifest(spark, sf_dir, injected=True))).select("sha256", "train_rows", "eval_rows")


def leakage_totals(spark, sf_dir):
    return leakage.totals(_train(spark, sf_dir), eval_manifest(spark, sf_dir))


def split_leakage(spark, sf_dir):
    """Texts that splits by speaker put on both sides."""
    m = manifest(spark, sf_dir).select("sha256", "source_id", T.stable_partition(F.col("speaker")).alias("split"))
    return leakage.overlap(m.filter("split = 'train'"), m.filter("split <> 'train'")).select("sha256", "train_rows", "eval_rows")


def speaker_leakage(spark, sf_dir):
    return quality.speaker_leakage(_accepted(spark, sf_dir))


def normalize_transcript(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.transcript(F.col("text")).alias("text"))


def normalize_generic(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.generic(F.col("text")).alias("text"))


def normalize_orthography(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.orthography(F.col("text")).alias("text"))


def safe_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.safe_name(F.col("url")).alias("name"))


def _report(spark, sf_dir):
    a = _accepted(spark, sf_dir)
    counts = a.agg(F.count(F.lit(1)).alias("accepted_rows"), F.count_if(F.expr("split = 'train'")).alias("train_rows"), F.count_if(F.expr("split = 'validation'")).alias("validation_rows"))
    leaking = quality.speaker_leakage(a).agg(F.count(F.lit(1)).alias("leaking_speakers"))
    chars = quality.outside(quality.inventory(a), ALPHABET).agg(F.count(F.lit(1)).alias("outside_reviewed"))
    return counts.crossJoin(leaking).crossJoin(chars)  # one row each


def readiness_blockers(spark, sf_dir):
    out = governance.readiness(_report(spark, sf_dir), "phoneme", True, False, len(ALPHABET))
    return out.select(F.col("position").cast("long").alias("position"), "code")


def row_reconciliation(spark, sf_dir):
    declared = compiler.judged(manifest(spark, sf_dir)).agg(F.count_if(F.size("reasons") == 0).alias("n"))
    observed = quality.by_split(_accepted(spark, sf_dir)).agg(F.sum("rows").alias("n"))
    return governance.reconciled(declared, observed)


QUERIES = {f.__name__: f for f in (
    quality_by_split, quality_global, dialect_counts, split_by_speaker, split_by_content, reject_ladder, reject_reason_counts, accepted_manifest, acceptance_totals,
    dedup_first_wins, duplicate_groups, char_inventory, top_chars, unknown_graphemes, grapheme_candidates, source_summary, provenance_sets, dataset_fingerprint, dataset_version,
    exact_leakage, leakage_examples, leakage_totals, split_leakage, speaker_leakage, normalize_transcript, normalize_generic, normalize_orthography, safe_names, readiness_blockers, row_reconciliation,
)}

_WHITE = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_TRANSCRIPT = f"trim(regexp_replace(nfc_normalize(text), '{_WHITE}', ' ', 'g'))"
_CHARS = f"{JUDGED}, chars AS (SELECT char, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS char FROM accepted) WHERE char <> '' GROUP BY char)"
_HOURS = "CAST(sum(frames) AS DOUBLE) / 150 / 3600.0 AS hours"
_IN_ALPHABET = "'" + ALPHABET + "'"
_CODE = "'U+' || CASE WHEN length(hex) < 4 THEN lpad(hex, 4, '0') ELSE hex END"
_FINGERPRINT = """SELECT sha256(array_to_string(list_transform(list_sort(list(struct_pack(a := sha256, b := t, c := coalesce(speaker, ''), d := coalesce(dialect, ''), e := coalesce(source_id, ''), f := coalesce(source_license, ''), g := coalesce(source_revision, ''), h := CASE WHEN training_only THEN 'training-only' ELSE 'split-eligible' END, i := coalesce(split, '')))),
  lambda r: concat_ws(chr(31), r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h, r.i) || chr(10)), '')) AS fingerprint, count(*) AS n FROM (SELECT *, {t} AS t FROM accepted {where})"""
_SIDES = "a AS (SELECT sha256, count(*) AS train_rows, array_to_string(list_sort(list_distinct(list(source_id))), ',') AS train_sources FROM manifest GROUP BY sha256), b AS (SELECT sha256, count(*) AS eval_rows, array_to_string(list_sort(list_distinct(list(source_id))), ',') AS eval_sources FROM evaluation GROUP BY sha256)"
_SYMBOLS = r" \-–—’''.,;:!?₵$%()/:\x{22}+@#&"

ORACLES = {
    "quality_by_split": f"WITH {JUDGED} SELECT split, count(*) AS rows, {_HOURS}, count(DISTINCT speaker) AS speakers FROM accepted GROUP BY split",
    "quality_global": f"WITH {JUDGED} SELECT count(*) AS accepted, {_HOURS}, count(DISTINCT speaker) AS speakers, count(DISTINCT dialect) AS dialects FROM accepted",
    "dialect_counts": f"WITH {JUDGED} SELECT dialect, count(*) AS rows FROM accepted GROUP BY dialect",
    "split_by_speaker": f"WITH {MANIFEST} SELECT rn, {split_sql('speaker')} AS split FROM manifest",
    "split_by_content": f"WITH {MANIFEST} SELECT rn, {split_sql('sha256')} AS split FROM manifest",
    "reject_ladder": f"WITH {JUDGED} SELECT rn, CAST(i - 1 AS BIGINT) AS position, reasons[i] AS reason FROM (SELECT rn, reasons, unnest(range(1, len(reasons) + 1)) AS i FROM judged)",
    "reject_reason_counts": f"WITH {JUDGED} SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM judged) GROUP BY reason",
    "accepted_manifest": f"WITH {JUDGED} SELECT rn, sha256, speaker, dialect, source_id, duration, training_only, split FROM accepted",
    "acceptance_totals": f"WITH {JUDGED} SELECT count(*) FILTER (len(reasons) = 0) AS accepted, count(*) FILTER (len(reasons) > 0) AS rejected, count(*) FILTER (len(reasons) = 0 AND training_only) AS training_only FROM judged",
    "dedup_first_wins": f"WITH {MANIFEST} SELECT min(rn) AS rn, sha256 FROM manifest GROUP BY sha256",
    "duplicate_groups": f"WITH {MANIFEST} SELECT sha256, count(*) AS n, min(rn) AS first_rn FROM manifest GROUP BY sha256 HAVING count(*) > 1",
    "char_inventory": f"WITH {_CHARS} SELECT char, n FROM chars",
    "top_chars": f"WITH {_CHARS} SELECT char, n FROM chars ORDER BY n DESC, char LIMIT 20",
    "unknown_graphemes": f"WITH {_CHARS} SELECT char, n, {_CODE} AS codepoint FROM (SELECT *, printf('%X', unicode(char)) AS hex FROM chars WHERE NOT contains({_IN_ALPHABET}, char))",
    "grapheme_candidates": f"WITH {_CHARS} SELECT char, n FROM chars WHERE regexp_matches(char, '[\\p{{L}}\\p{{M}}]')",
    "source_summary": f"WITH {JUDGED} SELECT split_part(source_id, ':', 1) AS source, source_license AS license, source_revision AS revision, count(*) AS rows, {_HOURS}, count(DISTINCT speaker) AS speakers FROM accepted GROUP BY 1, 2, 3",
    "provenance_sets": f"WITH {JUDGED} SELECT DISTINCT 'license' AS kind, source_license AS value FROM accepted UNION SELECT DISTINCT 'revision', source_revision FROM accepted",
    "dataset_fingerprint": f"WITH {JUDGED} " + _FINGERPRINT.format(t=_TRANSCRIPT.replace("{", "{{").replace("}", "}}"), where="").replace("{{", "{").replace("}}", "}"),
    "dataset_version": f"WITH {JUDGED} SELECT 'en-' || left(fingerprint, 16) AS dataset_id, n AS accepted FROM (" + _FINGERPRINT.format(t=_TRANSCRIPT.replace("{", "{{").replace("}", "}}"), where="WHERE language = 'en'").replace("{{", "{").replace("}}", "}") + ")",
    "exact_leakage": f"WITH {MANIFEST}, {INJECTED}, {_SIDES} SELECT sha256, train_rows, eval_rows, train_sources, eval_sources FROM a JOIN b USING (sha256)",
    "leakage_examples": f"WITH {MANIFEST}, {INJECTED}, {_SIDES} SELECT sha256, train_rows, eval_rows FROM a JOIN b USING (sha256) ORDER BY sha256 LIMIT 100",
    "leakage_totals": f"WITH {MANIFEST}, {EVAL}, {_SIDES} SELECT (SELECT count(*) FROM manifest) AS training_rows, (SELECT count(*) FROM evaluation) AS evaluation_rows, count(*) AS overlap_count, count(*) = 0 AS passed FROM a JOIN b USING (sha256)",
    "split_leakage": f"WITH {MANIFEST}, m AS (SELECT sha256, {split_sql('speaker')} AS split FROM manifest) SELECT sha256, count(*) FILTER (split = 'train') AS train_rows, count(*) FILTER (split <> 'train') AS eval_rows FROM m GROUP BY sha256 HAVING bool_or(split = 'train') AND bool_or(split <> 'train')",
    "speaker_leakage": f"WITH {JUDGED} SELECT speaker, count(DISTINCT split) AS splits FROM accepted GROUP BY speaker HAVING count(DISTINCT split) > 1",
    "normalize_transcript": f"SELECT doc_id, {_TRANSCRIPT} AS text FROM documents",
    "normalize_generic": f"SELECT doc_id, regexp_replace({_TRANSCRIPT}, ' ([,.;:!?])', '\\1', 'g') AS text FROM documents",
    "normalize_orthography": f"SELECT doc_id, regexp_replace(trim(regexp_replace(regexp_replace(translate(nfc_normalize(text), '“”‘', '\"\"’'), '[^\\p{{L}}\\p{{M}}\\p{{N}}{_WHITE[1:-2]}{_SYMBOLS}]', ' ', 'g'), '{_WHITE}', ' ', 'g')), ' ([,.;:!?])', '\\1', 'g') AS text FROM documents",
    "safe_names": "SELECT page_id, coalesce(nullif(left(regexp_replace(regexp_replace(trim(url), '[^A-Za-z0-9._-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g'), 100), ''), left(sha256(url), 20)) AS name FROM pages",
    "readiness_blockers": f"""WITH {_CHARS}, r AS (SELECT (SELECT count(*) FROM accepted) AS n, (SELECT count(*) FROM accepted WHERE split = 'train') AS t, (SELECT count(*) FROM accepted WHERE split = 'validation') AS v,
  (SELECT count(*) FROM (SELECT speaker FROM accepted GROUP BY speaker HAVING count(DISTINCT split) > 1)) AS l, (SELECT count(*) FROM chars WHERE NOT contains({_IN_ALPHABET}, char)) AS o),
 c AS (SELECT list_filter([CASE WHEN n < 1 OR t < 1 THEN 'empty_training_corpus' END, CASE WHEN l > 0 THEN 'speaker_leakage' END, 'g2p_unreviewed', CASE WHEN v < 1 THEN 'no_internal_validation' END, CASE WHEN o > 0 THEN 'observed_outside_reviewed_inventory' END], lambda x: x IS NOT NULL) AS codes FROM r)
 SELECT CAST(i - 1 AS BIGINT) AS position, codes[i] AS code FROM (SELECT codes, unnest(range(1, len(codes) + 1)) AS i FROM c)""",
    "row_reconciliation": f"WITH {JUDGED} SELECT *, declared = observed AS matches FROM (SELECT (SELECT count(*) FILTER (len(reasons) = 0) FROM judged) AS declared, (SELECT CAST(sum(n) AS BIGINT) FROM (SELECT split, count(*) AS n FROM accepted GROUP BY split)) AS observed)",
}
