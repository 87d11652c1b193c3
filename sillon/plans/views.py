"""The engine's inputs expressed over the shared tables, in DataFrame form and as the same SQL for DuckDB.

The tables hold no sound: a document counts as a clip of n_chars frames at 150 a second, named by its text's digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sillon.sources.tables import table

RATE = 150


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compiler input of ``documents`` and ``labels``: speaker is the source, dialect the language.

    Every fault that a row can have occurs, dealt by the row's number.
    """
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    joined = d.join(l, "doc_id", "left")
    unlabelled = F.col("quality").isNull() & F.col("toxic").isNull()
    each = lambda n: F.pmod("doc_id", F.lit(n)) == 0
    return joined.select(
        F.col("doc_id").alias("rn"), (~each(29)).alias("has_audio"), "text", F.col("source").alias("provider"), F.when(~each(31), F.col("source")).alias("speaker"), F.when(~each(37), F.col("lang")).alias("dialect"), F.col("lang").alias("language"),
        F.when(~each(41), F.concat("source", F.lit(":"), F.col("doc_id").cast("string"))).alias("source_id"), F.sha2("text", 256).alias("sha256"),
        F.col("n_chars").alias("frames"), F.lit(RATE).alias("rate"), (F.col("n_chars") / F.lit(float(RATE))).alias("duration"), F.when(each(43), 2).otherwise(1).alias("channels"),
        F.when(each(47), 0.0).otherwise(0.1).alias("rms"), F.when(each(53), 0.01).otherwise(0.0).alias("clipped"), F.when(each(59), -0.1).otherwise(0.0).alias("offset"),
        F.lit(False).alias("consent_attested"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("transcript_reviewed"),
        (F.coalesce("toxic", F.lit(0)) == 0).alias("governance_approved"), unlabelled.alias("upstream_validated"), unlabelled.alias("training_only"),
        F.concat(F.lit("lic-"), "lang").alias("source_license"), F.concat(F.lit("rev-"), F.pmod("doc_id", F.lit(3)).cast("string")).alias("source_revision"),
    )


MANIFEST = """manifest AS (
  SELECT d.doc_id AS rn, d.doc_id % 29 <> 0 AS has_audio, d.text, d.source AS provider, CASE WHEN d.doc_id % 31 <> 0 THEN d.source END AS speaker, CASE WHEN d.doc_id % 37 <> 0 THEN d.lang END AS dialect, d.lang AS language,
    CASE WHEN d.doc_id % 41 <> 0 THEN d.source || ':' || d.doc_id END AS source_id, sha256(d.text) AS sha256,
    d.n_chars AS frames, d.n_chars / 150.0::DOUBLE AS duration, d.doc_id % 43 = 0 AS stereo, d.doc_id % 47 = 0 OR d.doc_id % 53 = 0 OR d.doc_id % 59 = 0 AS bad,
    coalesce(l.quality = 1, false) AS transcript_reviewed, coalesce(l.toxic, 0) = 0 AS governance_approved,
    l.quality IS NULL AND l.toxic IS NULL AS upstream_validated, l.quality IS NULL AND l.toxic IS NULL AS training_only,
    'lic-' || d.lang AS source_license, 'rev-' || (d.doc_id % 3) AS source_revision
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

#: The rules that need no look at the sound.
FIRST_RULES = """[CASE WHEN NOT has_audio THEN 'missing_audio' END, CASE WHEN coalesce(trim(text), '') = '' THEN 'empty_text' END, CASE WHEN speaker IS NULL AND NOT training_only THEN 'missing_speaker' END,
      CASE WHEN NOT governance_approved THEN 'governance_not_approved' END, CASE WHEN NOT (transcript_reviewed OR upstream_validated) THEN 'transcript_not_validated' END,
      CASE WHEN dialect IS NULL THEN 'missing_dialect' END, CASE WHEN source_id IS NULL THEN 'missing_source_id' END]"""

_SHARE = "CAST('0x' || substr(sha256({0}), 1, 8) AS BIGINT) / 4294967295.0::DOUBLE"


def split_sql(key: str) -> str:
    share = _SHARE.format(key)
    return f"CASE WHEN {share} < 0.90::DOUBLE THEN 'train' WHEN {share} < 0.90::DOUBLE + 0.05::DOUBLE THEN 'validation' ELSE 'test' END"


JUDGED = f"""{MANIFEST}, staged AS (
  SELECT *, list_filter({FIRST_RULES}, lambda x: x IS NOT NULL) AS one,
    list_filter([CASE WHEN stereo THEN 'multichannel_audio' END, CASE WHEN duration < 0.5 THEN 'too_short' END, CASE WHEN duration > 20.0 THEN 'too_long' END, CASE WHEN duration < 0.35 OR duration > 30.0 OR bad THEN 'quality_flag' END], lambda x: x IS NOT NULL) AS late
  FROM manifest),
firsts AS (SELECT sha256, min(rn) AS first_rn FROM staged WHERE len(one) = 0 AND len(late) = 0 GROUP BY sha256),
judged AS (
  SELECT s.*, CASE WHEN len(one) > 0 THEN one WHEN rn > first_rn THEN list_concat(['duplicate_audio'], late) ELSE late END AS reasons
  FROM staged s LEFT JOIN firsts USING (sha256)),
accepted AS (SELECT *, CASE WHEN training_only THEN 'train' ELSE {split_sql('speaker')} END AS split FROM judged WHERE len(reasons) = 0)"""


def eval_manifest(spark: SparkSession, sf_dir: str, injected: bool = False) -> DataFrame:
    """Held-out rows of ``benchmark``; ``injected`` adds all documents in Spanish, an overlap by construction."""
    out = table(spark, sf_dir, "benchmark").select(F.sha2("text", 256).alias("sha256"), F.concat(F.lit("bench:"), F.col("item_id").cast("string")).alias("source_id"))
    if injected:
        out = out.unionByName(table(spark, sf_dir, "documents").filter("lang = 'es'").select(F.sha2("text", 256).alias("sha256"), F.concat(F.lit("held:"), F.col("doc_id").cast("string")).alias("source_id")))
    return out


EVAL = "evaluation AS (SELECT sha256(text) AS sha256, 'bench:' || item_id AS source_id FROM benchmark)"
INJECTED = "evaluation AS (SELECT sha256(text) AS sha256, 'bench:' || item_id AS source_id FROM benchmark UNION ALL SELECT sha256(text), 'held:' || doc_id FROM documents WHERE lang = 'es')"


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a user's turn and the next turn of ``conversations``."""
    c = table(spark, sf_dir, "conversations")
    plain = lambda t: F.trim(F.regexp_replace(t, r"[\t-\r ]+", " "))
    a = c.filter("role = 'user'").select("conv_id", "turn", plain(F.col("text")).alias("reference"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), plain(F.col("text")).alias("hypothesis"), F.col("role").alias("code_switch"))
    return a.join(b, ["conv_id", "turn"]).select(
        "conv_id", "turn", "reference", "hypothesis", F.concat(F.lit("s"), F.pmod("conv_id", F.lit(7)).cast("string")).alias("speaker"),
        F.when(F.col("turn") % 3 == 0, "").otherwise(F.concat(F.lit("d"), (F.col("turn") % 3).cast("string"))).alias("dialect"),
        F.when(F.pmod("conv_id", F.lit(2)) == 0, "quiet").alias("noise"), "code_switch",
    )


_PLAIN = r"trim(regexp_replace(text, '[\t-\r ]+', ' ', 'g'))"
_NORMAL = "trim(regexp_replace(replace(lower(nfc_normalize({0})), 'ß', 'ss'), '[\\x{{09}}-\\x{{0d}}\\x{{1c}}-\\x{{20}}\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'))"


def mapped(tokens: str, shared: str, alone: int) -> str:
    """Tokens as single bytes, as DuckDB's levenshtein counts bytes: shared ones by their numbers (below 126), others all alike."""
    return f"array_to_string(list_transform({tokens}, lambda x: CASE WHEN list_contains({shared}, x) THEN chr(CAST(list_position({shared}, x) AS INTEGER)) ELSE chr({alone}) END), '')"


UTTERANCES = f"""utterances AS (
  SELECT a.conv_id, a.turn, a.t AS reference, b.t AS hypothesis, 's' || (a.conv_id % 7) AS speaker, CASE WHEN a.turn % 3 = 0 THEN '' ELSE 'd' || (a.turn % 3) END AS dialect,
    CASE WHEN a.conv_id % 2 = 0 THEN 'quiet' END AS noise, b.role AS code_switch
  FROM (SELECT conv_id, turn, {_PLAIN} AS t FROM conversations WHERE role = 'user') a
  JOIN (SELECT conv_id, turn - 1 AS turn, role, {_PLAIN} AS t FROM conversations) b ON a.conv_id = b.conv_id AND a.turn = b.turn),
lists AS (
  SELECT *, list_filter(string_split(r, ' '), lambda x: x <> '') AS rw, list_filter(string_split(h, ' '), lambda x: x <> '') AS hw,
    list_filter(string_split(replace(r, ' ', ''), ''), lambda x: x <> '') AS rc, list_filter(string_split(replace(h, ' ', ''), ''), lambda x: x <> '') AS hc
  FROM (SELECT *, {_NORMAL.format('reference')} AS r, {_NORMAL.format('hypothesis')} AS h FROM utterances)),
counted AS (
  SELECT * EXCLUDE (wv, cv), CAST(levenshtein({mapped('rw', 'wv', 126)}, {mapped('hw', 'wv', 127)}) AS BIGINT) AS word_errors, CAST(len(rw) AS BIGINT) AS reference_words,
    CAST(levenshtein({mapped('rc', 'cv', 126)}, {mapped('hc', 'cv', 127)}) AS BIGINT) AS char_errors, CAST(len(rc) AS BIGINT) AS reference_chars
  FROM (SELECT *, list_intersect(rw, hw) AS wv, list_intersect(rc, hc) AS cv FROM lists))"""


def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as measured turns."""
    return table(spark, sf_dir, "events").select("event_id", F.col("value").alias("latency_seconds"), F.col("event_type").alias("dialect"), F.col("user_id").alias("speaker"), ((F.pmod("event_id", F.lit(20)) + 1) / F.lit(2.0)).alias("audio_seconds"))


LATENCIES = "latencies AS (SELECT event_id, value AS latency_seconds, event_type AS dialect, user_id AS speaker, (event_id % 20 + 1) / 2.0 AS audio_seconds FROM events)"


def review_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as review actions on users."""
    action = F.create_map(*[F.lit(x) for kv in {"signup": "draft", "view": "review_1", "click": "review_2", "purchase": "approve", "error": "reject"}.items() for x in kv])
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("item_id"), F.col("event_id").alias("seq"), F.coalesce(F.try_element_at(action, F.col("event_type")), F.lit("draft")).alias("action"), F.concat(F.lit("r"), F.pmod("event_id", F.lit(3)).cast("string")).alias("actor"), F.concat(F.lit("text "), F.col("event_id").cast("string")).alias("text"), F.lit("reason").alias("reason"))


def turn_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as frames of connections."""
    kind = F.create_map(*[F.lit(x) for kv in {"signup": "start", "view": "audio", "click": "audio", "purchase": "commit", "error": "cancel"}.items() for x in kv])
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("conn_id"), F.col("event_id").alias("seq"), F.coalesce(F.try_element_at(kind, F.col("event_type")), F.lit("start")).alias("kind"), F.lit(16000).alias("sample_rate"), F.floor(F.col("value") * 1000).cast("long").alias("n_bytes"))
