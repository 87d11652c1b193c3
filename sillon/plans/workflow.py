"""Queries of benchmarks, governance, signals, reviews and turns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sillon.functions.text import assignment_bucket, hash32, normalized
from sillon.operators import governance, lineage, review, routing, signal, speech, turns
from sillon.sources.tables import table

from . import corpus
from .views import LATENCIES, UTTERANCES, latencies, manifest, mapped, review_events, turn_frames, utterances

#: A small catalogue and plan.
CATALOG = [
    ("alpha", "hub", ["aa", "bb"], ["asr", "tts"], "production", "CC-BY-4.0", True, True, False, False),
    ("beta", "hub", ["bb"], ["asr"], "evaluation", "CC-BY-NC-4.0", True, False, False, True),
    ("gamma", "files", ["aa"], ["asr"], "research", "CC-BY-NC-4.0", False, True, True, True),
    ("delta", "hub", ["cc", "aa"], ["tts"], "production", "CC0-1.0", True, True, False, False),
]
PLAN = [
    ("aa", "asr", "train", 0, "alpha"), ("aa", "asr", "train", 1, "gamma"), ("aa", "asr", "eval", 0, "beta"),
    ("aa", "tts", "train", 0, "delta"), ("bb", "asr", "train", 0, "alpha"), ("bb", "asr", "eval", 0, "beta"),
]


def _catalog(spark):
    return spark.createDataFrame(CATALOG, governance.CATALOG_SCHEMA)


def error_rate_rows(spark, sf_dir):
    return speech.counted(utterances(spark, sf_dir)).select("conv_id", "turn", "word_errors", "reference_words", "char_errors", "reference_chars")


def wer_global(spark, sf_dir):
    return speech.error_rates(speech.counted(utterances(spark, sf_dir)))


def wer_slices(spark, sf_dir):
    return speech.slices(speech.counted(utterances(spark, sf_dir)))


def wer_by_dialect(spark, sf_dir):
    return speech.slices(speech.counted(utterances(spark, sf_dir), normalize=False), ("dialect",), "unlabeled").select("value", "utterances", "word_errors", "reference_words", "wer")


def latency_percentiles(spark, sf_dir):
    return speech.latency(latencies(spark, sf_dir))


def latency_slices(spark, sf_dir):
    return speech.latency(latencies(spark, sf_dir), ["dialect"])


def rtf(spark, sf_dir):
    return speech.real_time_factor(latencies(spark, sf_dir))


def benchmark_gates(spark, sf_dir):
    """The published acceptance limits held against the measured figures."""
    figures = speech.error_rates(speech.counted(utterances(spark, sf_dir))).select("wer", "cer").crossJoin(speech.latency(latencies(spark, sf_dir)).select("p95")).crossJoin(speech.real_time_factor(latencies(spark, sf_dir)))  # one row each
    return speech.gates(figures, {"wer": 0.20, "cer": 0.10, "p95": 2.0, "rtf": 0.60})


def latency_histogram(spark, sf_dir):
    """Stage timings by type in buckets of 50 seconds."""
    return speech.histogram(latencies(spark, sf_dir), ["dialect"], "latency_seconds", 50.0)


def _by_code(spark, sf_dir):
    """Documents of each language of the catalogue."""
    code = F.when(F.col("lang") == "en", "aa").when(F.col("lang") == "de", "bb").otherwise("cc")
    return table(spark, sf_dir, "documents").groupBy(code.alias("language")).agg(F.count(F.lit(1)).alias("documents"))


def source_plan(spark, sf_dir):
    """The plan's sources, and how many documents their languages have."""
    plan = governance.resolved(spark.createDataFrame(PLAN, governance.PLAN_SCHEMA), _catalog(spark)).join(_by_code(spark, sf_dir), "language", "left")
    return plan.select("language", "task", "role", F.col("position").cast("long").alias("position"), "source_id", "license", "usage", "documents")


def usage_matrix(spark, sf_dir):
    """Which uses each source allows, and how many documents its languages have."""
    uses = F.explode(F.array(*map(F.lit, governance.USAGE_RANK))).alias("requested")
    each = _catalog(spark).select("source_id", "usage", "languages", uses).withColumn("allowed", governance.allows(F.col("usage"), F.col("requested")))
    counted = each.withColumn("language", F.explode("languages")).join(_by_code(spark, sf_dir), "language", "left")
    return counted.groupBy("source_id", "requested", "allowed").agg(F.sum("documents").alias("documents"))


def catalog_plan(spark, sf_dir):
    """The sources that each language of the documents may use for recognition, by use."""
    langs = table(spark, sf_dir, "documents").select("lang").distinct().withColumn("language", F.when(F.col("lang") == "en", "aa").when(F.col("lang") == "de", "bb").otherwise("cc"))
    found = [governance.planned(_catalog(spark), language, "asr", use).select(F.lit(language).alias("language"), F.lit(use).alias("requested"), "source_id", "usage") for language in ("aa", "bb", "cc") for use in governance.USAGE_RANK]
    return langs.join(reduce(DataFrame.unionByName, found), "language").select("lang", "requested", "source_id", "usage")


def adapters_union(spark, sf_dir):
    """Documents as three providers' rows, adapted and united."""
    d = table(spark, sf_dir, "documents").withColumn("third", F.pmod("doc_id", F.lit(3)))
    path = F.concat(F.lit("a/ "), F.col("doc_id").cast("string"), F.lit("  x"))
    a = d.filter("third = 0").select(path.alias("path"), F.col("text").alias("sentence"), F.concat(F.lit(" "), "source").alias("speaker_id"), F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("dialect"))
    b = d.filter("third = 1").select(path.alias("audio_filepath"), F.col("text").alias("transcription"), F.when(F.pmod("doc_id", F.lit(2)) == 0, F.lit(" ")).alias("id"), F.col("doc_id").cast("string").alias("utt_id"))
    c = d.filter("third = 2").select(path.alias("path"), F.col("text").alias("sentence"), F.when(F.pmod("doc_id", F.lit(2)) == 0, F.col("source")).alias("client_id"), F.col("lang").alias("accent"))
    parts = [
        governance.adapt(a, "aware", ["audio", "path", "audio_filepath"], ["text", "transcription", "sentence"], ["id", "utt_id"], ["speaker_id", "speaker", "client_id"], True, "dialect"),
        governance.adapt(b, "plain", ["audio", "path", "audio_filepath"], ["text", "sentence", "transcription"], ["id", "utt_id"]),
        governance.adapt(c, "client", ["audio", "path"], ["sentence", "text"], ["id", "path"], ["client_id"], False, "accent"),
    ]
    return governance.united(parts, ["audio", "text", "speaker", "dialect", "source_id", "training_only"]).withColumn("text", F.sha2("text", 256))


def _acquisition(spark, sf_dir):
    m = manifest(spark, sf_dir)
    return governance.capped(m.select("rn", F.col("provider").alias("speaker"), "sha256", "duration"), "speaker", "rn", "sha256", F.col("duration") <= 20.0, 25)


def acquire_capped(spark, sf_dir):
    return _acquisition(spark, sf_dir).select("rn", "speaker", "outcome")


def acquire_totals(spark, sf_dir):
    return governance.acquired(_acquisition(spark, sf_dir), "speaker", "duration")


def importer_outcomes(spark, sf_dir):
    m = manifest(spark, sf_dir)
    outcome = governance.import_outcome(F.col("transcript_reviewed") | F.col("upstream_validated"), F.pmod("rn", F.lit(11)) != 0, F.pmod("rn", F.lit(7)) == 0)
    return m.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def mos_by_model(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    mark = lambda k: (F.pmod(F.floor(F.col("value") * k).cast("long"), F.lit(5)) + 1).cast("double")
    return speech.listening_scores(e.select(F.col("event_type").alias("model_id"), *[mark(k).alias(m) for k, m in enumerate(speech.METRICS, 1)]))


def assignment_buckets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", assignment_bucket(F.col("doc_id").cast("string"), F.col("source")).cast("long").alias("bucket"))


def _pointers(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("task"), F.pmod("user_id", F.lit(5)).cast("long").alias("stage"), F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("model_id"), F.col("event_id").alias("updated"))


def pointer_history(spark, sf_dir):
    return governance.pointer_history(_pointers(spark, sf_dir), ["task", "stage"], "model_id", ["updated"])


def latest_pointers(spark, sf_dir):
    return governance.latest_pointers(_pointers(spark, sf_dir), ["task", "stage"], "model_id", ["updated"])


def latest_checkpoint(spark, sf_dir):
    paths = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", F.concat(F.lit("run/checkpoint-x"), F.col("event_id").cast("string"))).otherwise(F.concat(F.lit("run/checkpoint-"), F.col("event_id").cast("string"))).alias("path"))
    return governance.latest_checkpoint(paths)


def model_routes(spark, sf_dir):
    """The recognition route of each document's language: its own model where it has one, else the shared one."""
    registry = spark.createDataFrame([(x, x, "custom" if x in ("fr", "de") else None, f"custom:{x}", "remote", None) for x in ("de", "en", "es", "fr")], routing.REGISTRY)
    routes = routing.routed(table(spark, sf_dir, "documents").select(F.col("lang").alias("language")), registry)
    return routes.groupBy(F.col("engine").alias("route")).agg(F.count(F.lit(1)).alias("n"))


#: Languages by how they are routed: a deployed model, one that isn't deployed, a hint of its own, and nothing known.
REGISTRY = [("en", "English", "custom", "models/en", None, None), ("de", "Deutsch", "custom", "models/de", "local", "german"), ("fr", "Français", "shared", None, None, "french")]


def language_routes(spark, sf_dir):
    """How requests in the documents' languages are routed over a registry; every ninth names no language."""
    d = table(spark, sf_dir, "documents").select(F.when(F.pmod("doc_id", F.lit(9)) > 0, F.col("lang")).alias("language"))
    deployed = spark.createDataFrame([("models/en",)], "model string")
    return routing.routed(d, spark.createDataFrame(REGISTRY, routing.REGISTRY), deployed).groupBy("language", "engine", "hint", "error").agg(F.count(F.lit(1)).alias("n"))


def array_quality(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("samples"), F.lit(16).alias("rate"))
    return signal.inspected(e).select("vec_id", "duration", "peak", F.round("rms", 9).alias("rms"), "clipped", F.round("offset", 9).alias("offset"), "suspicious")


def pcm_duration(spark, sf_dir):
    return turn_frames(spark, sf_dir).select("seq", signal.pcm_seconds(F.col("n_bytes"), F.col("sample_rate")).alias("seconds"))


def gap_segments(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    return signal.gap_segments(e, "user_id", "micros", 3_600_000_000)


#: Normalizers by language; others have the generic one.
NORMALIZERS = {"en": "orthography", "fr": "orthography", "de": "transcript"}


def segment_recording(spark, sf_dir):
    """Voiced regions of documents as recordings: 50 samples a second, one for each character, by blocks of 30 either voiced or silent."""
    d = table(spark, sf_dir, "documents").filter("text <> ''").select("doc_id", F.char_length("text").alias("n"), F.split("text", "").alias("chars"))
    voiced, silent = (F.array(*[F.lit((0.2 + j % 5 * 0.01) * on).cast("float") for j in range(30)]) for on in (1, 0))
    block = lambda b: F.when(F.pmod(F.ascii(F.get("chars", b * 30)) + b, F.lit(3)) > 0, voiced).otherwise(silent)
    samples = F.slice(F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 30).cast("int")), block)), F.lit(1), F.col("n"))
    found = signal.segments(d.select("doc_id", samples.alias("samples"), F.lit(50).alias("rate")), key="doc_id")
    return found.select("doc_id", "segment", "start", "end", F.octet_length("wav").cast("long").alias("bytes"))


def review_audit(spark, sf_dir):
    return review.audit(review_events(spark, sf_dir)).drop("text")


def review_final_state(spark, sf_dir):
    return review.final_states(review_events(spark, sf_dir))


def review_queue(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("item_id"), F.col("ts").alias("created_at"), F.col("event_type").alias("state"))
    return review.queue(e, 100, state="view").select("item_id")


def store_admission(spark, sf_dir):
    """Documents with even ids stored, the others offered: those with new texts, the first of each."""
    m = manifest(spark, sf_dir).select(F.col("rn").alias("seq"), "sha256")
    return review.admitted(m.filter("seq % 2 = 1"), m.filter("seq % 2 = 0")).select("seq", "sha256")


def turn_buffers(spark, sf_dir):
    return turns.turns(turn_frames(spark, sf_dir), 10.0)


def voice_normalizers(spark, sf_dir):
    """Each document by the normalizer of its language."""
    return table(spark, sf_dir, "documents").select("doc_id", normalized(F.col("text"), F.col("lang"), NORMALIZERS).alias("text"))


def experiment_ids(spark, sf_dir):
    """Ids of plans: twelve digits of the digest of their compact JSON."""
    d = table(spark, sf_dir, "documents").select("source", "lang").distinct()
    plans = d.select("source", "lang", F.col("source").alias("dataset"), F.col("lang").alias("language"), F.lit("asr").alias("task"))
    return plans.select("source", "lang", F.concat("lang", F.lit("-asr-"), lineage.experiment_digest(["dataset", "language", "task"])).alias("experiment_id"), hash32(F.col("source")).alias("seed"))


QUERIES = {f.__name__: f for f in (
    error_rate_rows, wer_global, wer_slices, wer_by_dialect, latency_percentiles, latency_slices, rtf, benchmark_gates, latency_histogram, source_plan, usage_matrix, catalog_plan, adapters_union,
    acquire_capped, acquire_totals, importer_outcomes, mos_by_model, assignment_buckets, pointer_history, latest_pointers, latest_checkpoint, model_routes, language_routes, array_quality, pcm_duration, gap_segments,
    segment_recording, review_audit, review_final_state, review_queue, store_admission, turn_buffers, voice_normalizers, experiment_ids,
)}

_SUMS = "count(*) AS utterances, sum(word_errors)::BIGINT AS word_errors, sum(reference_words)::BIGINT AS reference_words, sum(char_errors)::BIGINT AS char_errors, sum(reference_chars)::BIGINT AS reference_chars, sum(word_errors)::DOUBLE / nullif(sum(reference_words), 0) AS wer, sum(char_errors)::DOUBLE / nullif(sum(reference_chars), 0) AS cer"
_SLICE = "SELECT '{0}' AS attribute, coalesce(nullif({0}, ''), 'unknown') AS value, * EXCLUDE (reference, hypothesis) FROM counted"
_LATENCY = "count(*) AS n, sum(latency_seconds::DECIMAL(18,6))::DOUBLE / count(latency_seconds) AS mean, round(quantile_cont(latency_seconds, 0.5), 6) AS p50, round(quantile_cont(latency_seconds, 0.95), 6) AS p95"
_RTF = "sum(greatest(latency_seconds, 0)::DECIMAL(18,6))::DOUBLE / nullif(sum(greatest(audio_seconds, 0)::DECIMAL(18,6))::DOUBLE, 0) AS rtf"
_CATALOG = "catalog(source_id, license, usage, languages, tasks) AS (VALUES " + ", ".join(f"('{c[0]}', '{c[5]}', '{c[4]}', {c[2]}, {c[3]})" for c in CATALOG) + ")"
_BY_CODE = "dl AS (SELECT CASE lang WHEN 'en' THEN 'aa' WHEN 'de' THEN 'bb' ELSE 'cc' END AS language, count(*) AS documents FROM documents GROUP BY 1)"
_RANK = "CASE {0} WHEN 'production' THEN 0 WHEN 'evaluation' THEN 1 ELSE 2 END"
_ACQUIRED = """m AS (SELECT doc_id AS rn, source AS speaker, sha256(text) AS sha256, n_chars / 150.0::DOUBLE <= 20.0 AS fine FROM documents),
g AS (SELECT *, fine AND rn = min(rn) FILTER (fine) OVER (PARTITION BY speaker, sha256) AS good FROM m),
r AS (SELECT *, sum(CASE WHEN good THEN 1 ELSE 0 END) OVER (PARTITION BY speaker ORDER BY rn) AS k FROM g),
a AS (SELECT rn, speaker, CASE WHEN good THEN 'imported' ELSE 'skipped' END AS outcome FROM r WHERE k < 25 OR (k = 25 AND good))"""
_POINTERS = "p AS (SELECT event_type AS task, (user_id % 5)::BIGINT AS stage, 'm' || event_id AS model_id, event_id AS updated FROM events)"

_REVIEW = """e AS (SELECT CAST(user_id AS VARCHAR) AS item_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'review_1' WHEN 'click' THEN 'review_2' WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'reject' ELSE 'draft' END AS action,
    'r' || (event_id % 3) AS actor, 'text ' || event_id AS text, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f AS (
  SELECT DISTINCT item_id, 0::BIGINT AS k, 0::BIGINT AS seq, '' AS action, '' AS actor, NULL::VARCHAR AS error, 'machine_draft' AS state, NULL::VARCHAR AS first, NULL::VARCHAR AS second, NULL::VARCHAR AS label FROM e
  UNION ALL
  SELECT item_id, k, seq, action, actor, error, CASE WHEN error IS NOT NULL THEN state ELSE CASE action WHEN 'review_1' THEN 'reviewer_1_complete' WHEN 'review_2' THEN 'reviewer_2_complete' WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' ELSE state END END,
    CASE WHEN error IS NULL AND action = 'review_1' THEN actor ELSE first END, CASE WHEN error IS NULL AND action = 'review_2' THEN text ELSE second END, CASE WHEN error IS NULL AND action = 'approve' THEN second ELSE label END
  FROM (SELECT e.item_id, e.k, e.seq, e.action, e.actor, e.text, f.state, f.first, f.second, f.label, CASE e.action
      WHEN 'draft' THEN CASE WHEN state <> 'machine_draft' THEN 'draft after review' END
      WHEN 'review_1' THEN CASE WHEN state <> 'machine_draft' THEN 'no review in state ' || state END
      WHEN 'review_2' THEN CASE WHEN first = e.actor THEN 'same reviewer' WHEN state <> 'reviewer_1_complete' THEN 'no review in state ' || state END
      WHEN 'approve' THEN CASE WHEN state <> 'reviewer_2_complete' THEN 'no approval in state ' || state END
      ELSE CASE WHEN state IN ('approved', 'rejected') THEN 'no rejection in state ' || state END END AS error
    FROM f JOIN e ON e.item_id = f.item_id AND e.k = f.k + 1))"""
_TURNS = """e AS (SELECT CAST(user_id AS VARCHAR) AS conn_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'audio' WHEN 'click' THEN 'audio' WHEN 'purchase' THEN 'commit' WHEN 'error' THEN 'cancel' ELSE 'start' END AS kind,
    CAST(floor(value * 1000) AS BIGINT) AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f AS (
  SELECT DISTINCT conn_id, 0::BIGINT AS k, 0::BIGINT AS seq, '' AS outcome, NULL::BIGINT AS n_bytes, NULL::BIGINT AS held, 0 AS chunks FROM e
  UNION ALL
  SELECT e.conn_id, e.k, e.seq, CASE kind
      WHEN 'start' THEN 'started' WHEN 'cancel' THEN 'cancelled'
      WHEN 'audio' THEN CASE WHEN held IS NULL THEN 'error:no_turn' WHEN (held + n) / 32000.0 > 10 THEN 'error:too_long' ELSE 'buffered' END
      ELSE CASE WHEN held IS NULL THEN 'error:no_turn' WHEN chunks = 0 THEN 'error:empty_turn' ELSE 'committed' END END,
    CASE WHEN kind = 'audio' AND (held + n) / 32000.0 <= 10 THEN held + n WHEN kind = 'commit' AND chunks > 0 THEN held END,
    CASE WHEN kind = 'start' THEN 0 WHEN kind = 'audio' AND (held + n) / 32000.0 <= 10 THEN held + n END, CASE WHEN kind = 'audio' AND (held + n) / 32000.0 <= 10 THEN chunks + 1 ELSE 0 END
  FROM f JOIN e ON e.conn_id = f.conn_id AND e.k = f.k + 1)"""
# a region ends with the last voiced frame before 22 silent ones, after 1000 frames, or with the recording
_REGIONS = """c AS (SELECT doc_id, string_split(text, '') AS cs FROM documents WHERE text <> ''),
s AS (SELECT doc_id, len(cs) AS n, i, CASE WHEN (unicode(cs[(i // 30) * 30 + 1]) + i // 30) % 3 > 0 THEN 0.2 + (i % 5) * 0.01 ELSE 0 END AS x FROM (SELECT doc_id, cs, unnest(range(0, len(cs))) AS i FROM c)),
e AS (SELECT doc_id, n, i, sqrt(x * x + 1e-12) AS e FROM s),
t AS (SELECT doc_id, greatest(0.003, 2.5 * quantile_cont(e, 0.2), 0.08 * quantile_cont(e, 0.95)) AS most FROM e GROUP BY doc_id),
v AS (SELECT doc_id, n, i FROM e JOIN t USING (doc_id) WHERE e >= most),
g AS (SELECT *, coalesce(lead(i) OVER w - i > 22, true) AS ends FROM v WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT doc_id, n, i, min(CASE WHEN ends THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS last FROM g),
firsts AS (SELECT doc_id, min(i) AS a FROM h GROUP BY doc_id),
r AS (
  SELECT doc_id, a, CASE WHEN closed THEN last + 1 WHEN cut THEN a + 1000 ELSE n END AS b, cut AND NOT closed AS whole, CASE WHEN closed THEN last + 22 WHEN cut THEN a + 1000 END AS onward
    FROM (SELECT h.doc_id, a, last, n, last + 22 <= least(n - 1, a + 999) AS closed, a + 999 <= n - 1 AS cut FROM firsts JOIN h ON h.doc_id = firsts.doc_id AND h.i = a)
  UNION ALL
  SELECT doc_id, a, CASE WHEN closed THEN last + 1 WHEN cut THEN a + 1000 ELSE n END, cut AND NOT closed, CASE WHEN closed THEN last + 22 WHEN cut THEN a + 1000 END
    FROM (SELECT doc_id, a, last, n, last + 22 <= least(n - 1, a + 999) AS closed, a + 999 <= n - 1 AS cut FROM (SELECT h.doc_id, min(h.i) AS a, arg_min(h.last, h.i) AS last, any_value(h.n) AS n FROM r JOIN h ON h.doc_id = r.doc_id AND h.i >= r.onward GROUP BY h.doc_id)))"""

ORACLES = {
    "segment_recording": f"WITH RECURSIVE {_REGIONS}, k AS (SELECT r.doc_id, a, b, row_number() OVER (PARTITION BY r.doc_id ORDER BY a) - 1 AS p, len(cs) AS n FROM r JOIN c USING (doc_id) WHERE whole OR b - a >= 30) SELECT doc_id, doc_id || '#segment-' || lpad(CAST(p AS VARCHAR), 4, '0') AS segment, greatest(0, a - 4) / 50.0::DOUBLE AS start, least(n, b + 4) / 50.0::DOUBLE AS \"end\", 44 + 2 * (least(n, b + 4) - greatest(0, a - 4)) AS bytes FROM k",
    "review_audit": f"WITH RECURSIVE {_REVIEW} SELECT item_id, seq, action, actor, error IS NULL AS accepted, error, state FROM f WHERE k > 0",
    "review_final_state": f"WITH RECURSIVE {_REVIEW} SELECT item_id, arg_max(state, seq) AS state, max(label) AS text, count(*) FILTER (error IS NULL) AS accepted, count(*) FILTER (error IS NOT NULL) AS refused FROM f WHERE k > 0 GROUP BY item_id",
    "turn_buffers": f"WITH RECURSIVE {_TURNS} SELECT conn_id, seq, outcome, n_bytes, CASE WHEN outcome = 'committed' THEN n_bytes / 32000.0::DOUBLE END AS seconds FROM f WHERE k > 0",
    "voice_normalizers": "SELECT doc_id, CASE WHEN lang IN ('en', 'fr') THEN o.text WHEN lang = 'de' THEN t.text ELSE g.text END AS text FROM documents d JOIN (" + ") o USING (doc_id) JOIN (".join(corpus.ORACLES[f"normalize_{k}"] for k in ("orthography", "transcript")) + ") t USING (doc_id) JOIN (" + corpus.ORACLES["normalize_generic"] + ") g USING (doc_id)",
    "error_rate_rows": f"WITH {UTTERANCES} SELECT conv_id, turn, word_errors, reference_words, char_errors, reference_chars FROM counted",
    "wer_global": f"WITH {UTTERANCES} SELECT {_SUMS} FROM counted",
    "wer_slices": f"WITH {UTTERANCES}, s AS ({' UNION ALL '.join(_SLICE.format(a) for a in speech.SLICES)}) SELECT attribute, value, {_SUMS} FROM s GROUP BY attribute, value",
    "wer_by_dialect": f"WITH {UTTERANCES}, w AS (SELECT coalesce(nullif(dialect, ''), 'unlabeled') AS value, string_split(reference, ' ') AS a, string_split(hypothesis, ' ') AS b FROM utterances), e AS (SELECT value, len(a) AS n, levenshtein({mapped('a', 'v', 126)}, {mapped('b', 'v', 127)}) AS d FROM (SELECT *, list_intersect(a, b) AS v FROM w)) SELECT value, count(*) AS utterances, sum(d)::BIGINT AS word_errors, sum(n)::BIGINT AS reference_words, sum(d)::DOUBLE / sum(n) AS wer FROM e GROUP BY value",
    "latency_percentiles": f"WITH {LATENCIES} SELECT {_LATENCY} FROM latencies",
    "latency_slices": f"WITH {LATENCIES} SELECT dialect, {_LATENCY} FROM latencies GROUP BY dialect",
    "rtf": f"WITH {LATENCIES} SELECT {_RTF} FROM latencies",
    "benchmark_gates": f"WITH {UTTERANCES}, {LATENCIES}, f AS (SELECT (SELECT sum(word_errors)::DOUBLE / sum(reference_words) FROM counted) AS wer, (SELECT sum(char_errors)::DOUBLE / sum(reference_chars) FROM counted) AS cer, (SELECT round(quantile_cont(latency_seconds, 0.95), 6) FROM latencies) AS p95, (SELECT {_RTF.replace(' AS rtf', '')} FROM latencies) AS rtf) SELECT gate, value, most, value <= most AS passed FROM (SELECT 'wer' AS gate, wer AS value, 0.20::DOUBLE AS most FROM f UNION ALL SELECT 'cer', cer, 0.10 FROM f UNION ALL SELECT 'p95', p95, 2.0 FROM f UNION ALL SELECT 'rtf', rtf, 0.60 FROM f)",
    "latency_histogram": f"WITH {LATENCIES} SELECT dialect, CAST(floor(latency_seconds / 50.0::DOUBLE) AS BIGINT) AS bucket, count(*) AS n FROM latencies GROUP BY 1, 2",
    "source_plan": f"WITH {_CATALOG}, {_BY_CODE}, plan(language, task, role, position, source_id) AS (VALUES {', '.join(str(p) for p in PLAN)}) SELECT language, task, role, CAST(position AS BIGINT) AS position, source_id, license, usage, documents FROM plan JOIN catalog USING (source_id) LEFT JOIN dl USING (language)",
    "usage_matrix": f"WITH {_CATALOG}, {_BY_CODE}, u(requested) AS (VALUES ('production'), ('evaluation'), ('research')), e AS (SELECT source_id, usage, unnest(languages) AS language FROM catalog) SELECT source_id, requested, {_RANK.format('requested')} >= {_RANK.format('usage')} AS allowed, CAST(sum(documents) AS BIGINT) AS documents FROM e LEFT JOIN dl USING (language), u GROUP BY source_id, usage, requested",
    "catalog_plan": f"WITH {_CATALOG}, d AS (SELECT DISTINCT lang FROM documents) SELECT lang, requested, source_id, usage FROM catalog, d, (VALUES ('production'), ('evaluation'), ('research')) u(requested) WHERE list_contains(languages, CASE lang WHEN 'en' THEN 'aa' WHEN 'de' THEN 'bb' ELSE 'cc' END) AND list_contains(tasks, 'asr') AND {_RANK.format('requested')} >= {_RANK.format('usage')}",
    "adapters_union": "SELECT 'a/ ' || doc_id || '  x' AS audio, sha256(text) AS text, CASE WHEN doc_id % 3 = 0 THEN ' ' || source WHEN doc_id % 3 = 2 AND doc_id % 2 = 0 THEN source ELSE '' END AS speaker, CASE WHEN doc_id % 3 = 1 THEN '' ELSE lang END AS dialect, CASE doc_id % 3 WHEN 0 THEN 'aware:' || doc_id WHEN 1 THEN 'plain:' || CASE WHEN doc_id % 2 = 0 THEN ' ' ELSE CAST(doc_id AS VARCHAR) END ELSE 'client:a/ ' || doc_id || '  x' END AS source_id, NOT (doc_id % 3 = 0 OR (doc_id % 3 = 2 AND doc_id % 2 = 0)) AS training_only FROM documents",
    "acquire_capped": f"WITH {_ACQUIRED} SELECT rn, speaker, outcome FROM a",
    "acquire_totals": f"WITH {_ACQUIRED} SELECT speaker, count(*) FILTER (outcome = 'imported') AS imported, count(*) FILTER (outcome = 'skipped') AS skipped, round(sum(CAST(n_chars / 150.0::DOUBLE AS DECIMAL(18,6))) FILTER (outcome = 'imported')::DOUBLE / 3600, 6) AS hours FROM a JOIN documents ON doc_id = rn GROUP BY speaker",
    "importer_outcomes": "SELECT CASE WHEN NOT (coalesce(quality = 1, false) OR (quality IS NULL AND toxic IS NULL)) THEN 'reject:consent' WHEN d.doc_id % 11 = 0 THEN 'reject:missing_file' WHEN d.doc_id % 7 = 0 THEN 'quarantine:multi_speaker' ELSE 'import' END AS outcome, count(*) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1",
    "mos_by_model": "SELECT event_type AS model_id, count(*) AS ratings, " + ", ".join(f"round(sum((CAST(floor(value * {k}) AS BIGINT) % 5 + 1))::DOUBLE / count(*), 4) AS {m}" for k, m in enumerate(speech.METRICS, 1)) + " FROM events GROUP BY event_type",
    "assignment_buckets": "SELECT doc_id, CAST('0x' || substr(sha256(doc_id || chr(31) || source), 1, 8) AS BIGINT) % 5 AS bucket FROM documents",
    "pointer_history": f"WITH {_POINTERS} SELECT *, lag(model_id) OVER w AS previous_model_id, lead(model_id) OVER w IS NULL AS latest FROM p WINDOW w AS (PARTITION BY task, stage ORDER BY updated)",
    "latest_pointers": f"WITH {_POINTERS} SELECT task, stage, arg_max(model_id, updated) AS model_id FROM p GROUP BY task, stage",
    "latest_checkpoint": "SELECT 'run/checkpoint-' || max(event_id) AS path, max(event_id) AS step FROM events WHERE event_type <> 'error'",
    "model_routes": "SELECT CASE WHEN lang IN ('fr', 'de') THEN 'custom:' || lang ELSE 'shared' END AS route, count(*) AS n FROM documents GROUP BY 1",
    "language_routes": """SELECT language, CASE WHEN language = 'en' THEN 'models/en' WHEN language IS NULL OR language = 'fr' THEN 'shared' END AS engine, CASE language WHEN 'fr' THEN 'french' END AS hint,
  CASE language WHEN 'de' THEN 'not deployed: models/de' WHEN 'es' THEN 'unknown language es' END AS error, count(*) AS n FROM (SELECT CASE WHEN doc_id % 9 > 0 THEN lang END AS language FROM documents) GROUP BY language""",
    "array_quality": "SELECT vec_id, duration, peak, round(rms, 9) AS rms, clipped, round(o, 9) AS offset, duration < 0.35 OR duration > 30 OR rms < 1e-4 OR clipped > 0.005 OR abs(o) > 0.05 AS suspicious FROM (SELECT vec_id, len(embedding) / 16.0::DOUBLE AS duration, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS peak, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)) AS rms, len(list_filter(embedding, lambda x: abs(x::DOUBLE) >= 0.999)) / len(embedding)::DOUBLE AS clipped, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / len(embedding) AS o FROM embeddings)",
    "pcm_duration": "SELECT event_id AS seq, CAST(floor(value * 1000) AS BIGINT) / 32000.0::DOUBLE AS seconds FROM events",
    "gap_segments": "WITH e AS (SELECT user_id, epoch_us(ts) AS micros FROM events), f AS (SELECT *, CASE WHEN coalesce(micros - lag(micros) OVER (PARTITION BY user_id ORDER BY micros) >= 3600000000, true) THEN 1 ELSE 0 END AS fresh FROM e), s AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY micros) - 1 AS BIGINT) AS segment FROM f) SELECT user_id, segment, min(micros) AS start, max(micros) AS \"end\", count(*) AS n FROM s GROUP BY user_id, segment",
    "review_queue": "SELECT CAST(event_id AS VARCHAR) AS item_id FROM events WHERE event_type = 'view' ORDER BY ts DESC, CAST(event_id AS VARCHAR) LIMIT 100",
    "store_admission": "SELECT min(doc_id) AS seq, sha256(text) AS sha256 FROM documents WHERE doc_id % 2 = 1 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0) GROUP BY 2",
    "experiment_ids": "SELECT source, lang, lang || '-asr-' || left(sha256('{\"dataset\":\"' || source || '\",\"language\":\"' || lang || '\",\"task\":\"asr\"}'), 12) AS experiment_id, CAST('0x' || substr(sha256(source), 1, 8) AS BIGINT) AS seed FROM (SELECT DISTINCT source, lang FROM documents)",
}
