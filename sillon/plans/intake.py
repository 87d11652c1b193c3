"""Queries of landing zones, resumable acquisition, tree digests, bounded uploads, observed figures and roll-backs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sillon.operators import acquisition, compiler, governance, lineage, metrics
from sillon.sources import files, landing, sinks
from sillon.sources.tables import table
from sillon.sources.workspace import folder

from .views import JUDGED, latencies, manifest
from .workflow import ORACLES as WORKFLOW
from .workflow import _pointers

_FIELDS = {"id": "doc_id", "words": "text", "language": "lang"}
_ROWS = "id long, words string, language string"


def _shards(spark, sf_dir, base, numbers, revision="r1"):
    """Documents as shards of a revision, a folder of files each, written in parallel; those of shard 2 are without their language."""
    d = table(spark, sf_dir, "documents").withColumn("shard", F.pmod("doc_id", F.lit(3)))
    for k in numbers:
        d.filter(F.col("shard") == k).drop("shard", *(["lang"] if k == 2 and revision == "r2" else [])).write.parquet(f"{base}/{revision}/shard-{k}")


def zone_rows(spark, sf_dir):
    """Rows of a landing zone at a pinned revision, through the data source."""
    base = folder(spark, "zone")
    _shards(spark, sf_dir, base, (0, 1, 2))
    read = landing.zone(spark, base, _ROWS, _FIELDS, "r1", "shard-*/*.parquet")
    return read.select("id", F.sha2("words", 256).alias("words"), "language")


def zone_stream_rows(spark, sf_dir):
    """The same as a stream that ends after two shards and goes on from its offsets with the third."""
    base = folder(spark, "zone")
    for numbers in ((1, 2), (0,)):
        _shards(spark, sf_dir, base, numbers)
        rows = landing.zone_stream(spark, base, _ROWS, _FIELDS, "r1", "shard-*/*.parquet")
        rows.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/out").select("id", F.sha2("words", 256).alias("words"), "language")


def shard_columns(spark, sf_dir):
    """Rows and lacking columns of each shard of a revision in which one has no language."""
    base = folder(spark, "zone")
    _shards(spark, sf_dir, base, (0, 1, 2), "r2")
    report = landing.shard_report(spark, f"{base}/r2/*", ["doc_id", "text", "lang"]).filter("n_rows > 0")
    by = F.regexp_extract("shard", r"/(shard-\d)/", 1).alias("shard"), F.array_join("missing", ",").alias("missing")
    return report.groupBy(*by).agg(F.sum("n_rows").alias("n_rows")).select("shard", "n_rows", "missing")


def resumed_acquisition(spark, sf_dir):
    """Receipts of sources by language: the run stops in the third source, and the next one takes the first two as they are."""
    base = folder(spark, "acquired")
    rows = manifest(spark, sf_dir).withColumn("fine", F.col("duration") <= 20.0).select("rn", "language", "sha256", "duration", "text", "fine")
    names = ["de", "en", "es", "fr"]
    catalog = {n: {"languages": [n], "tasks": ["asr"], "usage": "production", "provider": "landing"} for n in names}
    requests = [acquisition.Request(n, n, "asr", "train", "f" * 40, requested_max_samples=25) for n in names]
    stopped = rows.withColumn("text", F.when(F.col("language") == "es", F.raise_error(F.lit("stopped"))).otherwise(F.col("text")))
    try:
        acquisition.acquire_all(spark, requests, catalog, lambda r: stopped.filter(F.col("language") == r.language), base, {"landing"})
    except Exception as e:
        if "stopped" not in str(e):
            raise
    found = acquisition.acquire_all(spark, requests, catalog, lambda r: rows.filter(F.col("language") == r.language), base, {"landing"})
    reused = spark.createDataFrame([(r["source_id"], r["reused"]) for r in found], "source_id string, reused boolean")
    return acquisition.receipts(spark, base).join(reused, "source_id").select("source_id", "imported", "skipped", "hours", "reused")


def tree_digests(spark, sf_dir):
    """Model trees of text files, one tree a nation: their digests and ids."""
    base = folder(spark, "trees")
    s = table(spark, sf_dir, "supplier")
    name = F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit("/w"), F.col("s_suppkey").cast("string"))
    sinks.small_files(s, name, F.col("s_name"), base)
    parts = F.regexp_extract("path", r"/(n[^/]*)/[^/]*$", 1).alias("tree"), F.substring_index("path", "/", -1).alias("path")
    digests = files.file_digests(spark, base).select(*parts, "bytes", "sha256")
    return lineage.model_ids(lineage.tree_digests(digests, "tree"), F.col("tree"), F.lit("asr"))


def bounded_uploads(spark, sf_dir):
    """Files that an upload's limit lets in; the others aren't opened."""
    base = folder(spark, "uploads")
    content = F.repeat(F.lit("x"), F.pmod("s_suppkey", F.lit(40)).cast("int"))
    sinks.small_files(table(spark, sf_dir, "supplier"), F.concat(F.lit("k"), F.col("s_suppkey").cast("string")), content, base)
    return files.bounded_files(spark, base, 20).select(F.regexp_extract("path", r"/k(-?\d+)$", 1).cast("long").alias("k"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


_BOUNDS = [10.0, 50.0, 200.0]


def observed_outcomes(spark, sf_dir):
    """Accepted and rejected rows as they were seen while the rows were written."""
    judged, seen = metrics.observed(compiler.judged(manifest(spark, sf_dir)), "outcomes", metrics.outcome_figures())
    judged.select("rn", "reasons", "split").write.parquet(folder(spark, "judged"))
    return spark.createDataFrame([tuple(seen.get[c] for c in ("rows", "accepted", "rejected"))], "rows long, accepted long, rejected long")


def observed_timings(spark, sf_dir):
    """Stage timings that a stream's batches reported, added up."""
    base = folder(spark, "timings")
    rows = latencies(spark, sf_dir)
    rows.repartition(6).write.parquet(f"{base}/in")
    figures = metrics.Figures("timings")
    spark.streams.addListener(figures)
    try:
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in").observe("timings", *metrics.timing_figures("latency_seconds", _BOUNDS))
        stream.writeStream.format("noop").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        metrics.settled(figures, 3)
    finally:
        spark.streams.removeListener(figures)
    names = ["count", "sum", *[f"le_{i}" for i in range(len(_BOUNDS))]]
    return spark.createDataFrame([(int(figures.totals["count"]), float(figures.totals["sum"]), *[int(figures.totals[n]) for n in names[2:]])], "count long, sum double, le_0 long, le_1 long, le_2 long").withColumn("sum", F.round("sum", 3))


def roll_back_targets(spark, sf_dir):
    """Where each task's latest pointer would roll back to."""
    pointers = _pointers(spark, sf_dir)
    cards = pointers.select("task", "stage", "model_id", F.concat(F.lit("models/"), "model_id").alias("artifact_path"))
    return governance.roll_backs(governance.pointer_history(pointers, ["task", "stage"], "model_id", ["updated"]), cards, ["task", "stage"])


def faulty_lines(spark, sf_dir):
    """The numbers of broken lines of a text in ordered parts: every 13th is cut short, every 17th lacks its text, every 7th before it is blank."""
    path = folder(spark, "lines")
    d = table(spark, sf_dir, "documents").filter("text is not null")
    whole = F.to_json(F.struct("doc_id", F.when(F.pmod("doc_id", F.lit(17)) > 0, F.col("text")).alias("text")))
    line = F.when(F.pmod("doc_id", F.lit(13)) == 0, F.expr("left(l, length(l) - 1)")).otherwise(F.col("l"))
    lines = d.withColumn("l", whole).withColumn("l", F.concat(F.when(F.pmod("doc_id", F.lit(7)) == 0, F.lit("\n")).otherwise(""), line))
    lines.orderBy("doc_id").select("l").write.text(path)
    return files.faulty_lines(spark, path, "doc_id long, text string", ["text"], whole=True).select("line", F.sha2("value", 256).alias("sha256"))


QUERIES = {f.__name__: f for f in (faulty_lines, zone_rows, zone_stream_rows, shard_columns, resumed_acquisition, tree_digests, bounded_uploads, observed_outcomes, observed_timings, roll_back_targets)}

_ZONE = "SELECT doc_id AS id, sha256(text) AS words, lang AS language FROM documents"

ORACLES = {
    "faulty_lines": """WITH l AS (SELECT doc_id, '{"doc_id":' || doc_id || CASE WHEN doc_id % 17 > 0 THEN ',"text":' || to_json(text) ELSE '' END || '}' AS l FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN l[:-2] ELSE l END AS value, sum(1 + CAST(doc_id % 7 = 0 AS INTEGER)) OVER (ORDER BY doc_id) AS line FROM l)
SELECT CAST(line AS BIGINT) AS line, sha256(value) AS sha256 FROM n WHERE doc_id % 13 = 0 OR doc_id % 17 = 0""",
    "zone_rows": _ZONE,
    "zone_stream_rows": _ZONE,
    "shard_columns": "SELECT 'shard-' || (doc_id % 3) AS shard, count(*) AS n_rows, CASE WHEN doc_id % 3 = 2 THEN 'lang' ELSE '' END AS missing FROM documents GROUP BY doc_id % 3",
    "resumed_acquisition": """WITH m AS (SELECT doc_id AS rn, lang AS speaker, sha256(text) AS sha256, n_chars / 150.0::DOUBLE AS duration, n_chars / 150.0::DOUBLE <= 20.0 AS fine FROM documents),
g AS (SELECT *, fine AND rn = min(rn) FILTER (fine) OVER (PARTITION BY speaker, sha256) AS good FROM m),
r AS (SELECT *, sum(CASE WHEN good THEN 1 ELSE 0 END) OVER (PARTITION BY speaker ORDER BY rn) AS k FROM g),
a AS (SELECT speaker, duration, good FROM r WHERE k < 25 OR (k = 25 AND good))
SELECT speaker AS source_id, count(*) FILTER (good) AS imported, count(*) FILTER (NOT good) AS skipped, round(sum(CAST(duration AS DECIMAL(18,6))) FILTER (good)::DOUBLE / 3600, 6) AS hours, speaker IN ('de', 'en') AS reused FROM a GROUP BY speaker""",
    "tree_digests": """WITH f AS (SELECT 'n' || s_nationkey AS tree, 'w' || s_suppkey AS path, strlen(s_name) + 1 AS bytes, sha256(s_name || chr(10)) AS sha256 FROM supplier),
d AS (SELECT tree, count(*) AS files, sha256('[' || string_agg('{"bytes":' || bytes || ',"path":"' || path || '","sha256":"' || sha256 || '"}', ',' ORDER BY path) || ']') AS sha256 FROM f GROUP BY tree)
SELECT *, tree || '-asr-' || left(sha256, 12) AS model_id FROM d""",
    "bounded_uploads": "SELECT s_suppkey AS k, s_suppkey % 40 + 1 AS n_bytes, sha256(repeat('x', s_suppkey % 40) || chr(10)) AS sha256 FROM supplier WHERE s_suppkey % 40 + 1 <= 20",
    "observed_outcomes": f"WITH {JUDGED} SELECT count(*) AS rows, count(*) FILTER (len(reasons) = 0) AS accepted, count(*) FILTER (len(reasons) > 0) AS rejected FROM judged",
    "observed_timings": "SELECT count(value) AS count, round(sum(CAST(value AS DECIMAL(18,6)))::DOUBLE, 3) AS sum, " + ", ".join(f"count(*) FILTER (value <= {b}) AS le_{i}" for i, b in enumerate(_BOUNDS)) + " FROM events",
    "roll_back_targets": f"WITH h AS ({WORKFLOW['pointer_history']}) SELECT task, stage, model_id AS rolled_back, previous_model_id AS model_id, 'models/' || previous_model_id AS artifact_path FROM h WHERE latest AND previous_model_id IS NOT NULL",
}
