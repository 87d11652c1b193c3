"""Readers of the engine's file formats. Schemas are always given, never inferred."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Collection

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .landing import listed, opened, shard_report

#: Columns of acquisition metadata, corpus base files, inventories and ratings, and fields of manifest and utterance lines.
METADATA_COLUMNS = ["audio", "text", "speaker", "dialect", "source_id", "consent_attested", "transcript_reviewed", "governance_approved", "upstream_validated", "training_only", "source_license", "source_revision", "governance_basis", "source_dataset", "source_config", "source_split", "sample_rate"]
CORPUS_COLUMNS = ["audio", "text", "speaker", "dialect", "source_id", "consent_attested", "transcript_reviewed"]
INVENTORY_COLUMNS = ["path", "source_id", "speaker", "language", "multi_speaker", "consent_attested"]
RATING_COLUMNS = ["model_id", "naturalness", "pronunciation", "intelligibility", "speaker_similarity"]
MANIFEST_SCHEMA = "audio_filepath string, text string, duration double, speaker string, language string, sha256 string, dialect string, source_id string, consent_attested boolean, transcript_reviewed boolean, governance_approved boolean, upstream_validated boolean, training_only boolean, source_license string, source_revision string, governance_basis string, split string"
UTTERANCE_SCHEMA = "reference string, hypothesis string, audio_seconds double, latency_seconds double, speaker string, dialect string, noise string, code_switch string"


def csv(spark: SparkSession, path: str, required: list[str], ordinal: str | None = None) -> DataFrame:
    """A CSV file with a header, all columns as text; a byte order mark and line breaks in quotes are understood. A missing column is an error.

    ``ordinal`` names a column for the rows' numbers in their file, which begin with 2, after the header: a file with
    line breaks in quotes is read by one task, so rows keep their order. It holds for one file, not for a folder.
    """
    read = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", False).csv(path)
    missing = sorted(set(required) - set(read.columns))
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    return read.withColumn(ordinal, F.monotonically_increasing_id() + 2) if ordinal else read


def ratings(spark: SparkSession, path: str) -> DataFrame:
    """Listening ratings: a model and four figures."""
    read = csv(spark, path, RATING_COLUMNS)
    return read.select("model_id", *[F.nullif(F.trim(c), F.lit("")).cast("double").alias(c) for c in RATING_COLUMNS[1:]])


def _parsed(lines: DataFrame, schema: str, required: Collection[str]) -> DataFrame:
    """``lines`` with the object of each (column r) and whether it is none, or lacks a required field (column bad)."""
    full = StructType.fromDDL(schema).add("_bad", "string")
    parsed = lines.withColumn("r", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull() | ~F.ltrim("value").startswith("{")
    for c in required:
        bad = bad | F.col(f"r.{c}").isNull()
    return parsed.withColumn("bad", bad)


def jsonl(spark: SparkSession, path: str, schema: str, required: Collection[str] = ()) -> DataFrame:
    """JSON lines; blank lines are skipped, anything but an object, or a lacking required field, is an error; ``faulty_lines`` gives their numbers."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).filter(F.trim("value") != "")
    parsed = _parsed(lines, schema, required)
    checked = parsed.select(F.when(~F.col("bad"), F.col("r")).otherwise(F.raise_error(F.concat(F.lit("invalid line in "), "file", F.lit(": "), F.left("value", F.lit(200))))).alias("r"))
    return checked.select("r.*").drop("_bad")


def faulty_lines(spark: SparkSession, path: str, schema: str, required: Collection[str] = (), whole: bool = False) -> DataFrame:
    """file, line (from 1, blank ones counted) and value of the lines that ``jsonl`` refuses.

    With ``whole``, the files are one text in the order of their names, and lines are numbered through all of them.

    Tasks read parts of files and number the lines of each part; the lines of the parts before it, one count a part, are
    added. So files of any size are read in parallel and lines still have their numbers.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("at"))
    parts = lines.groupBy("file", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    order = Window.orderBy("file", "part") if whole else Window.partitionBy("file").orderBy("part")  # of parts, not of lines
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bad = _parsed(lines, schema, required).filter((F.trim("value") != "") & F.col("bad")).select("value", "file", "part", "at")
    met = bad.join(parts.withColumn("before", before), ["file", "part"])
    return met.select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def utterances(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark utterances; empty slice labels are null."""
    read = jsonl(spark, path, UTTERANCE_SCHEMA, ["reference", "hypothesis", "audio_seconds", "latency_seconds"])
    return read.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in ("speaker", "dialect", "noise", "code_switch")})


#: Shards that an error about lacking columns names.
NAMED_SHARDS = 10


def projected_parquet(spark: SparkSession, path: str, fields: dict[str, str], semantics: list[str] | None = None) -> DataFrame:
    """The physical columns that a mapping names, by their semantic names. Only these are read.

    ``path`` may be a pattern. Executors look into the footer of every shard first; a shard that lacks a column is an
    error that names it. Of ``semantics``, if given, those that the mapping leaves out are null.
    """
    lacking = shard_report(spark, path, sorted(set(fields.values()))).filter(F.size("missing") > 0).orderBy("shard").limit(NAMED_SHARDS).collect()
    if lacking:
        raise ValueError("; ".join(f"{r.shard}: missing columns {r.missing}" for r in lacking))
    read = spark.read.parquet(path)
    return read.select(*[F.col(fields[s]).alias(s) if s in fields else F.lit(None).cast("string").alias(s) for s in semantics or fields])


#: A reader of a provider's rows, from a session and a source of the catalogue.
Reader = Callable[[SparkSession, dict], DataFrame]


def source_rows(spark: SparkSession, source: dict, root: str, providers: dict[str, Reader], semantics: list[str]) -> DataFrame:
    """The rows of a catalogue source: from the Parquet files below ``root`` that its pattern names, at its revision, else from its provider's reader."""
    fields = {s: p for s, p in source["fields"].items() if s in semantics}
    if source.get("data_files_glob"):
        return projected_parquet(spark, "/".join(x for x in (root, source.get("revision"), source["data_files_glob"]) if x), fields, semantics)
    if source["provider"] not in providers:
        raise ValueError(f"no reader for provider {source['provider']}")
    rows = providers[source["provider"]](spark, source)
    return rows.select(*[F.col(fields[s]).alias(s) if fields.get(s) in rows.columns else F.lit(None).cast("string").alias(s) for s in semantics])


def public_voices(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Voice profiles of a folder, newest first: the fields of ``schema`` (with created_at); damaged profiles and those that lack one are left out."""
    names = StructType.fromDDL(schema).fieldNames()
    read = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).na.drop("any", subset=names)
    return read.orderBy(F.desc("created_at"))


def audio_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content and sha256 of the files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content", F.sha2("content", 256).alias("sha256"))


def bounded_files(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """path, length and content of the files below a folder that have at most ``limit`` bytes.

    The source compares lengths before it opens a file, so larger ones cost nothing but their listing. Spark's scans pass
    over empty files.
    """
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).filter(F.col("length") <= limit).select("path", "length", "content")


#: Bytes of a file that are read together.
RANGE_BYTES = 1 << 20


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and sha256 of the files below a folder, empty ones too; a task reads them in ranges, so a file of any size passes."""
    names = [(name,) for _, name in listed(path, "*")]  # as Spark does for its sources, the driver lists
    listing = spark.createDataFrame(names, "path string").repartition(max(1, min(len(names), spark.sparkContext.defaultParallelism * 4)))

    def digest(name: str) -> tuple[int, str]:
        fs, inside = opened(name)
        sums, size = hashlib.sha256(), 0
        with fs.open_input_stream(inside) as f:
            while chunk := f.read(RANGE_BYTES):
                sums.update(chunk)
                size += len(chunk)
        return size, sums.hexdigest()

    def run(batches):
        for batch in batches:
            found = [digest(p) for p in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([n for n, _ in found], type=pa.int64()), pa.array([d for _, d in found], type=pa.string())], names=["path", "bytes", "sha256"])

    return listing.mapInArrow(run, "path string, bytes long, sha256 string")


def with_existing(rows: DataFrame, listing: DataFrame, audio: str = "audio") -> DataFrame:
    """``rows`` with column has_audio: whether the listing has the path."""
    known = listing.select(F.col("path").alias(audio)).distinct().withColumn("has_audio", F.lit(True))
    return rows.join(known, audio, "left").withColumn("has_audio", F.coalesce("has_audio", F.lit(False)))


def count_lines(spark: SparkSession, path: str, split: str | None = None) -> int:
    """Lines that aren't blank, of a split if given."""
    if split is None:
        return spark.read.text(path).filter(F.trim("value") != "").count()
    return jsonl(spark, path, MANIFEST_SCHEMA).filter(F.col("split") == split).count()


def line_counts(spark: SparkSession, path: str, splits: Collection[str], folders: bool) -> DataFrame:
    """split and n, the lines that aren't blank of each of ``splits``, 0 where there are none, from one read of the files.

    With ``folders``, a split's files are in a folder of its name; else lines name their split themselves.
    """
    if folders:
        lines = spark.read.text([f"{path}/{s}" for s in splits]).filter(F.trim("value") != "")
        lines = lines.select(F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]*)/[^/]*$", 1).alias("split"))
    else:
        lines = jsonl(spark, path, MANIFEST_SCHEMA).select("split")
    asked = spark.createDataFrame([(s,) for s in splits], "split string")
    counts = lines.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    return asked.join(counts, "split", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
