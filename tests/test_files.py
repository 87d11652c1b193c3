import json
import random

import pytest
from pyspark.sql import functions as F

from sillon.sources import files, sinks
from sillon.streaming.ingest import Landing, first_wins, ingest, outcomes


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('﻿audio,text,extra\na.wav,"two\nlines ""q""",1\n', encoding="utf-8")
    (r,) = files.csv(spark, str(p), ["audio", "text"]).collect()
    assert (r.audio, r.text) == ("a.wav", 'two\nlines "q"')
    with pytest.raises(ValueError, match="speaker"):
        files.csv(spark, str(p), ["speaker"])


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": 1, "b": "x"}\n\n{"a": 2}\n')
    assert [r.a for r in files.jsonl(spark, str(p), "a long, b string").orderBy("a").collect()] == [1, 2]
    for bad in ('[1]\n', '{"a": 1\n', '{"b": "x"}\n'):
        p.write_text(bad)
        with pytest.raises(Exception, match="invalid line"):
            files.jsonl(spark, str(p), "a long, b string", ["a"]).collect()


def test_parquet(spark, tmp_path):
    p = str(tmp_path / "t")
    spark.createDataFrame([(1, "x", 2)], "i int, t string, stray int").write.parquet(p)
    assert files.projected_parquet(spark, p, {"text": "t"}).columns == ["text"]
    with pytest.raises(ValueError, match="speaker"):
        files.projected_parquet(spark, p, {"who": "speaker"})


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a.wav", "t", 1.1234567, None, "xx", "train")], "audio_filepath string, text string, duration double, speaker string, language string, split string")
    sinks.split_files(rows, str(tmp_path / "out"))
    for split in sinks.SPLITS:
        assert (tmp_path / "out" / split).exists()
    assert spark.read.text(str(tmp_path / "out/train")).first().value == '{"audio_filepath":"a.wav","text":"t","duration":1.12346,"language":"xx"}'
    sinks.metadata_csv(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == files.METADATA_COLUMNS
    sinks.json_report({"é": 1}, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"é": 1}


def test_audio_listing(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x")
    listing = files.audio_files(spark, str(tmp_path))
    path = listing.first().path
    rows = spark.createDataFrame([(path,), ("none",)], "audio string")
    assert {r.audio: r.has_audio for r in files.with_existing(rows, listing).collect()} == {path: True, "none": False}


REASONS = "array<string>"


def staged(df):
    """A stage whose first reasons are empty texts and whose second are short ones."""
    none = F.array().cast(REASONS)
    one = F.when(F.coalesce(F.col("text"), F.lit("")) == "", F.array(F.lit("empty_text"))).otherwise(none)
    return df.withColumn("one", one).withColumn("two", F.when((F.size("one") == 0) & (F.length("text") < 2), F.array(F.lit("too_short"))).otherwise(none))


def rows_of_files():
    """Files of rows: digests that repeat within and over files, come late, are null, or belong to rows with faults."""
    rng = random.Random(11)
    rows = [(i, rng.choice(["aa", "bb", "cc", "dd", "e", "", None]), rng.choice([f"d{k}" for k in range(9)] + [None])) for i in range(90)]
    rng.shuffle(rows)
    return [rows[i : i + 5] for i in range(0, 90, 5)]


def expected_reasons(files):
    rows = sorted(r for f in files for r in f)
    seen, out = set(), {}
    for rn, text, digest in rows:
        if not text:
            out[rn] = ["empty_text"]
        else:
            out[rn] = ["duplicate_audio"] * (digest in seen) + ["too_short"] * (len(text) < 2)
            if not out[rn]:
                seen.add(digest)
    return out


@pytest.mark.parametrize("per_batch", [1, 7, 1000])
def test_ingestion_does_not_depend_on_batches(spark, tmp_path, per_batch):
    files = rows_of_files()
    schema = "rn long, text string, sha256 string"
    landing = Landing(str(tmp_path / "out"))
    assert outcomes(spark, landing) is None

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(str(tmp_path / "in"))
        ingest(stream, staged, landing).awaitTermination()

    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k == len(files) // 2:
            run()  # and again later, from its checkpoint
    run()
    got = {r.rn: r.reasons for r in outcomes(spark, landing).collect()}
    assert got == expected_reasons(files)
    run()  # nothing new
    assert {r.rn: r.reasons for r in outcomes(spark, landing).collect()} == got


def test_a_repeated_batch_writes_the_same(spark, tmp_path):
    """A batch that failed after some of its writes runs again under its number."""
    files = rows_of_files()
    schema = "rn long, text string, sha256 string"
    landing = Landing(str(tmp_path / "out"))
    (tmp_path / "in").mkdir()
    failed = []

    def failing(df):
        if len(failed) == 3:
            failed.append(0)
            raise RuntimeError("lost")
        failed.append(1)
        return staged(df)

    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="lost"):
        ingest(stream(), failing, landing).awaitTermination()
    ingest(stream(), failing, landing).awaitTermination()
    assert {r.rn: r.reasons for r in outcomes(spark, landing).collect()} == expected_reasons(files)


def test_first_to_arrive_wins_in_a_stream(spark, tmp_path):
    spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "id string, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = first_wins(spark.readStream.schema("id string, text string").parquet(str(tmp_path / "in")), "text")
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "ok")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "ok")).collect()) == ["x", "y"]
