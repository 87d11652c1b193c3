"""Files, stores, uploads and lineage on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from sillon.functions import text as T
from sillon.operators import governance, quality, review
from sillon.plans.artifacts import CATALOG, PLAN, PROFILES
from sillon.sources import config, files, sinks
from sillon.sources.workspace import folder, text_file


def test_numbered_csv(spark):
    path = folder(spark, "csv")
    rows = spark.createDataFrame([(i, f'{i},"line\nbreak {i}"') for i in range(30)], "i long, line string")
    text_file(rows, "line", "i", path, "﻿id,text\n")
    got = files.csv(spark, path, ["id", "text"], "row").collect()
    assert [(r.row, r.id, r.text) for r in got] == [(i + 2, str(i), f"line\nbreak {i}") for i in range(30)]
    with pytest.raises(ValueError, match="missing columns"):
        files.csv(spark, path, ["id", "speaker"])


def test_catalogue_sources(spark, tmp_path):
    spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/r1/documents.parquet")
    sources = {s["source_id"]: s for s in config.catalog_rows(CATALOG)}
    lake = sources["lake"] | {"revision": "r1"}
    assert [tuple(r) for r in files.source_rows(spark, lake, str(tmp_path), {}, ["id", "text", "speaker"]).collect()] == [(1, "a", None)]
    with pytest.raises(ValueError, match="missing columns"):
        files.source_rows(spark, lake | {"fields": {"text": "nope"}}, str(tmp_path), {}, ["text"])
    with pytest.raises(ValueError, match="no reader"):
        files.source_rows(spark, sources["web"], "", {}, ["text"])
    assert config.plan(spark, PLAN).count() == 5 and set(config.profiles(PROFILES)) == {"en", "de"}


def test_damaged_voices_are_left_out(spark, tmp_path):
    lines = [{"voice_id": "a", "name": "x", "created_at": "2"}, {"voice_id": "b", "created_at": "3"}, {"voice_id": "c", "name": "y", "created_at": "9", "reference_path": "secret"}]
    (tmp_path / "v.json").write_text("\n".join(map(json.dumps, lines)) + '\n{"voice_id": "d", "name"\n')
    got = files.public_voices(spark, str(tmp_path), "voice_id string, name string, created_at string")
    assert got.columns == ["voice_id", "name", "created_at"] and [r.voice_id for r in got.collect()] == ["c", "a"]


def test_workspaces_keep_what_is_there(spark, tmp_path):
    profile = config.profiles(PROFILES)["en"]
    for _ in range(2):
        sinks.corpus_workspace(spark, profile, str(tmp_path))
    assert files.csv(spark, f"{tmp_path}/metadata", files.CORPUS_COLUMNS).count() == 0
    assert json.loads(spark.read.text(f"{tmp_path}/policy").first().value)["required_metadata"] == ["dialect"]


def test_store(spark, tmp_path):
    schema = "seq long, sha256 string, item_id string"
    path = f"{tmp_path}/store"
    review.insert(spark.createDataFrame([(1, "a", "i1"), (2, "a", "i2"), (3, "b", "i3")], schema), path)
    stored = review.insert(spark.createDataFrame([(4, "b", "i4"), (5, "c", "i5")], schema), path)
    assert sorted(r.item_id for r in stored.collect()) == ["i1", "i3", "i5"]
    assert review.item(stored, "item_id", "i3").first().seq == 3
    with pytest.raises(LookupError):
        review.item(stored, "item_id", "i2")
    with pytest.raises(ValueError):
        review.pending_drafts(stored, 1001)


def test_uploads_and_evaluation(spark):
    df = spark.createDataFrame([(5, False, "test"), (0, False, ""), (11, False, "train"), (11, True, None), (None, False, "test")], "n long, several boolean, split string")
    assert [r[0] for r in df.select(governance.upload_outcome(F.col("n"), F.col("several"), 10)).collect()] == ["accepted", "reject:empty", "reject:too_large", "reject:multi_speaker", "reject:empty"]
    assert sorted(r.split or "-" for r in governance.evaluated(df, "test").collect()) == ["-", "-", "test", "test"]


def test_receipts_and_lineage(spark):
    requests = spark.createDataFrame([(s, "r", 16000, None) for s in "abcd"], "source_id string, revision string, sample_rate int, max_samples int")
    receipts = spark.createDataFrame([("a", "r", 16000, None, "m"), ("b", "q", 16000, None, "m"), ("c", "r", 16000, None, "m")], "source_id string, resolved_revision string, sample_rate int, requested_max_samples int, metadata_sha256 string")
    metadata = spark.createDataFrame([("a", "1", "m"), ("b", "2", "m"), ("c", "3", "m")], "source_id string, audio string, metadata_sha256 string")
    listing = spark.createDataFrame([("1",), ("2",)], "path string")
    assert {r.source_id: r.reusable for r in governance.reuse(requests, receipts, metadata, listing).collect()} == {"a": True, "b": False, "c": False, "d": False}
    a, b = (spark.createDataFrame([(1, x, None)], "k int, m string, s string") for x in "xy")
    assert governance.lineage_differs(a, b, "k", ["m", "s"]).first().fields == ["m"]
    pointers = spark.createDataFrame([("t", "m1")], "task string, model_id string")
    with pytest.raises(Exception, match="not registered"):
        governance.deployed(pointers, pointers.limit(0), ["task"]).collect()


def test_readiness_of_all(spark):
    row = (10, 8, 1, 0, 0, "grapheme", True, False, 30)
    schema = "language string, accepted_rows long, train_rows long, validation_rows long, leaking_speakers long, outside_reviewed long, frontend string, tokenizer_reviewed boolean, g2p_reviewed boolean, reviewed_graphemes int"
    fine = governance.blockers_by_language(spark.createDataFrame([("a", *row)], schema))
    assert tuple(governance.readiness_status(fine).first()) == (True, 0)
    both = governance.blockers_by_language(spark.createDataFrame([("a", *row), ("b", 10, 8, 0, 1, 2, "phoneme", True, False, 30)], schema))
    assert both.filter("language = 'b'").first().codes == ["speaker_leakage", "g2p_unreviewed", "no_internal_validation", "observed_outside_reviewed_inventory"]
    assert tuple(governance.readiness_status(both).first()) == (False, 1)


def test_characters_are_described(spark):
    got = quality.described(spark.createDataFrame([("ɛ",), ("\u00a0",), ("\x07",)], "char string")).collect()
    assert [(r.codepoint, r.name, r.category, r.is_whitespace) for r in got] == [("U+025B", "LATIN SMALL LETTER OPEN E", "Ll", False), ("U+00A0", "NO-BREAK SPACE", "Zs", True), ("U+0007", "UNNAMED", "Cc", False)]


def test_normalizers_by_name(spark):
    df = spark.createDataFrame([("a ☃ b !", "tw"), ("a ☃ b !", "xx"), ("a  ☃ b !", "raw")], "t string, n string")
    names = {"tw": "orthography", "raw": "transcript"}
    assert [r[0] for r in df.select(T.normalized(F.col("t"), F.col("n"), names)).collect()] == ["a b!", "a ☃ b!", "a ☃ b !"]
