import hashlib
import json

import pytest

from sillon.operators import lineage
from sillon.sources import config, files

PROFILE = """
language: {code: aa, iso639_3: aaa, name: Aa, script: Latn, runtime_normalizer: generic, aliases: [Ay, AAA]}
corpus: {max_seconds: 12, required_metadata: [dialect]}
asr: {}
tts: {}
"""


def test_config(spark, tmp_path):
    c = tmp_path / "c.yaml"
    c.write_text("sources:\n  s: {provider: hub, languages: [aa], tasks: [asr], usage: evaluation, license: x}\n")
    assert config.catalog(spark, str(c)).first().usage == "evaluation"
    (row,) = config.catalog_rows(str(c))
    assert config.admissible(row, "aa", "asr", "eval") == [] and config.admissible(row, "bb", "tts", "train") == ["language", "task", "not for production training"]
    c.write_text("sources:\n  s: {languages: [], tasks: [ocr], usage: odd}\n")
    with pytest.raises(ValueError, match="s: usage; s: languages; s: tasks"):
        config.catalog_rows(str(c))
    p = tmp_path / "p.yaml"
    p.write_text("languages:\n  aa: {asr: {train: [s2, s1], eval: []}}\n")
    assert [(r.position, r.source_id) for r in config.plan(spark, str(p)).orderBy("position").collect()] == [(0, "s2"), (1, "s1")]


def test_profiles(spark, tmp_path):
    (tmp_path / "a.yaml").write_text(PROFILE)
    found = config.profiles(str(tmp_path))
    policy = config.policy(found["aa"], min_seconds=1.0)
    assert (policy.min_seconds, policy.max_seconds, policy.required, policy.split_by_speaker) == (1.0, 12.0, frozenset({"dialect"}), True)
    rows = spark.createDataFrame([(" AY ",), ("zz",)], "language string")
    known = config.aliases(spark, found).unionByName(spark.createDataFrame([("strasse", "ss")], "alias string, code string"))
    assert [r.code for r in config.canonical(rows, known, needed=False).orderBy("language").collect()] == ["aa", None]
    assert config.canonical(spark.createDataFrame([("Stra\u00dfe",)], "language string"), known).first().code == "ss"
    with pytest.raises(Exception, match="unknown language"):
        config.canonical(rows, known).collect()
    (tmp_path / "b.yaml").write_text(PROFILE.replace("code: aa", "code: bb"))
    with pytest.raises(ValueError, match="several profiles have aaa, ay"):
        config.profiles(str(tmp_path))
    (tmp_path / "b.yaml").write_text(PROFILE.replace("asr: {}", "asr: {language_token_mode: explicit}"))
    with pytest.raises(ValueError, match="decoder_language"):
        config.profiles(str(tmp_path))


def test_tree_digest(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.bin").write_bytes(b"x")
    (tmp_path / "sub" / "é.bin").write_bytes(b"yy")
    (tmp_path / "model_card.json").write_text("{}")
    want = [{"path": p, "bytes": n, "sha256": hashlib.sha256(d).hexdigest()} for p, n, d in (("b.bin", 1, b"x"), ("sub/é.bin", 2, b"yy"))]
    digest, found = lineage.tree_digest(files.audio_files(spark, str(tmp_path)), str(tmp_path))
    assert found == want and digest == hashlib.sha256(json.dumps(want, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert lineage.model_id("aa", "asr", digest) == f"aa-asr-{digest[:12]}"


def test_pointers(tmp_path):
    p = lineage.Pointers(str(tmp_path))
    for m in "ab":
        p.register("asr", "aa", m, str(tmp_path), {})
        p.promote("asr", "aa", m, "production")
    assert p.roll_back("asr", "aa")["model_id"] == "a" and p.current("asr", "aa", "production")["previous_model_id"] == "b"
    with pytest.raises(FileExistsError):
        p.register("asr", "aa", "a", str(tmp_path), {})
    with pytest.raises(ValueError):
        p.promote("asr", "aa", "none", "production")


def test_receipts_and_phases(tmp_path):
    m = tmp_path / "m.csv"
    m.write_text("x")
    receipt = {"resolved_revision": "r", "sample_rate": 16000, "requested_max_samples": None, "metadata_sha256": lineage.file_digest(str(m))}
    assert lineage.reusable(receipt, str(m), "r", 16000, None) and not lineage.reusable(receipt, str(m), "q", 16000, None)
    m.write_text("y")
    assert not lineage.reusable(receipt, str(m), "r", 16000, None)
    ran = []

    def fail():
        raise RuntimeError("no")

    state = str(tmp_path / "s.json")
    with pytest.raises(RuntimeError):
        lineage.run_phases([("a", lambda: ran.append(1)), ("b", fail)], state)
    assert lineage.run_phases([("a", lambda: ran.append(1)), ("b", lambda: None)], state)["b"]["state"] == "done" and ran == [1]
