import datetime
import hashlib
import io
import math
import random
import time
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from sillon.operators import compiler, governance, leakage, quality, review, signal, speech, turns

ROWS = "rn long, text string, speaker string, dialect string, source_id string, sha256 string, duration double, channels int, consent_attested boolean, transcript_reviewed boolean, governance_approved boolean, upstream_validated boolean, training_only boolean, has_audio boolean"


def row(rn, sha="x", **kw):
    base = {"rn": rn, "text": "t", "speaker": "s", "dialect": "d", "source_id": "a:1", "sha256": sha, "duration": 1.0, "channels": 1, "consent_attested": True, "transcript_reviewed": True, "governance_approved": False, "upstream_validated": False, "training_only": False, "has_audio": True}
    return tuple((base | kw).values())


def judged(spark, rows, policy=compiler.Policy()):
    return {r.rn: r.reasons for r in compiler.judged(spark.createDataFrame(rows, ROWS), policy).collect()}


def test_every_reason_in_order(spark):
    got = judged(spark, [
        row(1, has_audio=False, text=" ", speaker=None, consent_attested=False, transcript_reviewed=False, dialect="", source_id=None),
        row(2, "a", channels=2, duration=0.1), row(3, "b", duration=40.0), row(4, "c"), row(5, "c"), row(6, "c", duration=25.0), row(7, "d", duration=25.0), row(8, "d"),
    ])
    assert got[1] == ["missing_audio", "empty_text", "missing_speaker", "governance_not_approved", "transcript_not_validated", "missing_dialect", "missing_source_id"]
    assert got[2] == ["multichannel_audio", "too_short", "quality_flag"]
    assert got[3] == ["too_long", "quality_flag"]
    assert got[4] == [] and got[5] == ["duplicate_audio"] and got[6] == ["duplicate_audio", "too_long"]
    assert got[7] == ["too_long"] and got[8] == []  # a rejected row's digest isn't seen


def test_fixed_split_and_training_only(spark):
    rows = spark.createDataFrame([row(1, speaker=None, training_only=True)], ROWS)
    assert compiler.accepted(rows, compiler.Policy(fixed_split="test")).first().split == "test"
    assert compiler.accepted(rows).first().split == "train"


def test_fingerprint(spark):
    schema = "sha256 string, text string, speaker string, dialect string, source_id string, source_license string, source_revision string, training_only boolean, split string"
    data = [("b", "x", None, "d", "s:1", None, "r", True, "train"), ("a", "y\x01z", "p", None, "s:2", "l", None, False, "test"), ("a", "y", "p", None, "s:2", "l", None, False, "test")]
    want = hashlib.sha256()
    for r in sorted(tuple("" if v is None else ("training-only" if v else "split-eligible") if isinstance(v, bool) else v for v in d) for d in data):
        want.update("\x1f".join(r).encode() + b"\n")
    for n in (1, 5):
        df = spark.createDataFrame(data, schema).repartition(n)
        assert compiler.fingerprint(df).first().fingerprint == want.hexdigest() == compiler.fingerprint_of_large(df)


def test_fingerprint_in_parts(spark, monkeypatch):
    """A large manifest goes through tasks that hand on the digest's state, not through the driver."""
    schema = "sha256 string, text string, speaker string, dialect string, source_id string, source_license string, source_revision string, training_only boolean, split string"
    df = spark.range(500).selectExpr("sha2(string(id % 400), 256) AS sha256", "repeat(string(id), int(id % 90)) || 'é' AS text", "CAST(NULL AS string) AS speaker", "'d' AS dialect", "string(id % 3) AS source_id", "'l' AS source_license", "'r' AS source_revision", "id % 2 = 0 AS training_only", "'train' AS split")
    want = hashlib.sha256()
    for r in sorted([r.sha256, r.text, "", "d", r.source_id, "l", "r", "training-only" if r.training_only else "split-eligible", "train"] for r in df.collect()):
        want.update("\x1f".join(r).encode() + b"\n")
    monkeypatch.setattr(compiler, "FINGERPRINT_CHARS", 100)
    monkeypatch.setattr(compiler, "PART_CHARS", 20_000)
    monkeypatch.setattr(type(df), "toLocalIterator", lambda *a, **k: pytest.fail("rows go through the driver"))
    got = compiler.fingerprint(df.repartition(7)).first()
    assert (got.fingerprint, got.n) == (want.hexdigest(), 500)
    assert compiler.fingerprint_of_large(spark.createDataFrame([], schema)) == hashlib.sha256().hexdigest()


def test_quality(spark):
    df = spark.createDataFrame([("s", "train", "d", 150, 150), ("s", "test", "d", 300, 150), ("t", None, None, 150, 150)], "speaker string, split string, dialect string, frames long, rate int")
    assert {r.split: (r.rows, r.hours) for r in quality.by_split(df).collect()} == {"train": (1, 1 / 3600), "test": (1, 2 / 3600), "unknown": (1, 1 / 3600)}
    assert [r.speaker for r in quality.speaker_leakage(df).collect()] == ["s"]
    assert quality.overall(df.limit(0)).first().accepted == 0


def test_leakage(spark):
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    a = spark.createDataFrame([(digest("x").upper(), "s1"), (digest("x"), "s2"), (digest("y"), "s3")], "sha256 string, source_id string")
    b = spark.createDataFrame([(digest("x"), "e1"), (digest("z"), None)], "sha256 string, source_id string")
    (r,) = leakage.overlap(a, b).collect()
    assert (r.sha256, r.train_sources, r.eval_sources, r.train_rows, r.eval_rows) == (digest("x"), ["s1", "s2"], ["e1"], 2, 1)
    t = leakage.totals(a, b).first()
    assert (t.training_rows, t.evaluation_rows, t.overlap_count, t.passed) == (3, 2, 1, False)
    with pytest.raises(RuntimeError):
        leakage.assert_none(a, b)
    leakage.assert_none(a, b.limit(0))
    with pytest.raises(Exception, match="invalid sha256"):
        leakage.digests(spark.createDataFrame([("short", "s")], "sha256 string, source_id string")).collect()


def test_speech(spark):
    u = spark.createDataFrame([("hello world", "hello there", "a", ""), ("", "x", None, "q"), ("Straße", "STRASSE", "a", "q")], "reference string, hypothesis string, speaker string, noise string")
    g = speech.error_rates(speech.counted(u)).first()
    assert (g.word_errors, g.reference_words, g.utterances) == (2, 3, 3)
    got = {(r.attribute, r.value): r.wer for r in speech.slices(speech.counted(u), ("speaker", "noise")).collect()}
    assert got[("speaker", "unknown")] is None and got[("speaker", "a")] == 1 / 3 and ("noise", "unknown") in got
    rows = spark.createDataFrame([(0.5, 2.0), (0.5, 2.0), (-1.0, 0.0)], "latency_seconds double, audio_seconds double")
    assert speech.real_time_factor(rows).first().rtf == 0.25
    p = speech.latency(rows).first()
    assert (p.p50, p.p95) == (0.5, 0.5)


def test_percentiles_of_large_groups(spark, monkeypatch):
    rng = np.random.RandomState(3)
    parts = {"a": rng.randn(30_000), "b": np.repeat(rng.randint(0, 5, 200), 100).astype(float), "c": rng.rand(7), "d": np.arange(25_000.0)}
    df = spark.createDataFrame([(k, float(x)) for k, v in parts.items() for x in v] + [("a", None), ("e", None)], "k string, x double")
    monkeypatch.setattr(speech, "DIRECT_ROWS", 10_000)
    got = {r.k: r for r in speech.latency(df, ["k"], "x").collect()}
    for k, v in parts.items():
        assert (got[k].p50, got[k].p95) == (pytest.approx(np.percentile(v, 50), abs=2e-6), pytest.approx(np.percentile(v, 95), abs=2e-6))
    assert got["e"].p50 is None and got["a"].n == 30_001


def test_listening(spark):
    schema = "model_id string, naturalness double, pronunciation double, intelligibility double, speaker_similarity double"
    df = spark.createDataFrame([("m", 4.0, 5.0, 3.0, 1.0), ("m", 5.0, 5.0, 4.0, 2.0), (" ", 9.0, 9.0, 9.0, 9.0)], schema)
    (r,) = speech.listening_scores(df).collect()
    assert (r.model_id, r.ratings, r.naturalness, r.speaker_similarity) == ("m", 2, 4.5, 1.5)
    with pytest.raises(Exception, match="between 1 and 5"):
        speech.listening_scores(spark.createDataFrame([("m", 5.5, 5.0, 3.0, 1.0)], schema)).collect()


def test_unreadable_and_bad_sounds(spark):
    rows = [(*row(1, "a"), 0.1, 0.0, 0.0, None), (*row(2, "b"), 0.0, 0.0, 0.0, None), (*row(3, "c"), 0.1, 0.01, 0.0, None), (*row(4, "d"), 0.1, 0.0, -0.06, None), (*row(5, "a", duration=None, channels=None), None, None, None, "cut file"), (*row(6, "a"), 0.1, 0.0, 0.0, None)]
    df = spark.createDataFrame(rows, ROWS + ", rms double, clipped double, offset double, audio_error string")
    assert {r.rn: r.reasons for r in compiler.judged(df).collect()} == {1: [], 2: ["quality_flag"], 3: ["quality_flag"], 4: ["quality_flag"], 5: ["audio_error:cut file"], 6: ["duplicate_audio"]}


def test_providers_values_stay_as_they_are(spark):
    rows = spark.createDataFrame([(" a  b.wav ", "x   y ", "  s  p ", " ", None)], "audio string, text string, speaker string, id string, dialect string")
    r = governance.adapt(rows, "p", ["audio"], ["text"], ["id"], ["speaker"], True, "dialect").first()
    assert tuple(r) == (" a  b.wav ", "x   y ", "  s  p ", None, "p: ", False)
    assert governance.adapt(rows, "p", ["audio"], ["text"], ["id"], ["speaker"], False, "dialect").first().speaker == "s  p"


def test_governance(spark):
    uses = spark.createDataFrame([("production", "research"), ("research", "production")], "a string, b string")
    assert [r.x for r in uses.select(governance.allows(F.col("a"), F.col("b")).alias("x")).collect()] == [True, False]
    rows = spark.createDataFrame([("p.wav", "", "hi", None)], "path string, audio string, sentence string, client_id string")
    r = governance.adapt(rows, "c", ["audio", "path"], ["sentence", "text"], ["id", "path"], ["client_id"]).first()
    assert (r.audio, r.text, r.speaker, r.source_id, r.training_only) == ("p.wav", "hi", None, "c:p.wav", True)
    with pytest.raises(Exception, match="is given"):
        governance.adapt(rows, "c", ["audio"], ["sentence"], ["id"]).collect()


def test_capped(spark):
    data = [("s", i, f"d{i % 4}", i != 2) for i in range(10)] + [("t", 0, "d0", True)]
    got = governance.capped(spark.createDataFrame(data, "s string, i int, d string, f boolean"), "s", "i", "d", F.col("f"), 3).collect()
    assert sorted((r.s, r.i, r.outcome) for r in got) == [("s", 0, "imported"), ("s", 1, "imported"), ("s", 2, "skipped"), ("s", 3, "imported"), ("t", 0, "imported")]


def test_pointers(spark):
    df = spark.createDataFrame([("k", "a", 1), ("k", "b", 2), ("k", "a", 3)], "k string, m string, t int")
    assert sorted((r.t, r.previous_model_id, r.latest) for r in governance.pointer_history(df, ["k"], "m", ["t"]).collect()) == [(1, None, False), (2, "a", False), (3, "b", True)]
    assert governance.latest_pointers(df, ["k"], "m", ["t"]).first().m == "a"
    paths = spark.createDataFrame([("o/checkpoint-9",), ("o/checkpoint-10",), ("o/checkpoint-x",)], "path string")
    assert governance.latest_checkpoint(paths).first().path == "o/checkpoint-10"


def runs(*lengths):
    """Frames of one sample at 50 a second: voiced, silent, voiced and so on."""
    return np.concatenate([np.full(n, 0.3 * (k % 2 == 0), np.float32) for k, n in enumerate(lengths)])


@pytest.mark.parametrize(
    ("lengths", "want"),
    [
        ((0, 100), []),
        ((0, 40, 60, 100), [(40, 100)]),
        ((30, 200), [(0, 30)]),
        ((29, 200), []),  # too short
        ((40, 21, 40, 200), [(0, 101)]),  # silence too short to end it
        ((40, 22, 40, 200), [(0, 40), (62, 102)]),
        ((0, 300, 20, 5), []),  # runs to the end, but is too short
        ((0, 300, 40, 5), [(300, 345)]),  # the end of the recording ends it, silence and all
        ((0, 900, 1500, 900), [(900, 1900), (1900, 2400)]),  # cut for length
        ((0, 900, 1010, 900), [(900, 1900)]),  # what a cut leaves is too short
        ((0, 900, 990, 10, 40, 900), [(900, 1900), (1900, 1940)]),  # cut in the middle of a silence
    ],
)
def test_regions_by_hand(lengths, want):
    assert signal.regions(runs(*lengths), 50) == want


def test_regions_hold_their_rules():
    rng = np.random.RandomState(0)
    quiet, most, least = 22, 1000, 30
    for _ in range(200):
        s = runs(0, *(rng.randint(1, rng.choice([30, 300, 1500])) for _ in range(rng.randint(2, 30))), rng.randint(1, 3000))
        voiced = np.flatnonzero(s)
        found = signal.regions(s, 50)
        if not len(voiced) or len(voiced) > 0.75 * len(s):  # the threshold rises with the floor
            continue
        ends = [0, *(b for _, b in found)]
        assert all(a >= e and s[a] and b - a <= most for (a, b), e in zip(found, ends, strict=False))
        for a, b in found:
            inside = np.concatenate((voiced[(voiced >= a) & (voiced < b)], [b] if b - a == most or b == len(s) else []))
            assert b - a == most or b == len(s) or s[b - 1]
            assert b - a >= least and (np.diff(inside) <= quiet + (b in inside)).all()
        left = np.setdiff1d(voiced, np.concatenate([np.arange(a, b) for a, b in found] or [np.zeros(0, int)]))
        for part in np.split(left, np.flatnonzero(np.diff(left) > quiet) + 1):
            assert not len(part) or part[-1] + 1 - part[0] < least or len(s) - part[0] < least
    assert signal.regions(np.zeros(16000, np.float32), 16000) == [] == signal.regions(np.zeros(0, np.float32), 16000)


def test_resampling():
    s = np.sin(np.arange(100) / 7).astype(np.float32)
    up = signal.resampled(s, 8000, 16000)
    assert np.allclose(up[::2], s) and np.allclose(up[1:-1:2], (s[:-1] + s[1:]) / 2, atol=1e-6) and up[-1] == s[-1]
    assert np.allclose(signal.resampled(s, 16000, 8000), s[::2])
    assert len(signal.resampled(s[:1], 16000, 8000)) == 1


def wav_file(samples, rate, channels=1, width=2):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def test_sound_files(spark):
    wide = (np.array([0, 2**30, -(2**31)], "<i4")).tobytes()
    files = {
        "a": wav_file(np.array([0, 16384, -32768, 0], "<i2").tobytes(), 8000, 2), "b": wav_file(bytes([128, 192, 0]), 8000, 1, 1), "c": wav_file(wide, 8000, 1, 4),
        "d": wav_file(b"".join(wide[i + 1 : i + 4] for i in range(0, 12, 4)), 8000, 1, 3), "e": b"", "f": b"no sound", "g": wav_file(bytes(2 * 8000), 8000),
    }
    df = spark.createDataFrame(list(files.items()), "path string, content binary")
    got = {r.path: r.d for r in df.select("path", signal.decoded("content").alias("d")).collect()}
    assert got["a"].samples == [0.0, 0.5, -1.0, 0.0] and got["a"].channels == 2 and all(got[k].samples == [0.0, 0.5, -1.0] for k in "bcd")
    assert got["e"].error == "audio is empty" and got["f"].error.startswith("audio can't be read")
    clips = {r.path: r for r in signal.normalized_clips(df, 16000, 0.9).collect()}
    assert clips["g"].error == "recording exceeds maximum duration of 0.9s" and clips["a"].seconds == 4 / 16000 and clips["a"].wav[:4] == b"RIFF"
    assert np.frombuffer(clips["a"].wav[44:], "<i2").tolist() == [8191, -4095, -16383, -16383]
    with pytest.raises(signal.SoundError):
        signal.leveled(np.array([1.0, np.nan]))
    assert signal.leveled(np.array([[0.5, -2.0]])).tolist() == [0.25, -1.0] and signal.leveled(np.array([0.5])).tolist() == [0.5]
    given = spark.createDataFrame([(bytearray(b"x"), None, None, None, None), (None, "p", None, None, bytearray(b"y")), (None, None, [0.5], 8000, None)], "bytes binary, path string, array array<double>, sampling_rate int, stored binary")
    load = signal.payload(F.struct("bytes", "path", "array", "sampling_rate"), F.col("stored"))
    assert [bytes(r[0])[:4] for r in given.select(load).collect()] == [b"x", b"y", b"RIFF"]


def test_column_forms_equal_the_helpers(spark):
    rows = [([0.1, -0.5, 0.25, 1.0, 0.0], 5), ([0.3], 7), ([], 5), ([float(i % 7) / 7 for i in range(31)], 11)]
    df = spark.createDataFrame(rows, "s array<float>, r int")
    for target in (3, 8, 11):
        got = [r.x for r in df.select(signal.resampled_column(F.col("s"), F.col("r"), target).alias("x")).collect()]
        assert all(np.allclose(g, signal.resampled(np.array(s, np.float32), r, target), atol=1e-6) for g, (s, r) in zip(got, rows, strict=True))
    two = df.select(signal.downmixed(F.col("s"), F.lit(2)).alias("x")).collect()
    assert all(np.allclose(r.x, signal.mono(np.array(s, np.float32), 2)) for r, (s, _) in zip(two, rows, strict=True))


def test_waveforms(spark):
    df = spark.createDataFrame([([0.1] * 160, 16), ([1.0, -1.0] * 80, 16), ([], 16)], "samples array<float>, rate int")
    a, b, c = signal.inspected(df).collect()
    assert abs(a.offset - 0.1) < 1e-6 and a.suspicious and b.clipped == 1.0 and b.peak == 1.0 and c.rms is None
    got = spark.createDataFrame([(bytes(200), 8000)], "pcm binary, rate int").select(signal.wav_of_pcm("pcm", "rate").alias("w")).first().w
    assert bytes(got[:4]) == b"RIFF" and len(got) == 244


def test_review(spark):
    events = [("i", 1, "draft", "asr", "d", ""), ("i", 2, "review_2", "bob", "t", ""), ("i", 3, "review_1", "ann", "one", ""), ("i", 4, "review_2", " ann", "two", ""), ("i", 5, "review_2", "bob", " two  x", ""), ("i", 6, "draft", "asr", "d", ""), ("i", 7, "approve", "cat", "", ""), ("i", 8, "reject", "cat", "", "why"), ("j", 1, "approve", "cat", "", ""), ("j", 2, "reject", "cat", "", "bad"), ("k", 1, "odd", None, None, None)]
    df = spark.createDataFrame(events, "item_id string, seq long, action string, actor string, text string, reason string").repartition(3)
    got = {(r.item_id, r.seq): r for r in review.audit(df).collect()}
    assert [got["i", s].accepted for s in range(1, 9)] == [True, False, True, False, True, False, True, False]
    assert got["i", 4].error == "same reviewer" and got["k", 1].error == "unknown action odd"
    last = {r.item_id: (r.state, r.text) for r in review.final_states(df).collect()}
    assert last == {"i": ("approved", "two x"), "j": ("rejected", None), "k": ("machine_draft", None)}


FRAMES = [("c", 1, "audio", None, 10), ("c", 2, "start", 16000, None), ("c", 3, "commit", None, None), ("c", 4, "start", 4000, None), ("c", 5, "start", None, None), ("c", 6, "audio", None, 32000), ("c", 7, "audio", None, 32000), ("c", 8, "commit", None, None), ("c", 9, "start", 16000, None), ("c", 10, "audio", None, 3200000), ("c", 11, "audio", None, 2), ("c", 12, "cancel", None, None), ("c", 13, "odd", None, None)]
OUTCOMES = ["error:no_turn", "started", "error:empty_turn", "error:sample_rate", "started", "buffered", "buffered", "committed", "started", "error:too_long", "error:no_turn", "cancelled", "error:unknown_frame"]


def test_turns(spark):
    df = spark.createDataFrame(FRAMES, "conn_id string, seq long, kind string, sample_rate int, n_bytes long").repartition(3)
    got = sorted(turns.turns(df).collect(), key=lambda r: r.seq)
    assert [r.outcome for r in got] == OUTCOMES
    assert (got[7].n_bytes, got[7].seconds) == (64000, 2.0)


def stream_of(spark, path, rows, schema, files, per_batch):
    """A stream of files that are written one after the other, in the order given."""
    for k in range(files):
        spark.createDataFrame(rows[k::files], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def collected(df, path):
    df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/out").collect()


FRAME = "conn_id string, seq long, kind string, sample_rate int, n_bytes long"


def test_turns_stream(spark, tmp_path):
    rows = FRAMES + [("other", *f[1:]) for f in FRAMES] + [FRAMES[4], FRAMES[5]]  # two frames are delivered twice
    random.Random(2).shuffle(rows)
    got = collected(turns.turns_stream(stream_of(spark, str(tmp_path / "in"), rows, FRAME, 6, 1)), tmp_path)
    for conn in ("c", "other"):
        assert [r.outcome for r in sorted(got, key=lambda r: r.seq) if r.conn_id == conn] == OUTCOMES


def test_idle_connections_are_forgotten(spark, tmp_path):
    rows = [("c", 1, "start", 16000, None), ("c", 2, "audio", None, 10), ("c", 4, "commit", None, None)]  # the third is lost
    frames = stream_of(spark, str(tmp_path / "in"), rows, FRAME, 1, 1)
    q = turns.turns_stream(frames, idle=200).writeStream.format("memory").queryName("idle_turns").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    until = time.time() + 60
    while spark.table("idle_turns").count() < 3 and time.time() < until:
        time.sleep(0.5)
    q.stop()
    assert [r.outcome for r in spark.table("idle_turns").orderBy("seq").collect()] == ["started", "buffered", "committed"]


def test_reviews_stream_from_where_a_batch_ends(spark, tmp_path):
    rng = random.Random(8)
    events = [(f"i{k}", n, rng.choice(["draft", "review_1", "review_2", "approve", "reject"]), rng.choice(["ann", "bob", "cat"]), f"text {n}", "why") for k in range(12) for n in range(1, 15)]
    schema = "item_id string, seq long, action string, actor string, text string, reason string"
    expected = sorted(map(tuple, review.audit(spark.createDataFrame(events, schema)).collect()))
    before, after = [e for e in events if e[1] <= 5], [e for e in events if e[1] > 5]
    begin = review.workflow_states(spark.createDataFrame(before, schema))
    assert {r.number for r in begin.collect()} == {6}
    rng.shuffle(after)
    got = collected(review.audit_stream(stream_of(spark, str(tmp_path / "in"), after, schema, 5, 2), begin=begin), tmp_path)
    assert sorted(map(tuple, [*review.audit(spark.createDataFrame(before, schema)).collect(), *got])) == expected


def quantile(values, share):
    ordered = sorted(values)
    at = (len(ordered) - 1) * share
    low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
    return low if at == math.floor(at) else low + (high - low) * (at - math.floor(at))


def test_percentiles_of_ties_and_large_groups(spark, monkeypatch):
    rng = random.Random(7)
    groups = {
        "ties": [5.0] * 3000 + [rng.random() for _ in range(40)] + [9.0] * 20,
        "edge": [1.0] * 500 + [2.0] * 500,
        "wide": [10 ** rng.uniform(-200, 200) for _ in range(4000)],
        "even": [float(i % 977) for i in range(5000)],
        "odd": [float("inf"), float("-inf"), -0.0, 0.0] + [rng.gauss(0, 1) for _ in range(2000)],
        "one": [4.0],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("none", None), ("one", None), (None, 3.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    shares = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = {r.g: r.p for r in speech.percentiles(df, ["g"], "x", shares).collect()}
    monkeypatch.setattr(speech, "DIRECT_ROWS", 10)
    narrowed = {r.g: r.p for r in speech.percentiles(df, ["g"], "x", shares).collect()}
    assert set(got) == set(narrowed) == {*groups, None}
    for g, vs in groups.items():
        expected = [quantile(vs, s) for s in shares]
        assert got[g] == pytest.approx(expected) and narrowed[g] == pytest.approx(expected)
    assert speech.percentiles(df.filter("g = 'nowhere'"), ["g"], "x", shares).collect() == []


def test_percentiles_of_a_million_equal_values(spark):
    df = spark.range(1_000_000).select(F.lit("a").alias("g"), F.when(F.col("id") < 10, F.col("id").cast("double")).otherwise(F.lit(7.5)).alias("x"))
    assert speech.percentiles(df, ["g"], "x", [0.0, 0.5, 0.95]).first().p == [0.0, 7.5, 7.5]


def test_null_digests_are_alike(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, None), (4, "a"), (5, "b"), (6, "b")], "seq long, sha256 string")
    assert {r.seq: r.repeats for r in compiler.first_wins(rows, "sha256", "seq").collect()} == {1: False, 2: False, 3: True, 4: True, 5: False, 6: True}
    stored = spark.createDataFrame([(9, "b")], "seq long, sha256 string")
    assert sorted(r.seq for r in review.admitted(rows, stored).collect()) == [1, 2]
    assert sorted(r.seq for r in review.admitted(rows, spark.createDataFrame([(9, None)], "seq long, sha256 string")).collect()) == [1, 5]


def test_sessions_and_late_rows(spark, tmp_path):
    """Runs are given once the watermark is past them; rows that come after that, by two batches here, are dropped, earlier ones join their run."""
    schema = "user string, ts timestamp"
    at = lambda minutes: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)
    batches = [[("a", at(0)), ("a", at(5)), ("b", at(3))], [("a", at(12)), ("a", at(200))], [("a", at(209))], [("a", at(9)), ("a", at(191)), ("b", at(4))], [(None, at(9000))]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = collected(signal.sessions(stream, "user", "ts", "10 minutes", "30 minutes"), tmp_path)
    assert sorted((r.user, r.start, r.end, r.n) for r in got if r.user) == [("a", at(0), at(12), 3), ("a", at(191), at(209), 3), ("b", at(3), at(3), 1)]
    whole = signal.sessions(spark.createDataFrame([r for b in batches[:4] for r in b], schema), "user", "ts", "10 minutes", "30 minutes")
    assert sorted((r.user, r.n) for r in whole.collect()) == [("a", 3), ("a", 4), ("b", 2)]


def test_segments_of_greatest_length(spark):
    rows = [(1, t) for t in (0, 4, 8, 12, 16, 40, 44)] + [(2, 7)]
    labels = signal.labelled(spark.createDataFrame(rows, "key long, at long"), 10, 12)
    got = sorted(tuple(r) for r in signal.measured(labels).select("key", "segment", "start", "end", "n").collect())
    assert got == [(1, 0, 0, 8, 3), (1, 1, 12, 16, 2), (1, 2, 40, 44, 2), (2, 0, 7, 7, 1)]
