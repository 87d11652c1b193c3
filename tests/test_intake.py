"""Acquisition with receipts, observed figures, pointer histories over ranges."""

import random

import pytest
from pyspark.sql import functions as F

from sillon.operators import acquisition, compiler, governance, metrics, routing
from sillon.sources import config

SOURCE = {"languages": ["aa"], "tasks": ["asr"], "usage": "production", "provider": "landing"}
ROWS = "rn long, sha256 string, duration double, fine boolean, text string"


def rows(spark, n=40):
    return spark.createDataFrame([(i, f"d{i % 23}", 1.5 + i, i % 7 != 3, f"t{i}") for i in range(n)] + [(n, None, 1.0, True, "x"), (n + 1, "z", None, None, None)], ROWS)


def request(source="s", **kw):
    return acquisition.Request(source, "aa", "asr", "train", "f" * 40, **kw)


def plain(receipts):
    return sorted((r["source_id"], r["imported"], r["skipped"], r["hours"], r["metadata_sha256"]) for r in receipts)


def test_a_stopped_acquisition_goes_on(spark, tmp_path):
    catalog = {s: SOURCE for s in "abc"}
    requests = [request(s, requested_max_samples=9) for s in "abc"]
    whole = acquisition.acquire_all(spark, requests, catalog, lambda r: rows(spark), str(tmp_path / "whole"), {"landing"})
    read = []

    def failing(r):
        read.append(r.source_id)
        return rows(spark) if len(read) != 2 else rows(spark).withColumn("text", F.raise_error(F.lit("lost")))

    base = str(tmp_path / "parts")
    with pytest.raises(Exception, match="lost"):
        [acquisition.acquire(spark, r, failing(r), base) for r in requests]
    found = [acquisition.acquire(spark, r, failing(r), base) for r in requests]
    assert [r["reused"] for r in found] == [True, False, False]
    assert plain(found) == plain(whole) and plain(r.asDict() for r in acquisition.receipts(spark, base).collect()) == plain(whole)
    assert found[0]["imported"] == 9 and acquisition.metadata(spark, found[1]["folder"]).count() == 9


def test_receipts_stand_for_what_was_asked(spark, tmp_path):
    base = str(tmp_path)
    assert acquisition.receipts(spark, base).count() == 0
    first = acquisition.acquire(spark, request(), rows(spark), base)
    assert first["skipped"] > 0 and first["hours"] > 0 and not first["reused"]
    assert acquisition.acquire(spark, request(), rows(spark), base)["reused"]
    for other in (request(sample_rate=8000), request(requested_max_samples=3), acquisition.Request("s", "aa", "asr", "train", "e" * 40)):
        assert not acquisition.acquire(spark, other, rows(spark), base)["reused"]
    last = acquisition.acquire(spark, request(), rows(spark), base)
    spark.createDataFrame([(1, "d", 1.0, True, "new")], ROWS).drop("fine").withColumn("fine", F.lit(True)).write.mode("append").parquet(f"{last['folder']}/metadata")
    assert not acquisition.acquire(spark, request(), rows(spark), base)["reused"]  # its metadata was touched
    empty = acquisition.acquire(spark, request("none"), rows(spark).limit(0), base)
    assert (empty["imported"], empty["skipped"], empty["hours"]) == (0, 0, 0.0)


def test_guards_come_before_reading(spark, tmp_path):
    assert config.admissible(SOURCE, "aa", "asr", "train", {"landing"}, 1, 8000) == []
    assert config.admissible(SOURCE | {"provider": "hub"}, "aa", "asr", "train", {"landing"}, 0, 7999) == ["provider", "max_samples", "sample_rate"]
    with pytest.raises(ValueError, match="b: language"):
        acquisition.acquire_all(spark, [request("a"), request("b")], {"a": SOURCE, "b": SOURCE | {"languages": []}}, lambda r: 1 / 0, str(tmp_path), {"landing"})


def test_digest_of_rows_in_any_order(spark):
    df = rows(spark)
    same = acquisition.rows_digest(df)
    assert same == acquisition.rows_digest(df.repartition(7).select(*reversed(df.columns)))
    assert same != acquisition.rows_digest(df.unionByName(df.limit(1))) and same != acquisition.rows_digest(df.filter("rn <> 5"))


def test_observed_figures(spark, tmp_path):
    judged = spark.createDataFrame([(1, []), (2, ["a"]), (3, ["a", "b"])], "rn long, reasons array<string>")
    df, seen = metrics.observed(judged, "seen", metrics.outcome_figures())
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 3, "accepted": 1, "rejected": 2}
    times = spark.createDataFrame([(0.5,), (2.0,), (None,)], "seconds double")
    df, seen = metrics.observed(times, "times", metrics.timing_figures("seconds", [1.0, 5.0]))
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"count": 2, "sum": 2.5, "le_0": 1, "le_1": 2}
    for k in range(3):
        times.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    figures = metrics.Figures("stream")
    spark.streams.addListener(figures)
    stream = spark.readStream.schema("seconds double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).observe("stream", *metrics.timing_figures("seconds", [1.0]))
    stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    metrics.settled(figures, 3)
    spark.streams.removeListener(figures)
    assert figures.totals == {"count": 6, "sum": 7.5, "le_0": 3}
    with pytest.raises(TimeoutError):
        metrics.settled(figures, 4, 0.1)


def test_pointer_history_over_ranges(spark):
    rng = random.Random(4)
    events = [(rng.choice(["a"] * 9 + ["b", "c", None]), i, f"m{i}") for i in range(400)]
    rng.shuffle(events)
    got = {(r.task, r.at): (r.previous_model_id, r.latest) for r in governance.pointer_history(spark.createDataFrame(events, "task string, at long, model_id string"), ["task"], "model_id", ["at"]).collect()}
    expected = {}
    for task in {e[0] for e in events}:
        mine = sorted(e[1:] for e in events if e[0] == task)
        for k, (at, _) in enumerate(mine):
            expected[task, at] = (mine[k - 1][1] if k else None, k == len(mine) - 1)
    assert got == expected
    assert governance.pointer_history(spark.createDataFrame([], "task string, at long, model_id string"), ["task"], "model_id", ["at"]).collect() == []


def test_roll_backs(spark):
    events = spark.createDataFrame([("a", 1, "m1"), ("a", 2, "m2"), ("a", 3, "m1"), ("b", 1, "m9")], "task string, at long, model_id string")
    cards = spark.createDataFrame([("a", "m1", "x"), ("a", "m2", "y")], "task string, model_id string, artifact_path string")
    history = governance.pointer_history(events, ["task"], "model_id", ["at"])
    assert [(r.task, r.rolled_back, r.model_id, r.artifact_path) for r in governance.roll_backs(history, cards, ["task"]).collect()] == [("a", "m1", "m2", "y")]
    with pytest.raises(Exception, match="not registered: m2"):
        governance.roll_backs(history, cards.filter("model_id = 'm1'"), ["task"]).collect()


def test_repeated_numbers_are_judged_alike(spark):
    schema = "rn long, text string, speaker string, dialect string, source_id string, sha256 string, duration double, channels int, consent_attested boolean, transcript_reviewed boolean, governance_approved boolean, upstream_validated boolean, training_only boolean, has_audio boolean"
    row = lambda rn, sha: (rn, "t", "s", "d", "a:1", sha, 1.0, 1, True, True, False, False, False, True)
    got = compiler.judged(spark.createDataFrame([row(1, "x"), row(2, "x"), row(2, "x"), row(2, "y"), row(3, None), row(4, None)], schema)).collect()
    assert sorted((r.rn, r.sha256 or "", tuple(r.reasons)) for r in got) == [(1, "x", ()), (2, "x", ("duplicate_audio",)), (2, "x", ("duplicate_audio",)), (2, "y", ()), (3, "", ()), (4, "", ("duplicate_audio",))]


def test_routes(spark):
    registry = spark.createDataFrame([
        ("aa", "Aa", "custom", "m/aa", "local", None), ("bb", "Bb", "custom", " m/bb ", None, "b"), ("cc", "Cc", None, None, None, None), ("dd", "Dd", "shared", None, None, "d"), ("ee", "Ee", "custom", " ", None, None),
        ("ff", "Ff", "odd", None, None, None), ("gg", "Gg", "custom", "m/gg", "remote", "g"), ("hh", "Hh", "custom", "m/hh", "magic", None),
    ], routing.REGISTRY)
    asked = spark.createDataFrame([(None,), ("zz",), *[(f"{c}{c}",) for c in "abcdefgh"]], "language string")
    got = {r.language: (r.engine, r.hint, r.error) for r in routing.routed(asked, registry, spark.createDataFrame([("m/bb",), ("m/hh",)], "model string")).collect()}
    assert got == {
        None: ("shared", None, None), "zz": (None, None, "unknown language zz"), "aa": (None, None, "not deployed: m/aa"), "bb": ("m/bb", "b", None), "cc": ("shared", "cc", None), "dd": ("shared", "d", None),
        "ee": (None, None, "no model"), "ff": (None, None, "unknown mode odd"), "gg": ("m/gg", "g", None), "hh": (None, None, "unknown kind magic"),
    }
    assert routing.routed(asked, registry).filter("engine = 'm/aa'").count() == 1  # nothing is said about deployment
