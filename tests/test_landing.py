"""The landing zone as a source of batches and streams, footers of shards, digests in ranges, bounded reads."""

import hashlib
import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sillon.operators import lineage
from sillon.sources import files, landing

FIELDS = {"id": "doc_id", "words": "text"}


def shard(folder, name, ids, **columns):
    folder.mkdir(parents=True, exist_ok=True)
    given = {"doc_id": pa.array(ids, type=pa.int32()), "text": [f"t{i}" for i in ids], "unused": [b"x" * 10] * len(ids)} | columns
    pq.write_table(pa.table({k: v for k, v in given.items() if v is not None}), folder / name)


def test_batches(spark, tmp_path):
    shard(tmp_path / "r1" / "sub", "b.parquet", [3, 4])
    shard(tmp_path / "r1", "a.parquet", [1, 2])
    shard(tmp_path / "r2", "a.parquet", [9])
    read = lambda **o: landing.zone(spark, str(tmp_path), "id long, words string", FIELDS, **o)
    assert sorted(map(tuple, read(revision="r1").collect())) == [(i, f"t{i}") for i in (1, 2, 3, 4)]
    assert read(revision="r1").rdd.getNumPartitions() == 2
    assert [r.id for r in read(revision="r2").collect()] == [9]
    assert [r.id for r in read(revision="r1", pattern="sub/*").orderBy("id").collect()] == [3, 4]
    with pytest.raises(Exception, match="no shard fits"):
        read(revision="r3").collect()
    shard(tmp_path / "r1", "c.parquet", [5], text=None)
    with pytest.raises(Exception, match=r"c.parquet: missing columns \['text'\]"):
        read(revision="r1").collect()


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    shard(tmp_path / "in" / "r1", "a.parquet", [1, 2])

    def run(revision="r1"):
        rows = landing.zone_stream(spark, str(tmp_path / "in"), "id long, words string", FIELDS, revision=revision)
        rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [1, 2]
    shard(tmp_path / "in" / "r1", "0.parquet", [3])  # its name comes first, its time later
    shard(tmp_path / "in" / "r1", "b.parquet", [4, 5])
    assert run() == [1, 2, 3, 4, 5]
    assert run() == [1, 2, 3, 4, 5]
    shard(tmp_path / "in" / "r2", "a.parquet", [6])
    with pytest.raises(Exception, match="began at revision"):
        run("r2")


def test_a_shard_without_a_column_is_named(spark, tmp_path):
    for k in range(3):
        shard(tmp_path, f"s{k}.parquet", [k], text=None if k == 1 else ["x"])
    report = {r.shard.rsplit("/", 1)[1]: (r.n_rows, r.missing) for r in landing.shard_report(spark, str(tmp_path), ["doc_id", "text"]).collect()}
    assert report == {"s0.parquet": (1, []), "s1.parquet": (1, ["text"]), "s2.parquet": (1, [])}
    with pytest.raises(ValueError, match=r"s1.parquet: missing columns \['text'\]$"):
        files.projected_parquet(spark, f"{tmp_path}/*.parquet", FIELDS)
    assert files.projected_parquet(spark, f"{tmp_path}/s[02].parquet", FIELDS).count() == 2


def test_digests_in_ranges(spark, tmp_path):
    data = {"a.bin": b"", "z/é\"\\.bin": b"y", "b/big.bin": b"x" * (3 * files.RANGE_BYTES + 5), "b.bin": b"1", "model_card.json": b"{}", "b/😀\t": b"2"}
    for name, content in data.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    digests = files.file_digests(spark, str(tmp_path))
    assert {r.path.split(f"{tmp_path}/")[1]: (r.bytes, r.sha256) for r in digests.collect()} == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in data.items()}
    relative = digests.withColumn("path", F.expr(f"substring(path, locate('{tmp_path}/', path) + {len(str(tmp_path)) + 1})"))
    (got,) = lineage.tree_digests(relative.withColumn("tree", F.lit("m")), "tree").collect()
    want = [{"path": n, "bytes": len(data[n]), "sha256": hashlib.sha256(data[n]).hexdigest()} for n in sorted(data, key=lambda n: n.split("/")) if n != "model_card.json"]
    assert (got.tree, got.files) == ("m", 5)
    assert got.sha256 == hashlib.sha256(json.dumps(want, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_large_files_are_not_read(spark, tmp_path):
    for n in (0, 10, 11):
        (tmp_path / f"{n}.bin").write_bytes(b"x" * n)
    read = files.bounded_files(spark, str(tmp_path), 10)
    assert [len(r.content) for r in read.collect()] == [10]
    assert "LessThanOrEqual(length,10)" in read._jdf.queryExecution().toString()
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "10")  # a file above it would be an error if it were read
    try:
        assert [len(r.content) for r in files.bounded_files(spark, str(tmp_path), 10).collect()] == [10]
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_numbers_of_faulty_lines(spark, tmp_path):
    """Numbers hold when a file is read in many parts, and blank lines count."""
    texts = {"a.json": [json.dumps({"k": i, "t": "x" * (i % 50)}) for i in range(3000)], "b.json": ["", "{}", '{"k": 1}', "[1]", "null", " ", '{"k": 2, "t": "y"}', "{"]}
    for i in (0, 1, 777, 2999):
        texts["a.json"][i] = texts["a.json"][i][:-1]
    for name, lines in texts.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (before, "4k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            read = files.faulty_lines(spark, str(tmp_path), "k long, t string", ["k"])
            assert size == before or read.rdd.getNumPartitions() > 3
            got = sorted((r.file.rsplit("/", 1)[1], r.line) for r in read.collect())
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert got == [("a.json", n) for n in (1, 2, 778, 3000)] + [("b.json", n) for n in (2, 4, 5, 8)]


def test_large_shards_are_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "r1").mkdir()
    ids = list(range(2000))
    pq.write_table(pa.table({"doc_id": ids, "text": [f"text {i}" for i in ids]}), tmp_path / "r1" / "a.parquet", row_group_size=100)
    rows = landing.zone(spark, str(tmp_path), "id long, words string", FIELDS, revision="r1", split=4000)
    assert rows.rdd.getNumPartitions() > 3
    assert sorted(map(tuple, rows.collect())) == [(i, f"text {i}") for i in ids]
    assert 1 < rows.select(F.spark_partition_id().alias("p")).distinct().count()


@pytest.mark.parametrize("name", ["zone_rows", "zone_stream_rows", "shard_columns", "faulty_lines"])
def test_queries_write_shards_in_parallel(spark, tmp_path, monkeypatch, name):
    """No shard or text is written by one task alone."""
    from sillon.plans import intake

    rows = spark.range(0, 600, 1, 6).selectExpr("id AS doc_id", "concat('words ', id) AS text", "'en' AS lang")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    monkeypatch.setattr(intake, "folder", lambda _, what: f"{tmp_path}/{what}")
    try:
        got = intake.QUERIES[name](spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = list(tmp_path.glob("lines/part-*" if name == "faulty_lines" else "zone/*/shard-0/part-*"))
    assert len(parts) > 1
    if name == "shard_columns":
        assert sorted(map(tuple, got)) == [("shard-0", 200, ""), ("shard-1", 200, ""), ("shard-2", 200, "lang")]
    elif name == "faulty_lines":
        line, want = 0, []
        for i in range(600):
            line += 1 + (i % 7 == 0)
            want += [line] * (i % 13 == 0 or i % 17 == 0)
        assert sorted(r.line for r in got) == want
    else:
        assert sorted(r.id for r in got) == list(range(600))


def test_small_files_come_from_several_tasks(spark, tmp_path, monkeypatch):
    from sillon.sources import sinks

    monkeypatch.setattr(sinks, "FILES_PER_TASK", 10)
    rows = spark.createDataFrame([(i, None if i == 5 else f"é{i}") for i in range(60)], "i int, t string").coalesce(1)
    sinks.small_files(rows, F.concat(F.lit("d"), (F.col("i") % 3).cast("string"), F.lit("/f"), F.col("i").cast("string")), F.col("t"), f"file://{tmp_path}/out")
    found = {p.relative_to(tmp_path / "out").as_posix(): p.read_text(encoding="utf-8") for p in (tmp_path / "out").rglob("f*")}
    assert found == {f"d{i % 3}/f{i}": "\n" if i == 5 else f"é{i}\n" for i in range(60)}


def test_batches_of_streams_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    from sillon.plans import streams

    monkeypatch.setattr(streams, "folder", lambda _, what: f"{tmp_path}/{what}")
    monkeypatch.setattr(streams, "materialize", lambda df, what: df)
    got = streams._streamed(spark.range(0, 60, 1, 3), F.col("id") % 2, 2, lambda stream: stream)
    assert sorted(r.id for r in got.collect()) == list(range(60))
    assert len(list((tmp_path / "stream" / "in").glob("part-*"))) == 6
