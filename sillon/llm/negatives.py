"""Hard negatives for contrastive training, from all inner products of anchors and rows.

The product of the anchors' matrix and the rows' is worked out in two dimensions of blocks and one of dimension chunks:
rows are packed into shards of ``SHARD`` as they are read, each shard cut into chunks of ``WIDTH`` dimensions; blocks of
about ``ANCHORS`` anchors and shards meet, chunk by chunk, on a grid of tasks to which either side is copied along one
axis only; the partial int64 tiles of a block and a shard are shuffled together and added. A finished tile is reduced at
once: the best rows of the anchor's own label, and of the other labels only the cells that can lie in a window of any
positive that may still come (a tile that holds enough positives bounds the worst of them from below). The best positives
of all tiles then open the windows, each tile gives the best cells of each window, and these are ranked over the tiles.

All work follows from the number of anchors times rows; tasks hold one tile. Identical vectors, frequent labels and
repeated identifiers spread over shards like any other rows.

Cases: rows with a null id, label or vector or with a null or non-finite component take no part; each row is a row of
its own even where identifiers or vectors repeat (an anchor's copy may be its positive); vectors of unequal length are
compared in the dimensions that both have; ties go to the lesser identifier; anchors without positives, positives
without negatives and empty tables give no rows; vectors whose squared length (in whole units) is 2**60 or more would
leave 64 bits and are refused with an error.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, map_batches, materialize

#: Rows of a shard, anchors of a block (about), dimensions of a chunk, blocks or shards a side of a grid cell.
SHARD, ANCHORS, WIDTH, GRID = 2048, 256, 32, 4
#: Positives of an anchor, negatives of a positive.
POSITIVES, NEGATIVES = 5, 5
#: A negative's score is at least this share (numerator, denominator) of the positive's, and at most the positive's.
LOW, HIGH = 4, 5
#: Anchors up to which their windows (some 200 bytes each) are broadcast.
WINDOW_ANCHORS = 100_000

_SHARDS = "shard long, chunk int, n int, n_anchors int, ids binary, labels binary, anchors binary, cells binary"
_PARTIALS = "block long, shard long, chunk int, anchors binary, anchor_ids binary, anchor_labels binary, ids binary, labels binary, tile binary"
_TILES = "block long, best array<struct<anchor: long, anchor_id: long, score: long, id: long, row: long>>, anchors binary, scores binary, ids binary, rows binary"
_FOUND = "anchor long, anchor_id long, positive_id long, positive_row long, positive_score long, negative_id long, negative_row long, negative_score long"


def _longs(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.int64)


def _shard_rows(shard: int, ids: list[np.ndarray], labels: list[np.ndarray], anchors: list[np.ndarray], vectors: list[np.ndarray]) -> dict[str, list]:
    """The rows of a shard, one for each chunk of its longest vector and one at least; shorter vectors end in zeros."""
    n = len(vectors)
    chunks = max(1, -(-max(map(len, vectors)) // WIDTH))
    cells = np.zeros((n, chunks * WIDTH), dtype=np.int64)
    for i, v in enumerate(vectors):
        cells[i, : len(v)] = v
    marks = np.concatenate(anchors)
    common = {"n": n, "n_anchors": int(marks.sum()), "ids": np.concatenate(ids).tobytes(), "labels": np.concatenate(labels).tobytes(), "anchors": marks.tobytes(), "shard": shard}
    return {c: [v] * chunks for c, v in common.items()} | {"chunk": list(range(chunks)), "cells": [np.ascontiguousarray(cells[:, c * WIDTH : (c + 1) * WIDTH]).tobytes() for c in range(chunks)]}


def shards(rows: DataFrame, scale: int, size: int = SHARD) -> DataFrame:
    """Rows (id, label, vector, anchor) packed where they are read; components become floor(scale * x)."""
    bounded_batches(rows.sparkSession)
    names = [x.split()[0] for x in _SHARDS.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], []]
        number = TaskContext.get().partitionId() << 24  # a shard's number is its task's and its place in the task

        def packed() -> pa.RecordBatch:
            columns = _shard_rows(number, *held)
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(columns[c], type=t) for c, t in zip(names, types, strict=True)], names=names)

        for batch in batches:
            lists = batch.column("vector")
            flat = lists.flatten()
            bad = np.asarray(flat.is_null())
            values = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
            bad |= ~np.isfinite(values)
            sizes = np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(len(lists)), sizes)
            ends = np.concatenate(([0], np.cumsum(sizes)))
            whole = np.floor(np.where(bad, 0.0, values) * scale)
            takes = ~np.isin(np.arange(len(lists)), owner[bad])
            with np.errstate(over="ignore"):
                lengths = np.bincount(owner, weights=whole * whole, minlength=len(lists))
            if (lengths[takes] >= 2.0**60).any():
                raise ValueError("a vector is so long that its scores would leave 64 bits")
            whole = np.where(np.abs(whole) < 2.0**62, whole, 0.0).astype(np.int64)
            ids, labels, anchors = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False), dtype=t) for c, t in (("id", np.int64), ("label", np.int64), ("anchor", bool)))
            for i in np.flatnonzero(takes):
                for to, x in zip(held, (ids[i : i + 1], labels[i : i + 1], anchors[i : i + 1], whole[ends[i] : ends[i + 1]]), strict=True):
                    to.append(x)
                if len(held[3]) == size:
                    yield packed()
                    number += 1
                    held = [[], [], [], []]
        if held[3]:
            yield packed()

    return rows.mapInArrow(run, _SHARDS)


def _anchor_rows(packed: DataFrame, size: int) -> DataFrame:
    """Each anchor's chunks: anchor (number of the row), chunk, id, label, cells."""

    def run(batch):
        out: dict[str, list] = {"anchor": [], "chunk": [], "id": [], "label": [], "cells": []}
        for row in batch.to_pylist():
            places = np.flatnonzero(np.frombuffer(row["anchors"], dtype=bool))
            cells = _longs(row["cells"]).reshape(-1, WIDTH)
            out["anchor"] += (row["shard"] * size + places).tolist()
            out["chunk"] += [row["chunk"]] * len(places)
            out["id"] += _longs(row["ids"])[places].tolist()
            out["label"] += _longs(row["labels"])[places].tolist()
            out["cells"] += [cells[i].tobytes() for i in places]
        return out

    return map_batches(packed.filter("n_anchors > 0").select("shard", "chunk", "ids", "labels", "anchors", "cells"), run, "anchor long, chunk int, id long, label long, cells binary")


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two int64 matrices whose products fit into 64 bits."""
    longest = [float((x.astype(float) ** 2).sum(axis=1).max(initial=0.0)) ** 0.5 for x in (a, b)]
    if longest[0] * longest[1] < 2.0**52:  # no partial sum is greater, so doubles are exact
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def partial_tiles(blocks: DataFrame, packed: DataFrame, n_blocks: int, n_shards: int) -> DataFrame:
    """A tile of scores for each block, shard and chunk."""
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    down, across = -(-n_blocks // GRID), -(-n_shards // GRID)
    keys = ["chunk", "down", "across"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = blocks.withColumn("down", F.pmod("block", F.lit(down)).cast("int")).withColumn("across", every(across))
    b = packed.select("shard", "chunk", "ids", "labels", F.col("cells").alias("right")).withColumn("across", F.pmod(F.xxhash64("shard"), F.lit(across)).cast("int")).withColumn("down", every(down))
    met = a.repartition(tasks, *keys).join(b.repartition(tasks, *keys), keys).select("block", "shard", "chunk", "members", "ids", "labels", "right")
    names = [x.split()[0] for x in _PARTIALS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 6]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                members = row["members"].values
                left = np.frombuffer(b"".join(members.field("cells").to_pylist()), dtype=np.int64).reshape(-1, WIDTH)
                right = _longs(row["right"].as_py()).reshape(-1, WIDTH)
                own = [members.field(c).to_numpy(zero_copy_only=False).astype(np.int64).tobytes() for c in ("anchor", "id", "label")]
                values = [row["block"].as_py(), row["shard"].as_py(), row["chunk"].as_py(), *own, row["ids"].as_py(), row["labels"].as_py(), product(left, right).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(values, types, strict=True)], names=names)

    return met.mapInArrow(run, _PARTIALS)


def reduce_tile(first: int, anchors: np.ndarray, anchor_ids: np.ndarray, anchor_labels: np.ndarray, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> tuple[list[dict], np.ndarray, np.ndarray]:
    """The best rows of each anchor's own label, and the places (anchor, row) of cells that a window may hold."""
    rows = first + np.arange(len(ids))
    best: list[dict] = []
    held = np.zeros(scores.shape, dtype=bool)
    for i, (anchor, label) in enumerate(zip(anchors.tolist(), anchor_labels.tolist(), strict=True)):
        own = np.flatnonzero((labels == label) & (rows != anchor))
        line = scores[i]
        if len(own) > POSITIVES:
            least = np.partition(line[own], len(own) - POSITIVES)[len(own) - POSITIVES]
            own = own[line[own] >= least]
        own = own[np.lexsort((rows[own], ids[own], -line[own]))][:POSITIVES]
        best += [{"anchor": anchor, "anchor_id": int(anchor_ids[i]), "score": int(line[j]), "id": int(ids[j]), "row": int(rows[j])} for j in own]
        # windows of negative scores are empty, and the worst positive of all tiles is no worse than the worst of these
        bound = max(0, int(line[own[-1]])) if len(own) == POSITIVES else 0
        held[i] = (labels != label) & (HIGH * line >= LOW * bound)
    at, of = np.nonzero(held)
    return best, at, of


def tiles(partial: DataFrame, size: int = SHARD) -> DataFrame:
    """Added tiles, reduced: best positives, and the cells that may be negatives."""
    names = [x.split()[0] for x in ("block", "best", "anchors", "scores", "ids", "rows")]
    best_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("anchor", "anchor_id", "score", "id", "row")]))

    def run(table: pa.Table) -> pa.Table:
        parts = sorted(({c: table.column(c)[i] for c in table.column_names} for i in range(table.num_rows)), key=lambda r: r["chunk"].as_py())
        first = {c: parts[0][c].as_py() for c in parts[0] if c != "tile"}
        anchors, anchor_ids, anchor_labels, ids, labels = (_longs(first[c]) for c in ("anchors", "anchor_ids", "anchor_labels", "ids", "labels"))
        place = {a: i for i, a in enumerate(anchors.tolist())}
        total = np.zeros((len(anchors), len(ids)), dtype=np.int64)
        for part in parts:  # not every anchor has all chunks
            mine = np.array([place[a] for a in _longs(part["anchors"].as_py()).tolist()], dtype=np.int64)
            total[mine] += _longs(part["tile"].as_py()).reshape(len(mine), len(ids))
        number = first["shard"] * size
        best, at, of = reduce_tile(number, anchors, anchor_ids, anchor_labels, ids, labels, total)
        values = [first["block"], best, anchors[at].tobytes(), total[at, of].tobytes(), ids[of].tobytes(), (number + of).astype(np.int64).tobytes()]
        return pa.table([pa.array([v], type=t) for v, t in zip(values, [pa.int64(), best_type, *[pa.binary()] * 4], strict=True)], names=names)

    return partial.groupBy("block", "shard").applyInArrow(run, _TILES)


def window_cells(windows: list[dict], anchors: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> list[tuple]:
    """The first cells of each window: for every positive, the best scores between its share and its own."""
    order = np.lexsort((rows, ids, -scores, anchors))
    anchors, scores, ids, rows = anchors[order], scores[order], ids[order], rows[order]
    out = []
    for w in windows:
        a, b = np.searchsorted(anchors, w["anchor"]), np.searchsorted(anchors, w["anchor"], side="right")
        i = a + int(np.searchsorted(-scores[a:b], -w["score"]))
        for j in range(i, min(b, i + NEGATIVES)):
            if LOW * w["score"] > HIGH * int(scores[j]):
                break
            out.append((w["anchor"], w["anchor_id"], w["id"], w["row"], w["score"], int(ids[j]), int(rows[j]), int(scores[j])))
    return out


def mine(embeddings: DataFrame, anchor: Column, vector: str = "embedding", label: str | Column = "label", key: str = "vec_id", scale: int = 256, size: int = SHARD) -> DataFrame:
    """Columns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` says which rows are anchors. Positives of an anchor are the ``POSITIVES`` best other rows of its label; a
    positive's negatives the ``NEGATIVES`` best rows of other labels in its window, from 4/5 of its score to its score.
    ``size`` is the number of rows of a shard.
    """
    labelled = F.col(label) if isinstance(label, str) else label
    rows = embeddings.select(F.col(key).cast("long").alias("id"), labelled.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    packed = materialize(shards(rows.filter("id is not null and label is not null and vector is not null"), scale, size), "shards")
    counts = packed.filter("chunk = 0").agg(F.count(F.lit(1)).alias("shards"), F.coalesce(F.sum("n_anchors"), F.lit(0)).alias("anchors")).first()
    n_blocks = max(1, -(-counts.anchors // ANCHORS))
    members = F.sort_array(F.collect_list(F.struct("anchor", "id", "label", "cells"))).alias("members")
    blocks = _anchor_rows(packed, size).withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(n_blocks))).groupBy("block", "chunk").agg(members)
    reduced = materialize(tiles(partial_tiles(blocks, packed, n_blocks, max(1, counts.shards)), size), "tiles")

    def ranked(df: DataFrame, by: list[str], score: str, name: str, row: str, most: int) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc(score), name, row)
        return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)

    positives = ranked(reduced.select("block", F.explode("best").alias("x")).select("block", "x.*"), ["anchor"], "score", "id", "row", POSITIVES)
    windows = positives.groupBy("block").agg(F.collect_list(F.struct("anchor", "anchor_id", "score", "id", "row")).alias("windows"))
    cells = reduced.select("block", "anchors", "scores", "ids", "rows")
    met = cells.join(F.broadcast(windows) if counts.anchors <= WINDOW_ANCHORS else windows, "block").drop("block")

    def run(batch):
        found = [x for r in batch.to_pylist() for x in window_cells(r["windows"], *(_longs(r[c]) for c in ("anchors", "scores", "ids", "rows")))]
        return dict(zip((x.split()[0] for x in _FOUND.split(", ")), zip(*found, strict=True) if found else [[]] * 8, strict=True))

    best = ranked(map_batches(met, run, _FOUND), ["anchor", "positive_row"], "negative_score", "negative_id", "negative_row", NEGATIVES)
    return best.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
