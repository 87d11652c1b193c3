"""MinHash near-duplicates with HyperMinHash registers.

A document's set holds its distinct word shingles. Every shingle is offered to each of the buckets under the bucket's
own hash function, so that short texts leave none empty. A bucket keeps its least hash value in 16 bits: the number of
leading zeros and ten mantissa bits after the first one. Bands of registers lead to candidates; their similarity is
estimated from equal registers, less the share that would agree by chance at ten mantissa bits; candidates within
``MARGIN`` of the threshold are confirmed on full sets.

Documents with equal sets form one class, found by a digest, and are never paired. Every class is first compared with the
least class of all its band buckets; then, in each bucket that still holds several components, with the bucket's own, a star of as many pairs as members, never all pairs. Linked classes become
components; buckets that still hold several components get further stars around other members. Members that then remain
outside their bucket's main component are compared with its other members on full sets, block by block of about
``BLOCK_BYTES`` of shingle hashes (a longer text is a block of its own), and each block gives at most one link between a
member and a component. So a pair of classes
that shares a bucket is either compared or already connected, and what is handed on grows with members, not with pairs.

With 40 bands of 5 registers a pair at similarity 0.8 shares no bucket with probability (1 - 0.8**5)**40 = 1.3e-7.

Cases: texts without words (null, empty, white space) have empty sets and are linked with nothing; a text of fewer words
than a shingle is one shingle; rows are linked by their own texts, and classes with the same least doc_id count as one;
rows without a doc_id get their class's component, or null, and are kept only where that is null; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, dealt_join, fresh, hot_of, map_batches, materialize, packed, small_or_plain, texts_of
from .components import components

BANDS, ROWS = 40, 5
REGISTERS = BANDS * ROWS
MANTISSA_BITS = 10
#: Words of a shingle, where a caller asks for no other number.
SHINGLE = 5
THRESHOLD = 80
#: Candidates whose estimate is lower than the threshold by more than this (six standard deviations) are dropped.
MARGIN = 0.18
#: Further stars before what remains is compared block by block.
STARS = 3
#: A star that confirms fewer links than one for so many of its pairs is the last one.
STAR_PAIRS = 100
#: Pairs of texts, and bucket members with the place of their vector, that a task should compare at least.
TASK_PAIRS = 500
#: Bytes of shingle hashes of a bucket's members that are held together to be compared.
BLOCK_BYTES = 1 << 20
#: Cells of the table of members and shingles that are multiplied at once.
CELLS = 2 << 20
#: Rows up to which register rows (400 bytes each), and nodes with their components (16 bytes each), are broadcast.
SKETCH_ROWS, NODE_ROWS = 50_000, 500_000
#: Rows up to which buckets, and nodes that pairs ask for, are broadcast: the driver holds each such table for a while.
BUCKET_ROWS = 100_000
#: Bytes of text that are hashed together.
CHUNK_BYTES = 1 << 20
#: Shingles that meet the bucket hashes together; their values stay in the processor's cache.
CHUNK_SHINGLES = 1 << 15

_random = np.random.RandomState(20240229)
_BYTES = _random.randint(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_A = (_random.randint(0, 1 << 31, REGISTERS, dtype=np.int64) * 2 + 1).astype(np.uint32)
_B = _random.randint(0, 1 << 32, REGISTERS, dtype=np.int64).astype(np.uint32)
_P = np.uint64(0x9E3779B97F4A7C15)
#: The bytes that part words: \\x20 and \\x09-\\x0D.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = np.full(1, _P, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[bytes]:
    """Words as UTF-8; only A-Z are lower-cased and only ASCII white space parts them."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingles_of(text: str, size: int = SHINGLE) -> frozenset:
    """The set of a text: distinct runs of ``size`` words, or all words where they are fewer."""
    words = words_of(text)
    return frozenset(zip(*(words[i:] for i in range(size)))) if len(words) >= size else frozenset([tuple(words)] if words else [])  # noqa: B905


def linked(a: frozenset, b: frozenset, threshold: int = THRESHOLD) -> bool:
    common = len(a & b)
    return bool(common) and 100 * common >= threshold * (len(a) + len(b) - common)


def shingle_hashes(texts: list[str], size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    global _powers
    raw = [x.encode("utf-8", "surrogatepass").lower() for x in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    space = _SPACE[data]
    begins = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    if not len(begins):
        return [np.zeros(0, dtype=np.uint64)] * len(texts)
    ends = np.flatnonzero(space & np.concatenate(([True], ~space[:-1])))
    ends = ends[ends > begins[0]]
    lengths = ends - begins
    longest = int(lengths.max())
    if len(_powers) < longest:
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.full(2 * longest, _P, dtype=np.uint64))
    inside = np.flatnonzero(~space)
    weights = _powers[inside - np.repeat(begins, lengths)]
    firsts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    words = _mix(np.add.reduceat(_BYTES[data[inside]] * weights, firsts))
    # words of text i stand at of[i] .. of[i + 1]
    of = np.searchsorted(begins, np.concatenate(([0], np.cumsum([len(x) + 1 for x in raw]))))
    n = max(0, len(words) - size + 1)
    rolled = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        rolled = rolled * _P + words[i : i + n]
    rolled = _mix(rolled + np.uint64(size))
    out = []
    for a, b in zip(of[:-1].tolist(), of[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            short = np.zeros(1, dtype=np.uint64)
            for w in words[a:b]:
                short = short * _P + w
            out.append(_mix(short + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of registers for each nonempty set: leading zeros of the least value, then mantissa bits."""
    least = np.empty((len(sets), REGISTERS), dtype=np.uint32)
    at = 0
    while at < len(sets):
        to, n = at, 0
        while to < len(sets) and (not n or n + len(sets[to]) <= CHUNK_SHINGLES):
            n += len(sets[to])
            to += 1
        part = (np.concatenate(sets[at:to]) >> np.uint64(32)).astype(np.uint32)
        firsts = np.concatenate(([0], np.cumsum([len(s) for s in sets[at:to]])[:-1]))
        for i in range(REGISTERS):
            least[at:to, i] = np.minimum.reduceat(part * _A[i] + _B[i], firsts)
        at = to
    mantissa, exponent = np.frexp(least.astype(np.float64))
    zeros = np.where(least > 0, 32 - exponent, 33).astype(np.uint16)
    bits = np.where(least > 0, (mantissa * 2 - 1) * (1 << MANTISSA_BITS), 0).astype(np.uint16)
    return zeros << np.uint16(MANTISSA_BITS) | bits


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of register rows of sets of ``n`` and ``m`` shingles.

    Least values of disjoint sets fall into one register value with probability nm / (n + m)**2 times the mean width of
    a register value on the logarithmic scale, 2**-bits / (2 ln 2).
    """
    equal = (a == b).mean(axis=1)
    chance = n * m / (n + m) ** 2 / (1 << MANTISSA_BITS) / (2 * np.log(2))
    return np.maximum(0.0, (equal - chance) / (1 - chance))


def signatures(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """Columns doc_id, n_shingles, digest (of the set, null if empty) and registers (big-endian, null if empty)."""

    def run(batch):
        out = {"doc_id": batch.column("doc_id"), "n_shingles": [], "digest": [], "registers": []}
        texts = texts_of(batch, "x")
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (not size or size + len(texts[to]) <= CHUNK_BYTES):
                size += len(texts[to])
                to += 1
            sets = shingle_hashes(texts[at:to], shingle)
            rows = iter(registers([s for s in sets if len(s)]))
            for s in sets:
                out["n_shingles"].append(len(s))
                out["digest"].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                out["registers"].append(next(rows).astype(">u2").tobytes() if len(s) else None)
            at = to
        return out

    return map_batches(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("x")), run, "doc_id long, n_shingles long, digest binary, registers binary")


def _sizes(pairs: DataFrame, key: str) -> DataFrame:
    return pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def _near(pairs: DataFrame, sketches: DataFrame, threshold: int, few: bool) -> DataFrame:
    """The pairs (a, b) whose estimated similarity is near the threshold or above. ``few`` sketches are broadcast."""

    def run(batch):
        n, m = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n", "m"))
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=">u2").reshape(-1, REGISTERS) for c in ("x", "y"))
        keep = np.flatnonzero(estimate(x, y, n, m) >= threshold / 100 - MARGIN)
        return {c: batch.column(c).take(keep) for c in ("a", "b")}

    a = sketches.select(F.col("node").alias("a"), F.col("n").alias("n"), F.col("registers").alias("x"))
    b = sketches.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("registers").alias("y"))
    met = pairs.join(F.broadcast(a), "a").join(F.broadcast(b), "b") if few else dealt_join(pairs, a, "a", "b", hot_of(_sizes(pairs, "a"))).join(b, "b")
    sized = met.filter((100 * F.least("n", "m") >= threshold * F.greatest("n", "m")))
    return map_batches(sized.select("a", "b", "n", "m", "x", "y"), run, "a long, b long")


def _confirmed(pairs: DataFrame, n: int, texts: DataFrame, threshold: int, shingle: int) -> DataFrame:
    """The pairs (a, b), ``n`` of them, whose full sets are similar enough. Only the texts that they ask for are shuffled."""

    def run(batch):
        out: dict[str, list] = {"a": [], "b": []}
        last: tuple[str, frozenset] = ("", frozenset())
        for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "x", "y")), strict=True):
            if last[0] != x:
                last = (x, shingles_of(x, shingle))
            if linked(last[1], shingles_of(y, shingle), threshold):
                out["a"].append(a)
                out["b"].append(b)
        return out

    asked = packed(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), 2 * n)
    if 2 * n <= BUCKET_ROWS:
        asked = F.broadcast(asked)
    texts = materialize(texts.join(asked, "node", "left_semi"), "asked")
    a, b = texts.select(F.col("node").alias("a"), F.col("text").alias("x")), texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    hubs = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    met = dealt_join(packed(pairs.join(b, "b"), n, TASK_PAIRS), a, "a", "b", hot_of(packed(hubs, n)) if n > HOT_ROWS else None)
    return map_batches(packed(met.select("a", "b", "x", "y"), n, TASK_PAIRS), run, "a long, b long")


def _vectors(texts: DataFrame, shingle: int) -> DataFrame:
    """Columns node and vector (sorted shingle hashes as bytes)."""
    return map_batches(texts.select("node", "text"), lambda batch: {"node": batch.column("node"), "vector": [s.tobytes() for s in shingle_hashes(texts_of(batch), shingle)]}, "node long, vector binary")


def block_links(xs: list[dict], ys: list[dict], threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """Links between members (node, component, vector) of two blocks and of different components, one for each member of ``xs`` and component."""
    vectors = [np.frombuffer(m["vector"], dtype=np.uint64) for m in [*xs, *ys]]
    sizes = np.array([len(v) for v in vectors])
    _, column, count = np.unique(np.concatenate(vectors), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(vectors)), sizes)
    shared = count[column] > 1
    row, column = row[shared], column[shared]
    common = np.zeros((len(xs), len(ys)))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = max(1, CELLS // len(vectors))
    for first in range(0, len(count), width):
        a, b = np.searchsorted(column, (first, first + width))
        if a < b:
            _, dense = np.unique(column[a:b], return_inverse=True)
            part = np.zeros((len(vectors), int(dense.max()) + 1), dtype=np.float32)
            part[row[a:b], dense] = 1
            common += part[: len(xs)] @ part[len(xs) :].T
    union = sizes[: len(xs), None] + sizes[None, len(xs) :] - common
    apart = np.array([m["component"] for m in xs])[:, None] != np.array([m["component"] for m in ys])[None, :]
    out: dict[tuple[int, int], tuple[int, int]] = {}
    for i, j in zip(*np.nonzero(apart & (common > 0) & (100 * common >= threshold * union)), strict=True):
        out.setdefault((xs[i]["node"], ys[j]["component"]), (xs[i]["node"], ys[j]["node"]))
    return list(out.values())


def _rest(members: DataFrame, n: int, texts: DataFrame, threshold: int, shingle: int) -> DataFrame:
    """Links (a, b) among ``n`` bucket members (key, node, component) of different components; the main component's members aren't compared with each other."""
    among = small_or_plain(materialize(packed(members.select("node").distinct(), n), "nodes"))
    # written first, so that no task runs two Python workers
    vectors = materialize(_vectors(texts.join(among, "node", "left_semi"), shingle), "vectors")
    lengths = small_or_plain(materialize(vectors.select("node", F.length("vector").cast("long").alias("bytes")), "lengths"), NODE_ROWS)
    sized = materialize(packed(members.join(lengths, "node"), n), "sized")
    spread = packed(sized.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")), n)
    blocks = lambda size: F.greatest(F.lit(1), F.ceil(size / BLOCK_BYTES))
    by_key = spread.groupBy("key").agg(F.sum("bytes").alias("bytes"), F.max_by(F.struct("component", "bytes"), F.struct("n", "component")).alias("main"))
    plan = by_key.select("key", F.col("main.component").alias("main"), blocks(F.col("bytes")).alias("blocks"), blocks(F.col("bytes") - F.col("main.bytes")).alias("others"))
    plan = materialize(packed(plan, n), "plan")
    planned = sized.drop("bytes").join(F.broadcast(plan), "key") if plan.count() <= BUCKET_ROWS else dealt_join(sized.drop("bytes"), plan, "key", "node", hot_of(_sizes(sized, "key")))
    rows = materialize(packed(planned, n), "rows")

    def gathered(part: DataFrame, number: str, name: str) -> DataFrame:
        dealt = part.withColumn("block", F.pmod(F.xxhash64("node"), number)).join(vectors, "node")
        return dealt.groupBy("key", "block", "blocks").agg(F.collect_list(F.struct("node", "component", "vector")).alias(name))

    left = gathered(rows.filter("component <> main"), "others", "xs").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = left.join(gathered(rows, "blocks", "ys"), ["key", "block"])

    def run(batch):
        found = {p for xs, ys in zip(batch.column("xs"), batch.column("ys"), strict=True) for p in block_links(xs.as_py(), ys.as_py(), threshold)}
        return {"a": [min(p) for p in found], "b": [max(p) for p in found]}

    return map_batches(met.select("xs", "ys"), run, "a long, b long")


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: int = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """Columns doc_id, n_shingles, component_id (least doc_id of all that links reach), kept: one row for each row of ``docs``."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketched = materialize(signatures(docs, shingle=shingle), "sketches")
    most = sketched.count()
    grouped = sketched.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers"))
    sets = materialize(packed(grouped, most), "sets")
    nodes = sets.filter("node is not null")
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("registers", 1 + 2 * ROWS * i, 2 * ROWS)) for i in range(BANDS)])
    bands = nodes.select("node", F.explode(keys).alias("key"))
    shared = materialize(packed(bands.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("hub")).filter("members > 1"), BANDS * most), "shared")
    held = None
    if shared.count() <= BUCKET_ROWS:
        buckets = bands.join(F.broadcast(shared), "key")
    else:
        held = hot_of(shared.select("key", F.col("members").alias("n")))
        buckets = dealt_join(bands, shared, "key", "node", held)
    buckets = materialize(buckets, "buckets")
    rows = buckets.count()
    among = materialize(packed(buckets.select("node").distinct(), rows), "among")
    found_by = small_or_plain(among)
    sketches = materialize(nodes.join(found_by, "node", "left_semi"), "candidates")
    few = among.count() <= SKETCH_ROWS
    texts = materialize(docs.filter("text is not null").withColumnRenamed("doc_id", "node").join(found_by, "node", "left_semi"), "texts")

    def links_of(pairs: DataFrame, most: int) -> tuple[DataFrame, int, int]:
        """The links among at most so many pairs, their number and that of the pairs."""
        # written one by one, so that no task runs two Python workers
        pairs = materialize(packed(pairs, most), "pairs")
        met = pairs.count()
        near = materialize(_near(pairs, sketches, threshold, few), "near") if met else pairs
        n = near.count() if met else 0
        links = materialize(_confirmed(near, n, texts, threshold, shingle), "links") if n else near
        return links, links.count() if n else 0, met

    # first each node with its least hub, one pair a node
    links, linked_pairs, _ = links_of(buckets.filter("node <> hub").groupBy("node").agg(F.min("hub").alias("a")).select("a", F.col("node").alias("b")), rows)
    found = components(links, linked_pairs) if linked_pairs else buckets.limit(0).select("node", F.col("hub").alias("component"))
    open_ = buckets.select("key", "node")
    star = 0
    while star <= STARS + 1:
        # members of buckets that hold several components; all of a bucket's have met its hub by the second star
        placed = open_.select("key", "node").join(small_or_plain(found, NODE_ROWS), "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
        mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("members"), F.min_by(F.struct("node", "component"), F.xxhash64("key", "node", F.lit(star)) if star else F.col("node")).alias("centre"))
        mixed = materialize(packed(mixed.filter(F.col("low") != F.col("high")).filter(F.lit(not star) | (F.col("members") > 2)).select("key", "centre"), rows), "mixed")
        n = mixed.count()
        if not n:
            break
        met = placed.join(F.broadcast(mixed), "key") if n <= BUCKET_ROWS else dealt_join(placed, mixed, "key", "node", held if held is not None else hot_of(_sizes(placed, "key")))
        open_ = materialize(packed(met, rows), "open")
        rows = open_.count()
        if star <= STARS:
            pairs = open_.filter("component <> centre.component").select(F.col("centre.node").alias("a"), F.col("node").alias("b"))
        else:
            pairs = _rest(open_.select("key", "node", "component"), rows, texts, threshold, shingle)
        links, linked_pairs, n = links_of(pairs.distinct(), rows)
        # further stars would find as little: what is left is compared at once
        star = max(star + 1, STARS + 1) if star and STAR_PAIRS * linked_pairs < n else star + 1
        if not linked_pairs:
            continue
        # links between components, then each node's component of components
        of = small_or_plain(found, NODE_ROWS)
        a, b = (of.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of")) for c in "ab")
        between = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("a_of", "a").alias("a"), F.coalesce("b_of", "b").alias("b"))
        above = small_or_plain(components(between, linked_pairs).select(F.col("node").alias("component"), F.col("component").alias("top")), NODE_ROWS)
        old = found.join(above, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
        new = above.select(F.col("component").alias("node"), F.col("top").alias("component"))
        found = materialize(packed(old.unionByName(new), among.count()), "components")
    sets_of = sets.select("digest", "node").join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    return sketched.join(sets_of, "digest", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: int = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates, with all its columns: that of the least ``key``.

    Rows that repeat a key are one document, of which the row with the least hash of the text stays. Rows without a key
    can't be told apart and all stay.
    """
    own = fresh(docs.columns)
    kept = materialize(classes(docs, text, key, threshold, shingle).filter("kept and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "kept")
    ids = kept.select(F.col("doc_id").alias(f"{own}key"), F.col("n").alias(f"{own}rows"))
    found = docs.join(small_or_plain(ids), F.col(key).cast("long") == F.col(f"{own}key"))
    once = found.filter(F.col(f"{own}rows") == 1).select(*docs.columns)
    several = found.filter(F.col(f"{own}rows") > 1).groupBy(f"{own}key").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(text)).alias("row")).select("row.*")
    return once.unionByName(several).unionByName(docs.filter(F.col(key).isNull()))
