"""Source divergence, order MinHash and hard negatives against plain versions of themselves, on rows of every odd kind."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sillon.llm import divergence, negatives, order_minhash


# --- source divergence


def plain_audit(rows, least=divergence.LEAST_DOCS):
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        held = Counter(t for g, _, ts in docs if g == lang for t in set(ts))
        kept = {t for t, n in held.items() if n >= least}
        v = len(kept)
        counts = {}
        for g, s, ts in docs:
            if g == lang:
                counts.setdefault(s, Counter()).update(t for t in ts if t in kept)
        whole = sum(counts.values(), Counter())
        p = lambda c, t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * v)
        for s, c in counts.items():
            pairs = [(o, sum(abs(p(c, t) - p(d, t)) for t in kept)) for o, d in counts.items() if o != s]
            terms = [(t, p(c, t) - p(whole, t)) for t in kept if c[t] and p(c, t) > p(whole, t)]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, 50)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, i, value, k) for k, (i, value) in enumerate(ranked, 1)]
    return sorted(out)


def audited(spark, rows):
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("term", F.lit(1)).withColumn("p", F.lit("x"))
    return sorted(tuple(r) for r in divergence.audit(df).select("lang", "source", "part", "item", "value", "rank").collect())


def test_audit_equals_plain_sums(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)] + ["Ärger", "日本", "ÀB", "naïve"]
    rows = []
    for i in range(900):
        lang, source = rng.choice(["en", "en", "fr", None, ""]), rng.choice(["hot"] * 5 + [f"s{k}" for k in range(7)] + [None])
        words = rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(len(vocabulary))], k=rng.randint(0, 40))
        rows.append((rng.choice([" ", "1", "-\n"]).join(words) if i % 17 else None, lang, source))
    rows += [("alone once", "xx", "a"), ("", "xx", "b"), ("word " * 20000, "fr", "long"), (None, None, None)] + [rows[3]] * 40
    expected = plain_audit(rows)
    assert {r[2] for r in expected} == {"pair", "term"}
    assert audited(spark, rows) == expected
    # several blocks of sources and bundles, tasks that hand on in parts
    monkeypatch.setattr(divergence, "SOURCES", 3)
    monkeypatch.setattr(divergence, "POSTINGS", 20)
    monkeypatch.setattr(divergence, "ENTRIES", 50)
    monkeypatch.setattr(divergence, "GROUPS", 2)
    assert audited(spark, rows) == expected


def test_audit_without_terms_or_rows(spark):
    assert audited(spark, []) == []
    assert audited(spark, [("a b", "x", "s"), (None, "x", "t")]) == [("x", "s", "pair", "t", 0, 1), ("x", "t", "pair", "s", 0, 1)]


def test_probabilities_beyond_64_bits(spark):
    n, total, v = 10**15, 10**17, 10**6
    row = spark.createDataFrame([(n, total, v)], "n long, t long, v long").select(divergence.probability("n", "t", "v").alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 5) // (total + 5 * v)


def test_prices_of_one_side():
    rng = np.random.RandomState(0)
    probs, counts = np.unique(rng.randint(1, 1000, 50)), None
    counts = rng.randint(1, 9, len(probs))
    floors = rng.randint(0, 1100, 20)
    assert divergence.priced_against(probs, counts, floors).tolist() == [int((counts * np.abs(probs - f)).sum()) for f in floors]


# --- order MinHash


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def spark_hash(values, seed=42):
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else (v[1] & (1 << 8 * v[0]) - 1).to_bytes(v[0], "little"), seed=seed)
    return seed


def plain_signature(text):
    big = re.compile("[฀-໿က-႟ក-៿⺀-鿿가-퟿豈-﫿\U00020000-\U0003ffff]")
    letters = []
    for run in re.split(r"[ \t\n\x0b\f\r]+", text):
        at = 0
        while at < len(run):
            n = 1
            if not big.match(run[at]):
                while n < order_minhash.LETTER and at + n < len(run) and not big.match(run[at + n]):
                    n += 1
            letters.append(run[at : at + n])
            at += n
    pairs = list(zip(["", *letters], [*letters, None], strict=True))
    seen = Counter()
    numbered = []
    for i, pair in enumerate(pairs):
        high = signed((spark_hash(pair) << 28) & (1 << 64) - 1) >> 28
        n = seen[high]
        seen[high] += 1
        numbered.append((high, n, i))
    valued = sorted(signed((spark_hash([(8, h), (4, n)]) << 28) & (1 << 64) - 1 | i) for h, n, i in numbered)[: order_minhash.SAMPLE]
    sample = sorted((x & (1 << 28) - 1, (x & (1 << 64) - 1) >> 29) for x in valued)
    out = []
    for k in range(order_minhash.TUPLES):
        ranked = sorted(signed((spark_hash([(8, x), (4, k)]) << 28) & (1 << 64) - 1 | j) for j, (_, x) in enumerate(sample))
        places = sorted(y & (1 << 28) - 1 for y in ranked[: order_minhash.LENGTH])
        out.append(spark_hash([(8, sample[j][1]) for j in places]) & 0xFFFFFFFF)
    return out


def plain_edits(rows):
    least = {}
    for i, text in rows:
        if i is not None:
            least[i] = min(least.get(i, text or ""), text or "")
    ids = sorted(least)
    nameless = min((t or "" for i, t in rows if i is None), default="")
    out = []
    for i, text in rows:
        text = text or ""
        following = [j for j in ids if i is not None and j > i] or ids
        after = least[following[0]] if following else nameless
        k = len(text) // 4
        edited = text[: len(text) - k] + after[:k]
        a, b, c = map(plain_signature, (text, edited, after))
        near = lambda x, y: sum(p == q for p, q in zip(x, y, strict=True)) / len(x)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(f"{x:08x}" for x in a), "".join(f"{x:08x}" for x in b), near(a, b), near(a, c)))
    return sorted(out, key=repr)


def edits(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("slot", F.lit("x")).withColumn("n", F.lit(0.5))
    return sorted((tuple(r) for r in order_minhash.compare_edits(df).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()), key=repr)


def test_fingerprints_equal_plain_ones(spark, monkeypatch):
    rng = random.Random(9)
    words = ["alpha", "be", "gamma-delta", "Österreich", "x", "日本語のテキスト", "ไทย", "😀😀", "internationalization"]
    rows = [(i * 7 % 101, " ".join(rng.choices(words, k=rng.choice([1, 2, 5, 30, 200])))) for i in range(60)]
    rows += [(300, ""), (301, None), (302, " \n\t"), (303, "same words " * 3000), (303, "another row"), (303, "another row"), (None, "no id"), (None, None), (304, "a b"), (305, "a b")]
    expected = plain_edits(rows)
    assert edits(spark, rows) == expected
    monkeypatch.setattr(order_minhash, "CHAIN_ROWS", 3)  # shuffled joins, frequent ids dealt
    assert edits(spark, rows + [(303, "more")] * 20) == plain_edits(rows + [(303, "more")] * 20)


def test_fingerprints_of_few_or_no_rows(spark):
    assert edits(spark, []) == []
    assert edits(spark, [(1, "only one row here")]) == plain_edits([(1, "only one row here")])
    assert edits(spark, [(None, "b c d e"), (None, "a")]) == plain_edits([(None, "b c d e"), (None, "a")])


def test_order_and_edits_count(spark):
    rng = random.Random(3)
    text = ["".join(rng.choices("abcdefghijklm", k=rng.randint(2, 7))) for _ in range(400)]
    moved, tail = text[200:] + text[:200], text[:300] + [f"other{i}" for i in range(100)]
    shuffled = rng.sample(text, len(text))
    rows = spark.createDataFrame([(" ".join(text), " ".join(x)) for x in (text, tail, moved, shuffled)], "a string, b string")
    got = [r.x for r in order_minhash.signatures(rows, {"p": "a", "q": "b"}).select(order_minhash.likeness(F.col("p"), F.col("q")).alias("x")).collect()]
    assert got[0] == 1 and got[0] > got[1] > 0.15 and got[0] > got[2] > got[3] and got[3] < 0.4


def test_successors_over_partitions(spark):
    ids = [(i,) for i in random.Random(1).sample(range(10_000), 500)]
    got = dict(r for r in map(tuple, order_minhash.successors(spark.createDataFrame(ids, "k long"), "k").select("k", "next").collect()))
    ordered = sorted(i for (i,) in ids)
    assert got == dict(zip(ordered, ordered[1:] + ordered[:1], strict=True))


def test_no_python_on_the_way(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    plan = order_minhash.compare_edits(df)._jdf.queryExecution().toString() + order_minhash.signatures(df, {"s": "text"})._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- hard negatives


def plain_mine(rows):
    whole = [(i, key, label, [math.floor(256 * x) for x in v]) for i, (key, v, label) in enumerate(rows) if None not in (key, label, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, key, label, v in whole:
        if key % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), k, j, other) for j, k, other, w in whole if j != i)
        for s, k, _, _ in [x for x in scored if x[3] == label][:5]:
            window = [x for x in scored if x[3] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(key, k, rank, n, -s, -t) for rank, (t, n, _, _) in enumerate(window, 1)]
    return sorted(out)


def mined(spark, rows, size=negatives.SHARD):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("anchor", F.lit("x")).withColumn("block", F.lit(1))
    return sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 100 == 0, size=size).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def vectors(rng, n, dims, labels, key=lambda i: i):
    return [(key(i), [float(np.float32(x)) for x in rng.normal(0.1, 0.2, dims)], int(rng.randint(labels))) for i in range(n)]


@pytest.mark.parametrize("shard", [2048, 7])
def test_negatives_equal_plain_ones(spark, shard):
    rng = np.random.RandomState(4)
    rows = vectors(rng, 260, 40, 3)
    rows += [(300, rows[0][1], 0), (300, rows[0][1], 0), (300, rows[0][1], 1)]  # repeated identifiers and vectors
    rows += [(400 + i, rows[5][1], i % 2) for i in range(60)]  # a frequent vector
    rows += [(None, rows[1][1], 0), (500, None, 1), (600, rows[2][1], None), (700, [1.0, None], 1), (800, [float("nan")] * 40, 1), (900, [float("inf"), 0.0], 0)]
    rows += [(1000, [], 1), (1100, [0.5] * 3, 0), (1200, [0.25] * 90, 2), (-100, rows[9][1], 1)]  # vectors of other lengths
    expected = plain_mine(rows)
    assert len(expected) > 20
    assert mined(spark, rows, shard) == expected


def test_negatives_of_few_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, [1.0], 1)]) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert mined(spark, [(100, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2)]) == [(100, 1, 1, 2, 65536, 256 * 230)]


def test_long_vectors(spark):
    rows = [(100, [float(2**20)] * 2, 1), (1, [float(2**20)] * 2, 1), (2, [float(2**20), float(2**20 - 1)], 2)]
    assert mined(spark, rows) == plain_mine(rows)  # beyond doubles
    with pytest.raises(Exception, match="leave 64 bits"):
        mined(spark, [(100, [1e9], 1)])
