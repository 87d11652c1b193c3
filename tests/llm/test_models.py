"""Language ID, toxicity, near-duplicates, host reputation and the pipeline on small tables."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sillon.llm import components, hosts, langid, minhash, toxicity
from sillon.llm.common import fold

SYLLABLES = {"xx": "ba ko mi lu ta re".split(), "yy": "sch ung ein heit ver zt".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n))


def test_fold(spark):
    rows = spark.createDataFrame([(i,) for i in (0, 1, 25, -7)] + [(None,)], "i long").select("i", fold(F.col("i"), 4).alias("f")).collect()
    assert all(r.f == (None if r.i is None else zlib.crc32(str(r.i).encode()) % 4) for r in rows)


def longest(text, at, sample):
    n = 0
    while at + n < len(text) and text[at : at + n + 1] in sample:
        n += 1
    return n


def test_cross_parsing_counts_phrases():
    rng = random.Random(1)
    samples = {k: [prose(rng, k, 200)] for k in SYLLABLES}
    parser = langid.Parser(langid.train(samples))
    for lang in SYLLABLES:
        for _ in range(20):
            text = prose(rng, rng.choice(list(SYLLABLES)), rng.randint(1, 40))
            line, sample = text, " " + samples[lang][0] + " "
            at = n = 0
            while at < len(line):
                at += max(1, longest(line, at, sample))
                n += 1
            got = parser.phrases([text])[0][parser.model.languages.index(lang), 0]
            assert got == n


def test_automaton_holds_all_substrings():
    rng = random.Random(2)
    s = [rng.randint(0, 2) for _ in range(60)]
    trans = langid.suffix_automaton(s)
    for _ in range(500):
        w = [rng.randint(0, 2) for _ in range(rng.randint(1, 8))]
        state, inside = 0, True
        for c in w:
            state = trans[state].get(c, -1)
            if state < 0:
                inside = False
                break
        assert inside == any(s[i : i + len(w)] == w for i in range(len(s) - len(w) + 1))


def test_language_id(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, l := rng.choice(list(SYLLABLES)), rng.choice([3, 50, 400])), l, "old") for i in range(300)]
    odd = [(1000, None, "xx", "o"), (1001, "", "xx", "o"), (1002, "123 ... !", None, "o"), (1003, "x" * 20_000, None, "o"), (None, "bakomi", None, "o"), (0, "", "yy", "o")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")
    model = langid.train(langid.sample(docs.filter("doc_id >= 100"), "text", "lang"))
    got = langid.identify(docs, model).collect()
    assert len(got) == 306 and docs.columns[:3] == ["doc_id", "text", "lang"]
    assert sum(r.lang_pred == r.lang for r in got if r.doc_id is not None and r.doc_id < 100 and r.text) >= 98
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (1000, 1001, 1002)} == {1000: "und", 1001: "und", 1002: "und"}
    none = langid.train(langid.sample(docs.limit(0), "text", "lang"))
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0


def test_languages_of_many_letters(spark):
    rng = random.Random(12)
    signs = {"zz": [chr(0x4E00 + i) for i in range(1500)], "ww": [chr(0xAC00 + i) for i in range(1500)]}
    words = {k: ["".join(rng.choices(v, k=2)) for _ in range(3000)] for k, v in signs.items()}
    texts = {k: ["".join(rng.choices(v, k=150)) for _ in range(80)] for k, v in words.items()}
    samples = {k: v[:60] for k, v in texts.items()} | {"xx": [prose(rng, "xx", 200) for _ in range(60)]}
    model = langid.train(samples)
    parser = langid.Parser(model)
    assert len(model.letters) > 2900
    line = texts["zz"][70]
    at = n = 0
    while at < len(line):
        at += max(1, longest(line, at, " " + " ".join(samples["zz"]) + " "))
        n += 1
    assert parser.phrases([line])[0][model.languages.index("zz"), 0] == n
    rows = [(t, k) for k, v in texts.items() for t in v[60:]] + [(prose(rng, "xx", 40), "xx") for _ in range(20)]
    rows += [("".join(rng.choices([chr(0x3400 + i) for i in range(500)], k=200)), None) for _ in range(20)]
    found = langid.identify(spark.createDataFrame(rows, "text string, lang string"), model)
    got = found.select("lang", "lang_pred", langid.rejected(model, F.col("lang_pred"), F.col("phrase_letters"), F.col("letters")).alias("gone")).collect()
    assert all(r.gone if r.lang is None else r.lang_pred == r.lang and not r.gone for r in got)


def test_copies_leave_a_sample_of_each_language(spark):
    rng = random.Random(11)
    few = spark.createDataFrame([(prose(rng, "xx", 20), "xx") for _ in range(300)] + [(prose(rng, "yy", 20), "yy") for _ in range(5)], "text string, lang string")
    copies = spark.range(400_000).select(F.when(F.col("id") % 4 > 0, F.lit(prose(rng, "yy", 20))).otherwise("").alias("text"), F.when(F.col("id") % 2 == 0, "yy").otherwise("xx").alias("lang"))
    got = langid.sample(few.unionByName(copies), "text", "lang")
    assert {k: len(set(v)) for k, v in got.items()} == {"xx": 128, "yy": 6}
    many = spark.range(450).select(F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.col("id").cast("string").alias("lang"))
    assert len(langid.sample(many, "text", "lang")) == 450


def test_toxicity(spark):
    rng = random.Random(4)
    bad = ["grolk", "vosnik", "grolkung"]
    rows, labels = [], []
    for i in range(600):
        words = prose(rng, "xx", rng.choice([5, 60, 500])).split()
        toxic = int(i % 5 == 0)
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words) + 1), rng.choice(bad[:2] if i < 400 else bad))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    rows += [(2000, None), (2001, ""), (2002, "!!!"), (2003, "ba " * 30_000), (None, "grolk grolk"), (2004, "ba grolkungen ko")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("old"))
    marks = spark.createDataFrame([*labels, labels[0], (3000, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks, fold(F.col("doc_id"), 5) != 0)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 606
    held = [r for r in got if r.doc_id is not None and r.doc_id < 600 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.predicted == int(r.doc_id % 5 == 0) for r in held) >= len(held) - 2
    by = {r.doc_id: r for r in got}
    assert by[2000].score == by[2001].score == by[2002].score < 0.5 and by[2004].predicted == 1 and by[2003].predicted == 0
    assert all(r.predicted == int(r.score >= 0.5) for r in got)
    assert toxicity.score(docs, toxicity.train(docs, marks.limit(0), F.lit(True))).filter("score > 0").count() == 0
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_shared_backoff():
    grams = {g: [0, 0] for w in ("abc", "abd") for g in toxicity.ngrams(w)}
    for w, k, n in (("abc", 0, 50), ("abc", 1, 5), ("abd", 1, 5)):
        for g in toxicity.ngrams(w):
            grams[g][k] += n
    s = toxicity.Scorer(toxicity.Counts("\n".join(grams), np.array([v[0] for v in grams.values()]), np.array([v[1] for v in grams.values()])))
    assert s.difference("abd") > 1 > 0 > s.difference("abc")
    assert abs(s.difference("zzz")) < abs(s.difference("abd"))  # only the weights of backoff differ
    total = sum(s._shared[toxicity.BORDER + c] for c in "abcdz" + toxicity.BORDER)
    assert 0.5 < total <= 1.0001


def brute_difference(counts, word):
    """The difference of a word by plain dictionaries of all n-grams."""
    shared, kinds = {g: x + y for g, (x, y) in counts.items()}, set(counts)
    for n in range(toxicity.ORDER, 1, -1):
        for g in [g for g in kinds if len(g) == n]:
            shared[g[1:]] = shared.get(g[1:], 0) + 1
            kinds.add(g[1:])
    after = {}
    for g in shared:
        after.setdefault(g[:-1], []).append(g)
    letters, cut = sum(len(g) == 1 for g in shared), toxicity.DISCOUNT

    def p(g):
        lower = p(g[1:]) if len(g) > 1 else 1 / (letters + 1)
        a = after.get(g[:-1])
        return (max(shared.get(g, 0) - cut, 0) + cut * len(a) * lower) / sum(map(shared.get, a)) if a else lower

    total = 0.0
    for g in toxicity.ngrams(word):
        seen, q = [counts[h] for h in after.get(g[:-1], []) if h in counts], []
        for k in (0, 1):
            n, different, c = sum(v[k] for v in seen), sum(v[k] > 0 for v in seen), counts.get(g, (0, 0))[k]
            q.append((max(c - cut, 0) + cut * different * p(g)) / n if n else p(g))
        total += np.log(q[1] / q[0]) if g[:-1] in after else 0.0
    return total


def test_differences_equal_plain_dictionaries():
    rng = random.Random(8)
    words = ["".join(rng.choices("abcé\U0001d4d0", k=rng.randint(1, 9))) for _ in range(150)]
    counts = {}
    for w in words[:80]:
        x, y = rng.choice([(3, 0), (0, 2), (4, 1)])
        for g in toxicity.ngrams(w):
            a = counts.get(g, (0, 0))
            counts[g] = (a[0] + x, a[1] + y)
    s = toxicity.Scorer(toxicity.Counts("\n".join(counts), *(np.array([v[k] for v in counts.values()]) for k in (0, 1))))
    assert np.allclose(s.differences([*words, "zq"]), [brute_difference(counts, w) for w in [*words, "zq"]])
    empty = toxicity.Scorer(toxicity.Counts("", np.zeros(0), np.zeros(0)))
    assert empty.differences(["ab", "c"]) == [0, 0] and empty.features(["", "ab"])[0] == (0, 0, 0, 0)


def test_rare_toxic_ngrams_are_kept(spark):
    rng = random.Random(9)
    common = ["".join(rng.choices("abcdefghijklmnop", k=8)) for _ in range(60_000)]
    rows = [(i, f"{' '.join(common)} n{'x' * i}", 0) for i in range(16)] + [(100 + i, f"{common[0]} grolk {'y' * i}", 1) for i in range(4)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    model = toxicity.train(table.select("doc_id", "text"), table.select("doc_id", "toxic"), F.lit(True))
    held = set(model.counts.value.grams.split("\n"))
    assert len(held) > 300_000 and set(toxicity.ngrams("grolk")) <= held and all(held.issuperset(toxicity.ngrams(w)) for w in common)


def test_registers_estimate():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(2000)]
    a = [" ".join(rng.choices(words, k=300)) for _ in range(60)]
    b = [" ".join(w if rng.random() > 0.05 * (i % 8) else "z%d" % rng.randrange(10**6) for w in t.split()) for i, t in enumerate(a)]
    x, y = minhash.shingle_hashes(a), minhash.shingle_hashes(b)
    assert [len(s) for s in x] == [len(minhash.shingles_of(t)) for t in a]
    true = np.array([len(p & q) / len(p | q) for p, q in ((minhash.shingles_of(s), minhash.shingles_of(t)) for s, t in zip(a, b, strict=True))])
    got = minhash.estimate(minhash.registers(x), minhash.registers(y), np.array([len(s) for s in x], float), np.array([len(s) for s in y], float))
    assert np.abs(got - true).max() < 0.15 and abs((got - true).mean()) < 0.02


def test_shingle_hashes_of_odd_texts():
    texts = ["", "  ", "a", "A", "a b", "A\tB", "a b a b", "x\x0by", "é É\xa0e", "a\x1cb c"]
    got = minhash.shingle_hashes(texts)
    assert [len(g) for g in got] == [len(minhash.shingles_of(t)) for t in texts]
    assert (got[2] == got[3]).all() and (got[4] == got[5]).all() and not set(got[2].tolist()) & set(got[4].tolist())


def test_short_words_hash_alike_in_any_company(monkeypatch):
    monkeypatch.setattr(minhash, "_powers", minhash._powers[:1])
    alone = minhash.shingle_hashes(["x y z u v w"])[0]
    assert (minhash.shingle_hashes(["a longer word", "x y z u v w"])[1] == alone).all()


def brute_components(rows):
    sets = [minhash.shingles_of(t or "") for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if minhash.linked(sets[i], sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, d), d)
    return {d: (len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))}


@pytest.fixture(scope="module")
def near_rows():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for base in range(6):
        t = rng.choices(words, k=rng.choice([1, 2, 12, 40, 120]))
        for _ in range(rng.choice([1, 5, 45])):
            u = list(t)
            for _ in range(rng.randint(0, max(1, len(t) // 12))):
                u[rng.randrange(len(u))] = rng.choice(words)
            rows.append(" ".join(u))
    rows += ["", None, " ", "one", "One", "one", "x y", "X  y"] + ["same text of a large group"] * 30
    rng.shuffle(rows)
    return [(i * 3 + 5, t) for i, t in enumerate(rows)]


def test_near_duplicates(spark, near_rows):
    docs = spark.createDataFrame(near_rows, "doc_id long, text string").withColumn("kept", F.lit("old")).repartition(3)
    want = brute_components(near_rows)
    got = minhash.classes(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(near_rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    left = minhash.deduplicate(docs.unionByName(spark.createDataFrame([(None, "no id", "z")], "doc_id long, text string, kept string")))
    assert sorted((r.doc_id for r in left.collect() if r.doc_id is not None)) == sorted({c for _, c in want.values()}) and left.columns == docs.columns
    assert minhash.classes(docs.limit(0)).count() == 0


def test_stage_takes_five_words(spark, monkeypatch):
    import corpus_pipeline

    rng = random.Random(10)
    rows = []
    for base in range(12):
        t = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        rows.append((100 * base, " ".join(t)))
        for i, places in enumerate(([50], [10, 30, 50, 70, 90], range(45, 50)), 1):
            u = list(t)
            for p in places:
                u[p] = f"z{base}x{i}x{p}"
            rows.append((100 * base + i, " ".join(u)))
    assert minhash.SHINGLE == 5
    want = brute_components(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == sorted({c for _, c in want.values()})
    assert {c % 100 for _, c in want.values()} == {0, 2}  # five scattered words part five-word sets, not two-word ones
    monkeypatch.setattr(minhash, "shingles_of", lambda t, size=2, of=minhash.shingles_of: of(t, size))
    two = brute_components(rows)
    assert {c % 100 for _, c in two.values()} == {0} and {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.classes(docs, shingle=2).collect()} == two


def test_blocks_link_what_brute_force_links(near_rows):
    rows = [(d, t) for d, t in near_rows if t and t.strip()]
    vectors = minhash.shingle_hashes([t for _, t in rows])
    members = [{"node": d, "component": d, "vector": v.tobytes()} for (d, _), v in zip(rows, vectors, strict=True)]
    got = {tuple(sorted(p)) for p in minhash.block_links(members[:70], members)}
    sets = {d: minhash.shingles_of(t) for d, t in rows}
    first = [d for d, _ in rows[:70]]
    assert got == {tuple(sorted((a, b))) for a in first for b in sets if a != b and minhash.linked(sets[a], sets[b])}


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (101, 102), (200, 200), (100, 101)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in (101, 102, 103)}


def test_rules_and_hosts(spark):
    urls = [None, "no scheme", "http://A.COM", "http://a.com/x", "https://example.com/en/1?q#f", "https://WWW.example.com/en/1", "http://x.www.example.com/en/", "http://b.net/es/1", "http://net/fr/", "http://b.net/de/", "http://notcom/x", "x://h?://z/", "http://b.net/es", "http://q.org/p#f"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("old"))
    none = spark.createDataFrame([], "host string, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in hosts.judge(pages, none).collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("a.com", "", None, "allow"), 3: ("a.com", "/x", "com/", "allow"), 4: ("example.com", "/en/1", "example.com/en/", "block"),
        5: ("www.example.com", "/en/1", "www.example.com/en/", "allow"), 6: ("x.www.example.com", "/en/", "www.example.com/en/", "allow"), 7: ("b.net", "/es/1", "net/es/", "block"), 8: ("net", "/fr/", "net/fr/", "block"),
        9: ("b.net", "/de/", None, "allow"), 10: ("notcom", "/x", None, "allow"), 11: ("h", "", None, "allow"), 12: ("b.net", "/es", None, "allow"), 13: ("q.org", "/p", None, "allow"),
    }
    assert hosts.judge(pages.limit(0), none).count() == 0


def test_reputation_shrinks(spark):
    rows = [("bad.x.org", 1)] * 40 + [("one.x.org", 1)] + [("good.x.org", 0)] * 40 + [(f"h{i}.y.org", i % 2) for i in range(30)] + [("n.z.org", None)]
    outcomes = spark.createDataFrame(rows, "host string, bad int")
    urls = ["http://bad.x.org/", "http://one.x.org/", "http://good.x.org/", "http://new.x.org/", "http://h1.y.org/", "http://other.info/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.host: r.verdict for r in hosts.judge(pages, outcomes, limit=0.55).collect()}
    assert got["bad.x.org"] == "block" and got["good.x.org"] == "allow"
    mean = {r.host: r.alpha / (r.alpha + r.beta) for r in hosts.reputation(outcomes)[0].collect()}
    assert 0.4 < mean["one.x.org"] < mean["bad.x.org"] and mean["good.x.org"] < 0.1


def test_levels_of_hosts(spark):
    want = {
        "a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.com:8080": ("x.com", "com"), "me@www.x.com": ("x.com", "com"), "a.com.": ("a.com", "com"), "com": ("com", "com"), "": ("", ""),
        "10.0.0.1": ("10.0.0.1", "10.0.0.1"), "10.0.0.1:80": ("10.0.0.1", "10.0.0.1"), "[::1]:80": ("[::1]", "[::1]"), "1.2.3": ("2.3", "3"), "d.e.f.net": ("f.net", "net"), "..": ("", ""),
    }
    rows = spark.createDataFrame([(h,) for h in want], "host string").select("host", *hosts.levels_of(F.col("host"))).collect()
    assert {r[0]: (r[1], r[2]) for r in rows} == want
    given = spark.createDataFrame([("x.y.z.w",)], "host string").select(*hosts.levels_of(F.col("host"), ("z.w", "y.z.w"))).first()
    assert tuple(given) == ("x.y.z.w", "y.z.w")


def test_frequent_hosts_and_domains(spark, monkeypatch):
    from sillon.llm import common

    rng = random.Random(13)
    names = ["hot.x.org"] * 60 + [f"h{i}.x.org" for i in range(30)] + [f"h{i}.d{i % 5}.com" for i in range(30)]
    rows = [(h, int(rng.random() < (0.9 if h == "hot.x.org" else 0.2))) for h in names]
    outcomes, pages = spark.createDataFrame(rows, "host string, bad int"), spark.createDataFrame([(i, f"http://{h}/") for i, h in enumerate(names)] + [(None, "http://hot.x.org/")], "page_id long, url string")
    plain = sorted(map(str, hosts.judge(pages, outcomes).collect()))
    monkeypatch.setattr(common, "HOT_ROWS", 7)
    assert sorted(map(str, hosts.judge(pages, outcomes).collect())) == plain and len(plain) == 121


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(7)
    rows = [(i, prose(rng, "xx" if i % 2 else "yy", 60), "xx" if i % 2 else "yy", f"src{i % 3}", 0) for i in range(200)]
    text = dict((r[0], r[1]) for r in rows)
    rows += [(500, "... 12 !!", "xx", "s", 0), (501, None, None, None, None), (502, text[0], "yy", "s", 0), (503, text[1] + " ko", "xx", "s", 0), (504, text[2] + " Passage one two THREE four five six seven eight nine ten", "yy", "s", 0)]
    labels = []
    for i in range(600, 700):
        toxic = i % 2
        rows.append((i, prose(rng, "xx", 40) + " grolk vosnik grolk" * toxic, "xx", "s", 0))
        labels.append((i, 1, toxic))
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "passage one, two three four five six seven eight nine ten eleven")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    out = corpus_pipeline.run(spark, d)
    kept = {r.doc_id for r in out.collect()}
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert not kept & {500, 501, 502, 503, 504} and set(range(200)) <= kept
    assert len([i for i in range(600, 700) if i % 2 == 0 and i in kept]) >= 48 and len([i for i in range(600, 700) if i % 2 and i in kept]) <= 2
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_parses_do_not_depend_on_segments(monkeypatch):
    """Long texts, copies of the sample, single words: as many phrases as a parse from the first symbol to the last."""
    rng = random.Random(21)
    samples = {k: [prose(rng, k, 300)] for k in SYLLABLES}
    texts = [prose(rng, rng.choice(list(SYLLABLES)), n) for n in (1, 3, 60, 700)] + [samples["xx"][0] * 3, "a" * 3000, "bak", samples["yy"][0], "", "1 2"]
    parser = langid.Parser(langid.train(samples))
    whole = parser.phrases(texts)[0]
    for lang, row in zip(parser.model.languages, whole.tolist(), strict=True):
        inside = " " + samples[lang][0] + " "
        for text, n in zip(texts, row, strict=True):
            line = re.sub(r"[^a-z]+", " ", text)
            at = k = 0
            while at < len(line) and line.strip():
                at += max(1, longest(line, at, inside))
                k += 1
            assert n == k
    for size in (1, 2, 7, 64):
        monkeypatch.setattr(langid, "SEGMENT", size)
        monkeypatch.setattr(langid, "TOGETHER", 100)
        assert (langid.Parser(parser.model).phrases(texts)[0] == whole).all()


def test_samples_are_whole_texts(spark):
    rows = [("xx", "long " * 9000), ("xx", "short one"), ("xx", "another short one"), ("yy", "only " * 20_000), ("zz", "a" * 30_000), ("zz", "b" * 30_000), ("zz", "cc")]
    got = langid.sample(spark.createDataFrame(rows, "l string, x string"), "x", "l")
    texts = {k: {x for lang, x in rows if lang == k} for k in ("xx", "yy", "zz")}
    assert all(set(v) <= texts[k] for k, v in got.items()) and set(got) == set(texts)
    assert set(got["xx"]) == texts["xx"] - {"long " * 9000} and got["yy"] == ["only " * 20_000]  # where none fits, one is taken
    assert len(got["zz"]) == 2 and "cc" in got["zz"]
