"""How far the sources of a language diverge in their use of words, in exact integers.

The terms that enough documents of a language hold are kept. A group (language and source) gives each kept term a
probability in whole billionths, smoothed so that a term which it lacks has the same floor as all others it lacks. The
distance of two groups is the sum of absolute differences over all kept terms, and no vector is ever made as long as the
vocabulary: by inclusion and exclusion over the two supports

* each group's terms are priced against the other's floor, from a histogram of the group's probabilities,
* terms that both hold were priced twice and against floors: a join of posting blocks (language, bundle of terms, block
  of sources) puts them right,
* terms that neither holds, all but both supports, cost the difference of the floors.

Work follows from postings and from the pairs that are asked for. Rows of a frequent term or source are counted within
tasks before they are shuffled, and blocks of postings have bounded sizes.

Cases: null texts, languages and sources are empty strings; a group without terms is a group; languages without kept
terms have distances of 0 and no terms; repeated rows are documents of their own; ties go to the lesser item; other
columns are of no account; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, dealt_join, map_batches, materialize

#: Documents of a language that must hold a term.
LEAST_DOCS = 30
#: Added to every count.
SMOOTHING = 5
#: Units of a probability.
SCALE = 1_000_000_000
#: Terms that are listed for a group.
LISTED = 50
#: Entries that a task counts before it hands them on.
ENTRIES = 400_000
#: Postings of a block (about), and sources of a block.
POSTINGS, SOURCES = 16_384, 128
#: Groups up to which their totals (some 100 bytes each) are broadcast.
GROUPS = 100_000

#: What parts terms becomes a space, A-Z become a-z, the other bytes stay.
_BYTES = bytes(x + 32 if 0x41 <= x <= 0x5A else x if x >= 0x80 or 0x61 <= x <= 0x7A else 0x20 for x in range(256))
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return text.translate(_BYTES).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """Occurrences and documents by lang, source and term, in parts to be added; a null term stands for the group itself."""
    bounded_batches(docs.sparkSession)

    def flushed(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> pa.RecordBatch:
        rows = [(lang, source, t, n, d[t]) for (lang, source), (c, d) in held.items() for t, n in [*c.items(), (None, 0)]]
        return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows, strict=True), _COUNTS, strict=True)], schema=_COUNTS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        entries = 0
        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
                if (lang, source) not in held:
                    held[lang, source] = (Counter(), Counter())
                n, docs = held[lang, source]
                before = len(n)
                found = terms_of(text.as_buffer().to_pybytes())
                n.update(found)
                docs.update(set(found))
                entries += len(n) - before
                if entries > ENTRIES:
                    yield flushed(held)
                    held, entries = {}, 0
        if held:
            yield flushed(held)

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    parts = docs.select(empty("lang"), empty("source"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")).mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return parts.withColumn("term", F.col("term").cast("string")).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(count: str, total: str, size: str) -> Column:
    """Smoothed whole billionths: counts may be so large that their product leaves 64 bits. 0 without kept terms."""
    return F.expr(f"CASE WHEN {size} > 0 THEN 1 + ((CAST({count} AS DECIMAL(19, 0)) + {SMOOTHING}) * {SCALE}) div (CAST({total} AS DECIMAL(19, 0)) + {SMOOTHING} * CAST({size} AS DECIMAL(19, 0))) ELSE 0 END")


def priced_against(probs: np.ndarray, counts: np.ndarray, floors: np.ndarray) -> np.ndarray:
    """For each floor the sum of differences of sorted probabilities, held ``counts`` times each, from it."""
    n, s = np.concatenate(([0], np.cumsum(counts))), np.concatenate(([0], np.cumsum(counts * probs)))
    at = np.searchsorted(probs, floors)
    return (n[at] * floors - s[at]) + (s[-1] - s[at]) - (n[-1] - n[at]) * floors


def overlap_corrections(xs: pa.StructArray, ys: pa.StructArray) -> dict[tuple[str, str], int]:
    """For pairs (lesser, greater) of sources of two posting blocks: what shared terms cost, less what they were priced at."""
    terms = pa.concat_arrays([xs.field("term"), ys.field("term")]).dictionary_encode()
    codes = terms.indices.to_numpy(zero_copy_only=False)

    def dense(rows: pa.StructArray, at: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        sources = rows.field("source").dictionary_encode()
        place = sources.indices.to_numpy(zero_copy_only=False)
        probs, floors = np.zeros((len(sources.dictionary), len(terms.dictionary)), dtype=np.int64), np.zeros(len(sources.dictionary), dtype=np.int64)
        probs[place, at] = rows.field("p").to_numpy(zero_copy_only=False)  # never 0 for a term that is held
        floors[place] = rows.field("floor").to_numpy(zero_copy_only=False)
        return sources.dictionary.to_pylist(), probs, floors

    (a, p, u), (b, q, v) = dense(xs, codes[: len(xs)]), dense(ys, codes[len(xs) :])
    out: dict[tuple[str, str], int] = {}
    for i, one in enumerate(a):
        has = np.flatnonzero(p[i])
        mine, theirs = p[i, has][None, :], q[:, has]
        cost = np.abs(mine - theirs) - np.abs(mine - v[:, None]) - np.abs(theirs - u[i]) + np.abs(u[i] - v)[:, None]
        shared = theirs > 0
        for other, s, any_shared in zip(b, np.where(shared, cost, 0).sum(axis=1).tolist(), shared.any(axis=1).tolist(), strict=True):
            if any_shared and one != other:
                out[min(one, other), max(one, other)] = s
    return out


def _pair_values(groups: DataFrame, priced: DataFrame) -> DataFrame:
    """Columns lang, a, b (a < b), value: the distance of every pair of sources of a language."""
    sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("groups"), F.sum("support").alias("postings"))
    sizes = sizes.select("lang", F.ceil(F.col("groups") / SOURCES).alias("blocks"), F.ceil(F.col("postings") / POSTINGS).alias("bundles"))
    sizes = F.broadcast(sizes) if sizes.count() <= GROUPS else sizes
    block = F.pmod(F.xxhash64("source"), "blocks")

    hist = priced.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("n"))
    hist = hist.groupBy("lang", "source").agg(F.sort_array(F.collect_list(F.struct("p", "n"))).alias("hist"))
    placed = groups.select("lang", "source", "floor", "support", "size").join(sizes, "lang").withColumn("block", block)
    others = placed.groupBy("lang", "block", "blocks").agg(F.collect_list(F.struct("source", "floor", "support")).alias("others"))
    each = placed.withColumnRenamed("block", "salt").join(hist, ["lang", "source"], "left").drop("blocks", "bundles")
    met = each.join(others.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("block", "blocks"), ["lang", "salt"])

    def sided(batch):
        out: dict[str, list] = {"lang": [], "a": [], "b": [], "value": []}
        for r in batch.to_pylist():
            held = r["hist"] or []
            probs, counts = (np.array([x[c] for x in held], dtype=np.int64) for c in ("p", "n"))
            others = [x for x in r["others"] if x["source"] != r["source"]]
            values = priced_against(probs, counts, np.array([x["floor"] for x in others], dtype=np.int64))
            for x, value in zip(others, values.tolist(), strict=True):
                if r["source"] < x["source"]:  # once a pair: the terms that neither holds, by inclusion and exclusion
                    value += (r["size"] - r["support"] - x["support"]) * abs(r["floor"] - x["floor"])
                for c, v in (("lang", r["lang"]), ("a", min(r["source"], x["source"])), ("b", max(r["source"], x["source"])), ("value", value)):
                    out[c].append(v)
        return out

    pair = "lang string, a string, b string, value long"
    one_sided = map_batches(met.select("lang", "source", "floor", "support", "size", "hist", "others"), sided, pair)

    dealt = priced.select("lang", "source", "term", "p", "floor").join(sizes, "lang").withColumn("block", block)
    dealt = dealt.withColumn("bundle", F.pmod(F.xxhash64("term"), F.greatest(F.lit(1).cast("long"), F.col("bundles") / F.col("blocks")).cast("long")))
    postings = materialize(dealt.groupBy("lang", "bundle", "block").agg(F.collect_list(F.struct("source", "term", "p", "floor")).alias("held")), "postings")
    joined = postings.select("lang", "bundle", F.col("block").alias("x"), F.col("held").alias("xs")).join(postings.select("lang", "bundle", F.col("block").alias("y"), F.col("held").alias("ys")), ["lang", "bundle"]).filter("x <= y")

    def shared(batch):
        out: dict[str, list] = {"lang": [], "a": [], "b": [], "value": []}
        for lang, xs, ys in zip(*(batch.column(c) for c in ("lang", "xs", "ys")), strict=True):
            for (a, b), value in overlap_corrections(xs.values, ys.values).items():
                for c, v in (("lang", lang.as_py()), ("a", a), ("b", b), ("value", value)):
                    out[c].append(v)
        return out

    return one_sided.unionByName(map_batches(joined.select("lang", "xs", "ys"), shared, pair)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame) -> DataFrame:
    """Columns lang, source, part, item, value, rank for documents with columns text, lang and source.

    Part ``pair``: the distance to each other source of the language. Part ``term``: the ``LISTED`` terms by which the
    group's probability exceeds the language's most.
    """
    counts = materialize(term_counts(docs), "counts")
    held = counts.filter("term is not null")
    kept = materialize(held.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("groups")).filter(F.col("docs") >= LEAST_DOCS).drop("docs"), "kept")
    languages = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("size"), F.sum("all").alias("lang_total"))
    postings = materialize(held.drop("docs").join(kept.drop("groups"), ["lang", "term"]), "kept_counts")
    sums = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("support"))
    groups = counts.filter("term is null").select("lang", "source").join(languages, "lang", "left").join(sums, ["lang", "source"], "left").na.fill(0, ["size", "lang_total", "total", "support"])
    groups = materialize(groups.withColumn("zero", F.lit(0)).withColumn("floor", probability("zero", "total", "size")).drop("zero"), "groups")
    few = groups.count() <= GROUPS
    named = groups.select("lang", "source", "total", "size", "lang_total", "floor").withColumn("group", F.struct("lang", "source"))
    members = postings.withColumn("group", F.struct("lang", "source"))
    sizes = groups.select(F.struct("lang", "source").alias("group"), F.col("support").alias("n"))
    met = members.join(F.broadcast(named.drop("lang", "source")), "group") if few else dealt_join(members, named.drop("lang", "source"), "group", "term", sizes)
    priced = met.select("lang", "source", "term", "floor", probability("n", "total", "size").alias("p"), probability("all", "lang_total", "size").alias("q"))

    ranks = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = priced.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    listed = over.withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") <= LISTED)
    pairs = _pair_values(groups, priced)
    both = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value")
    apart = both.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value").withColumn("rank", F.row_number().over(ranks))
    return apart.unionByName(listed)
