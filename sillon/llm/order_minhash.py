"""Order MinHash fingerprints of texts, by DataFrame functions alone.

A text's letters are its runs of non-space characters, cut after every ``LETTER`` characters (in scripts without spaces:
single characters), behind one empty letter; a k-mer is a pair of neighbouring letters. The i-th time that a k-mer occurs
is a pair (k-mer, i), so repeated k-mers count as often as they stand in the text. The ``SAMPLE`` pairs of least hash are
selected; each of the ``TUPLES`` hash functions then selects the ``LENGTH`` least of these, puts them back into the order
of the text and hashes the tuple. Two texts agree in a tuple if they share its pairs and have them in the same order,
which edits destroy and moved passages too.

A k-mer (36 bits of hash) and its position (28 bits, as many as an array has places for) make one 64-bit value: sorting
is sorting of plain integers, equal k-mers come to stand together in the order of the text, and they are numbered from
the borders of their runs. Everything but the sorts is linear in the text, and a text's row is worked on where it is.

Cases: null texts are empty; a text without a letter has one k-mer that no other text has; texts of fewer pairs than a
tuple's length make tuples of all they have; equal texts have equal fingerprints; white space between letters is of no
account; a table without rows gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dealt_join, fresh, materialize

#: Characters after which a run without white space is cut.
LETTER = 4
#: Blocks of scripts that put no spaces between words; fixed values of Unicode.
UNSPACED = r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{2E80}-\x{9FFF}\x{AC00}-\x{D7FF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"
#: Pairs of k-mer and number that are selected from a text.
SAMPLE = 64
#: Tuples of a fingerprint, and pairs in a tuple.
TUPLES, LENGTH = 32, 2
#: Documents up to which the rows of who follows whom (some 100 bytes each) are broadcast.
CHAIN_ROWS = 500_000
#: Bits of a position, and of a selected pair's identity beside its position.
POSITION, IDENTITY = 28, 35


def _low(x: Column, bits: int) -> Column:
    return x.bitwiseAND(F.lit((1 << bits) - 1))


def _packed(hashed: Column, low: Column) -> Column:
    return F.shiftleft(hashed, POSITION).bitwiseOR(low.cast("long"))


def _kmers(letters: Column) -> Column:
    """Sorted: the hash of each pair of neighbouring letters above its position."""
    return F.sort_array(F.transform(F.arrays_zip(F.concat(F.array(F.lit("")), letters), letters), lambda pair, i: _packed(F.xxhash64(pair), i)))


def _runs(kmers: Column) -> Column:
    """Where runs of equal k-mers begin."""
    kmer = lambda i: F.shiftright(F.get(kmers, i), POSITION)
    return F.filter(F.sequence(F.lit(0), F.size(kmers) - 1), lambda i: (i == 0) | (kmer(i) != kmer(i - 1)))


def _least(kmers: Column, runs: Column) -> Column:
    """The least hashes of pairs of k-mer and number, each above its position."""
    # never null, since Spark sorts arrays that hold no nulls as plain longs
    at = lambda i: F.coalesce(F.get(kmers, i), F.lit(0).cast("long"))
    valued = lambda i, begin, n: _packed(F.xxhash64(F.shiftright(at(begin), POSITION), n), _low(at(i), POSITION))
    end = lambda j: F.coalesce(F.get(runs, j + 1), F.size(kmers))
    # first occurrences one by one, the others by runs: most runs have no others
    first = F.transform(runs, lambda begin: valued(begin, begin, F.lit(0)))
    longer = F.filter(F.transform(runs, lambda begin, j: F.when(end(j) > begin + 1, F.struct(begin.alias("begin"), (end(j) - begin - 1).alias("last")))), lambda run: run.isNotNull())
    others = F.flatten(F.transform(longer, lambda run: F.transform(F.sequence(F.lit(1), run["last"]), lambda n: valued(run["begin"] + n, run["begin"], n))))
    return F.slice(F.sort_array(F.concat(first, others)), 1, SAMPLE)


def _placed(least: Column) -> Column:
    """Identities (hashes) of the selected pairs, in the order of the text."""
    turned = lambda x: F.shiftleft(_low(x, POSITION), IDENTITY).bitwiseOR(F.shiftrightunsigned(x, 64 - IDENTITY))
    return F.transform(F.sort_array(F.transform(F.sequence(F.lit(0), F.size(least) - 1), lambda i: turned(F.get(least, i)))), lambda x: _low(x, IDENTITY))


def _tuples(sample: Column) -> Column:
    """For each hash function the hash of its least pairs, in the order of the text."""
    ranked = lambda i: F.slice(F.sort_array(F.transform(sample, lambda x, j: _packed(F.xxhash64(x, i), j))), 1, LENGTH)
    placed = F.transform(F.sequence(F.lit(0), F.lit(TUPLES - 1)), lambda i: F.sort_array(F.transform(ranked(i), lambda y: _low(y, POSITION))))
    return F.transform(placed, lambda places: _low(F.xxhash64(F.transform(places, lambda j: F.get(sample, j.cast("int")))), 32))


def signatures(df: DataFrame, texts: dict[str, str]) -> DataFrame:
    """``df`` with an array of ``TUPLES`` 32-bit hashes for each text column; ``texts`` leads from new names to texts.

    Each step is a projection of its own that uses the last one's arrays twice, so that Spark keeps the steps apart: a
    lambda reads its arrays anew for each element, and what stands inside a lambda's argument is interpreted.
    """
    own = fresh(df.columns)
    kept = [F.col(c) for c in df.columns if c.lower() not in {n.lower() for n in texts}]
    cut = rf"[^\s{UNSPACED}]{{1,{LETTER}}}|[{UNSPACED}]"
    column = lambda step, n: F.col(f"{own}{step}_{n}")
    step = df.select(*kept, *[F.regexp_extract_all(F.coalesce(F.col(t), F.lit("")), F.lit(cut), F.lit(0)).alias(f"{own}w_{n}") for n, t in texts.items()])
    step = step.select(*kept, *[_kmers(column("w", n)).alias(f"{own}k_{n}") for n in texts])
    step = step.select("*", *[_runs(column("k", n)).alias(f"{own}r_{n}") for n in texts])
    step = step.select(*kept, *[_least(column("k", n), column("r", n)).alias(f"{own}l_{n}") for n in texts])
    step = step.select(*kept, *[_placed(column("l", n)).alias(f"{own}s_{n}") for n in texts])
    return step.select(*kept, *[_tuples(column("s", n)).alias(n) for n in texts])


def written(signature: Column) -> Column:
    """A fingerprint as text: eight hexadecimal digits for each tuple."""
    return F.lower(F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of tuples in which two signatures agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.lit(float(TUPLES))


def successors(ids: DataFrame, key: str) -> DataFrame:
    """``ids`` with the next greater ``key`` as column next: the least one follows the greatest. Keys are distinct and not null.

    Keys are ranged over partitions, in each of which a window leads from key to key; only the least key of each
    partition (as many rows as partitions) is ordered in one task.
    """
    spark = ids.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = materialize(ids.repartitionByRange(parts, key).withColumn("sillon_part", F.spark_partition_id()), "ranged")
    firsts = ranged.groupBy("sillon_part").agg(F.min(key).alias("first"))
    after = firsts.withColumn("after", F.lead("first").over(Window.orderBy("sillon_part"))).drop("first")
    first = ranged.agg(F.min(key).alias("sillon_first"))
    inside = ranged.withColumn("sillon_lead", F.lead(key).over(Window.partitionBy("sillon_part").orderBy(key)))
    placed = inside.join(F.broadcast(after), "sillon_part").join(F.broadcast(first))
    return placed.withColumn("next", F.coalesce("sillon_lead", "after", "sillon_first")).drop("sillon_part", "sillon_lead", "after", "sillon_first")


def compare_edits(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprints of texts and of the same texts with their last quarter replaced by the beginning of the next document.

    Columns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next. Rows that repeat a
    doc_id are judged one by one; as somebody's next document the least of their texts counts. Rows without a doc_id have
    the first document as their next (where no row has one: the least of themselves) and are nobody's next. Texts are
    shuffled once (twice where documents are too many to broadcast who follows whom); of a next document only the
    characters go along that its predecessor's quarter asks for.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.withColumn("slot", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))
    ids = materialize(docs.groupBy("slot", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.floor(F.char_length("text") / 4)).cast("int").alias("quarter")), "ids")
    named = ids.filter("doc_id is not null")
    nameless = ids.filter("doc_id is null").join(F.broadcast(named.agg(F.min("doc_id").alias("next"))))
    chain = successors(named, "doc_id").unionByName(nameless).withColumn("next_slot", F.coalesce(F.col("next").cast("string"), F.lit("-")))
    chain = materialize(chain.select("slot", "next_slot", "n", "quarter"), "chain")
    lenders = chain.groupBy(F.col("next_slot").alias("slot")).agg(F.collect_list(F.struct(F.col("slot").alias("to"), "quarter")).alias("lends"))  # to two slots at most
    few = chain.count() <= CHAIN_ROWS
    lending = docs.join(F.broadcast(lenders), "slot") if few else dealt_join(docs, lenders, "slot", "text", ids.select("slot", "n"))
    # the beginning of the least text is the least beginning
    heads = lending.select("text", F.explode("lends").alias("lend")).groupBy(F.col("lend.to").alias("slot")).agg(F.min(F.left("text", F.col("lend.quarter"))).alias("head"))
    met = dealt_join(docs, chain.select("slot", "next_slot", "n").join(heads, "slot"), "slot", "text", ids.select("slot", "n"))
    own = F.floor(F.char_length("text") / 4).cast("int")
    edited = met.select("doc_id", "slot", "next_slot", "n", "text", F.concat(F.left("text", F.char_length("text") - own), F.left("head", own)).alias("edited"))
    signed = signatures(
        edited.withColumns({"n_chars": F.char_length("text").cast("long"), "edited_sha256": F.sha2("edited", 256), "least": F.when(F.col("n") > 1, F.col("text"))}),
        {"signature": "text", "edited_signature": "edited"},
    )
    signed = materialize(signed.drop("text", "edited"), "signed")
    single = signed.filter("n = 1").select(F.col("slot").alias("next_slot"), F.col("signature").alias("next_signature"))
    several = signed.filter("n > 1").groupBy(F.col("slot").alias("next_slot")).agg(F.min_by("signature", "least").alias("next_signature"))
    heard = chain.groupBy("next_slot").agg(F.sum("n").alias("n"))
    both = dealt_join(signed.drop("n", "least"), single.unionByName(several), "next_slot", "slot", heard)
    return both.select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("signature")).alias("fingerprint"), written(F.col("edited_signature")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"), likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )
