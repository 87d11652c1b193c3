"""Benchmark decontamination with one Aho-Corasick automaton.

Windows of consecutive item words, normalised and joined by spaces, make up one automaton. Each document is normalised
the same way and scanned once; a match's place leads through word numbers to character offsets of the original text.

Words are runs of ASCII letters and digits and of characters beyond ASCII, with A-Z lower-cased.

Cases: a null or empty text has no words and no hits; an item without words has no windows; repeated items each count;
texts of any length are scanned whole; empty tables give empty results; clashing extra columns are ignored.

Memory: distinct windows are dealt by a hash over slices of about ``SLICE_BYTES`` normalised bytes. One slice, and so one
automaton, is the common case; a worker builds it once. Beyond it, a worker gathers about ``SPOOL_BYTES`` of texts, meets
the slices one after the other, each held alone, and unites the hits. The driver holds one slice at a time.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, fresh, kept, map_batches, materialize, texts_of

WINDOW = 10
#: Normalised bytes of one automaton's windows; a byte takes some 60 bytes of memory.
SLICE_BYTES = 4 << 20
#: Bytes of texts that meet the slices together, where there are several.
SPOOL_BYTES = 64 << 20

#: Words of an original text, whose A-Z aren't lower-cased yet.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes of words stand for themselves, A-Z in lower case; others become spaces.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """The normalised words of a text as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def windows_of(text: str, size: int = WINDOW) -> set[bytes]:
    """The normalised windows of an item; all its words where they are fewer than ``size``."""
    words = words_of(text)
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def build(windows: dict[bytes, list]) -> ahocorasick.Automaton:
    """An automaton whose values are (number of words, items). One character stands for one byte."""
    out = ahocorasick.Automaton()
    for w, items in windows.items():
        out.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, items))
    out.make_automaton()
    return out


def scan(automaton: ahocorasick.Automaton, words: list[bytes]) -> list[tuple[int, int, list]]:
    """The matches in a document's words: (first word, one past the last, items)."""
    line = f" {b' '.join(words).decode('latin-1')} "
    found, at, word = [], 0, 0
    for end, (n, items) in automaton.iter(line):
        word += line.count(" ", at, end)  # spaces before the one that ends the match: words so far
        at = end
        found.append((word - n, word, items))
    return found


def original_spans(text: str, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as character ranges of the original text, united where they touch."""
    if not hits:
        return []
    place = [m.span() for m in _WORD.finditer(text)]
    out: list[list[int]] = []
    last = -1
    for a, b in sorted(hits):
        if a <= last:
            out[-1][1] = max(out[-1][1], place[b - 1][1])
        else:
            out.append([place[a][0], place[b - 1][1]])
        last = max(last, b)
    return [(a, b) for a, b in out]


def _slices(benchmark: DataFrame, text: str, key: str, size: int, limit: int) -> list[Broadcast]:
    """The distinct windows, each with the sorted identifiers of its items, in slices of about ``limit`` bytes."""
    spark = benchmark.sparkSession

    def run(batch):
        found = [(w, k or "") for k, x in zip(batch.column("k").to_pylist(), texts_of(batch, "x"), strict=True) for w in sorted(windows_of(x, size))]
        return {"window": [w for w, _ in found], "item": [k for _, k in found]}

    pairs = map_batches(benchmark.select(F.col(key).cast("string").alias("k"), F.col(text).alias("x")), run, "window binary, item string")
    windows = materialize(pairs.groupBy("window").agg(F.sort_array(F.collect_list("item")).alias("items")), "windows")
    n = max(1, -(-(windows.agg(F.sum(F.length("window"))).first()[0] or 0) // limit))
    out = []
    for i in range(n):
        rows = windows.filter(F.pmod(F.xxhash64("window"), F.lit(n)) == i).toArrow()
        if rows.num_rows:
            out.append(spark.sparkContext.broadcast(dict(zip(rows.column("window").to_pylist(), rows.column("items").to_pylist(), strict=True))))
    return out


class _Automata:
    """The automata of broadcast slices; a worker keeps the last one built, which is the only one in the common case."""

    def __init__(self, slices: list[Broadcast]):
        self.slices = [(uuid.uuid4().hex, b) for b in slices]

    def __iter__(self) -> Iterator[ahocorasick.Automaton]:
        for name, b in self.slices:
            yield kept(("automaton", name), lambda b=b: build(b.value))


def _matches(texts: list[str], automata: _Automata) -> tuple[list[list[bytes]], list[list[tuple[int, int, list]]]]:
    """The words of each text and the matches in them."""
    words = [words_of(x) for x in texts]
    found: list[list[tuple[int, int, list]]] = [[] for _ in texts]
    for automaton in automata:
        for hits, w in zip(found, words, strict=True):
            if w:
                hits += scan(automaton, w)
    return words, found


def _gathered(batches: Iterable[pa.RecordBatch], automata: _Automata) -> Iterator[pa.RecordBatch]:
    """Batches as they come where there is one slice, else joined up to about ``SPOOL_BYTES``."""
    held: list[pa.RecordBatch] = []
    most = SPOOL_BYTES if len(automata.slices) > 1 else 0
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= most:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, text: str = "text", item: str = "item_id", limit: int = SLICE_BYTES) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, with all their columns."""
    automata = _Automata(_slices(benchmark, text, item, size, limit))

    def run(batch):
        return {hit: [bool(hits) for hits in _matches(texts_of(batch, text), automata)[1]]}

    hit = f"{fresh(docs.columns)}hit"
    return add_columns(docs, run, f"{hit} boolean", gather=lambda batches: _gathered(batches, automata)).filter(~F.col(hit)).select(*docs.columns)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, text: str = "text", key: str = "doc_id", item: str = "item_id", limit: int = SLICE_BYTES, spans: bool = False) -> DataFrame:
    """Words, words inside benchmark windows, and items found, of each document; with ``spans`` also the items' identifiers and the character ranges of the original text that are hit, as ``begin-end``."""
    automata = _Automata(_slices(benchmark, text, item, size, limit))
    schema = f"{key} {dict(docs.dtypes)[key]}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    schema += ", items array<string>, spans array<string>" * spans

    def run(batch):
        texts = texts_of(batch, text)
        words, found = _matches(texts, automata)
        out = {name: [] for name in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", *(("items", "spans") if spans else ()))}
        for x, w, hits in zip(texts, words, found, strict=True):
            hit = bytearray(len(w))
            for a, b, _ in hits:
                hit[a:b] = b"\1" * (b - a)
            items = sorted({i for h in {id(h[2]): h[2] for h in hits}.values() for i in h})
            values = [len(w), sum(hit), len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), bool(hits)]
            if spans:
                values += [items, [f"{a}-{b}" for a, b in original_spans(x, [(a, b) for a, b, _ in hits])]]
            for name, value in zip(out, values, strict=True):
                out[name].append(value)
        return {key: batch.column(key), **out}

    return map_batches(docs.select(key, text), run, schema, gather=lambda batches: _gathered(batches, automata))
