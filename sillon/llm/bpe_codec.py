"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct pretokens of a block of documents (``BLOCK_BYTES`` of text, or a longer document) that a worker hasn't met
before are laid end to end as one symbol sequence. An inverted index leads from each pair of adjacent tokens that merges
to the positions where it stands. Merges are applied in rank order, each to all its positions at once; each touches only
its two neighbours, whose new pairs enter the index. The ids are those of merging word by word, the left one of the lowest
rank first: where two positions of one merge overlap, the left one goes first, and where a merge could make a pair of
lower rank, as files whose ranks no training gave may have it, a word's other positions wait for their turn.

Cases: a null or empty text has no ids and decodes to no bytes; texts of any length are encoded whole; repeated rows
are encoded each; an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import kept, map_batches, texts_of
from .pretokens import CACHE_CHARS, CACHE_ENTRIES, pretokens, quiet_collector, unit_text, units

#: Letters by any version of Unicode.
_LETTERS = re.compile("[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
#: Bytes of text whose new pretokens are replayed together.
BLOCK_BYTES = 4 << 20


class Codec:
    """Encoder and decoder of a file of ranks."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        self.entries = entries
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.first = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.text_of = [str(i) for i in range(len(self.bytes_of))]
        self.size = len(self.bytes_of)
        found = {a * self.size + b: rank for token, rank in ranks.items() for i in range(1, len(token)) if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None}
        #: Every pair of tokens that merges, sorted, and what it merges to.
        self.pair_keys = np.array(sorted(found), dtype=np.int64)
        self.pair_to = np.array([found[k] for k in self.pair_keys.tolist()], dtype=np.int64)
        #: Whether a token is part of a pair that merges to one of lower rank.
        self.lowers = np.zeros(self.size, dtype=bool)
        for part in (self.pair_keys // self.size, self.pair_keys % self.size):
            self.lowers[part[self.pair_to < part]] = True
        self.words: dict[str, tuple[int, ...]] = {}
        self.units: dict[str, tuple[int, ...]] = {}

    def pairs_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The places in ``pair_keys`` of pairs, -1 where they don't merge."""
        key = a * self.size + b
        if not len(self.pair_keys):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, at, -1)

    def replay(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each word, by one replay of the merges over all of them."""
        symbols = self.first[np.frombuffer(b"".join(words), dtype=np.uint8)]
        n = len(symbols)
        if not n:
            return [()] * len(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        border = ends[(ends > 0) & (ends < n)]
        after[border - 1] = n  # neighbours end at a word's border
        before[border] = -1
        pair_of = np.full(n, -1)  # the place in ``pair_keys`` of the pair that begins at a position
        index: dict[int, list[np.ndarray]] = {}
        queue: list[tuple[int, int]] = []

        def put_back(where: np.ndarray) -> None:
            """Puts positions whose pairs are known into the index."""
            pairs = pair_of[where]
            order = np.argsort(pairs, kind="stable")
            where, pairs = where[order], pairs[order]
            begins = [0, *(np.flatnonzero(pairs[1:] != pairs[:-1]) + 1).tolist(), len(pairs)]
            for a, b in zip(begins, begins[1:]):  # noqa: B905
                pair = int(pairs[a])
                if pair in index:
                    index[pair].append(where[a:b])
                else:
                    index[pair] = [where[a:b]]
                    heapq.heappush(queue, (int(self.pair_to[pair]), pair))

        def enter(where: np.ndarray) -> None:
            """Puts positions into the index under the pairs that begin there."""
            pairs = self.pairs_of(symbols[where], symbols[after[where]])
            pair_of[where] = pairs
            where = where[pairs >= 0]
            if len(where):
                put_back(where)

        enter(np.flatnonzero(after < n))
        while queue:
            token, pair = heapq.heappop(queue)  # ranks are ids of what pairs merge to
            parts = index.pop(pair)
            while queue and queue[0][0] == token:  # other pairs that merge to it: places count, not pairs
                parts += index.pop(heapq.heappop(queue)[1])
            i = np.unique(np.concatenate(parts)) if len(parts) > 1 else np.sort(parts[0])
            i = i[pair_of[i] >= 0]
            i = i[self.pair_to[pair_of[i]] == token]
            if not len(i):
                continue
            if len(i) > 1 and self.lowers[token]:
                # a merge may make a pair that goes before the word's other positions: one position of each word at a time
                word = np.searchsorted(ends, i, side="right")
                again = np.concatenate(([False], word[1:] == word[:-1]))
                if again.any():
                    put_back(i[again])
                    i = i[~again]
            j = after[i]
            if len(i) > 1 and (j[:-1] == i[1:]).any():  # overlapping positions: the left one first
                keep, last = [], -1
                for a, b in zip(i.tolist(), j.tolist(), strict=True):
                    if a != last:
                        keep.append(a)
                        last = b
                i = np.array(keep)
                j = after[i]
            k = after[j]
            symbols[i], symbols[j], pair_of[j], after[i] = token, -1, -1, k
            has = k < n
            before[k[has]] = i[has]
            pair_of[i] = -1
            h = before[i]
            enter(np.concatenate((h[h >= 0], i[has])))
        alive = symbols >= 0
        ids = symbols[alive].tolist()
        stops = np.cumsum(alive)
        stops = np.where(ends > 0, stops[ends - 1], 0).tolist()
        return [tuple(ids[a:b]) for a, b in zip([0, *stops[:-1]], stops, strict=True)]

    def _learn(self, cut: list[list[str]]) -> list[str]:
        """Encodes the units of a block that are new, by one replay of the merges over their new pretokens; returns those too long to keep."""
        if len(self.units) > self.entries:
            self.units.clear()
        if len(self.words) > self.entries:
            self.words.clear()
        known, words = self.units, self.words
        new = set(filterfalse(known.__contains__, chain.from_iterable(cut)))
        # a unit of plain letters is one pretoken, and that of no other unit
        single = list(filter(_LETTERS, new))
        several = {u: pretokens(unit_text(u)) for u in new.difference(single)}
        new_words = list(set(chain.from_iterable(several.values())).difference(words))
        ids = self.replay([w.encode("utf-8", "surrogatepass") for w in chain(map(unit_text, single), new_words)])
        known.update(zip(single, ids))  # noqa: B905
        words.update(zip(new_words, ids[len(single) :], strict=True))
        known.update((u, tuple(chain.from_iterable(map(words.__getitem__, p)))) for u, p in several.items())
        for w in new_words:
            if len(w) > CACHE_CHARS:
                del words[w]
        return [u for u in new if len(u) > CACHE_CHARS]

    def encode_block(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text of a block."""
        cut = [units(x) if x else [] for x in texts]
        long = self._learn(cut)
        out = [list(chain.from_iterable(map(self.units.__getitem__, u))) for u in cut]
        for u in long:
            del self.units[u]
        return out

    def release(self) -> None:
        """Gives up the caches."""
        self.words.clear()
        self.units.clear()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def codec(path: str, entries: int = CACHE_ENTRIES) -> Codec:
    """The codec of a file, with caches of about so many entries, kept while the worker needs it."""

    def build() -> Codec:
        made = Codec(path, entries)
        quiet_collector()
        return made

    return kept(("codec", path, entries), build)


def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined up to about ``BLOCK_BYTES``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= BLOCK_BYTES:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Columns ``key`` and ``ids`` (array of int) of each text."""

    def run(batch, c):
        return {key: batch.column(key), "ids": c.encode_block(texts_of(batch, text))}

    return map_batches(docs.select(key, text), run, f"{key} {dict(docs.dtypes)[key]}, ids array<int>", lambda: codec(path), blocks)


def decode(encoded: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """Columns ``key`` and ``bytes`` of each id list; null ids decode to no bytes."""

    def run(batch, c):
        return {key: batch.column(key), "bytes": [c.decode(x or []) for x in batch.column(ids).to_pylist()]}

    return map_batches(encoded.select(key, ids), run, f"{key} {dict(encoded.dtypes)[key]}, bytes binary", lambda: codec(path))


def round_trip(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", entries: int = CACHE_ENTRIES, block: int | None = None) -> DataFrame:
    """Encodes each text, decodes the ids, and returns number of ids and digests of both.

    ``entries`` and ``block`` bound a worker's caches and the bytes of text (beside a longer document) whose new pretokens
    it replays together, where memory is short; the ids are the same.
    """
    schema = f"{key} {dict(docs.dtypes)[key]}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def parts(texts: list[str]) -> Iterator[list[str]]:
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or block is None or size + len(texts[to]) <= block):
                size += len(texts[to])
                to += 1
            yield texts[at:to]
            at = to

    def run(batch, c):
        name = c.text_of.__getitem__
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for part in parts(texts_of(batch, text)):
            for x in c.encode_block(part):
                out["n_tokens"].append(len(x))
                out["ids_sha256"].append(hashlib.sha256(" ".join(map(name, x)).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(c.decode(x)).hexdigest())
        return {key: batch.column(key)} | out

    return map_batches(docs.select(key, text), run, schema, lambda: codec(path, entries), blocks)
