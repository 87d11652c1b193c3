"""Token counts by heap-and-linked-list byte-pair merging.

A pretoken's bytes form a doubly linked list; a heap holds the ranks of adjacent pairs. The lowest is popped again and
again and merged unless one of its symbols has changed meanwhile. The count is the number of first symbols minus the
number of merges; identifiers are never emitted.

Cases: a null or empty text has no tokens; texts of any length count whole; a special token's string counts as one
token, as the library takes it by default; repeated rows are counted each; an empty table gives an empty result;
further columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, map_batches, texts_of
from .pretokens import Cache, pretokens, quiet_collector, unit_text, units

#: A text of more tokens than this is over the limit.
LIMIT = 1024


def byte_letters() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies: printable Latin-1 bytes stand for themselves, others follow from code point 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Merger:
    """The merges of a tokenizer file of the kind byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.first = [0] * 256
        for letter, b in letters.items():
            self.first[b] = vocab[letter]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        special = [t["content"] for t in spec.get("added_tokens", ())]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.words = Cache(self.count_pretoken)
        self.units = Cache(self.count_unit)

    def release(self) -> None:
        """Gives up the caches, whose functions hold on to the merger."""
        self.words.clear()
        self.units.clear()

    def count_pretoken(self, pretoken: str) -> int:
        """Symbols minus merges of one pretoken."""
        symbols: list[int] = [self.first[b] for b in pretoken.encode("utf-8", "surrogatepass")]
        n = len(symbols)
        if n < 2:
            return n
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = self.merges
        heap = [(found[0], i, found[1]) for i in range(n - 1) if (found := merges.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(heap)
        count = n
        while heap:
            _, i, to = heapq.heappop(heap)
            j = after[i]
            if symbols[i] < 0 or j >= n:
                continue
            found = merges.get((symbols[i], symbols[j]))
            if found is None or found[1] != to:
                continue
            symbols[i], symbols[j] = to, -1
            after[i] = k = after[j]
            count -= 1
            if k < n:
                before[k] = i
                if found := merges.get((to, symbols[k])):
                    heapq.heappush(heap, (found[0], i, found[1]))
            if (h := before[i]) >= 0 and (found := merges.get((symbols[h], to))):
                heapq.heappush(heap, (found[0], h, found[1]))
        return count

    def count_unit(self, unit: str) -> int:
        return sum(map(self.words.__getitem__, pretokens(unit_text(unit))))

    def count(self, text: str) -> int:
        """Tokens of a whole text; each special string in it is one."""
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(self.count(x) for x in parts if x)
        return sum(map(self.units.__getitem__, units(text))) if text else 0


def merger(path: str) -> Merger:
    """The merger of a file, kept while the worker needs it."""

    def build() -> Merger:
        made = Merger(path)
        quiet_collector()
        return made

    return kept(("merger", path), build)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Bytes and tokens of each text by the byte-level BPE file ``path``, which each worker reads from its own disk."""
    schema = f"{key} {dict(docs.dtypes)[key]}, n_bytes long, n_tokens long"

    def run(batch, m):
        texts = texts_of(batch, text)
        return {key: batch.column(key), "n_bytes": [len(x.encode("utf-8", "surrogatepass")) for x in texts], "n_tokens": [m.count(x) for x in texts]}

    counted = map_batches(docs.select(key, text), run, schema, lambda: merger(path))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
