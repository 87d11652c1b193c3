"""Splitting text for byte-level byte-pair vocabularies, with reuse of what a worker has split before.

The split pattern never looks from one run of visible characters into another: a run with the space before it is split
alike wherever it stands. So a text is cut at its spaces into units first, and each distinct unit is split once.
"""

from __future__ import annotations

import gc
import re

import regex

#: Fixed value: the pattern that splits text before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_split = regex.compile(PATTERN).findall

#: Entries that a worker's cache may hold; beyond that it starts anew. Some 150 bytes each.
CACHE_ENTRIES = 500_000
#: Characters of the longest unit that is kept in a cache.
CACHE_CHARS = 200


def pretokens(text: str) -> list[str]:
    """The matches of the pattern."""
    return _split(text)


#: A lone space between visible characters; cutting before it splits no run of white space.
_cut = regex.compile(r"(?<=\S) (?=\S)")

#: A space inside a run of white space.
_inside = re.compile(r"\s \s").search


def units(text: str) -> list[str]:
    """Keys of pieces of ``text`` that, split one by one, give the same pretokens as the whole; see ``unit_text``.

    A cut inside a run of white space may split it otherwise. Where a text has such spaces, or some at an end, only lone
    spaces between visible characters are cut at.
    """
    pieces = text.split(" ")
    if "" in pieces or _inside(text):
        cuts = [m.start() for m in _cut.finditer(text)]
        pieces = [text[a:b] for a, b in zip([0, *[c + 1 for c in cuts]], [*cuts, len(text)], strict=True)]
    pieces[0] = " " + pieces[0]
    return pieces


def unit_text(key: str) -> str:
    """The piece of a key: keys leave out the space before a piece, and begin with one where a text begins."""
    return key[1:] if key[0] == " " else " " + key


def quiet_collector() -> None:
    """Makes the garbage collector walk a worker's large caches seldom; they hold no cycles."""
    gc.collect()
    gc.freeze()
    gc.set_threshold(100_000, 50, 1000)


class Cache(dict):
    """A dictionary that works out what it lacks and never holds more than ``entries``."""

    def __init__(self, work, entries: int = CACHE_ENTRIES, chars: int = CACHE_CHARS):
        super().__init__()
        self.work, self.entries, self.chars = work, entries, chars

    def __missing__(self, key):
        value = self.work(key)
        if len(key) <= self.chars:
            if len(self) >= self.entries:
                self.clear()
            self[key] = value
        return value
