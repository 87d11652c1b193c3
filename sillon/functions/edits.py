"""Edit distances and error counts, worked out for batches of pairs.

Distances are bit-parallel: one integer holds a row of the table, so a pair of n and m symbols takes n steps on m bits.
There is no limit on symbols or on how many are distinct.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .text import bounded_batches


def distance(a: Sequence, b: Sequence) -> int:
    """The Levenshtein distance of two sequences of hashable symbols."""
    begin, end = 0, 0
    most = min(len(a), len(b))
    while begin < most and a[begin] == b[begin]:
        begin += 1
    while end < most - begin and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[begin : len(a) - end], b[begin : len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    # bit i of rise and fall: whether the table grows or shrinks from row i to row i + 1
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    rise, fall, out = full, 0, len(a)
    for y in b:
        same = places.get(y, 0)
        diagonal = (((same & rise) + rise) ^ rise) | same
        up, down = fall | full & ~(diagonal | rise), rise & diagonal
        out += bool(up & last) - bool(down & last)
        up, down, same = up << 1 | 1, down << 1, same | fall
        rise, fall = (down | ~(same | up)) & full, up & same & full
    return out


@F.arrow_udf(LongType())
def _list_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else distance(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int64())


def token_distance(a: Column, b: Column) -> Column:
    """The Levenshtein distance of two arrays of tokens."""
    bounded_batches()
    return _list_distance(a, b)


def tokens(text: Column) -> Column:
    """The words of a normalised text."""
    return F.filter(F.split(text, " "), lambda t: t != "")


_COUNTS = StructType([StructField(c, LongType()) for c in ("word_errors", "reference_words", "char_errors", "reference_chars")])


@F.arrow_udf(_COUNTS)
def _counts(r: pa.Array, h: pa.Array) -> pa.Array:
    out = []
    for x, y in zip(r.to_pylist(), h.to_pylist(), strict=True):
        if x is None or y is None:
            out.append(None)
            continue
        (v, w), (c, d) = ([t for t in s.split(" ") if t] for s in (x, y)), (s.replace(" ", "") for s in (x, y))
        out.append({"word_errors": distance(v, w), "reference_words": len(v), "char_errors": distance(c, d), "reference_chars": len(c)})
    return pa.array(out, pa.struct([(f.name, pa.int64()) for f in _COUNTS]))


def error_counts(r: Column, h: Column) -> dict[str, Column]:
    """Edits and reference lengths, in words and in characters other than spaces, of a normalised reference and hypothesis."""
    bounded_batches()
    found = _counts(r, h)
    return {f.name: found[f.name] for f in _COUNTS}
