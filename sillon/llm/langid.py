"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds all substrings of a bounded sample of labelled texts, each of them whole. A
text is parsed greedily into phrases, each the longest match in the automaton; the number of phrases, times the bits of a
pointer into the sample, is the text's description length. The language that needs fewest normalised phrases wins.

Texts are lower-cased; letters map to symbols, runs of anything else to one separator. So that thousands of places advance
together, texts are parsed in segments of ``SEGMENT`` symbols, at first as if a phrase began at each; then each segment is
parsed again from the state in which its predecessor ends, until it meets its first parse, which mostly takes a few
symbols. The phrases are those of a parse from the first symbol to the last, whatever the segments.

Cases: a null or empty text, or one without a letter (marks alone are none), is ``und`` with score 0; so is every text where there is no
labelled row to learn from; ties go to the language first in alphabetical order; repeated rows get equal results; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
import unicodedata
import uuid
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import add_columns, kept, texts_of

#: The sample of a language: documents and characters in all, at most. Texts are taken whole; one that doesn't fit is
#: passed over, and where none fits the shortest is taken.
SAMPLE_DOCS = 128
SAMPLE_SYMBOLS = 40_000
#: Parts of a language's texts of which the least are found first.
SAMPLE_PARTS = 16
#: Symbols of a segment, and of the texts whose segments are parsed together.
SEGMENT = 512
TOGETHER = 1 << 19
#: Parses that go on one by one, since so few don't pay for steps of all together.
FEW = 32
UNDETERMINED = "und"
#: Letters a phrase on the average, below which no learned language explains a text; less in languages whose own texts
#: fall short, see ``least_phrases``.
LEAST_PHRASE = 2.0
#: Shorter texts are never rejected for their phrases.
LEAST_LETTERS = 40

_SEPARATOR, _UNKNOWN = 0, 1


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """The transitions of the suffix automaton of a symbol sequence; state 0 is the root."""
    trans: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        cur = len(trans)
        trans.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in trans[p]:
            trans[p][c] = cur
            p = link[p]
        if p >= 0:
            q = trans[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(trans)
                trans.append(dict(trans[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and trans[p].get(c) == q:
                    trans[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return trans


#: Spreads keys over the slots of a table.
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Transitions:
    """All automata's transitions in one open hash table, from state and symbol; probes end at an empty slot."""

    def __init__(self, keys: np.ndarray, to: np.ndarray):
        size = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - size), (1 << size) - 1
        self.keys, self.to = np.full(1 << size, -1, dtype=np.int64), np.zeros(1 << size, dtype=np.int32)
        left, slots = np.arange(len(keys)), self._slots(keys)
        while len(left):
            _, first = np.unique(slots, return_index=True)
            first = first[self.keys[slots[first]] < 0]
            self.keys[slots[first]], self.to[slots[first]] = keys[left[first]], to[left[first]]
            rest = np.ones(len(left), dtype=bool)
            rest[first] = False
            left, slots = left[rest], (slots[rest] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _SPREAD) >> self.shift).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The states that keys lead to, -1 where there is no transition."""
        slots = self._slots(keys)
        seen = self.keys.take(slots)
        out = np.where(seen == keys, self.to.take(slots), np.int32(-1))
        left = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(left):
            slots_left = (slots[left] + 1) & self.mask
            slots[left] = slots_left
            seen, wanted = self.keys.take(slots_left), keys[left]
            hit = seen == wanted
            out[left[hit]] = self.to[slots_left[hit]]
            left = left[~hit & (seen >= 0)]
        return out

    def next(self, key: int) -> int:
        """``find`` for one key."""
        slot = (key * int(_SPREAD) & 0xFFFFFFFFFFFFFFFF) >> int(self.shift)
        while (seen := self.keys.item(slot)) != key:
            if seen < 0:
                return -1
            slot = (slot + 1) & self.mask
        return self.to.item(slot)


@dataclass
class Model:
    """Languages, symbols of letters, and the transitions of all automata."""

    languages: list[str]
    letters: dict[str, int]
    transitions: Transitions
    #: For each language and symbol: the state in which a phrase that begins with the symbol goes on.
    begins: np.ndarray
    #: Each language's state in which a text begins and any symbol begins a phrase.
    fresh: np.ndarray
    bits: np.ndarray
    #: Letters a phrase below which a language doesn't explain a text.
    least: np.ndarray

    def symbol_table(self) -> np.ndarray:
        """The symbol of each code point."""
        out = np.where(_categories() > 0, _UNKNOWN, _SEPARATOR).astype(np.int32)
        for letter, symbol in self.letters.items():
            out[ord(letter)] = symbol
        return out


@lru_cache(maxsize=1)
def _categories() -> np.ndarray:
    """For each code point: 2 for a letter, 1 for a mark, else 0."""
    kind = {"L": 2, "M": 1}
    return np.fromiter((kind.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), dtype=np.int8, count=0x110000)


def _squeezed(symbols: np.ndarray) -> np.ndarray:
    """Runs of separators as one."""
    if not len(symbols):
        return symbols
    keep = np.ones(len(symbols), dtype=bool)
    keep[1:] = (symbols[1:] != _SEPARATOR) | (symbols[:-1] != _SEPARATOR)
    return symbols[keep]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _model(samples: dict[str, list[str]]) -> Model:
    counts = Counter(c for texts in samples.values() for x in texts for c in x.lower() if unicodedata.category(c)[0] in "LM")
    letters = {c: 2 + i for i, (c, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0])))}
    width = 2 + len(letters)
    languages = sorted(samples)
    begins, fresh, bits, at = np.zeros((len(languages), width), dtype=np.int32), [], [], 0
    keys, to = [], []
    for begin, language in zip(begins, languages, strict=True):
        line: list[int] = [_SEPARATOR]
        for x in samples[language]:
            line += _squeezed(np.array([letters.get(c, _SEPARATOR) for c in x.lower() + " "], dtype=np.int32)).tolist()
        trans = suffix_automaton(line)
        fresh.append(at + len(trans))  # a last state without transitions, in which any symbol begins a phrase
        begin[:] = fresh[-1]  # a symbol that the sample lacks is a phrase of its own
        for s, state in trans[0].items():
            begin[s] = at + state
        for state, row in enumerate(trans):
            keys += [(at + state) * width + s for s in row]
            to += [at + state for state in row.values()]
        bits.append(math.log2(max(2, len(line))))
        at += len(trans) + 1
    transitions = Transitions(np.array(keys, dtype=np.int64), np.array(to, dtype=np.int32))
    return Model(languages, letters, transitions, begins, np.array(fresh, dtype=np.int32), np.array(bits), np.zeros(len(languages)))


def least_phrases(samples: dict[str, list[str]], bits: np.ndarray) -> np.ndarray:
    """Letters a phrase that each language asks for: ``LEAST_PHRASE``, or less where its own texts reach little more.

    Every second text of a sample is parsed by the others. A text that nothing explains has one letter a phrase; half
    the way from there to what the held-out texts reach is enough. Matches grow with the logarithm of the sample, and so
    does the least length asked for.
    """
    parser = Parser(_model({k: v[::2] for k, v in samples.items()}))
    out = np.full(len(samples), LEAST_PHRASE * (float(bits.min()) if len(bits) else 0.0) / math.log2(SAMPLE_SYMBOLS))
    for i, language in enumerate(sorted(samples)):
        counts, letters = parser.phrases(samples[language][1::2])
        if counts[i].sum():
            out[i] = min(out[i], 1 + (letters.sum() / counts[i].sum() - 1) / 2)
    return out


def train(samples: dict[str, list[str]]) -> Model:
    """The model of some texts by language."""
    model = _model(samples)
    model.least = least_phrases(samples, model.bits)
    return model


class Parser:
    """A model ready to parse texts."""

    def __init__(self, model: Model):
        self.model = model
        self.symbols = model.symbol_table()
        #: Whether a code point is a letter; marks have symbols, but a text of marks alone has no letter.
        self.is_letter = _categories() == 2

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text by language, and its letters."""
        points = [_points(x) for x in texts]
        rows = [_squeezed(self.symbols[p]) for p in points]
        letters = np.array([int(np.count_nonzero(r)) if self.is_letter[p].any() else 0 for r, p in zip(rows, points, strict=True)], dtype=np.int64)
        counts = np.zeros((len(self.model.languages), len(texts)), dtype=np.int64)
        at = [i for i in range(len(texts)) if letters[i]] if self.model.languages else []
        while at:
            n, size = 0, 0
            while n < len(at) and (not n or size + len(rows[at[n]]) <= TOGETHER):
                size += len(rows[at[n]])
                n += 1
            counts[:, at[:n]] = self._parsed([rows[i] for i in at[:n]])
            at = at[n:]
        return counts, letters

    def _parsed(self, rows: list[np.ndarray]) -> np.ndarray:
        """Phrases of each row of symbols by language."""
        m = self.model
        parts, owner = [], []
        for i, r in enumerate(rows):
            for a in range(0, len(r), SEGMENT):
                owner.append(i)
                parts.append(r[a : a + SEGMENT])
        owner = np.array(owner)
        lengths = np.array([len(p) for p in parts])
        order = np.argsort(-lengths, kind="stable")
        place = np.empty(len(parts), dtype=np.int64)
        place[order] = np.arange(len(parts))
        lengths = lengths[order]
        grid = np.zeros((len(parts), int(lengths[0])), dtype=np.int32)
        for k, i in enumerate(order):
            grid[k, : len(parts[i])] = parts[i]
        columns = np.ascontiguousarray(grid.T)
        width = m.begins.shape[1]
        state = np.repeat(m.fresh[:, None], len(parts), axis=1)
        counts = np.zeros(state.shape, dtype=np.int32)
        # segments that follow another one, and the ones before them; only their first parses are kept
        follows = np.flatnonzero(owner[1:] == owner[:-1])
        by_place = np.argsort(place[follows + 1])
        later, before = place[follows + 1][by_place], place[follows][by_place]
        states = np.zeros((columns.shape[0] if len(later) else 0, len(m.languages), len(later)), dtype=np.int32)
        begun = np.zeros(states.shape, dtype=bool)
        live = np.searchsorted(-lengths, -np.arange(columns.shape[0]), side="left")
        followed = np.searchsorted(later, live)
        for t in range(columns.shape[0]):
            k = live[t]
            column = columns[t, :k]
            to = m.transitions.find((state[:, :k].astype(np.int64) * width + column).ravel()).reshape(len(m.languages), k)
            ends = to < 0
            counts[:, :k] += ends
            state[:, :k] = np.where(ends, m.begins[:, column], to)
            if n := followed[t]:
                states[t, :, :n], begun[t, :, :n] = state[:, later[:n]], ends[:, later[:n]]
        entry = np.repeat(m.fresh[:, None], len(later), axis=1)
        while True:
            language, item = np.nonzero(entry != state[:, before])
            if not len(item):
                break
            now = entry[language, item] = state[language, before[item]]
            t = 0
            while len(item):
                if len(item) <= FEW:
                    for x in zip(language.tolist(), item.tolist(), now.tolist(), strict=True):
                        self._alone(*x, t, columns, lengths, later, counts, state, states, begun)
                    break
                part = later[item]
                symbol = columns[t, part]
                to = m.transitions.find(now.astype(np.int64) * width + symbol)
                ends = to < 0
                now = np.where(ends, m.begins[language, symbol], to)
                counts[language, part] += ends.astype(np.int32) - begun[t, language, item]
                met = now == states[t, language, item]
                states[t, language, item], begun[t, language, item] = now, ends
                t += 1
                over = ~met & (lengths[part] == t)
                state[language[over], part[over]] = now[over]
                go = ~met & ~over
                language, item, now = language[go], item[go], now[go]
        out = np.zeros((len(m.languages), len(rows)), dtype=np.int64)
        np.add.at(out.T, owner[order], counts.T)
        return out

    def _alone(self, language: int, item: int, now: int, t: int, columns, lengths, later, counts, state, states, begun) -> None:
        """The rest of one segment's second parse, from its symbol ``t`` on."""
        part, width = int(later[item]), self.model.begins.shape[1]
        begins, old, was = self.model.begins[language], states[:, language, item], begun[:, language, item]
        symbols = columns[: lengths[part], part].tolist()
        more = 0
        for t in range(t, len(symbols)):  # noqa: B020, PLR1704
            to = self.model.transitions.next(now * width + symbols[t])
            ends = to < 0
            now = begins.item(symbols[t]) if ends else to
            more += ends - was.item(t)
            if now == old.item(t):
                was[t] = ends
                break
            old[t], was[t] = now, ends
        else:
            state[language, part] = now
        counts[language, part] += more

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[float], list[int]]:
        """Language, score, letters a phrase and letters of each text."""
        counts, letters = self.phrases(texts)
        names, scores, lengths = [], [], []
        weights = self.model.bits / self.model.bits.max() if len(self.model.bits) else self.model.bits
        for i, n in enumerate(letters.tolist()):
            if not n or not self.model.languages:
                names.append(UNDETERMINED)
                scores.append(0.0)
                lengths.append(0.0)
                continue
            need = counts[:, i] * weights
            best = int(np.argmin(need))
            names.append(self.model.languages[best])
            scores.append(float(1 / np.exp2(np.maximum(need[best] - need, -60)).sum()))
            lengths.append(n / float(counts[best, i]))
        return names, scores, lengths, letters.tolist()


def sample(labelled: DataFrame, text: str, lang: str, docs: int = SAMPLE_DOCS, chars: int = SAMPLE_SYMBOLS) -> dict[str, list[str]]:
    """Distinct texts with letters for each language, whole: at most ``docs`` of them and ``chars`` characters in all.

    Those with the least hashes are taken, so copies, however many, and texts without letters crowd out nothing. What the
    driver gathers is bounded for each language, as is the model that it makes of it.
    """
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("l"), F.col(text).alias("x"))
    tie = F.xxhash64("x")
    least = rows.select("l", F.xxhash64("x", F.lit(1)).alias("h"), tie.alias("tie"), F.char_length("x").alias("n")).distinct().withColumn("part", F.pmod("tie", F.lit(SAMPLE_PARTS)))
    for by in (("l", "part"), ("l",)):  # the least of each part first, so that a language's rows needn't meet in one task
        place = F.row_number().over(Window.partitionBy(*by).orderBy("h", "tie"))
        least = least.withColumn("place", place).filter(F.col("place") <= docs)
    by_language: dict[str, list] = {}
    for r in sorted(least.select("l", "place", "tie", "n").collect(), key=lambda r: (r.l, r.place)):
        by_language.setdefault(r.l, []).append(r)
    chosen = []
    for language, texts in by_language.items():
        room = chars
        for r in texts:
            if r.n <= room:
                chosen.append((language, r.tie))
                room -= r.n
        if room == chars:
            chosen.append((language, min(texts, key=lambda r: r.n).tie))
    if not chosen:
        return {}
    wanted = labelled.sparkSession.createDataFrame(chosen, "l string, tie long")
    drawn = rows.withColumn("tie", tie).join(F.broadcast(wanted), ["l", "tie"]).groupBy("l", "tie").agg(F.first("x").alias("x"))
    found: dict[str, list[tuple[int, str]]] = {}
    for r in drawn.collect():
        found.setdefault(r.l, []).append((r.tie, r.x))
    return {k: [x for _, x in sorted(v)] for k, v in found.items()}


def identify(docs: DataFrame, model: Model, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with columns lang_pred, score, phrase_letters and letters, by names that begin with ``prefix``; they replace clashing ones."""
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def start() -> Parser:
        return kept(("langid", name), lambda: Parser(shared.value))

    def run(batch, parser):
        names, scores, lengths, letters = parser.predict(texts_of(batch, text))
        return {f"{prefix}lang_pred": names, f"{prefix}score": scores, f"{prefix}phrase_letters": lengths, f"{prefix}letters": letters}

    return add_columns(docs, run, f"{prefix}lang_pred string, {prefix}score double, {prefix}phrase_letters double, {prefix}letters long", start)


def rejected(model: Model, lang_pred: Column, phrase_letters: Column, letters: Column) -> Column:
    """Whether no learned language explains a text: it has no letters, or enough of them and only short phrases.

    How short depends on the predicted language, see ``least_phrases``.
    """
    least = F.create_map(*[F.lit(v) for k, n in zip(model.languages, model.least.tolist(), strict=True) for v in (k, n)])[lang_pred] if model.languages else F.lit(0.0)
    return (lang_pred == UNDETERMINED) & (letters == 0) | (letters >= LEAST_LETTERS) & (phrase_letters < F.coalesce(least, F.lit(0.0)))
