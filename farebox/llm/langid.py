"""Language by cross-parsing: the reference text that describes a document in the fewest phrases.

For each language, a bounded sample of labelled text is turned into a suffix automaton. A text
is parsed from left to right into the longest phrases that occur in the reference; the number of
phrases times the bits that point out a phrase, per symbol, estimates the cross entropy. The
language with the smallest estimate wins, the alphabetically first among equals.

Texts are lower-cased; runs of anything but letters are one blank. They are cut into segments
that are parsed side by side, so that a step of the automata is a step of all segments and
languages at once; a phrase ends with its segment, for every language alike. A step is one look
into a table that leads on, or restarts at the root where no longer phrase exists. Each language has
its own letters, and one of very many letters a hash table, so a worker holds 32 MB for each at most.

The sample is ``REFERENCE`` characters of each language, of pieces of documents in the order of the
hash of id and piece number. Null texts and texts without a letter get ``und`` and score 0, as do all texts where
nothing was learned. The score is the runner-up's share of both estimates (0.5 to 1; 1 if there is
one language). Repeated rows get equal results. Other columns stay; one that is named like a
result is replaced.
"""

from __future__ import annotations

import math
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farebox.llm.arrays import append_columns, text_buffer
from farebox.llm.lookup import Lookup

REFERENCE = 40_000
# Characters of a piece, and ranges of the draw (as bits) in which characters are summed.
PIECE = 2000
DRAW_BITS = 16
SEGMENT = 512
# Cells of a language's table (32 MB); beyond it the transitions are hashed.
TABLE_CELLS = 8 << 20
UNKNOWN = "und"
SLICE = 2 << 20


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Lower-case letter of each code point; 0 where it isn't a letter."""
    table = np.zeros(0x110000, np.int32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def code_points(raw: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8 text, and the row limits among them."""
    lead = (raw & 0xC0) != 0x80
    starts = np.flatnonzero(lead)
    first = raw[starts].astype(np.int32)
    size = 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0).astype(np.int64)
    code = np.where(size == 1, first, first & (0xFF >> (size + 1)))
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        code[more] = (code[more] << 6) | (raw[starts[more] + k] & 0x3F)
    return code, np.searchsorted(starts, limits)


def normalised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters with one 0 for each run of other characters, and the row limits."""
    code, limits = code_points(*text_buffer(texts))
    code = letters()[code]
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] > 0) | (code[:-1] > 0)
    keep[limits[:-1][limits[1:] > limits[:-1]]] = True
    before = np.concatenate([[0], np.cumsum(keep)])
    return code[keep], before[limits]


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of each state; state 0 is the root, every path from it spells a substring."""
    steps, link, length, last = [{}], [-1], [0], 0
    for symbol in text:
        new = len(steps)
        steps.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and symbol not in steps[p]:
            steps[p][symbol] = new
            p = link[p]
        if p >= 0:
            q = steps[p][symbol]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(steps)
                steps.append(dict(steps[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and steps[p].get(symbol) == q:
                    steps[p][symbol] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return steps


class Automata:
    """The automata of all languages, each over its own letters.

    An automaton of few letters is a table of states by letters; one whose table would be over
    ``TABLE_CELLS`` is a hash table of its transitions, of which there are three per character at most.
    A step's value is twice the next state, and one more where a new phrase begins.
    """

    def __init__(self, references: dict[str, str], table_cells: int = TABLE_CELLS):
        self.languages = sorted(references)
        texts = [normalised(pa.array([references[x]], pa.large_string()))[0] for x in self.languages]
        self.bits = np.array([math.log2(len(t) + 2) for t in texts])
        self.symbols = np.unique(np.concatenate(texts)) if texts else np.zeros(0, np.int32)
        # Number of each symbol among a language's own; 0 for those that it lacks.
        self.own = np.zeros((len(texts), len(self.symbols) + 1), np.int32)
        self.dense: list[int] = []
        self.hashed: dict[int, tuple[Lookup, int, np.ndarray]] = {}
        tables, bases, widths, size = [], [], [], 0
        for k, text in enumerate(texts):
            mine = np.unique(text)
            self.own[k, np.searchsorted(self.symbols, mine) + 1] = np.arange(1, len(mine) + 1)
            steps, width = suffix_automaton((np.searchsorted(mine, text) + 1).tolist()), len(mine) + 1
            state = np.repeat(np.arange(len(steps)), [len(s) for s in steps])
            letter = np.array([a for s in steps for a in s], np.int64)
            onward = np.array([b for s in steps for b in s.values()], np.int64)
            # A missing step begins a new phrase with its symbol, or stays at the root.
            begin = np.ones(width, np.int32)
            at_root = state == 0
            begin[letter[at_root]] = 2 * onward[at_root] + 1
            if len(steps) * width <= table_cells:
                table = np.tile(begin, (len(steps), 1))
                table[state, letter] = 2 * onward
                tables.append(table.ravel())
                self.dense.append(k)
                bases.append(size)
                widths.append(width)
                size += table.size
            else:
                self.hashed[k] = Lookup(state * width + letter, (2 * onward).astype(np.int32)), width, begin
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)
        self.bases, self.widths = np.array(bases, np.int64)[:, None], np.array(widths, np.int64)[:, None]

    def nbytes(self) -> int:
        hashed = sum(x.keys.nbytes + x.values.nbytes + begin.nbytes for x, _, begin in self.hashed.values())
        return self.table.nbytes + self.own.nbytes + hashed

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The step of every language (rows of ``state``) with the symbol of each segment (its columns)."""
        own = self.own[:, symbol]
        if not self.hashed:
            return self.table[self.bases + state * self.widths + own]
        out = np.empty(state.shape, np.int32)
        if self.dense:
            out[self.dense] = self.table[self.bases + state[self.dense] * self.widths + own[self.dense]]
        for k, (onward, width, begin) in self.hashed.items():
            value, found = onward.get((state[k] * np.int64(width) + own[k]).astype(np.uint64))
            out[k] = np.where(found, value, begin[own[k]])
        return out

    def number(self, text: np.ndarray) -> np.ndarray:
        """Symbols of normalised text; 0 for those of no reference."""
        if not len(self.symbols):
            return np.zeros(len(text), np.int32)
        place = np.minimum(np.searchsorted(self.symbols, text), len(self.symbols) - 1)
        return np.where(self.symbols[place] == text, place + 1, 0).astype(np.int32)

    def phrases(self, text: np.ndarray, limits: np.ndarray) -> np.ndarray:
        """Phrases of every row in every language."""
        size = np.diff(limits)
        pieces = -(-size // SEGMENT)
        owner = np.repeat(np.arange(len(size)), pieces)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = limits[:-1][owner] + number * SEGMENT
        lengths = np.minimum(limits[1:][owner] - starts, SEGMENT)
        by = np.argsort(-lengths, kind="stable")
        starts, lengths, owner = starts[by], lengths[by], owner[by]
        symbols = self.number(text)
        active = np.searchsorted(-lengths, -np.arange(1, SEGMENT + 1), "right")
        state = np.zeros((len(self.languages), len(starts)), np.int32)
        found = np.ones(state.shape, np.int32)
        for t, n in enumerate(active):
            if not n:
                break
            step = self.step(state[:, :n], symbols[starts[:n] + t])
            found[:, :n] += step & 1
            # A segment's first symbol begins its first phrase and isn't a second one.
            if not t:
                found[:, :n] -= step & 1
            state[:, :n] = step >> 1
        out = np.zeros((len(self.languages), len(size)), np.int64)
        for k in range(len(self.languages)):
            out[k] = np.bincount(owner, found[k], len(size))
        return out

    def predict(self, texts: pa.Array) -> list[pa.Array]:
        text, limits = normalised(texts)
        size = np.diff(limits)
        letter = np.concatenate([[0], np.cumsum(text > 0)])
        known = letter[limits[1:]] > letter[limits[:-1]]
        if not self.languages:
            known[:] = False
        if not known.any():
            n = len(size)
            return [pa.array([UNKNOWN] * n, pa.string()), pa.array(np.zeros(n)), pa.nulls(n, pa.float64())]
        bits = self.phrases(text, limits) * self.bits[:, None] / np.maximum(size, 1)
        best = bits.argmin(axis=0)
        low = bits[best, np.arange(len(size))]
        if len(self.languages) > 1:
            second = np.partition(bits, 1, axis=0)[1]
            score = second / np.maximum(low + second, 1e-12)
        else:
            score = np.ones(len(size))
        names = np.where(known, np.array([*self.languages], object)[best], UNKNOWN)
        return [
            pa.array(names.tolist(), pa.string()),
            pa.array(np.where(known, score, 0.0)),
            pa.array(np.where(known, low, np.nan), from_pandas=True),
        ]


def held_out(doc_id: str) -> Column:
    """Rows that nothing is learned from: every fifth id by its checksum, and null ids."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{doc_id}`").cast("string")), F.lit(5)) == 0, F.lit(True))


def references(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", size: int = REFERENCE
) -> dict[str, str]:
    """``size`` characters of each language, from documents that aren't held out.

    Texts count as pieces of ``PIECE`` characters, each with a draw of its own from the hash of id
    and piece number, so one very long document is as good as many short ones. A first pass sums
    the characters of each language by ranges of the draw; the second takes the ranges up to the
    one in which ``size`` is reached (or all), so what is ordered is small and never short.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    rows = rows.where(~held_out("id")).where("lang IS NOT NULL AND length(text) > 0").withColumn("n", F.length("text"))
    pieces = F.sequence(F.lit(0), F.floor((F.col("n") - 1) / PIECE).cast("int"))
    length = F.least(F.lit(PIECE), F.col("n") - F.col("piece") * PIECE)

    def draw(piece: Column) -> Column:
        return F.xxhash64("id", piece).bitwiseAND((1 << 40) - 1)

    def place(piece: Column) -> Column:
        return F.shiftright(draw(piece), 40 - DRAW_BITS)

    sums = rows.select("lang", "id", "n", F.explode(pieces).alias("piece"))
    sums = sums.groupBy("lang", place(F.col("piece")).alias("place")).agg(F.sum(length).alias("n"))
    upto = Window.partitionBy("lang").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    last = sums.where(F.col("before") < size).groupBy("lang").agg(F.max("place").alias("last"))
    rows = rows.join(F.broadcast(last), "lang")
    # Numbers of pieces are chosen before texts are cut.
    rows = rows.withColumn("chosen", F.filter(pieces, lambda k: place(k) <= F.col("last")))
    rows = rows.select("lang", "id", "n", "text", F.explode("chosen").alias("piece"))
    cut = F.substring("text", F.col("piece") * PIECE + 1, F.lit(PIECE))
    rows = rows.select("lang", cut.alias("text"), length.alias("n"), draw(F.col("piece")).alias("draw"))
    order = Window.partitionBy("lang").orderBy("draw", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).where(F.col("before") < size)
    rows = rows.select("lang", "before", F.substring("text", F.lit(1), (size - F.col("before")).cast("int")).alias("text"))
    found: dict[str, list] = {}
    for row in rows.orderBy("lang", "before").collect():
        found.setdefault(row.lang, []).append(row.text)
    return {k: "\n".join(v) for k, v in found.items()}


# The automata that a worker process has ready, by the name its job gave them.
_READY: dict[str, Automata] = {}


def identify(
    docs: DataFrame, known: dict[str, str], text: str = "text", out: tuple[str, str, str] = ("lang_pred", "score", "bits"), keep: list[str] | None = None
) -> DataFrame:
    """Add language, score, and the estimated cross entropy in bits per symbol (null for ``und``)."""
    name = uuid.uuid4().hex

    def run(texts: pa.Array) -> list[pa.Array]:
        if name not in _READY:
            _READY.clear()
            _READY[name] = Automata(known)
        return _READY[name].predict(texts)

    kinds = [T.StringType(), T.DoubleType(), T.DoubleType()]
    fields = T.StructType([T.StructField(n, k) for n, k in zip(out, kinds)])
    return append_columns(docs, text, fields, run, SLICE, keep)
