"""Secrets in texts: fixed patterns, and windows of high Shannon entropy.

Patterns (``assign``, ``access``, ``hex``) are matched leftmost and without overlaps by kind;
what fails a kind's length is dropped.

Entropy: candidates are maximal runs of letters, digits and ``+/_=-``. For each character class
a window slides over the parts of a candidate that lie in the class; the counts of its
characters and the sum of n log n change by the character that enters and the one that leaves,
so a step costs the same for every width. Windows over the class's bound that hold the groups of
characters the class asks for are merged to spans ``entropy_<class>``. Candidates on the allow
list (given strings or patterns: well-known hashes, words and names put together) give none, and
neither do spans that lie inside a pattern's span.

All is done on UTF-8 bytes, as every pattern is ASCII; spans count code points, end exclusive.
Null and empty texts have no spans. Repeated rows give equal spans. Other columns stay; one
that is named like the result is replaced. Text is scanned whole, of any length, in linear time.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farebox.llm.arrays import SPANS, SPANS_ARROW, append_columns, code_points, fresh, text_buffer

BASE_KINDS = ["assign", "access", "hex"]
ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

UPPER, LOWER, DIGIT = (frozenset(r) for r in (range(65, 91), range(97, 123), range(48, 58)))


@dataclass(frozen=True)
class CharClass:
    """Bytes of the class, window, least entropy in bits, and groups of which a window holds all."""

    name: str
    members: frozenset
    window: int
    bits: float
    groups: tuple


CLASSES = (
    CharClass("hex", DIGIT | frozenset(b"ABCDEFabcdef"), 20, 2.9, (DIGIT, frozenset(b"ABCDEFabcdef"))),
    CharClass("base36", DIGIT | LOWER, 24, 3.7, (DIGIT, LOWER)),
    CharClass("base32", DIGIT | UPPER, 16, 3.0, (DIGIT, UPPER)),
    CharClass("base64", DIGIT | LOWER | UPPER | frozenset(b"+/_=-"), 24, 3.9, (DIGIT, LOWER, UPPER)),
)
# Candidates that are no secrets: identifiers in 8-4-4-4-12 form, names in capitals, words joined by signs.
ALLOWED = (
    rb"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}",
    rb"[A-Z_]+",
    rb"[A-Za-z]+(?:[-_/+=]+[A-Za-z]+)*[0-9]{0,4}",
    rb"[0-9+/_=-]+",
)
SHORTEST = min(c.window for c in CLASSES)
_CANDIDATE = np.zeros(256, bool)
_CANDIDATE[list(DIGIT | LOWER | UPPER | frozenset(b"+/_=-"))] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True


def long_runs(raw: np.ndarray, inside: np.ndarray, limits: np.ndarray, least: int) -> np.ndarray:
    """(start, end) of the runs of ``inside`` bytes with at least ``least``; runs end with their row."""
    flags = np.zeros(len(raw) + 1, np.int8)
    flags[:-1] = inside[raw]
    change = np.flatnonzero(np.diff(flags, prepend=np.int8(0)))
    starts, ends = change[::2], change[1::2]
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    pieces = []
    for s, e in zip(starts, ends):
        cuts = [s, *limits[np.searchsorted(limits, s, "right") : np.searchsorted(limits, e, "left")], e]
        pieces += [(a, b) for a, b in zip(cuts, cuts[1:]) if b - a >= least]
    return np.array(pieces, np.int64).reshape(-1, 2)


@cache
def step_tables(cls: CharClass) -> tuple[list[float], float, list[tuple[int, ...]]]:
    """n log n by count, the most that its sum may reach, and the groups of each byte."""
    width = cls.window
    plogp = [0.0] + [n * math.log2(n) for n in range(1, width + 1)]
    # width * (log2(width) - bits) is the most that the sum of n log n may reach.
    most = width * (math.log2(width) - cls.bits) + 1e-9
    return plogp, most, [tuple(g for g, members in enumerate(cls.groups) if b in members) for b in range(256)]


def entropy_windows(data: bytes, cls: CharClass) -> list[tuple[int, int]]:
    """Merged windows of a candidate over the class's bound, as byte positions."""
    width, members, found = cls.window, cls.members, []
    plogp, most, groups = step_tables(cls)
    counts, total, held, begin = [0] * 256, 0.0, [0] * len(cls.groups), 0
    for i, byte in enumerate(data):
        if byte not in members:
            counts, total, held, begin = [0] * 256, 0.0, [0] * len(cls.groups), i + 1
            continue
        n = counts[byte]
        counts[byte] = n + 1
        total += plogp[n + 1] - plogp[n]
        for g in groups[byte]:
            held[g] += 1
        if i - begin == width:
            old = data[begin]
            n = counts[old]
            counts[old] = n - 1
            total += plogp[n - 1] - plogp[n]
            for g in groups[old]:
                held[g] -= 1
            begin += 1
        if i - begin == width - 1 and total <= most and all(held):
            if found and begin <= found[-1][1]:
                found[-1] = (found[-1][0], i + 1)
            else:
                found.append((begin, i + 1))
    return found


class Covered:
    """Whether a span lies inside one of many: by binary search in their starts and the furthest end so far."""

    def __init__(self, spans: list[tuple[int, int, str]]):
        spans = sorted(spans)
        self.starts = [s for s, _, _ in spans]
        self.reach = list(accumulate((e for _, e, _ in spans), max))

    def holds(self, start: int, end: int) -> bool:
        at = bisect_right(self.starts, start)
        return at > 0 and self.reach[at - 1] >= end


class Scanner:
    def __init__(self, classes: Iterable[CharClass] = CLASSES, allow: Iterable[str] = (), patterns: Iterable[bytes] = ALLOWED):
        self.classes = tuple(classes)
        self.allow = frozenset(a.encode() for a in allow)
        self.patterns = re.compile(b"|".join(b"(?:%s)" % p for p in patterns) or rb"(?!)")
        self.least = min((c.window for c in self.classes), default=1 << 62)

    def suppressed(self, candidate: bytes) -> bool:
        return candidate in self.allow or bool(self.patterns.fullmatch(candidate))

    def patterns_in(self, text: bytes) -> list[tuple[int, int, str]]:
        found = []
        if b"=" in text or b":" in text:
            found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_LEAST]
        if b"AKIA" in text:
            found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
        return found

    def entropy_in(self, candidate: bytes, start: int, covered: "Covered") -> list[tuple[int, int, str]]:
        if self.suppressed(candidate):
            return []
        found = []
        for cls in self.classes:
            for a, b in entropy_windows(candidate, cls):
                a, b = a + start, b + start
                if not covered.holds(a, b):
                    found.append((a, b, f"entropy_{cls.name}"))
        return found

    def scan(self, texts: pa.Array) -> pa.Array:
        """Spans of every text, by start and then kind as listed, base kinds first."""
        raw, limits = text_buffer(texts)
        data = raw.tobytes()
        order = {k: n for n, k in enumerate(BASE_KINDS + [f"entropy_{c.name}" for c in self.classes])}
        hexes, candidates = long_runs(raw, _HEX, limits, 16), long_runs(raw, _CANDIDATE, limits, self.least)
        hex_row, candidate_row = (np.searchsorted(limits, x[:, 0], "right") - 1 for x in (hexes, candidates))
        out = []
        for row in range(len(limits) - 1):
            low, high = int(limits[row]), int(limits[row + 1])
            text = data[low:high]
            base = self.patterns_in(text)
            a, b = np.searchsorted(hex_row, [row, row + 1])
            base += [(int(s) - low, int(e) - low, "hex") for s, e in hexes[a:b]]
            a, b = np.searchsorted(candidate_row, [row, row + 1])
            more = []
            if a < b:
                covered = Covered(base)
                for s, e in candidates[a:b].tolist():
                    more += self.entropy_in(data[s:e], s - low, covered)
            spans = sorted({*base, *more}, key=lambda x: (x[0], order[x[2]], x[1]))
            if not spans:
                out.append([])
                continue
            places = sorted({p for s, e, _ in spans for p in (s, e)})
            point = dict(zip(places, code_points(text, places)))
            out.append(
                [{"kind": k, "start": point[s], "end": point[e], "base": k in BASE_KINDS} for s, e, k in spans]
            )
        return pa.array(out, SPANS_ARROW)


def find_secrets(docs: DataFrame, text: str = "text", out: str = "secrets", keep: list[str] | None = None, **options) -> DataFrame:
    """Add the spans of every text: kind, start, end, and whether a pattern or the entropy found it."""
    scanner = Scanner(**options)
    return append_columns(docs, text, T.StructType([T.StructField(out, SPANS)]), lambda t: [scanner.scan(t)], keep=keep)


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]", **options) -> DataFrame:
    """The documents with every secret replaced by ``mark``; spans that overlap are replaced as one."""
    scanner = Scanner(**options)
    held = fresh(docs, "redacted")[0]

    def run(texts: pa.Array) -> list[pa.Array]:
        out = []
        for value, spans in zip(texts, scanner.scan(texts)):
            value, pieces, done = value.as_py(), [], 0
            for s in spans.as_py():
                if s["start"] >= done:
                    pieces += [value[done : s["start"]], mark]
                done = max(done, s["end"])
            out.append("".join([*pieces, value[done:]]) if pieces else value)
        return [pa.array(out, pa.string())]

    marked = append_columns(docs, text, T.StructType([T.StructField(held, T.StringType())]), run)
    columns = [F.col(f"`{held}`").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return marked.select(*columns)
