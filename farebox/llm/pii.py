"""Personal data in texts: fixed patterns, extended by a skip-chain conditional random field.

Patterns (``email``, ``ip``, ``card``, ``phone``) are matched leftmost and without overlaps by
kind; what fails a kind's rule is dropped.

Field: the tokens of a document are the pattern spans and all other stretches that look like one
(numbers with separators, addresses without a dotted host or spelled with "at" and "dot"). Labels
are the kinds and "none". Neighbouring tokens share a chain potential; tokens with equal digits,
equal last digits or equal letters share a skip potential, however far apart they are, linked
from one occurrence to the next. Pattern spans are observed. Loopy sum-product messages, a fixed
number of rounds over all documents of a slice at once, give the marginals of the others; a
likely kind adds a span. So a number once written as a phone number is found again where it
lacks the prefix.

Weights are fitted by pseudo-likelihood, with the pattern labels as teachers, on about
``FIT_DOCUMENTS`` documents, chosen by the hash of their id, and ``FIT_TOKENS`` tokens at most.

Everything is done on UTF-8 bytes, as all patterns are ASCII; spans count code points, end
exclusive. Null and empty texts have no spans. Repeated rows get equal spans. Other columns stay;
one that is named like the result is replaced. Texts are searched whole, in linear time.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farebox.llm.arrays import SPANS, SPANS_ARROW, append_columns, code_points, text_buffer

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["none", *KINDS]
FIT_DOCUMENTS = 20_000
FIT_TOKENS = 50_000
ROUNDS = 20
CERTAIN = 0.6
NEAR = 40
SUFFIX = 7

DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(rb"[A-Za-z0-9._%+-]*\Z")
LABEL = re.compile(rb"[A-Za-z0-9-]+")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
NUMBER = re.compile(rb"\+?\(?[0-9](?:[\x20().\-/]{0,2}[0-9])*")
SPELLED = re.compile(
    rb"[A-Za-z0-9._%+-]{1,64}(?:\x20?[\[(]\x20?at\x20?[\])]\x20?|\x20at\x20)[A-Za-z0-9-]{1,63}"
    rb"(?:(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]{1,63})+"
)
SPELLED_DOT = re.compile(rb"[\[(\x20]dot[\])\x20]")
LOCAL_BYTES = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# Words before a token that speak for a kind (fixed values).
CUES = {
    "email": ("mail", "email", "e-mail", "contact", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "tarjeta", "carte"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "telefon", "telefono"),
}


def emails(text: bytes) -> tuple[list, list]:
    """Addresses, and stretches with an at sign that fail for their host alone."""
    found, near, done, at = [], [], 0, text.find(b"@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_BYTES:
            start -= 1
        resume = at + 1
        if start < at:
            if m := DOMAIN.match(text, at + 1):
                found.append((start, m.end()))
                done = resume = m.end()
            elif m := LABEL.match(text, at + 1):
                near.append((start, m.end()))
        at = text.find(b"@", resume)
    return found, near


def luhn(digits: bytes) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d -= 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def small(part: bytes) -> bool:
    part = part.lstrip(b"0")
    return len(part) <= 3 and (not part or int(part) <= 255)


def ips(text: bytes, groups: list[tuple[int, int]]) -> list:
    """Four digit groups with single dots between them."""
    found, k = [], 0
    while k + 3 < len(groups):
        four = groups[k : k + 4]
        if all(b[0] == a[1] + 1 and text[a[1]] == 46 for a, b in zip(four, four[1:])):
            if all(small(text[a:b]) for a, b in four):
                found.append((four[0][0], four[3][1]))
            k += 4
        else:
            k += 1
    return found


def cards(text: bytes, groups: list[tuple[int, int]]) -> list:
    """Digit groups with single spaces or hyphens between them, taken as far as they go."""
    found, k = [], 0
    while k < len(groups):
        last = k
        size = groups[k][1] - groups[k][0]
        while last + 1 < len(groups) and groups[last + 1][0] == groups[last][1] + 1 and text[groups[last][1]] in b" -":
            last += 1
            size += groups[last][1] - groups[last][0]
        if 13 <= size <= 19 and luhn(b"".join(text[a:b] for a, b in groups[k : last + 1])):
            found.append((groups[k][0], groups[last][1]))
        k = last + 1
    return found


def phones(text: bytes) -> list:
    spans = [m.span() for m in PHONE.finditer(text)] if b"+" in text else []
    return [(a, b) for a, b in spans if 9 <= sum(48 <= c <= 57 for c in text[a:b]) <= 15]


@dataclass
class Token:
    row: int
    start: int
    end: int
    label: int  # of a pattern span; 0 for others
    keys: tuple
    features: np.ndarray


def pattern_spans(text: bytes, groups: list[tuple[int, int]]) -> tuple[list, list]:
    mail, near = emails(text)
    spans = [(0, a, b) for a, b in mail]
    spans += [(1, a, b) for a, b in ips(text, groups)]
    spans += [(2, a, b) for a, b in cards(text, groups)]
    spans += [(3, a, b) for a, b in phones(text)]
    return spans, near


N_FEATURES = 24


def features(text: bytes, start: int, end: int) -> np.ndarray:
    token = text[start:end]
    digits = bytes(c for c in token if 48 <= c <= 57)
    n, x = len(digits), np.zeros(N_FEATURES)
    x[0] = 1
    for k, sign in enumerate(b"+(- ./@"):
        x[1 + k] = sign in token
    parts = token.split(b".")
    four = len(parts) == 4 and all(p.isdigit() for p in parts)
    x[8], x[9] = four and all(map(small, parts)), four and not all(map(small, parts))
    x[10] = 13 <= n <= 19 and luhn(digits)
    for k, most in enumerate((6, 8, 12, 15, 16, 19)):
        if n <= most:
            x[11 + k] = 1
            break
    else:
        x[17] = 1
    x[18] = bool(re.search(rb"[0-9]{3}[- .][0-9]{4}\Z", token))
    x[19] = any(65 <= c <= 90 or 97 <= c <= 122 for c in token)
    before = text[max(0, start - 24) : start].decode("ascii", "ignore").lower().split()[-2:]
    for k, kind in enumerate(KINDS):
        x[20 + k] = any(w.strip(":.,;()") in CUES[kind] for w in before)
    return x


def token_keys(token: bytes) -> tuple:
    """What a token shares with others that mean the same."""
    low = re.sub(rb"\x20?[\[(]?\x20?\bat\b\x20?[\])]?\x20?", b"@", token.lower()) if b"@" not in token else token.lower()
    low = re.sub(rb"\x20?[\[(]?\x20?\bdot\b\x20?[\])]?\x20?", b".", low)
    if any(97 <= c <= 122 for c in low):
        return (b"l" + low, b"u" + low.split(b"@")[0])
    digits = bytes(c for c in token if 48 <= c <= 57)
    return (b"d" + digits, b"s" + digits[-SUFFIX:]) if len(digits) >= SUFFIX else (b"d" + digits,)


def find_tokens(texts: pa.Array) -> tuple[list[bytes], list[Token]]:
    """All tokens of the field by row and place, pattern spans with their labels."""
    raw, limits = text_buffer(texts)
    data = raw.tobytes()
    inside = (raw >= 48) & (raw <= 57)
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    filled = limits[1:] > limits[:-1]
    begin[limits[:-1][filled]] = inside[limits[:-1][filled]]
    end[limits[1:][filled] - 1] = inside[limits[1:][filled] - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    first = np.searchsorted(starts, limits)
    rows, tokens = [], []
    for row in range(len(limits) - 1):
        low, high = int(limits[row]), int(limits[row + 1])
        text = data[low:high]
        rows.append(text)
        groups = [(int(a) - low, int(b) - low) for a, b in zip(starts[first[row] : first[row + 1]], ends[first[row] : first[row + 1]])]
        spelled = b" at " in text or b"at)" in text or b"at]" in text
        spelled = spelled and SPELLED_DOT.search(text) is not None
        if not groups and b"@" not in text and not spelled:
            continue
        spans, near = pattern_spans(text, groups)
        if groups:
            near += [m.span() for m in NUMBER.finditer(text)]
        if spelled:
            near += [m.span() for m in SPELLED.finditer(text)]
        found = [(a, b, 1 + k) for k, a, b in spans]
        taken = sorted((a, b) for a, b, _ in found)
        done = 0
        for a, b in sorted(near):
            digits = sum(48 <= c <= 57 for c in text[a:b])
            if digits < SUFFIX and text[a:b].count(b".") != 3 and not any(c >= 64 for c in text[a:b]):
                continue
            while done < len(taken) and taken[done][1] <= a:
                done += 1
            if not any(s < b and e > a for s, e in taken[max(0, done - 1) : done + 3]):
                found.append((a, b, 0))
        for a, b, label in sorted(found):
            tokens.append(Token(row, a, b, label, token_keys(text[a:b]), features(text, a, b)))
    return rows, tokens


def edges(tokens: list[Token]) -> tuple[np.ndarray, np.ndarray]:
    """Chain and skip links as pairs of token numbers, left before right."""
    chain, skip, last = [], [], {}
    for k, token in enumerate(tokens):
        if k and tokens[k - 1].row == token.row and token.start - tokens[k - 1].end <= NEAR:
            chain.append((k - 1, k))
        linked = set()
        for key in token.keys:
            before = last.get((token.row, key))
            if before is not None and before not in linked:
                linked.add(before)
                skip.append((before, k))
            last[token.row, key] = k
    return np.array(chain, np.int64).reshape(-1, 2), np.array(skip, np.int64).reshape(-1, 2)


@dataclass
class Weights:
    unary: np.ndarray  # features x labels
    chain: np.ndarray  # labels x labels
    skip: np.ndarray

    @staticmethod
    def start() -> Weights:
        n = len(LABELS)
        unary = np.zeros((N_FEATURES, n))
        unary[0, 0] = 1.0
        return Weights(unary, np.zeros((n, n)), 3.0 * np.eye(n))


def fit(x: np.ndarray, label: np.ndarray, chain: np.ndarray, skip: np.ndarray, steps: int = 300) -> Weights:
    """Maximum of the pseudo-likelihood with a quadratic penalty, by gradient steps.

    Each token's label is predicted from its features and the labels of its neighbours. Skip
    links start from agreement and keep it where the sample has none.
    """
    w, n = Weights.start(), len(LABELS)
    if not len(x):
        return w
    one = np.eye(n)[label]
    prior = [w.unary.copy(), w.chain.copy(), w.skip.copy()]
    scale, speed = [np.zeros_like(p) for p in prior], 0.2
    for _ in range(steps):
        score = x @ w.unary
        for pairs, potential in ((chain, w.chain), (skip, w.skip)):
            if len(pairs):
                np.add.at(score, pairs[:, 1], one[pairs[:, 0]] @ potential)
                np.add.at(score, pairs[:, 0], one[pairs[:, 1]] @ potential.T)
        score -= score.max(axis=1, keepdims=True)
        p = np.exp(score)
        wrong = one - p / p.sum(axis=1, keepdims=True)
        slopes = [x.T @ wrong]
        for pairs in (chain, skip):
            g = np.zeros((n, n))
            if len(pairs):
                g = one[pairs[:, 0]].T @ wrong[pairs[:, 1]] + wrong[pairs[:, 0]].T @ one[pairs[:, 1]]
            slopes.append(g)
        slopes[2] = (slopes[2] + slopes[2].T) / 2
        for part, g, p0, s in zip((w.unary, w.chain, w.skip), slopes, prior, scale):
            g = g / len(x) - 1e-3 * (part - p0)
            s *= 0.95
            s += 0.05 * g * g
            part += speed * g / (np.sqrt(s) + 1e-3)
        speed *= 0.99
    return w


def marginals(w: Weights, x: np.ndarray, observed: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """Label probabilities of all tokens by loopy sum-product; pattern spans keep their label."""
    n = len(LABELS)
    unary = x @ w.unary
    fixed = observed > 0
    unary[fixed] = np.where(np.eye(n, dtype=bool)[observed[fixed]], 0.0, -60.0)
    links = [(chain, w.chain), (skip, w.skip)]
    source = np.concatenate([p for pairs, _ in links for p in (pairs[:, 0], pairs[:, 1])]).astype(np.int64)
    target = np.concatenate([p for pairs, _ in links for p in (pairs[:, 1], pairs[:, 0])]).astype(np.int64)
    back = np.concatenate(
        [np.arange(len(chain)) + len(chain), np.arange(len(chain)), 2 * len(chain) + len(skip) + np.arange(len(skip)), 2 * len(chain) + np.arange(len(skip))]
    ).astype(np.int64)
    potential = np.concatenate(
        [np.broadcast_to(m, (len(pairs), n, n)) for pairs, full in links for m in (full, full.T)]
    )
    message = np.zeros((len(source), n))
    belief = unary.copy()
    for _ in range(ROUNDS if len(source) else 0):
        belief = unary.copy()
        np.add.at(belief, target, message)
        out = (belief[source] - message[back])[:, :, None] + potential
        top = out.max(axis=1, keepdims=True)
        out = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
        out -= np.log(np.exp(out - out.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) + out.max(axis=1, keepdims=True)
        message = 0.5 * message + 0.5 * out
    belief = unary.copy()
    np.add.at(belief, target, message)
    belief -= belief.max(axis=1, keepdims=True)
    p = np.exp(belief)
    return p / p.sum(axis=1, keepdims=True)


def scan(texts: pa.Array, w: Weights) -> pa.Array:
    """Spans of every text, by kind as listed and then start."""
    rows, tokens = find_tokens(texts)
    spans = defaultdict(list)
    if tokens:
        observed = np.array([t.label for t in tokens])
        label = observed.copy()
        if (observed == 0).any():
            p = marginals(w, np.stack([t.features for t in tokens]), observed, *edges(tokens))
            best = p.argmax(axis=1)
            added = (observed == 0) & (best > 0) & (p[np.arange(len(best)), best] >= CERTAIN)
            label[added] = best[added]
        for t, k, base in zip(tokens, label, observed):
            if k:
                spans[t.row].append((int(k) - 1, t.start, t.end, bool(base)))
    out = []
    for row, text in enumerate(rows):
        found = sorted(spans.get(row, ()))
        places = sorted({p for _, a, b, _ in found for p in (a, b)})
        point = dict(zip(places, code_points(text, places)))
        out.append([{"kind": KINDS[k], "start": point[a], "end": point[b], "base": base} for k, a, b, base in found])
    return pa.array(out, SPANS_ARROW)


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", documents: int = FIT_DOCUMENTS, tokens: int = FIT_TOKENS) -> Weights:
    """Weights from a sample of about ``documents`` documents by the hash of their id.

    The driver gets ``tokens`` tokens at most, whole documents in the order of the hash but for
    the last one.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    share = min(1.0, documents / max(1, docs.select(F.lit(1)).count()))
    rows = rows.withColumn("draw", F.xxhash64("id").bitwiseAND((1 << 40) - 1)).where(F.col("draw") < int(share * (1 << 40)))

    def run(batches):
        for batch in batches:
            _, found = find_tokens(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([batch.column("draw")[t.row].as_py() for t in found], pa.int64()),
                    pa.array([batch.column("id_text")[t.row].as_py() for t in found], pa.string()),
                    pa.array([t.start for t in found], pa.int64()),
                    pa.array([t.end for t in found], pa.int64()),
                    pa.array([t.label for t in found], pa.int32()),
                    pa.array([list(t.keys) for t in found], pa.list_(pa.binary())),
                    pa.array([t.features.tolist() for t in found], pa.list_(pa.float64())),
                ],
                names=["draw", "id_text", "start", "end", "label", "keys", "x"],
            )

    schema = "draw long, id_text string, start long, end long, label int, keys array<binary>, x array<double>"
    rows = rows.select("draw", F.col("id").cast("string").alias("id_text"), "text").mapInArrow(run, schema)
    rows = rows.orderBy("draw", "id_text", "start", "end", "label").limit(tokens).collect()
    numbers: dict = {}
    found = [
        Token(numbers.setdefault((r.draw, r.id_text), len(numbers)), r.start, r.end, r.label, tuple(map(bytes, r["keys"])), np.array(r.x))
        for r in rows
    ]
    x = np.stack([t.features for t in found]) if found else np.zeros((0, N_FEATURES))
    return fit(x, np.array([t.label for t in found], np.int64), *edges(found))


def find_personal_data(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", out: str = "personal", keep: list[str] | None = None, weights: Weights | None = None
) -> DataFrame:
    """Add the spans of every text: kind, start, end, and whether a pattern or the field found it."""
    w = weights or learn(docs, doc_id, text)
    return append_columns(docs, text, T.StructType([T.StructField(out, SPANS)]), lambda t: [scan(t, w)], keep=keep)
