"""Byte-level BPE as a monoid: encode parts of a piece, join neighbours, decode by concatenation.

A token sequence is the encoding of its bytes exactly if every pair of neighbours is the
encoding of its own bytes: merges go by rank, so the first merge over a token limit would also
happen with the two tokens alone. Encodings therefore form a monoid. To join two of them, only
a window around the seam is encoded anew, and it grows until the pairs at both of its edges
hold; all tokens outside are then proven stable.

Pieces of the pattern are encoded once per slice of text: short ones in lockstep as numpy rows,
longer ones from leaves that are joined level by level.

Null and empty texts give no ids and no bytes. Repeated rows give equal results. Other columns
stay; one named like the result is replaced. Ids that are null or not in the vocabulary decode
to nothing.
"""

from __future__ import annotations

import base64
import functools
import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farebox.llm.arrays import append_columns, fresh, list_array

# White space of the pattern as the tokenizer's regular expressions define it (fixed values).
SPACE = r"\t-\r \x85\xA0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Rows whose words can't simply be cut at single spaces; superset of the white space above.
_WS = r"[\x09-\x0d\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
RAGGED = f"(?s)^{_WS}|{_WS}$|{_WS} | {_WS}"

LEAF = 24
NEVER = np.int32(2**31 - 1)
ROWS = 1 << 15


class Vocabulary:
    """Ranks of a rank file, with the pairs that can merge as a hash table of fixed size."""

    def __init__(self, lines: bytes):
        ranks = (line.split() for line in lines.splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in ranks}
        size = max(self.ranks.values(), default=-1) + 1
        self.tokens = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.bytes = pa.array(self.tokens, pa.large_binary())
        single = [self.ranks[bytes([b])] for b in range(256)]
        self.single = np.array(single, np.int32)
        self._stable: dict[tuple[int, int], bool] = {}

    def pair(self, a: int, b: int) -> int | None:
        """Rank of the token that two tokens merge to."""
        return self.ranks.get(self.tokens[a] + self.tokens[b])

    @functools.cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash table of all pairs that merge: keys and ranks by slot. Decoding never builds it."""
        keys, values = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append((a << 32) | b)
                    values.append(rank)
        keys, values = np.array(keys, np.uint64), np.array(values, np.int32)
        bits = max(8, int(len(keys) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        slots, ranks = np.full(1 << bits, np.uint64(2**64 - 1)), np.full(1 << bits, NEVER)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(slots[slot] == np.uint64(2**64 - 1))
            at, first = np.unique(slot[free], return_index=True)
            placed = free[first]
            slots[at], ranks[at] = keys[placed], values[placed]
            left = np.ones(len(keys), bool)
            left[placed] = False
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & self.mask
        return slots, ranks

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair's token; NEVER where the pair can't merge."""
        slots, ranks = self.table
        keys = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        slot = self._slot(keys)
        out, found = ranks[slot], slots[slot]
        todo = np.flatnonzero((found != keys) & (found != np.uint64(2**64 - 1)))
        out[found != keys] = NEVER
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            found = slots[slot[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = ranks[slot[todo[hit]]]
            todo = todo[~hit & (found != np.uint64(2**64 - 1))]
        return out

    def encode_bytes(self, data: bytes) -> list[int]:
        """Encoding of a short stretch: lowest rank first, leftmost among equals."""
        tokens = [int(self.single[b]) for b in data]
        end = len(tokens)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        rank = [self.pair(a, b) for a, b in zip(tokens, tokens[1:])] + [None]
        heap = [(r, i) for i, r in enumerate(rank) if r is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if rank[i] != r:
                continue
            gone = after[i]
            tokens[i], after[i], rank[gone] = r, after[gone], None
            tokens[gone] = -1
            if after[i] < end:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0:
                    rank[left] = self.pair(tokens[left], tokens[right]) if right < end else None
                    if rank[left] is not None:
                        heapq.heappush(heap, (rank[left], left))
        return [t for t in tokens if t >= 0]

    def stable(self, a: int, b: int) -> bool:
        """Whether the two tokens stay as they are side by side."""
        known = self._stable.get((a, b))
        if known is None:
            if len(self._stable) > 100_000:
                self._stable.clear()
            known = self._stable[a, b] = self.encode_bytes(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the joined bytes of two encodings."""
        if not left or not right:
            return left + right
        i = j = 0
        window: list[int] = []
        while True:
            grow_left = i < len(left) and not self.stable(left[-i - 1], (window or right)[0])
            grow_right = j < len(right) and not self.stable((window or left)[-1], right[j])
            if not grow_left and not grow_right:
                return left[: len(left) - i] + window + right[j:]
            if not window:
                i, j = 1, 1
            else:
                i = min(len(left), 2 * i) if grow_left else i
                j = min(len(right), 2 * j) if grow_right else j
            seam = left[len(left) - i :] + right[:j]
            window = self.encode_bytes(b"".join(self.tokens[t] for t in seam))

    def reduce(self, parts: list[list[int]]) -> list[int]:
        """Join neighbours level by level until one encoding is left."""
        while len(parts) > 1:
            pairs = [self.join(a, b) for a, b in zip(parts[::2], parts[1::2])]
            parts = pairs + parts[len(parts) & ~1 :]
        return parts[0] if parts else []

    def encode_rows(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encodings of many short stretches in lockstep: flat ids, and ids per stretch."""
        width = int(lengths.max(initial=0))
        at = np.arange(width + 1)
        inside = at < lengths[:, None]
        tok = np.full(inside.shape, -1, np.int32)
        tok[inside] = self.single[raw[(starts[:, None] + at)[inside]]]
        rank = np.full(inside.shape, NEVER)
        both = inside[:, 1:]
        rank[:, :-1][both] = self.merged(tok[:, :-1][both], tok[:, 1:][both])
        after = np.broadcast_to(at + 1, tok.shape).astype(np.int16)
        before = np.broadcast_to(at - 1, tok.shape).astype(np.int16)
        rows = np.arange(len(tok))
        while len(rows):
            now = rank[rows]
            i = now.argmin(axis=1)
            low = now[np.arange(len(rows)), i]
            live = low != NEVER
            rows, i, low = rows[live], i[live], low[live]
            gone = after[rows, i]
            right = after[rows, gone]
            tok[rows, i], tok[rows, gone], rank[rows, gone] = low, -1, NEVER
            after[rows, i] = right
            more = right < lengths[rows]
            r, k, n = rows[more], i[more], right[more]
            before[r, n] = k
            rank[rows, i] = NEVER
            rank[r, k] = self.merged(low[more], tok[r, n])
            left = before[rows, i]
            more = left >= 0
            r, k = rows[more], left[more]
            rank[r, k] = self.merged(tok[r, k], low[more])
        kept = tok >= 0
        return tok[kept], kept.sum(axis=1)

    def encode_pieces(self, pieces: pa.Array, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
        """Encodings of pattern pieces: flat ids, and ids per piece."""
        pieces = pieces.cast(pa.large_binary())
        if not len(pieces):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        offsets = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
        raw = np.frombuffer(pieces.buffers()[2], np.uint8) if pieces.buffers()[2] else np.zeros(0, np.uint8)
        sizes = np.diff(offsets)
        leaves = np.maximum(1, -(-sizes // leaf))
        owner = np.repeat(np.arange(len(pieces)), leaves)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(leaves) - leaves, leaves)
        starts = offsets[owner] + number * leaf
        lengths = np.minimum(leaf, offsets[owner + 1] - starts)
        by_length = np.argsort(lengths, kind="stable")
        flat, counts = [], np.zeros(len(owner), np.int64)
        for k in range(0, len(owner), ROWS):
            block = by_length[k : k + ROWS]
            ids, counts[block] = self.encode_rows(raw, starts[block], lengths[block])
            flat.append(ids)
        ids = np.concatenate(flat)
        place = np.zeros(len(owner), np.int64)
        place[by_length] = np.cumsum(counts[by_length]) - counts[by_length]
        ids = gather(ids, place, counts)
        if leaves.max(initial=1) == 1:
            return ids, counts
        limit = np.concatenate([[0], np.cumsum(counts)])
        first = np.cumsum(leaves) - leaves
        out, sums = [], np.add.reduceat(counts, first)
        done = 0
        for p in np.flatnonzero(leaves > 1):
            low, high = first[p], first[p] + leaves[p]
            whole = self.reduce([ids[limit[q] : limit[q + 1]].tolist() for q in range(low, high)])
            out += [ids[done : limit[low]], np.array(whole, np.int32)]
            done, sums[p] = limit[high], len(whole)
        return np.concatenate([*out, ids[done:]]), sums


def wide(text: str) -> pa.Scalar:
    return pa.scalar(text, pa.large_string())


def gather(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The stretches ``values[start : start + count]`` one after the other."""
    shift = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    return values[shift + np.arange(len(shift))]


@functools.lru_cache(maxsize=2)
def vocabulary(lines: bytes) -> Vocabulary:
    """One per worker process and rank file."""
    return Vocabulary(lines)


@functools.lru_cache(maxsize=2)
def compiled(pattern: str) -> regex.Pattern:
    inner = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
    return regex.compile(inner)


def encode_texts(texts: pa.Array, vocab: Vocabulary, pattern: str, leaf: int = LEAF) -> pa.Array:
    """Ids of every text.

    Between two characters that aren't white space, a single space always begins a piece. Texts
    are thus cut at single spaces and each different word is encoded once; texts with other
    runs of white space are cut by the pattern itself.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ragged = pc.match_substring_regex(texts, RAGGED).to_numpy(zero_copy_only=False)
    find = compiled(pattern).findall
    if ragged.any():
        cut = [find(t.as_py()) if r else None for t, r in zip(texts, ragged)]
        words = pc.split_pattern(pc.if_else(pa.array(ragged), "", texts), " ")
        words = pa.array(
            [c if r else w.as_py() for c, r, w in zip(cut, ragged, words)], pa.large_list(pa.large_string())
        )
    else:
        words = pc.split_pattern(texts, " ")
    per_row = pc.list_value_length(words).to_numpy().astype(np.int64)
    coded = words.flatten().dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64) * 2 + 1
    begins = np.cumsum(per_row) - per_row
    code[begins[per_row > 0]] -= 1
    code[np.repeat(ragged, per_row)] &= ~1
    used, code = np.unique(code, return_inverse=True)
    plain = coded.dictionary.take(pa.array(used >> 1))
    spaced = pa.array(used & 1, pa.bool_())
    chunks = pc.binary_join_element_wise(pc.if_else(spaced, wide(" "), wide("")), plain, wide(""))
    whole = pc.utf8_is_alpha(plain).to_numpy(zero_copy_only=False)
    mixed = np.flatnonzero(~whole)
    cut = [find(c) for c in chunks.take(pa.array(mixed)).to_pylist()]
    parts = np.ones(len(used), np.int64)
    parts[mixed] = [len(c) for c in cut]
    pieces = pa.concat_arrays(
        [chunks.filter(pa.array(whole)), pa.array([p for c in cut for p in c], pa.large_string())]
    ).dictionary_encode()
    ids, counts = vocab.encode_pieces(pieces.dictionary, leaf)
    which = pieces.indices.to_numpy()
    # Pieces in the order of the chunks again.
    order = np.zeros(len(used), np.int64)
    order[whole] = np.arange(whole.sum())
    order[mixed] = whole.sum() + np.cumsum(parts[mixed]) - parts[mixed]
    which = gather(which, order, parts)
    starts = np.cumsum(counts) - counts
    chunk_ids = gather(ids, starts[which], counts[which])
    limit = np.concatenate([[0], np.cumsum(counts[which])])
    ends = np.cumsum(parts)
    chunk_start, chunk_count = limit[ends - parts], limit[ends] - limit[ends - parts]
    flat = gather(chunk_ids, chunk_start[code], chunk_count[code])
    limit = np.concatenate([[0], np.cumsum(chunk_count[code])])
    return list_array(flat.astype(np.int32), limit[begins + per_row] - limit[begins])


def encode(
    df: DataFrame, ranks: bytes, pattern: str, text: str = "text", ids: str = "ids", leaf: int = LEAF, keep: list[str] | None = None
) -> DataFrame:
    """Add the ids of every text. ``ranks`` is the content of a rank file, read on the driver."""
    fields = T.StructType([T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(texts):
        return [encode_texts(texts, vocabulary(ranks), pattern, leaf)]

    return append_columns(df, text, fields, run, keep=keep)


def decode_ids(rows: pa.Array, vocab: Vocabulary) -> pa.Array:
    """Bytes of every list of ids: the token bytes lie in order, so only limits are set."""
    counts = pc.fill_null(pc.list_value_length(rows), 0).to_numpy().astype(np.int64)
    flat = rows.flatten()
    known = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(vocab.tokens)))
    flat = pc.if_else(pc.fill_null(known, False), flat, pa.scalar(None, flat.type))
    taken = pc.fill_null(vocab.bytes.take(flat), b"")
    buffers = taken.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[taken.offset : taken.offset + len(taken) + 1]
    limits = offsets[np.concatenate([[0], np.cumsum(counts)])] if len(offsets) else np.zeros(len(counts) + 1, np.int64)
    data = buffers[2] if buffers[2] is not None else pa.py_buffer(b"")
    return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(limits.tobytes()), data]).cast(pa.binary())


def round_trip(
    df: DataFrame, ranks: bytes, pattern: str, text: str = "text", out: tuple[str, str] = ("ids", "decoded"), keep: list[str] | None = None
) -> DataFrame:
    """Add the ids of every text and the bytes that these ids decode to, in one pass of one worker."""
    kinds = [T.ArrayType(T.IntegerType()), T.BinaryType()]
    fields = T.StructType([T.StructField(name, kind) for name, kind in zip(out, kinds)])

    def run(texts):
        vocab = vocabulary(ranks)
        ids = encode_texts(texts, vocab, pattern)
        return [ids, decode_ids(ids, vocab)]

    return append_columns(df, text, fields, run, keep=keep)


def decode(df: DataFrame, ranks: bytes, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the bytes that every list of ids stands for."""
    keep = [c for c in df.columns if c.lower() != decoded.lower() or c == ids]
    names = [c for c in keep if c.lower() != decoded.lower()]
    source = fresh(df, "ids_in")[0]
    df = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{ids}`").alias(source))
    schema = T.StructType([f for f in df.schema if f.name != source] + [T.StructField(decoded, T.BinaryType())])

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                arrays = [part.column(c) for c in names] + [decode_ids(part.column(source), vocabulary(ranks))]
                yield pa.RecordBatch.from_arrays(arrays, names=names + [decoded])

    return df.mapInArrow(run, schema)
