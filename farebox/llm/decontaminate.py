"""Verbatim benchmark passages in documents, by suffix arrays over the training words.

Each slice of documents in a task is a shard: its words get a suffix array, sorted as deep as
a window. Every suffix of every item is looked up by binary search; one that shares a whole window
with the shard gives an interval of the suffix array and so all places. Only the places at which a
match begins, where the words before differ, are taken out of the interval, by runs of equal words
before; from each the longest verbatim match is followed byte by byte. So a passage that repeats itself
costs no more than its maximal matches, however many windows lie in them.

A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is
one window. Words are runs of digits, letters a-z and all characters beyond ASCII, after A-Z
were lower-cased. Matches never cross rows.

The items are worked through in blocks of a stated size, one pass over the documents for each,
so what a task holds doesn't grow with the benchmark. Documents are never shuffled.

Null and empty texts have no words and no hits. An empty benchmark leaves every document clean.
Repeated documents and items count each on their own; items with equal ids count once, items
with a null id hit words but aren't listed. Other columns stay; one that is named like a result
is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from farebox.llm.arrays import append_columns, fresh, text_buffer

WINDOW = 13
# Text bytes of benchmark items that a task holds at a time.
BLOCK_BYTES = 8 << 20

_CODES = np.arange(256, dtype=np.uint8)
LOWER = np.where((_CODES >= 65) & (_CODES <= 90), _CODES + 32, _CODES).astype(np.uint8)
IN_WORD = ((LOWER >= 48) & (LOWER <= 57)) | ((LOWER >= 97) & (LOWER <= 122)) | (LOWER >= 128)
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)
SYMBOL_BITS = np.uint64(21)


@dataclass
class Words:
    """Words of many rows. Word w of row r: limits[r] <= w < limits[r + 1]."""

    low: np.ndarray  # lower-cased bytes
    starts: np.ndarray
    ends: np.ndarray
    limits: np.ndarray
    hashes: np.ndarray
    stop: np.ndarray  # end of the word's row, as a word number
    triple: np.ndarray  # three symbols from here on; 0 beyond the row

    def text(self, word: int, count: int) -> list[bytes]:
        return [self.low[self.starts[w] : self.ends[w]].tobytes() for w in range(word, word + count)]


def split_words(texts: pa.Array) -> Words:
    raw, offsets = text_buffer(texts)
    low, inside = LOWER[raw], IN_WORD[raw]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    filled = offsets[:-1][offsets[1:] > offsets[:-1]]
    begin[filled] = inside[filled]
    last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    end[last] = inside[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    limits = np.searchsorted(starts, offsets)
    hashes = word_hashes(low, starts, ends)
    symbols = np.maximum((hashes * np.uint64(0x9E3779B97F4A7C15)) >> (np.uint64(64) - SYMBOL_BITS), np.uint64(1))
    stop = np.repeat(limits[1:], np.diff(limits))
    triple = symbols.copy()
    for step in (1, 2):
        triple <<= SYMBOL_BITS
        ahead = np.arange(step, len(symbols) + step)
        here = np.flatnonzero(ahead < stop)
        triple[here] |= symbols[here + step]
    return Words(low, starts, ends, limits, hashes, stop, triple)


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of each word, modulo 2**64, from prefix sums."""
    power = np.full(len(low), BASE, np.uint64)
    power[:1] = 1
    np.cumprod(power, out=power)
    power *= low
    prefix = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(power, out=prefix[1:])
    back = np.full(len(low), INVERSE, np.uint64)
    back[:1] = 1
    np.cumprod(back, out=back)
    return (prefix[ends] - prefix[starts]) * back[starts]


def suffix_array(words: Words, depth: int) -> np.ndarray:
    """Word numbers in the order of their suffixes, compared over ``depth`` words at least."""
    order = np.argsort(words.triple, kind="stable")
    value = words.triple[order]
    head = np.ones(len(order), bool)
    head[1:] = value[1:] != value[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0)) + 1
    tied = np.flatnonzero(~head | ~np.append(head[1:], True))
    done = 3
    while done < depth and len(tied):
        p = order[tied]
        ahead = np.minimum(p + done, len(order) - 1)
        second = np.where(p + done < words.stop[p], rank[ahead], 0)
        group = rank[p]
        by = np.lexsort((second, group))
        p, group, second = p[by], group[by], second[by]
        order[tied] = p
        head = np.ones(len(tied), bool)
        head[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        rank[p] = tied[np.maximum.accumulate(np.where(head, np.arange(len(tied)), 0))] + 1
        more = (~head | ~np.append(head[1:], True)) & (second > 0)
        tied = tied[more]
        done *= 2
    return order


class Lookup:
    """Binary search of item suffixes in the suffix array of a shard."""

    def __init__(self, shard: Words, items: Words, depth: int):
        self.shard, self.items = shard, items
        self.order = suffix_array(shard, depth)

    def _value(self, place: np.ndarray, ahead: int) -> np.ndarray:
        word = self.order[place] + ahead
        inside = word < self.shard.stop[self.order[place]]
        return np.where(inside, self.shard.triple[np.minimum(word, len(self.order) - 1)], 0)

    def _first(self, low, high, ahead, bound):
        """First place in [low, high) whose triple ``ahead`` words on is at least ``bound``."""
        low, high = low.copy(), high.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_]) // 2
            less = self._value(middle, ahead) < bound[open_]
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]

    def narrow(self, query, low, high, ahead, count):
        """The part of each interval whose next ``count`` (1 to 3) words are the query's."""
        shift = SYMBOL_BITS * (np.uint64(3) - count.astype(np.uint64))
        least = (self.items.triple[query + ahead] >> shift) << shift
        low = self._first(low, high, ahead, least)
        return low, self._first(low, high, ahead, least + (np.uint64(1) << shift))

    def longest(self, query: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
        """Words that each item suffix has in common with its best place in the shard, ``most`` at most."""
        length = np.zeros(len(query), np.int64)
        end = self.items.stop[query] - query
        end = end if most is None else np.minimum(end, most)
        low, high = np.zeros(len(query), np.int64), np.full(len(query), len(self.order), np.int64)
        live, ahead = np.arange(len(query)), 0
        while len(live):
            live = live[end[live] > ahead]
            left = np.minimum(end[live] - ahead, 3)
            whole = np.zeros(len(live), bool)
            for count in (3, 2, 1):
                at = np.flatnonzero((left >= count) & (length[live] == ahead))
                if len(at):
                    who = live[at]
                    a, b = self.narrow(query[who], low[who], high[who], ahead, np.full(len(at), count))
                    found = a < b
                    length[who[found]] = ahead + count
                    if count == 3:
                        low[who], high[who] = np.where(found, a, low[who]), np.where(found, b, high[who])
                        whole[at[found]] = True
            live, ahead = live[whole], ahead + 3
        return length

    def places(self, query: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of the suffix array whose words begin with each query's first ``size`` words."""
        low, high = np.zeros(len(query), np.int64), np.full(len(query), len(self.order), np.int64)
        for ahead in range(0, int(size.max(initial=0)), 3):
            at = np.flatnonzero((size > ahead) & (low < high))
            count = np.minimum(size[at] - ahead, 3)
            low[at], high[at] = self.narrow(query[at], low[at], high[at], ahead, count)
        return low, high

    def heads(self, query: np.ndarray, size: np.ndarray, before: np.ndarray, shard_before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the query, word of the shard) of the places that aren't preceded by the query's word ``before``."""
        low, high = self.places(query, size)
        at = np.flatnonzero(low < high)
        low, high, before = low[at], high[at], before[at]
        ahead = shard_before[self.order]
        first = np.flatnonzero(np.diff(ahead, prepend=-9))  # of each run of equal words before
        run = np.cumsum(np.diff(ahead, prepend=-9) != 0) - 1
        owner, runs = spread(run[low], run[high - 1] + 1)
        last = np.append(first, len(ahead))[1:]
        begin, end = np.maximum(first[runs], low[owner]), np.minimum(last[runs], high[owner])
        other = ahead[begin] != before[owner]
        owner, begin, end = owner[other], begin[other], end[other]
        which, place = spread(begin, end)
        return at[owner[which]], self.order[place]


def spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, value) of all values of many ranges."""
    counts = high - low
    index = np.repeat(np.arange(len(low)), counts)
    return index, np.arange(len(index)) + np.repeat(low - (np.cumsum(counts) - counts), counts)


class Items:
    """A block of benchmark items, prepared once in a task."""

    def __init__(self, texts: list[str | None], window: int):
        self.words = words = split_words(pa.array(texts, pa.large_string()))
        number = np.repeat(np.arange(len(texts)), np.diff(words.limits))
        size = np.diff(words.limits)[number]
        word = np.arange(len(number))
        first = word == words.limits[:-1][number]
        is_window = np.where(size < window, first, word + window <= words.stop)
        self.item, self.query = number, word
        self.size = np.where(is_window, np.minimum(size, window), 0)
        self.depth = int(size.max(initial=0))
        self.joined = Joined(words)


class Joined:
    """The words of all rows with a space after each, so that equal words are equal bytes."""

    def __init__(self, words: Words):
        lengths = words.ends - words.starts + 1
        self.at = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        data = np.full(int(self.at[-1]), 32, np.uint8)
        inside = np.ones(len(data), bool)
        inside[self.at[1:] - 1] = False
        _, source = spread(words.starts, words.ends)
        data[inside] = words.low[source]
        self.data = data
        pieces = [None, pa.py_buffer(self.at), pa.py_buffer(data)]
        self.values = pa.Array.from_buffers(pa.large_binary(), len(lengths), pieces)


def before_words(words: Words, number: np.ndarray, none: int) -> np.ndarray:
    """The number of the word before each word, ``none`` at the start of a row."""
    out = np.full(len(number), none, np.int64)
    out[1:] = number[:-1]
    starts = words.limits[:-1][np.diff(words.limits) > 0]
    out[starts] = none
    return out


def common_words(a: Joined, b: Joined, x: int, y: int, most: int) -> int:
    """How many words from word x of ``a`` and word y of ``b`` on are equal, ``most`` at most."""
    length = int(a.at[x + most] - a.at[x])
    left, right = a.data[a.at[x] : a.at[x] + length], b.data[b.at[y] : b.at[y] + length]
    if len(right) == length and np.array_equal(left, right):
        return most
    size = min(len(left), len(right))
    differ = left[:size] != right[:size]
    end = int(differ.argmax()) if differ.any() else size
    # Whole words before the first byte that differs; the space after each belongs to it.
    return int(np.searchsorted(a.at, a.at[x] + end, "right")) - 1 - x


def find_matches(texts: pa.Array, items: Items) -> tuple[Words, np.ndarray, np.ndarray]:
    """Maximal matches as rows (item, word of the item, word of the document, words), by document row."""
    shard = split_words(texts)
    none = np.zeros((0, 4), np.int64)
    if not len(shard.starts) or not items.depth:
        return shard, np.zeros(0, np.int64), none
    lookup = Lookup(shard, items.words, int(items.size.max(initial=0)))
    wanted = np.flatnonzero(items.size > 0)
    # How far beyond a window a match goes is seen from its first place; here a whole window decides.
    wanted = wanted[lookup.longest(wanted, items.size[wanted]) >= items.size[wanted]]
    joined = Joined(shard)
    known = joined.values.dictionary_encode()
    shard_number = known.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    item_number = pc.index_in(items.joined.values, value_set=known.dictionary).fill_null(-4).to_numpy(zero_copy_only=False).astype(np.int64)
    # A window that is a short item whole begins at its first word; no word goes before.
    before = before_words(items.words, item_number, -3)[wanted]
    index, place = lookup.heads(wanted, items.size[wanted], before, before_words(shard, shard_number, -1))
    query = wanted[index]
    most = np.minimum(items.words.stop[query] - query, shard.stop[place] - place)
    enough = most >= items.size[query]
    query, place, most = query[enough], place[enough], most[enough]
    length = np.array([common_words(items.joined, joined, q, p, m) for q, p, m in zip(query.tolist(), place.tolist(), most.tolist())], np.int64)
    good = np.flatnonzero(length >= items.size[query]) if len(query) else np.zeros(0, np.int64)
    if not len(good):
        return shard, np.zeros(0, np.int64), none
    query, place, length = query[good], place[good], length[good]
    row = np.searchsorted(shard.limits, place, "right") - 1
    item = items.item[query]
    found = np.stack([item, query - items.words.limits[item], place - shard.limits[row], length], axis=1)
    by = np.lexsort((found[:, 0], found[:, 2], row))
    return shard, row[by], found[by]


def match_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    out: tuple[str, str] = ("n_words", "matches"),
    keep: list[str] | None = None,
) -> DataFrame:
    """Add the number of words of each text and its maximal verbatim matches with benchmark items.

    A match holds ``item``, ``item_word`` and ``doc_word`` (from 0) and ``words``. Items are
    split by hash into blocks of about ``block_bytes``, each collected on its own.
    """
    words, matches = out
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {words.lower(), matches.lower()}]
    source, part, before = fresh(docs, "text_of", "found", "found_before")
    docs = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(source))
    items = benchmark.select(F.col(f"`{item}`").alias("item"), F.col(f"`{item_text}`").alias("text"))
    items = items.where(F.length("text") > 0)
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-size // block_bytes))
    kind = items.schema["item"].dataType
    match = T.StructType(
        [T.StructField("item", kind)] + [T.StructField(c, T.LongType()) for c in ("item_word", "doc_word", "words")]
    )
    fields = T.StructType([T.StructField(words, T.LongType()), T.StructField(part, T.ArrayType(match))])
    for k in range(count):
        block = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k).collect()
        held = keep + [before] * (k > 0) + [source] * (k < count - 1)
        docs = append_columns(docs, source, fields, matcher(block, kind, window), keep=held)
        found = F.col(part) if not k else F.concat(before, part)
        name = before if k < count - 1 else matches
        docs = docs.withColumn(part, found).drop(before).withColumnRenamed(part, name)
    return docs.select(*[F.col(f"`{c}`") for c in [*keep, words, matches]])


def matcher(block: list, kind: T.DataType, window: int):
    ids, texts = [r.item for r in block], [r.text for r in block]
    ready: list[Items] = []

    def run(texts_in: pa.Array) -> list[pa.Array]:
        if not ready:
            ready.append(Items(texts, window))
        shard, row, found = find_matches(texts_in, ready[0])
        names = pa.array(ids, to_arrow_type(kind)).take(pa.array(found[:, 0]))
        columns = [names] + [pa.array(found[:, k]) for k in (1, 2, 3)]
        structs = pa.StructArray.from_arrays(columns, ["item", "item_word", "doc_word", "words"])
        limits = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts_in)))]).astype(np.int32)
        return [pa.array(np.diff(shard.limits).astype(np.int64)), pa.ListArray.from_arrays(pa.array(limits), structs)]

    return run


def n_hit(matches: str):
    """Words inside any match of the row."""
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(m["doc_word"].alias("s"), (m["doc_word"] + m["words"]).alias("e"))))
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))

    def add(a, x):
        new = F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(a["upto"], x["s"]))
        return F.struct(F.greatest(a["upto"], x["e"]).alias("upto"), (a["n"] + new).alias("n"))

    return F.aggregate(spans, start, add, lambda a: a["n"])


def item_list(matches: str):
    """Ids of the items with a match, as strings in order."""
    ids = F.transform(matches, lambda m: m["item"].cast("string"))
    return F.array_sort(F.array_distinct(F.filter(ids, lambda i: i.isNotNull())))


def contaminated(words, hits):
    """At least a twentieth of the words are hit."""
    return (hits > 0) & (20 * hits >= words)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents that aren't contaminated, with the columns they had."""
    words, matches = fresh(docs, "n_words", "matches")
    marked = match_benchmark(docs, benchmark, text, out=(words, matches), **options)
    clean = marked.where(~contaminated(F.col(words), n_hit(matches)))
    return clean.select(*[F.col(f"`{c}`") for c in docs.columns])
