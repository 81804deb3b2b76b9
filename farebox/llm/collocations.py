"""Phrases whose words come together more often than apart, from counts of one kind of window.

Every word opens one window: itself and the words that its lead columns find after it in the same
piece of text, padded with nulls at the piece's end. Only windows of the longest size are counted;
``ROLLUP`` over their columns gives all shorter phrases, as a phrase's count is the sum over the
windows that begin with it. The rollup's lowest level is the number of words of a language.

Before windows are shuffled they are cut where no frequent phrase can go on. A first pass counts
phrases of one to four words in 2 ** ``BIN_BITS`` bins by hash; a phrase in a bin under the least count is
rarer still. A window loses its words from the first such phrase on. All occurrences of a phrase are in
one bin, so what is cut is cut everywhere and counts that reach the least stay exact. No task holds
all bins: it writes those that it met, sorted and packed (some two bytes each) in blocks of neighbours, and a
block's counts are added up in one place. Which bins are full is a table of 2 ** ``TABLE_BITS`` bits
(32 MB) that is broadcast, neighbouring bins sharing a bit. With some hundred billion phrases or more
fewer windows are cut and more are shuffled; the results stay the same.

A phrase's score compares it with its two parts at the cut where they are commonest; arithmetic is
in decimals, and parts are joined by their text. A phrase that lies inside a longer one with nearly
the same count is dropped.

Null texts are empty, a null language is ``und``. Repeated rows count each. An empty table, and one
without frequent phrases, gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farebox.llm import words as W
from farebox.llm.arrays import slices, text_buffer
from farebox.session import materialize

LONGEST = 4
LEAST = 30
TOP = 2000
# A phrase is dropped for a longer one with this share (in hundredths) of its count.
SHARE = 80
BIN_BITS = 34
TABLE_BITS = 28
# Blocks are by the first bits of a bin.
BLOCK_BITS = 10
# Phrases whose bins a task gathers before it packs them.
HELD = 1 << 22
SLICE = 4 << 20

BREAK = np.zeros(256, bool)
BREAK[[*map(ord, ".,;:!?"), *range(0x0A, 0x0E)]] = True
IN_WORD = ~BREAK
IN_WORD[[0x20, 0x09]] = False
MIX = np.uint64(0x9E3779B97F4A7C15)


def cut_words(part: pa.RecordBatch) -> tuple[W.Pieces, np.ndarray]:
    """Words of all rows, A-Z lower-cased, and the piece of text that each is in."""
    raw, limits = text_buffer(part.column("text"))
    low = W.LOWER[raw]
    found = W.cut(low, limits, IN_WORD[low])
    breaks = np.cumsum(BREAK[low], dtype=np.int64)
    return found, (breaks[found.starts] if len(found.starts) else found.starts) + found.rows


def languages(part: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    known = part.column("lang").dictionary_encode()
    return known.dictionary, known.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def phrase_bins(
    found: W.Pieces, piece: np.ndarray, lang: tuple[pa.Array, np.ndarray], bin_bits: int, shortest: int = 2
) -> list[tuple[np.ndarray, np.ndarray]]:
    """(first word, bin) of the phrases of ``shortest`` words, one more, ..."""
    digest = np.array([xxhash.xxh3_64_intdigest(w) for w in found.values.to_pylist()], np.uint64)
    of = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in lang[0].to_pylist()], np.uint64)
    if not len(found.ids):
        return [(found.ids, found.ids)] * (LONGEST + 1 - shortest)
    word = digest[found.ids]
    code, out = word ^ of[lang[1][found.rows]], []
    for size in range(1, LONGEST + 1):
        count = max(len(word) - size + 1, 0)
        if size > 1:
            code = code[:count] * MIX
            code ^= code >> np.uint64(29)
            code ^= word[size - 1 :]
        if size >= shortest:
            begin = np.flatnonzero(piece[size - 1 :] == piece[:count])
            out.append((begin, ((code[begin] * MIX) >> np.uint64(64 - bin_bits)).astype(np.int64)))
    return out


def span_bits(bin_bits: int) -> int:
    """Bits of a bin's place in its block: a byte of the table has bins of one block only."""
    return max(bin_bits - BLOCK_BITS, 3)


def shared_bits(bin_bits: int) -> int:
    """Bits of a bin that the table leaves out."""
    return max(bin_bits - TABLE_BITS, 0)


def pack(bins: np.ndarray, full: int, bin_bits: int) -> list[tuple[int, int, bytes, bytes, bytes]]:
    """(block, low, high, rest, counts) of every block with bins; ``bins`` are sorted in place.

    A block's bins ascend. Their last ``low`` bits are in ``rest`` as they are; of the others ``high`` has the
    steps in unary, and ``counts`` how often each came, up to ``full``, in unary too.
    """
    if not len(bins):
        return []
    bins.sort()
    first = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
    times = np.minimum(np.diff(np.append(first, len(bins))), full)
    bins, span = bins[first], span_bits(bin_bits)
    low = min(max(bin_bits - len(bins).bit_length(), 0), span)
    blocks = bins >> span
    limits = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1]))
    out = []
    for begin, end in zip(limits.tolist(), [*limits[1:].tolist(), len(bins)]):
        own = (bins[begin:end] & ((1 << span) - 1)).astype("<u4")
        rest = np.unpackbits(own.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :low]
        high, counts = (own >> low) + np.arange(end - begin), np.cumsum(times[begin:end]) - 1
        out.append((int(blocks[begin]), low, at_bits(high), np.packbits(rest, bitorder="little").tobytes(), at_bits(counts)))
    return out


def at_bits(places: np.ndarray) -> bytes:
    """Bits that are set at the ascending places."""
    bits = np.zeros(int(places[-1]) + 1, np.uint8)
    bits[places] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def bit_places(bits: bytes) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))


def unpack(low: int, high: bytes, rest: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(places in the block, how often each came) of a row of :func:`pack`."""
    steps = bit_places(high)
    bits = np.zeros((len(steps), 32), np.uint8)
    bits[:, :low] = np.unpackbits(np.frombuffer(rest, np.uint8), count=len(steps) * low, bitorder="little").reshape(len(steps), low)
    lowest = np.packbits(bits, axis=1, bitorder="little").view("<u4").reshape(-1)
    return ((steps - np.arange(len(steps))) << low) + lowest, np.diff(bit_places(counts), prepend=-1)


def count_bins(docs: DataFrame, least: int, bin_bits: int, held: int = HELD) -> DataFrame:
    """(block, bits): the table's part for each block, which bins may hold a phrase that comes ``least`` times."""
    full, span, shared = max(min(least, 255), 1), span_bits(bin_bits), shared_bits(bin_bits)
    kinds = {"block": pa.int64(), "low": pa.int32(), "high": pa.binary(), "rest": pa.binary(), "counts": pa.binary()}

    def packed(bins: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = pack(bins, full, bin_bits)
        for k in range(0, len(rows), 1024):
            columns = zip(*rows[k : k + 1024])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], names=list(kinds))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, size = np.empty(held, np.int64), 0
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                found, piece = cut_words(part)
                for _, bins in phrase_bins(found, piece, languages(part), bin_bits, 1):
                    while len(bins):
                        some, bins = bins[: held - size], bins[held - size :]
                        gathered[size : size + len(some)] = some
                        size += len(some)
                        if size == held:
                            yield from packed(gathered)
                            size = 0
            pa.default_memory_pool().release_unused()
        yield from packed(gathered[:size])

    def table(block: int, found: list[np.ndarray]) -> pa.RecordBatch:
        bits = np.zeros(1 << (span - shared), np.uint8)
        bits[np.concatenate(found) >> shared] = 1
        bits = np.packbits(bits, bitorder="little").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bits], pa.binary())], names=["block", "bits"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total, found = None, np.zeros(1 << span, np.uint8), []
        for batch in batches:
            for block, low, high, rest, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if block != last:
                    if last is not None:
                        yield table(last, found)
                    last, found = block, []
                    total.fill(0)
                at, n = unpack(low, high, rest, counts)
                now = np.minimum(total[at] + n, full)
                total[at] = now
                found.append(at[now == full])
        if last is not None:
            yield table(last, found)

    rows = docs.mapInArrow(count, "block long, low int, high binary, rest binary, counts binary")
    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block long, bits binary")


def frequent_bins(docs: DataFrame, least: int, bin_bits: int = BIN_BITS) -> Broadcast:
    """The table of a fixed size over all bins, for the tasks."""
    span = span_bits(bin_bits)
    bits = np.zeros((1 << max(bin_bits - span, 0), (1 << (span - shared_bits(bin_bits))) // 8), np.uint8)
    for block, held in count_bins(docs, least, bin_bits).collect():  # at most a row per block
        bits[block] = np.frombuffer(held, np.uint8)
    return docs.sparkSession.sparkContext.broadcast(bits.reshape(-1))


def windows(docs: DataFrame, frequent: Broadcast, bin_bits: int = BIN_BITS) -> DataFrame:
    """(lang, w1, ..., n): every word with its lead columns, counted within slices of a task. A rare word is null."""
    shared = shared_bits(bin_bits)
    names = ["lang", *(f"w{k}" for k in range(1, LONGEST + 1)), "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = frequent.value
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                found, piece = cut_words(part)
                lang, of = languages(part)
                size, pad = len(found.ids), len(found.values)
                columns, open_ = [], np.ones(size, bool)
                for k, (begin, bins) in enumerate(phrase_bins(found, piece, (lang, of), bin_bits, 1)):
                    still = open_[begin]
                    begin, bins = begin[still], bins[still] >> shared
                    open_ = np.zeros(size, bool)
                    open_[begin] = bits[bins >> 3] >> (bins & 7) & 1
                    lead = np.full(size, pad)
                    lead[: max(size - k, 0)] = found.ids[k:]
                    columns.append(np.where(open_, lead, pad))
                key = of[found.rows]
                for column in columns:
                    key = W.joined(key, column, pad + 1)
                first = np.unique(key, return_index=True)[1]
                out = [lang.take(pa.array(of[found.rows[first]]))]
                for column in columns:
                    ids = column[first]
                    out.append(found.values.take(pa.array(ids, mask=ids == pad)).cast(pa.string()))
                out.append(pa.array(np.bincount(key, minlength=len(first)).astype(np.int64)))
                yield pa.RecordBatch.from_arrays(out, names=names)
            pa.default_memory_pool().release_unused()

    kinds = ", ".join(f"{c} {'long' if c == 'n' else 'string'}" for c in names)
    return docs.mapInArrow(run, kinds)


def phrase_counts(docs: DataFrame, least: int = LEAST, bin_bits: int = BIN_BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, words, f) of all phrases of one to four words that come ``least`` times, and (lang, n)."""
    columns = [f"w{k}" for k in range(1, LONGEST + 1)]
    counted = windows(docs, frequent_bins(docs, least, bin_bits), bin_bits).groupBy("lang", *columns).agg(F.sum("n").alias("n"))
    rolled = counted.rollup("lang", *columns).agg(F.sum("n").alias("f"), F.grouping_id().alias("level"))
    # A row's level has a bit for each column that was summed over; the last one left must be no padding.
    last = F.coalesce(*[F.when(F.col("level") == (1 << (LONGEST - k)) - 1, F.col(f"w{k}")) for k in range(1, LONGEST + 1)])
    whole = F.col("level") == (1 << LONGEST) - 1
    # The first of the two conditions holds on groups alone, so Spark drops padding before it shuffles.
    rolled = materialize(rolled.where(whole | last.isNotNull()).where(whole | (F.col("f") >= least)))
    words = F.filter(F.array(*columns), lambda w: w.isNotNull())
    phrases = rolled.where(~whole & F.col("w1").isNotNull()).select("lang", words.alias("words"), "f")
    return phrases, rolled.where(whole & F.col("lang").isNotNull()).select("lang", F.col("f").alias("n"))


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    least: int = LEAST,
    share: int = SHARE,
    top: int | None = TOP,
    bin_bits: int = BIN_BITS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases (None: all)."""
    content, of = F.col(f"`{text}`").cast("string"), F.col(f"`{lang}`").cast("string")
    docs = docs.select(F.coalesce(of, F.lit("und")).alias("lang"), F.coalesce(content, F.lit("")).alias("text"))
    phrases, totals = phrase_counts(docs, least, bin_bits)
    known = phrases.select("lang", F.array_join("words", " ").alias("phrase"), "words", F.col("f").alias("a"))
    candidates = known.where(F.size("words") > 1)
    sizes = F.sequence(F.lit(2), F.size("words") - 1)
    inner = F.flatten(
        F.transform(sizes, lambda m: F.transform(F.sequence(F.lit(1), F.size("words") - m + 1), lambda s: F.array_join(F.slice("words", s, m), " ")))
    )
    longer = candidates.where(F.size("words") > 2).select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = candidates.join(longer, ["lang", "phrase"], "left")
    kept = kept.where(F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(20,0)") < share * F.col("a").cast("decimal(20,0)")))
    cuts = kept.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")), " ").alias("rest"),
    )
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
    score = F.expr("(cast(a AS decimal(20,0)) * 2000000) div (cast(l AS decimal(20,0)) + cast(r AS decimal(20,0)))")
    worst = cuts.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    found = worst.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
