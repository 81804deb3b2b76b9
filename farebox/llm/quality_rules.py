"""Quality rules: counts of a text's form, and the likelihood ratio of its hashed n-grams.

Words are cut at ASCII white space. The rules of form count words, their code points, symbols,
repeated lines and the words inside windows of three that come twice or more in the text; texts
of too few words, or mostly of such windows, fail.

The ratio compares two multinomials over ``BUCKETS`` buckets of hashed words and word pairs (A-Z
lower-cased): trusted target text against the raw corpus. Both are counted over all rows, summed
in the tasks before the shuffle; a table of one weight per bucket, log p(target) - log p(raw) of
smoothed counts, is all that reaches the driver and the tasks, and its size is fixed. A text's
score is the mean weight of its grams, so length does not count.

A document passes if its score is within its language's bound: a low quantile of the scores of
trusted documents left out of the counts, less a margin and an allowance for short texts. Every
document is decided by this bound alone; nothing is drawn at random.

Null and empty texts have no words and fail by form. Without trusted text there is no score and
form alone decides. Languages without held-out trusted text, and null ones, are held to the bound
over all languages. Repeated rows get equal results; an empty table gives an empty result. Other
columns stay; one that is named like a result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farebox.llm import words as W
from farebox.llm.arrays import append_columns, fresh, slices, text_buffer
from farebox.llm.sieve import sieve
from farebox.session import materialize

BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
# Added to every bucket's count.
SMOOTHING = 1.0
# One in so many trusted documents sets the bounds and isn't counted.
HELD_OUT = 4
# Share of the held-out trusted documents under the bound before margin and allowance.
QUANTILE = 0.01
MARGIN = 0.05
# Short texts vary more: this much, over the root of the number of grams, is allowed them.
ALLOWANCE = 1.0
STEPS = 1000

WINDOW = 3
LEAST_WORDS = 50
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
FORM = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def per_row(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n).astype(np.int64)


def in_rows(flags: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """How many flags are set in each row."""
    before = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=before[1:])
    return before[limits[1:]] - before[limits[:-1]]


def repeated_words(found: W.Pieces, n: int) -> np.ndarray:
    """Words of each row inside windows of three words that come twice or more in the row."""
    count = len(found.ids)
    mark = np.zeros(count, bool)
    if count >= WINDOW:
        size = len(found.values)
        window = W.joined(W.joined(found.ids[:-2], found.ids[1:-1], size), found.ids[2:], size)
        inside = np.flatnonzero(found.rows[:-2] == found.rows[2:])
        key = W.joined(window[inside], found.rows[inside], n)
        often = inside[np.bincount(key)[key] >= 2] if len(key) else inside
        for step in range(WINDOW):
            mark[often + step] = True
    return per_row(found.rows[mark], n)


def duplicate_lines(raw: np.ndarray, limits: np.ndarray, has_word: np.ndarray) -> np.ndarray:
    """Lines of each row that hold a word and equal an earlier one."""
    found, n = W.lines(raw, limits), len(limits) - 1
    before = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(has_word, out=before[1:])
    filled = np.flatnonzero(before[np.append(found.starts[1:], len(raw))] > before[found.starts])
    rows = found.rows[filled]
    key = W.joined(found.ids[filled], rows, max(n, 1))
    again = np.ones(len(key), bool)
    again[np.unique(key, return_index=True)[1]] = False
    return per_row(rows[again], n)


def form(texts: pa.Array) -> list[np.ndarray]:
    """The columns of ``FORM`` for every text."""
    raw, limits = text_buffer(texts)
    inside, n = ~W.SPACE[raw], len(limits) - 1
    found = W.cut(raw, limits, inside)
    return [
        per_row(found.rows, n),
        in_rows(inside & ((raw & 0xC0) != 0x80), limits),
        in_rows(SYMBOL[raw], limits),
        duplicate_lines(raw, limits, inside),
        repeated_words(found, n),
    ]


def buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every word and every pair of neighbouring words."""
    raw, limits = text_buffer(texts)
    found = W.cut(raw, limits, ~W.SPACE[raw])
    digests = [xxhash.xxh3_64_intdigest(w.lower()) for w in found.values.to_pylist()]
    word = np.array(digests, np.uint64)[found.ids] if digests else np.zeros(0, np.uint64)
    after = np.flatnonzero(found.rows[1:] == found.rows[:-1])
    pair = (word[after] * np.uint64(0x9E3779B97F4A7C15) ^ word[after + 1]) * np.uint64(0xD6E8FEB86659FD93)
    code = np.concatenate([word, pair]) >> np.uint64(64 - BUCKET_BITS)
    return code.astype(np.int64), np.concatenate([found.rows, found.rows[after]])


def count_buckets(docs: DataFrame, text: str) -> DataFrame:
    """(bucket, n) over all rows: one array of fixed size per task, summed by bucket."""
    docs = docs.select(F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                total += np.bincount(buckets(part.column("text"))[0], minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    return docs.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def weights(target: DataFrame, raw: DataFrame) -> np.ndarray | None:
    """Log ratio of each bucket's smoothed shares; None without target text."""

    def share(counts: DataFrame) -> np.ndarray:
        found, n = counts.toArrow(), np.full(BUCKETS, SMOOTHING)  # at most BUCKETS rows
        n[found.column("bucket").to_numpy()] += found.column("n").to_numpy()
        return n

    have = share(target)
    if have.sum() == SMOOTHING * BUCKETS:
        return None
    rest = share(raw)
    return (np.log(have / have.sum()) - np.log(rest / rest.sum())).astype(np.float32)


RATIO = T.StructType([T.StructField("ratio", T.DoubleType()), T.StructField("n_grams", T.LongType())])


def ratio(table: np.ndarray | None, texts: pa.Array) -> list[pa.Array]:
    """Mean weight of each text's grams, null where there are none, and their number."""
    code, rows = buckets(texts)
    n = per_row(rows, len(texts))
    if table is None:
        return [pa.nulls(len(texts), pa.float64()), pa.array(n)]
    total = np.bincount(rows, table[code].astype(np.float64), len(texts))
    return [pa.array(total / np.maximum(n, 1), mask=n == 0), pa.array(n)]


def held_out(doc_id: str) -> Column:
    return F.pmod(F.crc32(F.col(f"`{doc_id}`").cast("string")), F.lit(HELD_OUT)) == 0


def step() -> Column:
    """The score with the allowance for short texts, in steps."""
    return F.floor((F.col("ratio") + ALLOWANCE / F.sqrt(F.col("n_grams"))) * STEPS)


def bound() -> Column:
    """The bound of a group's steps: an exact quantile, whose state is one count per step."""
    return (F.floor(F.percentile(step(), F.lit(QUANTILE))) / STEPS - MARGIN).alias("bound")


def rate(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    quality: str = "quality",
    keep: list[str] | None = None,
) -> DataFrame:
    """Add ``FORM``, ``base_failed``, the likelihood ratio ``score``, its bound ``least``, and ``kept``."""
    named = {*FORM, "base_failed", "score", "least", "kept"}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in named]
    trusted = labels.where(F.col(quality) == 1).select(F.col(doc_id).alias("id")).where("id IS NOT NULL").distinct()
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    # Both halves of the trusted rows are joined by merging at every size; each text is shuffled once.
    rows = sieve(rows, trusted, "id").join(trusted.hint("merge"), "id")
    table = weights(count_buckets(rows.where(~held_out("id")), "text"), count_buckets(docs, text))
    rated = append_columns(rows.where(held_out("id")), "text", RATIO, lambda t: ratio(table, t), keep=["lang"])
    rated = rated.where("ratio IS NOT NULL")
    own, of, every, content, score, size = fresh(docs, "own", "lang_of", "every", "content", "ratio", "n_grams")
    bounds = rated.where("lang IS NOT NULL").groupBy(F.col("lang").alias(of)).agg(bound().alias(own))
    overall = rated.agg(bound().alias(every))
    fields = T.StructType([T.StructField(c, T.LongType()) for c in FORM])
    fields = T.StructType([*fields, T.StructField(score, T.DoubleType()), T.StructField(size, T.LongType())])

    def run(texts: pa.Array) -> list[pa.Array]:
        return [*map(pa.array, form(texts)), *ratio(table, texts)]

    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{lang}`").alias(of), F.col(f"`{text}`").alias(content))
    found = append_columns(source, content, fields, run, keep=[*keep, of])
    found = found.join(materialize(bounds), of, "left").join(F.broadcast(materialize(overall)))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    least = F.coalesce(own, every) - ALLOWANCE / F.sqrt(F.col(size))
    return found.select(
        *[F.col(f"`{c}`") for c in keep],
        *FORM,
        failed.alias("base_failed"),
        F.col(score).alias("score"),
        F.when(F.col(score).isNotNull(), least).alias("least"),
        (~failed & F.coalesce(F.col(score) >= least, F.lit(True))).alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are kept, with the columns they had."""
    held = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)])
    names = {k: f"c{docs.columns.index(options.pop(k, k))}" for k in ("doc_id", "text", "lang")}
    labels = labels.select(F.col(options.pop("label_id", "doc_id")).alias(names["doc_id"]), options.pop("quality", "quality"))
    rated = rate(held, labels, **names, **options)
    return rated.where("kept").select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
