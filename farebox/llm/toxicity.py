"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic documents are labelled examples; everything else is unlabelled text, toxic
in a share that the class prior states. The risk of calling text harmless is measured on the
unlabelled sample and freed of what its toxic part adds: ``R_u- - prior * R_p-``. That estimate can't
be negative for a real risk, so where it falls below zero the step only undoes it, and the classifier
doesn't learn the sample by heart.

Inputs are byte grams of words (A-Z lower-cased, a blank at both ends), present or not. The grams
that the positives have more often than the unlabelled text are chosen by a likelihood ratio over
document counts, which are summed on Spark. The classifier is logistic, in numpy, on the driver;
it sees ``POSITIVES`` and ``UNLABELLED`` documents at most in expectation, drawn by the hash of
their id, and of these the chosen grams only. The prior is the share of toxic rows among all labels
of the training part.

Rows whose crc32 of the id has remainder 2 by 4 are held out; nothing is learned from them or from
null ids. Labels, language, source and id are no inputs of a score. Null and empty texts get the
score of a text without chosen grams; without any positives every score is the prior, or 0 without
labels. Repeated rows get equal scores. Other columns stay; one that is named like a result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farebox.llm.arrays import append_columns, list_array, slices, text_buffer
from farebox.llm.decontaminate import IN_WORD, LOWER
from farebox.llm.lookup import Lookup
from farebox.llm.sieve import sieve
from farebox.session import materialize

GRAM = 5
POSITIVES = 5_000
UNLABELLED = 20_000
CHOSEN = 2_048
# Documents among the positives that must have a gram.
LEAST = 3
# Likelihood ratio under which a difference may be chance.
SIGNIFICANT = 12.0
STEPS = 600
SPEED = 0.05
PENALTY = 1e-4
DECIDE = 0.3
SLICE = 1 << 20


def word_grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Grams of all words and the row limits among them."""
    raw, limits = text_buffer(texts)
    low, inside = LOWER[raw], IN_WORD[raw]
    # Runs of other bytes become one blank; every row begins and ends with a blank.
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    filled = limits[1:] > limits[:-1]
    keep[limits[:-1][filled]] = inside[limits[:-1][filled]]
    text = np.where(inside, low, 32)[keep]
    sums = np.concatenate([[0], np.cumsum(keep)])[limits]
    size = np.diff(sums)
    rows = np.arange(1, len(size) + 1)
    padded = np.full(len(text) + 2 * len(size) + GRAM, 32, np.uint8)
    padded[np.arange(len(text)) + np.repeat(2 * rows - 1, size)] = text
    bounds = np.concatenate([[0], sums[1:] + 2 * rows])
    count = int(bounds[-1])
    code = np.zeros(count, np.uint64)
    good = np.ones(count, bool)
    for k in range(GRAM):
        byte = padded[k : k + count]
        code = code << np.uint64(8) | byte
        if 0 < k < GRAM - 1:
            good &= byte != 32
    # A gram must not reach into the next row.
    for k in range(1, GRAM):
        good[np.maximum(bounds[1:] - k, bounds[:-1])] = False
    before = np.concatenate([[0], np.cumsum(good)])
    return code[good], before[bounds]


def rows_of(limits: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(limits) - 1), np.diff(limits))


def document_counts(docs: DataFrame) -> DataFrame:
    """(gram, p, u): how many positives and unlabelled documents of docs (text, positive) have each gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                code, limits = word_grams(part.column("text"))
                row = rows_of(limits)
                by = np.lexsort((row, code))
                code, row = code[by], row[by]
                once = np.ones(len(code), bool)
                once[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
                code, row = code[once], row[once]
                positive = part.column("positive").to_numpy(zero_copy_only=False)[row]
                head = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
                p = np.add.reduceat(positive.astype(np.int64), head) if len(code) else np.zeros(0, np.int64)
                u = np.add.reduceat((~positive).astype(np.int64), head) if len(code) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(code[head].astype(np.int64)), pa.array(p), pa.array(u)], names=["gram", "p", "u"]
                )

    counted = docs.select("text", "positive").mapInArrow(run, "gram long, p long, u long")
    return counted.groupBy("gram").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))


def choose(counts: DataFrame, positives: int, unlabelled: int, chosen: int = CHOSEN) -> np.ndarray:
    """The grams with the largest likelihood ratio among those that positives have more often."""
    p, u, n, m = F.col("p"), F.col("u"), float(positives), float(unlabelled)
    with_gram = (p + u) / (n + m)

    def term(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    ratio = term(p, n * with_gram) + term(u, m * with_gram) + term(n - p, n * (1 - with_gram)) + term(m - u, m * (1 - with_gram))
    rows = counts.where((p >= LEAST) & (p * m > u * n))
    best = rows.withColumn("ratio", 2 * ratio).where(F.col("ratio") >= SIGNIFICANT).orderBy(F.desc("ratio"), "gram").limit(chosen).select("gram").collect()
    return np.sort(np.array([r[0] for r in best], np.uint64))


class Classifier:
    """Logistic scores of the chosen grams."""

    def __init__(self, grams: np.ndarray, weights: np.ndarray, bias: float):
        self.grams, self.weights, self.bias = grams, weights, bias
        self.table = Lookup(grams, np.arange(len(grams), dtype=np.int32))

    def features(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the chosen grams that each text has, ascending, and how many."""
        code, limits = word_grams(texts)
        number, found = self.table.get(code) if len(self.grams) else (code, np.zeros(len(code), bool))
        key = np.unique(rows_of(limits)[found] * np.int64(len(self.grams) + 1) + number[found].astype(np.int64))
        row = key // (len(self.grams) + 1)
        return key - row * (len(self.grams) + 1), np.bincount(row, minlength=len(limits) - 1)

    def score(self, texts: pa.Array) -> np.ndarray:
        number, counts = self.features(texts)
        row = np.repeat(np.arange(len(counts)), counts)
        z = self.bias + np.bincount(row, self.weights[number], len(counts)) if len(self.grams) else np.full(len(counts), self.bias)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def train(number: np.ndarray, counts: np.ndarray, positive: np.ndarray, width: int, prior: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias of the smallest non-negative risk; documents are lists of feature numbers.

    Steps get smaller, and the mean of the second half of them is returned, as the correction
    makes single ones go back and forth.
    """
    row = np.repeat(np.arange(len(counts)), counts)
    w, b = np.zeros(width), float(np.log(prior / (1 - prior)))
    n, m = int(positive.sum()), int((~positive).sum())
    moment, square, mean = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        z = b + np.bincount(row, w[number], len(counts))
        toxic = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
        # Slopes of the mean losses by each document's z.
        found, missed = np.where(positive, toxic - 1.0, 0.0) * prior / n, np.where(positive, toxic, 0.0) * prior / n
        called = np.where(positive, 0.0, toxic) / m
        harmless = np.logaddexp(0.0, z)
        risk = harmless[~positive].mean() - prior * harmless[positive].mean()
        slope = found + called - missed if risk >= 0 else missed - called
        g = np.append(np.bincount(number, slope[row], width), slope.sum())
        g[:-1] += PENALTY * w
        moment = 0.9 * moment + 0.1 * g
        square = 0.999 * square + 0.001 * g * g
        move = SPEED * (1 - step / (steps + 1)) * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
        if 2 * step > steps:
            mean += np.append(w, b) / (steps - steps // 2)
    return mean[:-1], float(mean[-1])


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{doc_id}`").cast("string")), F.lit(4)) == 2, F.lit(False))


def drawn(rows: DataFrame, most: int) -> DataFrame:
    """About ``most`` rows at most, by the hash of ``id``."""
    share = min(1.0, most / max(1, rows.count()))
    return rows.where(F.xxhash64("id").bitwiseAND((1 << 40) - 1) < int(share * (1 << 40)))


def fit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic",
    positives: int = POSITIVES, unlabelled: int = UNLABELLED, chosen: int = CHOSEN,
) -> Classifier:
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.where(~held_out("id") & F.col("id").isNotNull())
    marks = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{toxic}`").alias("toxic"))
    marks = marks.where(~held_out("id") & F.col("id").isNotNull() & F.col("toxic").isNotNull())
    marks = marks.groupBy("id").agg(F.max("toxic").alias("toxic"))
    prior = marks.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    none = np.zeros(0, np.uint64)
    if not prior:
        return Classifier(none, np.zeros(0), -30.0)
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    confirmed = drawn(marks.where("toxic = 1").select("id"), positives)
    first = sieve(rows, confirmed, "id").join(confirmed.hint("merge"), "id").select("text", F.lit(True).alias("positive"))
    second = drawn(rows, unlabelled).select("text", F.lit(False).alias("positive"))
    sample = materialize(first.unionByName(second))
    sizes = {r.positive: r["count"] for r in sample.groupBy("positive").count().collect()}
    if len(sizes) < 2:
        return Classifier(none, np.zeros(0), float(np.log(prior / (1 - prior))))
    grams = choose(document_counts(sample), sizes[True], sizes[False], chosen)
    empty = Classifier(grams, np.zeros(len(grams)), 0.0)

    def run(texts: pa.Array) -> list[pa.Array]:
        return [list_array(*[a.astype(np.int32) for a in empty.features(texts)])]

    found = T.StructType([T.StructField("numbers", T.ArrayType(T.IntegerType()))])
    table = append_columns(sample, "text", found, run, SLICE, ["positive"]).toArrow().combine_chunks()
    lists, positive = table.column("numbers").combine_chunks(), table.column("positive").to_numpy()
    by = np.argsort(~positive, kind="stable")
    lists, positive = lists.take(pa.array(by)), positive[by]
    counts = lists.value_lengths().to_numpy().astype(np.int64)
    weights, bias = train(lists.flatten().to_numpy(), counts, positive, len(grams), prior)
    return Classifier(grams, weights, bias)


def rate(docs: DataFrame, model: Classifier, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Add the probability that each text is toxic."""
    fields = T.StructType([T.StructField(out, T.DoubleType())])
    return append_columns(docs, text, fields, lambda texts: [pa.array(model.score(texts))], SLICE, keep)
