"""Text quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over bytes: a gram of up to five bytes is an exact 40-bit number, every row is
preceded by four zero bytes. Its parts:

* Counts of the highest order come from all trusted text, summed in the tasks before they are
  shuffled. Counts of lower orders are numbers of different preceding bytes.
* Discounts for counts of one, two and three or more are set by each order's counts of counts.
* Probabilities of all orders, and the weights that contexts leave to the next lower order, are
  joins of these count tables, sharded by gram.

Scoring joins the documents with the table in shards of a stated number of entries, cut by the
last two bytes of the context: a position needs entries of one shard alone. Each shard is one
pass that adds its positions' log probabilities, so documents are never shuffled and a task's
memory is bounded. A byte model's table grows slower and slower with the text, so passes are few.

Part of the trusted documents is left out of the counts. The perplexities of these give each
language's bound: a quantile and a margin, both of the mean log probability of a byte plus an
allowance for short texts. Documents under the bound are rejected.

Null and empty texts have no perplexity and are kept; so are all documents where no trusted text
exists. Documents without a language, or of one without held-out trusted text, are held to the
bound over all languages. Repeated rows get equal results. Other columns stay; one that is named
like a result is replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farebox.llm.arrays import append_columns, fresh, slices, text_buffer
from farebox.llm.lookup import Lookup
from farebox.llm.sieve import sieve
from farebox.session import materialize

ORDER = 5
# Entries of the model that a task holds at a time.
SHARD_ENTRIES = 2_000_000
# Text bytes that are scored or counted at a time; each takes some hundred bytes of arrays.
SLICE = 1 << 19
# Different grams that a task gathers before it hands them on.
GATHERED = 1_000_000
# One in so many trusted documents sets the bounds and isn't counted.
HELD_OUT = 4
# Share of the held-out trusted documents under the quantile, and how far a document may lie under it.
QUANTILE = 0.02
MARGIN = 0.1
# Short texts vary more: this much, over the root of the number of bytes, is added to the mean.
ALLOWANCE = 4.0
# Steps of a quantile in one unit of log probability.
STEPS = 1000


def grams(raw: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The gram of the highest order that ends at each byte."""
    rows = np.diff(limits)
    pad = ORDER - 1
    padded = np.zeros(len(raw) + pad * len(rows), np.uint64)
    place = np.arange(len(raw)) + np.repeat(pad * np.arange(1, len(rows) + 1), rows)
    padded[place] = raw
    code = padded.copy()
    for back in range(1, ORDER):
        code[back:] |= padded[:-back] << np.uint64(8 * back)
    return code[place]


def merge_counts(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, count = np.concatenate(codes), np.concatenate(counts)
    by = np.argsort(code, kind="stable")
    code, count = code[by], count[by]
    head = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return code[head], np.add.reduceat(count, head) if len(code) else count


def count_grams(texts: DataFrame, text: str) -> DataFrame:
    """(g, n): how often each gram of the highest order occurs."""
    texts = texts.select(F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, held = [], [], 0
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                code, count = np.unique(grams(*text_buffer(part.column("text"))), return_counts=True)
                codes, counts, held = [*codes, code], [*counts, count], held + len(code)
                if held > GATHERED:
                    code, count = merge_counts(codes, counts)
                    codes, counts, held = [code], [count], len(code)
                    if held > GATHERED // 2:
                        yield table(code, count)
                        codes, counts, held = [], [], 0
        if codes:
            yield table(*merge_counts(codes, counts))

    def table(code: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(count.astype(np.int64))], names=["g", "n"])

    return texts.mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))


def discounts(table: DataFrame) -> Column:
    """Discount of a count ``n``, from how many grams have a count of one to four."""
    have = [F.sum((F.col("n") == k).cast("double")) for k in (1, 2, 3, 4)]
    t = [float(x or 0) for x in table.agg(*have).first()]
    share = t[0] / (t[0] + 2 * t[1]) if t[0] and t[1] else 0.5
    cut = [k + 1 - (k + 2) * share * t[k + 1] / t[k] if t[k] else (k + 1) / 2 for k in range(3)]
    cut = [min(max(c, 0.1), k + 0.9) for k, c in enumerate(cut)]
    return F.when(F.col("n") == 1, cut[0]).when(F.col("n") == 2, cut[1]).otherwise(cut[2])


def key(kind: int, code: Column) -> Column:
    return code.bitwiseOR(F.lit(kind << 40))


def build(counts: DataFrame) -> DataFrame:
    """(key, value): log probabilities (kinds 1 to 5) and log weights of contexts (kinds 8 to 12)."""
    tables = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):
        code = F.col("g").bitwiseAND((1 << (8 * order)) - 1)
        tables[order] = materialize(tables[order + 1].groupBy(code.alias("g")).agg(F.count("*").alias("n")))
    entries, lower = None, None
    for order in range(1, ORDER + 1):
        grams_of = tables[order].withColumn("h", F.shiftright("g", 8)).withColumn("cut", discounts(tables[order]))
        contexts = grams_of.groupBy("h").agg(F.sum("n").alias("total"), F.sum("cut").alias("given"))
        rows = grams_of.join(contexts, "h")
        share, weight = (F.col("n") - F.col("cut")) / F.col("total"), F.col("given") / F.col("total")
        if order == 1:
            rows = rows.select("g", (share + weight / 256).alias("p"))
        else:
            rows = rows.withColumn("low", F.col("g").bitwiseAND((1 << (8 * order - 8)) - 1))
            rows = rows.join(lower, "low").select("g", (share + weight * F.col("below")).alias("p"))
        rows = materialize(rows)
        lower = rows.select(F.col("g").alias("low"), F.col("p").alias("below"))
        new = rows.select(key(order, F.col("g")).alias("key"), F.log("p").alias("value"))
        left = contexts.select(key(7 + order, F.col("h")).alias("key"), F.log(weight).alias("value"))
        new = new.unionByName(left)
        entries = new if entries is None else entries.unionByName(new)
    return materialize(entries)


def bucket() -> Column:
    """The last two bytes of an entry's context; null where the context is shorter."""
    kind, code = F.shiftright("key", 40), F.col("key").bitwiseAND((1 << 40) - 1)
    pair = F.when(kind <= ORDER, F.shiftright(code, 8)).otherwise(code).bitwiseAND(65535)
    return F.when(((kind >= 3) & (kind <= ORDER)) | (kind >= 10), pair)


def shards(entries: DataFrame, most: int) -> list[list[int]]:
    """Buckets dealt to shards of about ``most`` entries: at most 65,536 sizes reach the driver."""
    sizes = entries.select(bucket().alias("b")).where("b IS NOT NULL").groupBy("b").count().collect()
    groups, size = [[]], 0
    for b, n in sorted((r[0], r[1]) for r in sizes):
        if size + n > most and groups[-1]:
            groups.append([])
            size = 0
        groups[-1].append(b)
        size += n
    return groups


class Shard:
    """A shard's entries as a table, and the buckets it answers for (all others score nothing)."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, buckets: np.ndarray | None):
        self.table, self.buckets = Lookup(keys, values), buckets

    def score(self, code: np.ndarray) -> np.ndarray:
        """Log probability of each gram's last byte in its context; 0 for other shards' grams."""
        total = np.zeros(len(code))
        left = np.arange(len(code))
        if self.buckets is not None:
            left = np.flatnonzero(self.buckets[(code >> np.uint64(8)) & np.uint64(65535)])
        code = code[left]
        for order in range(ORDER, 0, -1):
            gram = code & np.uint64((1 << (8 * order)) - 1)
            value, found = self.table.get(gram | np.uint64(order << 40))
            total[left[found]] += value[found]
            left, code, gram = left[~found], code[~found], gram[~found]
            if not len(left):
                return total
            value, found = self.table.get((gram >> np.uint64(8)) | np.uint64((7 + order) << 40))
            total[left[found]] += value[found]
        total[left] += np.log(1 / 256)
        return total


# The shard a worker process has ready, by the name its pass was given.
_READY: dict[str, Shard] = {}


def scorer(name: str, shared: Broadcast):
    def run(texts: pa.Array) -> list[pa.Array]:
        if name not in _READY:
            _READY.clear()
            _READY[name] = Shard(*shared.value)
        raw, limits = text_buffer(texts)
        scores = _READY[name].score(grams(raw, limits))
        sums, filled = np.zeros(len(limits) - 1), limits[1:] > limits[:-1]
        if filled.any():
            sums[filled] = np.add.reduceat(scores, limits[:-1][filled])
        return [pa.array(sums), pa.array(np.diff(limits))]

    return run


class Model:
    """A fitted model: its table of entries, and which buckets each shard holds."""

    def __init__(self, counts: DataFrame, shard_entries: int = SHARD_ENTRIES):
        self.entries = build(counts)
        self.groups = shards(self.entries, shard_entries)
        self.shared = [self._share(k) for k in range(len(self.groups))]

    def _share(self, k: int) -> tuple[str, Broadcast]:
        """One shard to the tasks; its size is bounded by the way buckets were dealt."""
        spark = self.entries.sparkSession
        if len(self.groups) == 1:
            rows, held = self.entries, None
        else:
            number = np.full(65536, -1, np.int32)
            for g, group in enumerate(self.groups):
                number[group] = g
            held = number == k if k else (number == k) | (number < 0)
            low, high = min(self.groups[k]), max(self.groups[k])
            rows = self.entries.withColumn("b", bucket()).where(F.col("b").isNull() | F.col("b").between(low, high))
        data = rows.select("key", "value").toArrow()
        arrays = data.column("key").to_numpy().astype(np.uint64), data.column("value").to_numpy().astype(np.float32), held
        return uuid.uuid4().hex, spark.sparkContext.broadcast(arrays)

    def score(
        self, docs: DataFrame, text: str = "text", out: tuple[str, str] = ("mean_logp", "n_bytes"), keep: list[str] | None = None
    ) -> DataFrame:
        """Add the mean log probability of each text's bytes, null where there are none, and their number."""
        named = {x.lower() for x in out}
        keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in named]
        source, part, size, before = fresh(docs, "text_of", "logp", "size_of", "logp_before")
        docs = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(source))
        fields = T.StructType([T.StructField(part, T.DoubleType()), T.StructField(size, T.LongType())])
        for k, shared in enumerate(self.shared):
            last = k == len(self.shared) - 1
            held = keep + [before] * (k > 0) + [source] * (not last)
            docs = append_columns(docs, source, fields, scorer(*shared), SLICE, held)
            total = F.col(part) + F.col(before) if k else F.col(part)
            docs = docs.withColumn(part, total).drop(before).withColumnRenamed(part, part if last else before)
        mean = F.col(part) / F.nullif(F.col(size), F.lit(0))
        return docs.select(*[F.col(f"`{c}`") for c in keep], mean.alias(out[0]), F.col(size).alias(out[1]))


def held_out(doc_id: str) -> Column:
    return F.pmod(F.crc32(F.col(f"`{doc_id}`").cast("string")), F.lit(HELD_OUT)) == 0


def allowed(mean_logp: str, n_bytes: str) -> Column:
    """The mean log probability with the allowance for short texts."""
    return F.col(mean_logp) + ALLOWANCE / F.sqrt(F.col(n_bytes))


def lower_quantile(steps: DataFrame, by: list[str]) -> DataFrame:
    """The bound of each group from how many documents (``n``) are on each ``step``: as many rows as steps."""
    order = Window.partitionBy(*by, F.lit(0)).orderBy("step")
    sums = steps.groupBy(*by, "step").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(order))
    sums = sums.withColumn("total", F.sum("n").over(Window.partitionBy(*by, F.lit(0))))
    first = sums.where(F.col("upto") >= QUANTILE * F.col("total")).groupBy(*by).agg(F.min("step").alias("step"))
    return first.select(*by, (F.col("step") / STEPS - MARGIN).alias("bound"))


def rate(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    quality: str = "quality",
    keep: list[str] | None = None,
    out: tuple[str, str, str] = ("perplexity", "most", "kept"),
    shard_entries: int = SHARD_ENTRIES,
) -> DataFrame:
    """Add each document's perplexity of a byte, the most that is kept at its length, and whether it is kept."""
    ppl, most, kept = out
    named = {x.lower() for x in out}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in named]
    trusted = labels.where(F.col(quality) == 1).select(F.col(doc_id).alias("id")).where("id IS NOT NULL").distinct()
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    # An inner join with different ids: a semi join would be moved before the sieve. Its plan is
    # stated, so that it is the same however many labels there are.
    rows = sieve(rows, trusted, "id").join(trusted.hint("merge"), "id")
    model = Model(materialize(count_grams(rows.where(~held_out("id")), "text")), shard_entries)
    rated = model.score(rows.where(held_out("id")), keep=["lang"]).where("n_bytes > 0")
    step = F.floor(allowed("mean_logp", "n_bytes") * STEPS).alias("step")
    steps = materialize(rated.select("lang", step).groupBy("lang", "step").agg(F.count("*").alias("n")))
    key_, mean, size, own, every = fresh(docs, "lang_of", "mean_logp", "n_bytes", "own", "every")
    bounds = lower_quantile(steps.where("lang IS NOT NULL"), ["lang"]).select(F.col("lang").alias(key_), F.col("bound").alias(own))
    overall = lower_quantile(steps, []).agg(F.max("bound").alias(every))
    scored = model.score(docs.withColumn(key_, F.col(f"`{lang}`")), text, (mean, size), [*keep, key_])
    scored = scored.join(bounds, key_, "left").join(F.broadcast(overall))
    least = F.coalesce(own, every) - ALLOWANCE / F.sqrt(F.col(size))
    return scored.select(
        *[F.col(f"`{c}`") for c in keep],
        F.exp(-F.col(mean)).alias(ppl),
        F.when(F.col(size) > 0, F.exp(-least)).alias(most),
        F.coalesce(F.col(mean) >= least, F.lit(True)).alias(kept),
    )


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are kept, with the columns they had."""
    out = tuple(fresh(docs, "perplexity", "most", "kept"))
    rated = rate(docs, labels, out=out, **options)
    return rated.where(F.col(out[2])).select(*[F.col(f"`{c}`") for c in docs.columns])
