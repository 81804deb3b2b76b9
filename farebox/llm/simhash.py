"""Near-duplicate documents by SimHash with bit-sliced comparison.

Fingerprints: A-Z are lower-cased, words are split at ASCII white space, and each bit tells
whether it is set in over half the hashes of the word shingles (repeats included).

Comparison: equal fingerprints are one entry. A fingerprint is cut into ``radius + 2`` blocks;
two of them that differ in ``radius`` bits at most agree in two blocks at least, so entries
meet in buckets of two equal blocks. A bucket over ``BUCKET`` entries is cut again by the same
rule over the other bits, until those that are free number few enough to bound a bucket.

In a bucket the entries stand as bit planes: bit j of plane p is bit p of entry j, as one long
integer. The distances of an entry to all others are added up plane by plane in carry-save
counters that start so that the first carry out marks a distance over the radius, and the bucket
is left as soon as all entries are marked. A bucket gives a spanning forest of its links only.

Null and empty texts have fingerprint 0 and link with each other like any equal fingerprints.
Rows with a null id are linked too; a group that has null ids alone has a null component.
Repeated rows stay and get the same component. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farebox.llm.arrays import append_columns, fresh
from farebox.llm.components import components
from farebox.session import materialize

SHINGLE = 3
RADIUS = 2
SEED = 42
# Entries of a bucket that one task compares; larger buckets are cut further.
BUCKET = 4096


def shingle_hashes(text: bytes, size: int) -> list[int]:
    words = text.lower().split()
    if not words:
        return []
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    joined = b" ".join(words)
    starts = list(accumulate([len(w) + 1 for w in words], initial=0))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[size:])]


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The fingerprint as a signed long."""
    hashes = np.array(shingle_hashes(text, size), "<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    most = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(most, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", size: int = SHINGLE, out: str = "fp", keep=None) -> DataFrame:
    """Add the fingerprint of every text as a long."""

    def run(texts: pa.Array) -> list[pa.Array]:
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        return [pa.array([fingerprint(t.as_py(), size) for t in texts], pa.int64())]

    return append_columns(docs, text, T.StructType([T.StructField(out, T.LongType())]), run, keep=keep)


def masks(bits: int, parts: int, equal: int) -> list[int]:
    """Masks over the set bits of ``bits``, cut into ``parts`` blocks, each with ``equal`` of the blocks."""
    places = [p for p in range(64) if bits >> p & 1]
    limits = [len(places) * k // parts for k in range(parts + 1)]
    blocks = [sum(1 << p for p in places[a:b]) for a, b in zip(limits, limits[1:])]
    return [sum(chosen) for chosen in combinations(blocks, equal)]


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def bucket_masks(bits: int, radius: int) -> list[int]:
    """One mask at least keeps the bits that two entries within the radius share."""
    if bits == (1 << 64) - 1:
        return masks(bits, radius + 2, 2)
    return masks(bits, radius + 4, 4)


def masked(fp: Column, mask_list: list[int]) -> Column:
    """(mask number, masked fingerprint) for every mask."""
    return F.explode(
        F.array(*[F.struct(F.lit(k).alias("mask"), fp.bitwiseAND(F.lit(signed(m))).alias("part")) for k, m in enumerate(mask_list)])
    )


def buckets(entries: DataFrame, radius: int, bucket: int) -> DataFrame:
    """Lists of entries that may be within the radius; each list is bounded."""
    every = (1 << 64) - 1
    first = bucket_masks(every, radius)
    rows = entries.select("fp", masked(F.col("fp"), first).alias("m")).select("fp", "m.*")
    sizes = rows.groupBy("mask", "part").agg(F.count("*").alias("size")).where("size > 1")
    sizes = materialize(sizes)
    small = rows.join(sizes.where(F.col("size") <= bucket).select("mask", "part"), ["mask", "part"])
    lists = small.groupBy("mask", "part").agg(F.collect_list("fp").alias("fps")).select("fps")
    large = rows.join(sizes.where(F.col("size") > bucket).select("mask", "part"), ["mask", "part"])
    # The bits outside a mask, cut again: what is free in the end is at most 12 bits for the given radius.
    options = [bucket_masks(every & ~m, radius) for m in first]
    inner = F.array(*[F.array(*[F.lit(signed(x)) for x in o]) for o in options])[F.col("mask")]
    cut = large.select("fp", "mask", "part", F.posexplode(inner).alias("inner", "bits"))
    cut = cut.select("fp", "mask", "part", "inner", F.col("fp").bitwiseAND(F.col("bits")).alias("rest"))
    keys = ["mask", "part", "inner", "rest"]
    return lists.unionByName(cut.groupBy(*keys).agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps"))


def within(planes: list[int], entry: int, radius: int, full: int) -> int:
    """Bit j is set if entry j differs from ``entry`` in ``radius`` bits at most."""
    digits = radius.bit_length()
    begin = (1 << digits) - (radius + 1)
    counter = [full if begin >> d & 1 else 0 for d in range(digits)]
    over = 0
    for p, plane in enumerate(planes):
        carry = plane ^ full if entry >> p & 1 else plane
        for d in range(digits):
            counter[d], carry = counter[d] ^ carry, counter[d] & carry
        over |= carry
        if over == full:
            return 0
    return full & ~over


def forest(entries: list[int], radius: int) -> list[tuple[int, int]]:
    """Links (entry, root) that join the entries as all links within the radius would."""
    entries = sorted(set(entries))
    table = np.array(entries, np.int64)
    planes = [int.from_bytes(np.packbits((table >> p) & 1, bitorder="little").tobytes(), "little") for p in range(64)]
    full = (1 << len(entries)) - 1
    unseen, links = full, []
    for i, root in enumerate(entries):
        if not unseen >> i & 1:
            continue
        unseen &= ~(1 << i)
        waiting = [root]
        while waiting and unseen:
            near = within(planes, waiting.pop() & (2**64 - 1), radius, full) & unseen
            unseen &= ~near
            while near:
                j = (near & -near).bit_length() - 1
                near &= near - 1
                waiting.append(entries[j])
                links.append((entries[j], root))
    return links


def near_links(entries: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between different fingerprints ``fp``, a spanning forest of every bucket."""

    def run(batches):
        for batch in batches:
            lists = batch.column(0)
            links = [link for fps in lists for link in forest(fps.as_py(), radius)]
            a, b = [x for x, _ in links], [y for _, y in links]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return buckets(entries, radius, bucket).mapInArrow(run, "a long, b long")


def assign_components(rows: DataFrame, doc_id: str, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(fp, component): the smallest id that each fingerprint of ``rows`` (id, fp) reaches."""
    entries = materialize(rows.groupBy("fp").agg(F.min(doc_id).alias("least")))
    roots = components(near_links(entries, radius, bucket))
    joined = entries.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    linked = joined.where("root IS NOT NULL")
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    alone = joined.where("root IS NULL").select("fp", F.col("least").alias("component"))
    return alone.unionByName(linked.join(least, "root").select("fp", "component"))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET
) -> DataFrame:
    """(id, fp, component) of every row."""
    source = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("content"))
    rows = materialize(fingerprints(source, "content", size, keep=["id"]))
    found = rows.join(assign_components(rows, "id", radius, bucket), "fp")
    return found.select(F.col("id").alias(doc_id), "fp", "component")


def keep_one(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET
) -> DataFrame:
    """One document of each group, that of the smallest id (nulls last), with the columns it had."""
    found = near_duplicates(docs, doc_id, text, size, radius, bucket)
    return keep_first(docs, found, lambda d, out: fingerprints(d, text, size, out=out), doc_id)


def keep_first(docs: DataFrame, found: DataFrame, stamp, doc_id: str = "doc_id") -> DataFrame:
    """One document of each component of ``found`` (id, fp, component); ``stamp(docs, out)`` adds ``fp`` again.

    Ids that several rows share, or that are null, don't tell rows apart. The rows behind them
    that are chosen are reduced to one by all their columns' hash.
    """
    rows = materialize(found.select(F.col(doc_id).alias("id"), "fp", "component"))
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp")).alias("x"))
    # Groups of null ids alone have no component to tell them apart; each fingerprint of them keeps one.
    alone = rows.where("component IS NULL").select("fp").distinct()
    chosen = first.where("component IS NOT NULL").select("x.id", "x.fp")
    unique = rows.groupBy("id").agg(F.count("*").alias("n")).where("n = 1 AND id IS NOT NULL").select("id")
    plain = docs.join(chosen.join(unique, "id", "left_semi").select(F.col("id").alias(doc_id)), doc_id, "left_semi")
    shared = chosen.join(unique, "id", "left_anti").unionByName(alone.select(F.lit(None).cast(rows.schema["id"].dataType).alias("id"), "fp"))
    key, mark, order = fresh(docs, "key", "mark", "order_in_key")
    again = docs.where(F.col(f"`{doc_id}`").isNull()).unionByName(docs.join(shared.select(F.col("id").alias(doc_id)).distinct(), doc_id, "left_semi"))
    again = stamp(again, mark)
    match = shared.select(F.col("id").alias(key), F.col("fp").alias(mark)).distinct()
    again = again.join(match, again[doc_id].eqNullSafe(match[key]) & (again[mark] == match[mark]), "left_semi")
    same = Window.partitionBy(F.col(f"`{doc_id}`"), mark).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    once = again.withColumn(order, F.row_number().over(same)).where(F.col(order) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
    return plain.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(once)
