"""Sparing rows a join's shuffle with a bitmap of fixed size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farebox.llm.arrays import fresh

# Size of the bitmap in bits: 1 MB, however many ids there are.
SIEVE_BITS = 1 << 23


def mark(docs: DataFrame, ids: DataFrame, doc_id: str, out: str) -> DataFrame:
    """Add whether the id of a row may be among ``ids``, by a bitmap of a fixed size (1 MB)."""
    spot = F.pmod(F.xxhash64(F.col(f"`{doc_id}`")), F.lit(SIEVE_BITS)) + 1
    bits = ids.groupBy(F.bitmap_bucket_number(spot).alias("number")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("bits")
    )
    number, held, place = fresh(docs, "number", "bits", "place")
    bits = bits.select(F.col("number").alias(number), F.col("bits").alias(held))
    rows = docs.withColumn(number, F.bitmap_bucket_number(spot)).withColumn(place, F.bitmap_bit_position(spot))
    rows = rows.join(F.broadcast(bits), number, "left")
    byte = F.conv(F.hex(F.substring(held, (F.floor(F.col(place) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    hit = F.floor(byte / F.pow(F.lit(2), F.pmod(place, F.lit(8)))) % 2 == 1
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce(hit, F.lit(False)).alias(out))


def sieve(docs: DataFrame, ids: DataFrame, doc_id: str) -> DataFrame:
    """Rows whose id may be among ``ids``: a bitmap of a fixed size (1 MB) spares others the join's shuffle."""
    spot = F.pmod(F.xxhash64(F.col(f"`{doc_id}`")), F.lit(SIEVE_BITS)) + 1
    bits = ids.groupBy(F.bitmap_bucket_number(spot).alias("number")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("bits")
    )
    number, held, place = fresh(docs, "number", "bits", "place")
    bits = bits.select(F.col("number").alias(number), F.col("bits").alias(held))
    rows = docs.withColumn(number, F.bitmap_bucket_number(spot)).withColumn(place, F.bitmap_bit_position(spot))
    rows = rows.join(F.broadcast(bits), number)
    byte = F.conv(F.hex(F.substring(held, (F.floor(F.col(place) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    hit = F.floor(byte / F.pow(F.lit(2), F.pmod(place, F.lit(8)))) % 2 == 1
    return rows.where(hit).select(*[F.col(f"`{c}`") for c in docs.columns])
