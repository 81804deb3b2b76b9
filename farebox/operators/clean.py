"""Raw boarding counts to fact rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from farebox.functions.calendar import clock_text, full_width, parse_ts
from farebox.functions.numeric import recode
from farebox.functions.text import code_of, name_of
from farebox.schemas import (
    INTERMEDIATE_GATE_LINE, INTERMEDIATE_GATE_NAME, MERGED_LINE_FROM, MERGED_LINE_NAME,
    MERGED_LINE_TO, SLOT_KEYS, STATION_VARIANTS,
)
from farebox.session import materialize

MEASURES = ["entradas", "salidas", "total"]


def aggregate_slots(raw: DataFrame, keys: list[str] = SLOT_KEYS) -> DataFrame:
    """One row per date, time and station, or per ``keys`` that tell the same slots apart.

    Counts are summed (a bad number raises under ANSI casts). Where a slot names several
    lines the alphabetically first label is kept, so the result does not depend on row order.
    """
    return raw.groupBy(*keys).agg(
        F.min("Linea").alias("Linea"),
        F.coalesce(F.sum(F.col("Entradas_E").cast("long")), F.lit(0)).alias("entradas"),
        F.coalesce(F.sum(F.col("Salidas_S").cast("long")), F.lit(0)).alias("salidas"),
    )


def derive_fields(slots: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Timestamp, date, time, codes, names and total of aggregated slots; those that are there are used."""
    have = slots.columns
    ts = F.col("timestamp") if "timestamp" in have else parse_ts(*SLOT_KEYS[:2])
    return slots.select(
        ts.alias("timestamp"),
        F.col("fecha") if "fecha" in have else ts.cast("date").alias("fecha"),
        clock_text(ts).alias("hora"),
        code_of("Linea").alias("codigo_linea"),
        name_of("Linea").alias("nombre_linea"),
        F.col("codigo_estacion") if "codigo_estacion" in have else code_of("Estacion").alias("codigo_estacion"),
        name_of("Estacion").alias("nombre_estacion"),
        "entradas",
        "salidas",
        (F.col("entradas") + F.col("salidas")).alias("total"),
        *keep,
    )


def recode_lines(df: DataFrame) -> DataFrame:
    """Two line rules: the intermediate-gate line takes another name (its code stays), and
    line 39 becomes line 31 with that line's name."""
    merged = F.col("codigo_linea") == MERGED_LINE_FROM
    renamed = F.when(F.col("nombre_linea") == INTERMEDIATE_GATE_LINE, INTERMEDIATE_GATE_NAME)
    return df.withColumns({
        "nombre_linea": F.when(merged, MERGED_LINE_NAME).otherwise(F.coalesce(renamed, F.col("nombre_linea"))),
        "codigo_linea": F.when(merged, F.lit(MERGED_LINE_TO).cast("long")).otherwise(F.col("codigo_linea")),
    })


def consolidate_variants(df: DataFrame, mapping: dict[int, int] | None = None, mode: str = "parity") -> DataFrame:
    """Fold station variants into their principal station.

    ``parity``: every principal row at a timestamp receives the whole variant sum of that
    timestamp; variants without a principal row there disappear, and so do rows without a
    station code. ``regroup``: codes are replaced and rows regrouped; nothing is lost.

    The variants alone are summed by (timestamp, principal code) and joined to the other rows:
    a few codes, so Spark can broadcast the sums and leave the rows where they are. ``df`` is read
    twice; hand over a stored table.
    """
    mapping = STATION_VARIANTS if mapping is None else mapping
    code = F.col("codigo_estacion")
    if mode == "regroup":
        keys = [c for c in df.columns if c not in MEASURES and c not in ("nombre_estacion", "nombre_linea")]
        names = [c for c in ("nombre_linea", "nombre_estacion") if c in df.columns]
        is_main = ~code.isin(list(mapping))
        return (
            df.withColumns({"_main": is_main, "codigo_estacion": recode("codigo_estacion", mapping)})
            .groupBy(*keys)
            .agg(
                *[F.sum(m).alias(m) for m in MEASURES],
                *[F.coalesce(F.min(F.when(F.col("_main"), F.col(c))), F.min(c)).alias(c) for c in names],
            )
            .select(*df.columns)
        )
    if mode != "parity":
        raise ValueError(f"unknown mode {mode!r}")
    is_variant = code.isin(list(mapping))
    sums = df.where(is_variant & F.col("timestamp").isNotNull()).groupBy(
        F.col("timestamp").alias("_at"), recode("codigo_estacion", mapping).alias("_main")
    ).agg(*[F.sum(m).alias(f"_{m}") for m in MEASURES])
    rest = df.where(code.isNotNull() & ~is_variant)
    joined = rest.join(sums, (F.col("timestamp") == F.col("_at")) & (code == F.col("_main")), "left")
    out = {m: F.col(m) + F.coalesce(f"_{m}", F.lit(0)) for m in MEASURES}
    return joined.select(*[out[c].alias(c) if c in out else F.col(c) for c in df.columns])


def lay_out(raw: DataFrame, mapping: dict[int, int], day_parts: int = 1) -> tuple[DataFrame, list[str], list[str]]:
    """Raw rows dealt by day, the one exchange of the cleaning job, with the keys that it keeps and those of a slot.

    Slots, the folding of variants and the files of the table all stay within a day. One sort by the
    keys serves the sums of slots and the folding; the first key packs day, principal code and second
    into one number, so that comparing it settles nearly all pairs of rows. Texts of full width follow
    from the timestamp and aren't moved; others are kept, as they tell slots apart. A table whose days
    outgrow a task takes ``day_parts`` over 1: then a day's stations, each with its variants, are dealt
    over that many tasks.
    """
    ts, texts = parse_ts(*SLOT_KEYS[:2]), F.concat_ws(" ", *SLOT_KEYS[:2])
    rows = raw.select(
        ts.alias("timestamp"), code_of("Estacion").alias("codigo_estacion"),
        F.when(~full_width(texts) | ts.isNull(), F.struct(*SLOT_KEYS[:2])).alias("texto"), "Estacion", "Linea",
        *[F.col(c).cast("long").alias(c) for c in ("Entradas_E", "Salidas_S")],
    )
    rows = rows.withColumns({"fecha": F.col("timestamp").cast("date"), "principal": recode("codigo_estacion", mapping)})
    second = F.unix_seconds("timestamp") - F.unix_date("fecha").cast("long") * 86400
    packed = F.shiftleft(F.unix_date("fecha").cast("long"), 41) + F.shiftleft(F.pmod("principal", F.lit(1 << 24)), 17) + second
    rows = rows.withColumn("orden", packed)
    dealing = ["fecha"]
    if day_parts > 1:
        rows = rows.withColumn("parte", F.pmod(F.xxhash64("principal"), F.lit(day_parts)))
        dealing = ["fecha", "parte"]
    keys = ["orden", *dealing, "principal", "timestamp"]
    return rows.repartition(*dealing), keys, [*keys, "codigo_estacion", "Estacion", "texto"]


def fold_variants(slots: DataFrame, mapping: dict[int, int], keys: list[str], measures: list[str] = MEASURES) -> DataFrame:
    """:func:`consolidate_variants` in parity mode for rows that are dealt and sorted by ``keys``: a window, no join.

    The rows of one principal code and timestamp are neighbours; each principal row adds the sum
    over the variants among them.
    """
    code = F.col("codigo_estacion")
    is_variant = code.isin(list(mapping))
    own, counts = W.partitionBy(*keys), is_variant & F.col("timestamp").isNotNull()
    added = {m: F.coalesce(F.sum(F.when(counts, F.col(m))).over(own), F.lit(0)) for m in measures}
    told = slots.withColumns({f"_{m}": c for m, c in added.items()}).where(code.isNotNull() & ~is_variant)
    return told.withColumns({m: F.col(m) + F.col(f"_{m}") for m in measures}).select(*slots.columns)


def clean_slots(raw: DataFrame, mapping: dict[int, int] | None = None, day_parts: int = 1) -> DataFrame:
    """Raw rows to stored slots in parity mode, with codes of stations and the labels as they came.

    One scan and one exchange, by day; the slots are written once, each day in one file (or in
    ``day_parts``), so the table and the dimensions are written from it without moving rows again.
    """
    mapping = STATION_VARIANTS if mapping is None else mapping
    dealt, keys, slot = lay_out(raw, mapping, day_parts)
    folded = fold_variants(aggregate_slots(dealt, slot), mapping, keys, ["entradas", "salidas"])
    return materialize(folded.select("timestamp", "fecha", "codigo_estacion", "Estacion", "Linea", "entradas", "salidas"))


def name_slots(slots: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Slots with their names, the codes of their lines and the line rules, read off the labels."""
    return recode_lines(derive_fields(slots, keep))


def clean(raw: DataFrame, mode: str = "parity", mapping: dict[int, int] | None = None, day_parts: int = 1) -> DataFrame:
    """Raw rows to fact rows that still carry the raw line and station names; stored, laid out by day."""
    if mode == "parity":
        return name_slots(clean_slots(raw, mapping, day_parts))
    mapping = STATION_VARIANTS if mapping is None else mapping
    dealt, keys, slot = lay_out(raw, mapping, day_parts)
    parts = [k for k in keys if k == "parte"]
    named = name_slots(aggregate_slots(dealt, slot), parts)
    return materialize(consolidate_variants(named, mapping, mode).drop(*parts))


def label_counts(slots: DataFrame) -> DataFrame:
    """How many slots have each combination of codes and names: names are read off the distinct labels, not off rows."""
    counts = slots.groupBy("codigo_estacion", "Estacion", "Linea").agg(F.count("*").alias("len"))
    blank = {"timestamp": F.lit(None).cast("timestamp"), "entradas": F.lit(0), "salidas": F.lit(0)}
    named = name_slots(counts.withColumns(blank), ["len"])
    return named.groupBy("codigo_linea", "nombre_linea", "codigo_estacion", "nombre_estacion").agg(F.sum("len").alias("len"))
