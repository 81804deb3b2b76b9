"""Raw files to fact table and dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from farebox.operators.clean import clean, clean_slots, label_counts, name_slots
from farebox.operators.dims import build_dimensions, dimensions_of
from farebox.session import at_once, materialize, scratch
from farebox.sources.facts import DAY_PARTS, write_validations
from farebox.sources.raw import bad_inputs, extract_archives, extracted_rows, headers_differ, read_raw_csv
from farebox.sources.sinks import write_dims, write_table


def build_warehouse(raw: DataFrame, out: str, mode: str = "parity", day_parts: int = DAY_PARTS) -> None:
    """Clean raw rows, write ``validations`` and the three dimensions below ``out``.

    The cleaned rows feed both outputs and are in the checkpoint folder, dealt by day, so the raw files
    are read and shuffled a single time and a lost executor costs a re-read of that folder only. It is
    deleted when the outputs stand.
    """
    with scratch(raw.sparkSession):
        if mode == "parity":
            slots = clean_slots(raw, day_parts=day_parts)
            named, counts = name_slots(slots), label_counts(slots)
        else:
            named = clean(raw, mode, day_parts=day_parts)
            counts = None
        # Table and dimensions don't wait for each other: the table's last files leave cores idle.
        at_once(
            lambda: write_validations(named, f"{out}/validations", day_parts=day_parts, laid_out=True),
            lambda: write_dims(*(build_dimensions(named) if counts is None else dimensions_of(counts)), f"{out}/dims"),
        )


def run_from_csv(spark: SparkSession, csv_path, out: str, mode: str = "parity", day_parts: int = DAY_PARTS) -> None:
    """Files of one header, as published, are one scan that checks it; others are sorted out by a census first.

    A scan that meets another header fails before anything is written.
    """
    try:
        build_warehouse(read_raw_csv(spark, csv_path, uniform=True), out, mode, day_parts)
    except Exception as error:
        if not headers_differ(error):
            raise
        build_warehouse(read_raw_csv(spark, csv_path), out, mode, day_parts)


def run_from_archives(spark: SparkSession, zip_path: str, out: str, mode: str = "parity") -> None:
    """As :func:`run_from_csv` for ZIP archives; unreadable inputs are listed in ``bad_inputs``."""
    with scratch(spark):
        extracted = materialize(extract_archives(spark, zip_path))
        write_table(bad_inputs(extracted), f"{out}/bad_inputs")
        build_warehouse(extracted_rows(extracted), out, mode)
