"""Helpers shared by the operators: Arrow text as numpy buffers, appended columns, digests of span lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text bytes an operator works on at a time inside a task; bounds its temporary arrays.
SLICE_BYTES = 2 << 20


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the row limits (n + 1 offsets from 0); null is empty.

    The bytes are a view of the Arrow buffer and must not be written to.
    """
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if not len(offsets):
        return raw[:0], np.zeros(1, np.int64)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes of text; a longer row stands alone."""
    _, offsets = text_buffer(batch.column(column))
    start, rows = 0, batch.num_rows
    while start < rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), rows)
        yield batch.slice(start, stop - start)
        start = stop


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` has it (upper and lower case are equal)."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def append_columns(
    df: DataFrame,
    column: str,
    fields: T.StructType,
    function: Callable[[pa.Array], list[pa.Array]],
    limit: int = SLICE_BYTES,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add what ``function`` makes of the values in ``column``, a slice of rows at a time.

    Every row is kept, with its other columns or those in ``keep``; one that is named like a
    result is replaced by it. The function holds nothing between slices but what it was made
    with, so a task can be run again anywhere.
    """
    new = {f.name.lower() for f in fields}
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    source = column if column in keep else fresh(df, "column_in")[0]
    sent = [F.col(f"`{c}`") for c in keep] + ([] if column in keep else [F.col(f"`{column}`").alias(source)])
    df = df.select(*sent)
    schema = T.StructType([f for f in df.schema if f.name in keep] + list(fields))

    def run(batches):
        for batch in batches:
            for part in slices(batch, source, limit):
                arrays = [part.column(c) for c in keep] + function(part.column(source))
                yield pa.RecordBatch.from_arrays(arrays, names=keep + [f.name for f in fields])
                del arrays
            # Workers are kept for later stages; what a batch took goes back to the system.
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def list_array(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A list per row out of flat values and the number of them in each row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


SPAN = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("base", T.BooleanType()),
    ]
)
SPANS = T.ArrayType(SPAN)
SPANS_ARROW = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])
)


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of every span in order, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def span_digests(spans: Column, kinds: list[str]) -> list[Column]:
    """Counts of the base spans by kind, the digest of the base spans, and all spans as text."""
    base = F.filter(spans, lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in kinds]
    return [*counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(spans).alias("spans")]


def code_points(data: bytes, positions: list[int]) -> list[int]:
    """Code points before each of the ascending byte positions."""
    out, last, count = [], 0, 0
    for position in positions:
        count += len(data[last:position].decode("utf-8", "ignore"))
        out.append(count)
        last = position
    return out
