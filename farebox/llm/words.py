"""Words and lines of many texts at once: cut in numpy, numbered exactly by Arrow's dictionaries."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass
class Pieces:
    """Pieces of text: distinct ones in ``values``; piece k is ``values[ids[k]]``, in row ``rows[k]``."""

    values: pa.Array
    ids: np.ndarray
    rows: np.ndarray
    starts: np.ndarray


def cut(raw: np.ndarray, limits: np.ndarray, inside: np.ndarray) -> Pieces:
    """Longest runs of bytes that are ``inside``, none across the limits of rows."""
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    filled = limits[:-1][limits[1:] > limits[:-1]]
    begin[filled] = inside[filled]
    starts = np.flatnonzero(begin)
    # Inside bytes in a row: a piece's length is how many there are up to the next piece.
    before = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(inside, out=before[1:])
    offsets = np.append(before[starts], before[-1])
    return numbered(raw[inside], offsets, np.searchsorted(limits, starts, "right") - 1, starts)


def numbered(data: np.ndarray, offsets: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> Pieces:
    buffers = [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data)]
    known = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, buffers).dictionary_encode()
    return Pieces(known.dictionary, known.indices.to_numpy(zero_copy_only=False).astype(np.int64), rows, starts)


def lines(raw: np.ndarray, limits: np.ndarray) -> Pieces:
    """The parts between line feeds of every row."""
    feed = raw == 0x0A
    at = np.flatnonzero(feed)
    rows = np.concatenate([np.arange(len(limits) - 1), np.searchsorted(limits, at, "right") - 1])
    starts = np.concatenate([limits[:-1], at + 1])
    order = np.lexsort((starts, rows))
    rows, starts = rows[order], starts[order]
    before = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(~feed, out=before[1:])
    return numbered(raw[~feed], np.append(before[starts], before[-1]), rows, starts)


def joined(first: np.ndarray, second: np.ndarray, span: int) -> np.ndarray:
    """A number from 0 for each different pair of numbers; ``span`` is above all of the second."""
    return pd.factorize(first * np.int64(span) + second)[0].astype(np.int64)


_CODES = np.arange(256, dtype=np.uint8)
LOWER = np.where((_CODES >= 65) & (_CODES <= 90), _CODES + 32, _CODES).astype(np.uint8)
