"""Tokens of whole Arrow text columns as codes into their exact distinct byte strings, for use inside tasks.

A token is a run of bytes outside a separator set. Tokens are told apart by their bytes, not by hashes. Nulls have none.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

from strataweave.llm.words import buffers

SPACES = np.zeros(256, dtype=bool)
SPACES[[32, 9, 10, 13]] = True


class Tokens(NamedTuple):
    code: np.ndarray  # of each token, in order
    row: np.ndarray  # row of the column
    start: np.ndarray  # byte positions in the column's bytes
    end: np.ndarray
    distinct: pa.Array  # binary


_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[65:91] = _LETTERS[97:123] = True


def tokens(column: pa.Array, separators: np.ndarray, lower: np.ndarray | None = None, ends: np.ndarray | None = None) -> Tokens:
    """Tokens of each text; ``lower`` maps bytes before they are compared, ``ends`` begin a new token after a letter."""
    data, at = buffers(column)
    inside = ~separators[data]
    cut = np.zeros(len(data) + 1, dtype=bool)  # before each byte
    cut[at] = True
    cut[1:-1] |= ~inside[1:] | ~inside[:-1]
    if ends is not None:
        cut[1:-1] |= _LETTERS[data[:-1]] & ends[data[1:]]
    start = np.flatnonzero(inside & cut[:-1])
    end = np.flatnonzero(inside & cut[1:]) + 1
    kept = data[inside]
    if lower is not None:
        kept = lower[kept]
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(kept))])
    coded = words.dictionary_encode()
    row = np.searchsorted(at, start, side="right") - 1
    return Tokens(coded.indices.to_numpy().astype(np.int64), row, start, end, coded.dictionary)
