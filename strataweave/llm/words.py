"""Words of whole Arrow text columns as NumPy arrays of hashes and byte positions, for use inside tasks.

Words are runs of bytes outside a separator set, with A-Z lower-cased. A word is known by a 64-bit hash of its bytes: each byte
value and each place in a word has a random number of its own, and the products are summed. No words are made to collide, as they
are with powers of one multiplier; where two words meet by hash, :func:`same_words` compares their bytes.
Nulls have no words. A slice of rows holds about ``SLICE`` bytes, or one longer text, so memory follows the slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE = 4 << 20
_BLOCK = 1 << 16

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Separators of words ``[^\\x20\\x09-\\x0D]+``.
BLANKS = np.zeros(256, dtype=bool)
BLANKS[[32, 9, 10, 11, 12, 13]] = True
#: Separators of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` (after lower-casing).
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[:0x80] = True
SYMBOLS[0x30:0x3A] = SYMBOLS[0x61:0x7B] = SYMBOLS[0x41:0x5B] = False


class Words(NamedTuple):
    hash: np.ndarray  # uint64
    row: np.ndarray  # row of the column
    start: np.ndarray  # byte positions in ``data``
    end: np.ndarray
    data: np.ndarray  # bytes of the column


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _random(n: int, seed: int) -> np.ndarray:
    return mix((np.arange(n, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15))


#: A number for each byte value, equal for both cases of A-Z.
_BYTES = _random(256, 1)[LOWER]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column."""
    if not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column = column.cast(pa.string())
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batches, text: str = "text", limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Cut record batches into slices of about ``limit`` text bytes."""
    for batch in batches:
        _, at = buffers(batch.column(batch.schema.get_field_index(text)))
        row = 0
        while row < len(at) - 1:
            stop = max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1)
            yield batch.slice(row, stop - row)
            row = stop


def words(column: pa.Array, separators: np.ndarray = BLANKS) -> Words:
    data, at = buffers(column)
    pieces = []
    lo = 0
    while lo < len(data):
        hi = min(lo + _BLOCK, len(data))
        while hi < len(data):  # end the block between words
            cut = np.flatnonzero(separators[data[lo:hi]])
            if len(cut):
                hi = lo + int(cut[-1]) + 1
                break
            hi = min(hi + _BLOCK, len(data))
        pieces.append(_block(data, at, lo, hi, separators))
        lo = hi
    if not pieces:
        none = np.zeros(0, np.int64)
        return Words(none.astype(np.uint64), none, none, none, data)
    return Words(*(np.concatenate(x) for x in zip(*pieces)), data)


def _block(data, at, lo, hi, separators):
    inside = ~separators[data[lo:hi]]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    opens = at[np.searchsorted(at, lo, side="left") : np.searchsorted(at, hi, side="left")] - lo  # texts that begin here
    opens = opens[opens < hi - lo]
    first[opens] = inside[opens]
    kept = np.flatnonzero(inside)
    begin = np.flatnonzero(first[kept])
    if not len(begin):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    length = np.diff(np.append(begin, len(kept)))
    place = np.arange(len(kept)) - np.repeat(begin, length)
    hashes = np.add.reduceat(_BYTES[data[lo:hi][kept]] * _random(int(length.max()), 1 << 32)[place], begin)
    start = kept[begin] + lo
    return mix(hashes ^ length.astype(np.uint64)), np.searchsorted(at, start, side="right") - 1, start, start + length


def same_words(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """Whether words ``i`` of ``a`` have the bytes of words ``j`` of ``b``, lower-cased."""
    same = a.end[i] - a.start[i] == b.end[j] - b.start[j]
    equal = np.flatnonzero(same)
    total = np.cumsum(a.end[i[equal]] - a.start[i[equal]])
    lo = 0
    while lo < len(equal):  # about _BLOCK bytes at once
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + _BLOCK)))
        at = equal[lo:hi]
        size = a.end[i[at]] - a.start[i[at]]
        first = np.cumsum(size) - size
        step = np.arange(int(size.sum())) - np.repeat(first, size)
        left, right = (LOWER[x.data[np.repeat(x.start[k[at]], size) + step]] for x, k in ((a, i), (b, j)))
        same[at] = np.add.reduceat((left != right).astype(np.int64), first) == 0
        lo = hi
    return same


def hash_words(texts: list[str | None], separators: np.ndarray = BLANKS) -> list[np.ndarray]:
    """Word hashes of each text."""
    found = words(pa.array(texts, pa.string()), separators)
    return np.split(found.hash, np.searchsorted(found.row, np.arange(1, len(texts))))


def shingle_sets(column: pa.Array, size: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text has its whole word sequence as one."""
    found = words(column)
    seed = mix(found.hash)
    count = np.bincount(found.row, minlength=len(column))
    whole = np.zeros(len(seed), np.uint64)
    for k in range(size):
        part = np.zeros(len(seed), np.uint64)
        part[: len(seed) - k] = seed[k:] if k else seed
        whole += part * power_of(k)
    whole = mix(whole)
    sets, at = [], 0
    for n in count.tolist():
        if n >= size:
            sets.append(np.unique(whole[at : at + n - size + 1]))
        elif n:
            short = seed[at : at + n]
            value = sum(int(x) * int(power_of(k)) for k, x in enumerate(short)) + n
            sets.append(mix(np.array([value & 0xFFFFFFFFFFFFFFFF], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
        at += n
    return sets


def power_of(k: int) -> np.uint64:
    return _random(1, (k + 1) << 40)[0]
