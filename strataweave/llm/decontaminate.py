"""Operator 3: benchmark decontamination with an FM-index per shard of training texts.

A window is 13 consecutive words of a benchmark item; an item of fewer words is one window. Each task takes shards of about
``SHARD`` text bytes. Words that no item has become separators, and stretches between separators that are shorter than the
shortest window are left out, as nothing can occur there. The rest is indexed: suffix array, Burrows-Wheeler transform, a
wavelet matrix for its ranks and suffix positions sampled by text place. All windows are searched backwards at once, their
occurrences located by walking to a sampled place, and overlapping or adjacent ones merged into removal spans.

The benchmark is the query set: it is read in blocks of ``BLOCK_BYTES``, each broadcast by itself; with more than one block the
hits of a text are united by its row. Nothing is shuffled with a single block.

Null and empty texts have no words and are clean. Repeated rows are judged each by itself. Items without words have no
window; items without an id count as hits but are not listed. Other columns pass through :func:`decontaminate` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.llm.words import SYMBOLS, Words, buffers, same_words, slices, words
from strataweave.session import stage

WINDOW = 13
SHARD = 8 << 20
BLOCK_BYTES = 32 << 20
SAMPLE = 16
_REPORT = "n_words long, spans array<struct<start: long, end: long>>, n_hit long, items array<string>"


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes; every separator (0) counts as a symbol of its own, by place."""
    size = len(symbols)
    stops = symbols == 0
    first = np.where(stops, np.cumsum(stops) - 1, symbols.astype(np.int64) + int(stops.sum()))
    order = np.argsort(first, kind="stable")
    rank = np.empty(size, np.int64)

    def ranked(part, at, keys):
        """Ranks of one sorted stretch list: the place of the first of each run of equal keys."""
        new = np.append(True, keys[1:] != keys[:-1])
        rank[part] = at[np.flatnonzero(new)][np.cumsum(new) - 1]
        return new

    at = np.arange(size)
    new = ranked(order, at, first[order])
    step = 1
    while True:
        tied = ~(new & np.append(new[1:], True))
        at = at[tied]
        if not len(at):
            return order
        part = order[at]
        later = np.minimum(part + step, size - 1)
        keys = rank[part] * np.int64(size + 1) + np.where(part + step < size, rank[later] + 1, 0)
        by = np.argsort(keys, kind="stable")
        part, keys = part[by], keys[by]
        order[at] = part
        new = ranked(part, at, keys)
        step *= 2


class FmIndex:
    """Counts and places of word sequences in ``symbols`` (0 is a separator and ends the array)."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        order = suffix_array(symbols)
        self.size = len(symbols)
        self.last = symbols[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=alphabet + 1))])
        marked = (order % SAMPLE == 0) | (symbols[order - 1] == 0)
        self.marked = marked
        self.place = np.where(marked, order, -1)
        self.levels = []
        level = self.last
        for bit in reversed(range(max(1, int(alphabet).bit_length()))):
            ones = (level >> bit) & 1
            self.levels.append((bit, np.concatenate([[0], np.cumsum(ones)]).astype(np.int32), int(len(level) - ones.sum())))
            level = np.concatenate([level[ones == 0], level[ones == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before row ``at`` of the transform."""
        low = np.zeros(len(at), np.int64)
        for bit, ones, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            up, base = ones[at], ones[low]
            at = np.where(one, zeros + up, at - up)
            low = np.where(one, zeros + base, low - base)
        return at - low

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of sequences of one length those that occur, and their row ranges."""
        which = np.arange(len(windows))
        lo, hi = np.zeros(len(windows), np.int64), np.full(len(windows), self.size, np.int64)
        for k in reversed(range(windows.shape[1])):
            c = windows[which, k]
            lo = self.before[c] + self.rank(c, lo)
            hi = self.before[c] + self.rank(c, hi)
            some = hi > lo
            which, lo, hi = which[some], lo[some], hi[some]
        return which, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of rows, by stepping back to a sampled one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        while True:
            open_ = np.flatnonzero(~self.marked[rows])
            if not len(open_):
                return self.place[rows] + steps
            c = self.last[rows[open_]].astype(np.int64)
            rows[open_] = self.before[c] + self.rank(c, rows[open_])
            steps[open_] += 1


class Windows(NamedTuple):
    vocabulary: np.ndarray  # sorted word hashes; a word's symbol is its place plus one
    spelled: Words  # the words of the vocabulary, in its order
    by_length: dict  # length -> distinct windows as rows of symbols
    owners: dict  # length -> (offsets, item numbers)
    items: list  # item ids as strings, or None


def windows_of(ids: list, texts: list[str | None]) -> Windows:
    found = words(pa.array(texts, pa.string()), SYMBOLS)
    vocabulary, once = np.unique(found.hash, return_index=True)
    spelled = Words(*(x[once] for x in found[:-1]), found.data)
    symbol = np.searchsorted(vocabulary, found.hash) + 1
    ends = np.searchsorted(found.row, np.arange(len(texts)), side="right")
    made: dict[int, list] = {}
    start = 0
    for item, end in enumerate(ends.tolist()):
        n = min(WINDOW, end - start)
        if n:
            rows = np.lib.stride_tricks.sliding_window_view(symbol[start:end], n)
            made.setdefault(n, []).append((rows, np.full(len(rows), item)))
        start = end
    by_length, owners = {}, {}
    for n, parts in made.items():
        rows, inverse = np.unique(np.concatenate([p[0] for p in parts]), axis=0, return_inverse=True)
        item = np.concatenate([p[1] for p in parts])
        order = np.argsort(inverse.ravel(), kind="stable")
        by_length[n] = rows
        owners[n] = (np.searchsorted(inverse.ravel()[order], np.arange(len(rows) + 1)), item[order])
    return Windows(vocabulary, spelled, by_length, owners, [None if i is None else str(i) for i in ids])


def _expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges, and the range each is from."""
    size = hi - lo
    owner = np.repeat(np.arange(len(lo)), size)
    return np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + lo[owner], owner


def scan_shard(column: pa.Array, windows: Windows):
    """Per text: words, hit words, merged byte spans and item ids."""
    n_rows = len(column)
    found = words(column, SYMBOLS)
    n_words = np.bincount(found.row, minlength=n_rows)
    hit = np.zeros(len(found.hash), bool)
    items: list[list[str]] = [[] for _ in range(n_rows)]
    if windows.by_length and len(found.hash):
        at = np.minimum(np.searchsorted(windows.vocabulary, found.hash), len(windows.vocabulary) - 1)
        known = windows.vocabulary[at] == found.hash
        met = np.flatnonzero(known)
        known[met] = same_words(found, met, windows.spelled, at[met])
        cut = np.append(True, (found.row[1:] != found.row[:-1]) | (known[1:] != known[:-1]))
        begin = np.flatnonzero(cut)
        length = np.diff(np.append(begin, len(known)))
        wanted = known[begin] & (length >= min(windows.by_length))
        begin, length = begin[wanted], length[wanted]
        if len(begin):
            word, run = _expand(begin, begin + length)
            spot = np.arange(len(word)) + run  # one separator after each stretch
            symbols = np.zeros(len(word) + len(begin), np.int64)
            symbols[spot] = at[word] + 1
            origin = np.zeros(len(symbols), np.int64)
            origin[spot] = word
            index = FmIndex(symbols, len(windows.vocabulary))
            pairs = []
            for n, rows in windows.by_length.items():
                which, lo, hi = index.search(rows)
                if not len(which):
                    continue
                places, owner = _expand(lo, hi)
                first = origin[index.locate(places)]
                covered = np.zeros(len(hit) + 1, np.int64)
                np.add.at(covered, first, 1)
                np.add.at(covered, first + n, -1)
                hit |= np.cumsum(covered)[:-1] > 0
                met = np.unique(found.row[first] * np.int64(len(rows)) + which[owner])
                offsets, item = windows.owners[n]
                at_item, from_ = _expand(offsets[met % len(rows)], offsets[met % len(rows) + 1])
                pairs.append(np.unique((met // len(rows))[from_] * np.int64(len(windows.items)) + item[at_item]))
            for pair in (np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)).tolist():
                name = windows.items[pair % len(windows.items)]
                if name is not None:
                    items[pair // len(windows.items)].append(name)
    n_hit = np.bincount(found.row[hit], minlength=n_rows)
    spots = np.flatnonzero(hit)
    fresh = np.append(True, (spots[1:] != spots[:-1] + 1) | (found.row[spots[1:]] != found.row[spots[:-1]])) if len(spots) else np.zeros(0, bool)
    opens = spots[fresh]
    closes = spots[np.append(fresh[1:], True)] if len(spots) else spots
    base = buffers(column)[1]
    row = found.row[opens]
    offsets = np.searchsorted(row, np.arange(n_rows + 1)).astype(np.int32)
    spans = pa.ListArray.from_arrays(
        pa.array(offsets),
        pa.StructArray.from_arrays([pa.array(found.start[opens] - base[row], pa.int64()), pa.array(found.end[closes] - base[row], pa.int64())], ["start", "end"]),
    )
    return n_words, spans, n_hit, [sorted(set(x)) for x in items]


def _report(windows, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=SHARD):
            n_words, spans, n_hit, items = scan_shard(part.column("text"), windows.value)
            yield pa.RecordBatch.from_arrays(
                [part.column(key), pa.array(n_words, pa.int64()), spans, pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string()))],
                [key, "n_words", "spans", "n_hit", "items"],
            )

    return run


def _clean(windows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=SHARD):
            n_words, _, n_hit, _ = scan_shard(part.column(part.schema.get_field_index("text")), windows.value)
            yield part.filter(pa.array((n_hit == 0) | (20 * n_hit < n_words)))

    return run


def query_blocks(benchmark: DataFrame) -> list:
    """The benchmark's windows, broadcast in blocks of about ``BLOCK_BYTES``."""
    context = benchmark.sparkSession.sparkContext
    rows = benchmark.select("item_id", "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES) or 1
    out = []
    for k in range(blocks):
        part = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        table = part.toArrow()
        out.append(context.broadcast(windows_of(table.column("item_id").to_pylist(), table.column("text").to_pylist())))
    return out


def _merged(docs: DataFrame, blocks: list) -> DataFrame:
    """Report by ``row`` over several query blocks: spans of all blocks united word by word."""
    texts = docs.select("row", "text")
    key = docs.schema["row"].dataType.simpleString()
    parts = None
    for windows in blocks:
        part = texts.mapInArrow(_report(windows, "row"), f"row {key}, {_REPORT}")
        parts = part if parts is None else parts.unionByName(part)
    grouped = parts.groupBy("row").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("raw"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    # the words of a text that lie in any span; spans end with their last word
    return grouped.join(texts, "row").mapInArrow(_united, f"row {key}, {_REPORT}")


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        found = words(part.column("text"), SYMBOLS)
        begin = buffers(part.column("text"))[1]
        at = np.searchsorted(found.row, np.arange(part.num_rows + 1))
        spans, counts = [], []
        for i, raw in enumerate(part.column("raw").to_pylist()):
            own = slice(at[i], at[i + 1])
            start, end = found.start[own], found.end[own]
            base = int(begin[i])
            hit = np.zeros(len(start), bool)
            for s in raw:
                hit[np.searchsorted(start, base + s["start"]) : np.searchsorted(end, base + s["end"], side="right")] = True
            edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
            opens, closes = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
            spans.append([{"start": int(start[a] - base), "end": int(end[b] - base)} for a, b in zip(opens, closes)])
            counts.append(int(hit.sum()))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [part.column("row"), part.column("n_words"), pa.array(spans, kind), pa.array(counts, pa.int64()), part.column("items")],
            ["row", "n_words", "spans", "n_hit", "items"],
        )


def contaminated():
    """At least one word in twenty is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def scan(docs: DataFrame, benchmark: DataFrame, blocks: list | None = None) -> DataFrame:
    """``doc_id, n_words, n_hit, spans`` (bytes of the UTF-8 text)``, items`` (sorted strings)``, contaminated`` of every row."""
    blocks = blocks or query_blocks(benchmark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    if len(blocks) == 1:
        report = docs.select("doc_id", "text").mapInArrow(_report(blocks[0], "doc_id"), f"doc_id {kind}, {_REPORT}")
    else:
        rows = stage(docs.select(F.struct(F.monotonically_increasing_id().alias("at"), "doc_id").alias("row"), "text"))
        report = _merged(rows, blocks).withColumn("doc_id", F.col("row.doc_id"))
    return report.select("doc_id", "n_words", "n_hit", "spans", "items", contaminated().alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, blocks: list | None = None) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    blocks = blocks or query_blocks(benchmark)
    if len(blocks) == 1:
        return docs.mapInArrow(_clean(blocks[0]), docs.schema)
    rows = stage(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")))
    bad = _merged(rows.select("row", F.col("doc.text").alias("text")), blocks).filter(contaminated())
    return rows.join(bad.select("row"), "row", "left_anti").select("doc.*")
