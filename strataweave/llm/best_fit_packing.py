"""Operator 11: documents packed into sequences of bounded length, by bin completion with branch and bound.

Only lengths matter to a packing, and there are at most ``capacity`` different ones, so the packing is found on the histogram
of all lengths: a list of fillings, each with the number of sequences that repeat it. The histogram and the list are all
that the driver sees, and both are bounded by ``capacity``, whatever the number of documents.

A filling is found around the largest document left. Best fit (the largest length that fits the room, until none fits) gives the
incumbent. If it needs more sequences than the lower bound, bin completion looks for one less: it enumerates the fillings around the
largest document that are not dominated (no longer document left could take the place of one or two of their
documents, and nothing more fits), least waste first, and cuts a branch whose waste, with the least waste of the rest, exceeds
what one sequence less allows. A success is the next incumbent. Packing is NP-hard: the search ends after
``nodes`` fillings, and it repeats a filling as often as its documents allow.

Spark tokenizes, counts lengths, numbers the pieces of a length through counts of partitions, and looks the number up in the
broadcast list of fillings (at most about ``capacity * log(capacity)`` fillings, as each uses up one length but for a remainder).

Defined cases: null and empty texts are one end id; rows repeated or without id are documents of their own; only documents over
``capacity`` are cut; an empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataweave.llm.tokens import SPACES, tokens
from strataweave.llm.words import LOWER, buffers, slices
from strataweave.session import fits_broadcast, stage

CAPACITY = 4096
END = 1
#: Fillings tried by the search, and fillings and steps looked at around one document.
NODES, WIDTH, STEPS = 3_000, 12, 400
#: Every so many fillings the rest is packed by best fit.
TAIL = 128
#: Text bytes of a slice.
SLICE = 8 << 20
#: Words encoded in one call.
_TOGETHER = 20_000
#: Marks that may end a word.
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".,;:!?"]] = True

Filling = tuple[tuple[int, int], ...]  # (length, copies), longest first


# ---- packing of a histogram -------------------------------------------------------------------


def lower_bound(left: np.ndarray, capacity: int) -> int:
    """Sequences that any packing of ``left[length]`` documents needs (Martello and Toth's L2)."""
    sizes = np.arange(capacity + 1)
    count, total = np.cumsum(left), np.cumsum(left * sizes)
    half = capacity // 2
    k = np.arange(half + 1)
    # documents over capacity - k are alone; those over half have no other such; those of at least k fill up
    alone = count[-1] - count[capacity - k]
    large, large_sum = count[capacity - k] - count[half], total[capacity - k] - total[half]
    small = total[half] - np.where(k > 0, total[k - 1], 0)
    most = alone + large + np.maximum(0, -(-(small - (large * capacity - large_sum)) // capacity))
    return max(-(-int(total[-1]) // capacity), int(most.max()))


def _times(left: np.ndarray, filling: Filling) -> int:
    return min(int(left[n]) // m for n, m in filling)


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[int, Filling]]:
    """``(times, filling)``: each filling takes the largest lengths that still fit, as often as all of them are left."""
    left, done = left.copy(), []
    present = np.flatnonzero(left)
    while len(present):
        filling, room = [], capacity
        at = len(present) - 1
        while at >= 0:
            n = int(present[at])
            m = min(room // n, int(left[n]))
            if m:
                filling.append((n, m))
                room -= n * m
            at = min(at, int(np.searchsorted(present, room, side="right"))) - 1 if m else at - 1
        times = _times(left, filling)
        for n, m in filling:
            left[n] -= m * times
        done.append((times, tuple(filling)))
        if any(left[n] == 0 for n, _ in filling):
            present = present[left[present] > 0]
    return done


def _dominated(chosen: list[int], waste: int, left: np.ndarray) -> bool:
    """Whether a longer document left over could take the place of one or two chosen ones."""
    sizes, used = np.unique(chosen, return_counts=True)
    free = left.copy()
    free[sizes] -= used
    pairs = {a + b for i, a in enumerate(chosen) for b in chosen[i + 1 :]}
    return any(free[n + 1 : n + waste + 1].any() for n in sizes.tolist()) or any(free[n : n + waste + 1].any() for n in pairs)


def completions(left: np.ndarray, room: int, slack: int) -> list[tuple[int, list[int]]]:
    """``(waste, lengths)``: undominated fillings of ``room`` from ``left`` with a waste of at most ``slack``."""
    if room == 0 or left[room]:
        return [(0, [room] if room else [])]  # a single document that fits exactly dominates all others
    present = np.flatnonzero(left[: room + 1])
    if not len(present):
        return [(room, [])] if room <= slack else []
    found, steps, least = [], 0, int(present[0])
    mates = room - present
    exact = present[(mates >= present) & (left[mates] > (mates == present))]
    if len(exact):
        return [(0, [room - int(a), int(a)]) for a in exact[:WIDTH]]
    path: list[int] = []

    def fill(room: int, top: int) -> None:
        nonlocal steps
        steps += 1
        if steps > STEPS or len(found) >= WIDTH or (found and not found[-1][0]):
            return
        if room < least or top < least:
            if room <= slack and not _dominated(path, room, left):
                found.append((room, path[:]))
            return
        at = int(np.searchsorted(present, min(room, top), side="right")) - 1
        fits = False
        while at >= 0 and steps <= STEPS and len(found) < WIDTH:
            n = int(present[at])
            if left[n] > path.count(n):
                fits = True
                path.append(n)
                fill(room - n, n)
                path.pop()
            at -= 1
        if not fits and room <= slack and not _dominated(path, room, left):
            found.append((room, path[:]))

    fill(room, room)
    return sorted(found, key=lambda x: (x[0], len(x[1])))


def complete(left: np.ndarray, capacity: int, sequences: int, nodes: Iterator[int]) -> list[tuple[int, Filling]] | None:
    """A packing into at most ``sequences``, or None where the search finds none before ``nodes`` end."""
    total = int((left * np.arange(capacity + 1)).sum())
    slack = sequences * capacity - total
    if slack < 0:
        return None
    state, done, spent = left.copy(), [], 0
    open_: list[Iterator] = []

    def branches(wasted: int) -> Iterator[tuple[int, int, Filling]]:
        top = int(np.flatnonzero(state)[-1])
        state[top] -= 1
        options = completions(state, capacity - top, slack - wasted)
        state[top] += 1
        for waste, chosen in options:
            sizes, copies = np.unique([top, *chosen], return_counts=True)
            filling = tuple(zip(sizes.tolist()[::-1], copies.tolist()[::-1]))
            times = _times(state, filling)  # all possible repeats at once: counts of any size take few fillings
            if waste:
                times = min(times, (slack - wasted) // waste)
            if times:
                yield waste, times, filling

    wasted, used = 0, 0
    open_.append(branches(0))
    while open_:
        step = next(open_[-1], None)
        if step is None:
            open_.pop()
            if done:
                waste, times, filling = done.pop()
                wasted, used = wasted - waste * times, used - times
                for n, m in filling:
                    state[n] += m * times
            continue
        spent += 1
        if next(nodes, None) is None:
            return None
        waste, times, filling = step
        for n, m in filling:
            state[n] -= m * times
        wasted, used = wasted + waste * times, used + times
        done.append((waste, times, filling))
        rest = used + lower_bound(state, capacity) if state.any() else used
        if rest > sequences:  # the waste so far and the least waste of the rest are too much
            open_.append(iter(()))
        elif not state.any():
            return [(t, f) for _, t, f in done]
        else:
            tail = best_fit(state, capacity) if spent % TAIL == 1 else []
            if tail and used + sum(t for t, _ in tail) <= sequences:
                return [(t, f) for _, t, f in done] + tail
            open_.append(branches(wasted))
    return None


def pack(counts: np.ndarray, capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[int, Filling]]:
    """``(times, filling)`` of a packing of ``counts[length]`` documents into few sequences."""
    found = best_fit(counts, capacity)
    bound = lower_bound(counts, capacity)
    left = iter(range(nodes))
    while (used := sum(t for t, _ in found)) > bound:
        better = complete(counts, capacity, used - 1, left)
        if better is None:
            break
        found = better
    return found


# ---- documents ---------------------------------------------------------------------------------


def _cut(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(path)
        seen = np.zeros(capacity + 1, np.int64)
        part = TaskContext.get().partitionId()
        for batch in slices(batches, limit=SLICE):
            ids, at = token_ids(known, batch.column("text"))
            n = np.diff(at)
            pieces = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(capacity, n[row] - start)
            raw = memoryview(ids.astype("<u4").tobytes())
            begin = 4 * (at[row] + start)
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(begin.tolist(), (begin + 4 * length).tolist())]
            order = np.argsort(length, kind="stable")
            runs = np.bincount(length, minlength=capacity + 1)
            spot = np.empty(len(row), np.int64)
            spot[order] = np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs)
            spot += seen[length]
            seen += runs
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row)),
                    pa.array(piece.astype(np.int32)),
                    pa.array(start),
                    pa.array(length),
                    pa.array(crc, pa.int64()),
                    pa.array(np.full(len(row), part, np.int32)),
                    pa.array(spot),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "spot"],
            )

    return run


class _Known:
    """Ids of the words met so far by a worker; past ``limit`` words it begins anew."""

    def __init__(self, path: str, limit: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.mark = self.tokenizer.encode("\x01", add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.words, self.ids, self.first, self.width = pa.array([], pa.large_binary()), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def look_up(self, words: pa.Array) -> np.ndarray:
        """Place of each word in ``first`` and ``width``."""
        if len(self.words) > self.limit:
            self.forget()
        found = pc.index_in(words, self.words)
        missing = pc.is_null(found).to_numpy(zero_copy_only=False)
        place = found.fill_null(0).to_numpy().astype(np.int64)
        if missing.any():
            place[missing] = len(self.words) + np.arange(int(missing.sum()))
            fresh = words.filter(pa.array(missing))
            ids, width = self._encode(fresh.cast(pa.large_string()).to_pylist())
            self.first = np.append(self.first, len(self.ids) + np.cumsum(width) - width)
            self.width, self.ids = np.append(self.width, width), np.append(self.ids, ids)
            self.words = pa.concat_arrays([self.words, fresh])
        return place

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words and how many each has; words are encoded together, told apart by the id of a mark none of them has."""
        ids, widths = [], []
        for at in range(0, len(words), _TOGETHER):
            block = words[at : at + _TOGETHER]
            if len(self.mark) == 1 and not any("\x01" in w or "<|" in w for w in block):
                got = np.array(self.tokenizer.encode("\n\x01\n".join(block), add_special_tokens=False).ids, np.int64)
                marks = np.flatnonzero(got == self.mark[0])
                if len(marks) == len(block) - 1:
                    ids.append(np.delete(got, marks))
                    widths.append(np.diff(np.concatenate([[-1], marks, [len(got)]])) - 1)
                    continue
            each = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in block]
            ids.append(np.array([i for x in each for i in x], np.int64))
            widths.append(np.array([len(x) for x in each], np.int64))
        return np.concatenate(ids), np.concatenate(widths)


@cache
def _known(path: str) -> _Known:
    return _Known(path)


def token_ids(known: _Known, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each text with the end id, and where each text begins.

    The tokenizer drops white space and ignores case, and it joins neither what stands on both sides of a blank nor a letter and
    the mark after it, so the distinct stretches between these are encoded once. Special tokens have marks
    within, so a slice of texts with ``<|`` keeps its case and is cut at blanks only.
    """
    data, _ = buffers(column)
    special = b"<|" in data.tobytes()
    found = tokens(column, SPACES) if special else tokens(column, SPACES, LOWER, ends=_ENDS)
    place = known.look_up(found.distinct)[found.code]
    w, first = known.width[place], known.first[place]
    n = np.bincount(found.row, weights=w, minlength=len(column)).astype(np.int64) + 1
    at = np.zeros(len(column) + 1, np.int64)
    np.cumsum(n, out=at[1:])
    ids = np.full(int(at[-1]), END, np.int64)
    source = np.repeat(first - (np.cumsum(w) - w), w) + np.arange(int(w.sum()))
    target = np.ones(len(ids), dtype=bool)
    target[at[1:] - 1] = False
    ids[target] = known.ids[source]
    return ids, at


def _slots(packing: list[tuple[int, Filling]], capacity: int):
    """Ranges of the pieces in order of length and number: first piece, copies a sequence, first sequence, place, and length."""
    rows, sequence = [], 0
    for times, filling in packing:
        place = 0
        for n, m in filling:
            rows.append((n, times * m, m, sequence, place))
            place += n * m
        sequence += times
    rows.sort(key=lambda r: r[0])
    table = np.array(rows, np.int64).reshape(-1, 5)
    first = np.cumsum(table[:, 1]) - table[:, 1]
    lengths = np.zeros(capacity + 2, np.int64)
    np.add.at(lengths, table[:, 0] + 1, table[:, 1])
    return first, table[:, 2].copy(), table[:, 3].copy(), table[:, 4].copy(), np.cumsum(lengths)


def _place(slots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, copies, sequence, place, shorter = slots.value
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            overall = shorter[length] + number
            k = np.searchsorted(first, overall, side="right") - 1
            nth = overall - first[k]
            columns = {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            columns["sequence_id"] = pa.array(sequence[k] + nth // copies[k])
            columns["offset"] = pa.array(place[k] + nth % copies[k] * length)
            yield pa.RecordBatch.from_pydict(columns)

    return run


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    kind = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)])
    for name, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())):
        kind = kind.add(name, t)
    cut = T.StructType(kind.fields + [T.StructField("part", T.IntegerType()), T.StructField("spot", T.LongType())])
    pieces = stage(docs.select("doc_id", "text").mapInArrow(_cut(tokenizer, capacity), cut))
    parts = stage(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in parts.groupBy("length").agg(F.sum("n")).collect():  # at most one row a length
        counts[length] = n
    slots = spark.sparkContext.broadcast(_slots(pack(counts, capacity, nodes), capacity))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    base = F.broadcast(base) if fits_broadcast(parts) else base
    numbered = pieces.join(base, ["part", "length"]).withColumn("number", F.col("base") + F.col("spot"))
    placed = T.StructType(kind.fields + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return numbered.drop("part", "spot", "base").mapInArrow(_place(slots), placed)
