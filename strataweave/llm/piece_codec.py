"""Operator 6: SentencePiece encoding and decoding by suffix-array matching.

Texts are normalised as the model says for an identity normaliser: a word mark is put before the text and stands for every
blank. The segmentation is the one of greatest total piece score (ties to the longest last piece), as for a unigram model with
the scores of the given vocabulary; characters without a piece become byte pieces.

A task takes the texts of a batch, cuts them where no piece of the vocabulary can cross (before a word mark that follows
another character) and concatenates the distinct chunks that it has not met lately. Over this text it builds a suffix array ordered to the depth of the
longest piece, finds the range of every piece by binary search, expands the ranges to edges, sorts them by position and
relaxes them from each position to the next, all chunks in step. Texts are put together from their chunks, so the work of
matching follows the distinct chunks, and no row is moved between tasks.

Null text: null ids. Empty text: no ids. Decoding gives back every text exactly, except that U+2581, the word mark itself,
comes back as a blank. Repeated rows are encoded each by itself; other columns pass through unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strataweave.llm.words import slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Penalty of a character without a piece, below the least score.
UNKNOWN_PENALTY = 10.0
_SLICE = 4 << 20
#: Characters that are matched at once, and chunks after which a task forgets what it has matched.
PART = 600_000
REMEMBERED = 200_000
_LOADED: dict[str, "Codec"] = {}


class Memory:
    """Chunks that a task has matched before, with their ids."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.ids, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)


class Codec:
    """Pieces of a model file, and matching of chunk batches."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.byte_ids = np.zeros(256, np.int64)
        plain, scores = [], []
        self.raw = [b""] * size
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i)):
                plain.append((piece, i))
                scores.append(model.get_score(i))
                self.raw[i] = piece.replace(MARK, " ").encode()
        self.ids = np.array([i for _, i in plain])
        self.scores = np.array(scores)
        self.unknown = float(self.scores.min()) - UNKNOWN_PENALTY
        self.points = [np.array([ord(c) for c in p]) for p, _ in plain]
        self.lengths = np.array([len(p) for p, _ in plain])
        self.depth = int(self.lengths.max())
        self.padded = np.zeros((len(plain), self.depth), np.uint32)
        for row, piece in zip(self.padded, self.points):
            row[: len(piece)] = piece
        crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p, _ in plain)
        #: One chunk: marks and what follows up to the next mark.
        self.chunk = None if crossing else re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")

    def chunks(self, text: str) -> list[str]:
        text = MARK + text.replace(" ", MARK) if text else ""
        return [text] if self.chunk is None and text else [] if not text else self.chunk.findall(text)

    def edges(self, symbols: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and piece number of every occurrence of a piece; symbol 0 ends a chunk, ``points`` are those of 1, 2, ..."""
        width = max(1, int(len(points)).bit_length())
        per = 62 // width  # symbols in one key
        tail = per * (self.depth // per + 2)
        padded = np.concatenate([symbols, np.zeros(tail, np.int64)])
        key = np.zeros(len(symbols), np.int64)
        for k in range(per):
            key = (key << width) | padded[k : k + len(symbols)]
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(len(symbols) + tail, np.int64)
        dense = np.cumsum(np.append(False, ordered[1:] != ordered[:-1]))
        rank[order] = dense + 1
        rank[len(symbols) :] = 0
        # second level: suffixes of equal key by the key of what follows
        split = int(self.depth > per)
        if split:
            tied = np.append(False, dense[1:] == dense[:-1])
            tied[:-1] |= tied[1:]
            at = np.flatnonzero(tied)
            part = order[at]
            two = dense[at] * np.int64(len(symbols) + 2) + rank[part + per]
            order[at] = part[np.argsort(two, kind="stable")]
        at = np.minimum(np.searchsorted(points, self.padded), len(points) - 1)
        there = points[at] == self.padded
        inside = np.arange(self.depth) < self.lengths[:, None]
        code = np.where(there & inside, at + 1, 0)
        names = np.flatnonzero((there | ~inside).all(axis=1))
        code = code[names]
        low = np.zeros(len(names), np.int64)
        for k in range(per):
            low = (low << width) | (code[:, k] if k < self.depth else 0)
        high = low + (np.int64(1) << (width * np.maximum(per - self.lengths[names], 0))) - 1
        far = self.lengths[names] > per
        lo = np.searchsorted(ordered, low, side="left")
        hi = np.searchsorted(ordered, high, side="right")
        for j in np.flatnonzero(far & (hi > lo)).tolist():
            rest = code[j, per : self.lengths[names[j]]].tolist()
            value = 0
            for c in rest[:per]:
                value = (value << width) | c
            room = width * (per - len(rest[:per]))
            # keys of what follows, in suffix order, for the piece's own range
            follow = np.append(key, np.zeros(tail, np.int64))[order[lo[j] : hi[j]] + per]
            a, b = np.searchsorted(follow, value << room), np.searchsorted(follow, ((value + 1) << room) - 1, side="right")
            if len(rest) > per:  # deeper than two keys: compare what is left
                own = order[lo[j] + a : lo[j] + b]
                good = np.ones(len(own), bool)
                for k, c in enumerate(rest[per:]):
                    good &= padded[own + 2 * per + k] == c
                order = np.concatenate([order, own[good]])
                lo[j], hi[j] = len(order) - int(good.sum()), len(order)
            else:
                lo[j], hi[j] = lo[j] + a, lo[j] + b
        found = hi - lo
        name = np.repeat(names, found)
        spot = np.arange(len(name)) - np.repeat(np.cumsum(found) - found, found) + np.repeat(lo, found)
        return order[spot], name

    def segment(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks one after another, and the offsets of the chunks."""
        text = "".join(chunks)
        raw = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        length = np.array([len(c) for c in chunks], np.int64)
        first = np.cumsum(length) - length
        points, inverse = np.unique(raw, return_inverse=True)
        gap = np.repeat(np.arange(len(chunks)), length)  # one 0 after each chunk
        symbols = np.zeros(len(raw) + len(chunks), np.int64)
        spot = np.arange(len(raw)) + gap
        symbols[spot] = inverse + 1
        start, name = self.edges(symbols, points)
        begin = first + np.arange(len(chunks))
        place = np.zeros(len(symbols), np.int64)
        place[spot] = spot - begin[gap]
        # the last entries are those of a character without a piece
        lengths, scores, numbers = np.append(self.lengths, 1), np.append(self.scores, self.unknown), np.append(self.ids, -1)
        single = np.zeros(len(symbols), bool)
        single[start[lengths[name] == 1]] = True
        missing = spot[~single[spot]]
        start = np.concatenate([start, missing]).astype(np.int32)
        name = np.concatenate([name, np.full(len(missing), len(lengths) - 1)]).astype(np.int32)
        step = place[start] * np.int64(self.depth + 1) + self.depth - lengths[name]
        order = np.argsort(step, kind="stable")  # by position; at one position each length by itself
        start, name, step = start[order], name[order], step[order]
        del order
        best = np.full(len(symbols) + 1, -np.inf)
        best[begin] = 0.0
        back = np.full(len(symbols) + 1, -1, np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(step)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            value = best[start[lo:hi]] + scores[name[lo:hi]]
            to = start[lo:hi] + lengths[name[lo:hi]]
            better = value > best[to]
            to = to[better]
            best[to] = value[better]
            back[to] = lo + np.flatnonzero(better)
        # walk all chunks back in step
        at, live = begin + length, np.flatnonzero(length > 0)
        path, owner = [], []
        while len(live):
            edge = back[at[live]]
            path.append(edge)
            owner.append(live)
            at[live] = start[edge]
            live = live[at[live] > begin[live]]
        path = np.concatenate(path) if path else np.zeros(0, np.int64)
        owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        order = np.lexsort((start[path], owner))
        path, owner = path[order], owner[order]
        ids = numbers[name[path]]
        wide = ids < 0
        if wide.any():  # byte pieces of characters without a piece
            places = np.flatnonzero(wide)
            origin = np.empty(len(symbols), np.int64)
            origin[spot] = np.arange(len(raw))
            coded = [chr(c).encode("utf-8", "surrogatepass") for c in raw[origin[start[path[places]]]]]
            times = np.ones(len(ids), np.int64)
            times[places] = [len(c) for c in coded]
            ids, owner = np.repeat(ids, times), np.repeat(owner, times)
            ids[ids < 0] = self.byte_ids[np.frombuffer(b"".join(coded), np.uint8)]
        return ids, np.searchsorted(owner, np.arange(len(chunks) + 1))

    def encode(self, texts: list[str | None], memory: Memory | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and their offsets; chunks in ``memory`` are not matched again."""
        memory = Memory() if memory is None else memory
        if len(memory.known) > REMEMBERED:
            memory.__init__()
        known, old = memory.known, len(memory.known)
        numbers, counts = [], []
        for text in texts:
            own = [known.setdefault(c, len(known)) for c in self.chunks(text or "")]
            numbers.append(np.array(own, np.int64))
            counts.append(len(own))
        fresh, part, size = islice(known, old, None), [], 0
        parts = []
        for chunk in fresh:
            part.append(chunk)
            size += len(chunk)
            if size >= PART:
                parts.append(self.segment(part))
                part, size = [], 0
        if part:
            parts.append(self.segment(part))
        for ids, at in parts:
            memory.at = np.concatenate([memory.at, at[1:] + memory.at[-1]])
            memory.ids = np.concatenate([memory.ids, ids.astype(np.int32)])
        at = memory.at
        used = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        size = at[used + 1] - at[used]
        ends = np.concatenate([[0], np.cumsum(size)])
        spread = np.arange(ends[-1]) - np.repeat(ends[:-1], size) + np.repeat(at[used], size)
        return memory.ids[spread], ends[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]

    def decode(self, ids) -> str:
        """Text of ids; broken byte sequences become replacement characters."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def codec(path: str) -> Codec:
    if path not in _LOADED:
        _LOADED[path] = Codec(path)
    return _LOADED[path]


def encode(docs: DataFrame, model: str = MODEL, ids: str = "token_ids", text: str = "text", check: str | None = None) -> DataFrame:
    """``docs`` with a column of piece ids, in place of one of that name.

    ``check`` names a further column that tells whether the ids decode to the text (marks read as blanks).
    """
    docs = docs.drop(ids, *([check] if check else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, memory = codec(model), Memory()
        for part in slices(batches, text, _SLICE):
            texts = part.column(part.schema.get_field_index(text)).to_pylist()
            flat, at = own.encode(texts, memory)
            nulls = pa.array([t is None for t in texts], pa.bool_())
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.astype(np.int32)), mask=nulls)
            more = [lists]
            if check:
                same = [t is None or own.decode(flat[a:b].tolist()) == t.replace(MARK, " ") for t, a, b in zip(texts, at[:-1], at[1:])]
                more.append(pa.array(same, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, ids, *([check] if check else [])])

    more = [T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField(check, T.BooleanType())] if check else [])]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *more]))


def decode(tokens: DataFrame, model: str = MODEL, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """``tokens`` with a column of the text that its piece ids stand for (null for null ids), in place of one of that name."""
    tokens = tokens.drop(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            texts = [None if x is None else own.decode(x) for x in lists.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text])

    return tokens.mapInArrow(run, T.StructType([*tokens.schema.fields, T.StructField(text, T.StringType())]))
