"""Operator 1: language-model scores from a subword lattice.

The pieces of an existing vocabulary span each word as a lattice over its bytes: a piece where its bytes stand, and a single
byte everywhere. A document is a sequence of pieces, its words beginning with the word mark, and one end symbol; its
probability is the sum over all segmentations, found by a forward recursion in log space. As no piece crosses the beginning of
a word, the sum is a product over words, so each distinct word is run through the recursion once.

The vocabulary's own scores give the first piece probabilities (ranks by Zipf's law, or logarithms as they are). They are then
re-estimated on the training documents: forward-backward over all distinct training words, weighted by their counts, with the
first probabilities as prior. Pieces are neither added nor removed.

Spark part: one pass counts words; the counted words carry their lattice score as a table. Words so frequent that at most
``FREQUENT_LIMIT`` can exist are broadcast; all others meet the documents in a join on the word's 64-bit hash, as one row for
each word of a document. Word lists and documents never pass through the driver.

Null and empty texts are one end token. A null ``doc_id`` counts as a training document. Repeated rows are scored each by
itself and each counts in training. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.llm.words import LOWER, slices, words
from strataweave.session import release, stage

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
FREQUENT_LIMIT = 1_000_000
ROUNDS = 2
_MARK = "▁"
_COUNTED = 8 << 20
_BATCH = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def read_pieces(path: str, ranks: bool = True) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes (the word mark as a blank) with the log probabilities of the vocabulary's scores, and all single bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scores: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        text = model.id_to_piece(i).replace(_MARK, " ")
        if " " not in text[1:]:
            scores[text.encode()] = model.get_score(i)
    least = min(scores.values())
    for b in range(256):
        scores.setdefault(bytes([b]), least)
    value = np.array(list(scores.values()))
    weight = 1.0 / (1.0 - np.minimum(value, 0.0)) if ranks else np.exp(value - value.max())
    return list(scores), np.log(weight / weight.sum())


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, _BATCH * 2)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


class Pieces:
    """Pieces by length and hash."""

    def __init__(self, pieces: list[bytes]):
        self.size = len(pieces)
        self.tables = {}
        by: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            by.setdefault(len(p), []).append(i)
        for n, ids in sorted(by.items()):
            powers = [pow(_BASE, k, 1 << 64) for k in range(n)]
            hashes = np.array([sum((b + 1) * q for b, q in zip(pieces[i], powers)) & 0xFFFFFFFFFFFFFFFF for i in ids], np.uint64)
            order = np.argsort(hashes)
            self.tables[n] = (hashes[order], np.array(ids)[order])


class Lattice:
    """All edges of a batch of words; nodes are the byte boundaries of each word."""

    def __init__(self, batch: list[bytes], pieces: Pieces):
        length = np.array([len(w) + 1 for w in batch])
        data = np.frombuffer(b"".join(b" " + w for w in batch), np.uint8)
        first = np.cumsum(length) - length
        word = np.repeat(np.arange(len(batch)), length)
        place = np.arange(len(data)) - first[word]
        left = length[word] - place
        up, down = _powers(len(data))
        sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)])
        starts, sizes, ids = [], [], []
        for n, (hashes, names) in pieces.tables.items():
            at = np.flatnonzero(left >= n)
            if not len(at):
                continue
            key = (sums[at + n] - sums[at]) * down[at]
            spot = np.minimum(np.searchsorted(hashes, key), len(hashes) - 1)
            found = hashes[spot] == key
            starts.append(at[found])
            sizes.append(np.full(int(found.sum()), n))
            ids.append(names[spot[found]])
        start, size = np.concatenate(starts), np.concatenate(sizes)
        step = place[start] * 64 + size  # edges of one step reach each node once
        order = np.argsort(step, kind="stable")
        self.id = np.concatenate(ids)[order]
        self.word = word[start[order]]
        self.source = start[order] + self.word
        self.target = self.source + size[order]
        self.cuts = np.flatnonzero(np.diff(step[order])) + 1
        self.begin = first + np.arange(len(batch))
        self.end = self.begin + length
        self.nodes = len(data) + len(batch)

    def _steps(self):
        edge = [0, *self.cuts.tolist(), len(self.id)]
        return list(zip(edge[:-1], edge[1:]))

    def forward(self, weight: np.ndarray) -> np.ndarray:
        alpha = np.full(self.nodes, -np.inf)
        alpha[self.begin] = 0.0
        w = weight[self.id]
        for lo, hi in self._steps():
            to = self.target[lo:hi]
            alpha[to] = np.logaddexp(alpha[to], alpha[self.source[lo:hi]] + w[lo:hi])
        return alpha

    def expected(self, weight: np.ndarray, count: np.ndarray, size: int) -> np.ndarray:
        """Expected piece counts over all segmentations of words that occur ``count`` times."""
        alpha = self.forward(weight)
        beta = np.full(self.nodes, -np.inf)
        beta[self.end] = 0.0
        w = weight[self.id]
        for lo, hi in reversed(self._steps()):
            to = self.source[lo:hi]
            beta[to] = np.logaddexp(beta[to], beta[self.target[lo:hi]] + w[lo:hi])
        share = np.exp(alpha[self.source] + w + beta[self.target] - alpha[self.end][self.word])
        return np.bincount(self.id, share * count[self.word], minlength=size)


def word_scores(batch: list[bytes], pieces: Pieces, weight: np.ndarray) -> np.ndarray:
    """Natural-log marginal probability of each word."""
    lattice = Lattice(batch, pieces)
    return lattice.forward(weight)[lattice.end]


def _batches(words_: list[bytes]) -> Iterator[slice]:
    lo = held = 0
    for i, w in enumerate(words_):
        held += len(w) + 1
        if held >= _BATCH:
            yield slice(lo, i + 1)
            lo, held = i + 1, 0
    if lo < len(words_):
        yield slice(lo, len(words_))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, limit=_COUNTED):
        found = words(part.column("text"))
        if not len(found.hash):
            continue
        held_out = np.asarray(part.column("held_out").to_numpy(zero_copy_only=False), bool)
        hashes, first, back, n = np.unique(found.hash, return_index=True, return_inverse=True, return_counts=True)
        train = np.bincount(back, (~held_out)[found.row], minlength=len(hashes)).astype(np.int64)
        raw = LOWER[found.data].tobytes()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(hashes.view(np.int64)),
                pa.array([raw[s:e] for s, e in zip(found.start[first].tolist(), found.end[first].tolist())], pa.binary()),
                pa.array(train),
                pa.array(n),
            ],
            ["hash", "word", "c", "n"],
        )


def _expect(pieces, weight):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, total = pieces.value.size, 0.0
        for batch in batches:
            listed, counts = batch.column("word").to_pylist(), batch.column("c").to_numpy()
            for own in _batches(listed):
                total = total + Lattice(listed[own], pieces.value).expected(weight.value, counts[own], size)
        if not np.isscalar(total):
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["piece", "n"])

    return run


def _score_words(pieces, weight):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column("word").to_pylist()
            scores = [word_scores(listed[own], pieces.value, weight.value) for own in _batches(listed)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("hash"), batch.column("c"), batch.column("n"), pa.array(np.concatenate(scores) if scores else [], pa.float64())],
                ["hash", "c", "n", "score"],
            )

    return run


def _document_parts(frequent):
    """For each text a row of its sums over frequent words, and a row for each other word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_c, base, score = frequent.value
        row = TaskContext.get().partitionId() << 40
        for part in slices(batches):
            found = words(part.column("text"))
            n_rows = part.num_rows
            total = np.bincount(found.row, minlength=n_rows)
            at = np.minimum(np.searchsorted(known, found.hash), max(0, len(known) - 1))
            hit = known[at] == found.hash if len(known) else np.zeros(len(found.hash), bool)
            own, spot = found.row[hit], at[hit]
            sums = [np.bincount(own, x[spot], minlength=n_rows) for x in ((known_c > 0).astype(float), base, score)]
            rest = np.flatnonzero(~hit)
            order = rest[np.lexsort((found.hash[rest], found.row[rest]))]
            r, h = found.row[order], found.hash[order]
            new = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (h[1:] != h[:-1]))) if len(r) else np.zeros(0, int)
            times = np.diff(np.append(new, len(r)))
            m = len(new)
            none = pa.nulls(m, part.column("doc_id").type)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([row + np.arange(n_rows), row + r[new]])),
                    pa.concat_arrays([part.column("doc_id"), none]),
                    pa.concat_arrays([part.column("held_out"), pa.nulls(m, pa.bool_())]),
                    pa.array(np.concatenate([total, np.zeros(m, np.int64)])),
                    pa.concat_arrays([pa.nulls(n_rows, pa.int64()), pa.array(h[new].view(np.int64))]),
                    pa.array(np.concatenate([np.zeros(n_rows, np.int64), times])),
                    pa.array(np.concatenate([sums[0].astype(np.int64), np.zeros(m, np.int64)])),
                    pa.array(np.concatenate([sums[1], np.zeros(m)])),
                    pa.array(np.concatenate([sums[2], np.zeros(m)])),
                ],
                ["row", "doc_id", "held_out", "n_words", "hash", "times", "known", "base", "score"],
            )
            row += n_rows

    return run


def lattice_scores(docs: DataFrame, vocabulary: str = VOCABULARY, rounds: int = ROUNDS, ranks: bool = True) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` (log10) of every row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    context = spark.sparkContext
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False)).alias("held_out")
    texts = docs.select("doc_id", held_out, "text")
    documents = docs.select(held_out).filter("NOT held_out").count()

    counted = texts.select("held_out", "text").mapInArrow(_counts, "hash long, word binary, c long, n long")
    lexicon = stage(counted.groupBy("hash", "word").agg(F.sum("c").alias("c"), F.sum("n").alias("n")))
    seen = lexicon.agg(F.sum("c").alias("c"), F.sum(F.expr("CAST(c > 0 AS LONG)")).alias("v"), F.sum("n").alias("n")).first()
    train_tokens = (seen.c or 0) + documents
    distinct = (seen.v or 0) + (documents > 0)

    listed, first = read_pieces(vocabulary, ranks)
    pieces = context.broadcast(Pieces(listed))
    prior = np.exp(first) * len(listed)

    def weights(counts):
        """Log probabilities of the pieces; what is left is that of the end."""
        return np.log(counts / (counts.sum() + documents + 1))

    weight = weights(prior)
    for _ in range(rounds):
        current = context.broadcast(weight)
        sums = lexicon.filter("c > 0").select("word", "c").mapInArrow(_expect(pieces, current), "piece long, n double")
        table = sums.groupBy("piece").agg(F.sum("n").alias("n")).toArrow()  # one row for each piece
        counts = prior.copy()
        counts[table.column("piece").to_numpy()] += table.column("n").to_numpy()
        weight = weights(counts)
    end = np.log1p(-np.exp(weight).sum())

    scored = stage(lexicon.mapInArrow(_score_words(pieces, context.broadcast(weight)), "hash long, c long, n long, score double"))
    release(lexicon)
    size = float(train_tokens + distinct + 1)
    base = F.log10((F.col("c") + 1) / F.lit(size))
    log10 = F.col("score") / float(np.log(10))
    scored = scored.select("hash", "c", "n", base.alias("base"), log10.alias("score"))
    least = max(1, -(-(seen.n or 0) // FREQUENT_LIMIT))
    table = scored.filter(F.col("n") >= least).toArrow()  # at most FREQUENT_LIMIT rows
    hashes = table.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    arrays = (hashes[order], *(table.column(c).to_numpy()[order] for c in ("c", "base", "score")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, held_out boolean, n_words long, hash long, times long, known long, base double, score double"
    parts = stage(texts.mapInArrow(_document_parts(context.broadcast(arrays)), schema))

    rare = scored.filter(F.col("n") < least).select("hash", "c", F.col("base").alias("b"), F.col("score").alias("s"))
    met = (
        parts.filter("hash IS NOT NULL")
        .select("row", "hash", "times")
        .join(rare, "hash")
        .select("row", F.expr("IF(c > 0, times, 0)").alias("known"), (F.col("times") * F.col("b")).alias("base"), (F.col("times") * F.col("s")).alias("score"))
    )
    heads = parts.filter("hash IS NULL").select("row", "doc_id", "held_out", "n_words", "known", "base", "score")
    sums = heads.unionByName(met, allowMissingColumns=True).groupBy("row").agg(
        *(F.max(c).alias(c) for c in ("doc_id", "held_out", "n_words")),
        *(F.sum(c).alias(c) for c in ("known", "base", "score")),
    )
    end_base = float(np.log10((documents + 1) / size))
    return sums.select(
        "doc_id",
        "held_out",
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("known") + int(documents > 0)).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + end_base).alias("base_score"),
        (F.col("score") + float(end / np.log(10))).alias("score"),
    )
