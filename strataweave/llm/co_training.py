"""Operator 8: quality classifier by co-training a text view and a metadata view.

The text view sees only the text: shares of character classes, repetition, word lengths, each in bins, and the presence of
telling words and beginnings of words. The metadata view sees only the other columns: language, source and the stated number of characters. Both are
ridge-penalised logistic regressions. In each round every view labels the unlabelled documents of which it is surest, in the
classes' proportions, and these join the training rows of the *other* view. At the end each view is calibrated on labelled
rows that neither has trained on, and a logistic combination of both calibrated logits gives the score of a document.

A document is good if its label says quality 1 and it is not labelled toxic. The classifier is fit on at most ``LABELLED``
labelled and ``UNLABELLED`` other documents, the first by a seeded hash of the id; only their features come to the driver. All
documents are scored, over their whole texts, in one pass without a shuffle.

Nulls: a null text counts as empty, null metadata are a category of their own, null labels are no labels, rows without an id are
scored but never trained on. Of repeated ids the worst label counts and one text is sampled. With no labels, or one class only,
every document gets the share of good labels (1 without any). Other columns pass through :func:`keep_good` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.llm.words import LOWER, buffers, mix, slices, words
from strataweave.session import release, stage

LABELLED = 7_000
UNLABELLED = 4_000
ROUNDS = 3
#: Share of the unlabelled documents that a view may label in a round, and how sure it must be.
SHARE, SURE = 0.05, 0.97
THRESHOLD = 0.5
SEED = 11
TELLING = 400
#: Bytes of the beginnings of words that the text view knows besides whole words.
PREFIXES = (4, 5)
_BINS = 8
#: Hashed languages and hashed sources, 0 for null.
_CATEGORIES = 64
_SYMBOL = b"#$%&*+/<=>@\\^_`{|}~!"


def _classes() -> list[np.ndarray]:
    upper, lower, digit, blank, stop, symbol, bang, high = (np.zeros(256, bool) for _ in range(8))
    upper[65:91] = lower[97:123] = digit[48:58] = high[128:] = True
    blank[[9, 10, 11, 12, 13]] = True
    stop[list(b".,;:?'\"()-")] = True
    symbol[list(_SYMBOL)] = True
    bang[ord("!")] = True
    return [upper, lower, digit, blank, stop, symbol, bang, high]


_CLASSES = _classes()


def text_shares(column: pa.Array, found) -> np.ndarray:
    """Numbers for each text, none of which depends on other columns."""
    data, at = buffers(column)
    n = len(column)
    size = np.maximum(np.diff(at), 1)
    out = []
    for table in _CLASSES:
        sums = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
        out.append((sums[at[1:]] - sums[at[:-1]]) / size)
    row = found.row
    count = np.bincount(row, minlength=n)
    many = np.maximum(count, 1)
    length = (found.end - found.start).astype(float)
    mean = np.bincount(row, length, minlength=n) / many
    out += [np.log1p(count), mean, np.sqrt(np.maximum(np.bincount(row, length**2, minlength=n) / many - mean**2, 0))]
    key = mix(found.hash ^ mix(row.astype(np.uint64)))
    _, first, times = np.unique(key, return_index=True, return_counts=True)
    distinct = np.bincount(row[first], minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, row[first], times)
    out += [distinct / many, top / many]
    again = np.zeros(len(row), bool)
    again[1:] = (found.hash[1:] == found.hash[:-1]) & (row[1:] == row[:-1])
    out.append(np.bincount(row[again], minlength=n) / many)
    ends = np.isin(found.data[found.end - 1], np.frombuffer(_SYMBOL, np.uint8)) if len(row) else again
    out.append(np.bincount(row[ends], minlength=n) / many)
    first_upper = _CLASSES[0][found.data[found.start]] if len(row) else again
    out.append(np.bincount(row[first_upper], minlength=n) / many)
    return np.stack(out, axis=1)


def marks(found) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of what may be telling: every word, and the beginnings of longer words."""
    out = [found.hash]
    for n in PREFIXES:
        key = np.full(len(found.hash), n, np.uint64)
        for k in range(n):
            at = found.start + k
            inside = at < found.end
            byte = LOWER[found.data[np.minimum(at, len(found.data) - 1)]] if len(at) else at.astype(np.uint8)
            key = key * np.uint64(257) + np.where(inside, byte.astype(np.uint64) + np.uint64(1), np.uint64(0))
        out.append(mix(key))
    return np.tile(found.row, len(out)), np.concatenate(out)


def _category(batch: pa.RecordBatch, name: str) -> np.ndarray:
    if name not in batch.schema.names:
        return np.zeros(batch.num_rows, np.int64)
    texts = batch.column(batch.schema.get_field_index(name)).cast(pa.string())
    hashes = {None: 0}
    return np.array([hashes.setdefault(v, 1 + crc32(v.encode()) % (_CATEGORIES - 1) if v is not None else 0) for v in texts.to_pylist()])


def metadata(batch: pa.RecordBatch) -> np.ndarray:
    """Language, source (as category numbers) and log of the stated length."""
    if "n_chars" in batch.schema.names:
        chars = batch.column(batch.schema.get_field_index("n_chars")).cast(pa.float64()).fill_null(-1.0).to_numpy(zero_copy_only=False)
    else:
        chars = np.full(batch.num_rows, -1.0)
    return np.stack([_category(batch, "lang"), _category(batch, "source"), np.log1p(np.maximum(chars, -0.5))], axis=1)


class Logistic(NamedTuple):
    weight: np.ndarray
    bias: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weight + self.bias


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 8) -> Logistic:
    """Newton steps on the penalised likelihood; the bias is free."""
    full = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = np.zeros(full.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        curve = np.maximum(p * (1 - p), 1e-6)
        hessian = ((full * curve[:, None].astype(full.dtype)).T @ full).astype(float) + np.diag(penalty)
        step = np.linalg.solve(hessian, full.T @ (y - p) - penalty * w)
        w = w + step * min(1.0, 8.0 / (np.abs(step).max() + 1e-12))
    return Logistic(w[:-1], float(w[-1]))


class Model(NamedTuple):
    edges: np.ndarray  # bin edges of each text number
    telling: np.ndarray  # sorted hashes of telling words
    chars: np.ndarray  # bin edges of the stated length
    text: Logistic
    meta: Logistic
    joint: Logistic
    constant: float | None

    def text_view(self, shares: np.ndarray, rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        n = len(shares)
        x = np.zeros((n, shares.shape[1] * _BINS + len(self.telling)), np.float32)
        for j, edge in enumerate(self.edges):
            x[np.arange(n), j * _BINS + np.searchsorted(edge, shares[:, j])] = 1
        if len(self.telling):
            at = np.minimum(np.searchsorted(self.telling, hashes), len(self.telling) - 1)
            hit = self.telling[at] == hashes
            x[rows[hit], shares.shape[1] * _BINS + at[hit]] = 1
        return x

    def meta_view(self, meta: np.ndarray) -> np.ndarray:
        n = len(meta)
        x = np.zeros((n, 2 * _CATEGORIES + _BINS), np.float32)
        x[np.arange(n), meta[:, 0].astype(int)] = 1
        x[np.arange(n), _CATEGORIES + meta[:, 1].astype(int)] = 1
        x[np.arange(n), 2 * _CATEGORIES + np.searchsorted(self.chars, meta[:, 2])] = 1
        return x

    def views(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        column = batch.column(batch.schema.get_field_index("text"))
        found = words(column)
        return self.text_view(text_shares(column, found), *marks(found)), self.meta_view(metadata(batch))

    def score(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of a good document by text, by metadata and by both."""
        if self.constant is not None:
            return (np.full(batch.num_rows, self.constant),) * 3
        text, meta = self.views(batch)
        logits = np.stack([self.text.logit(text), self.meta.logit(meta)], axis=1)
        odds = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return odds(logits[:, 0]), odds(logits[:, 1]), odds(self.joint.logit(logits))


def _bins(values: np.ndarray) -> np.ndarray:
    return np.quantile(values, np.arange(1, _BINS) / _BINS)


def fit(shares, meta, label: np.ndarray, held: np.ndarray, telling: np.ndarray, seen: tuple, rounds: int = ROUNDS) -> Model:
    """Co-train on rows of which ``label`` is 1, 0 or -1 (none); labelled rows in ``held`` only calibrate.

    ``telling`` are sorted hashes of telling words, ``seen`` the rows and hashes of those that occur.
    """
    known = label >= 0
    train, check = np.flatnonzero(known & ~held), np.flatnonzero(known & held)
    good = float((label[known] == 1).mean()) if known.any() else 1.0
    none = Logistic(np.zeros(0), 0.0)
    if known.sum() < 20 or any(len(set(label[part].tolist())) < 2 for part in (train, check)):
        return Model(np.zeros(0), np.zeros(0, np.uint64), np.zeros(0), none, none, none, good)
    y = label[train]
    empty = Model(np.stack([_bins(s) for s in shares.T]), telling, _bins(meta[:, 2]), none, none, none, None)
    views = [empty.text_view(shares, *seen), empty.meta_view(meta)]
    pools = [dict(zip(train.tolist(), y.tolist())) for _ in views]  # training rows of each view
    free = set(np.flatnonzero(label < 0).tolist())
    fitted = [none, none]
    for turn in range(rounds + 1):
        for v, x in enumerate(views):
            at = np.array(list(pools[v]))
            fitted[v] = fit_logistic(x[at], np.array([pools[v][i] for i in at.tolist()], float))
        if turn == rounds or not free:
            break
        open_ = np.array(sorted(free))
        for v, x in enumerate(views):
            p = 1 / (1 + np.exp(-np.clip(fitted[v].logit(x[open_]), -30, 30)))
            for value, order, share in ((1, np.argsort(-p), good), (0, np.argsort(p), 1 - good)):
                for k in order[: int(SHARE * share * len(label)) + 1].tolist():
                    if (p[k] if value else 1 - p[k]) >= SURE:
                        pools[1 - v].setdefault(int(open_[k]), value)
                        free.discard(int(open_[k]))
    scaled = []
    for v, x in enumerate(views):
        platt = fit_logistic(fitted[v].logit(x[check])[:, None], label[check].astype(float), 1e-3)
        scaled.append(Logistic(fitted[v].weight * platt.weight[0], fitted[v].bias * platt.weight[0] + platt.bias))
    logits = np.stack([scaled[v].logit(x[check]) for v, x in enumerate(views)], axis=1)
    joint = fit_logistic(logits, label[check].astype(float), 1e-3)
    return empty._replace(text=scaled[0], meta=scaled[1], joint=joint)


def _distinct_marks(found) -> tuple[np.ndarray, np.ndarray]:
    rows, hashes = marks(found)
    _, first = np.unique(mix(hashes ^ mix(rows.astype(np.uint64))), return_index=True)
    return rows[first], hashes[first]


def _mark_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts each mark occurs, and in how many good ones."""
    for part in slices(batches):
        rows, hashes = _distinct_marks(words(part.column("text")))
        values, back = np.unique(hashes, return_inverse=True)
        good = part.column("label").to_numpy(zero_copy_only=False)[rows] == 1
        n, ones = np.bincount(back, minlength=len(values)), np.bincount(back, good, minlength=len(values))
        yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(ones.astype(np.int64))], ["mark", "n", "ones"])


def _features(telling: np.ndarray):
    """Numbers of both views, and the telling marks that occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            column = part.column("text")
            found = words(column)
            shares, meta = text_shares(column, found), metadata(part)
            rows, hashes = _distinct_marks(found)
            kept = np.isin(hashes, telling)
            rows, hashes = rows[kept], hashes[kept]
            order = np.argsort(rows, kind="stable")
            at = np.searchsorted(rows[order], np.arange(part.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("label"),
                    part.column("held"),
                    pa.array(shares.tolist(), pa.list_(pa.float64())),
                    pa.array(meta.tolist(), pa.list_(pa.float64())),
                    pa.ListArray.from_arrays(pa.array(at), pa.array(hashes[order].view(np.int64))),
                ],
                ["label", "held", "shares", "meta", "marks"],
            )

    return run


def _sample(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(n)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of ``docs``."""
    bad = (F.col("quality") != 1) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    judged = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min(F.when(bad, 0).otherwise(1)).alias("label"))
    ids = docs.filter("doc_id IS NOT NULL").select("doc_id")
    wanted = _sample(judged.join(ids, "doc_id", "left_semi"), LABELLED)
    others = _sample(ids.distinct().join(judged, "doc_id", "left_anti"), UNLABELLED).withColumn("label", F.lit(-1))
    held = (F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id"), F.lit(4)) == 0).alias("held")
    chosen = stage(wanted.unionByName(others).select("doc_id", "label", held))
    columns = [c for c in ("doc_id", "text", "lang", "source", "n_chars") if c in docs.columns]
    # at most LABELLED + UNLABELLED ids; one text of each
    rows = stage(docs.select(*columns).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]))
    base = rows.filter("label >= 0 AND NOT held")
    total, good = base.agg(F.count("*"), F.avg("label")).first()
    counts = base.select("text", "label").mapInArrow(_mark_counts, "mark long, n long, ones long").groupBy("mark").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))
    good = good or 0.0
    spread = F.sqrt(F.greatest(F.col("n") * (good * (1 - good)) * (1 - F.col("n") / F.lit(max(total, 1))), F.lit(1e-9)))
    z = F.abs(F.col("ones") - F.col("n") * good) / spread
    strong = counts.filter((F.col("n") >= 5) & (F.col("n") < total)).withColumn("z", z).filter("z > 5")
    picked = strong.orderBy(F.desc("z"), "mark").limit(TELLING).toArrow()
    telling = np.sort(picked.column("mark").to_numpy().view(np.uint64))
    schema = "label int, held boolean, shares array<double>, meta array<double>, marks array<long>"
    table = rows.mapInArrow(_features(telling), schema).toArrow()
    release(chosen, rows)
    label = table.column("label").to_numpy()
    if not len(label):
        return fit(np.zeros((0, 1)), np.zeros((0, 3)), label, np.zeros(0, bool), telling, ())
    numbers = lambda c: np.array(table.column(c).to_pylist(), float)
    found = table.column("marks").combine_chunks()
    size = np.diff(found.offsets.to_numpy())
    seen = np.repeat(np.arange(len(size)), size), found.flatten().to_numpy().view(np.uint64)
    return fit(numbers("shares"), numbers("meta"), label, table.column("held").to_numpy(), telling, seen)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, text_score, metadata_score, score, good`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [c for c in ("doc_id", "text", "lang", "source", "n_chars") if c in docs.columns]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            text, meta, both = shared.value.score(part)
            arrays = [part.column("doc_id"), *map(pa.array, (text, meta, both, both >= THRESHOLD))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_score", "metadata_score", "score", "good"])

    return docs.select(*columns).mapInArrow(run, f"doc_id {kind}, text_score double, metadata_score double, score double, good boolean")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield part.filter(pa.array(shared.value.score(part)[2] >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
