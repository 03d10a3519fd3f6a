"""Operator 13: frequent phrases by Toivonen's sampling method, and collocations among them.

A sample of the documents proposes phrases: those of at least ``LOWER`` times the share of ``support`` that falls to the sample.
One pass over all documents then counts exactly the proposed phrases and their negative border, the phrases that were not proposed
although both phrases of one word less in them were. If a phrase of the border reaches ``support``, it joins the proposals, and a further
pass counts the border that it opens, until no phrase of a new border reaches ``support``: then no frequent phrase is uncounted,
since the first uncounted one would stand in a border. The sample decides only how many passes are needed.

Nearly all phrases of the border are rare, so a count of them all as texts would move far more than the input. Every count of the sample
and of the full pass therefore has two steps (Park, Chen and Yu). The first adds up occurrences in buckets of the phrases' hashes, about
one for every ``BUCKET_TEXT`` bytes of text; tasks send places and counts of their buckets, two bytes and one for an entry at a usual
support, and Spark brings those of one stretch of buckets together. The second counts as texts only the phrases in buckets that reach the support. A
phrase's bucket never has less than the phrase, so none that reaches it is lost, and the others are dropped by their exact count.

Tasks tell phrases by codes into the exact words of a slice of texts, and give each distinct phrase once a slice with its number of
occurrences; Spark sums them by group and phrase. Whether the parts of a phrase are proposed is asked of a filter of hashed bits, of
``FILTER_BITS`` at most, so the broadcast is bounded for any number of proposals; buckets that reach the support are in such a filter too. A wrong yes counts a phrase in vain; it never
changes a count, and what is proposed or fails is decided on the phrases themselves.

Defined cases: null texts have no words; a null group is ``und``; repeated rows count as often as they stand there; occurrences may
overlap; ties in rank go by count and then phrase, which is unique in its group; an empty table gives no rows. Whole texts of any
length are read, one text at least in a slice. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataweave.llm.tokens import tokens
from strataweave.llm.words import LOWER as LOWER_CASE
from strataweave.llm.words import buffers, mix, slices
from strataweave.operators.joins import equi_join
from strataweave.session import stage

#: One document in so many is sampled; proposals have at least this part of their expected count there.
SAMPLE, LOWER = 8, 0.5
#: Bits of the filter for each proposal, and of the filter at most (32 MB).
BITS_EACH, FILTER_BITS = 16, 1 << 28
#: Text bytes of a slice.
SLICE = 1 << 20
#: Text bytes for each bucket, and the least and greatest number of bits that tell buckets apart; a stretch has 2**16 buckets.
BUCKET_TEXT, BUCKET_BITS = 4, (16, 32)
#: Entries of buckets that a task adds up before it sends them (about 100 MB while they are sorted).
ENTRIES = 4 << 20
#: Rows of a group that one task ranks at once.
SALTS = 64

_BREAKS = np.zeros(256, dtype=bool)
_BREAKS[[ord(c) for c in ".,;:!?"]] = _BREAKS[10:14] = True
_GAPS = _BREAKS.copy()
_GAPS[[32, 9]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)


# ---- the filter -----------------------------------------------------------------------------------


def _word_hashes(words: pa.Array, groups: pa.Array, group: np.ndarray) -> np.ndarray:
    """Hashes of words in their groups; equal hashes of different words only cost counts in vain."""

    def plain(texts: pa.Array) -> np.ndarray:
        data, at = buffers(texts.cast(pa.binary()))
        n = np.diff(at)
        place = np.arange(len(data)) - np.repeat(at[:-1], n)
        power = np.cumprod(np.full(int(n.max(initial=0)) + 1, _STEP, np.uint64), dtype=np.uint64)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[place], dtype=np.uint64)])
        return mix((sums[at[1:]] - sums[at[:-1]]) ^ n.astype(np.uint64))

    return mix(plain(words) + plain(groups)[group] * _ODD)


def _extend(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of their first words and their last word."""
    return mix(prefix * _STEP + word)


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - bits.bit_length() + 1)
    return hashes >> shift, (hashes * _ODD) >> shift


def _has(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    found = np.ones(len(hashes), dtype=bool)
    for at in _places(hashes, len(filter_) * 64):
        found &= (filter_[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return found


def _masks(hashes: np.ndarray, bits: int) -> pa.RecordBatch:
    at = np.concatenate(_places(hashes, bits))
    word, inverse = np.unique(at >> np.uint64(6), return_inverse=True)
    mask = np.zeros(len(word), np.uint64)
    np.bitwise_or.at(mask, inverse, np.uint64(1) << (at & np.uint64(63)))
    return pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(mask.view(np.int64))], ["word", "mask"])


def _marks(bits: int):
    """Words of the filter that phrases set, with their bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = pc.split_pattern(batch.column("phrase"), " ")
            groups = batch.column("lang").dictionary_encode()
            n = pc.list_value_length(parts).to_numpy().astype(np.int64)
            words = _word_hashes(parts.flatten(), groups.dictionary, np.repeat(groups.indices.to_numpy(), n))
            first = np.cumsum(n) - n
            hashes = words[first] if len(n) else words
            for k in range(1, int(n.max(initial=1))):
                longer = n > k
                hashes[longer] = _extend(hashes[longer], words[first[longer] + k])
            yield _masks(hashes, bits)

    return run


def _bucket_marks(bits: int):
    """Words of the filter that buckets set, with their bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _masks(mix(batch.column("bucket").to_numpy().astype(np.uint64)), bits)

    return run


def _filter(rows: DataFrame, marks=_marks) -> np.ndarray:
    """The filter of ``rows``, a staged table; at most ``FILTER_BITS`` pass the driver."""
    n = max(1, rows.count())
    bits = min(FILTER_BITS, max(1 << 12, 1 << (BITS_EACH * n - 1).bit_length()))
    marks = rows.mapInArrow(marks(bits), "word long, mask long")
    rows = marks.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    found = np.zeros(bits // 64, np.uint64)
    found[rows["word"].to_numpy()] = rows["mask"].to_numpy().view(np.uint64)
    return found


# ---- counting ---------------------------------------------------------------------------------------


class _Slice(NamedTuple):
    names: pa.Array  # of the groups
    distinct: pa.Array  # words of all groups
    group: np.ndarray  # of each word of a group
    spelling: np.ndarray  # of each word of a group, a code into ``distinct``
    seen: np.ndarray  # occurrences of each word of a group
    hash: np.ndarray  # of each word of a group
    word: np.ndarray  # at each place, a code into the words of the groups
    reach: np.ndarray  # words from each place to the end of its piece


class _May(NamedTuple):
    """Whether the buckets of phrases reach the support."""

    filter: np.ndarray
    bits: int

    def has(self, hashes: np.ndarray) -> np.ndarray:
        return _has(self.filter, mix(_buckets(hashes, self.bits)))


def _buckets(hashes: np.ndarray, bits: int) -> np.ndarray:
    return hashes >> np.uint64(64 - bits)


def _read(batch: pa.RecordBatch) -> _Slice | None:
    text = batch.column("text")
    found = tokens(text, _GAPS, LOWER_CASE)
    total = len(found.code)
    if not total:
        return None
    data, _ = buffers(text)
    pieces = np.cumsum(_BREAKS[data], dtype=np.int32)[found.start].astype(np.int64) + found.row * (len(data) + 1)
    ends = np.flatnonzero(np.append(pieces[1:] != pieces[:-1], True)) + 1
    reach = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(total)
    groups = batch.column("lang").dictionary_encode()
    group = groups.indices.to_numpy().astype(np.int64)[found.row]
    names = groups.dictionary.cast(pa.binary())
    n_words = len(found.distinct)
    dense = group * n_words + found.code
    seen = np.bincount(dense)
    code = np.flatnonzero(seen)
    renamed = np.zeros(len(seen), np.int64)
    renamed[code] = np.arange(len(code))
    group, spelling = code // n_words, code % n_words
    hashes = _word_hashes(found.distinct.take(pa.array(spelling)), names, group)
    return _Slice(names, found.distinct, group, spelling, seen[code], hashes, renamed[dense], reach)


def _walk(found: _Slice, longest: int, shortest: int, held, old, known: int, may: _May | None) -> Iterator[tuple]:
    """For each length from 2: the length, and of phrases whose parts are in ``held`` (with ``shortest`` words or more also in ``may``)
    the places where they begin, their hashes, and whether they are to be counted.
    """

    def inside(hashes: np.ndarray, length: int) -> np.ndarray:
        yes = _has(held, hashes) if held is not None and length <= known else np.ones(len(hashes), dtype=bool)
        return yes & may.has(hashes) if may is not None and length >= shortest else yes

    # of each phrase that begins at a place of ``at``: its hash, whether it is in the filters now, and was counted and in ``old`` before
    at, hashes, yes = np.arange(len(found.word)), found.hash[found.word], inside(found.hash, 1)[found.word]
    was = _has(old, found.hash)[found.word] if old is not None else None
    for length in range(2, longest + 1):
        # both parts of one word less begin here and at the next word
        keep = np.flatnonzero((at[:-1] + 1 == at[1:]) & yes[:-1] & yes[1:] & (found.reach[at[:-1]] >= length))
        at = at[keep]
        hashes = _extend(hashes[keep], found.hash[found.word[at + length - 1]])
        now = inside(hashes, length)
        wanted = may.has(hashes) if may is not None and length >= shortest else np.ones(len(keep), dtype=bool)
        if old is not None:
            counted = was[keep] & was[keep + 1]
            wanted, was = wanted & ~counted, counted & _has(old, hashes)
        useful = wanted | now  # others are neither counted nor part of anything counted
        at, hashes, yes = at[useful], hashes[useful], now[useful]
        was = was[useful] if old is not None else None
        if not len(at):
            return
        yield length, at, hashes, wanted[useful]


def _count(longest: int, shortest: int, now, before, known: int, may, limit: int):
    """Phrases of ``shortest`` to ``longest`` words whose parts are in the filter ``now``, but not all in ``before``.

    The filter has phrases of up to ``known`` words; longer parts pass. With words, there is a row of no words with their number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [None if x is None else x.value for x in (now, before, may)]
        for batch in slices(batches, limit=limit):
            found = _read(batch)
            if found is not None:
                yield from _phrases(found, longest, shortest, *filters[:2], known, filters[2])

    return run


def _phrases(found: _Slice, longest: int, shortest: int, held, old, known: int, may: _May | None) -> Iterator[pa.RecordBatch]:
    texts = found.distinct.take(pa.array(found.spelling))
    if shortest == 1:
        words = np.bincount(found.group, found.seen, len(found.names)).astype(np.int64)
        groups = np.flatnonzero(words)
        yield _rows(found.names, groups, pa.array([b""] * len(groups), texts.type), words[groups], 0)
        chosen = np.flatnonzero(may.has(found.hash)) if may is not None else np.arange(len(texts))
        yield _rows(found.names, found.group[chosen], texts.take(pa.array(chosen)), found.seen[chosen], 1)
    for length, at, _, wanted in _walk(found, longest, shortest, held, old, known, may):
        at = at[wanted]
        if length < shortest or not len(at):
            continue
        ids = found.word[at]  # code of the phrase of so many words at each place
        for k in range(1, length):
            _, first, ids, count = np.unique(ids * len(found.hash) + found.word[at + k], return_index=True, return_inverse=True, return_counts=True)
        parts = [texts.take(pa.array(found.word[at[first] + k])) for k in range(length)]
        yield _rows(found.names, found.group[found.word[at[first]]], pc.binary_join_element_wise(*parts, pa.scalar(b" ", texts.type)), count, length)


def _rows(names: pa.Array, group: np.ndarray, phrases: pa.Array, count: np.ndarray, length: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            names.take(pa.array(group)).cast(pa.string()),
            phrases.cast(pa.large_string()).cast(pa.string()),
            pa.array(np.full(len(group), length, np.int32)),
            pa.array(count.astype(np.int64)),
        ],
        ["lang", "phrase", "words", "f"],
    )


def _shared(docs: DataFrame, *values) -> list:
    return [None if x is None else docs.sparkSession.sparkContext.broadcast(x) for x in values]


def _counted(docs: DataFrame, longest: int, shortest: int = 1, now=None, before=None, known: int | None = None, may: _May | None = None, limit: int = SLICE) -> DataFrame:
    now, before, may = _shared(docs, now, before, may)
    rows = docs.mapInArrow(_count(longest, shortest, now, before, known or longest, may, limit), "lang string, phrase string, words int, f long")
    return rows.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))


# ---- buckets ----------------------------------------------------------------------------------------


def _entries(bits: int, least: int, longest: int, shortest: int, now, known: int):
    """Buckets of the phrases that :func:`_count` counts, by stretch, with their counts up to ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, some = None if now is None else now.value, []
        for batch in slices(batches, limit=SLICE):
            found = _read(batch)
            if found is None:
                continue
            if shortest == 1:
                some.append(_entry(_buckets(found.hash, bits), found.seen))
            steps = [hashes for length, _, hashes, _ in _walk(found, longest, shortest, held, None, known, None) if length >= shortest]
            if steps:
                some.append(_entry(*np.unique(_buckets(np.concatenate(steps), bits), return_counts=True)))
            if sum(map(len, some)) >= ENTRIES:
                yield _stretches(some, least)
                some = []
        if some:
            yield _stretches(some, least)

    return run


def _entry(bucket: np.ndarray, count: np.ndarray) -> np.ndarray:
    return bucket << np.uint64(32) | count.astype(np.uint64)


def _stretches(some: list[np.ndarray], least: int) -> pa.RecordBatch:
    """Rows of a stretch each, with the places of its buckets there and their counts. A count cut at ``least`` still reaches it."""
    entries = np.sort(np.concatenate(some))
    bucket = entries >> np.uint64(32)
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    count = np.minimum(np.add.reduceat(entries & np.uint64(0xFFFFFFFF), first), np.uint64(least)).astype(np.min_scalar_type(least))
    bucket = bucket[first]
    stretch = bucket >> np.uint64(16)
    begin = np.flatnonzero(np.append(True, stretch[1:] != stretch[:-1]))
    at = np.append(begin, len(bucket))
    columns = [pa.array(stretch[begin].astype(np.int32))]
    for values in ((bucket & np.uint64(0xFFFF)).astype(np.uint16), count):
        offsets = (at * values.itemsize).astype(np.int32)
        columns.append(pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(values)]))
    return pa.RecordBatch.from_arrays(columns, ["stretch", "places", "counts"])


def _reaching(least: int):
    """Buckets of a stretch that reach ``least``."""

    def run(table: pa.Table) -> pa.Table:
        sums = np.zeros(1 << 16)
        for batch in table.to_batches():
            places, counts = (buffers(batch.column(c).cast(pa.binary()))[0] for c in ("places", "counts"))
            sums += np.bincount(places.view(np.uint16), counts.view(np.min_scalar_type(least)), 1 << 16)
        over = np.flatnonzero(sums >= least)
        return pa.table({"bucket": pa.array(over + (table.column("stretch")[0].as_py() << 16), pa.int64())})

    return run


def _frequent(docs: DataFrame, least: int, longest: int, shortest: int = 1, now=None, known: int | None = None) -> DataFrame:
    """The rows of :func:`_counted` with at least ``least`` occurrences, and those of no words."""
    may = None
    if least > 1:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = min(max((size // BUCKET_TEXT).bit_length(), BUCKET_BITS[0]), BUCKET_BITS[1])
        run = _entries(bits, least, longest, shortest, *_shared(docs, now), known or longest)
        entries = docs.mapInArrow(run, "stretch int, places binary, counts binary")
        may = _May(_filter(stage(entries.groupBy("stretch").applyInArrow(_reaching(least), "bucket long")), _bucket_marks), bits)
    return _counted(docs, longest, shortest, now=now, known=known, may=may).filter((F.col("words") == 0) | (F.col("f") >= least))


# ---- mining -----------------------------------------------------------------------------------------


def propose(docs: DataFrame, support: int, longest: int, sample: int = SAMPLE, lower: float = LOWER) -> DataFrame:
    """Phrases that are frequent in a sample of ``docs(lang, text)``, with a lowered threshold."""
    taken = stage(docs.filter(F.pmod(F.xxhash64("lang", "text", "row"), F.lit(sample)) == 0))
    least = max(1, int(lower * support / sample))
    short = stage(_frequent(taken, least, min(2, longest)).filter("words > 0"))
    if longest <= 2:
        return short
    long = _frequent(taken, least, longest, 3, now=_filter(short.select("lang", "phrase")), known=2)
    return stage(short.unionByName(long))


def frequent_phrases(docs: DataFrame, support: int = 100, longest: int = 5, sample: int = SAMPLE, lower: float = LOWER) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, words, f`` of all phrases with at least ``support`` occurrences, and ``lang, n`` of all words.

    ``docs`` has ``lang, text, row``, the last any value that tells rows apart for the sample.
    """
    proposed = propose(docs, support, longest, sample, lower).select("lang", "phrase", "words")
    now = _filter(proposed.select("lang", "phrase"))
    counted = stage(_frequent(docs, support, longest, now=now))
    totals = stage(counted.filter("words = 0").select("lang", F.col("f").alias("n")))
    found = counted.filter("words > 0")
    frequent = [found]
    while True:
        failures = stage(found.join(proposed, ["lang", "phrase"], "left_anti").select("lang", "phrase", "words"))
        if failures.filter(F.col("words") < longest).isEmpty():
            break
        proposed = proposed.unionByName(failures)
        before, now = now, _grown(now, failures)
        found = stage(_counted(docs, longest, 2, now=now, before=before).filter(F.col("f") >= support))
        frequent.append(found)
    every = frequent[0]
    for more in frequent[1:]:
        every = every.unionByName(more)
    return every, totals


def _grown(now: np.ndarray, failures: DataFrame) -> np.ndarray:
    """The filter with the bits of ``failures`` added; its size stays."""
    marks = failures.select("lang", "phrase").mapInArrow(_marks(len(now) * 64), "word long, mask long")
    rows = marks.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    grown = now.copy()
    grown[rows["word"].to_numpy()] |= rows["mask"].to_numpy().view(np.uint64)
    return grown


def _part(begin: str, count: str) -> F.Column:
    return F.expr(f"array_join(slice(split(phrase, ' '), {begin}, {count}), ' ')")


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """Phrases of two and more words with ``lang, phrase, words, a, l, r, n, score`` of their lowest cut."""
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    long = phrases.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    cuts = long.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("head", _part("1", "k")).withColumn("tail", _part("k + 1", "words - k"))
    counts = stage(phrases.select("lang", "phrase", "f"))
    for part, name in (("head", "l"), ("tail", "r")):
        sums = counts.select(F.col("lang"), F.col("phrase").alias(part), F.col("f").alias(name))
        cuts = equi_join(cuts, sums, ["lang", part], "inner", spread=True)
    cuts = equi_join(cuts, totals, "lang", "inner", spread=True, small=totals.count() <= 100_000)
    cuts = cuts.withColumn("top", F.lit(1000).cast("decimal(4,0)") * (wide("a") * wide("n")).cast("decimal(34,0)")).withColumn("bottom", wide("l") * wide("r"))
    cuts = cuts.withColumn("score", F.expr("top DIV bottom"))
    best = cuts.groupBy("lang", "phrase", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "n", "cut.score")


def maximal(candidates: DataFrame, percent: int = 100) -> DataFrame:
    """Drop candidates inside a longer one that has at least ``percent`` of their occurrences.

    A phrase inside a longer one is inside one of a single word more that occurs no less often, so both ends of
    each candidate are enough.
    """
    ends = candidates.filter("words > 2").select(
        "lang", "a", F.explode(F.array(_part("1", "words - 1"), _part("2", "words - 1"))).alias("phrase")
    )
    longest = ends.groupBy("lang", "phrase").agg(F.max("a").alias("_over"))
    kept = candidates.join(longest, ["lang", "phrase"], "left")
    return kept.filter(F.col("_over").isNull() | (100 * F.col("_over") < percent * F.col("a"))).drop("_over")


def collocations(docs: DataFrame, support: int = 100, longest: int = 5, top: int = 2000, sample: int = SAMPLE, lower: float = LOWER) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` collocations of each group of ``docs(lang, text)``."""
    kept = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").withColumn("row", F.monotonically_increasing_id())
    phrases, totals = frequent_phrases(kept, support, longest, sample, lower)
    found = maximal(stage(scored(phrases, totals)))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
