"""Packing, Merkle manifest and phrase mining against brute force and edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataweave.llm import best_fit_packing, merkle_climb, queries, toivonen
from strataweave.llm.tokens import SPACES, tokens
from strataweave.llm.words import LOWER

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, part int, level int, length long, a long"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns whose names operators use themselves."""
    queries.reach_package(spark)
    long_text = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [
        (1, "a B c d. e f g", "en", "s", 13, "r", 1, 1, 1, 1),
        (1, "a B c d. e f g", "en", "s", 13, "r", 1, 1, 1, 1),
        (2, None, None, None, None, None, None, None, None, None),
        (3, "", "en", "s", 0, "", 0, 0, 0, 0),
        (None, "a b c d e f g", "en", "s", None, None, 2, 2, 2, 2),
        (4, long_text, "de", "", len(long_text), None, 3, 3, 3, 3),
        (4, "Tail <|endoftext|>x ¶É́", "de", "s", 4, None, 3, 3, 3, 3),
        (5, " \t\n\x0b \x0c", "fr", "t", 4, None, 4, 4, 4, 4),
    ] + [(100 + i, "Same Same same same", None, "hot", 3, None, 0, 0, 0, 0) for i in range(300)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    queries.reach_package(spark)
    return spark.createDataFrame([], DOCS)


def test_tokens_are_told_apart_by_bytes():
    texts = ["Ab cd", None, "", "  cd\tab ", "xÉ y", "é"]
    found = tokens(pa.array(texts), SPACES, LOWER)
    named = [(r, found.distinct[c].as_py()) for r, c in zip(found.row.tolist(), found.code.tolist())]
    assert named == [(i, w) for i, t in enumerate(texts) for w in re.findall(rb"[^ \t\r\n]+", (t or "").translate(LOW).encode())]
    raw = "".join(t or "" for t in texts).encode()
    assert [raw[a:b].lower() for a, b in zip(found.start, found.end)] == [w for _, w in named]
    assert len(tokens(pa.array([], pa.string()), SPACES).code) == 0
    sliced = tokens(pa.array(["zz", "ab cd", "e"]).slice(1), SPACES)
    assert [sliced.distinct[c].as_py() for c in sliced.code] == [b"ab", b"cd", b"e"] and sliced.row.tolist() == [0, 0, 1]


# ---- packing ------------------------------------------------------------------------------------


def least_bins(sizes, capacity):
    """By trying every bin for each document, longest first."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for b in {room: k for k, room in enumerate(bins)}.values():
            if bins[b] >= sizes[i]:
                place(i + 1, bins[:b] + [bins[b] - sizes[i]] + bins[b + 1 :])
        place(i + 1, bins + [capacity - sizes[i]])

    place(0, [])
    return best


def test_pack_is_least_on_small_sets():
    r = random.Random(5)
    better = 0
    for trial in range(60):
        capacity = 30
        sizes = [r.randint(3, 20) for _ in range(r.randint(1, 12))]
        counts = np.bincount(sizes, minlength=capacity + 1)
        packing = best_fit_packing.pack(counts, capacity)
        used = sum(t for t, _ in packing)
        assert used == least_bins(sizes, capacity), sizes
        assert best_fit_packing.lower_bound(counts, capacity) <= used
        held = np.zeros(capacity + 1, np.int64)
        for times, filling in packing:
            assert sum(n * m for n, m in filling) <= capacity and times > 0
            for n, m in filling:
                held[n] += n and m * times
        assert held.tolist() == counts.tolist()
        better += used < sum(t for t, _ in best_fit_packing.best_fit(counts, capacity))
    assert best_fit_packing.pack(np.zeros(31, np.int64), 30) == []


def test_bin_completion_beats_best_fit():
    counts = np.bincount([6, 6, 5, 5, 4, 4] + [60, 50, 40, 30, 20], minlength=101)
    hard = np.bincount([44, 44, 31, 31, 25, 25] * 40, minlength=101)  # 44 + 31 + 25 fills a sequence, 44 + 44 wastes 12
    assert sum(t for t, _ in best_fit_packing.best_fit(hard, 100)) > 80
    assert sum(t for t, _ in best_fit_packing.pack(hard, 100)) == 80
    assert sum(t for t, _ in best_fit_packing.pack(counts, 100)) == best_fit_packing.lower_bound(counts, 100)
    assert sum(t for t, _ in best_fit_packing.pack(hard * 10**9, 100)) == 80 * 10**9


def check_packing(docs, out, capacity):
    from tokenizers import Tokenizer

    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = Counter()
    for row in docs.select("doc_id", "text").collect():
        ids = np.array(tokenizer.encode(row.text or "", add_special_tokens=False).ids + [1], "<u4")
        for i, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            expected[(row.doc_id, i, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in out) == expected
    places = defaultdict(list)
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
    for spots in places.values():
        end = 0
        for offset, length in sorted(spots):
            assert offset == end
            end += length
        assert end <= capacity
    return len(places)


def test_pack_documents(spark, odd, none):
    out = best_fit_packing.pack_documents(odd).collect()
    used = check_packing(odd, out, 4096)
    assert used == -(-sum(r.length for r in out) // 4096)
    assert check_packing(odd, best_fit_packing.pack_documents(odd, capacity=64).collect(), 64)
    assert best_fit_packing.pack_documents(none).collect() == []
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = queries.QUERIES["op11_best_fit_packing"](spark, SF).collect()
    counts = np.bincount([r.length for r in out], minlength=4097)
    assert check_packing(docs, out, 4096) == best_fit_packing.lower_bound(counts, 4096)


# ---- Merkle manifest -------------------------------------------------------------------------------


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(row):
    found = [row]
    while len(found[-1]) > 1:
        found.append([digest(*found[-1][i : i + 16]) for i in range(0, len(found[-1]), 16)])
    return found


def climb(tree, i):
    steps = []
    for level in tree[:-1]:
        run = i // 16 * 16
        steps.append((level[run:i], level[i + 1 : run + 16]))
        i //= 16
    return steps


def brute_manifest(rows, changed):
    leaf = lambda r: digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r])
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(((r[0] is not None, r[0] or 0), leaf(r), leaf((*r[:4], changed(r))), r[0]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [levels([x[1] for x in sorted(groups[s])]) for s in names]
    top = levels([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(names):
        for i, (_, own, start, key) in enumerate(sorted(groups[s])):
            steps = climb(trees[k], i) + climb(top, k)
            fold = start
            for before, after in steps:
                fold = digest(*before, fold, *after)
            out.append((key, own, trees[k][-1][0], top[-1][0], digest(*[x for b, a in steps for x in b + a]), fold, fold == top[-1][0]))
    return sorted(out, key=repr)


def spark_manifest(docs, change):
    out = merkle_climb.verify_manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "source", "doc_id", {"text": change})
    return sorted([tuple(r) for r in out.collect()], key=repr)


def test_manifest(spark, odd, none):
    lowered = lambda r: r[4] and r[4].translate(LOW)
    every = merkle_climb.lower_ascii(F.col("text"))
    pick = lambda docs: [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert spark_manifest(odd, every) == brute_manifest(pick(odd), lowered)
    many = odd.withColumn("source", F.concat(F.lit("s"), F.expr("doc_id % 40"))).filter("doc_id IS NOT NULL")
    assert spark_manifest(many, every) == brute_manifest(pick(many), lowered)
    one = odd.filter("doc_id = 3")
    assert spark_manifest(one, every) == brute_manifest(pick(one), lowered)
    alone = odd.filter("source = 'hot'")
    assert spark_manifest(alone, every) == brute_manifest(pick(alone), lowered)
    assert spark_manifest(none, every) == []


def test_manifest_copies_of_hot_nodes(odd, monkeypatch):
    """Nodes above many runs exist more than once; rows and digests stay the same."""
    every = merkle_climb.lower_ascii(F.col("text"))
    before = spark_manifest(odd, every)
    monkeypatch.setattr(merkle_climb, "MEET", 2)
    assert spark_manifest(odd, every) == before


# ---- phrases -----------------------------------------------------------------------------------------


def brute_phrases(rows, support, top):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= support}
        inside = {p[i:j] for p, a in found.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and a >= f[p[i:j]]}
        ranked = []
        for p, a in found.items():
            if p not in inside:
                score, k = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def mined(docs, support, top, **options):
    return sorted(tuple(r) for r in toivonen.collocations(docs, support, top=top, **options).collect())


def test_collocations(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.lang, r.text) for r in docs.select("lang", "text").collect()]
    assert mined(docs, 6, 60) == brute_phrases(rows, 6, 60)
    plain = [(r.lang, r.text) for r in odd.select("lang", "text").collect()]
    assert mined(odd, 2, 100) == brute_phrases(plain, 2, 100)
    assert mined(none, 2, 10) == []


def test_failures_of_the_border_are_expanded(spark, monkeypatch):
    """A phrase that no sampled document has is found in full through passes over the border."""
    r = random.Random(3)
    plain = [(i, " ".join(r.choice("abcdefgh") for _ in range(30)), "x") for i in range(40)]
    docs = spark.createDataFrame(plain + [(99, "one Two three four five. " * 20, None)], "doc_id long, text string, lang string")
    queries.reach_package(spark)
    passes = []
    counted = toivonen._counted
    monkeypatch.setattr(toivonen, "_counted", lambda *a, **k: passes.append(k.get("before") is not None) or counted(*a, **k))
    monkeypatch.setattr(toivonen, "propose", lambda rows, *a: rows.sparkSession.createDataFrame([], "lang string, phrase string, words int, f long"))
    assert mined(docs, 12, 500) == brute_phrases([(x[2], x[1]) for x in plain] + [(None, "one Two three four five. " * 20)], 12, 500)
    assert sum(passes) >= 4


def test_filter_that_says_yes_too_often_changes_nothing(odd, monkeypatch):
    monkeypatch.setattr(toivonen, "FILTER_BITS", 64)
    plain = [(r.lang, r.text) for r in odd.select("lang", "text").collect()]
    monkeypatch.setattr(toivonen, "BITS_EACH", 1)
    assert mined(odd, 2, 100, sample=2) == brute_phrases(plain, 2, 100)


def test_scores_beyond_64_bits(spark):
    rows = [("x", "a", 1, 10**13), ("x", "b", 1, 3 * 10**12), ("x", "a b", 2, 7 * 10**11 + 1)]
    phrases = spark.createDataFrame(rows, "lang string, phrase string, words int, f long")
    totals = spark.createDataFrame([("x", 9 * 10**16 + 7)], "lang string, n long")
    found = toivonen.scored(phrases, totals).first()
    assert found.score == 1000 * (7 * 10**11 + 1) * (9 * 10**16 + 7) // (3 * 10**25)


def test_rare_phrases_of_the_border_are_not_counted_as_texts(spark, monkeypatch):
    """Frequent words in random order: nearly all pairs are in the border, and only frequent phrases are counted as texts."""
    r = random.Random(5)
    rows = [("x", " ".join(f"w{r.randrange(300)}" for _ in range(100)) + ". one two three") for _ in range(300)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    queries.reach_package(spark)
    tables, counted = [], toivonen._counted
    monkeypatch.setattr(toivonen, "_counted", lambda *a, **k: tables.append(counted(*a, **k)) or tables[-1])
    assert mined(docs, 30, 100, sample=2) == brute_phrases(rows, 30, 100)
    assert max(t.count() for t in tables) < 2_000


@pytest.mark.parametrize("least", [2, 100, 300])
def test_buckets_keep_all_that_reaches_the_support(least):
    """Counts that are spread over tasks, cut at the support, and in the first and last bucket of a stretch."""
    r = random.Random(least)
    places = [0, 5, (1 << 16) - 1, 1 << 16, (1 << 32) - 1] + [r.randrange(1 << 18) for _ in range(200)]
    sent, sums = [], {}
    for _ in range(3):
        some = []
        for _ in range(4):
            part = {p: r.randrange(1, max(3, least // 8)) * r.choice([1, 1, 1, 40]) for p in sorted(r.sample(places, 90))}
            sums = {p: sums.get(p, 0) + part.get(p, 0) for p in {**sums, **part}}
            some.append(toivonen._entry(np.array(list(part), np.uint64), np.array(list(part.values()))))
        sent.append(toivonen._stretches(some, least))
    table, found = pa.Table.from_batches(sent), []
    for stretch in sorted(set(table["stretch"].to_pylist())):
        rows = table.filter(pa.array([x == stretch for x in table["stretch"].to_pylist()]))
        found += toivonen._reaching(least)(rows)["bucket"].to_pylist()
    assert found == sorted(p for p, n in sums.items() if n >= least)
    assert 0 < len(found) <= len(sums)
