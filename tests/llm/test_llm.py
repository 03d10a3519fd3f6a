"""Training-data operators against brute force, exact round trips and edge cases."""

from __future__ import annotations

import base64
import hashlib
import io
import itertools
import math
import random
import re
import textwrap
import zipfile
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from strataweave.llm import (
    co_training,
    decontaminate,
    jaccard_join,
    lattice_score,
    license_scan,
    link_trust,
    oracles,
    piece_codec,
    queries,
    topk_search,
    two_pass_shuffle,
    words,
    zip_archive,
)
from tools.check import canonical

SF = "/root/testdata/sf0.001"
SYMBOL_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, n long"


def blank_words(text):
    return (text or "").encode().lower().split()


def symbol_words(text):
    return SYMBOL_WORDS.findall((text or "").encode().lower())


def invented(seed, n, vocabulary=40, low=0, high=60):
    r = random.Random(seed)
    pool = [f"{'aeiou'[i % 5]}w{i}" for i in range(vocabulary)] + ["Ünï", "ÉA", "zß."]
    return [" ".join(r.choice(pool) for _ in range(r.randint(low, high))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns whose names operators use themselves."""
    long_text = " ".join(f"w{i % 977}" for i in range(40_000))
    rows = [
        (1, "a b c d e f g", "en", "s", 13, "r", 1),
        (1, "a b c d e f g", "en", "s", 13, "r", 1),
        (2, None, None, None, None, None, None),
        (3, "", "en", "s", 0, "", 0),
        (None, "a b c d e f g", "en", "s", None, None, 2),
        (4, long_text, "de", "s", len(long_text), None, 3),
        (4, "tail", "de", "s", 4, None, 3),
        (5, " \t\n ", "fr", "t", 4, None, 4),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# words


@pytest.mark.parametrize("separators, split", [(words.BLANKS, blank_words), (words.SYMBOLS, symbol_words)])
def test_words_are_the_contracts_words(separators, split):
    texts = ["Hello  world É\x0bx", None, "", "hello", "A-b c9_d", " lead trail ", "x" * 200_000 + " y", "\u00a0z\u2028q"]
    found = words.words(pa.array(texts), separators)
    got = [bytes(words.LOWER[found.data[s:e]]) for s, e in zip(found.start, found.end)]
    assert got == [w for t in texts for w in split(t)]
    assert Counter(found.row.tolist()) == Counter({i: len(split(t)) for i, t in enumerate(texts) if split(t)})
    assert len(set(found.hash.tolist())) == len(set(got))


def twins(depth=10):
    """Two words of 2**depth letters that collide under every polynomial modulo a power of two."""
    a, b = "p", "q"
    for _ in range(depth):
        a, b = a + b, b + a
    return a, b


def test_words_that_polynomials_confuse(spark):
    a, b = twins()
    for separators in (words.BLANKS, words.SYMBOLS):
        found = words.words(pa.array([f"{a} {b} {a.upper()}"]), separators)
        assert found.hash[0] != found.hash[1] and found.hash[0] == found.hash[2]
        assert words.same_words(found, np.array([0, 0, 0]), found, np.array([0, 1, 2])).tolist() == [True, False, True]
    docs = spark.createDataFrame([(1, f"one two three four {a}"), (2, f"one two three four {b}"), (3, a)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 3}
    items = spark.createDataFrame([("i", b)], "item_id string, text string")
    assert {r.doc_id: r.n_hit for r in decontaminate.scan(docs, items).collect()} == {1: 0, 2: 1, 3: 0}
    table = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    held = [i for i in (1, 2, *range(3, 60)) if zlib.crc32(str(i).encode()) % 7 == 2][0]
    rows = [(1, a), (held, b)]
    scored = lattice_score.lattice_scores(table.sparkSession.createDataFrame(rows, table.schema)).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in scored) == lattice_expectation(rows)


def test_slices_keep_all_rows():
    texts = invented(1, 50) + [None, "", "q" * 5_000]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    parts = list(words.slices([batch.slice(3)], limit=300))
    assert [t for p in parts for t in p.column("text").to_pylist()] == texts[3:]


# operator 1


def test_forward_sums_all_segmentations():
    listed, weight = lattice_score.read_pieces(lattice_score.VOCABULARY)
    table = dict(zip(listed, weight))
    pieces = lattice_score.Pieces(listed)

    def brute(word):
        text = b" " + word
        total = 0.0
        for cuts in itertools.product((0, 1), repeat=len(text) - 1):
            edges = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(text)]
            parts = [text[a:b] for a, b in zip(edges, edges[1:])]
            if all(p in table for p in parts):
                total += math.exp(sum(table[p] for p in parts))
        return math.log(total)

    batch = [b"the", b"nation", "é€".encode(), b"a", b"zzzzzzz"]
    assert np.allclose(lattice_score.word_scores(batch, pieces, weight), [brute(w) for w in batch])


def test_expected_counts_cover_every_byte():
    listed, weight = lattice_score.read_pieces(lattice_score.VOCABULARY)
    batch, count = [b"inanin.", b"the", "ñ".encode()], np.array([3, 1, 2])
    expected = lattice_score.Lattice(batch, lattice_score.Pieces(listed)).expected(weight, count, len(listed))
    bytes_ = sum(x * len(p) for x, p in zip(expected, listed))
    assert np.isclose(bytes_, sum((len(w) + 1) * c for w, c in zip(batch, count)))


def lattice_expectation(docs):
    counts, total = Counter(), 0
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    for i, text in docs:
        if not held(i):
            counts.update([*blank_words(text), "END"])
            total += len(blank_words(text)) + 1
    out = []
    for i, text in docs:
        own = [*blank_words(text), "END"]
        base = sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in own)
        out.append((str(i), held(i), len(own), sum(counts[w] > 0 for w in own), total, round(base, 6)))
    return sorted(out)


@pytest.mark.parametrize("limit", [1_000_000, 20])
def test_lattice_scores(spark, odd, monkeypatch, limit):
    monkeypatch.setattr(lattice_score, "FREQUENT_LIMIT", limit)
    texts = invented(2, 60)
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string"))
    got = lattice_score.lattice_scores(docs).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == lattice_expectation(rows)
    by_text = {}
    for i, text in rows:
        by_text.setdefault(" ".join(map(repr, blank_words(text))), set()).add(str(i))
    scores = {str(r.doc_id): r.score for r in got if r.doc_id not in (4, 1)}
    assert all(s < 0 for s in scores.values())
    assert np.isclose(scores["2"], scores["3"]) and np.isclose(scores["3"], scores["5"])  # only the end


def test_lattice_scores_of_nothing(none):
    assert lattice_score.lattice_scores(none).count() == 0


# operator 2


def test_hosts_paths_and_rules(spark):
    urls = ["http://A.Example.ORG/es/x?q#f", "https://x.com/fr/", "http://x.com?fr", "no scheme", None, "http://", "q://Ä.com/de/1", "http://example.org/en/1", "http://notexample.org/es/", "http://h://i/fr/"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    rule, action = link_trust.rule_columns(link_trust.host_of(df.url), link_trust.path_of(df.url))
    got = [tuple(r) for r in df.select(link_trust.host_of(df.url), link_trust.path_of(df.url), rule, action).collect()]
    assert got == [
        ("a.example.org", "/es/x", "example.org/es/", "block"),
        ("x.com", "/fr/", "com/fr/", "allow"),
        ("x.com", "", None, None),
        ("", "", None, None),
        ("", "", None, None),
        ("", "", None, None),
        ("Ä.com", "/de/1", "com/de/", "block"),
        ("example.org", "/en/1", "example.org/en/1", "block"),
        ("notexample.org", "/es/", "org/", "allow"),
        ("h:", "//i/fr/", None, None),
    ]


def test_trust_spreads_along_links_and_distrust_against(spark):
    link = lambda *to: "".join(f'<a class="x" href="{t}">t</a>' for t in to)
    pages = [
        (1, "http://good.org/a", link("http://near.net/x", "/own", "//far.net/")),
        (2, "http://near.net/", link("https://far.net/")),
        (3, "http://bad.com/de/x", link("http://near.net/")),
        (4, "http://spam.net/", link("http://bad.com/", "http://bad.com/q")),
        (5, "http://far.net/", None),
        (6, None, None),
        (6, None, None),
    ]
    rows = link_trust.url_verdicts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    got = {r.page_id: r for r in rows}
    assert len(rows) == 7
    assert [got[i].verdict for i in (1, 2, 3, 4, 5, 6)] == ["allow", "allow", "block", "block", "allow", "allow"]
    edges = {("good.org", "near.net"): 1, ("good.org", "far.net"): 1, ("near.net", "far.net"): 1, ("bad.com", "near.net"): 1, ("spam.net", "bad.com"): 2}
    hosts = {h for e in edges for h in e}
    for kind, seed, flow in (("trust", "good.org", edges), ("distrust", "bad.com", {(b, a): n for (a, b), n in edges.items()})):
        start = {h: float(h == seed) for h in hosts}
        rank = dict(start)
        for _ in range(400):
            new = {h: (1 - link_trust.DAMPING) * start[h] for h in hosts}
            for (a, b), n in flow.items():
                new[b] += link_trust.DAMPING * rank[a] * n / sum(m for (c, _), m in flow.items() if c == a)
            rank = new
        for r in rows:
            if r.host in hosts:
                assert np.isclose(r[kind], rank[r.host])


def test_trust_reaches_hosts_at_any_distance(spark):
    link = lambda to: f'<a href="http://{to}/">t</a>'
    chain = [f"h{i}.net" for i in range(40)] + ["bad.com"]
    pages = [(i, f"http://{a}/", link(b)) for i, (a, b) in enumerate(zip(chain, chain[1:]))] + [(90, "http://bad.com/de/", None)]
    pages += [(91, "http://x.net/", link("y.net")), (92, "http://y.net/", link("x.net"))]  # no seed reaches these
    df = spark.createDataFrame([(*p, "other") for p in pages], "page_id long, url string, html string, rank string").withColumn("kind", F.lit(1))
    got = {r.page_id: r.verdict for r in link_trust.url_verdicts(df).collect()}
    assert got == {i: "block" if i < 91 else "allow" for i, *_ in pages}
    assert link_trust.url_verdicts(df.limit(0)).count() == 0


# operator 3


def brute_hits(docs, items):
    windows = {}
    for i, text in items:
        own = symbol_words(text)
        n = min(13, len(own))
        for k in range(len(own) - n + 1 if n else 0):
            windows.setdefault(tuple(own[k : k + n]), set()).add(i)
    out = []
    for text in docs:
        own, hit, found = symbol_words(text), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(own) - n + 1):
                ids = windows.get(tuple(own[k : k + n]))
                if ids:
                    hit |= set(range(k, k + n))
                    found |= ids
        out.append((len(own), len(hit), sorted(str(i) for i in found if i is not None)))
    return out


def benchmark_case(seed):
    items = list(enumerate(invented(seed, 12, 12, 10, 30))) + [(50, "aw0"), (51, ""), (52, None), (None, "ew1 iw2")]
    r = random.Random(seed)
    docs = invented(seed + 1, 40, 30) + [None, "", "aw0"]
    for _ in range(30):
        passage = r.choice(items[:12])[1].split()
        a = r.randint(0, 3)
        docs.append(" ".join(invented(r.random(), 1)[0].split() + passage[a : a + r.randint(8, 30)] + invented(r.random(), 1)[0].split()))
    return items, docs + [docs[-1]] * 3


@pytest.mark.parametrize("seed", range(4))
def test_index_finds_what_scanning_finds(seed):
    items, docs = benchmark_case(seed)
    for own in (items, items[:12]):
        table = decontaminate.windows_of([i for i, _ in own], [t for _, t in own])
        n_words, spans, n_hit, found = decontaminate.scan_shard(pa.array(docs, pa.string()), table)
        assert list(zip(n_words.tolist(), n_hit.tolist(), found)) == brute_hits(docs, own)
        for text, own_spans, n in zip(docs, spans.to_pylist(), n_hit.tolist()):
            raw = (text or "").encode()
            assert sum(len(symbol_words(raw[s["start"] : s["end"]].decode())) for s in own_spans) == n


def test_suffix_array():
    for seed in range(5):
        r = random.Random(seed)
        symbols = np.array([r.randint(0, 3) for _ in range(200)] + [1, 2] * 40 + [0])
        stops = np.cumsum(symbols == 0)
        key = [(0, int(stops[i])) if s == 0 else (1, int(s)) for i, s in enumerate(symbols)]
        assert decontaminate.suffix_array(symbols).tolist() == sorted(range(len(key)), key=lambda i: key[i:])


@pytest.mark.parametrize("block", [32 << 20, 300])
def test_scan_and_decontaminate(spark, odd, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    items, texts = benchmark_case(9)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    got = decontaminate.scan(docs, benchmark).collect()
    texts += [r.text for r in odd.collect()]
    want = Counter((w, h, tuple(i), h > 0 and 20 * h >= w) for w, h, i in brute_hits(texts, items))
    assert Counter((r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got) == want
    kept = decontaminate.decontaminate(odd, benchmark)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_decontaminate_nothing(spark, none):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.scan(none, empty).count() == 0
    one = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert [tuple(r) for r in decontaminate.scan(one, empty).select("n_words", "n_hit", "contaminated").collect()] == [(1, 0, False)]


# operator 4


def test_licences_against_plain_cosines(spark):
    lines = list(license_scan.TEMPLATES.values())
    r = random.Random(3)
    texts = [None, ""] + invented(4, 30, 20)
    for line in lines * 3:
        texts.append("\n".join([invented(r.random(), 1)[0], f"# {line}", line.upper() + r.choice(["", " today", " of the and all"])]))
    texts += ["the of the in", lines[0] + " " + lines[1]]
    files = [(i, f"d{i % 3}/e{i % 5}/{'LICENSE' if i % 7 == 0 else i}", t) for i, t in enumerate(texts)] + [(900, None, "x"), (901, "top", lines[3]), (901, "top", lines[3])]
    got = license_scan.scan_licences(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()
    assert len(got) == len(files)

    terms = license_scan._terms_of
    vocabulary = {t for x in lines for t in terms(x)}
    df = Counter(t for _, _, x in files for t in set(terms(x or "")) & vocabulary)
    n = len(files)
    idf = lambda t: math.log((1 + n) / (1 + (df[t] if t in vocabulary else 1))) + 1
    vectors = {k: Counter(terms(x)) for k, x in license_scan.TEMPLATES.items()}

    def cosine(a, b):
        dot = sum(a[t] * b[t] * idf(t) ** 2 for t in a)
        return dot / math.sqrt(sum((v * idf(t)) ** 2 for t, v in a.items()) * sum((v * idf(t)) ** 2 for t, v in b.items())) if a and b else 0

    own = []
    for _, path, text in files:
        units = (text or "").split("\n") + ([text or ""] if path and "LICENSE" in path else [])
        best = max(((round(cosine(Counter(terms(u)), v), 9), -i, k) for u in units for i, (k, v) in enumerate(sorted(vectors.items()))), default=(0, 0, None))
        own.append(best if best[0] >= license_scan.COSINE else None)
    granted = {}
    for (_, path, _), best in zip(files, own):
        if path and "LICENSE" in path and best:
            folder = path.rpartition("/")[0]
            granted[folder] = max(granted.get(folder, (0, "")), (best[0], best[2]))
    want = Counter()
    for (i, path, _), best in zip(files, own):
        folder, near = (path or "").rpartition("/")[0], None
        if not best:
            while near is None:
                near = granted.get(folder)
                if not folder:
                    break
                folder = folder.rpartition("/")[0]
        want[(i, best[2] if best else near[1] if near else None)] += 1
    assert Counter((r.doc_id, r.license) for r in got) == want
    assert {"header", "inherited", "none"} <= {r.found for r in got}


def test_terms_of_columns(spark):
    texts = ["a.b. .c -- d", "...", "", "v. 2.0.", "-x- +y+ 4.0\n(c) BY-NC.", "Line one.\n", "a----b -.+", "é2.0é"]
    got = spark.createDataFrame([(x,) for x in texts], "text string").select("text", license_scan.terms(F.col("text")).alias("t")).collect()
    assert all(r.t == license_scan._terms_of(r.text) for r in got)


def test_licence_scores_count_dotted_terms(spark):
    """Files with '2.0' and '4.0' count, so lines that miss or hold only such a term get the scores of the formula."""
    lines = ["Licensed under CC BY", "CC 4.0", "2.0", "4.0.", "Licensed under CC BY 4.0.", "Licensed under the Apache License"]
    texts = lines + ["Apache 2.0"] * 40 + ["see v. 2.0, or 4.0"] * 40 + ["plain words"] * 20
    df = spark.createDataFrame([(i, f"{i}.txt", x) for i, x in enumerate(texts)], "doc_id long, path string, text string")
    got = {r.doc_id: r for r in license_scan.scan_licences(df, license_scan.TEMPLATES, cosine=0.01).collect()}
    vectors = {k: Counter(license_scan._terms_of(x)) for k, x in license_scan.TEMPLATES.items()}
    vocabulary = {t for v in vectors.values() for t in v}
    files = Counter(t for x in texts for t in set(license_scan._terms_of(x)))
    idf = lambda t: math.log((1 + len(texts)) / (1 + (files[t] if t in vocabulary else 1))) + 1
    for i, line in enumerate(lines):
        unit = Counter(license_scan._terms_of(line))
        score = {}
        for k, v in vectors.items():
            norm = math.sqrt(sum((n * idf(t)) ** 2 for t, n in unit.items()) * sum((n * idf(t)) ** 2 for t, n in v.items()))
            score[k] = sum(n * v[t] * idf(t) ** 2 for t, n in unit.items()) / norm
        best = max(score, key=lambda k: (score[k], k))
        assert np.isclose(got[i].score, score[best]), line
        assert np.isclose(score[got[i].license], score[best]), line


def test_wrapped_notices_titles_and_licence_texts(spark):
    """Notices over several lines, titles and genuine licence files have their licence, and files inherit it."""
    form = license_scan.FORMS
    wrapped = lambda text, mark, width=60: "\n".join(mark + x for x in textwrap.wrap(text, width))
    code = "\n\nimport os\nprint(os.name)\n" + "\n".join(invented(8, 20))
    mit = "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + wrapped(form["MIT"][-1], "")
    bsd = "Copyright (c) 2020 A. Person\nAll rights reserved.\n\n" + wrapped(form["BSD-3-Clause"][-1], "")
    files = {
        "m/LICENSE": (mit, "MIT"),
        "m/src/x.py": ("import os", "MIT"),
        "b/LICENSE.txt": (bsd, "BSD-3-Clause"),
        "b/y.py": ("x = 1", "BSD-3-Clause"),
        "g/COPYING": ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n" + code * 3, "GPL-3.0"),
        "g/z.py": ("y = 2", "GPL-3.0"),
        "a/one.py": ("#!/bin/python\n# Copyright 2020 A. Person\n#\n" + wrapped(form["Apache-2.0"][-1], "# ") + code, "Apache-2.0"),
        "a/two.c": ("int x;\n/*\n" + wrapped(license_scan.TEMPLATES["BSD-3-Clause"], " * ", 40) + "\n */" + code, "BSD-3-Clause"),
        "a/three.c": ("// " + wrapped(form["GPL-3.0"][-1], "// ") + code, "GPL-3.0"),
        "a/four.c": (code + "\n" + wrapped(license_scan.TEMPLATES["MPL-2.0"], "// ", 40) + code, "MPL-2.0"),
        "a/five.md": ("Title\n=====\n\nMIT License\n" + code, "MIT"),
        "a/none.md": (code, None),
    }
    for i in range(200):
        files[f"n/{i}"] = (" ".join(("the of in to a is and or this with for not by any be version general use").split()[i % 7 :]), None)
    rows = [(i, path, text) for i, (path, (text, _)) in enumerate(files.items())]
    got = {r.path: r for r in license_scan.scan_licences(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert {p: r.license for p, r in got.items()} == {p: name for p, (_, name) in files.items()}
    assert got["m/src/x.py"].found == got["b/y.py"].found == "inherited"


def test_licence_scan_of_nothing(spark):
    assert license_scan.scan_licences(spark.createDataFrame([], "doc_id long, path string, text string")).count() == 0


# operator 5


class Raw:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


@pytest.mark.parametrize("limits", [(0xFFFFFFFF, 0xFFFF), (50, 2), (150, 0xFFFF)])
def test_directories_with_and_without_zip64(limits):
    out = io.BytesIO()
    archive = zip_archive.StoredZip(out, *limits)
    want = {f"m{i}/é": bytes([i]) * 60 for i in range(5)} | {"empty": b""}
    for name, data in want.items():
        archive.add(name, data)
    archive.close()
    data = out.getvalue()
    with zipfile.ZipFile(io.BytesIO(data)) as file:
        assert file.testzip() is None and {n: file.read(n) for n in file.namelist()} == want
    members = zip_archive.read_directory(Raw(data), len(data))
    assert {n: data[zip_archive.member_start(Raw(data), at) :][:size] for n, (at, size) in members.items()} == want


def test_directory_of_another_writer_and_broken_ones():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as file:
        file.writestr("a", b"x" * 10)
        file.comment = b"PK\x05\x06 in a comment"
    assert list(zip_archive.read_directory(Raw(out.getvalue()), len(out.getvalue()))) == ["a"]
    with pytest.raises(ValueError):
        zip_archive.read_directory(Raw(b"nothing"), 7)
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as file:
        file.writestr("a", b"x" * 100)
    with pytest.raises(ValueError):
        zip_archive.read_directory(Raw(packed.getvalue()), len(packed.getvalue()))


def test_archives_round_trip(spark, monkeypatch):
    monkeypatch.setattr(zip_archive, "MEMBER_BYTES", 400)
    monkeypatch.setattr(zip_archive, "FETCH_BYTES", 900)
    pages = [(i, f"http://h/{i}", f"<p>{i % 7}é</p>" * (i % 5)) for i in range(40)]
    pages += [(100, None, None), (101, "http://é x\r\nInjected: y", ""), (None, "u", "<p>0é</p>"), (None, "u", "alone"), (7, "again", "<p>0é</p>" * 2), (7, "again", "<p>0é</p>" * 2), (200, "big", "z" * 50_000)]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, digest string, bytes long").repartition(3)
    archives = zip_archive.write_archives(df)
    got = zip_archive.read_archives(archives).collect()
    groups = {}
    for i, _, html in pages:
        groups.setdefault(html or "", []).append(i)
    want = Counter()
    for html, ids in groups.items():
        least = min((i for i in ids if i is not None), default=None)
        digest = base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        for i in ids:
            first = least is None or i == least
            want[(i, len(html.encode()), digest, "response" if first else "revisit", None if first else least)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert all(r.intact for r in got)
    assert zip_archive.read_archives(zip_archive.write_archives(df.limit(0))).count() == 0


# operator 6


def test_pieces_are_the_best_path():
    codec = piece_codec.Codec(piece_codec.MODEL)
    table = {"".join(map(chr, p)): codec.scores[n] for n, p in enumerate(codec.points)}
    by_id = {int(i): s for i, s in zip(codec.ids, codec.scores)}

    def best(text):
        text = piece_codec.MARK + text.replace(" ", piece_codec.MARK) if text else ""
        reach = [0.0] + [-math.inf] * len(text)
        for j in range(1, len(text) + 1):
            for i in range(max(0, j - codec.depth), j):
                score = table.get(text[i:j], codec.unknown if j - i == 1 else None)
                if score is not None:
                    reach[j] = max(reach[j], reach[i] + score)
        return reach[-1]

    texts = ["the nation", " two  blanks ", "internationalization unconstitutional", "a" * 300, "日本語テキスト", "x=1;\n\ty", "", " "] + invented(5, 20)
    ids, at = codec.encode(texts)
    for text, a, b in zip(texts, at[:-1], at[1:]):
        assert codec.decode(ids[a:b].tolist()) == text
        if all(int(i) in by_id for i in ids[a:b]):
            assert sum(by_id[int(i)] for i in ids[a:b]) == pytest.approx(best(text))


def test_library_decodes_the_same_text():
    import sentencepiece

    codec = piece_codec.Codec(piece_codec.MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=piece_codec.MODEL)
    texts = ["the", "of", "\x00€𝄞", " two  blanks\n", *invented(7, 20)]
    ids, at = codec.encode(texts)
    assert [library.decode(ids[a:b].tolist()) for a, b in zip(at[:-1], at[1:])] == texts


def test_memory_changes_nothing(monkeypatch):
    codec = piece_codec.Codec(piece_codec.MODEL)
    texts = invented(6, 60)
    whole = codec.encode(texts)[0].tolist()
    monkeypatch.setattr(piece_codec, "REMEMBERED", 20)
    memory = piece_codec.Memory()
    assert [i for t in texts for i in codec.encode([t], memory)[0].tolist()] == whole


def test_encode_and_decode_tables(odd, none):
    coded = piece_codec.decode(piece_codec.encode(odd))
    assert coded.columns == [*odd.columns, "token_ids", "decoded"]
    for r in coded.collect():
        assert r.decoded == r.text and (r.token_ids is None) == (r.text is None)
    assert piece_codec.decode(piece_codec.encode(none)).count() == 0


# operator 7


def brute_components(rows):
    def shingles(text):
        own = blank_words(text)
        return frozenset(tuple(own[i : i + 5]) for i in range(len(own) - 4)) if len(own) >= 5 else frozenset([tuple(own)] if own else [])

    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets.items())


def near_copies(seed, groups=6, copies=14):
    r = random.Random(seed)
    texts = []
    for _ in range(groups):
        base = [f"w{r.randint(0, 300)}" for _ in range(r.choice([3, 5, 12, 60, 120]))]
        for _ in range(copies):
            own = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                own[r.randrange(len(own))] = f"e{r.randint(0, 10_000)}"
            if r.random() < 0.2:
                own = own[: int(len(own) * 0.85)]
            texts.append(" ".join(own))
    line = " ".join(f"common{i}" for i in range(12))
    texts += [f"{line} {' '.join(f'u{r.randint(0, 9999)}' for _ in range(r.randint(0, 6)))}" for _ in range(30)]
    return texts + [None, "", "solo", "SOLO", "a b c d e", "A B C D E"]


@pytest.mark.parametrize("seed, frequent, block", [(1, 64, 256), (2, 4, 256), (3, 3, 5)])
def test_components_are_exact(spark, monkeypatch, seed, frequent, block):
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard_join, "LIST_BLOCK", block)
    rows = [(3 * i + 1, t) for i, t in enumerate(near_copies(seed))]
    random.Random(seed).shuffle(rows)
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute_components(rows)


def test_prefixes_and_overlaps():
    for n in range(1, 60):
        for m in range(1, 60):
            least = next(x for x in range(max(n, m) * 2 + 2) if 100 * x >= 80 * (n + m - x))
            assert jaccard_join.overlap_needed(n, m) == least
        assert jaccard_join.prefix_length(n) == n - math.ceil(0.8 * n - 1e-9) + 1


def test_keep_one(spark, odd, none):
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, None, 4, 4, 5])
    rows = [(i, t) for i, t in enumerate(near_copies(4))]
    want = {c for _, _, c in brute_components(rows)}
    got = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in got.collect()} == want
    assert jaccard_join.keep_one(none).count() == 0
    assert jaccard_join.jaccard_components(odd).filter("doc_id IS NULL AND component_id IS NULL AND n_shingles = 3").count() == 1


# operator 8


def quality_case(seed, n=600):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good = r.random() < 0.7
        text = invented(r.random(), 1, 200, 20, 60)[0]
        if not good:
            text = re.sub(" ", r.choice(["!! ", "&&& ", "*** "]), text).upper()
        toxic = r.random() < 0.15
        if toxic:
            text += " vileword horridword"
        docs.append((i, text, "en" if r.random() < 0.5 else "de", "s1" if good == (r.random() < 0.9) else "s2", len(text)))
        if i % 2 == 0:
            labels.append((i, int(good), int(toxic)))
    return docs, labels


def test_co_training_beats_chance_on_unlabelled_rows(spark, odd, none):
    docs, labels = quality_case(5)
    truth = {i: "!!" not in t and "&&&" not in t and "***" not in t and "vile" not in t for i, t, *_ in docs}
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    table = spark.createDataFrame(labels + [(7, None, None), (None, 1, 0), (900, 0, 0)], "doc_id long, quality int, toxic int")
    model = co_training.train(df, table)
    got = co_training.score(df, model).collect()
    unseen = [r for r in got if r.doc_id % 2]
    assert np.mean([r.good == truth[r.doc_id] for r in unseen]) > 0.93
    assert all(0 <= x <= 1 for r in got for x in (r.text_score, r.metadata_score, r.score))
    assert co_training.score(odd, model).count() == odd.count()
    kept = co_training.keep_good(odd, table)
    assert kept.columns == odd.columns
    assert co_training.keep_good(none, table).count() == 0


def test_views_exchange_labels():
    r = np.random.default_rng(0)
    n = 900
    y = r.integers(0, 2, n)
    shares = (y + r.normal(0, 0.1, n))[:, None].repeat(2, axis=1)
    meta = np.stack([y, y, r.normal(size=n)], axis=1).astype(float)
    label = np.where(np.arange(n) < 400, y, -1)
    held = np.arange(n) % 4 == 0
    nothing = np.zeros(0, np.uint64), (np.zeros(0, int), np.zeros(0, np.uint64))
    one = co_training.fit(shares, meta, label, held, *nothing, rounds=0)
    more = co_training.fit(shares, meta, label, held, *nothing, rounds=3)
    right = lambda m: np.mean((m.meta.logit(m.meta_view(meta)) > 0) == (y == 1))
    assert right(more) >= right(one) and right(more) > 0.98
    assert np.abs(more.meta.weight).sum() != np.abs(one.meta.weight).sum()


def test_without_labels_all_stay(spark, odd):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert co_training.keep_good(odd, empty).count() == odd.count()


# operator 9


@pytest.mark.parametrize("bucket", [24 << 20, 3_000])
def test_shards(spark, odd, monkeypatch, bucket):
    monkeypatch.setattr(two_pass_shuffle, "BUCKET_BYTES", bucket)
    texts = invented(8, 400)
    docs = odd.select("doc_id", "text", "row").unionByName(
        spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)] + [(None, "same", "q")] * 200 + [(77, "hot", "q")] * 200, "doc_id long, text string, row string")
    )
    written = two_pass_shuffle.two_pass_shuffle(docs)
    got = two_pass_shuffle.shard_digest(written).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.slot, r.shard)) if r.doc_id is not None and r.doc_id < 400]
    assert order != sorted(order)


def test_fisher_yates_is_uniform_and_seeded(none):
    assert two_pass_shuffle.fisher_yates(50, 3).tolist() == two_pass_shuffle.fisher_yates(50, 3).tolist()
    counts = Counter(tuple(two_pass_shuffle.fisher_yates(3, s).tolist()) for s in range(1_200))
    assert len(counts) == 6 and max(counts.values()) < 260
    assert two_pass_shuffle.two_pass_shuffle(none).count() == 0


# operator 10


def brute_topk(rows, k):
    kept = [(i, [math.floor(float(np.float32(x)) * 64) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, (i, v) in enumerate(kept):
        if i is None or i % 20:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j is None, j or 0) for c, (j, w) in enumerate(kept) if c != q)
        out += [(i, n + 1, None if void else j, -s) for n, (s, void, j) in enumerate(scored[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block, seeds", [(4096, 4096), (4, 10)])
def test_topk(spark, monkeypatch, block, seeds):
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", block)
    monkeypatch.setattr(topk_search, "_SEED_ROWS", seeds)
    monkeypatch.setattr(topk_search, "_BLOCK", 16)
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in r.normal(0, 0.2 * (1 + i % 9), 8).astype(np.float32)]) for i in range(300)]
    rows += [(i, rows[5][1]) for i in range(300, 340)] + [(341, None), (342, [1.0, None]), (343, [float("nan")] * 8), (344, [float("inf")] * 8), (345, []), (346, [1.0, 2.0]), (None, [1.0] * 8), (360, [0.0] * 8)]
    rows += [(20, [0.5] * 8), (20, rows[20][1]), (380, []), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk_search.topk(df, F.col("vec_id") % 20 == 0, 20)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect()), key=repr) == brute_topk(rows, 20)
    assert topk_search.topk(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


# pipeline


def test_stages_keep_columns_and_take_effect(spark, odd, none):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "contamination", "pieces"]
    for table in (odd, none):
        docs = table
        for name, step in corpus_pipeline.STAGES[:-1]:
            docs = step(spark, docs, SF)
            assert docs.columns == odd.columns
        assert corpus_pipeline.pieces(spark, docs, SF).count() == docs.count()


def test_pipeline_against_its_parts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    first = {r.doc_id for r in corpus_pipeline.quality(spark, docs, SF).select("doc_id").collect()}
    components = brute_components([(i, texts[i]) for i in first])
    second = {i for i, n, c in components if i == c or n == 0}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    third = {i for i in second for n, h, _ in brute_hits([texts[i]], items) if not (h and 20 * h >= n)}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == third and all(r.round_trip for r in got)


# registered queries


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cursor = con.execute(oracles.ORACLES[name])
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(cursor.fetchall(), [c[0] for c in cursor.description])


def test_all_operators_are_registered():
    names = {q.split("_")[0] for q in entry.queries() if re.match(r"op\d+_", q)}
    assert names == {f"op{n}" for n in range(1, 11)} and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", ["op2_link_trust", "op4_license_scan", "op6_piece_codec", "op8_co_training"])
def test_queries_return_every_row(spark, name):
    table = "pages" if name == "op2_link_trust" else "documents"
    assert queries.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
