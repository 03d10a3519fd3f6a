"""DuckDB SQL that gives the same rows as the queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(pattern: str, text: str = "text") -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '{pattern}')"


OP3 = rf"""
WITH i AS (SELECT item_id, {_words(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[k : k + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS k FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, {_words(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')} AS w FROM documents),
dw AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n, -1) + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw))),
hit AS (SELECT doc_id, k, n, item_id FROM dw JOIN iw USING (n, win)),
spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> {s}) & 31)::INT, 1)" for s in (15, 10, 5, 0))
OP5 = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) AS hex FROM pages),
g AS (SELECT hex, string_agg({_BASE32}, '' ORDER BY k) AS payload_digest
  FROM (SELECT hex, k, ('0x' || substr(hex, 1 + 5 * k::INT, 5))::BIGINT AS v FROM (SELECT DISTINCT hex FROM p), range(0, 8) r(k)) GROUP BY hex),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM p)
SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to, true AS intact FROM f JOIN g USING (hex)
"""

OP7 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_words(r'[^\x20\x09-\x0D]+')} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + least(5, len(w)) - 1], ' ') || '|' || least(5, len(w)) AS g
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n
  HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM w LEFT JOIN n USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""

OP10 = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id,
    list_resize(list_transform(embedding, lambda x: floor(x::DOUBLE * 64)), (SELECT max(len(embedding)) FROM embeddings), 0.0) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q, v c
  WHERE q.vec_id % 20 = 0 AND q.r <> c.r)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST)::INT AS rank FROM s)
WHERE rank <= 20
"""



def _field(value: str) -> str:
    return f"coalesce(octet_length(encode(({value})::VARCHAR)) || ':' || ({value})::VARCHAR, '-')"


_FIELDS = ", ".join(map(_field, ("doc_id", "source", "lang", "n_chars")))
_BITS = "[" + ", ".join(["0::UBIGINT"] * 8) + "]"
_CRC = f"""xor(4294967295::UBIGINT, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT),
  lambda a, b: list_reduce({_BITS}, lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END, xor(a, b)), 4294967295::UBIGINT))"""
_TAMPERED = f"CASE WHEN ({_CRC}) % 5 = 0 THEN translate(text, '{_UPPER}', '{_LOWER}') ELSE text END"


def _tree(name: str, leaves: str) -> str:
    """Levels of the trees of ``leaves(tree, idx, size, digest)``."""
    return f"""{name} AS (SELECT tree, 0 AS level, idx, size, digest FROM {leaves}
  UNION ALL SELECT tree, max(level) + 1, idx // 16, (max(size) + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM {name} WHERE size > 1 GROUP BY tree, idx // 16),
{name}_s AS (SELECT a.tree, a.level, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS low,
    coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS high
  FROM {name} a JOIN {name} b ON a.tree = b.tree AND a.level = b.level AND a.idx // 16 = b.idx // 16 WHERE a.size > 1 GROUP BY a.tree, a.level, a.idx)"""


OP12 = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || source, '-') AS tree, sha256(concat({_FIELDS}, {_field('text')})) AS leaf,
  sha256(concat({_FIELDS}, {_field(_TAMPERED)})) AS start FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS size, leaf AS digest FROM d),
{_tree("lower_t", "l")},
subroots AS (SELECT tree AS of, digest, '' AS tree, row_number() OVER (ORDER BY encode(tree)) - 1 AS idx, count(*) OVER () AS size FROM lower_t WHERE size = 1),
{_tree("upper_t", "subroots")},
c AS (SELECT doc_id, leaf, tree, idx AS place, 0 AS level, start AS fold, '' AS proof FROM l
  UNION ALL SELECT doc_id, leaf, c.tree, place // 16, c.level + 1, sha256(low || fold || high), proof || low || high
  FROM c JOIN lower_t_s s ON s.tree = c.tree AND s.level = c.level AND s.idx = c.place),
e AS (SELECT c.doc_id, c.leaf, r.digest AS subroot, r.idx AS place, 0 AS level, c.fold, c.proof
  FROM c JOIN lower_t t ON t.tree = c.tree AND t.level = c.level AND t.idx = c.place AND t.size = 1 JOIN subroots r ON r.of = c.tree
  UNION ALL SELECT doc_id, leaf, subroot, place // 16, e.level + 1, sha256(low || fold || high), proof || low || high
  FROM e JOIN upper_t_s s ON s.level = e.level AND s.idx = e.place)
SELECT doc_id, leaf, subroot, t.digest AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = t.digest AS verified
FROM e JOIN upper_t t ON t.level = e.level AND t.size = 1
"""

OP13 = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) r(k))),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM g GROUP BY lang, k, phrase HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS v FROM f WHERE k > 1),
cut AS (SELECT c.lang, c.phrase, c.k, c.a, j, h.f AS l, t.f AS r, n.n, (1000 * c.a * n.n) // (h.f * t.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c JOIN f h ON h.lang = c.lang AND h.phrase = array_to_string(c.v[1 : j], ' ')
  JOIN f t ON t.lang = c.lang AND t.phrase = array_to_string(c.v[j + 1 : c.k], ' ') JOIN n ON n.lang = c.lang),
low AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS nth FROM cut) WHERE nth = 1),
sub AS (SELECT lang, array_to_string(v[i : i + m - 1], ' ') AS phrase, max(a) AS a
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM c, range(2, 5) q(m) WHERE m < k) GROUP BY 1, 2),
kept AS (SELECT low.* FROM low LEFT JOIN sub ON sub.lang = low.lang AND sub.phrase = low.phrase WHERE sub.a IS NULL OR 100 * sub.a < 100 * low.a)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept) WHERE rank <= 2000
"""

ORACLES = {
    "op3_decontaminate": OP3,
    "op5_zip_archive": OP5,
    "op7_jaccard_join": OP7,
    "op10_topk_search": OP10,
    "op12_merkle_climb": OP12,
    "op13_toivonen": OP13,
}
