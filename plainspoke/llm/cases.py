"""Queries of the training-data operators and their SQL.

SQL can state what op2, op4 and op7 return: all pairs by cosine or by full shingle
sets with the closure of their links, digests with the largest id of each; and
what op12 and op13 return: trees level by level, and counts of phrases.
The others depend on models (1, 6, 8, 11), on tokenizers (5, 9), on stored bytes of a
format (10) or on a scanner of lines (3); tests hold them against brute force, an
exact round trip or held-out accuracy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, collocations, embedding_dedup, language_id, license_scan, merkle, minhash_dedup, ogg_media, packing, pii, quality, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (language_id.op1_language_id, embedding_dedup.op2_embedding_dedup, license_scan.op3_license_scan, minhash_dedup.op4_minhash_dedup, packing.op5_packing, quality.op6_quality, pii.op8_pii, warc.op7_warc, byte_bpe.op9_byte_bpe, ogg_media.op10_ogg_media, toxicity.op11_toxicity, merkle.op12_merkle, collocations.op13_collocations)
    return {f.__name__: f for f in own}


#: From links (a, b): the smallest node that each node reaches.
_CLOSURE = "ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links), reach AS (SELECT a, b FROM ways UNION SELECT r.a, x.b FROM reach r JOIN ways x ON r.b = x.a), comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a)"

_OP2 = f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id < q.vec_id AND len(p.e) = len(q.e) WHERE list_cosine_similarity(p.e, q.e) >= 0.95), {_CLOSURE}, n AS (SELECT a, count(*) AS n FROM ways GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(c, vec_id)) AS kept FROM embeddings LEFT JOIN comp ON comp.a = vec_id LEFT JOIN n ON n.a = vec_id"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_OP4 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(range(1, CASE WHEN len(w) = 0 THEN 1 ELSE greatest(len(w) - 4, 1) + 1 END), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w),
f AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
links AS (SELECT p.doc_id AS a, q.doc_id AS b FROM f p JOIN f q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY p.doc_id, q.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))), {_CLOSURE}
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(c, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(c, doc_id)) AS kept FROM s LEFT JOIN comp ON comp.a = doc_id"""

_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Twenty bits of a hexadecimal digest are four characters in base 32.
_FOUR = " || ".join(f"substr('{_B32}', CAST((CAST('0x' || substr(h, 5 * i + 1, 5) AS BIGINT) // {32**k}) % 32 AS INTEGER) + 1, 1)" for k in (3, 2, 1, 0))
_OP7 = f"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages), g AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS head FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(8), lambda i: {_FOUR}), '') AS payload_digest, CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> head THEN head END AS refers_to FROM g"""



def _framed(value: str) -> str:
    return f"coalesce(CAST(octet_length(encode(CAST({value} AS VARCHAR))) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(map(_framed, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


#: crc32 of a decimal number: each byte goes in with the first of eight steps.
_CRC = "xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))), lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))))"


def _up(name: str, start: str) -> str:
    return f"{name} AS ({start} UNION ALL SELECT t, lev + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value((c + 1) // 2) FROM {name} WHERE c > 1 GROUP BY t, lev, i // 2)"


def _sides(nodes: str, tree: str, place: str) -> str:
    """For each ancestor below the root of the node at ``place`` of ``tree``: its level and the siblings before and after."""
    return f"JOIN {nodes} u ON u.t = {tree} AND u.c > 1 AND u.i = ({place} >> u.lev) LEFT JOIN {nodes} s ON s.t = u.t AND s.lev = u.lev AND s.i = xor(u.i, 1)"


_SIDE = "CASE WHEN u.i % 2 = 1 THEN s.h || ':' ELSE ':' || coalesce(s.h, '') END AS side"
_OP12 = f"""WITH RECURSIVE d AS (SELECT doc_id, lang, {_leaf("n_chars")} AS leaf, {_leaf(f"(n_chars + CASE WHEN {_CRC} % 7 = 0 THEN 1 ELSE 0 END)")} AS given FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS t, row_number() OVER () AS id FROM d),
{_up("low", "SELECT t, 0 AS lev, i, leaf AS h, n AS c FROM r")}, subroots AS (SELECT t, h FROM low WHERE c = 1), {_up("top", "SELECT 0 AS t, 0 AS lev, t AS i, h, count(*) OVER () AS c FROM subroots")},
sides AS (SELECT r.id, u.lev, {_SIDE} FROM r {_sides("low", "r.t", "r.i")} UNION ALL SELECT r.id, 1000 + u.lev, {_SIDE} FROM r {_sides("top", "0", "r.t")}),
paths AS (SELECT id, list(side ORDER BY lev) AS p FROM sides GROUP BY id),
f AS (SELECT doc_id, leaf, w.h AS subroot, (SELECT h FROM top WHERE c = 1) AS root, sha256(replace(array_to_string(coalesce(p, []), ''), ':', '')) AS proof_sha256, list_reduce(list_concat([given], coalesce(p, [])), lambda g, s: sha256(split_part(s, ':', 1) || g || split_part(s, ':', 2))) AS folded_root FROM r JOIN subroots w ON w.t = r.t LEFT JOIN paths ON paths.id = r.id)
SELECT *, folded_root = root AS verified FROM f"""

_OP13 = f"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\\n\\x0B\\f\\r]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS w FROM pieces),
g AS (SELECT lang, k, unnest(list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) t(k)),
f AS (SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS a FROM g GROUP BY ALL), n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS p FROM f WHERE k > 1 AND a >= 10),
halves AS (SELECT lang, phrase, a, j, array_to_string(p[1:j], ' ') AS x, array_to_string(p[j + 1:], ' ') AS y FROM c JOIN (VALUES (1), (2)) j(j) ON j < k),
cuts AS (SELECT h.lang, h.phrase, h.a, j, x.a AS l, y.a AS r, 1000000 * h.a * h.a // (x.a * y.a) AS score FROM halves h JOIN f x ON x.lang = h.lang AND x.phrase = h.x JOIN f y ON y.lang = h.lang AND y.phrase = h.y),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
parts AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, a, unnest([array_to_string(p[1:2], ' '), array_to_string(p[2:3], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY lang, phrase),
stay AS (SELECT lowest.* FROM lowest LEFT JOIN parts USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * a),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM stay)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score FROM o JOIN n USING (lang) WHERE rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    return {"op2_embedding_dedup": _OP2, "op4_minhash_dedup": _OP4, "op7_warc": _OP7, "op12_merkle": _OP12, "op13_collocations": _OP13}
