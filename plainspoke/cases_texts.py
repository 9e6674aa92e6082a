"""Queries of the further text jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cases import _PAIRS, _S, _TOKENS, _any, _count, _cp, _docs
from .operators import reports, tables, texts
from .plans import logical as L
from .registry import query

_GOAL = ["only", "there", "this", "nicht", "avec", "from", "with", "then", "de"]


@query(f"SELECT doc_id, CAST(found AS INTEGER) AS found, found * 1000 // 6 AS per_mille, found * 1000 // 6 < 150 AS narrow FROM (SELECT doc_id, {_count('t', [w for w in _GOAL if len(w) > 3 and w not in ('then', 'this')])} + {_count('t', ['then', 'this'])} AS found FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents))".replace("// 6", "// 8"))
def d56_scope_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.scope_ratio(_docs(spark, sf_dir), _GOAL)


_LEVELS = {"L0": ["only", "this"], "L1": ["from", "with", "then"], "L2": ["les", "des"], "L3": ["der", "die"]}


@query(f"SELECT doc_id, CASE WHEN greatest(a, b, c, d) = 0 THEN NULL WHEN a = greatest(a, b, c, d) THEN 'L0' WHEN b = greatest(a, b, c, d) THEN 'L1' WHEN c = greatest(a, b, c, d) THEN 'L2' ELSE 'L3' END AS level, CAST(greatest(a, b, c, d) AS INTEGER) AS hits FROM (SELECT doc_id, {', '.join(f'{_count(chr(116), own)} AS {n}' for n, own in zip('abcd', _LEVELS.values(), strict=True))} FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents))")
def d33_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.level(_docs(spark, sf_dir), _LEVELS)


@query(f"WITH b AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS t FROM conversations), k AS (SELECT *, {_TOKENS.format(t='t')} AS k, {_S.replace('coalesce(text, ' + chr(39) * 2 + ')', 't')} AS s FROM b) SELECT conv_id, turn, CAST(len(k) AS INTEGER) AS tokens, CAST((length(t) - length(replace(t, 'then', ''))) // 4 AS INTEGER) AS hedge, CAST((length(t) - length(replace(t, 'with', ''))) // 4 AS INTEGER) AS smooth, len(list_distinct(k)) * 1000 // greatest(len(k), 1) AS distinct_per_mille, len(list_filter(k, lambda x: length(x) > 6)) * 1000 // greatest(len(k), 1) AS long_per_mille, greatest(len(k), 1) // greatest(len(s), 1) AS mean_sentence FROM k")
def d45_exchange_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = L.turns(spark, sf_dir).select(F.struct("conv_id", "turn").alias("at"), "text")
    return texts.exchange_profile(own, ["then"], ["with"], id="at").select("at.*", "tokens", "hedge", "smooth", "distinct_per_mille", "long_per_mille", "mean_sentence")


@query(f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS at, s[i] AS question FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {_S} AS s FROM documents)) WHERE s[i] LIKE '%!'")
def d26_marked_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.explicit_questions(_docs(spark, sf_dir), mark="!")


@query(f"WITH s AS (SELECT conv_id, turn, unnest(range(len(s))) AS nth, unnest(s) AS s FROM (SELECT conv_id, turn, {_S} AS s FROM conversations WHERE role = 'assistant')), w AS (SELECT conv_id, turn, nth, list_distinct(list_filter(regexp_split_to_array(trim(lower(s)), '\\s+'), lambda x: length(x) > 3)) AS w FROM s) SELECT a.conv_id, a.turn, count(DISTINCT b.turn) AS streak FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn < a.turn AND len(list_intersect(a.w, b.w)) > 0.6 * greatest(len(a.w), len(b.w)) GROUP BY a.conv_id, a.turn")
def w17_entrenched_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.entrenched_claims(L.turns(spark, sf_dir))


@query("WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(length(text), 0) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(length(text), 0)) AS i FROM conversations), f AS (SELECT conv_id, turn, i, CAST(1 AS INTEGER) AS relay, CAST(n AS BIGINT) AS chars FROM t WHERE i = 1 UNION ALL SELECT t.conv_id, t.turn, t.i, CASE WHEN f.chars >= 3000 THEN f.relay + 1 ELSE f.relay END, CASE WHEN f.chars >= 3000 THEN 0 ELSE f.chars END + t.n FROM f JOIN t ON t.conv_id = f.conv_id AND t.i = f.i + 1) SELECT conv_id, turn, relay, chars FROM f")
def w8_relay_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.relay_numbers(L.turns(spark, sf_dir))


_CARD = "\\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\\b"


@query(f"SELECT doc_id, regexp_replace(coalesce(text, ''), '{_CARD}', '[CARD]', 'g') AS text_out, CAST(len(regexp_extract_all(coalesce(text, ''), '{_CARD}')) AS INTEGER) AS n FROM documents")
def x8_redacted_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.redacted_cards(_docs(spark, sf_dir))


@query("SELECT doc_id, array_to_string(w[1:50], ' ') AS text_out, least(len(w), 50) * 1000 // greatest(len(w), 1) AS kept_per_mille FROM (SELECT doc_id, list_filter(regexp_split_to_array(trim(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS w FROM documents)")
def x6_token_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.token_ceiling(_docs(spark, sf_dir), 50)


_KEY = "trim(regexp_replace(regexp_replace(lower(x), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT conv_id, turn, list_transform(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: {_KEY} <> ''), lambda x: substr(sha256({_KEY}), 1, 16)) AS pointers FROM conversations")
def x20_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.pointers(L.turns(spark, sf_dir))


@query(f"WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM conversations), k AS (SELECT *, {_KEY} AS key FROM l), d AS (SELECT key, arg_min(x, row(conv_id, turn, pos)) AS original FROM k WHERE key <> '' GROUP BY key) SELECT conv_id, turn, string_agg(original, chr(10) ORDER BY pos) AS text FROM k JOIN d USING (key) GROUP BY conv_id, turn")
def x20_reconstructed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.reconstructed(texts.pointers(L.turns(spark, sf_dir)), tables.sequence_dictionary(L.turns(spark, sf_dir)))


@query(_cp("SELECT id, entity FROM cp WHERE length(raw_text) >= 30 QUALIFY row_number() OVER (PARTITION BY entity, md5(substr(raw_text, 1, 500)) ORDER BY id) = 1"))
def x16_distinct_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.distinct_pages(L.company_pages(spark, sf_dir))


@query("SELECT doc_id, array_to_string(k, chr(10)) AS text_out, CAST(len(l) - len(k) AS INTEGER) AS dropped FROM (SELECT doc_id, l, list_filter(l, lambda x: NOT regexp_matches(lower(x), 'licensed|released under') AND trim(x) <> '') AS k FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))")
def x15_without_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.without_lines(_docs(spark, sf_dir), "licensed|released under")


@query(_PAIRS + ", f AS (SELECT *, coalesce(lag(longer) OVER (PARTITION BY conv_id ORDER BY i) * longer < 0, false) AS flip FROM m) SELECT conv_id, count(*) AS pairs, count(*) FILTER (WHERE flip) AS flips, CAST(sum(abs(longer)) AS BIGINT) AS distance FROM f GROUP BY conv_id")
def a27_thread_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.thread_summary(tables.pair_metrics(L.turns(spark, sf_dir)))


@query("SELECT n.doc_id FROM (SELECT doc_id, toxic AS v FROM labels) n LEFT JOIN (SELECT doc_id, quality AS v FROM labels WHERE quality = 1) o ON n.doc_id = o.doc_id WHERE o.doc_id IS NULL OR n.v IS DISTINCT FROM o.v")
def u7_requeued(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = L.table(spark, sf_dir, "labels")
    return texts.requeued(lab.where("quality = 1").select("doc_id", F.col("quality").alias("v")), lab.select("doc_id", F.col("toxic").alias("v")), "doc_id", "v")


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN '[\"a\",\"' || source || '\"]' ELSE '[\"' || source || '\"]' END AS items FROM documents")
def u14_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _docs(spark, sf_dir).select("doc_id", "source", F.when(F.col("lang") == "en", '["a"]').alias("items"))
    return texts.appended(own, "items", F.col("source")).select("doc_id", "items")


@query(f"SELECT doc_id, len(regexp_extract_all(text, '[|]')) >= 3 OR len(list_filter(regexp_split_to_array(trim(coalesce(text, '')), '\\s+'), lambda x: x <> '')) < 8 OR {_any('lower(text)', ['licensed', 'token'])} AS junk FROM documents")
def p12_junk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions import text as T

    junk = (F.regexp_count("text", F.lit("[|]")) >= 3) | (T.word_count(F.col("text")) < 8) | T.has_any(F.lower("text"), ["licensed", "token"])
    return _docs(spark, sf_dir).select("doc_id", junk.alias("junk"))


@query("SELECT item_id AS key, CAST(item_id % 4 AS INTEGER) AS topic FROM benchmark ORDER BY item_id % 4 DESC, item_id LIMIT 20")
def o3_multi_key_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = L.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), (F.col("item_id") % 4).cast("int").alias("topic"))
    return b.orderBy(F.desc("topic"), "key").limit(20)


@query("WITH l AS (SELECT DISTINCT role, unnest(string_split(text, chr(10))) AS line FROM conversations) SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT role) >= 2")
def o8_lines_of_both_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = L.turns(spark, sf_dir).select("role", F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    return lines.groupBy("line").agg(F.count_distinct("role").alias("n")).where("n >= 2").select("line")


