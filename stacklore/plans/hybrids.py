"""Queries over the three lanes of hybrid search: the test set asks the documents and their vectors."""

from pyspark.sql import functions as F

from stacklore.catalog import query
from stacklore.operators import hybrid as h
from stacklore.operators import retrieval as rt
from stacklore.plans.texts import _NORM
from stacklore.sources.views import CONTENT, content, table, vectors

POOL = 50
#: Questions, documents, and the hits of each lane with their ranks; ``mode`` is the route of a question.
_HITS = rf"""WITH {CONTENT},
asked AS (SELECT item_id AS query_id, text, ['DIRECT', 'SYNTHESIS', 'OTHER'][item_id % 3 + 1] AS intent, {_NORM} AS norm,
  list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) >= 5)[1:5] AS lemmas FROM benchmark),
q AS (SELECT *, list_distinct(regexp_extract_all(norm, '[a-z0-9]+')) AS ws, list_distinct(lemmas) AS ls, len(string_split_regex(trim(text), '\s+')) AS n_words,
  CASE WHEN regexp_matches(text, '"[^"]+"') OR regexp_matches(norm, '\b(hangi sayfa|kitap adi|kim dedi)\b') THEN 'fast_exact' WHEN intent = 'DIRECT' THEN 'fast_exact' ELSE 'balanced' END AS mode FROM asked),
d AS (SELECT id, content_type, title, text, regexp_extract_all({_NORM}, '[a-z0-9]+') AS ws, regexp_extract_all(lower(title), '[a-z0-9]+') AS ts, lower(title) AS low,
  CASE content_type WHEN 'BOOK' THEN 1.0 WHEN 'HIGHLIGHT' THEN 3.0 WHEN 'INSIGHT' THEN 4.0 WHEN 'PERSONAL_NOTE' THEN 5.0 ELSE 7.0 END AS source FROM content),
lem AS (SELECT query_id, id, source, len(ls) AS n_lemmas, ls, low, list_sum(list_transform(ls, lambda x: len(list_filter(ws2, lambda w: starts_with(w, x))))) AS n,
  len(list_filter(ls, lambda x: len(list_filter(ts, lambda w: starts_with(w, x))) > 0)) > 0 AS titled FROM (SELECT q.query_id, q.ls, d.id, d.source, d.low, d.ts, d.ws AS ws2 FROM q, d)),
every AS (
  SELECT query_id, id, 'exact' AS lane, 100.0::DOUBLE AS score, source AS prio FROM q JOIN d ON len(q.ws) > 0 AND list_has_all(d.ws, q.ws)
  UNION ALL SELECT query_id, id, 'lemma', least(95, 70 + 5 * n + CASE WHEN titled THEN 4 ELSE 0 END)::DOUBLE, source FROM lem
  WHERE n > 0 AND NOT (n_lemmas = 1 AND n = 1 AND contains(low, ls[1]) AND NOT titled)
  UNION ALL SELECT a.vec_id, b.vec_id, 'semantic', greatest(0, round(list_cosine_similarity(a.embedding::DOUBLE[64], b.embedding::DOUBLE[64]), 6)) * 100, 0.0
  FROM embeddings a JOIN benchmark ON item_id = a.vec_id, embeddings b),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, lane ORDER BY prio, score DESC, id) AS rank FROM every) WHERE rank <= {POOL}),
worded AS (SELECT DISTINCT query_id FROM hits WHERE lane <> 'semantic'),
routed AS (SELECT hits.*, intent, n_words FROM hits JOIN q USING (query_id) WHERE lane <> 'semantic' OR mode <> 'fast_exact' OR query_id NOT IN (SELECT query_id FROM worded)),
fused AS (
  SELECT query_id, id, sum(CASE intent WHEN 'DIRECT' THEN CASE lane WHEN 'exact' THEN 0.55 WHEN 'lemma' THEN 0.30 ELSE 0.15 END WHEN 'SYNTHESIS' THEN CASE lane WHEN 'semantic' THEN 0.60 ELSE 0.20 END
    ELSE CASE lane WHEN 'exact' THEN 0.34 ELSE 0.33 END END::DOUBLE / (60 + rank)) AS rrf, min(lane) AS lane, max(score) AS score, any_value(n_words) AS n_words FROM routed GROUP BY ALL),
placed AS (
  SELECT f.*, d.content_type, d.title, d.text, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 9) DESC, f.lane, d.source, round(f.score, 6) DESC, f.id) AS pos FROM fused f JOIN d USING (id))"""

_TAIL = rf"""{_HITS},
t1 AS (SELECT *, lane = 'semantic' AS tail, length(trim(text)) AS n FROM placed),
t2 AS (SELECT * FROM t1 WHERE NOT tail OR n >= greatest(CASE WHEN content_type IN ('PERSONAL_NOTE', 'HIGHLIGHT', 'INSIGHT') THEN 15 ELSE 60 END, CASE WHEN regexp_matches(lower(trim(text)), '^(title|author):') THEN 220 ELSE 0 END)),
t3 AS (SELECT *, count(*) FILTER (NOT tail) OVER (PARTITION BY query_id) AS n_lexical, max(score) FILTER (tail) OVER (PARTITION BY query_id) AS top,
  list(content_type) FILTER (NOT tail) OVER (PARTITION BY query_id) AS types, row_number() OVER (PARTITION BY query_id, tail ORDER BY score DESC, pos) AS nth FROM t2),
t4 AS (SELECT *, score >= CASE WHEN top > 0 THEN greatest(2, top * 0.35::DOUBLE) ELSE 0 END AS ok FROM t3),
t5 AS (SELECT *, max(ok::INT) FILTER (tail) OVER (PARTITION BY query_id) AS any_ok FROM t4),
t6 AS (SELECT *, row_number() OVER (PARTITION BY query_id, tail ORDER BY NOT coalesce(list_contains(types, content_type), false), nth) AS place FROM t5 WHERE NOT tail OR ok OR (any_ok = 0 AND nth <= 6)),
t7 AS (SELECT * REPLACE (CASE WHEN tail THEN place ELSE pos END AS place) FROM t6),
t8 AS (SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY tail, place) AS pos) FROM t7
  WHERE NOT tail OR place <= CASE WHEN n_words = 1 THEN CASE WHEN n_lexical > 30 THEN 2 WHEN n_lexical >= 20 THEN 3 WHEN n_lexical >= 10 THEN 4 ELSE 5 END ELSE 6 END)"""


def _asked(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    intent = F.element_at(F.array(*map(F.lit, ("DIRECT", "SYNTHESIS", "OTHER"))), (F.col("query_id") % 3 + 1).cast("int"))
    lemmas = F.slice(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)")), lambda w: F.length(w) >= 5), 1, 5)
    return q.select("query_id", "text", intent.alias("intent"), lemmas.alias("lemmas")).join(vectors(spark, d).select(F.col("id").alias("query_id"), "vec"), "query_id", "left")


def _hits(spark, d):
    return h.routed(h.lanes(content(spark, d), vectors(spark, d), _asked(spark, d), POOL), _asked(spark, d), POOL)


@query(f"{_HITS} SELECT query_id, id, score, rank FROM hits WHERE lane = 'lemma'")
def ret02_lemma_search(spark, d):
    """The first hits of each question by words that begin with one of its lemmas."""
    nothing = _asked(spark, d).withColumn("vec", F.lit(None).cast("array<float>"))
    return h.lanes(content(spark, d), vectors(spark, d), nothing, POOL).where("lane = 'lemma'").select("query_id", "id", "score", "rank")


@query(f"{_HITS} SELECT query_id, pos, id, lane, round(score, 4) AS score, round(rrf, 8) AS rrf FROM placed WHERE pos <= 20")
def ret03_hybrid_search(spark, d):
    found = h.hybrid_search(content(spark, d), vectors(spark, d), _asked(spark, d), pool=POOL, limit=20)
    return found.select("query_id", "pos", "id", "lane", F.round("score", 4).alias("score"), F.round("rrf", 8).alias("rrf"))


@query(f"{_TAIL} SELECT query_id, pos, id, lane FROM t8 WHERE pos > 10 AND pos <= 70")
def ret03_second_page(spark, d):
    """Word hits first, then the capped tail, from the eleventh result on."""
    return h.hybrid_search(content(spark, d), vectors(spark, d), _asked(spark, d), pool=POOL, limit=60, offset=10, tail=6).select("query_id", "pos", "id", "lane")


@query(f"{_HITS} SELECT query_id, id, round(rrf, 8) AS rrf, lane FROM fused")
def ret05_rank_fusion(spark, d):
    return h.fused(_hits(spark, d)).select("query_id", "id", F.round("rrf", 8).alias("rrf"), "lane")


@query(f"{_HITS}, f AS (SELECT query_id, id, min(CASE lane WHEN 'exact' THEN 0 WHEN 'lemma' THEN 1 ELSE 2 END * 1000000 + rank) AS k FROM routed GROUP BY ALL) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY k) AS pos FROM f")
def ret06_priority_concatenation(spark, d):
    return rt.in_order(_hits(spark, d), h.LANES).select("query_id", "id", "pos")


@query(f"{_TAIL} SELECT query_id, pos, id, lane, tail FROM t8")
def ret07_lexical_head_semantic_tail(spark, d):
    """All word hits of the pool, and the semantic tail that quality, floor, types and cap leave."""
    c = content(spark, d)
    found = h.placed(h.fused(_hits(spark, d)), c)
    return h.with_tail(found, 6, True).select("query_id", "pos", "id", "lane", "tail")


@query(r"""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '"[^"]+"') THEN 'fast_exact' WHEN role = 'user' THEN 'fast_exact' ELSE 'balanced' END AS mode,
CASE WHEN regexp_matches(text, '"[^"]+"') OR role = 'user' THEN 'exact,lemma' ELSE 'exact,lemma,semantic' END AS lanes FROM conversations""")
def ret04_query_routing(spark, d):
    intent = F.when(F.col("role") == "user", "DIRECT").otherwise("SYNTHESIS")
    routed = table(spark, d, "conversations").select("conv_id", "turn", rt.route(F.col("text"), intent).alias("mode"))
    return routed.withColumn("lanes", F.concat_ws(",", rt.lanes_of(F.col("mode"))))
