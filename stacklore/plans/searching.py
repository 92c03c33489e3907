"""Queries over vectors, retrieval and the concept graph."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from stacklore.catalog import query
from stacklore.operators import graph as g
from stacklore.operators import retrieval as rt
from stacklore.operators import vectors as v
from stacklore.sources.views import CONTENT, LINKS, LOGS, RELATIONS, content, links, logs, relations, table, vectors

_PAIRS = """pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS id, c.label, list_cosine_similarity(q.embedding::DOUBLE[64], c.embedding::DOUBLE[64]) AS sim
FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0)"""


def _sides(spark, d):
    e = vectors(spark, d)
    return e.where("id % 100 = 0"), e


@query(f"WITH {_PAIRS} SELECT query_id, id, round(sim, 5) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 6) DESC, id) AS nth FROM pairs) WHERE nth <= 10")
def joi15_nearest_neighbours(spark, d):
    return v.closest(*_sides(spark, d), 10).select("query_id", "id", F.round("sim", 5).alias("sim"))


@query("SELECT a.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[64], b.embedding::DOUBLE[64]), 5) AS sim FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def mth01_cosine(spark, d):
    e = vectors(spark, d)
    b = e.select((F.col("id") - 1).alias("id"), F.col("vec").alias("w"))
    return e.join(b, "id").select("id", F.round(v.cosine(F.col("vec"), F.col("w")), 5).alias("sim"))


@query(f"""WITH {_PAIRS}, s AS (SELECT query_id, id, round(greatest(0, (1 - (1 - sim) / (0.5 + label / 10)) * 100), 4) AS score FROM pairs)
SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS nth FROM s) WHERE nth <= 10""")
def vec01_weighted_search(spark, d):
    q, e = _sides(spark, d)
    return v.closest(q, e.withColumn("weight", 0.5 + F.col("label") / 10), 10, "weight").select("query_id", "id", "score")


@query(f"""WITH {_PAIRS}, p AS (SELECT p.*, length(text) < 600 AS short FROM pairs p JOIN documents ON doc_id = id), a AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 6) DESC, id) AS nth FROM p),
b AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 6) DESC, id) AS nth FROM p WHERE short) SELECT query_id, id FROM a WHERE nth <= 10 UNION SELECT query_id, id FROM b WHERE nth <= 10""")
def vec02_intent_shaped_search(spark, d):
    q, e = _sides(spark, d)
    e = e.join(content(spark, d).select("id", (F.length("text") < 600).alias("short")), "id")
    return v.closest(q, e, 10).select("query_id", "id").union(v.closest(q, e.where("short"), 10).select("query_id", "id")).distinct()


@query(f"""WITH {_PAIRS}, s AS (SELECT query_id, id, label, round(sim * 100, 4) AS score FROM pairs), core AS (SELECT * FROM s WHERE label < 3 AND score > 20),
n AS (SELECT query_id, count(*) AS n FROM core GROUP BY 1), sp AS (SELECT s.query_id, id, score, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY s.query_id ORDER BY score DESC, id) AS nth FROM s LEFT JOIN n USING (query_id) WHERE label >= 3 AND score > 45)
SELECT query_id, id, score FROM core UNION ALL SELECT query_id, id, score FROM sp WHERE nth <= CASE WHEN n = 0 THEN 2147483647 WHEN n < 35 THEN greatest(4 - n // 10, 1) ELSE 0 END""")
def vec03_proportional_backfill(spark, d):
    q, e = _sides(spark, d)
    found = lambda rows, least: v.similar(q, rows, least / 100).select("query_id", "id", F.round(F.col("sim") * 100, 4).alias("score")).where(F.col("score") > least)
    return v.backfill(found(e.where("label < 3"), 20), found(e.where("label >= 3"), 45))


@query(f"WITH {_PAIRS} SELECT query_id, id, CASE WHEN round(sim, 6) >= 0.6 THEN 'syntopic' WHEN round(sim, 6) >= 0.45 THEN 'discovery' ELSE 'context' END AS zone FROM pairs WHERE round(sim, 6) >= 0.35")
def vec04_zone_search(spark, d):
    return v.similar(*_sides(spark, d), 0.35).select("query_id", "id", v.zone(F.round("sim", 6)).alias("zone")).where("zone IS NOT NULL")


@query("""WITH b AS (SELECT a.vec_id AS id, list_transform(range(1, 65), lambda i: 0.6::DOUBLE * a.embedding[i]::DOUBLE + 0.4::DOUBLE * b.embedding[i]::DOUBLE) AS x FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT id, round(x[1] / sqrt(list_sum(list_transform(x, lambda y: y * y))), 5) AS first FROM b""")
def vec05_target_blend(spark, d):
    e = vectors(spark, d).select("id", F.col("vec").cast("array<double>").alias("vec"))
    b = e.select((F.col("id") - 1).alias("id"), F.col("vec").alias("w"))
    return e.join(b, "id").select("id", F.round(v.blend(F.col("vec"), F.col("w"), 0.5)[0], 5).alias("first"))


@query("SELECT label, round(avg(embedding[1]::DOUBLE), 5) AS first, round(avg(embedding[64]::DOUBLE), 5) AS last FROM embeddings GROUP BY 1")
def vec06_centroids(spark, d):
    return v.centroids(vectors(spark, d), "label").select("label", F.round(F.col("centroid")[0], 5).alias("first"), F.round(F.col("centroid")[63], 5).alias("last"))


@query(f"""WITH {_PAIRS}, s AS (SELECT id, max(round(sim, 6)) AS m FROM pairs GROUP BY 1) SELECT id, round(CASE WHEN m <= 0.8 THEN 1 ELSE greatest(0, 1 - (m - 0.8) / 0.2) END, 4) AS penalty FROM s WHERE CASE WHEN m <= 0.8 THEN 1 ELSE greatest(0, 1 - (m - 0.8) / 0.2) END >= 0.3""")
def vec07_dislike_penalty(spark, d):
    s = v.most_similar(*_sides(spark, d)).withColumn("penalty", v.dislike_penalty(F.col("sim")))
    return s.where("penalty >= 0.3").select("id", F.round("penalty", 4).alias("penalty"))


@query("""WITH e AS (SELECT vec_id AS id, label, embedding::DOUBLE[64] AS v, embedding::DOUBLE[] AS l FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id DESC) AS nth FROM e),
m AS (SELECT label, list(x ORDER BY i)::DOUBLE[64] AS c FROM (SELECT label, i, avg(l[i]) AS x FROM e, range(1, 65) t(i) GROUP BY ALL) GROUP BY 1), b AS (SELECT e.id, max(round(list_cosine_similarity(e.v, r.v), 6)) AS best FROM e JOIN r USING (label) WHERE r.nth <= 50 AND e.id <> r.id GROUP BY 1)
SELECT id, round(list_cosine_similarity(v, c), 6) >= 0.2 AND coalesce(best, 0) > 0.35 AS near_duplicate FROM e JOIN m USING (label) LEFT JOIN b USING (id)""")
def vec08_semantic_near_duplicate(spark, d):
    """Each label as a session. The limits of the operator (0.80 and 0.85) are lower here: the vectors of a label lie farther apart."""
    return v.near_duplicates(vectors(spark, d), "label", 50, 0.2, 0.35)


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) AND length(trim(text)) > 0")
def vec09_missing_vectors(spark, d):
    from stacklore.functions.udfs import embed

    lacking = content(spark, d).join(vectors(spark, d), "id", "left_anti").where("length(trim(text)) > 0")
    return lacking.select("id", embed("text").alias("vec")).where("size(vec) = 64").select("id")


@query(f"""WITH {LINKS} SELECT concept_id, content_id, round(list_cosine_similarity(a.embedding::DOUBLE[64], b.embedding::DOUBLE[64]), 5) AS strength FROM links JOIN embeddings a ON a.vec_id = concept_id JOIN embeddings b ON b.vec_id = content_id""")
def vec10_link_strength(spark, d):
    e = vectors(spark, d)
    a = e.select(F.col("id").alias("concept_id"), F.col("vec").alias("x"))
    b = e.select(F.col("id").alias("content_id"), F.col("vec").alias("y"))
    return links(spark, d).join(a, "concept_id").join(b, "content_id").select("concept_id", "content_id", F.round(v.cosine(F.col("x"), F.col("y")), 5).alias("strength"))


_L = f"""WITH {CONTENT}, q AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: length(w) >= 7))) AS term FROM benchmark),
t AS (SELECT DISTINCT id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS term FROM content),
lx AS (SELECT query_id, id, count(*) AS score FROM q JOIN t USING (term) GROUP BY ALL), sm AS (SELECT query_id, id, least(score, 2) AS score FROM lx WHERE score >= 2)"""


def _lists(spark, d):
    """Documents by shared long words, and those with two or more, as two ranked lists."""
    split = lambda c: F.split(F.lower(c), "[^a-z]+")
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(F.filter(split("text"), lambda w: F.length(w) >= 7))).alias("term"))
    t = content(spark, d).select("id", F.explode(F.array_distinct(split("text"))).alias("term"))
    lx = t.join(rt.if_small(q), "term").groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("score"))
    return lx, lx.where("score >= 2").select("query_id", "id", F.least("score", F.lit(2)).alias("score"))


_CORE = "content_type IN ('BOOK', 'HIGHLIGHT', 'INSIGHT', 'PERSONAL_NOTE')"


@query(f"""WITH {CONTENT}, h AS (SELECT id, created_at FROM content WHERE {_CORE} AND regexp_matches(lower(text), '(^|[^a-z0-9])thing($|[^a-z0-9])') AND regexp_matches(lower(text), '(^|[^a-z0-9])the($|[^a-z0-9])'))
SELECT id, 100 AS score, row_number() OVER (ORDER BY created_at DESC, id DESC)::INT AS position FROM h""")
def ret01_exact_search(spark, d):
    """All words of a query as whole terms, newest first."""
    from stacklore.operators.filters import surface

    return rt.exact_search(surface(content(spark, d)), "thing the")


@query(f"""WITH {CONTENT}, h AS (SELECT id, created_at FROM content WHERE {_CORE} AND contains(lower(text), 'nstha')) SELECT id, 100 AS score, row_number() OVER (ORDER BY created_at DESC, id DESC)::INT AS position FROM h""")
def ret01_substring_path(spark, d):
    """A query that no chunk holds as a whole term."""
    from stacklore.operators.filters import surface

    return rt.exact_search(surface(content(spark, d)), "nstha")


@query(r"""WITH w AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM documents), l AS (SELECT id, len(ws) AS len FROM w), z AS (SELECT count(*) AS docs, avg(len) AS avg_len FROM l),
q AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM benchmark),
tf AS (SELECT term, id, count(*) AS tf FROM (SELECT id, unnest(ws) AS term FROM w) WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
SELECT query_id, id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))), 4) AS bm25 FROM q JOIN tf USING (term) JOIN df USING (term) JOIN l USING (id), z GROUP BY ALL""")
def ret08_bm25(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return rt.bm25(content(spark, d).select("id", "text"), q).select("query_id", "id", F.round("bm25", 4).alias("bm25"))


@query(_L + r""", w AS (SELECT id, list_filter(string_split_regex(lower(substr(text, 1, 2500) || ' ' || title), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM content), l AS (SELECT id, len(ws) AS len FROM w), z AS (SELECT count(*) AS docs, avg(len) AS avg_len FROM l),
q2 AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM benchmark),
tf AS (SELECT term, id, count(*) AS tf FROM (SELECT id, unnest(ws) AS term FROM w) WHERE term IN (SELECT term FROM q2) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
bm AS (SELECT query_id, id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))) AS bm25 FROM q2 JOIN tf USING (term) JOIN df USING (term) JOIN l USING (id), z GROUP BY ALL),
x AS (SELECT query_id, id, least(score, 5) / 5 AS base, coalesce(bm25, 0) AS b FROM lx LEFT JOIN bm USING (query_id, id)), y AS (SELECT *, min(b) OVER (PARTITION BY query_id) AS lo, max(b) OVER (PARTITION BY query_id) AS hi FROM x)
SELECT query_id, id, round(0.65::DOUBLE * base + 0.35::DOUBLE * CASE WHEN hi > lo THEN (b - lo) / (hi - lo) ELSE 0 END, 4) AS blend FROM y""")
def ret08_bm25_blend(spark, d):
    """Hits by shared long words, re-ranked with the BM25 of the head of their texts and their titles."""
    lx, _ = _lists(spark, d)
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    base = lx.select("query_id", "id", (F.least("score", F.lit(5)) / 5).alias("base"))
    return rt.reranked(base, content(spark, d), q).withColumn("blend", F.round("blend", 4))


@query(None)
def ret10_mmr(spark, d):
    lx, _ = _lists(spark, d)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    head = lx.withColumn("nth", F.row_number().over(w)).where("nth <= 20")
    terms = content(spark, d).select("id", F.array_distinct(F.split(F.lower("text"), "[^a-z]+")).alias("terms"))
    return rt.mmr(head.join(terms, "id"), 10)


_SAYS = lambda c: f"list_filter(regexp_extract_all(translate(lower({c}), 'ışçğüöâîû', 'iscguoaiu'), '[a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN ({', '.join(repr(w) for w in rt.STEP_BACK_STOP)}))"


@query(f"""WITH t AS (SELECT conv_id, turn, {_SAYS('text')} AS own, {_SAYS("role || ' ' || CASE WHEN turn % 2 = 0 THEN 'the Konu' ELSE 'x' END")} AS given, len(regexp_extract_all(translate(lower(text), 'ışçğüöâîû', 'iscguoaiu'), '[a-z0-9]+')) AS n FROM conversations),
w AS (SELECT conv_id, turn, n, unnest(CASE WHEN len(list_distinct(given)) >= 2 THEN given ELSE list_concat(given, own) END) AS word, generate_subscripts(CASE WHEN len(list_distinct(given)) >= 2 THEN given ELSE list_concat(given, own) END, 1) AS k FROM t),
d AS (SELECT conv_id, turn, n, word, min(k) AS k FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY k) AS nth FROM d)
SELECT conv_id, turn, string_agg(word, ' ' ORDER BY nth) AS wider FROM r WHERE nth <= 4 AND n >= 4 GROUP BY ALL HAVING count(*) >= 2""")
def ret14_step_back(spark, d):
    """Turns as questions whose role, and now and then two more words, are the keywords."""
    c = table(spark, d, "conversations")
    given = F.array("role", F.when(F.col("turn") % 2 == 0, "the Konu").otherwise("x"))
    return c.select("conv_id", "turn", rt.step_back(F.col("text"), given).alias("wider")).where("wider IS NOT NULL")


@query(f"""WITH {CONTENT}, f AS (SELECT *, lower(regexp_replace(text, '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')) AS t, ['exact_deaccented', 'lemma_fuzzy', 'semantic', 'other'][id % 4 + 1] AS kind FROM content),
b AS (SELECT *, least(5 * (contains(t, 'thing')::INT + contains(t, 'erth')::INT), 25) AS freq, CASE WHEN id % 6 = 0 THEN 20 WHEN lang = 'en' THEN 15 WHEN contains(lower(title), 'book 1') THEN 10 ELSE 0 END AS place FROM f),
s AS (SELECT *, freq + place + CASE WHEN id % 9 = 0 THEN 5 ELSE 0 END + 5 * contains(t, 'book 1')::INT AS boost FROM b)
SELECT id, boost, least(70 + id % 30 + boost, CASE kind WHEN 'lemma_fuzzy' THEN 100 WHEN 'semantic' THEN 85 ELSE 150 END)::DOUBLE AS score, CASE WHEN place >= 20 THEN 'insight_match' WHEN place >= 15 THEN 'tag_match' ELSE kind END AS shown,
contains(t, 'thing') OR contains(t, 'erth') OR contains(t, 'book 1') AS in_content FROM s""")
def ret18_location_boosts(spark, d):
    k = F.col("id")
    kind = F.element_at(F.array(*map(F.lit, ("exact_deaccented", "lemma_fuzzy", "semantic", "other"))), (k % 4 + 1).cast("int"))
    hits = content(spark, d).select(
        "id", "text", "title", kind.alias("kind"), (70 + k % 30).cast("double").alias("score"), F.when(k % 6 == 0, "a Thing!").alias("comment"),
        F.when(F.col("lang") == "en", "erth, x").alias("tags"), (k % 9 == 0).alias("corrected"),
    )
    return rt.boosted(hits, ["thing", "Erth", "ve", "book 1"]).select("id", "boost", "score", "shown", "in_content")


@query(f"WITH {LOGS}, k AS (SELECT tenant || '|' || lower(regexp_replace(query_text, '\\s+', ' ', 'g')) AS key, count(*) AS n FROM logs GROUP BY 1) SELECT count(*) AS distinct_keys, sum(n)::BIGINT AS searches, round(1 - count(*) / sum(n), 4) AS repeat_rate FROM k")
def ret21_repeated_queries(spark, d):
    return rt.repeated_queries(logs(spark, d))


@query(f"""WITH {LOGS}, a AS (SELECT id, tenant AS query_id, result_count AS score, row_number() OVER (PARTITION BY tenant ORDER BY created_at, id) AS pos FROM logs), b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rs FROM a)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rs <= 3 THEN rs ELSE 3 + pos END, pos) AS new_pos FROM b""")
def ret22_bounded_promotion(spark, d):
    w = Window.partitionBy("tenant").orderBy("created_at", "id")
    a = logs(spark, d).select("id", F.col("tenant").alias("query_id"), F.col("result_count").alias("score"), F.row_number().over(w).alias("pos"))
    return rt.promoted(a, "score", 3).select("query_id", "id", "new_pos")


@query(f"WITH {LOGS} SELECT intent, round(avg((a <> b)::INT), 4) AS changed FROM (SELECT tenant, intent, arg_max(id, (ms, id)) AS a, arg_max(id, (result_count, id)) AS b FROM logs GROUP BY ALL) GROUP BY 1")
def ret23_shadow_comparison(spark, d):
    top = logs(spark, d).groupBy("tenant", "intent").agg(F.max_by("id", F.struct("ms", "id")).alias("a"), F.max_by("id", F.struct("result_count", "id")).alias("b"))
    return top.groupBy("intent").agg(F.round(F.avg((F.col("a") != F.col("b")).cast("int")), 4).alias("changed"))


@query("SELECT lower(p_name) AS key, min(p_name) AS name, min(p_type) AS kind FROM part GROUP BY 1")
def gra01_concept_upsert(spark, d):
    p = table(spark, d, "part").select(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")")).alias("name"), F.col("p_type").alias("kind"))
    return g.upsert_concepts(p, p.withColumn("name", F.upper("name"))).select("key", "name", "kind")


@query(f"WITH {RELATIONS} SELECT src, dst, rel_type, weight + 1 AS weight FROM relations")
def gra02_relation_upsert(spark, d):
    r = relations(spark, d)
    return g.upsert_relations(r, r.withColumn("weight", F.col("weight") + 1))


_TW = "CASE WHEN contains(rel_type, 'IS_A') THEN 1.0 WHEN contains(rel_type, 'PART_OF') THEN 0.9 WHEN contains(rel_type, 'RELATED') THEN 0.7 ELSE 0.5 END::DOUBLE"
_TOUCH = "t AS (SELECT DISTINCT concept, CASE WHEN src = concept THEN dst ELSE src END AS other, rel_type, weight FROM relations, e WHERE src = concept OR dst = concept)"
_E = "e AS (SELECT s_suppkey::BIGINT AS concept FROM supplier WHERE s_nationkey = 3)"


def _entries(spark, d):
    return table(spark, d, "supplier").where("s_nationkey = 3").select(F.col("s_suppkey").cast("long").alias("concept"))


@query(f"WITH {RELATIONS}, {LINKS}, {_E}, {_TOUCH} SELECT concept, content_id, round(max(weight * {_TW} * strength), 6) AS score FROM t JOIN links ON concept_id = other WHERE weight * {_TW} >= 0.3 GROUP BY ALL")
def gra03_one_hop(spark, d):
    return g.one_hop(_entries(spark, d), relations(spark, d), links(spark, d), 0.3)


@query(f"WITH {RELATIONS}, {_E}, {_TOUCH} SELECT concept, other, rel_type, weight FROM t ORDER BY weight DESC, concept, other, rel_type LIMIT 15")
def gra04_bridge_listing(spark, d):
    return g.bridges(_entries(spark, d), relations(spark, d))


_CEN = "cen AS (SELECT o.id, n_in, n_out, round(n_in * n_out / (SELECT count(*) FROM relations), 6) AS centrality FROM (SELECT src AS id, count(*) AS n_out FROM relations GROUP BY 1) o JOIN (SELECT dst AS id, count(*) AS n_in FROM relations GROUP BY 1) i USING (id))"


@query(f"WITH {RELATIONS}, {_CEN} SELECT * FROM cen")
def gra05_centrality(spark, d):
    return g.centrality(relations(spark, d))


@query("""WITH r AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem) SELECT x.src AS a, y.src AS b, round(0.1::DOUBLE * count(DISTINCT x.dst), 4) AS score FROM r x JOIN r y ON x.dst = y.dst AND x.src < y.src GROUP BY ALL HAVING count(DISTINCT x.dst) >= 2""")
def gra06_concept_bridges(spark, d):
    from stacklore.operators.joins import common_neighbours

    r = relations(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return common_neighbours(r).select("a", "b", F.round(0.1 * F.col("shared"), 4).alias("score"))


@query(f"""WITH {RELATIONS}, k AS (SELECT lower(p_name) AS key, min(p_partkey) AS keep FROM part GROUP BY 1), m AS (SELECT p_partkey AS id, keep FROM part JOIN k ON key = lower(p_name))
SELECT coalesce(a.keep, src) AS src, dst, rel_type, max(weight) AS weight FROM relations LEFT JOIN m a ON a.id = src GROUP BY ALL""")
def gra07_merge_duplicates(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    r = relations(spark, d).withColumn("dst", -F.col("dst") - 1)  # suppliers are no parts
    return g.merge_duplicates(p, r)[1].withColumn("dst", -F.col("dst") - 1)


@query(f"WITH {RELATIONS}, {LINKS}, {_CEN} SELECT content_id, max(centrality) AS centrality FROM links JOIN cen ON id = concept_id WHERE centrality > 0.01 GROUP BY 1 ORDER BY centrality DESC, content_id LIMIT 40")
def gra08_central_chunks(spark, d):
    return g.central_chunks(relations(spark, d), links(spark, d), 0.01, 40)


@query(f"WITH {LINKS}, {LOGS}, s AS (SELECT DISTINCT tenant, result_count AS content_id FROM logs) SELECT tenant, concept_id FROM (SELECT DISTINCT tenant FROM s), (SELECT DISTINCT concept_id FROM links) EXCEPT SELECT tenant, concept_id FROM s JOIN links USING (content_id)")
def gra09_unseen_concepts(spark, d):
    seen = logs(spark, d).select("tenant", F.col("result_count").alias("content_id")).distinct()
    return g.unseen_concepts(links(spark, d), seen)


@query(f"WITH {RELATIONS} SELECT src, dst, round((weight + least(0.35, 0.08::DOUBLE * (contains(lower(p_name || ' ' || s_name), 'ring')::INT + contains(lower(p_name || ' ' || s_name), 'red')::INT))) * CASE WHEN src % 3 = 0 THEN 0.92 ELSE 1 END::DOUBLE, 6) AS score FROM relations JOIN part ON p_partkey = src JOIN supplier ON s_suppkey = dst WHERE score >= 0.45 ORDER BY score DESC, src, dst LIMIT 30")
def gra11_edge_candidates(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("src"), F.col("p_name").alias("src_label"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("dst"), F.col("s_name").alias("dst_label"))
    r = relations(spark, d).withColumn("provider", F.when(F.col("src") % 3 == 0, "orkg").otherwise("OPENALEX"))
    named = r.join(p, "src").join(s, "dst").select("src", "dst", "rel_type", "src_label", "dst_label")
    return g.edge_candidates(r, named, ["ring", "red"], 30).select("src", "dst", "score")


@query("SELECT user_id AS id FROM events GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR")
def gra12_stale_worklist(spark, d):
    last = table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("synced_at"))
    return g.stale(last, "2024-01-31 00:00:00", 24).select("id")


@query(f"WITH {LINKS} SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT content_id FROM links)")
def gra13_unlinked_chunks(spark, d):
    return g.unlinked(content(spark, d), links(spark, d)).select("id")
