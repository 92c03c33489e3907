"""Queries over fallbacks, expansion, re-ranking, anchors and provider payloads."""

from pyspark.sql import functions as F

from stacklore.catalog import query
from stacklore.operators import answering as an
from stacklore.operators import retrieval as rt
from stacklore.operators.spelling import typo_rescue
from stacklore.plans.searching import _L, _lists
from stacklore.plans.texts import VOCABULARY, closest, dictionary
from stacklore.sources.views import CONTENT, ITEMS, LINKS, LOGS, content, items, links, logs, table, vectors


@query(r"""WITH c AS (SELECT doc_id AS id, lower(text) AS text, ['BOOK', 'HIGHLIGHT', 'INSIGHT', 'PDF_CHUNK', 'PERSONAL_NOTE'][doc_id % 5 + 1] AS k, string_split(lower(text), ' ') AS words FROM documents)
SELECT id, round(100 * (0.48::DOUBLE * 0.5 + 0.24::DOUBLE * (list_contains(words, 'thing')::INT + list_contains(words, 'the')::INT) / 2 + 0.10::DOUBLE * (contains(text, 'thing')::INT + contains(text, 'the')::INT) / 2
+ CASE k WHEN 'BOOK' THEN 0.04 WHEN 'PDF_CHUNK' THEN 0 WHEN 'PERSONAL_NOTE' THEN 0.03 ELSE 0.05 END::DOUBLE + CASE WHEN length(text) < 40 THEN -0.10 ELSE least(0.06, length(text) / 7000) END::DOUBLE), 4) AS rerank FROM c""")
def ret09_heuristic_rerank(spark, d):
    c = content(spark, d).withColumn("text", F.lower("text")).withColumn("words", F.split("text", " "))
    return an.heuristic_rank(c.withColumn("base", F.lit(0.5)).withColumn("terms", F.array(F.lit("thing"), F.lit("the"), F.lit("the")))).select("id", "rerank")


_FEW = f"""{_L}, n AS (SELECT item_id AS query_id, (SELECT count(*) FROM sm WHERE sm.query_id = item_id) AS n FROM benchmark)
SELECT query_id, id, 0 AS turn FROM sm UNION ALL SELECT lx.query_id, lx.id, 1 FROM lx JOIN n USING (query_id) WHERE n < 3 AND NOT EXISTS (SELECT 1 FROM sm WHERE sm.query_id = lx.query_id AND sm.id = lx.id)"""


@query(_FEW)
def ret12_fallback(spark, d):
    lx, sm = _lists(spark, d)
    return an.when_few(sm, table(spark, d, "benchmark").select(F.col("item_id").alias("query_id")), lx, 3)


@query(f"""{_L}, n AS (SELECT item_id AS query_id, (SELECT count(*) FROM sm WHERE sm.query_id = item_id) AS n, list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) >= 7)[1:2] AS two FROM benchmark),
k AS (SELECT DISTINCT query_id, unnest(two) AS word FROM n WHERE n < 40), d AS (SELECT DISTINCT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents), h AS (SELECT DISTINCT query_id, id FROM k JOIN d USING (word))
SELECT query_id, id, 0 AS turn FROM sm UNION ALL SELECT query_id, id, 1 FROM h WHERE NOT EXISTS (SELECT 1 FROM sm WHERE sm.query_id = h.query_id AND sm.id = h.id)""")
def ret15_keyword_gap_fill(spark, d):
    """Queries with less than forty pooled hits are asked again by their first two long words."""
    _, sm = _lists(spark, d)
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return an.gap_filled(sm, q, lambda asked: rt.term_hits(docs, asked, "[a-z]+"), 40)


@query(r"""WITH q AS (SELECT item_id AS query_id, string_split_regex(trim(text), '\s+') AS w FROM benchmark), e AS (SELECT query_id, w, unnest(range(0, least(len(w), 3))) AS i FROM q WHERE len(w) >= 2)
SELECT query_id, i, array_to_string(list_concat(w[1:i], w[i + 2:]), ' ') AS text FROM e""")
def ret13_query_variations(spark, d):
    return an.variations(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


@query(f"""WITH {LOGS}, r AS (SELECT tenant AS query_id, intent AS item_id, id, row_number() OVER (PARTITION BY tenant, intent ORDER BY ms DESC, id) AS nth FROM logs) SELECT * FROM r WHERE nth <= CASE WHEN item_id IN ('view', 'click') THEN 6 ELSE 2 END""")
def ret16_compare_fan_out(spark, d):
    rows = logs(spark, d).select(F.col("tenant").alias("query_id"), F.col("intent").alias("item_id"), "id", F.col("ms").alias("score"), F.col("intent").isin("view", "click").alias("primary"))
    return an.compared(rows, 6)


@query(r"""WITH q AS (SELECT DISTINCT o_orderpriority AS query_id, unnest(string_split_regex(lower(o_orderpriority || ' small rinq widgt'), '[^\p{L}\p{N}]+')) AS asked FROM orders), w AS (SELECT p_partkey AS id, 3 AS weight, unnest(string_split_regex(lower(p_name), '[^\p{L}\p{N}]+')) AS word FROM part
UNION ALL SELECT p_partkey, 1, unnest(string_split_regex(lower(p_type), '[^\p{L}\p{N}]+')) FROM part),
h AS (SELECT query_id, id, asked, max(weight) AS w FROM q JOIN w ON true WHERE length(asked) >= 4 AND length(word) >= 4 AND levenshtein(asked, word) <= 1 GROUP BY ALL) SELECT query_id, id, sum(w)::BIGINT AS score FROM h GROUP BY ALL""")
def ret17_field_search(spark, d):
    q = table(spark, d, "orders").select(F.col("o_orderpriority").alias("query_id"), F.concat("o_orderpriority", F.lit(" small rinq widgt")).alias("text")).distinct()
    return an.field_search(table(spark, d, "part").withColumnRenamed("p_partkey", "id"), q, {"p_name": 3, "p_type": 1})


_ASKED = r"""q0 AS (SELECT item_id AS query_id, list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) >= 7)[1] AS w FROM benchmark), q AS (SELECT query_id, w[1:2] || w[4:] AS word FROM q0 WHERE w IS NOT NULL)"""
_TERMS = "t AS (SELECT DISTINCT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)"


@query(f"""WITH {VOCABULARY}, {_ASKED}, {_TERMS}, hits AS (SELECT query_id, id FROM q JOIN t USING (word)),
weak AS (SELECT query_id, word FROM q WHERE (SELECT count(*) FROM hits h WHERE h.query_id = q.query_id) <= 2 AND word NOT IN (SELECT word FROM v WHERE n >= 20)), {closest('weak')},
more AS (SELECT w.query_id, t.id, row_number() OVER (PARTITION BY w.query_id ORDER BY t.id) AS nth FROM weak w JOIN fixes f USING (word) JOIN t ON t.word = f.fix WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.query_id = w.query_id AND h.id = t.id))
SELECT query_id, id, false AS rescued FROM hits UNION ALL SELECT query_id, id, true FROM more WHERE nth <= 160""")
def ret11_typo_rescue(spark, d):
    """The first long word of each item without its third letter, searched for as it is and then corrected."""
    w = F.try_element_at(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)")), lambda x: F.length(x) >= 7), F.lit(1))
    q = table(spark, d, "benchmark").withColumn("w", w).where("w IS NOT NULL")
    q = q.select(F.col("item_id").alias("query_id"), F.concat(F.substring("w", 1, 2), F.expr("substr(w, 4)")).alias("text"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return typo_rescue(q, lambda asked: rt.term_hits(docs, asked, "[a-z]+"), dictionary(spark, d)[1])


@query(f"""WITH {LOGS} SELECT id, '{{"intent":"' || intent || '","status":"' || CASE WHEN intent = 'error' THEN 'failed' ELSE 'logged' END || '"}}' AS strategy FROM logs""")
def ret20_log_patch(spark, d):
    lg = logs(spark, d)
    return an.patched_logs(lg, lg.where("intent = 'error'").select("id", F.lit("failed").alias("status")))


@query("""WITH n AS (SELECT p_partkey AS id, lower(p_name) AS t, p_size > 20 AS leaf FROM part), q AS (SELECT r_regionkey AS query_id, CASE WHEN r_regionkey % 2 = 0 THEN 'red ring' ELSE 'small widget' END AS q FROM region),
s AS (SELECT query_id, id, round(len(list_intersect(list_distinct(string_split(t, ' ')), string_split(q, ' '))) / 2 + CASE WHEN contains(t, q) THEN 0.35 ELSE 0 END::DOUBLE - CASE WHEN leaf THEN 0 ELSE 0.05 END::DOUBLE, 4) AS score FROM n, q
WHERE len(list_intersect(string_split(t, ' '), string_split(q, ' '))) > 0) SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS nth FROM s) WHERE nth <= 8""")
def ret24_category_tree(spark, d):
    tree = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), (F.col("p_size") > 20).alias("leaf"))
    q = table(spark, d, "region").select(F.col("r_regionkey").alias("query_id"), F.when(F.col("r_regionkey") % 2 == 0, "red ring").otherwise("small widget").alias("text"))
    return an.tree_match(tree, q, 8)


def _titles(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, " (notes)").otherwise(" - PDF")).alias("title"))
    asked = F.element_at(F.array(*map(F.lit, ("all about the red widget", "small ring or large ring", "a blu gadgett", "widget red", "brass"))), (F.col("r_regionkey") + 1).cast("int"))
    return t, table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("query_id"), asked.alias("text"))


@query(r"""WITH t AS (SELECT p_partkey AS item_id, unnest([lower(p_name) || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ' ' END, lower(p_name)]) AS t FROM part), q AS (SELECT r_regionkey AS query_id, ['all about the red widget', 'small ring or large ring', 'a blu gadgett', 'widget red', 'brass'][r_regionkey + 1] AS q FROM region)
SELECT query_id::BIGINT AS query_id, item_id, max(CASE WHEN contains(q, trim(t)) THEN 100 ELSE 97 END)::BIGINT AS score FROM t, q WHERE contains(q, trim(t)) OR (len(list_filter(string_split(trim(t), ' '), lambda w: length(w) >= 3)) >= 2 AND list_has_all(string_split(q, ' '), list_filter(string_split(trim(t), ' '), lambda w: length(w) >= 3))) GROUP BY ALL""")
def joi11_fuzzy_titles(spark, d):
    """Titles that a question holds whole or by all their words."""
    from stacklore.operators.fuzzy import fuzzy_titles

    return fuzzy_titles(*_titles(spark, d), 97)


@query(None)
def joi11_partial_titles(spark, d):
    """Titles that a question means with letters wrong or missing, too."""
    from stacklore.operators.fuzzy import fuzzy_titles

    return fuzzy_titles(*_titles(spark, d), 70)


@query("SELECT c_custkey AS id, CASE WHEN c_nationkey < 8 THEN 'exact' WHEN c_nationkey < 16 THEN 'collection' ELSE 'topical' END AS kind, CASE WHEN c_nationkey < 8 THEN c_nationkey || ':' || c_custkey % 200 WHEN c_nationkey < 16 THEN 'muslim ' || c_custkey END AS ref FROM customer")
def mth02_reference_class(spark, d):
    n, k = F.col("c_nationkey"), F.col("c_custkey").cast("string")
    text = F.when(n < 8, F.concat(F.lit("see "), n.cast("string"), F.lit(" : "), (F.col("c_custkey") % 200).cast("string"))).when(n < 16, F.concat(F.lit("in Muslim "), k)).otherwise("on patience")
    kind, ref = an.reference_class(F.col("text"))
    return table(spark, d, "customer").withColumn("text", text).select(F.col("c_custkey").alias("id"), kind.alias("kind"), ref.alias("ref"))


@query(f"""WITH {CONTENT}, {LINKS}, {LOGS}, s AS (SELECT DISTINCT tenant, result_count AS content_id FROM logs),
fresh AS (SELECT DISTINCT c.tenant, concept_id FROM content c JOIN links l ON l.content_id = c.id WHERE strength >= 0.7 AND NOT EXISTS (SELECT 1 FROM s WHERE s.tenant = c.tenant AND s.content_id = c.id)),
touched AS (SELECT tenant, concept_id FROM s JOIN links USING (content_id)), gap AS (SELECT tenant, min(concept_id) AS concept_id FROM (SELECT * FROM fresh EXCEPT SELECT * FROM touched) GROUP BY 1),
dormant AS (SELECT tenant, min(title) AS title FROM (SELECT tenant, title FROM content EXCEPT SELECT s.tenant, c.title FROM s JOIN content c ON c.id = s.content_id) GROUP BY 1)
SELECT tenant, coalesce('concept:' || concept_id, 'title:' || title) AS pivot FROM (SELECT DISTINCT tenant FROM s) LEFT JOIN gap USING (tenant) LEFT JOIN dormant USING (tenant)""")
def rec04_discovery_pivot(spark, d):
    seen = logs(spark, d).select("tenant", F.col("result_count").alias("content_id")).distinct()
    return an.discovery_pivot(links(spark, d), content(spark, d).select("id", "tenant", "title"), seen, seen.select("tenant").distinct())


@query(f"""WITH {CONTENT}, {LOGS}, e AS (SELECT DISTINCT tenant, kind, ref, noted FROM (SELECT tenant, content_type AS kind, id AS ref, created_at AS noted FROM content WHERE content_type IN ('PERSONAL_NOTE', 'HIGHLIGHT')
UNION ALL SELECT tenant, 'search', id, created_at FROM logs)), r AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY noted DESC, kind, ref) AS nth FROM e)
SELECT tenant, count(*) AS n, max(noted) AS last_at, max(noted) < TIMESTAMP '2024-01-30' AS refresh, count(DISTINCT kind) FILTER (nth <= 20) AS recent_kinds FROM r GROUP BY 1""")
def rec07_evidence_profile(spark, d):
    """What is known of each tenant from its notes, highlights and searches, and whether the profile is due."""
    kept = content(spark, d).where("content_type IN ('PERSONAL_NOTE', 'HIGHLIGHT')").select("tenant", F.col("content_type").alias("kind"), F.col("id").alias("ref"), F.col("created_at").alias("at"))
    asked = logs(spark, d).select("tenant", F.lit("search").alias("kind"), F.col("id").alias("ref"), F.col("created_at").alias("at"))
    return an.evidence_profile(kept.unionByName(asked), "2024-01-30 00:00:00", 20)


@query(f"WITH {ITEMS} SELECT tenant, coalesce(CASE WHEN category <> 'PRIVATE' THEN category END, 'unfiled') AS folder, count(*) OVER (PARTITION BY tenant, coalesce(CASE WHEN category <> 'PRIVATE' THEN category END, 'unfiled')) AS n, item_id FROM items WHERE item_type = 'PERSONAL_NOTE'")
def rec11_folders(spark, d):
    gone = spark.createDataFrame([("PRIVATE",)], "category string").withColumn("gone", F.lit(True))
    notes = items(spark, d).where("item_type = 'PERSONAL_NOTE'").join(F.broadcast(gone), "category", "left").withColumn("folder", F.coalesce(F.when(F.col("gone").isNull(), F.col("category")), F.lit("unfiled")))
    n = notes.groupBy("tenant", "folder").agg(F.count(F.lit(1)).alias("n"))
    return notes.join(n, ["tenant", "folder"]).select("tenant", "folder", "n", "item_id")


@query(f"""WITH {CONTENT}, n AS (SELECT tenant, c.id, embedding, row_number() OVER (PARTITION BY tenant ORDER BY created_at DESC, id DESC) AS nth FROM content c JOIN embeddings ON vec_id = id)
SELECT tenant, round(avg(embedding[1]::DOUBLE), 5) AS first, round(avg(embedding[64]::DOUBLE), 5) AS last FROM n WHERE nth <= 10 GROUP BY 1 HAVING count(*) >= 3""")
def rec12_topic_anchor(spark, d):
    notes = content(spark, d).join(vectors(spark, d).select("id", "vec"), "id")
    return an.topic_anchor(notes).select("tenant", F.round(F.col("anchor")[0], 5).alias("first"), F.round(F.col("anchor")[63], 5).alias("last"))


@query(f"WITH {LOGS}, s AS (SELECT tenant, count(DISTINCT result_count) AS n FROM logs GROUP BY 1) SELECT tenant FROM s WHERE n >= 50")
def rec13_saturated_tenants(spark, d):
    cards = logs(spark, d).groupBy("tenant").agg(F.count_distinct("result_count").alias("n"))
    return logs(spark, d).select("tenant").distinct().join(cards.where("n < 50"), "tenant", "left_anti")


_ED = "e AS (SELECT 'book:' || lower(p_name) AS src, 'author:' || lower(p_brand) AS dst, 1.0::DOUBLE AS weight FROM part UNION ALL SELECT 'book:' || lower(p_name), 'topic:' || lower(p_type), 0.7::DOUBLE FROM part)"


@query(f"WITH {_ED} SELECT src, dst, max(weight) AS weight FROM e GROUP BY ALL")
def gra10_provider_payloads(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.to_json(F.struct(F.col("p_name").alias("title"), F.array("p_brand").alias("authors"), F.array("p_type").alias("topics"))).alias("json"))
    return an.normalised_payloads(p)[1]


@query(rf"""WITH {VOCABULARY}, c AS (SELECT u.conv_id * 100 + u.turn AS id, u.text || CASE WHEN u.conv_id % 2 = 0 THEN ' nedir' ELSE '' END AS question, a.text || CASE a.conv_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' Fakat bu durum; paradoks, sentez and context.' WHEN 2 THEN ' 1abc ;; demektir' ELSE u.text END AS answer, u.text AS chunk,
['DIRECT', 'COMPARATIVE', 'SYNTHESIS'][u.conv_id % 3 + 1] AS intent, ['EXPLORER', 'SYNTHESIS', 'QUOTE', 'HYBRID', 'PLAIN'][u.conv_id % 5 + 1] AS mode, ((u.conv_id * 7 + u.turn) % 21) / 20::DOUBLE AS similarity
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
w AS (SELECT id, unnest(list_filter(string_split_regex(answer, '\s+'), lambda x: x <> '')) AS w FROM c), f AS (SELECT id, count_if(regexp_full_match(w, '\p{{N}}+') OR length(w) < 3 OR lower(w) IN (SELECT word FROM v WHERE n >= 20)) / count(*) AS fluency FROM w GROUP BY 1),
x AS (SELECT *, lower(answer) AS la, string_split_regex(lower(answer), '[.!?]\s+') AS parts, regexp_matches(answer, '\d[a-z]{{2,}}')::INT + regexp_matches(answer, '[;:~]{{2,}}')::INT + regexp_matches(answer, '\bc;')::INT AS misread FROM c LEFT JOIN f USING (id)),
y AS (SELECT *, len(list_filter(parts, lambda s: length(s) >= 20 AND contains(lower(chunk), s))) / greatest(len(parts), 1) AS copied, {" + ".join(f"contains(la, '{w}')::INT" for w in an.CONNECTING)} AS links FROM x),
z AS (SELECT *, 0.8::DOUBLE * CASE WHEN copied > 0.8 THEN 0.3 WHEN copied > 0.4 THEN 0.6 ELSE 1 END::DOUBLE AS d0 FROM y)
SELECT id, round(least(1, CASE WHEN similarity >= 0.85 THEN 1 WHEN similarity >= 0.7 THEN 0.7 + (similarity - 0.7) * 2 ELSE similarity END::DOUBLE * CASE WHEN intent = 'DIRECT' AND contains(lower(question), 'nedir') AND NOT contains(la, 'tanım') AND NOT contains(la, 'demektir') THEN 0.8
WHEN intent = 'COMPARATIVE' AND NOT regexp_matches(la, 'fark|benzer|birincisi|oysa|diğer yandan') THEN 0.7 ELSE 1 END::DOUBLE), 4) AS relevance, round(CASE WHEN fluency IS NULL THEN 1 ELSE greatest(0, fluency - 0.3::DOUBLE * misread) END, 4) AS ocr,
round(CASE WHEN mode NOT IN ('EXPLORER', 'SYNTHESIS') THEN 1 ELSE least(1, CASE WHEN links >= 5 THEN d0 + 0.2 WHEN links < 3 AND mode = 'EXPLORER' THEN d0 * 0.7::DOUBLE ELSE d0 END) END, 4) AS depth, CASE WHEN mode IN ('QUOTE', 'HYBRID') THEN 0.4 ELSE 0.9 END::DOUBLE AS format FROM z""")
def eva07_answer_scores(spark, d):
    """Turns of users and assistants as questions and answers, some of which got marks of the rules."""
    c, k = table(spark, d, "conversations"), F.col("conv_id")
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    marked = F.when(k % 4 == 3, F.col("text")).otherwise(pick("", " Fakat bu durum; paradoks, sentez and context.", " 1abc ;; demektir", ""))
    pairs = c.where("role = 'user'").join(a, ["conv_id", "turn"]).select(
        (k * 100 + F.col("turn")).alias("id"), F.concat("text", F.when(k % 2 == 0, " nedir").otherwise("")).alias("question"), F.concat("answer", marked).alias("answer"), F.col("text").alias("chunk"),
        pick("DIRECT", "COMPARATIVE", "SYNTHESIS").alias("intent"), pick("EXPLORER", "SYNTHESIS", "QUOTE", "HYBRID", "PLAIN").alias("mode"), ((k * 7 + F.col("turn")) % 21 / 20).alias("similarity"),
    )
    return an.answer_scores(pairs, dictionary(spark, d)[1])


@query(f"WITH {LOGS}, s AS (SELECT tenant AS query_id, id, intent, lag(intent) OVER (PARTITION BY tenant ORDER BY created_at, id) AS before FROM logs) SELECT query_id, id FROM s WHERE before IS NULL OR before <> intent")
def win08_windowed_dedupe(spark, d):
    rows = logs(spark, d).select(F.col("tenant").alias("query_id"), "id", "created_at", F.col("intent").alias("key"))
    return an.without_repeats(rows, ["created_at", "id"], F.to_date("created_at"))


@query("""WITH t AS (SELECT doc_id AS id, source AS title, string_split(text, chr(10)) AS ls FROM documents), p AS (SELECT *, greatest(ceil((len(ls) - 1) / 3), 1)::INT AS n FROM t), e AS (SELECT *, unnest(range(0, n))::INT AS piece FROM p)
SELECT id, piece, md5(array_to_string(list_concat([title, ls[1]], ls[piece * 3 + 2 : piece * 3 + 4]), chr(10))) AS text FROM e""")
def doc06_table_chunks(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.split("text", "\n").alias("lines"))
    return an.table_chunks(t, 3).withColumn("text", F.md5("text"))


@query(None)
def doc12_ingestion_pipeline(spark, d):
    """Pages to chunks: markup to text, repair, boilerplate, quality gate; id, decision and reasons of each."""
    from stacklore.functions import text as t
    from stacklore.operators import documents as dc

    body = t.strip_boilerplate(t.ocr_repair(t.markup_to_text(F.col("html"))))
    chunks = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("title"), F.lit(20).alias("page_number"), body.alias("text"))
    judged = dc.integrity(dc.chunk_quality(chunks))
    return judged.select("id", F.when(F.col("skip"), "REJECT").otherwise(F.col("decision")).alias("decision"), F.array_join("flags", ",").alias("reasons"), t.content_hash(F.col("text")).alias("hash"))
