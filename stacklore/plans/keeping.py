"""Queries over sources, sinks, repair and the feed."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from stacklore.catalog import query
from stacklore.operators import ranking as r
from stacklore.operators import repair as rp
from stacklore.operators import reports
from stacklore.operators.similarity import alike
from stacklore.sources import readers, sinks
from stacklore.sources.views import CONTENT, ITEMS, LINKS, LOGS, content, items, links, logs, table, vectors


@query(f"WITH {CONTENT} SELECT id, page_number, chunk_index FROM content WHERE item_id = 'src4' ORDER BY page_number, chunk_index, id")
def src01_item_scan(spark, d):
    return readers.item_chunks(content(spark, d), "src4").select("id", "page_number", "chunk_index")


@query(f"WITH {LOGS} SELECT count(*) AS n, min(created_at) AS first_at, max(created_at) AS last_at, count(DISTINCT tenant) AS tenants FROM logs WHERE created_at >= TIMESTAMP '2024-01-29' AND created_at < TIMESTAMP '2024-01-30 12:00:00'")
def src06_daily_log_scan(spark, d):
    return readers.yesterday_on(logs(spark, d), "2024-01-30 12:00:00")[1]


@query("SELECT date_trunc('month', o_orderdate)::DATE AS partition_month, count(*) AS n FROM orders GROUP BY 1")
def snk01_month_partition(spark, d):
    return sinks.with_month(table(spark, d, "orders"), "o_orderdate").groupBy("partition_month").agg(F.count(F.lit(1)).alias("n"))


_UP = "SELECT p_partkey, p_name, p_retailprice * 2 AS p_retailprice FROM part WHERE p_size > 25 UNION ALL SELECT p_partkey + 1000000, p_name, p_retailprice FROM part WHERE p_size <= 5"


@query(f"WITH u AS ({_UP}) SELECT coalesce(u.p_partkey, p.p_partkey) AS id, CASE WHEN u.p_partkey IS NOT NULL THEN u.p_retailprice ELSE p.p_retailprice END AS price FROM part p FULL JOIN u ON u.p_partkey = p.p_partkey")
def snk04_upsert(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice", "p_size")
    new = p.where("p_size <= 5").withColumn("p_partkey", F.col("p_partkey") + 1000000)
    u = p.where("p_size > 25").withColumn("p_retailprice", F.col("p_retailprice") * 2).unionByName(new)
    return sinks.upsert(p, u, ["p_partkey"]).select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"))


@query("SELECT c_custkey AS id, CASE WHEN c_nationkey < 10 THEN n_name ELSE c_mktsegment END AS label FROM customer JOIN nation ON n_nationkey = c_nationkey")
def snk05_fill_blanks(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") < 10, "  ").otherwise(F.col("c_mktsegment")).alias("label"), "c_nationkey")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("label"))
    return sinks.fill_blanks(c, n, ["c_nationkey"], ["label"]).select("id", "label")


@query(f"WITH {CONTENT} SELECT item_id, count(*) AS n, min(id) AS least FROM content WHERE item_id NOT IN ('src1', 'src6') OR content_type = 'HIGHLIGHT' GROUP BY 1")
def snk06_replace_by_key(spark, d):
    c = content(spark, d).select("id", "tenant", "item_id", "content_type")
    new = c.where("item_id IN ('src1', 'src6') AND content_type = 'HIGHLIGHT'")
    return sinks.replace_by_key(c, new, ["item_id"]).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))


@query(f"WITH {LINKS}, g AS (SELECT doc_id FROM documents WHERE source = 'src2') SELECT 'documents' AS child, count(*) AS purged FROM g UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id IN (SELECT doc_id FROM g) UNION ALL SELECT 'links', count(*) FROM links WHERE content_id IN (SELECT doc_id FROM g)")
def snk07_cascade_purge(spark, d):
    docs = table(spark, d, "documents")
    tables = {"documents": (docs, "doc_id"), "labels": (table(spark, d, "labels"), "doc_id"), "links": (links(spark, d), "content_id")}
    return sinks.purge(tables, docs.where("source = 'src2'").select("doc_id"), "doc_id")[1]


@query("SELECT s_suppkey AS id, CASE WHEN s_nationkey < 12 THEN s_acctbal ELSE 0 END AS balance FROM supplier")
def snk08_snapshot_restore(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), "s_nationkey")
    snap = sinks.snapshot(s.where("s_nationkey < 12"), "id", "balance", "2024-01-01 00:00:00")
    return sinks.restore(s.withColumn("balance", F.lit(0.0)), snap, "id", "balance").select("id", "balance")


@query(f"WITH {LOGS} SELECT intent, count(*) AS n FROM logs WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL 15 DAY GROUP BY 1")
def snk09_retention(spark, d):
    return sinks.retain(logs(spark, d), "created_at", "2024-01-31 00:00:00", 15).groupBy("intent").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CONTENT}, p AS (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY chunk_index, id) - 1) // 200 AS part, min(title) OVER (PARTITION BY item_id) AS head FROM content)
SELECT item_id, p.part::BIGINT AS part, md5(CASE WHEN p.part = 0 THEN '# ' || any_value(head) || chr(10) ELSE '' END || string_agg('## ' || content_type || chr(10) || text, chr(10) ORDER BY chunk_index, id)) AS text FROM p GROUP BY item_id, p.part""")
def snk10_item_bundles(spark, d):
    return sinks.item_bundles(content(spark, d)).withColumn("text", F.md5("text"))


@query(None)
def dq01_near_duplicate_suppression(spark, d):
    """Each page of a hundred documents is the head of a query, in order of ids."""
    w = Window.partitionBy("query_id").orderBy("id")
    c = content(spark, d).select(F.col("page_number").alias("query_id"), "id", F.array_distinct(F.split(F.lower("text"), r"\s+")).alias("words"))
    return rp.suppress_similar(c.withColumn("rank", F.row_number().over(w)))


@query(r"""WITH s AS (SELECT doc_id AS id, list_sort(list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda w: w <> ''))) AS words FROM documents),
k AS (SELECT id, words, CASE WHEN len(words) > 0 THEN min(id) OVER (PARTITION BY words) ELSE id END AS twin FROM s), h AS (SELECT id, words, len(words) AS n FROM k WHERE id = twin AND len(words) > 0),
p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.words, b.words)) AS c, a.n + b.n AS m FROM h a JOIN h b ON a.id <> b.id AND a.n * 100 >= b.n * 92 AND b.n * 100 >= a.n * 92),
l AS (SELECT a, count(*) AS n_links, min(b) AS least FROM p WHERE c * 100 >= (m - c) * 92 GROUP BY 1)
SELECT id, twin, CASE WHEN least < twin THEN least END AS first, coalesce(n_links, 0) AS n_links FROM k LEFT JOIN l ON a = twin""")
def dq01_corpus_wide(spark, d):
    """Every pair of documents with 92 hundredths of their words in common, as links of each document."""
    return alike(content(spark, d).select("id", "text"))


@query("SELECT min(doc_id) AS id, count(*) AS copies FROM documents GROUP BY sha256(text)")
def dq02_exact_duplicates(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies")).drop("h")


@query("SELECT count(*) AS n, count_if(length(trim(text)) < 12) AS short, 0 AS mislabelled, 'ISSUES' AS status FROM documents")
def dq03_health_audit(spark, d):
    return rp.health(content(spark, d))


@query(f"WITH {CONTENT} SELECT id, CASE WHEN item_id = 'src3' THEN 'PERSONAL_NOTE' ELSE content_type END AS content_type FROM content WHERE length(trim(text)) >= 12")
def dq04_cleanup(spark, d):
    c = content(spark, d).withColumn("title", F.when(F.col("item_id") == "src3", F.lit("Diary - Self")).otherwise(F.col("title")))
    return rp.cleaned(c).select("id", "content_type")


@query(f"""WITH {ITEMS}, x AS (SELECT 'null_visibility' AS "check", count_if(search_visibility IS NULL) AS value FROM items UNION ALL SELECT 'short_text', count_if(length(trim(text)) < 12) FROM content UNION ALL SELECT 'bad_page', count_if(page_number < 1) FROM content)
SELECT "check", value, CASE WHEN value = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM x""")
def dq05_check_suite(spark, d):
    c = content(spark, d)
    return rp.check_suite({"null_visibility": (items(spark, d), F.col("search_visibility").isNull()), "short_text": (c, F.length(F.trim("text")) < 12), "bad_page": (c, F.col("page_number") < 1)})


@query(f"WITH {ITEMS} SELECT category AS value, count(*) AS n FROM items WHERE category IS NULL OR category NOT IN ('IDEAS') GROUP BY 1")
def dq06_allowed_values(spark, d):
    return rp.outside_domain(items(spark, d), "category", ("IDEAS",))


@query(f"WITH {ITEMS} SELECT tenant, item_id, min(title) AS title, string_split(min(title), ' - ')[-1] AS author FROM content WHERE item_id IN (SELECT item_id FROM items WHERE is_deleted = 1) GROUP BY ALL")
def dq07_orphan_repair(spark, d):
    return rp.missing_parents(content(spark, d), items(spark, d).where("is_deleted = 0"))


@query(f"WITH {ITEMS} SELECT c.id, coalesce(i.search_visibility, 'DEFAULT') AS visibility FROM content c LEFT JOIN items i USING (tenant, item_id)")
def dq08_visibility_inheritance(spark, d):
    return rp.inherited(content(spark, d), items(spark, d)).select("id", "visibility")


@query(f"WITH {ITEMS} SELECT item_id, count(*) AS n FROM content WHERE item_id NOT IN (SELECT item_id FROM items WHERE is_deleted = 0) GROUP BY 1")
def dq09_stale_items(spark, d):
    return rp.stale_items(content(spark, d), items(spark, d).where("is_deleted = 0").select("item_id").distinct(), "item_id")


@query(f"WITH {CONTENT} SELECT id FROM content WHERE content_type = 'PERSONAL_NOTE' ORDER BY created_at DESC, id DESC")
def dq10_note_leakage(spark, d):
    return rp.leaked_notes(content(spark, d)).select("id")


@query("SELECT c_custkey AS id, CASE WHEN n_regionkey = 1 THEN n_name ELSE c_mktsegment END AS label FROM customer JOIN nation ON n_nationkey = c_nationkey")
def dq11_enrichment_patch(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label"), "c_nationkey")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.when(F.col("n_regionkey") == 1, F.col("n_name")).otherwise(" ").alias("label"))
    return sinks.patch(c, n, ["c_nationkey"], ["label"]).select("id", "label")


@query("SELECT count(DISTINCT CASE WHEN length(trim(text)) >= 12 THEN source || sha256(text) END) AS accepted, count_if(length(trim(text)) < 12) AS rejected FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def dq12_sync_quarantine(spark, d):
    missing = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")
    ok = F.length(F.trim("text")) >= 12
    key = F.when(ok, F.sha2(F.concat("source", F.lit(":"), F.sha2("text", 256)), 256))
    return missing.agg(F.count_distinct(key).alias("accepted"), F.count_if(~ok).alias("rejected"))


@query(f"""WITH {LOGS}, s AS (SELECT tenant AS query_id, id, intent AS kind, row_number() OVER (PARTITION BY tenant ORDER BY ms DESC, id) AS nth FROM logs),
l AS (SELECT *, sum((nth > 5)::INT) OVER (PARTITION BY query_id, kind ORDER BY nth) AS own FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY nth) AS pos FROM l WHERE nth <= 5 OR own <= 2) SELECT query_id, id, pos FROM k WHERE pos <= 10""")
def win10_provider_cap(spark, d):
    w = Window.partitionBy("tenant").orderBy(F.desc("ms"), "id")
    s = logs(spark, d).select(F.col("tenant").alias("query_id"), "id", F.col("intent").alias("kind"), F.row_number().over(w).alias("rank"))
    return rp.provider_cap(s, 10)


@query(None)
def win05_type_cap(spark, d):
    w = Window.partitionBy("tenant").orderBy(F.desc("ms"), "id")
    s = logs(spark, d).select(F.col("tenant").alias("query_id"), "id", F.col("intent").alias("kind"), F.row_number().over(w).alias("rank"))
    return rp.type_cap(s, 10, 3)


@query(f"""WITH {CONTENT}, {LOGS}, seen AS (SELECT DISTINCT result_count AS id FROM logs WHERE intent = 'view'), n AS (SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[64], (SELECT embedding::DOUBLE[64] FROM embeddings ORDER BY vec_id LIMIT 1)), 6) AS score FROM embeddings),
s AS (SELECT c.id, -count(l.id)::DOUBLE AS score FROM content c LEFT JOIN logs l ON l.result_count = c.id GROUP BY 1), e AS (SELECT id, 0 AS src, score FROM n UNION ALL SELECT id, 1, score FROM s UNION ALL SELECT id, 2, -((id * 2654435761 + 40503) % 4294967296)::DOUBLE FROM content),
k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, id) AS rank FROM e WHERE id NOT IN (SELECT id FROM seen)), f AS (SELECT id, min((src, rank)) AS k FROM k WHERE rank <= CASE src WHEN 2 THEN 20 ELSE 5 END GROUP BY 1) SELECT id, k[1] AS src FROM f ORDER BY k, id LIMIT 20""")
def rec01_multi_seed(spark, d):
    """Seeds like the first vector, seeds seen least, and others in a repeatable order; none that was viewed."""
    from stacklore.operators import vectors as v

    c, e = content(spark, d), vectors(spark, d)
    near = v.similar(e.orderBy("id").limit(1), e).select("id", F.round("sim", 6).alias("score"))
    n = logs(spark, d).groupBy(F.col("result_count").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    rare = c.join(n, "id", "left").select("id", (-F.coalesce("n", F.lit(0))).cast("double").alias("score"))
    seen = logs(spark, d).where("intent = 'view'").select(F.col("result_count").alias("id"))
    return rp.multi_seed(near, rare, c.select("id", (-r.repeatable("id")).cast("double").alias("score")), seen, 5, 20).select("id", "src")


@query(f"""WITH {CONTENT}, {LOGS}, v AS (SELECT DISTINCT tenant, result_count AS id FROM logs WHERE intent = 'view'), l AS (SELECT DISTINCT tenant, result_count AS id FROM logs WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY),
p AS (SELECT c.vec_id AS id, max(round(list_cosine_similarity(q.embedding::DOUBLE[64], c.embedding::DOUBLE[64]), 6)) AS m FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0 GROUP BY 1),
f AS (SELECT c.tenant, c.id, CASE WHEN coalesce(m, 0) <= 0.8 THEN 1 ELSE greatest(0, 1 - (m - 0.8) / 0.2) END AS penalty, row_number() OVER (PARTITION BY tenant, sha256(text) ORDER BY c.id) AS copy FROM content c LEFT JOIN p USING (id) WHERE length(trim(text)) >= 60 AND NOT EXISTS (SELECT 1 FROM v WHERE v.tenant = c.tenant AND v.id = c.id)),
k AS (SELECT *, penalty < 0.3 OR EXISTS (SELECT 1 FROM l WHERE l.tenant = f.tenant AND l.id = f.id) AS relaxed FROM f WHERE copy = 1), n AS (SELECT tenant, count(*) AS n FROM k WHERE NOT relaxed GROUP BY 1), m AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY id) AS nth FROM k WHERE relaxed)
SELECT tenant, id, relaxed FROM k WHERE NOT relaxed UNION ALL SELECT m.tenant, id, relaxed FROM m LEFT JOIN n USING (tenant) WHERE nth + coalesce(n, 0) <= 20""")
def rec02_filter_chain(spark, d):
    """Each tenant's chunks but those viewed, seen in thirty days, repeated, or like the disliked vectors."""
    from stacklore.operators import vectors as v

    e = vectors(spark, d)
    worst = v.most_similar(e.where("id % 100 = 0"), e).select("id", v.dislike_penalty(F.col("sim")).alias("penalty"))
    seen = logs(spark, d).select("tenant", F.col("result_count").alias("id"), "intent", "created_at")
    lately = seen.where(F.col("created_at") >= F.expr("timestamp_ntz'2024-01-31 00:00:00' - INTERVAL 30 DAYS"))
    return rp.filter_chain(content(spark, d).select("tenant", "id", "text").join(worst, "id", "left"), seen.where("intent = 'view'"), lately)


@query(f"""WITH {LOGS}, s AS (SELECT id, tenant, ['syntopic', 'discovery', 'context'][id % 3 + 1] AS zone, round((CASE id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 ELSE 0.5 END::DOUBLE + 0.8::DOUBLE * least(ms / 5000, 1)) * 0.9::DOUBLE, 6) AS score FROM logs),
t AS (SELECT *, row_number() OVER (PARTITION BY tenant, zone ORDER BY score DESC, id) AS turn FROM s) SELECT tenant, id, row_number() OVER (PARTITION BY tenant ORDER BY turn, zone) AS pos FROM t""")
def rec03_zone_score(spark, d):
    zones = F.element_at(F.array(*map(F.lit, ("syntopic", "discovery", "context"))), (F.col("id") % 3 + 1).cast("int"))
    s = logs(spark, d).select("id", "tenant", zones.alias("zone"), F.least(F.col("ms") / 5000, F.lit(1.0)).alias("sim"), F.lit(0.9).alias("penalty"))
    return r.interleave(rp.zone_score(s, {"syntopic": 1.0, "discovery": 0.8, "context": 0.5}), "tenant", "zone", "score").select("tenant", "id", "pos")


@query(f"""WITH {CONTENT}, g AS (SELECT tenant, item_id, count(*) AS total, count_if(content_type = 'HIGHLIGHT') AS highlights, count_if(content_type = 'PERSONAL_NOTE') AS notes, max(created_at) AS last_at FROM content GROUP BY ALL)
SELECT tenant, 'continue' AS family, arg_max(item_id, (notes, highlights, item_id)) AS item_id FROM g GROUP BY 1 UNION ALL SELECT tenant, 'latest', arg_max(item_id, (last_at, item_id)) FROM g GROUP BY 1
UNION ALL SELECT tenant, 'dormant', arg_max(item_id, (total, item_id)) FROM g WHERE last_at < TIMESTAMP '2024-02-10' GROUP BY 1
UNION ALL SELECT tenant, 'theme', arg_max(lang, (n, lang)) FROM (SELECT tenant, lang, count(*) AS n FROM content WHERE lang IS NOT NULL GROUP BY ALL) GROUP BY 1""")
def rec05_activity_board(spark, d):
    c = content(spark, d)
    return rp.board(reports.item_signals(c), c.select("tenant", F.col("lang").alias("tag")), "2024-02-10 00:00:00")


@query(f"""WITH {LOGS}, p AS (SELECT id, tenant, intent AS family, round(ms * CASE intent WHEN 'click' THEN 1.5 WHEN 'view' THEN 0.5 ELSE 1 END::DOUBLE, 6) AS points FROM logs), n AS (SELECT *, row_number() OVER (PARTITION BY tenant, family ORDER BY points DESC, id) AS nth FROM p)
SELECT tenant, id, row_number() OVER (PARTITION BY tenant ORDER BY points DESC, id) AS pos, row_number() OVER (PARTITION BY tenant ORDER BY points DESC, id) = 1 AS featured FROM n WHERE nth <= 3""")
def rec06_board_layout(spark, d):
    cards = logs(spark, d).select("id", "tenant", F.col("intent").alias("family"), F.col("ms").alias("score"))
    return rp.laid_out(cards, {"click": 1.5, "view": 0.5}, 3).select("tenant", "id", "pos", "featured")


@query("""WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS nth FROM conversations), t AS (SELECT conv_id, substr(arg_min(text, turn), 1, 60) AS title FROM conversations WHERE role = 'user' GROUP BY 1)
SELECT m.conv_id, string_agg(role || ': ' || substr(text, 1, 40), chr(10) ORDER BY turn) AS context, any_value(title) AS title FROM m LEFT JOIN t USING (conv_id) WHERE nth <= 4 GROUP BY 1""")
def rec08_conversation_context(spark, d):
    return rp.recent_messages(table(spark, d, "conversations"), 4)


@query(f"WITH {CONTENT} SELECT item_id, max(created_at) AS last_at FROM content WHERE list_contains([lang, content_type], 'fr') GROUP BY 1 ORDER BY last_at DESC, item_id LIMIT 10")
def rec09_topic_search(spark, d):
    c = content(spark, d).withColumn("topics", F.to_json(F.array("lang", "content_type")))
    hit = c.where(F.array_contains(F.from_json("topics", "array<string>"), "fr"))
    return hit.groupBy("item_id").agg(F.max("created_at").alias("last_at")).orderBy(F.desc("last_at"), "item_id").limit(10)


@query(f"""WITH {ITEMS}, h AS (SELECT tenant, item_id, string_agg(id::VARCHAR, ',' ORDER BY id) AS highlights FROM content WHERE content_type = 'HIGHLIGHT' GROUP BY ALL)
SELECT tenant, item_id, item_type, highlights FROM items LEFT JOIN h USING (tenant, item_id) WHERE is_deleted = 0 ORDER BY tenant, item_id LIMIT 60""")
def rec10_library_listing(spark, d):
    h = content(spark, d).where("content_type = 'HIGHLIGHT'").groupBy("tenant", "item_id").agg(F.array_sort(F.collect_list("id")).alias("h"))
    rows = items(spark, d).where("is_deleted = 0").join(h, ["tenant", "item_id"], "left").orderBy("tenant", "item_id").limit(60)
    return rows.select("tenant", "item_id", "item_type", F.array_join(F.transform("h", lambda x: x.cast("string")), ",").alias("highlights"))
