"""Queries over aggregates."""

from pyspark.sql import functions as F

from stacklore.catalog import query
from stacklore.operators import reports as rp
from stacklore.sources.views import CONTENT, ITEMS, LINKS, LOGS, content, items, links, logs, table, vectors

_Q = "round(quantile_cont(ms, 0.5), 4) AS p50, round(quantile_cont(ms, 0.95), 4) AS p95, round(quantile_cont(ms, 0.99), 4) AS p99"
_B = "count_if(ms < 200) AS under_200, count_if(ms >= 200 AND ms < 500) AS from_200, count_if(ms >= 500 AND ms < 1000) AS from_500, count_if(ms >= 1000 AND ms < 2000) AS from_1000, count_if(ms >= 2000) AS over_2000"


@query(f"WITH {CONTENT} SELECT content_type, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM content), 2) AS pct FROM content GROUP BY 1")
def agg01_share_by_type(spark, d):
    return rp.share_by(content(spark, d), "content_type")


@query(f"WITH {LOGS} SELECT intent, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM logs), 2) AS pct FROM logs GROUP BY 1")
def agg02_intent_distribution(spark, d):
    return rp.share_by(logs(spark, d), "intent")


@query(f"WITH {LOGS} SELECT intent, round(avg(ms), 4) AS avg_ms, {_Q}, round(avg(result_count), 4) AS avg_results FROM logs GROUP BY 1")
def agg03_latency_quantiles(spark, d):
    return rp.latency_quantiles(logs(spark, d), "intent")


@query(f"WITH {LOGS} SELECT intent, {_B} FROM logs GROUP BY 1")
def agg04_latency_bands(spark, d):
    return rp.latency_bands(logs(spark, d), "intent")


@query(f"""WITH {LOGS}, m AS (SELECT intent, count(*) AS n FROM logs GROUP BY 1), t AS (SELECT count(*) AS total, round(avg(ms), 4) AS avg_ms, {_Q},
  round(avg(result_count), 4) AS avg_results, {_B} FROM logs),
b AS (SELECT intent AS main_intent, round(n * 100.0 / (SELECT total FROM t), 2) AS main_pct FROM m ORDER BY n DESC, intent DESC LIMIT 1)
SELECT b.*, t.*, round(over_2000 * 100.0 / total, 2) AS slow_pct,
  concat_ws('; ', CASE WHEN over_2000 * 100.0 / total > 5 THEN 'many slow queries' END, CASE WHEN main_pct > 60 THEN 'one intent dominates' END) AS notes FROM b, t""")
def agg05_daily_usage_report(spark, d):
    return rp.daily_usage(logs(spark, d))


@query(f"WITH {LOGS} SELECT round(avg(ms), 4) AS avg_ms, max(ms) AS max_ms, count(*) AS n FROM logs")
def agg06_table_latency(spark, d):
    return logs(spark, d).agg(F.round(F.avg("ms"), 4).alias("avg_ms"), F.max("ms").alias("max_ms"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CONTENT} SELECT tenant, item_id, count(*) AS total, count_if(content_type = 'HIGHLIGHT') AS highlights, count_if(content_type = 'INSIGHT') AS insights,
count_if(content_type = 'PERSONAL_NOTE') AS notes, max(created_at) AS last_at, max(page_number) AS max_page FROM content GROUP BY ALL""")
def agg07_item_signals(spark, d):
    return rp.item_signals(content(spark, d))


@query(f"""WITH {CONTENT}, {LINKS}, m AS (SELECT c.item_id, e.vec_id IS NOT NULL AS v, c.id IN (SELECT content_id FROM links) AS g FROM content c LEFT JOIN embeddings e ON e.vec_id = c.id)
SELECT item_id, count(*) AS total, count_if(v) AS embedded, count_if(g) AS linked, round(count_if(v) / count(*), 4) AS vector_ratio, round(count_if(g) / count(*), 4) AS graph_ratio,
CASE WHEN count_if(v) > 0 AND count_if(g) > 0 THEN 'fully_ready' WHEN count_if(v) > 0 THEN 'vector_ready' WHEN count_if(g) > 0 THEN 'graph_ready' ELSE 'not_ready' END AS state FROM m GROUP BY 1""")
def agg08_index_coverage(spark, d):
    return rp.index_coverage(content(spark, d), vectors(spark, d), links(spark, d))


_OCC = "(length(lower(text)) - length(replace(lower(text), '{0}', ''))) // {1}"


@query(f"WITH {CONTENT} SELECT item_id, page_number, sum({_OCC.format('thing', 5)} + {_OCC.format('leau', 4)})::BIGINT AS n FROM content GROUP BY ALL HAVING n > 0")
def agg09_keyword_pages(spark, d):
    return rp.keyword_pages(content(spark, d), ["thing", "leau"])


@query(f"""WITH {CONTENT} SELECT item_id, (CASE WHEN sum({_OCC.format('zzzz', 4)}) > 0 THEN sum({_OCC.format('zzzz', 4)}) ELSE sum(len(regexp_extract_all(lower(text), 'th[ei]ng?'))) END)::BIGINT AS n
FROM content GROUP BY 1""")
def agg10_keyword_count_fallback(spark, d):
    return rp.keyword_count(content(spark, d), ["zzzz"], "th[ei]ng?")


@query(f"""WITH {CONTENT} SELECT item_id, sum({_OCC.format('thing', 5)})::BIGINT AS n FROM content GROUP BY 1
UNION ALL SELECT 'ALL_NOTES', sum({_OCC.format('thing', 5)})::BIGINT FROM content WHERE content_type IN ('HIGHLIGHT', 'INSIGHT', 'PERSONAL_NOTE')""")
def agg11_compare_items(spark, d):
    return rp.compare_items(content(spark, d), "thing", ("HIGHLIGHT", "INSIGHT", "PERSONAL_NOTE"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS word FROM documents) WHERE length(word) > 2 GROUP BY 1")
def agg12_vocabulary(spark, d):
    return rp.vocabulary(content(spark, d), r"([a-z0-9_]+)")


@query("""SELECT id, string_agg(w || ':' || n, ',' ORDER BY w) AS freq FROM (SELECT doc_id AS id, w, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '\\s+')) AS w FROM documents)
WHERE w <> '' GROUP BY ALL) GROUP BY 1""")
def agg13_lemma_frequency_map(spark, d):
    pairs = F.transform(F.map_entries("freq"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return rp.lemma_map(content(spark, d)).select("id", F.array_join(pairs, ",").alias("freq"))


@query(f"""WITH {CONTENT}, s AS (SELECT item_id, CASE WHEN length(text) > 3000 THEN 'A' WHEN length(text) > 1000 THEN 'B' ELSE 'C' END AS level FROM content)
SELECT item_id, count(*) AS total, count_if(level = 'A') AS n_a, count_if(level = 'B') AS n_b, count_if(level = 'C') AS n_c,
round(count_if(level = 'A') / count(*), 4) AS ratio_a, round(count_if(level = 'B') / count(*), 4) AS ratio_b, round(count_if(level = 'C') / count(*), 4) AS ratio_c FROM s GROUP BY 1""")
def agg14_level_distribution(spark, d):
    level = F.when(F.length("text") > 3000, "A").when(F.length("text") > 1000, "B").otherwise("C")
    return rp.level_distribution(content(spark, d).withColumn("level", level))


@query("""WITH g AS (SELECT p_name AS title, p_type AS author, count(DISTINCT p_partkey) AS n FROM part GROUP BY ALL HAVING n > 1) SELECT DISTINCT title, author, n, p_partkey::VARCHAR AS id FROM part JOIN g ON title = p_name AND author = p_type""")
def agg15_duplicate_groups(spark, d):
    p = table(spark, d, "part").select(F.col("p_name").alias("title"), F.col("p_type").alias("author"), F.col("p_partkey").cast("string").alias("id"))
    return rp.duplicate_groups(p, ["title", "author"], "id")


@query(f"WITH {CONTENT} SELECT item_id, count(DISTINCT tenant) AS tenants FROM content GROUP BY 1 HAVING tenants > 1")
def agg16_cross_tenant_collision(spark, d):
    return rp.collisions(content(spark, d), "item_id")


@query(f"""WITH {ITEMS}, n AS (SELECT tenant, item_id, count(*) AS chunks, min(created_at) AS a, max(created_at) AS b FROM content GROUP BY ALL)
SELECT i.tenant, count(*) AS items, count(DISTINCT title) AS titles, count(category) AS with_category, min(a) AS first_at, max(b) AS last_at, round(avg(chunks), 4) AS avg_chunks
FROM items i JOIN n USING (tenant, item_id) GROUP BY 1""")
def agg17_tenant_summary(spark, d):
    chunks = content(spark, d).groupBy("tenant", "item_id").agg(F.count(F.lit(1)).alias("chunks"), F.min("created_at").alias("a"), F.max("created_at").alias("b"))
    return items(spark, d).join(chunks, ["tenant", "item_id"]).groupBy("tenant").agg(
        F.count(F.lit(1)).alias("items"), F.count_distinct("title").alias("titles"), F.count("category").alias("with_category"),
        F.min("a").alias("first_at"), F.max("b").alias("last_at"), F.round(F.avg("chunks"), 4).alias("avg_chunks"),
    )


@query(f"""WITH {ITEMS}, s AS (SELECT (category IS NOT NULL)::INT + (search_visibility IS NOT NULL)::INT + (title IS NOT NULL)::INT AS score FROM items)
SELECT score, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM s), 2) AS pct FROM s GROUP BY 1""")
def agg18_metadata_completeness(spark, d):
    return rp.completeness(items(spark, d), ["category", "search_visibility", "title"])


@query(f"""WITH {ITEMS} SELECT i.tenant, i.item_id, declared_chunks, count(c.id) AS actual FROM items i LEFT JOIN content c ON c.tenant = i.tenant AND trim(c.title) = trim(i.title) GROUP BY ALL""")
def agg19_declared_vs_actual(spark, d):
    c = content(spark, d).select("tenant", F.trim("title").alias("t"), "id")
    return items(spark, d).withColumn("t", F.trim("title")).join(c, ["tenant", "t"], "left").groupBy("tenant", "item_id", "declared_chunks").agg(F.count("id").alias("actual"))


@query(f"""WITH {CONTENT} SELECT tenant, sum(length(text)) FILTER (content_type <> 'BOOK')::BIGINT AS bytes,
CASE WHEN bytes > 200000 THEN 'over' WHEN bytes > 150000 THEN 'near' ELSE 'ok' END AS quota FROM content GROUP BY 1""")
def agg20_storage_quota(spark, d):
    used = content(spark, d).where("content_type <> 'BOOK'").groupBy("tenant").agg(F.sum(F.length("text")).alias("bytes"))
    return used.withColumn("quota", F.when(F.col("bytes") > 200000, "over").when(F.col("bytes") > 150000, "near").otherwise("ok"))


@query(f"""WITH {CONTENT} SELECT item_id, count(*) AS chunks, round(avg(ceil(len(string_split(text, ' ')) * 1.3)), 4) AS avg_tokens,
round(avg((length(text) < 120)::INT), 4) AS blank_ratio FROM content GROUP BY 1""")
def agg21_text_metrics(spark, d):
    tokens = F.ceil(F.size(F.split("text", " ")) * 1.3)
    return content(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("chunks"), F.round(F.avg(tokens), 4).alias("avg_tokens"), F.round(F.avg((F.length("text") < 120).cast("int")), 4).alias("blank_ratio"))


@query(f"""WITH t AS (SELECT doc_id AS id, unnest(string_split(lang || ',' || upper(lang) || ',' || source, ',')) AS label, generate_subscripts(string_split(lang || ',' || upper(lang) || ',' || source, ','), 1) AS pos FROM documents)
SELECT lower(label) AS tag, count(*) AS n, arg_min(label, id * 10 + pos) AS display FROM t WHERE lower(label) <> 'fr' GROUP BY 1 ORDER BY n DESC, tag LIMIT 10""")
def agg23_top_tags(spark, d):
    tagged = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array("lang", F.upper("lang"), "source").alias("tags"))
    return rp.top_terms(tagged, "tags", ("fr",))


@query(f"""WITH {CONTENT} SELECT word, count(DISTINCT item_id) AS items FROM (SELECT item_id, unnest(list_distinct(string_split(lower(text), ' '))) AS word FROM content) GROUP BY 1 HAVING items >= 5""")
def agg24_recurring_terms(spark, d):
    return rp.recurring_terms(content(spark, d).withColumn("words", F.split(F.lower("text"), " ")), "words", 5)


@query(f"WITH {LOGS} SELECT strftime(created_at, '%Y-%m-%d') AS day, intent, count(*) AS n FROM logs WHERE created_at >= TIMESTAMP '2024-01-17' GROUP BY ALL")
def agg25_daily_activity(spark, d):
    recent = logs(spark, d).where("created_at >= timestamp_ntz'2024-01-17 00:00:00'")
    return recent.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day"), "intent").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CONTENT} SELECT tenant, item_id, arg_max(title, id) AS title, min(created_at) AS first_at, max(created_at) AS last_at,
CASE WHEN bool_or(content_type = 'PDF_CHUNK') THEN 'BOOK' WHEN bool_or(content_type = 'PERSONAL_NOTE') THEN 'PERSONAL_NOTE' ELSE 'BOOK' END AS item_type FROM content GROUP BY ALL""")
def agg26_representative_row(spark, d):
    return rp.newest_title(content(spark, d))


@query(f"WITH {CONTENT} SELECT page_number AS query_id, count(DISTINCT lower(title)) AS titles, count(DISTINCT content_type) AS types, count_if(length(text) > 1000) AS long_texts FROM content GROUP BY 1")
def agg27_source_diversity(spark, d):
    return content(spark, d).groupBy(F.col("page_number").alias("query_id")).agg(
        F.count_distinct(F.lower("title")).alias("titles"), F.count_distinct("content_type").alias("types"), F.count_if(F.length("text") > 1000).alias("long_texts")
    )


def _histogram_sql(share):
    """The linear place of a quantile in the counts c0.. of the bounds, as SQL."""
    arms = ""
    for i, bound in enumerate(rp.BOUNDS):
        low, before = (rp.BOUNDS[i - 1], f"c{i - 1}") if i else (0.0, "0")
        arms += f" WHEN c{i} >= {share} * n THEN CASE WHEN c{i} > {before} THEN {low}::DOUBLE + {bound - low}::DOUBLE * ({share}::DOUBLE * n - {before}) / (c{i} - {before}) ELSE {low} END"
    return f"CASE{arms} ELSE {rp.BOUNDS[-1]} END"


@query(f"""WITH {LOGS}, v AS (SELECT *, date_trunc('hour', created_at) AS hour, ['PASS', 'REGENERATE', 'DECLINE'][result_count % 3 + 1] AS verdict FROM logs),
h AS (SELECT hour, intent, count(*) AS n, round(avg((ms > 1000)::INT), 4) AS slow_ratio, round(avg((verdict = 'DECLINE')::INT), 4) AS error_ratio, round(count(*) / 3600, 6) AS per_second, round(quantile_cont(ms, 0.95), 4) AS p95,
count_if(verdict = 'PASS') AS pass, count_if(verdict = 'REGENERATE') AS regenerate, count_if(verdict = 'DECLINE') AS decline, {", ".join(f"count_if(ms <= {b}) AS c{i}" for i, b in enumerate(rp.BOUNDS))} FROM v GROUP BY ALL)
SELECT hour, intent, n, slow_ratio, error_ratio, per_second, p95, pass, regenerate, decline, {", ".join(f"round({_histogram_sql(q / 100)}, 4) AS h{q}" for q in (50, 95, 99))} FROM h""")
def agg28_service_metrics(spark, d):
    verdict = F.element_at(F.array(*map(F.lit, ("PASS", "REGENERATE", "DECLINE"))), (F.col("result_count") % 3 + 1).cast("int"))
    return rp.hourly_metrics(logs(spark, d).withColumn("verdict", verdict))


@query(f"""WITH {CONTENT} SELECT item_id, count(*) AS raw, count_if(NOT contains(text, 'License')) AS effective, count_if(NOT contains(text, 'License') AND e.vec_id IS NOT NULL) AS embedded
FROM content c LEFT JOIN embeddings e ON e.vec_id = c.id GROUP BY 1""")
def agg29_effective_index_counts(spark, d):
    real = ~F.col("text").contains("License")
    marked = content(spark, d).join(vectors(spark, d).select("id", F.lit(1).alias("v")), "id", "left")
    return marked.groupBy("item_id").agg(F.count(F.lit(1)).alias("raw"), F.count_if(real).alias("effective"), F.count_if(real & F.col("v").isNotNull()).alias("embedded"))
