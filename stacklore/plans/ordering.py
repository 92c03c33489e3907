"""Queries over windows, limits and samples."""

from pyspark.sql import functions as F

from stacklore.catalog import query
from stacklore.operators import ranking as r
from stacklore.sources.views import CONTENT, LOGS, content, logs, table

_S = f"WITH {LOGS}, s AS (SELECT id, tenant AS query_id, ms AS score, intent AS kind FROM logs)"


def _scored(spark, d):
    return logs(spark, d).select("id", F.col("tenant").alias("query_id"), F.col("ms").alias("score"), F.col("intent").alias("kind"))


@query(f"WITH {LOGS} SELECT tenant, id, intent FROM (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY created_at DESC NULLS LAST, id DESC) AS nth FROM logs) WHERE nth = 1")
def win01_latest_row(spark, d):
    return r.latest(logs(spark, d), ["tenant"], "created_at", "id").select("tenant", "id", "intent")


@query("SELECT doc_id AS id FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS nth FROM documents) WHERE nth = 1")
def win02_keep_first(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("h"))
    return r.keep_first(docs, ["h"], "id").select("id")


@query(f"{_S} SELECT id, round(CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0 END, 6) AS norm FROM s WINDOW w AS (PARTITION BY query_id)")
def win03_min_max(spark, d):
    return r.min_max(_scored(spark, d), "score", "query_id").select("id", F.round("norm", 6).alias("norm"))


@query(f"""{_S}, a AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY score DESC, id) AS nth, max(score) OVER (PARTITION BY query_id, kind) AS best FROM s),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (nth > 2)::INT, CASE WHEN nth <= 2 THEN -best END, CASE WHEN nth <= 2 THEN kind END, score DESC, id) AS pos FROM a) SELECT query_id, id, pos FROM b WHERE pos <= 12""")
def win04_group_quota(spark, d):
    return r.per_group_quota(_scored(spark, d), "kind", 2, 12).select("query_id", "id", "pos")


@query(f"""{_S}, a AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY score DESC, id) AS turn FROM s) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY turn, kind) AS pos FROM a""")
def win06_interleave(spark, d):
    return r.interleave(_scored(spark, d), "query_id", "kind", "score").select("query_id", "id", "pos")


@query(f"""{_S}, a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rk FROM s)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rk % 2, CASE WHEN rk % 2 = 0 THEN rk ELSE -rk END) AS pos FROM a WHERE rk < 10""")
def win07_long_context_order(spark, d):
    ranked = r.top_k(_scored(spark, d), ["query_id"], [F.desc("score"), "id"], 10).withColumn("rk", F.col("nth") - 1)
    return r.ends_first(ranked, "query_id", "rk").select("query_id", "id", "pos")


@query(f"""WITH {CONTENT}, {LOGS}, n AS (SELECT result_count AS id, count(*) AS times FROM logs GROUP BY 1) SELECT c.id, coalesce(times, 0) AS times FROM content c LEFT JOIN n USING (id) ORDER BY times, (c.id * 2654435761 + 40503) % 4294967296, c.id LIMIT 40""")
def win09_least_seen(spark, d):
    return r.least_seen(content(spark, d), logs(spark, d).select(F.col("result_count").alias("id")), 40).select("id", "times")


@query(f"WITH {LOGS} SELECT tenant, arg_max(id, (intent = 'purchase', result_count, id)) AS id FROM logs GROUP BY 1")
def win11_priority_pick(spark, d):
    return r.pick_by(logs(spark, d), ["tenant"], [F.col("intent") == "purchase", F.col("result_count"), F.col("id")], ["id"])


@query("SELECT p_partkey AS id FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def top01_distance_top_k(spark, d):
    return table(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(25).select(F.col("p_partkey").alias("id"))


@query("SELECT o_orderkey AS id FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 40")
def top02_offset_page(spark, d):
    return r.page(table(spark, d, "orders"), [F.desc("o_orderdate"), F.desc("o_orderkey")], 40, 20).select(F.col("o_orderkey").alias("id"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderdate < TIMESTAMP '1999-06-01' OR (o_orderdate = TIMESTAMP '1999-06-01' AND o_orderkey < 500) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 21")
def top03_keyset_page(spark, d):
    return r.keyset_page(table(spark, d, "orders"), "o_orderdate", "o_orderkey", ("1999-06-01 00:00:00", 500), 20).select(F.col("o_orderkey").alias("id"))


@query(f"{_S} SELECT id FROM s ORDER BY score DESC, id LIMIT 80")
def top04_candidate_pool(spark, d):
    return _scored(spark, d).orderBy(F.desc("score"), "id").limit(r.pool_size(20)).select("id")


@query("SELECT doc_id AS id FROM documents ORDER BY (doc_id * 2654435761 + 283521) % 4294967296, doc_id LIMIT 30")
def top05_random_rows(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return docs.orderBy(r.repeatable("id", 7), "id").limit(30)


@query(f"""{_S}, st AS (SELECT kind, row_number() OVER (ORDER BY kind) AS k, count(*) OVER () AS s FROM (SELECT DISTINCT kind FROM s)),
q AS (SELECT kind, floor(47 / s) + (k <= 47 % s)::INT AS quota FROM st) SELECT id, s.kind FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY id) AS nth FROM s) s JOIN q USING (kind) WHERE nth <= quota""")
def top06_stratified(spark, d):
    return r.stratified(_scored(spark, d), "kind", 47).select("id", "kind")


@query(f"""WITH {CONTENT}, a AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY page_number, chunk_index, id) AS rn, count(*) OVER (PARTITION BY item_id) AS n, sum(length(text)) OVER (PARTITION BY item_id) AS chars FROM content),
b AS (SELECT *, greatest(floor(n * 0.15), 1) AS edge, greatest(ceil(chars / 30000), 1) AS step FROM a) SELECT item_id, id, rn FROM b WHERE rn <= edge OR rn > n - edge OR (((rn - edge - 1) % step) + step) % step = 0""")
def top07_head_middle_tail(spark, d):
    return r.head_middle_tail(content(spark, d), 30000).select("item_id", "id", "rn")


@query(f"""WITH {CONTENT} SELECT id, CASE content_type WHEN 'BOOK' THEN 1.0 WHEN 'HIGHLIGHT' THEN 3.0 WHEN 'INSIGHT' THEN 4.0 WHEN 'PERSONAL_NOTE' THEN 5.0 ELSE CASE WHEN id % 2 = 0 THEN 5.5 ELSE 7.0 END END::DOUBLE AS priority FROM content""")
def top08_source_priority(spark, d):
    c = content(spark, d).withColumn("comment", F.when(F.col("id") % 2 == 0, "x").otherwise(""))
    return c.select("id", r.source_priority(F.col("content_type"), F.col("text"), F.col("comment")).alias("priority"))


@query(f"""{_S}, p(kind, rank) AS (VALUES ('purchase', 1), ('signup', 2), ('click', 3)) SELECT id, coalesce(rank, 9) AS rank FROM s LEFT JOIN p USING (kind) ORDER BY coalesce(rank, 9), score DESC, id LIMIT 60""")
def top09_domain_reorder(spark, d):
    ranks = spark.createDataFrame([("purchase", 1), ("signup", 2), ("click", 3)], "kind string, rank int")
    out = _scored(spark, d).join(F.broadcast(ranks), "kind", "left").withColumn("rank", F.coalesce("rank", F.lit(9)))
    return out.orderBy("rank", F.desc("score"), "id").limit(60).select("id", "rank")


@query(f"""WITH {CONTENT}, a AS (SELECT item_id, id, row_number() OVER (PARTITION BY item_id ORDER BY id) - 1 AS rn, count(*) OVER (PARTITION BY item_id) AS n FROM content),
t AS (SELECT ('0x' || substr(md5('tok:salt'), 1, 8))::BIGINT AS turn) SELECT item_id, id, (rn - turn % n + n) % n AS pos FROM a, t""")
def top10_rotation(spark, d):
    return r.rotated(content(spark, d), "item_id", "id", "tok", "salt").select("item_id", "id", "pos")


@query(f"""WITH {CONTENT}, a AS (SELECT page_number AS query_id, id, text, row_number() OVER (PARTITION BY page_number ORDER BY length(text) DESC, id) AS nth FROM content)
SELECT query_id, string_agg('[' || nth || '] ' || substr(text, 1, 100), chr(10) ORDER BY nth) AS context FROM a WHERE nth <= 5 GROUP BY 1""")
def top11_bounded_context(spark, d):
    c = content(spark, d).select(F.col("page_number").alias("query_id"), "id", F.length("text").alias("score"), "text")
    return r.bounded_context(c, 5, 100)
