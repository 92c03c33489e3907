"""Queries over joins and set operations."""

from pyspark.sql import functions as F

from stacklore.catalog import query
from stacklore.operators import joins as j
from stacklore.operators import ranking as r
from stacklore.sources.views import CONTENT, ITEMS, LINKS, LOGS, RELATIONS, content, items, links, logs, relations, table


@query(f"WITH {ITEMS} SELECT c.id, i.item_type, i.search_visibility FROM content c LEFT JOIN items i USING (tenant, item_id)")
def joi01_content_items(spark, d):
    return j.with_items(content(spark, d), items(spark, d), "item_type", "search_visibility").select("id", "item_type", "search_visibility")


@query(f"WITH {ITEMS} SELECT id FROM content c WHERE EXISTS (SELECT 1 FROM items i WHERE i.tenant = c.tenant AND i.item_id = c.item_id AND is_deleted = 0)")
def joi02_active_items(spark, d):
    return j.active(content(spark, d), items(spark, d)).select("id")


@query(f"WITH {CONTENT}, {LOGS} SELECT id FROM content WHERE id NOT IN (SELECT result_count FROM logs WHERE result_count IS NOT NULL AND intent = 'view')")
def joi03_unseen(spark, d):
    seen = logs(spark, d).where("intent = 'view'").select(F.col("result_count").alias("id")).distinct()
    return j.unseen(content(spark, d), seen, ["id"]).select("id")


@query("""SELECT 'labels' AS child, count(*) AS orphans FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'embeddings', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT doc_id FROM documents)""")
def joi04_orphans(spark, d):
    children = {"labels": (table(spark, d, "labels"), ["doc_id"]), "embeddings": (table(spark, d, "embeddings"), ["vec_id"]), "orders": (table(spark, d, "orders"), ["o_orderkey"])}
    return j.orphans(children, table(spark, d, "documents"), ["doc_id"])


@query("""SELECT c_custkey, last.o_orderkey, last.o_orderstatus FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey,
arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY 1) last ON c_custkey = o_custkey""")
def joi05_latest_child(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return j.latest_child(table(spark, d, "customer").select("c_custkey"), o, ["c_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus"])


@query(f"""WITH {RELATIONS}, {LINKS}, e AS (SELECT s_suppkey::BIGINT AS concept FROM supplier WHERE s_nationkey = 3),
t AS (SELECT DISTINCT concept, CASE WHEN src = concept THEN dst ELSE src END AS other, rel_type, weight FROM relations, e WHERE src = concept OR dst = concept)
SELECT DISTINCT concept, other, content_id FROM t JOIN links ON concept_id = other""")
def joi06_either_end(spark, d):
    entries = table(spark, d, "supplier").where("s_nationkey = 3").select(F.col("s_suppkey").cast("long").alias("concept"))
    near = j.touching(entries, relations(spark, d))
    return near.join(links(spark, d), F.col("concept_id") == F.col("other")).select("concept", "other", "content_id").distinct()


@query("""WITH r AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem) SELECT x.src AS a, y.src AS b, count(DISTINCT x.dst) AS shared FROM r x JOIN r y ON x.dst = y.dst AND x.src < y.src GROUP BY ALL HAVING shared >= 3""")
def joi07_common_neighbours(spark, d):
    return j.common_neighbours(relations(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst")), 3)


@query(f"""WITH {CONTENT}, n AS (SELECT s.id AS seed, c.id, least(abs(c.page_number - s.page_number), abs(c.chunk_index - s.chunk_index)) AS gap FROM content s JOIN content c USING (item_id)
WHERE s.id % 100 = 0 AND c.id <> s.id AND (abs(c.page_number - s.page_number) <= 1 OR abs(c.chunk_index - s.chunk_index) <= 1)),
k AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY gap, id) AS nth FROM n) SELECT id, min(gap) AS gap FROM k WHERE nth <= 4 GROUP BY 1""")
def joi08_neighbours(spark, d):
    c = content(spark, d)
    return j.neighbours(c.where("id % 100 = 0"), c, 1, 4)


@query(f"WITH {CONTENT} SELECT a.id AS anchor, c.id FROM content a JOIN content c USING (title) WHERE a.id % 100 = 0 AND c.id <> a.id AND abs(c.page_number - a.page_number) <= 2")
def joi09_near_pages(spark, d):
    c = content(spark, d)
    return j.near_pages(c.where("id % 100 = 0"), c, 2)


@query(f"WITH {CONTENT} SELECT a.id AS anchor, c.id, string_split(a.title, ' - ')[-1] AS author FROM content a JOIN content c ON string_split(a.title, ' - ')[-1] = string_split(c.title, ' - ')[-1] WHERE a.id % 100 = 0 AND a.title <> c.title")
def joi10_same_author(spark, d):
    c = content(spark, d)
    return j.same_author(c.where("id % 100 = 0"), c)


@query(f"WITH {ITEMS} SELECT a.tenant, a.item_id AS item_a, b.item_id AS item_b FROM (SELECT * REPLACE (string_split(title, ' - ')[1] AS title) FROM items) a JOIN (SELECT * REPLACE (string_split(title, ' - ')[1] AS title) FROM items) b ON a.tenant = b.tenant AND a.item_id < b.item_id WHERE a.title <> b.title AND (contains(lower(a.title), lower(b.title)) OR contains(lower(b.title), lower(a.title)))")
def joi12_title_mismatches(spark, d):
    return j.title_mismatches(items(spark, d).withColumn("title", F.element_at(F.split("title", " - "), 1)))


@query(f"WITH {RELATIONS} SELECT src, dst, rel_type, p_name AS src_label, s_name AS dst_label FROM relations JOIN part ON p_partkey = src JOIN supplier ON s_suppkey = dst")
def joi13_labelled_edges(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("src"), F.col("p_name").alias("src_label"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("dst"), F.col("s_name").alias("dst_label"))
    return relations(spark, d).join(p, "src").join(s, "dst").select("src", "dst", "rel_type", "src_label", "dst_label")


@query(f"""WITH {CONTENT}, {LOGS} SELECT tenant, id, EXISTS (SELECT 1 FROM logs l WHERE l.tenant = c.tenant AND l.result_count = c.id AND l.created_at >= TIMESTAMP '2024-01-10') AS seen FROM content c""")
def joi14_seen_in_window(spark, d):
    seen = logs(spark, d).select("tenant", F.col("result_count").alias("id"), F.col("created_at").alias("seen_at"))
    return j.seen_within(content(spark, d).select("tenant", "id"), seen, "2024-01-10 00:00:00")


@query("""SELECT p_partkey AS id FROM part WHERE contains(lower(p_name), 'ring') OR lower(p_name) IN ('red widget', 'brand#2') UNION SELECT p_partkey FROM part WHERE lower(p_brand) IN ('red widget', 'brand#2')""")
def joi16_concept_lookup(spark, d):
    p = table(spark, d, "part")
    return j.concept_lookup(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("alias")), "ring", ["red widget", "brand#2"])


@query(f"""WITH {CONTENT}, c AS (SELECT id AS candidate, unnest([{{'kind': 'tag', 'word': lang}}, {{'kind': 'tag', 'word': content_type}}, {{'kind': 'author', 'word': string_split(title, ' - ')[-1]}}]) AS t FROM content WHERE id % 100 = 0),
i AS (SELECT DISTINCT item_id AS item, unnest([{{'kind': 'tag', 'word': lang}}, {{'kind': 'tag', 'word': content_type}}, {{'kind': 'author', 'word': string_split(title, ' - ')[-1]}}]) AS t FROM content),
h AS (SELECT candidate, item, c.t.kind AS kind, count(*) AS n FROM c JOIN i ON c.t.kind = i.t.kind AND c.t.word = i.t.word GROUP BY ALL),
s AS (SELECT candidate, item, sum(least(n, CASE WHEN kind = 'tag' THEN 2 ELSE 1 END))::BIGINT AS score FROM h GROUP BY ALL)
SELECT candidate, item, score FROM (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY score DESC, item) AS nth FROM s) WHERE nth <= 3""")
def joi17_evidence_match(spark, d):
    term = lambda k, w: F.struct(F.lit(k).alias("kind"), w.alias("word"))
    terms = F.array(term("tag", F.col("lang")), term("tag", F.col("content_type")), term("author", j.author_of("title")))
    c = content(spark, d).withColumn("terms", terms)
    return j.evidence_match(c.where("id % 100 = 0").withColumnRenamed("id", "candidate"), c.withColumnRenamed("item_id", "item"), 3)


@query("""SELECT doc_id AS id, src FROM (SELECT doc_id, 0 AS src FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 1 FROM labels l WHERE quality = 1 AND NOT toxic = 1) ORDER BY src, doc_id LIMIT 120""")
def set01_prefer_first(spark, d):
    lb = table(spark, d, "labels").withColumnRenamed("doc_id", "id")
    return r.prefer_first(lb.where("toxic = 1").select("id"), lb.where("quality = 1").select("id"), "id", 120)


@query("SELECT doc_id AS id FROM documents EXCEPT SELECT doc_id FROM labels")
def set02_missing_keys(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id")).subtract(table(spark, d, "labels").select("doc_id"))


_SIG = "sha256(lower(trim(text)))"


@query(f"""WITH a AS (SELECT source, {_SIG} AS sig, count(*) AS na FROM documents GROUP BY ALL), b AS (SELECT source, {_SIG} AS sig, count(*) AS nb FROM documents WHERE lang <> 'es' GROUP BY ALL)
SELECT source, sum(greatest(coalesce(na, 0) - coalesce(nb, 0), 0))::BIGINT AS missing, sum(greatest(coalesce(nb, 0) - coalesce(na, 0), 0))::BIGINT AS extra FROM a FULL JOIN b USING (source, sig) GROUP BY 1 HAVING missing + extra > 0""")
def set03_multiset_parity(spark, d):
    s = table(spark, d, "documents").select("lang", "source", F.sha2(F.lower(F.trim("text")), 256).alias("sig"))
    diff = r.bag_difference(s, s.where("lang <> 'es'"), ["source", "sig"])
    return diff.groupBy("source").agg(F.sum("missing").alias("missing"), F.sum("extra").alias("extra"))


@query(f"""WITH {CONTENT}, a AS (SELECT tenant, content_type, count(*) AS n FROM content GROUP BY ALL), b AS (SELECT tenant, content_type, count(*) AS n FROM content WHERE lang <> 'es' OR tenant = 'u1' GROUP BY ALL)
SELECT tenant, sum(a.n)::BIGINT AS source_rows, sum(coalesce(b.n, 0))::BIGINT AS target_rows, CASE WHEN sum(a.n) = sum(coalesce(b.n, 0)) THEN 'OK' WHEN sum(coalesce(b.n, 0)) >= 0.9 * sum(a.n) THEN 'WARN' ELSE 'FAIL' END AS status
FROM a LEFT JOIN b USING (tenant, content_type) GROUP BY 1""")
def set04_parity_sweep(spark, d):
    c = content(spark, d)
    both = c.groupBy("tenant").agg(F.count(F.lit(1)).alias("source_rows"), F.count_if(F.expr("lang <> 'es' OR tenant = 'u1'")).alias("target_rows"))
    status = F.when(F.col("source_rows") == F.col("target_rows"), "OK").when(F.col("target_rows") >= 0.9 * F.col("source_rows"), "WARN").otherwise("FAIL")
    return both.withColumn("status", status)


@query(f"""WITH {CONTENT}, e AS (SELECT tenant, 'note' AS kind, id, substr(text, 1, 80) AS clip FROM content WHERE content_type = 'PERSONAL_NOTE' UNION ALL
SELECT 'u' || (conv_id % 7), 'message', conv_id * 100 + turn, substr(text, 1, 80) FROM conversations)
SELECT tenant, kind, id, clip FROM (SELECT *, row_number() OVER (PARTITION BY tenant, kind ORDER BY id DESC) AS nth FROM e) WHERE nth <= 5""")
def set05_evidence_union(spark, d):
    notes = content(spark, d).where("content_type = 'PERSONAL_NOTE'").select("tenant", F.lit("note").alias("kind"), "id", F.substring("text", 1, 80).alias("clip"))
    m = table(spark, d, "conversations")
    messages = m.select(F.concat(F.lit("u"), (F.col("conv_id") % 7).cast("string")).alias("tenant"), F.lit("message").alias("kind"), (F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.substring("text", 1, 80).alias("clip"))
    return r.top_k(notes.unionByName(messages), ["tenant", "kind"], [F.desc("id")], 5).drop("nth")


@query("""WITH t AS (SELECT doc_id, list_distinct(string_split(lower(text), ' ')) AS w FROM documents)
SELECT a.doc_id AS id, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 4) AS overlap FROM t a JOIN t b ON b.doc_id = a.doc_id + 1""")
def set06_jaccard(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("w"))
    b = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"))
    return t.join(b, "doc_id").select(F.col("doc_id").alias("id"), F.round(r.jaccard(F.col("w"), F.col("v")), 4).alias("overlap"))


@query(f"WITH {ITEMS} SELECT item_id FROM items WHERE item_type = 'BOOK' AND is_deleted = 0 UNION SELECT item_id FROM content WHERE content_type = 'PDF_CHUNK' AND page_number > 8")
def set07_ingested_items(spark, d):
    files = items(spark, d).where("item_type = 'BOOK' AND is_deleted = 0").select("item_id")
    return files.union(content(spark, d).where("content_type = 'PDF_CHUNK' AND page_number > 8").select("item_id")).distinct().orderBy("item_id")
