"""Queries over files that are written and read again, provider results, and injected functions."""

import uuid

from pyspark.sql import functions as F

from stacklore.catalog import query
from stacklore.functions import udfs
from stacklore.operators import providers
from stacklore.sources import readers, sinks
from stacklore.sources.shared import shared_dir
from stacklore.sources.views import table


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("""WITH h AS (SELECT o_custkey AS c, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1), k AS (SELECT c_custkey AS c, c_name AS title FROM customer)
SELECT c::VARCHAR AS book_id, coalesce(n, 0) AS highlights, first::INT AS first_page, NULL::VARCHAR AS reason FROM k LEFT JOIN h USING (c) WHERE c % 7 <> 0 AND c % 11 <> 0 AND c % 13 <> 0
UNION ALL SELECT CASE WHEN c % 13 = 0 THEN NULL WHEN c % 7 = 0 THEN ' ' ELSE c::VARCHAR END, 0, NULL, CASE WHEN c % 13 = 0 THEN 'not_json' WHEN c % 7 = 0 THEN 'no_id' ELSE 'no_title' END FROM k WHERE c % 7 = 0 OR c % 11 = 0 OR c % 13 = 0""")
def src02_document_exports(spark, d):
    """Customers as exported documents with their orders as highlights, some of them broken; read back and sorted out."""
    path, c = _folder(spark, "exports"), F.col("c_custkey")
    marks = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("pageNumber"), F.col("o_orderpriority").alias("text"), F.col("o_orderstatus").alias("type")))).alias("highlights")
    )
    ident = F.when(c % 7 == 0, " ").otherwise(c.cast("string")).alias("book_id")
    title = F.when(c % 11 != 0, F.col("c_name")).alias("title")
    body = F.to_json(F.struct(ident, title, F.array("c_mktsegment").alias("tags"), "highlights"))
    table(spark, d, "customer").join(marks, "c_custkey", "left").select(F.when(c % 13 == 0, F.concat(F.lit('{"book_id": '), c.cast("string"))).otherwise(body)).write.text(path)
    good, bad = readers.read_exports(spark, path)
    pages = F.transform("highlights", lambda h: h["pageNumber"])
    good = good.select("book_id", F.coalesce(F.size("highlights"), F.lit(0)), F.array_min(pages), F.lit(None).cast("string"))
    good = good.toDF("book_id", "highlights", "first_page", "reason").withColumn("highlights", F.greatest("highlights", F.lit(0)).cast("long"))
    return good.unionByName(bad.select("book_id", F.lit(0).cast("long").alias("highlights"), F.lit(None).cast("int").alias("first_page"), "reason"))


@query("""WITH s AS (SELECT n_name || ':' || (s_suppkey % 40) AS id, 'part ' || (s_suppkey % 3) AS chapter, 'a: ' || s_nationkey || '; b: x' AS grades, s_name AS text, s_suppkey,
row_number() OVER (PARTITION BY n_name, s_suppkey % 40 ORDER BY s_suppkey) AS nth FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 5 <> 0)
SELECT id, CASE WHEN s_suppkey % 3 <> 2 THEN chapter END AS chapter, grades, text FROM s WHERE nth = 1""")
def src03_json_collections(spark, d):
    """Suppliers of a nation as one nested collection, with a number that repeats and texts that are blank; read back."""
    path, k = _folder(spark, "collections"), F.col("s_suppkey")
    grade = lambda n, g: F.struct(F.lit(n).alias("name"), g.alias("grade"))
    row = F.struct(
        k.alias("order"), (k % 40).alias("hadithnumber"), F.when(k % 5 == 0, " ").otherwise(F.col("s_name")).alias("text"),
        F.array(grade("a", F.col("s_nationkey").cast("string")), grade("b", F.lit("x"))).alias("grades"), F.struct((k % 3).alias("book")).alias("reference"),
    )
    sections = F.create_map(F.lit("0"), F.lit("part 0"), F.lit("1"), F.lit("part 1"))
    every = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    one = every.groupBy("n_name").agg(F.array_sort(F.collect_list(row)).alias("hadiths")).select(F.to_json(F.struct(F.struct(F.col("n_name").alias("name"), sections.alias("sections")).alias("metadata"), "hadiths")), "n_name")
    one.write.partitionBy("n_name").text(path)
    return readers.read_collection(spark, path)


@query("""WITH r AS (SELECT l_orderkey AS k, array_to_string(list_sort(list_distinct(list(lower(l_returnflag || l_linestatus)))), ',') AS roots FROM lineitem GROUP BY 1)
SELECT o_custkey::VARCHAR AS part, o_orderkey::VARCHAR AS number, o_orderpriority AS text, CASE WHEN o_orderkey % 3 = 0 THEN 'second ' || o_orderstatus ELSE 'first ' || o_orderstatus END AS translation, roots FROM orders LEFT JOIN r ON k = o_orderkey""")
def src04_csv_assembly(spark, d):
    """Texts, translations in two columns and tagged tokens as three CSV folders, put together by (part, number)."""
    path, o, k = _folder(spark, "csv"), table(spark, d, "orders"), F.col("o_orderkey")
    keys = [F.col("o_custkey").alias("part"), k.alias("number")]
    o.select(*keys, F.col("o_orderpriority").alias("text")).write.option("header", True).csv(f"{path}/texts")
    o.select(*keys, F.when(k % 3 == 0, " ").otherwise(F.concat(F.lit("first "), "o_orderstatus")).alias("a"), F.concat(F.lit("second "), "o_orderstatus").alias("b")).write.option("header", True).csv(f"{path}/translations")
    tag = F.concat(F.lit("POS:N|ROOT:"), F.lower(F.concat("l_returnflag", "l_linestatus")), F.lit("|LEM:x"))
    lines = table(spark, d, "lineitem").join(o.select(*keys), F.col("l_orderkey") == F.col("number")).select("part", "number", tag.alias("tag"))
    lines.write.option("header", True).csv(f"{path}/tokens")
    read = lambda name: spark.read.option("header", True).schema(f"part STRING, number STRING, {name}").csv
    made = readers.assemble(read("text STRING")(f"{path}/texts"), read("a STRING, b STRING")(f"{path}/translations"), read("tag STRING")(f"{path}/tokens"), ["part", "number"], ["a", "b"])
    return made.select("part", "number", "text", "translation", F.array_join("roots", ",").alias("roots"))


@query("""WITH p AS (SELECT page_id, md5(html) AS text, unnest(range(0, (page_id % 3 + 1)::INT)) AS nth FROM pages WHERE page_id % 10 <> 0) SELECT (page_id * 10 + nth)::BIGINT AS page, nth::BIGINT AS nth, text FROM p""")
def src05_parser_output(spark, d):
    """Parser payloads with their page arrays at different depths, some cut off; all pages in order."""
    path, p = _folder(spark, "parser"), F.col("page_id")
    pages = F.transform(F.sequence(F.lit(0), (p % 3).cast("int")), lambda i: F.struct((p * 10 + i).alias("page"), F.md5("html").alias("text")))
    flat, deep, deeper = F.struct(pages.alias("pages")), F.struct(F.struct(pages.alias("pages")).alias("result")), F.struct(F.array(F.struct(F.struct(pages.alias("pages")).alias("document"))).alias("outputs"))
    body = F.when(p % 4 == 0, F.to_json(flat)).when(p % 4 == 1, F.to_json(deep)).otherwise(F.to_json(deeper))
    table(spark, d, "pages").select(F.when(p % 10 == 0, F.expr("substr(md5(html), 1, 9)")).otherwise(body)).write.text(path)
    return readers.read_parser_pages(spark, path, lines=True).select("page", "nth", "text")


@query("SELECT doc_id, coalesce(lang, 'none') AS lang, md5(text) AS text FROM documents WHERE doc_id IS NOT NULL")
def snk02_json_lines(spark, d):
    """Documents as JSON lines in a folder for each language, read back."""
    path = _folder(spark, "lines")
    sinks.write_json_lines(table(spark, d, "documents").select("doc_id", "text", F.coalesce("lang", F.lit("none")).alias("lang")), path, "lang")
    return spark.read.schema("doc_id long, text string, lang string").json(path).select("doc_id", "lang", F.md5("text").alias("text"))


@query("SELECT o_orderpriority AS part, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1")
def snk03_versioned_rebuild(spark, d):
    """Two partitions loaded, then all of them, then all again, and what the version that is pointed at holds."""
    root, parts = _folder(spark, "rebuild"), table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("part"))
    sinks.rebuild(spark, parts.where("part < '3'"), "part", root, "1")
    for _ in range(2):
        sinks.rebuild(spark, parts, "part", root, "1")
    return sinks.read_current(spark, root).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


def _books(spark, d):
    """Results of three providers for each size of part: titles in different spelling, some with ISBNs."""
    k = F.col("p_partkey")
    part = table(spark, d, "part")
    own = lambda name, nth, title, isbns: part.select(F.col("p_size").cast("long").alias("query_id"), F.lit(name).alias("provider"), (k * 3 + nth).alias("nth"), title.alias("title"), F.col("p_brand").alias("author"), isbns.alias("isbns"))
    isbn = lambda every: F.when(k % every == 0, F.array(F.concat(F.lit("97800000"), k.cast("string")))).otherwise(F.array().cast("array<string>"))
    return own("google-books", 0, F.col("p_name"), isbn(2)).unionByName(own("open-library", 1, F.upper("p_name"), isbn(3))).unionByName(own("open-library-bib", 2, F.concat(F.col("p_name"), F.lit(" ")), isbn(6)))


@query(r"""WITH b AS (SELECT p_size AS query_id, unnest([0, 1, 2]) AS j, p_partkey AS k, lower(trim(p_name)) AS title, lower(p_brand) AS author FROM part),
r AS (SELECT query_id, k * 3 + j AS nth, CASE WHEN k % [2, 3, 6][j + 1] = 0 THEN '97800000' || k ELSE title || '|' || author END AS key FROM b) SELECT query_id::BIGINT AS query_id, key, min(nth)::BIGINT AS nth FROM r GROUP BY 1, 2""")
def ret19_provider_merge(spark, d):
    """One result for each set of ISBNs, or title and author, of each query: the first."""
    return providers.first_of_each(_books(spark, d)).select("query_id", "key", "nth")


@query(None)
def ret19_provider_rank(spark, d):
    """The merged results of each query in order of their ISBN match or likeness."""
    size = table(spark, d, "part").select(F.col("p_size").cast("long").alias("query_id")).distinct()
    isbns = F.when(F.col("query_id") % 2 == 0, F.array(F.concat(F.lit("97800000"), (F.col("query_id") * 6).cast("string")))).otherwise(F.array().cast("array<string>"))
    queries = size.select("query_id", F.lit("Small ring of tin").alias("text"), isbns.alias("isbns"))
    return providers.ranked(providers.first_of_each(_books(spark, d)), queries).select("query_id", "nth", "score", "position")


@query(None)
def udf01_embedding(spark, d):
    """The stand-in model's vector of each document, its first and last places."""
    v = udfs.embed(F.col("text"))
    return table(spark, d, "documents").select("doc_id", v.alias("v")).select("doc_id", F.col("v")[0].alias("first"), F.col("v")[63].alias("last"))


@query("SELECT conv_id, turn, array_to_string(list_transform(string_split_regex(lower(text), '[^a-z]+'), lambda w: w[1:5]), ' ') AS lemmas FROM conversations")
def udf02_lemmatiser(spark, d):
    """An injected analyser that keeps five letters of each word."""
    words = F.split(F.lower("text"), "[^a-z]+")
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(udfs.lemmatise(words, lambda w: w[:5]), " ").alias("lemmas"))


@query("SELECT conv_id * 100 + turn AS id, substr(text, 1, 20) AS answer, least(length(text), 20) / 20::DOUBLE AS score FROM conversations WHERE role = 'user'")
def udf03_answer_and_judge(spark, d):
    """Injected answers (the first twenty letters) and their judge (their share of twenty letters)."""
    cases = table(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("text").alias("question"))
    return udfs.answer_all(cases, lambda q: (q or "")[:20], lambda q, a: len(a) / 20)


@query("""WITH w AS (SELECT doc_id AS id, list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) >= 9) AS ws FROM documents), e AS (SELECT id, ws, unnest(range(1, len(ws))) AS i FROM w)
SELECT id, ws[i] AS src, 'NEAR' AS rel_type, ws[i + 1] AS dst FROM e""")
def udf04_concept_extractor(spark, d):
    """An injected extractor: each two long words that follow one another."""

    def pairs(text):
        import re

        long = [w for w in re.findall("[a-z]+", text.lower()) if len(w) >= 9]
        return [(a, "NEAR", b) for a, b in zip(long, long[1:])]

    return udfs.extract_concepts(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), pairs)
