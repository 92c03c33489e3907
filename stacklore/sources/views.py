"""Library tables as plain projections of the given tables, each also as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPES = ("BOOK", "HIGHLIGHT", "INSIGHT", "PDF_CHUNK", "PERSONAL_NOTE")
CONTENT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()), T.StructField("tenant", T.StringType()), T.StructField("item_id", T.StringType()),
        T.StructField("content_type", T.StringType()), T.StructField("title", T.StringType()), T.StructField("text", T.StringType()),
        T.StructField("page_number", T.LongType()), T.StructField("chunk_index", T.LongType()), T.StructField("created_at", T.TimestampNTZType()),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` in order; missing ones become typed nulls."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, n = F.col("doc_id"), F.expr("CAST(substr(source, 4) AS BIGINT)")
    return table(spark, sf_dir, "documents").select(
        d.alias("id"), F.concat(F.lit("u"), (d % 7).cast("string")).alias("tenant"), F.col("source").alias("item_id"),
        F.element_at(F.array(*map(F.lit, TYPES)), (d % 5 + 1).cast("int")).alias("content_type"),
        F.concat(F.lit("Book "), n.cast("string"), F.lit(" - Author "), (n % 5).cast("string")).alias("title"), "text",
        F.expr("doc_id div 100 + 1").alias("page_number"), F.expr("doc_id div 20").alias("chunk_index"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, doc_id, 0, 0)").alias("created_at"), "lang",
    )


CONTENT = """content AS (SELECT doc_id AS id, 'u' || (doc_id % 7) AS tenant, source AS item_id,
  ['BOOK', 'HIGHLIGHT', 'INSIGHT', 'PDF_CHUNK', 'PERSONAL_NOTE'][doc_id % 5 + 1] AS content_type,
  'Book ' || substr(source, 4)::BIGINT || ' - Author ' || (substr(source, 4)::BIGINT % 5) AS title, text,
  doc_id // 100 + 1 AS page_number, doc_id // 20 AS chunk_index,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id) AS created_at, lang FROM documents)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.expr("CAST(substr(item_id, 4) AS BIGINT)")
    kinds = F.array(*map(F.lit, ("BOOK", "ARTICLE", "MOVIE", "PERSONAL_NOTE")))
    return content(spark, sf_dir).select("tenant", "item_id", "title").distinct().select(
        "tenant", "item_id", "title", F.element_at(kinds, (n % 4 + 1).cast("int")).alias("item_type"), (n % 9 == 0).cast("int").alias("is_deleted"),
        F.when(n % 5 == 0, "NEVER_RETRIEVE").when(n % 5 == 1, "EXCLUDE").when(n % 5 > 2, "DEFAULT").alias("search_visibility"),
        F.when(n % 3 == 0, "PRIVATE").when(n % 3 == 1, "IDEAS").alias("category"), (n * 7 % 50).alias("declared_chunks"),
    )


ITEMS = CONTENT + """, items AS (SELECT tenant, item_id, title, ['BOOK', 'ARTICLE', 'MOVIE', 'PERSONAL_NOTE'][n % 4 + 1] AS item_type,
  (n % 9 = 0)::INT AS is_deleted, CASE WHEN n % 5 = 0 THEN 'NEVER_RETRIEVE' WHEN n % 5 = 1 THEN 'EXCLUDE' WHEN n % 5 > 2 THEN 'DEFAULT' END AS search_visibility,
  CASE WHEN n % 3 = 0 THEN 'PRIVATE' WHEN n % 3 = 1 THEN 'IDEAS' END AS category, n * 7 % 50 AS declared_chunks
  FROM (SELECT DISTINCT tenant, item_id, title, substr(item_id, 4)::BIGINT AS n FROM content))"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("tenant"), F.col("event_type").alias("intent"),
        (F.col("value") * 10).alias("ms"), F.col("ts").alias("created_at"), k.alias("result_count"), F.concat(F.lit("Query  "), (k % 50).cast("string")).alias("query_text"),
    )


LOGS = """logs AS (SELECT event_id AS id, 'u' || user_id AS tenant, event_type AS intent, value * 10 AS ms, ts AS created_at,
  (props->>'$.k')::BIGINT AS result_count, 'Query  ' || ((props->>'$.k')::BIGINT % 50) AS query_text FROM events)"""


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("IS_A", "PART_OF", "RELATED_TO", "MENTIONS")))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(
        F.round(F.avg("l_discount") * 10, 6).alias("weight")
    ).withColumn("rel_type", F.element_at(kinds, ((F.col("src") + F.col("dst")) % 4 + 1).cast("int")))


RELATIONS = """relations AS (SELECT l_partkey AS src, l_suppkey AS dst, round(avg(l_discount) * 10, 6) AS weight,
  ['IS_A', 'PART_OF', 'RELATED_TO', 'MENTIONS'][(l_partkey + l_suppkey) % 4 + 1] AS rel_type FROM lineitem GROUP BY ALL)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").cast("long").alias("concept_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i")).select(
        "concept_id", (F.col("concept_id") * 3 + F.col("i") * 17).alias("content_id"), (1 - F.col("i") * 0.2).alias("strength")
    )


LINKS = """links AS (SELECT s_suppkey::BIGINT AS concept_id, s_suppkey::BIGINT * 3 + i * 17 AS content_id, 1 - i * 0.2::DOUBLE AS strength
  FROM supplier, range(0, 5) r(i))"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
