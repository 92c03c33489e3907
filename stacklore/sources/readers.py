"""Readers for nested exports, collections and parser output."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXPORT = "book_id STRING, type STRING, title STRING, author STRING, tags ARRAY<STRING>, highlights ARRAY<STRUCT<text: STRING, type: STRING, comment: STRING, pageNumber: INT>>, _bad STRING"


def item_chunks(chunks: DataFrame, item: str) -> DataFrame:
    """All chunks of an item in reading order."""
    return chunks.where(F.col("item_id") == item).orderBy("page_number", "chunk_index", "id")


def read_exports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Valid documents of a nested JSON export, and those that are quarantined with a reason."""
    raw = spark.read.schema(EXPORT).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    reason = F.when(F.col("_bad").isNotNull(), "not_json").when(F.length(F.trim(F.coalesce("book_id", F.lit("")))) == 0, "no_id").when(F.length(F.trim(F.coalesce("title", F.lit("")))) == 0, "no_title")
    marked = raw.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason", "_bad"), marked.where("reason IS NOT NULL").select("book_id", "reason", "_bad")


COLLECTION = "metadata STRUCT<name: STRING, sections: MAP<STRING, STRING>>, hadiths ARRAY<STRUCT<hadithnumber: BIGINT, text: STRING, grades: ARRAY<STRUCT<name: STRING, grade: STRING>>, reference: STRUCT<book: BIGINT>>>"


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """Rows of nested collections: chapter by section number, grades as text, first of each id."""
    raw = spark.read.schema(COLLECTION).option("multiLine", True).json(path)
    h = raw.select("metadata", F.col("_metadata.file_path").alias("file"), F.posexplode("hadiths").alias("nth", "h"))
    out = h.select(
        F.concat_ws(":", "metadata.name", F.col("h.hadithnumber").cast("string")).alias("id"), F.try_element_at("metadata.sections", F.col("h.reference.book").cast("string")).alias("chapter"),
        F.array_join(F.transform("h.grades", lambda g: F.concat_ws(": ", g["name"], g["grade"])), "; ").alias("grades"), F.col("h.text").alias("text"), "file", "nth",
    )
    first = out.where(F.length(F.trim("text")) > 0).groupBy("id").agg(F.min(F.struct("file", "nth", "chapter", "grades", "text")).alias("r"))
    return first.select("id", "r.chapter", "r.grades", "r.text")


def assemble(texts: DataFrame, translations: DataFrame, tokens: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row for each key: the first non-empty translation by column order, and sorted distinct roots of the token table."""
    pick = F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns))
    tr = translations.groupBy(*keys).agg(*(F.max(c).alias(c) for c in columns)).select(*keys, pick.alias("translation"))
    roots = tokens.select(*keys, F.explode(F.regexp_extract_all("tag", F.lit(r"ROOT:([^|]+)"), F.lit(1))).alias("r")).groupBy(*keys).agg(F.array_sort(F.collect_set("r")).alias("roots"))
    return texts.join(tr, keys, "full").join(roots, keys, "full")


def _pages_of(node: object) -> Iterator[dict]:
    """The entries of every array named ``pages``, at any depth, in the order of the text."""
    if isinstance(node, dict):
        found = node.get("pages")
        if isinstance(found, list):
            yield from (p for p in found if isinstance(p, dict))
    for inner in node.values() if isinstance(node, dict) else node if isinstance(node, list) else ():
        yield from _pages_of(inner)


def read_parser_pages(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """file, object, nth, page, text of the page entries of all JSON objects under a prefix.

    A file is one object, or with ``lines`` each of its lines; ``object`` numbers them in the order of the files' names.
    ``nth`` keeps the order inside an object. Unreadable objects are left out.
    """
    raw = spark.read.option("wholetext", not lines).text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("object"), "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file, number, value in b.itertuples(index=False):
                try:
                    node = json.loads(value)
                except ValueError:
                    continue
                rows += [(file, number, n, p.get("page"), p.get("text")) for n, p in enumerate(_pages_of(node))]
            yield pd.DataFrame(rows, columns=["file", "object", "nth", "page", "text"]).astype({"page": "Int64"})

    return raw.mapInPandas(run, "file string, object long, nth long, page long, text string")


def yesterday_on(logs: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Log rows since the start of the day before ``now``, newest first, and their summary."""
    start = F.date_trunc("day", F.lit(now).cast("timestamp_ntz") - F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz")
    rows = logs.where((F.col("created_at") >= start) & (F.col("created_at") < F.lit(now).cast("timestamp_ntz")))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), F.count_distinct("tenant").alias("tenants"))
    return rows.orderBy(F.desc("created_at"), F.desc("id")), total
