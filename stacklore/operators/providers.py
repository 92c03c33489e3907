"""Results of metadata providers, given as tables: union, first of each work, and rank."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: What a provider's results gain where ISBNs match and where texts are compared, and the weights of texts.
ISBN_BONUS = {"open-library-bib": 0.12, "open-library": 0.08, "google-books": 0.05}
TEXT_BONUS, OTHER_BONUS = {"google-books": 0.04}, 0.03
TITLE_WEIGHT, AUTHOR_WEIGHT, WORDS_WEIGHT = 0.58, 0.22, 0.20
#: Letters that count as one another.
FOLD_FROM, FOLD_TO = "ıçğöşü", "icgosu"


def bare(text: Column) -> Column:
    """Small letters without Turkish marks, blanks at the ends off."""
    return F.translate(F.lower(F.translate(F.trim(F.coalesce(text, F.lit(""))), "İ", "i")), FOLD_FROM, FOLD_TO)


def first_of_each(results: DataFrame) -> DataFrame:
    """Of the results (query_id, provider, nth, title, author, isbns) of each query the first with each set of ISBNs, or,
    without any, each title and author; ``key`` says which. Results without either are left out; null ISBNs do not count."""
    isbns = F.array_sort(F.filter(F.coalesce("isbns", F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")))
    title, author = bare(F.col("title")), bare(F.col("author"))
    key = F.when(F.size(isbns) > 0, F.array_join(isbns, ",")).when((title != "") | (author != ""), F.concat(title, F.lit("|"), author))
    rows = results.withColumn("key", key).where("key IS NOT NULL")
    first = rows.groupBy("query_id", "key").agg(F.min_by(F.struct("provider", "nth", "title", "author", "isbns"), F.struct("nth", "provider")).alias("r"))
    return first.select("query_id", "key", "r.*")


@F.pandas_udf(DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of two strings in matching blocks, longest first; 0 where one is empty."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b)])


def _bonus(known: dict[str, float], other: float) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for p in known.items() for x in p))[F.col("provider")], F.lit(other))


def ranked(results: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, nth, score, position of results for queries (query_id, text, isbns): a query that names ISBNs ranks by
    match, others by likeness of title and author and shared words; ties keep their order."""
    q = queries.select("query_id", bare(F.col("text")).alias("asked"), F.coalesce("isbns", F.array().cast("array<string>")).alias("asked_isbns"))
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: F.length(w) >= 2))
    rows = results.join(q, "query_id").withColumns({"t": bare(F.col("title")), "a": bare(F.col("author"))})
    shared = F.when(F.size(words("t")) > 0, F.size(F.array_intersect(words("asked"), words("t"))) / F.greatest(F.size(words("asked")), F.lit(1))).otherwise(0.0)
    by_text = likeness("asked", "t") * TITLE_WEIGHT + likeness("asked", "a") * AUTHOR_WEIGHT + shared * WORDS_WEIGHT + _bonus(TEXT_BONUS, OTHER_BONUS)
    by_isbn = F.coalesce(F.arrays_overlap("isbns", "asked_isbns"), F.lit(False)).cast("int") + _bonus(ISBN_BONUS, 0.0)
    scored = rows.withColumn("score", F.round(F.when(F.size("asked_isbns") > 0, by_isbn).otherwise(by_text), 6))
    return scored.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "nth")))
