"""Citations of answers, and whether the cited sources say what is cited."""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The two forms of a citation, letters that are looked at before one, words of a run, and bands of likeness.
BY_NUMBER, BY_TITLE = re.compile(r"\[ID:\s*(\d+)\]"), re.compile(r"\[Kaynak:\s*(.*?)\]")
REACH, RUN = 200, 5
LIKE, NEAR = (0.82, 0.9), (0.65, 0.5)
UNCITED = 0.6
#: Likeness of titles at which one is taken for the other, and what shared words and letters make of it.
TITLE, WORDS, LETTERS, BOTH = 0.78, 0.75, 0.60, 0.85

CITED = T.ArrayType(T.StructType([T.StructField("number", T.LongType()), T.StructField("title", T.StringType()), T.StructField("text", T.StringType())]))


@F.pandas_udf(CITED)
def citations(answers: pd.Series) -> pd.Series:
    """Each citation with its source's number or title and the last line of what stands before it."""

    def found(answer: str | None) -> list[dict]:
        answer = answer or ""
        said = lambda m: answer[max(0, m.start() - REACH) : m.start()].strip().split("\n")[-1]
        numbers = [{"number": int(m[1]), "title": None, "text": said(m)} for m in BY_NUMBER.finditer(answer)]
        return numbers + [{"number": None, "title": m[1].strip(), "text": said(m)} for m in BY_TITLE.finditer(answer)]

    return answers.map(found)


def plain_title(title: Column) -> Column:
    """Small ASCII letters, digits and single blanks; marks are folded away."""
    folded = F.translate(F.coalesce(title, F.lit("")), "çÇğĞıİöÖşŞüÜâÂîÎûÛéèêëáàäíìïóòôúùñ", "ccggiioossuuaaiiuueeeeaaaiiiooouun")
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(folded), r"[^a-z0-9\s]", " "), r"\s+", " "))


@F.pandas_udf(T.DoubleType())
def letter_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the letters in matching runs, as a share of all letters."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def word_share(text: Column, content: Column) -> Column:
    """Share of a text's words that stand in a content: the likeness where no embedding is at hand."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != ""))
    return F.size(F.array_intersect(words(text), words(content))) / F.greatest(F.size(words(text)), F.lit(1))


def _by_title(cited: DataFrame, sources: DataFrame) -> DataFrame:
    """answer_id, at, nth of the source that each title means: the first that holds it or is held by it, else the likest."""
    pairs = cited.where("title IS NOT NULL").select("answer_id", "at", plain_title(F.col("title")).alias("t")).where("t <> ''")
    pairs = pairs.join(sources.select("answer_id", "nth", plain_title(F.col("title")).alias("s")).where("s <> ''"), "answer_id")
    words = lambda c: F.array_distinct(F.split(c, " "))
    shared = F.size(F.array_intersect(words("t"), words("s"))) / F.size(F.array_union(words("t"), words("s")))
    pairs = pairs.select("*", (F.contains("s", "t") | F.contains("t", "s")).alias("held"), shared.alias("shared"), letter_ratio("t", "s").alias("letters"))
    like = F.greatest("shared", "letters", F.when((F.col("shared") >= WORDS) & (F.col("letters") >= LETTERS), BOTH).otherwise(0.0))
    order = Window.partitionBy("answer_id", "at").orderBy(F.desc("held"), F.when(F.col("held"), 0.0).otherwise(-like), "nth")
    return pairs.withColumn("rank", F.row_number().over(order)).where((F.col("rank") == 1) & (F.col("held") | (like >= TITLE))).select("answer_id", "at", F.col("nth").alias("meant"))


def verified(answers: DataFrame, sources: DataFrame, likeness: Callable[[Column, Column], Column] = word_share) -> DataFrame:
    """answer_id, score, n_citations, violations (sorted) of each of ``answers`` (answer_id, answer).

    ``sources`` has answer_id, nth (from 1), title and content. A citation counts in full where five of its words on end stand in
    its source; else by ``likeness`` of its text to the source. One whose source is missing counts nothing, and an answer without
    citations has a score of its own.
    """
    cited = answers.select("answer_id", F.posexplode(citations("answer")).alias("at", "c")).select("answer_id", "at", "c.*")
    meant = cited.join(_by_title(cited, sources), ["answer_id", "at"], "left")
    meant = meant.withColumn("nth", F.coalesce("number", "meant"))
    known = meant.join(sources.select("answer_id", "nth", F.lower(F.coalesce("content", F.lit(""))).alias("content")), ["answer_id", "nth"], "left")
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    starts = F.when(F.size("words") > RUN, F.sequence(F.lit(1), F.size("words") - RUN)).otherwise(F.array().cast("array<int>"))
    run = F.exists(starts, lambda i: F.contains(F.col("content"), F.array_join(F.slice("words", i, RUN), " ")))
    told = known.withColumn("words", words).withColumn("run", run).withColumn("like", likeness(F.col("text"), F.col("content")))
    lost, like = F.col("content").isNull(), F.col("like")
    score = F.when(lost, 0.0).when(F.col("run"), 1.0).when(like >= LIKE[0], LIKE[1]).when(like >= NEAR[0], NEAR[1]).otherwise(0.0)
    fault = F.when(lost, "wrong_source").when(F.col("run") | (like >= LIKE[0]), None).when(like >= NEAR[0], "hallucination_risk").otherwise("fabricated_quote")
    sums = told.groupBy("answer_id").agg(F.avg(score).alias("score"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(fault)).alias("faults"))
    out = answers.select("answer_id").join(sums, "answer_id", "left")
    none = F.array(F.lit("no_citations_for_verification"))
    return out.select("answer_id", F.coalesce("score", F.lit(UNCITED)).alias("score"), F.coalesce("n", F.lit(0)).alias("n_citations"), F.coalesce("faults", none).alias("violations"))
