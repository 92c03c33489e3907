"""Fallbacks, expansion and re-ranking over tables of queries; feed anchors."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stacklore.operators.spelling import one_edit_keys

#: Priors of source types in the re-rank.
SOURCE_PRIOR = {"BOOK": 0.04, "HIGHLIGHT": 0.05, "INSIGHT": 0.05, "PERSONAL_NOTE": 0.03}


def heuristic_rank(df: DataFrame) -> DataFrame:
    """Re-rank score of rows (base in 0..1, terms and words arrays, content_type, text)."""
    coverage = F.size(F.array_intersect("terms", "words")) / F.greatest(F.size(F.array_distinct("terms")), F.lit(1))
    tf = F.size(F.filter(F.array_distinct("terms"), lambda t: F.col("text").contains(t))) / F.greatest(F.size(F.array_distinct("terms")), F.lit(1))
    prior = F.coalesce(F.create_map(*(F.lit(x) for p in SOURCE_PRIOR.items() for x in p))[F.col("content_type")], F.lit(0.0))
    quality = F.when(F.length("text") < 40, -0.10).otherwise(F.least(F.lit(0.06), F.length("text") / 7000.0))
    return df.withColumn("rerank", F.round(100 * (0.48 * F.col("base") + 0.24 * coverage + 0.10 * tf + prior + quality), 4))


def when_few(first: DataFrame, queries: DataFrame, second: DataFrame, least: int) -> DataFrame:
    """First results, and second results of the queries that have fewer than ``least``."""
    n = queries.select("query_id").join(first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left")
    weak = n.where(F.coalesce("n", F.lit(0)) < least).select("query_id")
    more = second.join(weak, "query_id", "left_semi").join(first.select("query_id", "id"), ["query_id", "id"], "left_anti")
    return first.select("query_id", "id", F.lit(0).alias("turn")).unionByName(more.select("query_id", "id", F.lit(1).alias("turn")))


def gap_filled(pooled: DataFrame, queries: DataFrame, search: Callable[[DataFrame], DataFrame], least: int, longer: int = 7) -> DataFrame:
    """query_id, id, turn: pooled hits, and for queries (query_id, text) with fewer than ``least`` those of a search for their first two words of ``longer`` letters."""
    n = queries.join(pooled.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left").where(F.coalesce("n", F.lit(0)) < least)
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)")), lambda w: F.length(w) >= longer)
    hits = search(n.select("query_id", F.array_join(F.slice(words, 1, 2), " ").alias("text")))
    new = hits.select("query_id", "id").join(pooled.select("query_id", "id"), ["query_id", "id"], "left_anti")
    return pooled.select("query_id", "id", F.lit(0).alias("turn")).unionByName(new.select("query_id", "id", F.lit(1).alias("turn")))


def evidence_profile(evidence: DataFrame, due: str, newest: int) -> DataFrame:
    """Per tenant of ``evidence`` (tenant, kind, ref, at): how much there is, the last of it, whether that is before ``due``, and how many kinds the newest hold."""
    each = evidence.distinct()
    w = Window.partitionBy("tenant").orderBy(F.desc("at"), "kind", "ref")
    recent = each.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= newest).groupBy("tenant").agg(F.count_distinct("kind").alias("recent_kinds"))
    total = each.groupBy("tenant").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last_at"))
    return total.join(recent, "tenant").select("tenant", "n", "last_at", (F.col("last_at") < F.lit(due).cast("timestamp_ntz")).alias("refresh"), "recent_kinds")


def variations(queries: DataFrame, most: int = 3) -> DataFrame:
    """Further forms of queries of two or more words: without one word each, at most ``most``."""
    words = F.split(F.trim("text"), r"\s+")
    q = queries.withColumn("w", words).where("size(w) >= 2")
    each = q.select("query_id", "w", F.explode(F.sequence(F.lit(0), F.least(F.size("w"), F.lit(most)) - 1)).alias("i"))
    return each.select("query_id", "i", F.array_join(F.filter("w", lambda x, k: k != F.col("i")), " ").alias("text"))


def compared(rows: DataFrame, per_item: int) -> DataFrame:
    """Top rows of each query and item, and how much evidence each item has; other items get a third of that."""
    w = Window.partitionBy("query_id", "item_id").orderBy(F.desc("score"), "id")
    top = rows.withColumn("nth", F.row_number().over(w))
    room = F.when(F.col("primary"), per_item).otherwise(F.lit(per_item // 3))
    return top.where(F.col("nth") <= room).select("query_id", "item_id", "id", "nth")


def field_search(docs: DataFrame, queries: DataFrame, fields: dict[str, int]) -> DataFrame:
    """query_id, id, score: weights of fields that hold a query word, or a word one edit away from it."""
    every = None
    for name, weight in fields.items():
        own = docs.select("id", F.lit(weight).alias("weight"), F.explode(F.array_distinct(F.split(F.lower(name), r"[^\p{L}\p{N}]+"))).alias("word"))
        every = own if every is None else every.unionByName(own)
    every = every.where("length(word) >= 4")
    q = queries.select("query_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("asked")).where("length(asked) >= 4")
    keyed = lambda df, c: df.select(c).distinct().select(c, F.explode(one_edit_keys(F.col(c))).alias("key"))
    words = keyed(every, "word").join(keyed(q, "asked"), "key").where(F.levenshtein("word", "asked") <= 1).select("word", "asked").distinct()
    hits = q.join(words, "asked").join(every, "word").groupBy("query_id", "id", "asked").agg(F.max("weight").alias("w"))
    return hits.groupBy("query_id", "id").agg(F.sum("w").alias("score"))


def tree_match(tree: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Nodes (id, title, leaf) by shared words with each query; 0.35 more where the title holds the query, 0.05 less for inner nodes."""
    words = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    n = tree.select("id", "title", "leaf", words("title").alias("tw"))
    q = queries.select("query_id", F.lower("text").alias("q"), words("text").alias("qw"))
    pairs = n.withColumn("w", F.explode("tw")).join(q.withColumn("w", F.explode("qw")), "w").dropDuplicates(["query_id", "id"])
    score = F.size(F.array_intersect("tw", "qw")) / F.size("qw") + F.when(F.lower("title").contains(F.col("q")), 0.35).otherwise(0.0) - F.when(F.col("leaf"), 0.0).otherwise(0.05)
    df = pairs.withColumn("score", F.round(score, 4))
    return df.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("nth") <= k).select("query_id", "id", "score")


def patched_logs(logs: DataFrame, patch: DataFrame) -> DataFrame:
    """Log rows with their strategy as JSON, patched values over old ones."""
    p = patch.select("id", F.col("status").alias("new_status"))
    s = F.struct(F.col("intent"), F.coalesce("new_status", F.lit("logged")).alias("status"))
    return logs.join(p, "id", "left").select("id", F.to_json(s).alias("strategy"))


def reference_class(text: Column) -> tuple[Column, Column]:
    """Kind of a reference question, and the reference itself (chapter:verse or collection and number)."""
    pair = F.regexp_extract(text, r"(\d{1,3}\s*:\s*\d{1,3})", 1)
    number = F.regexp_extract(F.lower(text), r"((?:bukhari|muslim|tirmidhi)\s*#?\s*\d+)", 1)
    kind = F.when(pair != "", "exact").when(number != "", "collection").otherwise("topical")
    return kind, F.coalesce(F.nullif(F.regexp_replace(pair, r"\s", ""), F.lit("")), F.nullif(number, F.lit("")))


def discovery_pivot(links: DataFrame, content: DataFrame, seen: DataFrame, tenants: DataFrame, strength: float = 0.7) -> DataFrame:
    """tenant, pivot: a concept of the tenant's own unseen chunks that none of the chunks it has seen holds, by links of at
    least ``strength``; else the title of one of its chunks that it has seen nothing of; else null. The least of each is taken.

    ``links`` concept_id, content_id, strength; ``content`` id, tenant, title; ``seen`` tenant, content_id.
    """
    own = content.select("tenant", F.col("id").alias("content_id"))
    fresh = own.join(seen, ["tenant", "content_id"], "left_anti").join(links.where(F.coalesce("strength", F.lit(1.0)) >= strength), "content_id").select("tenant", "concept_id").distinct()
    touched = seen.join(links, "content_id").select("tenant", "concept_id")
    gap = fresh.join(touched, ["tenant", "concept_id"], "left_anti").groupBy("tenant").agg(F.min("concept_id").alias("concept_id"))
    known = seen.join(content.select(F.col("id").alias("content_id"), "title"), "content_id").select("tenant", "title")
    dormant = content.select("tenant", "title").distinct().join(known, ["tenant", "title"], "left_anti").groupBy("tenant").agg(F.min("title").alias("title"))
    pivot = F.coalesce(F.concat(F.lit("concept:"), F.col("concept_id").cast("string")), F.concat(F.lit("title:"), "title"))
    return tenants.join(gap, "tenant", "left").join(dormant, "tenant", "left").select("tenant", pivot.alias("pivot"))


def topic_anchor(notes: DataFrame, least: int = 3, newest: int = 10) -> DataFrame:
    """Per tenant the mean of the newest note vectors by position, where there are enough."""
    w = Window.partitionBy("tenant").orderBy(F.desc("created_at"), F.desc("id"))
    n = notes.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= newest)
    enough = n.groupBy("tenant").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("tenant")
    each = n.join(enough, "tenant").select("tenant", F.posexplode("vec").alias("i", "x")).groupBy("tenant", "i").agg(F.avg("x").alias("x"))
    return each.groupBy("tenant").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("anchor"))


def normalised_payloads(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Provider payloads (id, json with title, authors, topics) as entities and typed weighted edges; self-edges go."""
    p = payloads.withColumn("p", F.from_json("json", "title STRING, authors ARRAY<STRING>, topics ARRAY<STRING>")).select("id", "p.*")
    book = p.select(F.concat(F.lit("book:"), F.lower("title")).alias("key"), F.col("title").alias("label"), F.lit("BOOK").alias("kind"))
    part = lambda c, kind: p.select(F.concat(F.lit("book:"), F.lower("title")).alias("src"), F.explode(c).alias("label")).withColumn("kind", F.lit(kind))
    ends = part("authors", "AUTHOR").unionByName(part("topics", "TOPIC")).withColumn("dst", F.concat(F.lower("kind"), F.lit(":"), F.lower("label")))
    entities = book.unionByName(ends.select(F.col("dst").alias("key"), "label", "kind")).groupBy("key").agg(F.max("label").alias("label"), F.max("kind").alias("kind"))
    edges = ends.where("src <> dst").groupBy("src", "dst").agg(F.max(F.when(F.col("kind") == "AUTHOR", 1.0).otherwise(0.7)).alias("weight"))
    return entities, edges


#: Marks of answers to kinds of questions, words that connect thoughts, and headings of answer modes.
DEFINING, COMPARING = ("tanım", "demektir"), ("fark", "benzer", "birincisi", "oysa", "diğer yandan")
CONNECTING = (
    "dolayısıyla", "ilişkili", "çelişki", "paradoks", "sentez", "bağlamında", "fakat", "oysaki", "öte yandan", "bu durum", "relationship", "correlation", "however",
    "context", "synthesis",
)
HEADINGS = {"QUOTE": ("Doğrudan Tanımlar", "Bağlamsal Analiz"), "HYBRID": ("Karşıt Görüşler", "Bağlamsal Kanıtlar")}
#: Looks of misread text; each takes 0.3 off.
MISREAD = (r"\d[a-z]{2,}", r"[;:~]{2,}", r"\bc;")


def answer_scores(df: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """id and rule scores (0..1) of answers (id, question, answer, intent, mode, similarity of question and answer, chunk): relevance,
    ocr (share of known words, less for looks of misread text), depth (own words and connecting ones), format. ``vocabulary`` has fix."""
    q, a = F.lower("question"), F.lower("answer")
    none = lambda text, marks: ~F.coalesce(*(F.when(text.contains(m), True) for m in marks), F.lit(False))
    sim = F.col("similarity")
    base = F.when(sim >= 0.85, 1.0).when(sim >= 0.70, 0.7 + (sim - 0.70) * 2).otherwise(sim)
    off = F.when((F.col("intent") == "DIRECT") & q.contains("nedir") & none(a, DEFINING), 0.8).when((F.col("intent") == "COMPARATIVE") & none(a, COMPARING), 0.7).otherwise(1.0)
    relevance = F.greatest(F.lit(0.0), F.least(F.lit(1.0), base * off))
    # words that the vocabulary knows: each distinct word of an answer meets it once
    words = F.filter(F.split("answer", r"\s+"), lambda w: w != "")
    each = df.select("id", F.explode(words).alias("w")).withColumn("plain", F.col("w").rlike(r"^\p{N}+$") | (F.length("w") < 3))
    told = each.join(vocabulary.select(F.col("fix"), F.lit(1).alias("known")).distinct(), F.lower("w") == F.col("fix"), "left")
    fluent = told.groupBy("id").agg((F.count_if(F.col("plain") | F.col("known").isNotNull()) / F.count(F.lit(1))).alias("fluency"))
    misread = sum((F.when(F.col("answer").rlike(p), 0.3).otherwise(0.0) for p in MISREAD), F.lit(0.0))
    ocr = F.when(F.col("fluency").isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), F.col("fluency") - misread))
    parts = F.split(a, r"[.!?]\s+")
    copied = F.size(F.filter(parts, lambda s: (F.length(s) >= 20) & F.lower("chunk").contains(s))) / F.greatest(F.size(parts), F.lit(1))
    links = sum((a.contains(c).cast("int") for c in CONNECTING), F.lit(0))
    depth = 0.8 * F.when(copied > 0.8, 0.3).when(copied > 0.4, 0.6).otherwise(1.0)
    depth = F.when(links >= 5, depth + 0.2).when((links < 3) & (F.col("mode") == "EXPLORER"), depth * 0.7).otherwise(depth)
    depth = F.when(F.col("mode").isin("EXPLORER", "SYNTHESIS"), F.least(F.lit(1.0), depth)).otherwise(1.0)
    missing = F.lit(False)
    for mode, heads in HEADINGS.items():
        missing = missing | ((F.col("mode") == mode) & ~(F.col("answer").contains(f"## {heads[0]}") & F.col("answer").contains(f"## {heads[1]}")))
    formatted = F.when(missing, 0.4).otherwise(0.9)
    return df.join(fluent, "id", "left").select("id", F.round(relevance, 4).alias("relevance"), F.round(ocr, 4).alias("ocr"), F.round(depth, 4).alias("depth"), formatted.alias("format"))


def without_repeats(df: DataFrame, order: list[str], chunk: Column) -> DataFrame:
    """Per query, rows in order whose key differs from that of the row before.

    ``chunk`` cuts each query's rows into runs that keep the order (a day, a page of ranks), so a query that holds
    a third of all rows is spread over its runs; only the last key of each run goes on to the next one.
    """
    d = df.withColumn("chunk", chunk)
    last = d.groupBy("query_id", "chunk").agg(F.max_by("key", F.struct(*order)).alias("last"))
    before = last.select("query_id", "chunk", F.lag("last").over(Window.partitionBy("query_id").orderBy("chunk")).alias("brought"))
    own = F.lag("key").over(Window.partitionBy("query_id", "chunk").orderBy(*order))
    told = d.withColumn("own", own).withColumn("first", F.row_number().over(Window.partitionBy("query_id", "chunk").orderBy(*order)) == 1)
    told = told.join(before, ["query_id", "chunk"]).withColumn("before", F.when(F.col("first"), F.col("brought")).otherwise(F.col("own")))
    return told.where(F.col("before").isNull() | (F.col("before") != F.col("key"))).select("query_id", "id")


def windowed_dedupe(df: DataFrame, window: int, head: int) -> DataFrame:
    """Of the first ``head`` rows of each query by rank, those whose key none of the last ``window`` kept rows has."""

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        kept, out = [], []
        for i, k in pdf.sort_values("rank")[["id", "key"]].itertuples(index=False):
            if k not in kept[-window:]:
                kept.append(k)
                out.append(i)
        return pd.DataFrame({"query_id": [pdf["query_id"].iloc[0]] * len(out), "id": out})

    return df.select("query_id", "id", "rank", "key").where(F.col("rank") <= head).groupBy("query_id").applyInPandas(keep, "query_id string, id long")


def table_chunks(tables: DataFrame, rows_each: int) -> DataFrame:
    """Tables (id, title, lines with the header first) in pieces that repeat title and header."""
    body = F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))
    t = tables.withColumn("body", body).withColumn("pieces", F.greatest(F.ceil(F.size("body") / rows_each), F.lit(1)).cast("int"))
    t = t.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    part = F.slice("body", F.col("piece") * rows_each + 1, F.lit(rows_each))
    return t.select("id", "piece", F.array_join(F.concat(F.array("title", F.element_at("lines", 1)), part), "\n").alias("text"))
