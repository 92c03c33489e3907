"""Hybrid search for a table of queries: two word lanes and a vector lane, routed, fused and paged.

Each lane reads the corpus once. A task holds its rows against all queries of a block and keeps
the first ``pool`` of each query, so what is shuffled is at most ``pool`` rows for each query,
lane and task, however many rows match. Fusion, policies and paging then see a bounded number
of rows of a query.

Null texts match no words, null vectors nothing. Rows that repeat an id are hits of their own in a
lane and one result. Ties go to the smaller id.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stacklore.functions.text import normalize_text
from stacklore.operators.filters import semantic_quality
from stacklore.operators.retrieval import RANK_CONSTANT, WEIGHTS, route, tail_cap

#: Queries that are broadcast at a time (a few hundred bytes each), and query rows of one matrix product.
BLOCK, STEP = 50_000, 256
#: Lemmas of a query that count, and the fewest letters of one.
LEMMAS, LEAST_LEMMA = 5, 3
TOKEN = re.compile(r"[a-z0-9]+")
LANES = ("exact", "lemma", "semantic")
#: Kinds of intent, and the order of sources that comes before scores.
DIRECT = ("DIRECT", "CITATION_SEEKING", "FOLLOW_UP")
BROAD = ("SYNTHESIS", "NARRATIVE", "SOCIETAL", "COMPARATIVE")
PRIORITY = {"BOOK": 1.0, "ARTICLE": 2.0, "HIGHLIGHT": 3.0, "INSIGHT": 4.0, "PERSONAL_NOTE": 5.0, "WEBSITE": 6.0, "MOVIE": 6.0, "SERIES": 6.0}
REPORT, REPORT_PRIORITY, OTHER_PRIORITY = r"<h1>research report|<h2>final answer", 5.8, 7.0


def source_priority(kind: Column, text: Column) -> Column:
    """Books first, then articles, highlights, insights, notes, generated reports among notes, web and film, the rest."""
    kind = F.upper(F.trim(kind))
    out = F.when((kind == "PERSONAL_NOTE") & F.lower(text).rlike(REPORT), REPORT_PRIORITY)
    for name, value in PRIORITY.items():
        out = out.when(kind == name, value)
    return out.otherwise(OTHER_PRIORITY)


class Heads:
    """The first ``most`` entries of each query by key; larger keys come first."""

    def __init__(self, most: int):
        self.most, self.of = most, {}

    def add(self, query: int, key: tuple) -> None:
        head = self.of.setdefault(query, [])
        if len(head) < self.most:
            heapq.heappush(head, key)
        elif key > head[0]:
            heapq.heapreplace(head, key)


HITS = "query_id long, id long, lane string, score double, priority double"


def _hits(found: dict[str, Heads]) -> pa.RecordBatch:
    """Entries (-priority, score, -id) of each lane as rows."""
    rows = [(q, -i, lane, s, -p) for lane, heads in found.items() for q, head in heads.of.items() for p, s, i in head]
    columns = zip(*rows) if rows else [()] * 5
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["query_id", "id", "lane", "score", "priority"])


def word_hits(words: list[str], title: str, lemmas: list[str]) -> float | None:
    """Score of a text for a query's lemmas, None without a hit: words that begin with a lemma, and four more for such a word of the title.

    A lone hit of a lone lemma that the title holds inside a word only is none.
    """
    able = [x for x in lemmas if len(x) >= LEAST_LEMMA]
    n = sum(w.startswith(x) for w in words for x in able)
    if not n:
        return None
    in_title = any(w.startswith(x) for w in TOKEN.findall(title) for x in able)
    if len(lemmas) == 1 and n == 1 and lemmas[0] in title and not in_title:
        return None
    return min(95.0, 70.0 + 5.0 * n + 4.0 * in_title)


def _word_lanes(asked, pool: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = {"exact": Heads(pool), "lemma": Heads(pool)}
        whole: dict[str, list] = {}
        starts: dict[str, list] = {}
        for query, words, lemmas in asked.value:
            if words:
                whole.setdefault(max(words, key=len), []).append((query, set(words)))
            for x in lemmas:
                if len(x) >= LEAST_LEMMA:
                    starts.setdefault(x[:LEAST_LEMMA], []).append((x, query))
        lemmas_of = {query: lemmas for query, _, lemmas in asked.value}
        for batch in batches:
            for i, text, title, priority in zip(*(c.to_pylist() for c in batch.columns)):
                words = TOKEN.findall(text or "")
                there = set(words)
                for w in there.intersection(whole):
                    for query, all_of in whole[w]:
                        if all_of <= there:
                            heads["exact"].add(query, (-priority, 100.0, -i))
                met = {q for w in there for x, q in starts.get(w[:LEAST_LEMMA], ()) if w.startswith(x)}
                for query in met:
                    if (score := word_hits(words, title or "", lemmas_of[query])) is not None:
                        heads["lemma"].add(query, (-priority, score, -i))
        yield _hits(heads)

    return run


def _vector_lane(asked, pool: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = asked.value
        head = Heads(pool)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            vecs = np.array(batch.column(1).to_pylist(), np.float64).reshape(len(ids), -1)
            length = np.sqrt((vecs * vecs).sum(axis=1, keepdims=True))
            vecs = vecs / np.where(length > 0, length, 1.0)
            for at in range(0, len(names), STEP):
                sims = np.maximum(np.round(matrix[at : at + STEP] @ vecs.T, 6), 0.0)
                # only what can be among the first of this batch
                for query, row in zip(names[at : at + STEP], sims):
                    best = np.lexsort((ids, -row))[:pool] if len(row) <= 4 * pool else _first(row, ids, pool)
                    for j in best.tolist():
                        head.add(query, (0.0, float(row[j]) * 100, -int(ids[j])))
        yield _hits({"semantic": head})

    return run


def _first(row: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    able = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k])
    return able[np.lexsort((ids[able], -row[able]))[:k]]


def _blocks(queries: DataFrame, columns: list[str]) -> Iterator[list]:
    """Rows of ``queries`` in blocks of about ``BLOCK``."""
    n = -(-queries.count() // BLOCK)
    for k in range(n):
        part = queries.select(*columns)
        yield (part if n == 1 else part.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == k)).collect()


def lanes(content: DataFrame, vectors: DataFrame, queries: DataFrame, pool: int) -> DataFrame:
    """query_id, id, lane, score, priority: the first ``pool`` hits of each query in each lane.

    ``content`` has id, content_type, title and text; ``vectors`` id and vec; ``queries`` query_id, text, lemmas
    and vec. Word lanes order by priority of the source, then score; the vector lane by cosine similarity.
    """
    context = content.sparkSession.sparkContext
    text, title, kind = F.col("text"), F.col("title"), F.col("content_type")
    docs = content.select("id", normalize_text(text).alias("text"), normalize_text(title).alias("title"), source_priority(kind, text).alias("priority"))
    fold = lambda c: F.transform(c, lambda x: normalize_text(x))
    asked = queries.select("query_id", normalize_text(F.col("text")).alias("text"), fold(F.coalesce("lemmas", F.array().cast("array<string>"))).alias("lemmas"), "vec")
    parts = []
    for rows in _blocks(asked, ["query_id", "text", "lemmas"]):
        told = [(r["query_id"], sorted(set(TOKEN.findall(r["text"]))), list(dict.fromkeys(x for x in r["lemmas"] if len(x) > 1))[:LEMMAS]) for r in rows]
        parts.append(docs.mapInArrow(_word_lanes(context.broadcast(told), pool), HITS))
    for rows in _blocks(asked.where("vec IS NOT NULL"), ["query_id", "vec"]):
        matrix = np.array([r["vec"] for r in rows], np.float64)
        length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
        told = ([r["query_id"] for r in rows], matrix / np.where(length > 0, length, 1.0))
        parts.append(vectors.where("vec IS NOT NULL").select("id", "vec").mapInArrow(_vector_lane(context.broadcast(told), pool), HITS))
    if not parts:
        return content.sparkSession.createDataFrame([], f"{HITS}, rank int")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    # the vector lane's priority counts only in the tie of the fused order
    order = Window.partitionBy("query_id", "lane").orderBy("priority", F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= pool)


def routed(hits: DataFrame, queries: DataFrame, pool: int) -> DataFrame:
    """``hits`` of the lanes that each query's route opens; the vector lane opens, cut at 20 to 100 rows, where no word lane has a hit."""
    mode = queries.select("query_id", "intent", route(F.col("text"), F.col("intent")).alias("mode"), F.size(F.split(F.trim("text"), r"\s+")).alias("n_words"))
    both = hits.join(mode, "query_id")
    worded = F.max((F.col("lane") != "semantic").cast("int")).over(Window.partitionBy("query_id"))
    rescue = (worded == 0) & (F.col("rank") <= max(20, min(100, pool)))
    return both.withColumn("rescue", rescue).where((F.col("lane") != "semantic") | (F.col("mode") != "fast_exact") | F.col("rescue"))


def weight(intent: Column, lane: Column) -> Column:
    """The weight of a lane by the kind of intent."""
    kind = F.when(intent.isin(*DIRECT), "direct").when(intent.isin(*BROAD), "broad").otherwise("other")
    out = F.lit(0.0)
    for name, weights in WEIGHTS.items():
        for w, one in zip(weights, LANES):
            out = F.when((kind == name) & (lane == one), w).otherwise(out)
    return out


def fused(hits: DataFrame) -> DataFrame:
    """query_id, id, rrf, lane (the first), score (the best), n_words: one row for each result."""
    lane = F.array_position(F.array(*map(F.lit, LANES)), F.col("lane"))
    each = hits.select("*", lane.alias("nth"), (weight(F.col("intent"), F.col("lane")) / (RANK_CONSTANT + F.col("rank"))).alias("part"))
    return each.groupBy("query_id", "id").agg(
        F.sum("part").alias("rrf"), F.min(F.struct("nth", "lane")).getField("lane").alias("lane"), F.max("score").alias("score"), F.first("n_words").alias("n_words")
    )


def placed(found: DataFrame, content: DataFrame) -> DataFrame:
    """``found`` (query_id, id, rrf, lane, score) with content_type, title and text, and each result's place in ``pos``."""
    # a bounded number of hits for each query meets the corpus by id
    told = found.join(content.select("id", "content_type", "title", "text"), "id").withColumn("source", source_priority(F.col("content_type"), F.col("text")))
    lane = F.array_position(F.array(*map(F.lit, LANES)), F.col("lane"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf", 9)), lane, "source", F.desc(F.round("score", 6)), "id")
    return told.withColumn("pos", F.row_number().over(order))


def with_tail(found: DataFrame, most: int, guard: bool, adaptive_cap: bool = True) -> DataFrame:
    """Word hits in their order, then a capped tail of hits of the vector lane alone.

    ``found`` has query_id, id, pos, lane, score, content_type, title, text, n_words. With ``guard`` the tail leaves out
    poor texts and scores below max(2, 0.35 of the best), unless nothing would be left. Types that the word hits hold come
    first. A query of one word has a cap by the number of word hits.
    """
    q = Window.partitionBy("query_id")
    tail = F.col("lane") == "semantic"
    able = tail & (semantic_quality(F.col("text"), F.col("title"), F.col("content_type")) if guard else F.lit(True))
    df = found.where(~tail | able).withColumn("tail", tail)
    df = df.withColumn("n_lexical", F.count(F.when(~F.col("tail"), 1)).over(q)).withColumn("top", F.max(F.when(F.col("tail"), F.col("score"))).over(q))
    df = df.withColumn("types", F.collect_set(F.when(~F.col("tail"), F.upper("content_type"))).over(q))
    floor = F.when(F.col("top") > 0, F.greatest(F.lit(2.0), F.col("top") * 0.35)).otherwise(0.0) if guard else F.lit(0.0)
    df = df.withColumn("ok", F.col("score") >= floor).withColumn("any_ok", F.max(F.when(F.col("tail"), F.col("ok"))).over(q))
    by_score = Window.partitionBy("query_id", "tail").orderBy(F.desc("score"), "pos")
    df = df.withColumn("nth", F.row_number().over(by_score)).where(~F.col("tail") | F.col("ok") | (~F.col("any_ok") & (F.col("nth") <= max(most, 3))))
    other = (~F.array_contains("types", F.upper("content_type"))).cast("int")
    ordered = Window.partitionBy("query_id", "tail").orderBy(other, "nth")
    cap = F.when(F.col("n_words") == 1, tail_cap(F.col("n_lexical"))).otherwise(most) if adaptive_cap else F.lit(most)
    df = df.withColumn("nth", F.when(F.col("tail"), F.row_number().over(ordered)).otherwise(F.col("pos")))
    return df.where(~F.col("tail") | (F.col("nth") <= cap)).withColumn("pos", F.row_number().over(q.orderBy("tail", "nth")))


def hybrid_search(content: DataFrame, vectors: DataFrame, queries: DataFrame, pool: int = 100, limit: int = 20, offset: int = 0, tail: int | None = None, guard: bool = True) -> DataFrame:
    """query_id, pos, id, lane, score, rrf: the page from ``offset`` of each query's results.

    ``queries`` has query_id, text, intent, lemmas and vec. ``tail`` puts word hits first and caps what the vector lane
    adds behind them; without it results stay in the fused order.
    """
    found = fused(routed(lanes(content, vectors, queries, pool), queries, pool))
    told = placed(found, content)
    if tail is not None:
        told = with_tail(told, tail, guard)
    return told.where((F.col("pos") > offset) & (F.col("pos") <= offset + limit)).select("query_id", "pos", "id", "lane", "score", "rrf")
