"""Lexical retrieval, fusion and re-ranking for a table of queries."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stacklore.functions.text import FOLD_FROM, FOLD_TO, normalize_text
from stacklore.operators.filters import whole_term

#: Bucket weights by kind of intent, and the rank constant.
WEIGHTS = {"direct": (0.55, 0.30, 0.15), "broad": (0.20, 0.20, 0.60), "other": (0.34, 0.33, 0.33)}
RANK_CONSTANT = 60


#: Phrases of a direct look-up, words of a question about a concept, and intents of a direct question.
DIRECT_PHRASES = ("hangi sayfa", "kitap adi", "kitabi adi", "kitabin adi", "kim dedi", "kim soyledi", "tam alinti")
CONCEPT_WORDS = ("nedir", "neden", "nasil", "anlami", "kavram", "kavramsal", "etik", "ahlak", "felsefe", "adalet", "vicdan", "ozgurluk")
DIRECT_INTENTS = ("DIRECT", "CITATION_SEEKING", "FOLLOW_UP")
QUOTED = '"[^"]+"'
#: Lanes that each mode opens, in order.
LANES_OF = {"fast_exact": ("exact", "lemma"), "semantic_focus": ("lemma", "semantic", "exact"), "balanced": ("exact", "lemma", "semantic")}


def route(text: Column, intent: Column) -> Column:
    """Retrieval mode of a query, whose marks are folded away; short questions and all others are balanced."""
    low = F.translate(F.lower(F.translate(F.coalesce(text, F.lit("")), "Iİ", "ıi")), FOLD_FROM, FOLD_TO)
    words = F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}]+)"))
    concept = F.arrays_overlap(words, F.array(*map(F.lit, CONCEPT_WORDS))) & (F.size(words) > 1)
    phrase = low.rlike(rf"(^|[^\p{{L}}\p{{N}}_])({'|'.join(DIRECT_PHRASES)})($|[^\p{{L}}\p{{N}}_])")
    return F.when(phrase | text.rlike(QUOTED), "fast_exact").when(concept, "semantic_focus").when(intent.isin(*DIRECT_INTENTS), "fast_exact").otherwise("balanced")


def lanes_of(mode: Column) -> Column:
    """The lanes of a mode, in order."""
    out = F.array(*map(F.lit, LANES_OF["balanced"]))
    for name, lanes in LANES_OF.items():
        out = F.when(mode == name, F.array(*map(F.lit, lanes))).otherwise(out)
    return out


def in_order(hits: DataFrame, lanes: tuple[str, ...]) -> DataFrame:
    """query_id, id, lane, rank, pos: hits (query_id, id, lane, rank) lane by lane, each result at its first place."""
    prio = F.array_position(F.array(*map(F.lit, lanes)), F.col("lane"))
    first = hits.groupBy("query_id", "id").agg(F.min(F.struct(prio.alias("prio"), "rank", "lane")).alias("f"))
    return first.select("query_id", "id", "f.*").withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("prio", "rank", "id")))


def tail_cap(n_lexical: Column) -> Column:
    """How many semantic rows may follow for a one-word query."""
    return F.when(n_lexical > 30, 2).when(n_lexical >= 20, 3).when(n_lexical >= 10, 4).otherwise(5)


def terms_of(df: DataFrame, ident: str, text: str = "text") -> DataFrame:
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return df.select(F.col(ident), F.explode(words).alias("term")).where("term <> ''")


#: Letters of a text that the head of a match is scored by.
HEAD = 2500


def exact_search(chunks: DataFrame, asked: str) -> DataFrame:
    """id, score, position of chunks (id, text, created_at) that hold all words of a query as whole terms, newest first; where
    no chunk does, those that hold the query letter by letter."""
    low = F.lower("text")
    words = list(dict.fromkeys(w for w in asked.lower().split() if w))
    if not words:
        return chunks.limit(0).select("id", F.lit(100).alias("score"), F.lit(1).alias("position"))
    whole = reduce(and_, (whole_term(low, w) for w in words))
    found = chunks.where(whole)
    kept = found if found.limit(1).count() else chunks.where(low.contains(asked.lower()))
    return kept.select("id", F.lit(100).alias("score"), F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("id"))).alias("position"))


def reranked(base: DataFrame, docs: DataFrame, queries: DataFrame, weight: float = 0.35) -> DataFrame:
    """query_id, id, blend: base scores of hits with the BM25 of their first ``HEAD`` letters and title, scaled to 0..1 within each query."""
    head = docs.select("id", F.concat_ws(" ", F.substring("text", 1, HEAD), "title").alias("text"))
    both = base.join(bm25(head, queries), ["query_id", "id"], "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
    return blended(both, "base", "bm25", weight).select("query_id", "id", "blend")


#: Rows of a table of query terms up to which it is broadcast (some tens of bytes each); beyond it both sides are shuffled.
SMALL = 500_000


def if_small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """``df`` with a hint to broadcast it, if it is counted to have at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def term_hits(docs: DataFrame, queries: DataFrame, word: str = r"[\p{L}\p{N}]+") -> DataFrame:
    """query_id, id, score: how many distinct words of a query (query_id, text) stand in a document (id, text).

    A document's words meet the few query terms before anything is shuffled; only hits are.
    """
    words = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(f"({word})"))))
    asked = queries.select("query_id", words("text").alias("term"))
    return docs.select("id", words("text").alias("term")).join(if_small(asked), "term").groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("score"))


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, delta: float = 0.0) -> DataFrame:
    """query_id, id, bm25 over the whole corpus, whose words meet the query terms before
    anything is shuffled; a document's length comes along with them."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    split = docs.select("id", words.alias("words"))
    size = split.agg(F.count(F.lit(1)).alias("docs"), F.avg(F.size("words")).alias("avg_len"))  # one row
    asked = terms_of(queries, "query_id").distinct()
    each = split.select("id", F.size("words").alias("len"), F.explode("words").alias("term"))
    tf = each.join(if_small(asked.select("term").distinct()), "term", "left_semi").groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = tf.join(df, "term").join(asked, "term").join(F.broadcast(size))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len"))) + delta
    return rows.groupBy("query_id", "id").agg(F.sum(idf * part).alias("bm25"))


def blended(df: DataFrame, base: str, extra: str, w: float) -> DataFrame:
    p = Window.partitionBy("query_id")
    lo, hi = F.min(extra).over(p), F.max(extra).over(p)
    norm = F.when(hi > lo, (F.col(extra) - lo) / (hi - lo)).otherwise(0.0)
    return df.withColumn("blend", (1 - w) * F.col(base) + w * norm)


def mmr(df: DataFrame, keep: int, lam: float = 0.7) -> DataFrame:
    """Greedy choice of relevant and unlike rows: query_id, id, pos. The head of each
    query must be bounded; terms is an array, score the relevance."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True])
        sets, left, out = [set(t) for t in pdf["terms"]], list(range(len(pdf))), []
        top = max(pdf["score"].max(), 1e-12)
        rel = (pdf["score"] / top).tolist()
        worst = [0.0] * len(pdf)
        while left and len(out) < keep:
            best = max(left, key=lambda i: (lam * rel[i] - (1 - lam) * worst[i], -i))
            out.append(best)
            left.remove(best)
            for i in left:
                union = len(sets[i] | sets[best])
                worst[i] = max(worst[i], len(sets[i] & sets[best]) / union if union else 0.0)
        order = out + left
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[order].values, "id": pdf["id"].iloc[order].values, "pos": range(1, len(order) + 1)})

    return df.select("query_id", "id", "score", "terms").groupBy("query_id").applyInPandas(choose, "query_id long, id long, pos long")


def promoted(df: DataFrame, score: str, n: int) -> DataFrame:
    """Only the n best by a second score move to the front; the others keep their order."""
    w = Window.partitionBy("query_id")
    df = df.withColumn("by_score", F.row_number().over(w.orderBy(F.desc(score), "pos")))
    key = F.when(F.col("by_score") <= n, F.col("by_score")).otherwise(n + F.col("pos"))
    return df.withColumn("new_pos", F.row_number().over(w.orderBy(key, "pos"))).drop("by_score")


#: Words that say nothing of a question, for boosts and for a wider question, and ceilings of the score by kind of match.
BOOST_STOP = (
    "ve", "veya", "ile", "ama", "fakat", "ancak", "lakin", "ki", "de", "da", "mi", "mu", "mı", "mü", "bir", "bu", "şu", "o", "ben", "sen", "biz", "siz", "onlar",
    "gibi", "için", "diye", "en", "daha", "çok", "her", "hangi", "ne", "kim", "bunu", "şunu", "böyle", "şöyle",
)
STEP_BACK_STOP = (
    "ve", "veya", "ile", "icin", "gibi", "kadar", "daha", "cok", "az", "mi", "midir", "nedir", "nasil", "neden", "hangi", "bu", "su", "o", "da", "de", "ki", "ya",
    "ama", "fakat", "ancak", "bir", "iki", "uc", "dort", "bes", "konu", "sey", "durum", "metin", "icerik", "yapi", "ornek", "acikla", "aciklama",
)
CEILINGS, NO_CEILING = {"exact_deaccented": 150, "lemma_exact": 110, "lemma_fuzzy": 100, "semantic": 85}, 150
IN_NOTE, IN_TAGS, IN_TITLE, EACH_TOKEN, TOKENS_MOST, CORRECTED = 20, 15, 10, 5, 25, 5


def boosted(hits: DataFrame, tokens: list[str]) -> DataFrame:
    """``hits`` with boost, score and kind as shown: five for each token of the question in the text (25 at most), the best of a token in the
    note (20), the tags (15) and the title (10), five for a corrected match, cut at the ceiling of the kind of match.

    ``hits`` has score, kind, text, title, tags, comment (plain strings or null) and corrected; ``in_content`` says whether a token of three
    letters stands in the text, which sorts before the score.
    """
    able = [normalize_token(t) for t in tokens if t.lower() not in BOOST_STOP]
    fold = lambda c: normalize_text(F.coalesce(c, F.lit("")))
    text, note, tags, title = (fold(F.col(c)) for c in ("text", "comment", "tags", "title"))
    n = sum((text.contains(t).cast("int") for t in able), F.lit(0))
    holds = lambda c, ts: reduce(or_, (c.contains(t) for t in ts), F.lit(False))
    place = F.when(holds(note, able), IN_NOTE).when(holds(tags, able), IN_TAGS).when(holds(title, able), IN_TITLE).otherwise(0)
    more = F.least(n * EACH_TOKEN, F.lit(TOKENS_MOST)) + place + F.when(F.coalesce("corrected", F.lit(False)), CORRECTED).otherwise(0)
    top = F.lit(NO_CEILING)
    for kind, most in CEILINGS.items():
        top = F.when(F.col("kind") == kind, most).otherwise(top)
    shown = F.when(place >= IN_NOTE, "insight_match").when(place >= IN_TAGS, "tag_match").otherwise(F.col("kind"))
    df = hits.withColumns({"boost": more, "score": F.least(F.col("score") + more, top).cast("double"), "shown": shown})
    return df.withColumn("in_content", holds(text, [normalize_token(t) for t in tokens if len(t) >= 3]))


def normalize_token(token: str) -> str:
    """A token as ``normalize_text`` leaves it."""
    low = token.replace("I", "ı").replace("İ", "i").lower()
    return "".join(c for c in low if c.isalnum() or c in "_ ").strip().translate(str.maketrans(FOLD_FROM, FOLD_TO))


def step_back(question: Column, keywords: Column, least: int = 4, most: int = 4) -> Column:
    """A wider question of up to four words that say something: those of the keywords, and of the question where they are fewer than two;
    null for a question of fewer than ``least`` words or where fewer than two are left."""
    plain = lambda c: F.regexp_extract_all(F.translate(F.lower(F.translate(F.coalesce(c, F.lit("")), "Iİ", "ii")), FOLD_FROM, FOLD_TO), F.lit("([a-z0-9]+)"))
    telling = lambda words: F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*STEP_BACK_STOP)))
    own = F.slice(telling(F.flatten(F.transform(F.coalesce(keywords, F.array().cast("array<string>")), plain))), 1, most)
    words = F.when(F.size(own) >= 2, own).otherwise(F.slice(F.array_union(own, telling(plain(question))), 1, most))
    return F.when((F.size(plain(question)) >= max(2, least)) & (F.size(words) >= 2), F.array_join(words, " "))


def repeated_queries(logs: DataFrame) -> DataFrame:
    key = F.sha2(F.concat_ws("|", "tenant", F.trim(F.lower(F.regexp_replace("query_text", r"\s+", " ")))), 256)
    each = logs.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return each.agg(F.count(F.lit(1)).alias("distinct_keys"), F.sum("n").alias("searches"), F.round(1 - F.count(F.lit(1)) / F.sum("n"), 4).alias("repeat_rate"))
