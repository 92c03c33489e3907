"""Data quality, repair, and feed operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def suppress_similar(df: DataFrame, threshold: float = 0.92, window: int = 8) -> DataFrame:
    """Per query, rows in rank order whose word set is not too like one of the last kept (bounded heads)."""
    threshold, window = min(max(threshold, 0.4), 1.0), min(max(window, 1), 20)

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        kept, out = [], []
        for i, words in zip(pdf.sort_values("rank")["id"], pdf.sort_values("rank")["words"]):
            s = set(words)
            if not any(len(s & k) / max(len(s | k), 1) >= threshold for k in kept[-window:]):
                kept.append(s)
                out.append(i)
        return pd.DataFrame({"query_id": [pdf["query_id"].iloc[0]] * len(out), "id": out})

    return df.select("query_id", "id", "rank", "words").groupBy("query_id").applyInPandas(keep, "query_id long, id long")


def type_cap(df: DataFrame, head: int, most: int) -> DataFrame:
    """Per query, at most ``most`` rows of a type among the first ``head``; rows passed over move behind all others, none is lost."""
    query = Window.partitionBy("query_id")
    df = df.select("query_id", "id", "rank", "kind").withColumn("able", F.row_number().over(Window.partitionBy("query_id", "kind").orderBy("rank", "id")) <= most)
    df = df.withColumn("nth", F.sum(F.col("able").cast("long")).over(query.orderBy("rank", "id").rowsBetween(Window.unboundedPreceding, 0)))
    # rows behind the one that fills the head are not passed over
    full = F.min(F.when(F.col("able") & (F.col("nth") == head), F.col("rank"))).over(query)
    late = ~F.col("able") & (F.col("rank") < F.coalesce(full, F.col("rank") + 1))
    return df.withColumn("late", late).select("query_id", "id", F.row_number().over(query.orderBy("late", "rank", "id")).cast("long").alias("pos"))


def provider_cap(df: DataFrame, limit: int, most: int = 2) -> DataFrame:
    """Top rows: the first half as ranked, then at most ``most`` more of each provider."""
    w = Window.partitionBy("query_id").orderBy("rank")
    late = df.withColumn("nth", F.row_number().over(w)).withColumn("late", F.col("nth") > limit // 2)
    own = F.sum(F.col("late").cast("int")).over(Window.partitionBy("query_id", "kind").orderBy("rank"))
    kept = late.withColumn("own", own).where(~F.col("late") | (F.col("own") <= most))
    return kept.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= limit).select("query_id", "id", "pos")


def health(chunks: DataFrame) -> DataFrame:
    short = F.count_if(F.length(F.trim("text")) < 12)
    odd = F.count_if(F.lower("title").endswith(" - self") & (F.col("content_type") != "PERSONAL_NOTE"))
    return chunks.agg(F.count(F.lit(1)).alias("n"), short.alias("short"), odd.alias("mislabelled")).withColumn("status", F.when((F.col("short") > 0) | (F.col("mislabelled") > 0), "ISSUES").otherwise("OK"))


def cleaned(chunks: DataFrame) -> DataFrame:
    own = F.lower("title").endswith(" - self")
    return chunks.where(F.length(F.trim("text")) >= 12).withColumn("content_type", F.when(own, "PERSONAL_NOTE").otherwise(F.col("content_type")))


def check_suite(checks: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """check, value, status: rows of each table that break its rule."""
    out = None
    for name, (df, bad) in checks.items():
        one = df.agg(F.lit(name).alias("check"), F.count_if(bad).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("status", F.when(F.col("value") == 0, "PASS").otherwise("FAIL"))


def outside_domain(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    bad = df.where(F.col(column).isNull() | ~F.col(column).isin(*allowed))
    return bad.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def missing_parents(chunks: DataFrame, items: DataFrame) -> DataFrame:
    """Parent rows made from the titles of chunks without one."""
    lost = chunks.join(items.select("tenant", "item_id"), ["tenant", "item_id"], "left_anti")
    return lost.groupBy("tenant", "item_id").agg(F.min("title").alias("title")).withColumn("author", F.element_at(F.split("title", " - "), -1))


def inherited(chunks: DataFrame, items: DataFrame) -> DataFrame:
    p = items.select("tenant", "item_id", F.col("search_visibility").alias("own"))
    return chunks.join(p, ["tenant", "item_id"], "left").withColumn("visibility", F.coalesce("own", F.lit("DEFAULT"))).drop("own")


def stale_items(stored: DataFrame, active: DataFrame, key: str) -> DataFrame:
    gone = stored.join(active.select(key), key, "left_anti")
    return gone.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def leaked_notes(chunks: DataFrame) -> DataFrame:
    leak = (F.col("content_type") == "PERSONAL_NOTE") | ((F.col("content_type") == "INSIGHT") & F.lower("title").endswith(" - self"))
    return chunks.where(leak).orderBy(F.desc("created_at"), F.desc("id"))


def multi_seed(near: DataFrame, rare: DataFrame, rest: DataFrame, seen: DataFrame, n: int, total: int) -> DataFrame:
    """n by similarity, n least seen, the rest in a seeded order; each row once, none of ``seen`` (id). Each list has id and score, best first."""
    every = None
    for src, df in enumerate((near, rare, rest)):
        fresh = df.join(seen.select("id").distinct(), "id", "left_anti").orderBy(F.desc("score"), "id").limit(n if src < 2 else total)  # at most ``total`` rows
        own = fresh.select("id", F.lit(src).alias("src"), F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"))
        every = own if every is None else every.unionByName(own)
    first = every.groupBy("id").agg(F.min(F.struct("src", "rank")).alias("k")).select("id", "k.src", "k.rank")
    return first.orderBy("src", "rank", "id").limit(total)


#: A candidate of this penalty or less is left out, and as many as a tenant should have at least.
LEAST_PENALTY, WANTED = 0.3, 20


def filter_chain(candidates: DataFrame, session: DataFrame, lately: DataFrame, wanted: int = WANTED) -> DataFrame:
    """tenant, id, relaxed: candidates (tenant, id, text, penalty) of enough length that the session has not shown, that were
    not seen lately, whose text is the first of its kind for the tenant and whose penalty leaves enough of them. A tenant with
    fewer than ``wanted`` of these gets more in order of id, seen lately and disliked ones among them.

    ``session`` and ``lately`` have tenant and id.
    """
    fits = candidates.where("length(trim(text)) >= 60").join(session.select("tenant", "id").distinct(), ["tenant", "id"], "left_anti")
    first = fits.groupBy("tenant", F.sha2("text", 256).alias("h")).agg(F.min("id").alias("id")).select("tenant", "id")
    fits = fits.select("tenant", "id", "penalty").join(first, ["tenant", "id"], "left_semi")
    marked = fits.join(lately.select("tenant", "id", F.lit(True).alias("late")).distinct(), ["tenant", "id"], "left")
    marked = marked.withColumn("relaxed", F.coalesce("late", F.lit(False)) | (F.coalesce("penalty", F.lit(1.0)) < LEAST_PENALTY))
    strict = marked.where("NOT relaxed").select("tenant", "id", "relaxed")
    n = strict.groupBy("tenant").agg(F.count(F.lit(1)).alias("n"))
    nth = F.row_number().over(Window.partitionBy("tenant").orderBy("id"))
    more = marked.where("relaxed").withColumn("nth", nth).where(F.col("nth") <= wanted).join(n, "tenant", "left")
    return strict.unionByName(more.where(F.col("nth") + F.coalesce("n", F.lit(0)) <= wanted).select("tenant", "id", "relaxed"))


def board(signals: DataFrame, tags: DataFrame, idle_before: str) -> DataFrame:
    """One card of each family for each tenant: continue (most notes), latest, dormant (idle since a date), and as theme the most common of ``tags`` (tenant, tag)."""
    pick = lambda df, name, order: df.groupBy("tenant").agg(F.max_by("item_id", F.struct(*order, "item_id")).alias("item_id")).withColumn("family", F.lit(name))
    cut = F.lit(idle_before).cast("timestamp_ntz")
    common = tags.where("tag IS NOT NULL").groupBy("tenant", F.col("tag").alias("item_id")).agg(F.count(F.lit(1)).alias("n"))
    return (
        pick(signals, "continue", ["notes", "highlights"]).unionByName(pick(signals, "latest", ["last_at"]))
        .unionByName(pick(signals.where(F.col("last_at") < cut), "dormant", ["total"])).unionByName(pick(common, "theme", ["n"])).select("tenant", "family", "item_id")
    )


def recent_messages(messages: DataFrame, n: int) -> DataFrame:
    """Last n messages of each conversation in order, and its title from the first user text."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = messages.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.concat_ws(": ", m["role"], F.substring(m["text"], 1, 40))), "\n")
    title = messages.where("role = 'user'").groupBy("conv_id").agg(F.substring(F.min_by("text", "turn"), 1, 60).alias("title"))
    return last.groupBy("conv_id").agg(joined.alias("context")).join(title, "conv_id", "left")


def laid_out(cards: DataFrame, weights: dict[str, float], per_family: int) -> DataFrame:
    """Cards by score times family weight; the first is featured, each family has a budget."""
    w = F.create_map(*(F.lit(x) for p in weights.items() for x in p))
    df = cards.withColumn("points", F.round(F.col("score") * F.coalesce(w[F.col("family")], F.lit(1.0)), 6))
    df = df.withColumn("nth", F.row_number().over(Window.partitionBy("tenant", "family").orderBy(F.desc("points"), "id")))
    df = df.where(F.col("nth") <= per_family).withColumn("pos", F.row_number().over(Window.partitionBy("tenant").orderBy(F.desc("points"), "id")))
    return df.withColumn("featured", F.col("pos") == 1)


def zone_score(df: DataFrame, zone_weights: dict[str, float]) -> DataFrame:
    z = F.create_map(*(F.lit(x) for p in zone_weights.items() for x in p))
    return df.withColumn("score", F.round((z[F.col("zone")] + 0.8 * F.col("sim")) * F.col("penalty"), 6))
