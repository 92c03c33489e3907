"""Windows, limits, samples and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], ts: str, ident: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(ts).desc_nulls_last(), F.desc(ident))
    return df.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def keep_first(df: DataFrame, keys: list, *rank) -> DataFrame:
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*rank))).where("nth = 1").drop("nth")


def min_max(df: DataFrame, column: str, *keys: str) -> DataFrame:
    w = Window.partitionBy(*keys)
    lo, hi = F.min(column).over(w), F.max(column).over(w)
    return df.withColumn("norm", F.when(hi > lo, (F.col(column) - lo) / (hi - lo)).otherwise(0.0))


def per_group_quota(df: DataFrame, group: str, quota: int, total: int) -> DataFrame:
    """Per query: the first ``quota`` rows of each group, groups by best score, then the rest by score."""
    own = Window.partitionBy("query_id", group).orderBy(F.desc("score"), "id")
    df = df.withColumn("nth", F.row_number().over(own)).withColumn("best", F.max("score").over(Window.partitionBy("query_id", group)))
    first = F.col("nth") <= quota
    w = Window.partitionBy("query_id").orderBy(F.when(first, 0).otherwise(1), F.when(first, -F.col("best")), F.when(first, F.col(group)), F.desc("score"), "id")
    return df.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= total).drop("nth", "best")


def interleave(df: DataFrame, key: str, zone: str, score: str) -> DataFrame:
    """One row from each zone in turn, best first."""
    turn = F.row_number().over(Window.partitionBy(key, zone).orderBy(F.desc(score), "id"))
    df = df.withColumn("turn", turn)
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy("turn", zone))).drop("turn")


def ends_first(df: DataFrame, key: str, rank: str) -> DataFrame:
    """Even ranks upwards, then odd ranks downwards (rank counts from 0)."""
    even = F.col(rank) % 2 == 0
    w = Window.partitionBy(key).orderBy(F.when(even, 0).otherwise(1), F.when(even, F.col(rank)).otherwise(-F.col(rank)))
    return df.withColumn("pos", F.row_number().over(w))


def repeatable(ident: str, seed: int = 1) -> Column:
    """A shuffle order that the seed settles."""
    return (F.col(ident) * 2654435761 + seed * 40503) % 4294967296


def least_seen(df: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    n = seen.groupBy("id").agg(F.count(F.lit(1)).alias("times"))
    return df.join(n, "id", "left").withColumn("times", F.coalesce("times", F.lit(0))).orderBy("times", repeatable("id"), "id").limit(k)


def pick_by(df: DataFrame, keys: list[str], criteria: list, columns: list[str]) -> DataFrame:
    """One row of each key, the greatest by criteria in order."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*criteria)).alias("r")).select(*keys, "r.*")


def top_k(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("nth") <= k)


def page(df: DataFrame, order: list, offset: int, k: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(k)


def keyset_page(df: DataFrame, ts: str, ident: str, cursor: tuple, k: int) -> DataFrame:
    """Rows after the cursor in descending order, and one more to tell whether others follow."""
    c = F.lit(cursor[0]).cast("timestamp_ntz")
    return df.where((F.col(ts) < c) | ((F.col(ts) == c) & (F.col(ident) < cursor[1]))).orderBy(F.desc(ts), F.desc(ident)).limit(k + 1)


def pool_size(limit: int, wide: bool = True) -> int:
    return min(limit * 4 if wide else limit + 40, 2500)


def stratified(df: DataFrame, stratum: str, n: int) -> DataFrame:
    """n rows spread evenly over the strata; the first strata take what is left over."""
    strata = df.select(stratum).distinct()
    strata = strata.withColumn("k", F.row_number().over(Window.orderBy(stratum))).withColumn("s", F.count(F.lit(1)).over(Window.partitionBy()))
    quota = strata.select(stratum, (F.floor(F.lit(n) / F.col("s")) + (F.col("k") <= n % F.col("s")).cast("int")).alias("quota"))
    w = Window.partitionBy(stratum).orderBy("id")
    return df.join(F.broadcast(quota), stratum).withColumn("nth", F.row_number().over(w)).where("nth <= quota").drop("nth", "quota")


def head_middle_tail(chunks: DataFrame, budget: int) -> DataFrame:
    """15 % of an item's chunks at each end, and every step-th between, to fit the characters."""
    w = Window.partitionBy("item_id")
    o = w.orderBy("page_number", "chunk_index", "id")
    df = chunks.withColumn("rn", F.row_number().over(o)).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("chars", F.sum(F.length("text")).over(w))
    df = df.withColumn("edge", F.greatest(F.floor(F.col("n") * 0.15), F.lit(1))).withColumn("step", F.greatest(F.ceil(F.col("chars") / budget), F.lit(1)))
    end = (F.col("rn") <= F.col("edge")) | (F.col("rn") > F.col("n") - F.col("edge"))
    return df.where(end | (F.pmod(F.col("rn") - F.col("edge") - 1, F.col("step")) == 0)).drop("edge", "step", "chars", "n")


#: Rank of each type in a result list.
PRIORITY = {"BOOK": 1.0, "ARTICLE": 2.0, "HIGHLIGHT": 3.0, "INSIGHT": 4.0, "PERSONAL_NOTE": 5.0, "WEBSITE": 6.0, "MOVIE": 6.0, "SERIES": 6.0}


def source_priority(kind: Column, text: Column, comment: Column) -> Column:
    low = F.lower(text)
    report = low.contains("<h1>research report") | low.contains("<h2>final answer")
    known = F.create_map(*(F.lit(x) for p in PRIORITY.items() for x in p))
    early = kind.isin("BOOK", "ARTICLE", "HIGHLIGHT", "INSIGHT")
    return (
        F.when(early, known[kind]).when((kind == "PERSONAL_NOTE") & report, 5.8).when(kind == "PERSONAL_NOTE", 5.0)
        .when(F.length(comment) > 0, 5.5).otherwise(F.coalesce(known[kind], F.lit(7.0)))
    )


def rotated(df: DataFrame, key: str, order: str, token: str, salt: str) -> DataFrame:
    """Each key's list, turned by a number that the token settles."""
    w = Window.partitionBy(key)
    n, rn = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(order)) - 1
    turn = F.conv(F.substring(F.md5(F.lit(f"{token}:{salt}")), 1, 8), 16, 10).cast("long")
    return df.withColumn("pos", F.pmod(rn - turn % n, n))


def bounded_context(df: DataFrame, k: int = 15, chars: int = 700) -> DataFrame:
    top = top_k(df, ["query_id"], [F.desc("score"), "id"], k)
    line = F.concat(F.lit("["), F.col("nth").cast("string"), F.lit("] "), F.substring("text", 1, chars))
    return top.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", line.alias("line")))), lambda x: x["line"]), "\n").alias("context"))


def prefer_first(first: DataFrame, second: DataFrame, key: str, most: int) -> DataFrame:
    both = first.withColumn("src", F.lit(0)).unionByName(second.withColumn("src", F.lit(1)))
    return keep_first(both, [key], "src").orderBy("src", key).limit(most)


def bag_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that either side has more often, with how many are missing and extra."""
    n = lambda df, c: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(c))
    both = n(a, "na").join(n(b, "nb"), keys, "full")
    diff = F.coalesce("na", F.lit(0)) - F.coalesce("nb", F.lit(0))
    return both.select(*keys, F.greatest(diff, F.lit(0)).alias("missing"), F.greatest(-diff, F.lit(0)).alias("extra")).where("missing + extra > 0")


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
