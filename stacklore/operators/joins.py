"""Joins over chunks, items and graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["tenant", "item_id"]


def with_items(chunks: DataFrame, items: DataFrame, *columns: str) -> DataFrame:
    return chunks.join(items.select(*KEY, *columns), KEY, "left")


def active(chunks: DataFrame, items: DataFrame) -> DataFrame:
    return chunks.join(items.where(F.coalesce("is_deleted", F.lit(0)) == 0).select(*KEY), KEY, "left_semi")


def unseen(chunks: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    return chunks.join(seen.select(*keys), keys, "left_anti")


def orphans(children: dict[str, tuple[DataFrame, list[str]]], parent: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of each child table whose key the parent lacks, counted."""
    out = None
    for name, (child, own) in children.items():
        renamed = child.select(*(F.col(c).alias(k) for c, k in zip(own, keys)))
        n = renamed.join(parent.select(*keys), keys, "left_anti").agg(F.lit(name).alias("child"), F.count(F.lit(1)).alias("orphans"))
        out = n if out is None else out.unionByName(n)
    return out


def latest_child(parent: DataFrame, child: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    last = child.groupBy(*keys).agg(*(F.max_by(c, F.struct(*order)).alias(c) for c in columns))
    return parent.join(last, keys, "left")


def touching(entries: DataFrame, relations: DataFrame) -> DataFrame:
    """concept, other, rel_type, weight for relations with an entry at either end:
    two equi joins, as an OR of both ends has no hash join."""
    ahead = relations.join(entries, relations.src == entries.concept).select("concept", F.col("dst").alias("other"), "rel_type", "weight")
    back = relations.join(entries, relations.dst == entries.concept).select("concept", F.col("src").alias("other"), "rel_type", "weight")
    return ahead.union(back).distinct()


#: Sources of one destination that meet all others of it in one task.
HUB_BLOCK = 2000


def common_neighbours(relations: DataFrame, least: int = 2, block: int = HUB_BLOCK) -> DataFrame:
    """Sources a < b with several destinations in common.

    All pairs at a destination are asked for, so their number grows with the square of its degree; a destination of more
    than ``block`` sources is cut into blocks, each of which meets all its sources in a task of its own. What is shuffled is one
    list for each source and block; pairs become rows in the task that counts them.
    """
    r = relations.select("src", "dst").distinct()
    many = r.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("dst", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    lists = r.join(many, "dst").groupBy("dst", "blocks", F.pmod(F.xxhash64("src"), "blocks").cast("int").alias("part")).agg(F.array_sort(F.collect_list("src")).alias("srcs"))
    own = lists.select("dst", "part", F.col("srcs").alias("own"))
    every = lists.select("dst", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), F.col("srcs").alias("every"))
    met = own.join(every, ["dst", "part"]).select(F.explode("own").alias("a"), "every").select("a", F.filter("every", lambda b: b > F.col("a")).alias("bs"))
    pairs = met.where(F.size("bs") > 0).repartition("a").select("a", F.explode("bs").alias("b"))  # a pair stands once for each destination
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)


def neighbours(seeds: DataFrame, chunks: DataFrame, reach: int, k: int) -> DataFrame:
    """Nearest k chunks of each seed's item within ``reach`` pages or positions."""
    s = seeds.select(F.col("id").alias("seed"), "item_id", F.col("page_number").alias("p"), F.col("chunk_index").alias("i"))
    near = s.join(chunks.select("id", "item_id", "page_number", "chunk_index"), "item_id").where(
        (F.col("id") != F.col("seed")) & ((F.abs(F.col("page_number") - F.col("p")) <= reach) | (F.abs(F.col("chunk_index") - F.col("i")) <= reach))
    )
    gap = F.least(F.abs(F.col("page_number") - F.col("p")), F.abs(F.col("chunk_index") - F.col("i")))
    w = Window.partitionBy("seed").orderBy("gap", "id")
    near = near.withColumn("gap", gap).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k)
    return near.groupBy("id").agg(F.min("gap").alias("gap"))


def near_pages(anchors: DataFrame, chunks: DataFrame, reach: int = 10) -> DataFrame:
    page = lambda c: F.coalesce(c, F.lit(1))
    a = anchors.select("title", F.col("id").alias("anchor"), page("page_number").alias("p"))
    out = a.join(chunks.select("title", "id", page("page_number").alias("q")), "title")
    return out.where((F.abs(F.col("q") - F.col("p")) <= reach) & (F.col("id") != F.col("anchor"))).select("anchor", "id")


def author_of(title):
    return F.element_at(F.split(title, " - "), -1)


#: Anchors of a title that meet a chunk in one row, and chunks of an author in one part.
ANCHORS, PART = 1000, 20_000


def same_author(anchors: DataFrame, chunks: DataFrame, block: int = ANCHORS, part: int = PART) -> DataFrame:
    """anchor, id, author of every anchor and chunk of one author under different titles.

    All of these pairs are asked for. Anchors go in lists of one title, at most about ``block`` long, and the chunks of an author in
    parts, each of which meets all its lists: a pair becomes a row where it is given on, and few authors still make many tasks.
    """
    c = chunks.select("id", "title", author_of("title").alias("author"))
    parts = c.groupBy("author").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts"))
    a = anchors.select(F.col("id").alias("anchor"), author_of("title").alias("author"), F.col("title").alias("t"))
    sizes = a.groupBy("author", "t").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("lists"))
    listed = a.join(sizes, ["author", "t"]).groupBy("author", "t", F.pmod(F.xxhash64("anchor"), "lists").alias("nth")).agg(F.collect_list(F.struct("anchor")).alias("anchors"))
    listed = listed.join(parts, "author").select("author", "t", "anchors", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    own = c.join(parts, "author").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    return own.join(listed, ["author", "part"]).where("title <> t").select(F.inline("anchors"), "id", "author")


def title_mismatches(items: DataFrame, gram: int = 3) -> DataFrame:
    """Items a < b of one tenant with different titles of which one contains the other, letter by letter.

    The shorter title brings the rarest of its runs of ``gram`` letters (all of it, if it is shorter), which every title
    that contains it has too.
    """
    t = items.select("tenant", "item_id", "title", F.lower("title").alias("t")).where(F.length("t") > 0)
    runs = lambda size: F.transform(F.sequence(F.lit(1), F.length("t") - size + 1), lambda i: F.substr("t", i, F.lit(size)))
    every = F.array_distinct(F.flatten(F.array(*(F.when(F.length("t") >= n, runs(n)).otherwise(F.array().cast("array<string>")) for n in range(1, gram + 1)))))
    grams = t.select("tenant", "item_id", "title", "t", F.explode(every).alias("gram"))
    often = grams.groupBy("tenant", "gram").agg(F.count(F.lit(1)).alias("n"))
    own = grams.where(F.length("gram") == F.least(F.length("t"), F.lit(gram))).join(often, ["tenant", "gram"])
    part = own.groupBy("tenant", "item_id").agg(F.min(F.struct("n", "gram", "title", "t")).alias("r")).select("tenant", F.col("item_id").alias("part_id"), "r.gram", F.col("r.title").alias("part_title"), F.col("r.t").alias("part"))
    found = grams.join(part, ["tenant", "gram"]).where((F.col("item_id") != F.col("part_id")) & (F.col("title") != F.col("part_title")) & F.contains("t", "part"))
    return found.select("tenant", F.least("item_id", "part_id").alias("item_a"), F.greatest("item_id", "part_id").alias("item_b")).distinct()


def labelled_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    e = lambda end: entities.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label"))
    return edges.join(e("src"), "src").join(e("dst"), "dst")


def seen_within(candidates: DataFrame, seen: DataFrame, cutoff: str) -> DataFrame:
    recent = seen.where(F.col("seen_at") >= F.lit(cutoff).cast("timestamp_ntz")).select("tenant", "id").distinct().withColumn("s", F.lit(True))
    return candidates.join(recent, ["tenant", "id"], "left").withColumn("seen", F.coalesce("s", F.lit(False))).drop("s")


def concept_lookup(concepts: DataFrame, aliases: DataFrame, part: str, names: list[str]) -> DataFrame:
    """Ids whose name holds a part, or whose name or alias is one of ``names``."""
    low = F.lower("name")
    own = concepts.where(low.contains(part) | low.isin(*names)).select("id")
    return own.union(aliases.where(F.lower("alias").isin(*names)).select("id")).distinct()


def evidence_match(candidates: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """Score of candidate and item: up to two shared tags, one for a shared title word, one for a shared author."""
    side = lambda df, key: df.select(key, F.explode("terms").alias("t")).select(key, F.col("t.kind").alias("kind"), F.col("t.word").alias("word")).distinct()
    hits = side(candidates, "candidate").join(side(items, "item"), ["kind", "word"]).groupBy("candidate", "item", "kind").agg(F.count(F.lit(1)).alias("n"))
    score = F.sum(F.least(F.col("n"), F.when(F.col("kind") == "tag", 2).otherwise(1))).alias("score")
    w = Window.partitionBy("candidate").orderBy(F.desc("score"), "item")
    return hits.groupBy("candidate", "item").agg(score).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k).drop("nth")
