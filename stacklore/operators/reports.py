"""Aggregates over search logs, items and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share_by(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by key with their percentage of all rows."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 2))


#: Bands of values between which a quantile is looked for, and distinct values of a key from which their limits are taken.
BANDS_OF_VALUES, LIMITS_FROM = 64, 1000


def quantiles(df: DataFrame, value: str, shares: dict[str, float], *keys: str) -> DataFrame:
    """``keys`` and one exact quantile (between the two nearest values in proportion) for each name of ``shares``.

    Values are counted where they are, so a task sends each distinct one once; counts of bands tell the band of each rank, and
    only the values of these bands are put in order. No task holds all values. The limits of the bands are the same however
    often and in whatever order rows come, as they are computed more than once: they lie between the distinct values whose
    hashes come first. Any limits give the same quantiles.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    drawn = counts.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("v"), "v"))).where(F.col("nth") <= LIMITS_FROM)
    drawn = drawn.groupBy(*keys).agg(F.array_sort(F.collect_list("v")).alias("some"))
    cut = lambda i: F.element_at("some", (F.floor(i * F.size("some") / BANDS_OF_VALUES) + 1).cast("int"))
    limits = drawn.select(*keys, F.transform(F.sequence(F.lit(1), F.lit(BANDS_OF_VALUES - 1)), cut).alias("limits"))
    join = lambda a, b: a.join(b, list(keys)) if keys else a.join(F.broadcast(b))  # noqa: E731  without keys it is one row
    placed = join(counts, limits).select(*keys, "v", "n", F.size(F.filter("limits", lambda x: x < F.col("v"))).alias("band"))
    bands = placed.groupBy(*keys, "band").agg(F.sum("n").alias("m"))
    bands = bands.withColumn("total", F.sum("m").over(Window.partitionBy(*keys)))
    upto = F.sum("m").over(Window.partitionBy(*keys).orderBy("band"))
    asked = F.explode(F.flatten(F.array(*(F.array(*(F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), (F.lit(q) * (F.col("total") - 1)).alias("at")) for side in (0, 1))) for name, q in shares.items()))))
    wanted = bands.withColumn("before", upto - F.col("m")).select(*keys, "band", "before", "m", asked.alias("r")).select(*keys, "band", "before", "m", "r.*")
    wanted = wanted.withColumn("rank", F.when(F.col("side") == 0, F.floor("at")).otherwise(F.ceil("at"))).where("rank >= before AND rank < before + m")
    near = placed.join(wanted.select(*keys, "band", "before").distinct(), [*keys, "band"])
    end = F.col("before") + F.sum("n").over(Window.partitionBy(*keys, "band").orderBy("v"))
    near = near.withColumn("end", end).select(*keys, "band", "v", "n", "end")
    found = wanted.join(near, [*keys, "band"]).where("rank < `end` AND rank >= `end` - n")
    of = lambda name, side, x: F.max(F.when((F.col("name") == name) & (F.col("side") == side), x))  # noqa: E731  one row each
    between = lambda name: of(name, 0, F.col("v")) + (of(name, 1, F.col("v")) - of(name, 0, F.col("v"))) * of(name, 0, F.col("at") - F.floor("at"))
    return found.groupBy(*keys).agg(*(between(name).alias(name) for name in shares))


def rounded(x: Column, digits: int = 4) -> Column:
    """``x`` rounded as SQL does it for doubles, by the whole number nearest to its product; ``F.round`` goes by decimal digits instead."""
    return F.round(x * 10.0**digits) / 10.0**digits


def latency_quantiles(logs: DataFrame, *keys: str) -> DataFrame:
    q = quantiles(logs, "ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, *keys)
    means = logs.groupBy(*keys).agg(F.round(F.avg("ms"), 4).alias("avg_ms"), F.round(F.avg("result_count"), 4).alias("avg_results"))
    both = means.join(q, list(keys)) if keys else means.join(F.broadcast(q))
    return both.select(*keys, "avg_ms", *(rounded(F.col(n)).alias(n) for n in ("p50", "p95", "p99")), "avg_results")


#: Half-open bands; the last one takes 2000 itself.
BANDS = (("under_200", 0, 200), ("from_200", 200, 500), ("from_500", 500, 1000), ("from_1000", 1000, 2000), ("over_2000", 2000, None))


def latency_bands(logs: DataFrame, *keys: str) -> DataFrame:
    ms = F.col("ms")
    count = lambda lo, hi: F.count_if((ms >= lo) & (ms < hi) if hi else ms >= lo)
    return logs.groupBy(*keys).agg(*(count(lo, hi).alias(n) for n, lo, hi in BANDS))


def daily_usage(logs: DataFrame) -> DataFrame:
    """One row: totals, latency, bands, the main intent, and notes on slow or lopsided use."""
    intents = logs.groupBy("intent").agg(F.count(F.lit(1)).alias("n"))
    main = intents.agg(F.max(F.struct("n", "intent")).alias("m"), F.sum("n").alias("total"))
    main = main.select(F.col("m.intent").alias("main_intent"), F.round(F.col("m.n") * 100.0 / F.col("total"), 2).alias("main_pct"), "total")
    report = main.join(latency_quantiles(logs)).join(latency_bands(logs))  # each side is a single row
    slow = F.round(F.col("over_2000") * 100.0 / F.col("total"), 2)
    notes = F.concat_ws("; ", F.when(slow > 5, F.lit("many slow queries")), F.when(F.col("main_pct") > 60, F.lit("one intent dominates")))
    return report.withColumn("slow_pct", slow).withColumn("notes", notes)


def item_signals(chunks: DataFrame) -> DataFrame:
    kind = lambda k: F.count_if(F.col("content_type") == k)
    return chunks.groupBy("tenant", "item_id").agg(
        F.count(F.lit(1)).alias("total"), kind("HIGHLIGHT").alias("highlights"), kind("INSIGHT").alias("insights"), kind("PERSONAL_NOTE").alias("notes"),
        F.max("created_at").alias("last_at"), F.max("page_number").alias("max_page"),
    )


def index_coverage(chunks: DataFrame, vectors: DataFrame, links: DataFrame) -> DataFrame:
    """Embedded and linked chunks of each item, their ratios and the readiness state."""
    marked = chunks.join(vectors.select("id", F.lit(1).alias("v")), "id", "left").join(
        links.select(F.col("content_id").alias("id"), F.lit(1).alias("g")).distinct(), "id", "left"
    )
    out = marked.groupBy("item_id").agg(F.count(F.lit(1)).alias("total"), F.count("v").alias("embedded"), F.count("g").alias("linked"))
    out = out.withColumn("vector_ratio", F.round(F.col("embedded") / F.col("total"), 4)).withColumn("graph_ratio", F.round(F.col("linked") / F.col("total"), 4))
    state = F.when((F.col("embedded") > 0) & (F.col("linked") > 0), "fully_ready").when(F.col("embedded") > 0, "vector_ready").when(F.col("linked") > 0, "graph_ready")
    return out.withColumn("state", state.otherwise("not_ready"))


def occurrences(text, term: str):
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("long")


def keyword_pages(chunks: DataFrame, forms: list[str]) -> DataFrame:
    low = F.lower("text")
    hits = sum((occurrences(low, f) for f in forms), F.lit(0))
    return chunks.groupBy("item_id", "page_number").agg(F.sum(hits).alias("n")).where("n > 0")


def keyword_count(chunks: DataFrame, forms: list[str], pattern: str) -> DataFrame:
    low = F.lower("text")
    hits = sum((occurrences(low, f) for f in forms), F.lit(0))
    out = chunks.groupBy("item_id").agg(F.sum(hits).alias("literal"), F.sum(F.regexp_count(low, F.lit(pattern))).alias("raw"))
    return out.select("item_id", F.when(F.col("literal") > 0, F.col("literal")).otherwise(F.col("raw")).cast("long").alias("n"))


def compare_items(chunks: DataFrame, term: str, note_types: tuple[str, ...]) -> DataFrame:
    """Occurrences by item, and one row for the term in all notes."""
    hits = F.sum(occurrences(F.lower("text"), term)).alias("n")
    notes = chunks.where(F.col("content_type").isin(*note_types)).agg(hits).select(F.lit("ALL_NOTES").alias("item_id"), "n")
    return chunks.groupBy("item_id").agg(hits).unionByName(notes)


def vocabulary(chunks: DataFrame, pattern: str = r"(\w+)") -> DataFrame:
    words = chunks.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(pattern))).alias("word")).where(F.length("word") > 2)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def lemma_map(chunks: DataFrame) -> DataFrame:
    """Word counts of each chunk as a map in key order."""
    words = chunks.select("id", F.explode(F.split(F.lower("text"), r"\s+")).alias("w")).where("w <> ''")
    each = words.groupBy("id", "w").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("w", "n")))).alias("freq"))


def level_distribution(scored: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    out = scored.groupBy("item_id").agg(n.alias("total"), *(F.count_if(F.col("level") == x).alias(x) for x in "ABC"))
    return out.select("item_id", "total", *(F.col(x).alias(f"n_{x.lower()}") for x in "ABC"), *(F.round(F.col(x) / F.col("total"), 4).alias(f"ratio_{x.lower()}") for x in "ABC"))


def duplicate_groups(df: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """Keys that stand with more than one id, and how many: a row for each of the ids, so that no group is one row."""
    each = df.select(*keys, ident).distinct()
    return each.join(each.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), keys).select(*keys, "n", ident)


def collisions(df: DataFrame, ident: str, tenant: str = "tenant") -> DataFrame:
    return df.groupBy(ident).agg(F.count_distinct(tenant).alias("tenants")).where("tenants > 1")


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    return share_by(df.withColumn("score", sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))), "score")


def newest_title(chunks: DataFrame) -> DataFrame:
    kind = F.when(F.max((F.col("content_type") == "PDF_CHUNK").cast("int")) == 1, "BOOK").when(F.max((F.col("content_type") == "PERSONAL_NOTE").cast("int")) == 1, "PERSONAL_NOTE")
    return chunks.groupBy("tenant", "item_id").agg(
        F.max_by("title", F.struct("created_at", "id")).alias("title"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), kind.otherwise("BOOK").alias("item_type")
    )


def top_terms(df: DataFrame, tags: str, stop: tuple[str, ...] = (), k: int = 10) -> DataFrame:
    """Most common labels whatever the case, in the spelling seen first."""
    each = df.select("id", F.posexplode(tags).alias("pos", "label")).where(~F.lower("label").isin(*stop) if stop else F.lit(True))
    out = each.groupBy(F.lower("label").alias("tag")).agg(F.count(F.lit(1)).alias("n"), F.min_by("label", F.struct("id", "pos")).alias("display"))
    return out.orderBy(F.desc("n"), "tag").limit(k)


def recurring_terms(df: DataFrame, words: str, least: int = 2) -> DataFrame:
    each = df.select("item_id", F.explode(F.array_distinct(words)).alias("word"))
    return each.groupBy("word").agg(F.count_distinct("item_id").alias("items")).where(F.col("items") >= least)


#: Upper bounds of the latency buckets in milliseconds; the last bucket is open.
BOUNDS = (50.0, 100.0, 250.0, 500.0, 1000.0, 2500.0, 5000.0, 10000.0)


def histogram(df: DataFrame, value: str, *by: str, bounds: tuple[float, ...] = BOUNDS) -> DataFrame:
    """``by`` and ``counts``: how many values are at or below each bound, and how many there are. Null values do not count."""
    upto = [F.count_if(F.col(value) <= b) for b in bounds]
    return df.groupBy(*by).agg(F.array(*upto, F.count(value)).alias("counts"))


def merged(histograms: DataFrame, *by: str, bounds: tuple[float, ...] = BOUNDS) -> DataFrame:
    """The histograms of coarser groups, by adding up finer ones."""
    total = [F.sum(F.col("counts")[i]) for i in range(len(bounds) + 1)]
    return histograms.groupBy(*by).agg(F.array(*total).alias("counts"))


def histogram_quantile(counts: Column, share: float, bounds: tuple[float, ...] = BOUNDS) -> Column:
    """The quantile of a histogram, linear within the bucket where it falls; the last bound if it is in the open bucket, null without values."""
    total = counts[len(bounds)]
    rank, out = F.lit(share) * total, F.lit(bounds[-1])
    for i in reversed(range(len(bounds))):
        low, before = (bounds[i - 1], counts[i - 1]) if i else (0.0, F.lit(0))
        inside = F.when(counts[i] > before, low + (bounds[i] - low) * (rank - before) / (counts[i] - before)).otherwise(low)
        out = F.when(counts[i] >= rank, inside).otherwise(out)
    return F.when(total > 0, out)


def hourly_metrics(logs: DataFrame) -> DataFrame:
    """hour, intent, n, slow_ratio, error_ratio, per_second, p95 (exact), h50, h95, h99 (by histogram) and how many verdicts of each kind."""
    by_hour = logs.withColumn("hour", F.date_trunc("hour", "created_at").cast("timestamp_ntz"))
    verdicts = [F.count_if(F.col("verdict") == v).alias(v.lower()) for v in ("PASS", "REGENERATE", "DECLINE")]
    share = lambda c: F.round(F.avg(c.cast("int")), 4)
    n = by_hour.groupBy("hour", "intent").agg(
        F.count(F.lit(1)).alias("n"), share(F.col("ms") > 1000).alias("slow_ratio"), share(F.col("verdict") == "DECLINE").alias("error_ratio"), F.round(F.count(F.lit(1)) / 3600, 6).alias("per_second"), *verdicts
    )
    told = histogram(by_hour, "ms", "hour", "intent")
    told = told.select("hour", "intent", *(F.round(histogram_quantile(F.col("counts"), q / 100), 4).alias(f"h{q}") for q in (50, 95, 99)))
    exact = quantiles(by_hour, "ms", {"p95": 0.95}, "hour", "intent").withColumn("p95", rounded(F.col("p95")))
    return n.join(told, ["hour", "intent"]).join(exact, ["hour", "intent"], "left")
