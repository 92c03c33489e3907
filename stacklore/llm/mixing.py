"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

Sources in code-point order (null last) weigh ``weights`` in turn and share
``epochs`` times all words. A source stops at ``max_epochs`` times its own words;
what it leaves over goes to the others by weight, until none is above its cap.
With sources sorted by cap per weight, the first that the common level of what is
left does not fill tells that level, so one ordered pass settles every round.

A target is taken as whole repetitions of every document and one partial one:
documents fall by a seeded hash into ``BUCKETS`` buckets; those below the bucket
in which the remainder ends are repeated once more, those inside it give the same
fraction of their words (rounded by a second hash), those above give none.

Null texts have size 0 and give no words. A null source is a source of its own.
Repeated rows share their decision and count each. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stacklore.llm.base import keep

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BUCKETS = 4096


def _hash(seed: str, *cols: Column) -> Column:
    """A whole number below 2^32 that only the seed and the columns settle."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *cols)), 1, 8), 16, 10).cast("long")


def source_targets(sized: DataFrame, epochs: float = 1.5, max_epochs: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target for each source of ``sized`` (source, size).

    The rows of this table are the distinct sources, whatever the number of
    documents, so one window may order them all.
    """
    own = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    own = own.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double"))
    own = own.withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    # past the first source that is not filled the levels only fall, so the largest is its own
    own = own.withColumn("left", F.sum("source_size").over(everything) * F.lit(epochs) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    own = own.withColumn("level", F.col("left") / F.sum("weight").over(after))
    own = own.withColumn("level", F.max(F.when(F.col("level") < F.col("cap") / F.col("weight"), F.col("level"))).over(everything))
    share = F.col("level") * F.col("weight")
    target = F.when(F.col("level").isNull() | (share >= F.col("cap")), F.col("cap")).otherwise(share)
    return own.select("source", "source_size", target.alias("target"))


#: Rows up to which the table of sources is broadcast; beyond it both sides are shuffled.
SMALL = 200_000


def mix(docs: DataFrame, seed: str = "mix", epochs: float = 1.5, max_epochs: int = 2, weights: tuple[int, ...] = WEIGHTS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, the columns named in ``carry``, size, source_size, target, taken of every row of ``docs``.

    Needs doc_id, text and source; other columns are ignored unless carried, whatever
    their names are. Do not carry columns named as those of the result.
    ``taken`` is at most ``max_epochs`` times ``size``; reruns agree.
    """
    sized = docs.select(
        "doc_id",
        "source",
        *([F.struct(*carry).alias("carried")] if carry else []),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        (_hash(seed, F.col("doc_id").cast("string")) % BUCKETS).alias("bucket"),
    )
    # the only pass over the texts before the last one
    words = keep(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "words")
    targets = source_targets(words.withColumnRenamed("words", "size"), epochs, max_epochs, weights)
    filled = words.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - whole * F.col("source_size")
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
    # the bucket in which the remainder ends, one row for each source
    edge = (
        filled.select("source", "bucket", "words", "source_size", "target", whole.alias("whole"), rest.alias("rest"), upto.alias("upto"))
        .groupBy("source", "source_size", "target", "whole", "rest")
        .agg(
            F.min(F.when(F.col("upto") > F.col("rest"), F.struct("bucket", "upto", "words"))).alias("edge")
        )
        .select(
            F.col("source").alias("s"),
            "source_size",
            "target",
            "whole",
            F.coalesce(F.col("edge.bucket"), F.lit(BUCKETS)).alias("edge_bucket"),
            F.coalesce((F.col("rest") - (F.col("edge.upto") - F.col("edge.words"))) / F.col("edge.words"), F.lit(0.0)).alias("share"),
        )
    )
    edge = keep(edge, "edges")
    if edge.count() <= SMALL:
        edge = F.broadcast(edge)
    luck = _hash(seed + "/part", F.col("doc_id").cast("string")) / F.lit(4294967296.0)
    part = (
        F.when(F.col("bucket") < F.col("edge_bucket"), F.col("size"))
        .when(F.col("bucket") == F.col("edge_bucket"), F.least(F.floor(F.col("size") * F.col("share") + luck), F.col("size")))
        .otherwise(F.lit(0))
    )
    return sized.join(edge, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "source", *(["carried.*"] if carry else []), "size", "source_size", "target", (F.col("whole") * F.col("size") + part).cast("long").alias("taken")
    )


#: The same rows as DuckDB SQL, for the query's parameters.
ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || doc_id::VARCHAR), 1, 8))::BIGINT % 4096 AS bucket,
         ('0x' || substr(md5('mix/part:' || doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS luck
  FROM documents),
own AS (
  SELECT source, source_size, cap, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size, (2 * sum(size))::DOUBLE AS cap FROM sized GROUP BY source)),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv
  FROM own),
targets AS (
  SELECT source, source_size, CASE WHEN level IS NULL OR level * weight >= cap THEN cap ELSE level * weight END AS target
  FROM (SELECT *, max(CASE WHEN lv < cap / weight THEN lv END) OVER () AS level FROM levels)),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM targets),
filled AS (
  SELECT b.source, b.bucket, b.words, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
         sum(b.words) OVER (PARTITION BY b.source ORDER BY b.bucket) AS upto
  FROM (SELECT source, bucket, sum(size) AS words FROM sized GROUP BY source, bucket) b
  JOIN parts p ON b.source IS NOT DISTINCT FROM p.source),
edge AS (
  SELECT source, source_size, target, whole, coalesce(min(CASE WHEN upto > rest THEN bucket END), 4096) AS edge_bucket,
         coalesce((any_value(rest) - (min(CASE WHEN upto > rest THEN upto END) - arg_min(words, bucket) FILTER (upto > rest)))
                  / arg_min(words, bucket) FILTER (upto > rest), 0) AS share
  FROM filled GROUP BY source, source_size, target, whole)
SELECT d.doc_id, d.size, e.source_size, e.target,
       (e.whole * d.size + CASE WHEN d.bucket < e.edge_bucket THEN d.size
                                WHEN d.bucket = e.edge_bucket THEN least(floor(d.size * e.share + d.luck), d.size) ELSE 0 END)::BIGINT AS taken
FROM sized d JOIN edge e ON d.source IS NOT DISTINCT FROM e.source
"""
