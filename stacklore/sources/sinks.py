"""Writes without a table format: joins that give the new state, and versioned folders."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def with_month(df: DataFrame, ts: str = "created_at") -> DataFrame:
    return df.withColumn("partition_month", F.trunc(F.col(ts).cast("date"), "MM"))


def write_monthly(df: DataFrame, path: str, ts: str = "created_at") -> None:
    """One folder for each month; rows of a month are brought together first."""
    with_month(df, ts).repartition("partition_month").write.mode("overwrite").partitionBy("partition_month").parquet(path)


def write_json_lines(df: DataFrame, path: str, by: str) -> None:
    df.write.mode("overwrite").partitionBy(by).json(path)


def _known(spark: SparkSession, path: str) -> DataFrame | None:
    """A table that the first run does not have yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def rebuild(spark: SparkSession, parts: DataFrame, key: str, root: str, version: str) -> int:
    """Load the partitions of ``parts`` that this version lacks, then point at it; gives how many were left.

    A partition is written by replacing its folder and only then noted as done, so a run that broke off in between
    writes it once more and no row twice. The pointer is the last of a growing list, so there always is one.
    """
    out, done = f"{root}/version={version}", f"{root}/done"
    names = parts.select(F.lit(version).alias("version"), F.col(key).cast("string").alias(key)).distinct()
    known = _known(spark, done)
    left = (names if known is None else names.join(known.select("version", key), ["version", key], "left_anti")).cache()
    n = left.count()
    if n:
        todo = parts.join(left.select(key), parts[key].cast("string") == left[key], "left_semi")
        todo.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(out)
        left.write.mode("append").parquet(done)
    left.unpersist()
    turns = _known(spark, f"{root}/current")
    turn = 0 if turns is None else turns.agg(F.max("turn")).first()[0] + 1
    spark.createDataFrame([(turn, version)], "turn long, version string").coalesce(1).write.mode("append").parquet(f"{root}/current")
    return n


def read_current(spark: SparkSession, root: str) -> DataFrame:
    """The version that the last finished rebuild points at."""
    version = spark.read.parquet(f"{root}/current").orderBy(F.desc("turn")).first()["version"]
    return spark.read.parquet(f"{root}/version={version}")


def upsert(target: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """The target after updates: matching keys take the new row, others are added. Keys must be unique on each side."""
    rest = [c for c in target.columns if c not in keys]
    u = updates.select(*keys, *(F.col(c).alias(f"new_{c}") for c in rest), F.lit(True).alias("has_new"))
    both = target.join(u, keys, "full")
    return both.select(*keys, *(F.when(F.col("has_new"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in rest))


def fill_blanks(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Only blank columns of the target are filled."""
    s = source.select(*keys, *(F.col(c).alias(f"new_{c}") for c in columns))
    filled = {c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.col(f"new_{c}")) for c in columns}
    return target.join(s, keys, "left").select(*(filled[c].alias(c) if c in filled else F.col(c) for c in target.columns))


def patch(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Every non-blank value of the source overwrites the target's."""
    s = source.select(*keys, *(F.col(c).alias(f"new_{c}") for c in columns))
    new = {c: F.coalesce(F.nullif(F.trim(f"new_{c}"), F.lit("")), F.col(c)) for c in columns}
    return target.join(s, keys, "left").select(*(new[c].alias(c) if c in new else F.col(c) for c in target.columns))


def replace_by_key(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the keys in ``rows`` give way to ``rows``."""
    return target.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows.select(target.columns))


def purge(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without rows of purged keys, and how many rows each loses."""
    left, counts = {}, None
    for name, (df, column) in tables.items():
        ids = gone.select(F.col(key).alias(column))
        left[name] = df.join(ids, column, "left_anti")
        n = df.join(ids, column, "left_semi").agg(F.lit(name).alias("child"), F.count(F.lit(1)).alias("purged"))
        counts = n if counts is None else counts.unionByName(n)
    return left, counts


def snapshot(df: DataFrame, key: str, column: str, at: str) -> DataFrame:
    return df.select(key, column, F.lit(at).cast("timestamp_ntz").alias("taken_at"))


def restore(df: DataFrame, snap: DataFrame, key: str, column: str) -> DataFrame:
    old = snap.select(key, F.col(column).alias("old"))
    return df.join(old, key, "left").withColumn(column, F.coalesce("old", column)).drop("old")


def retain(df: DataFrame, ts: str, now: str, days: int) -> DataFrame:
    return df.where(F.col(ts) >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS"))


def retain_parents(parents: DataFrame, children: DataFrame, key: str, ts: str, now: str, days: int) -> DataFrame:
    """A parent goes only when it is old and has no child left."""
    old = F.col(ts) < F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")
    marked = parents.join(children.select(key, F.lit(True).alias("c")).distinct(), key, "left")
    return marked.where(~old | F.col("c")).drop("c")


#: Chunks of one part of a bundle.
PART = 200


def item_bundles(chunks: DataFrame, part: int = PART) -> DataFrame:
    """item_id, part, text: one text document for each item in parts of at most ``part`` chunks: a header first, then the chunks in order with their kind.

    Chunks are counted off within ranges of their place, so an item with a third of all rows is many small groups.
    """
    line = F.concat(F.lit("## "), F.col("content_type"), F.lit("\n"), F.col("text"))
    spans = chunks.groupBy("item_id", "chunk_index").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("item_id").orderBy("chunk_index")) - F.col("n")
    nth = F.row_number().over(Window.partitionBy("item_id", "chunk_index").orderBy("id"))
    placed = chunks.withColumn("nth", nth).join(spans.select("item_id", "chunk_index", upto.alias("before")), ["item_id", "chunk_index"])
    placed = placed.withColumn("at", F.col("before") + F.col("nth") - 1).withColumn("part", F.floor(F.col("at") / part))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", line.alias("line")))), lambda x: x["line"]), "\n")
    head = F.when(F.col("part") == 0, F.concat(F.lit("# "), F.col("title"), F.lit("\n"))).otherwise(F.lit(""))
    titles = chunks.groupBy("item_id").agg(F.min("title").alias("title"))
    return placed.groupBy("item_id", "part").agg(body.alias("body")).join(titles, "item_id").select("item_id", "part", F.concat(head, "body").alias("text"))
