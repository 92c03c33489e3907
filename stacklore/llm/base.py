"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stacklore.sources.shared import shared_dir  # noqa: F401

#: Text handed to one numpy step inside a task, in characters.
SLICE_CHARS = 3_000_000
#: Bytes of an Arrow batch, about.
BATCH_BYTES = 8_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: the lineage is cut,
    and a lost executor costs no recomputation of what lies before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.kept_at = path
    if _open:
        _open[-1].append(kept)
    return kept


#: Tables kept within each ``passing`` block that is open.
_open: list[list[DataFrame]] = []


@contextmanager
def passing() -> Iterator[list[DataFrame]]:
    """Tables kept inside are removed at the end of the block, but for those that are taken out of its list."""
    _open.append([])
    try:
        yield _open[-1]
    finally:
        for df in _open.pop():
            forget(df)


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` kept, with a number for each row in a column whose name is free, and that name."""
    name, taken = "row_number", {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return keep(df.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def below(share: float) -> int:
    """The largest of the numbers ``place`` that the given share of rows stays at or below."""
    return int(min(1.0, share) * (1 << 63)) - 1


def place(*cols: str) -> Column:
    """A number from 0 to 2^63 - 1 that only the values of the columns settle."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 1)


def sampled(rows: DataFrame, most: int, by: str | None = None) -> DataFrame:
    """text, h and ``by`` of the ``most`` different texts of ``rows`` (text, by), for each value of ``by``, whose hashes come first.

    Copies are one text however many rows they fill, so no sample grows thin where texts repeat. Only hashes are shuffled
    to find the sample, and each task gives on ``most`` of them at most.
    """
    keys = [by] if by else []
    hashed = rows.where("text IS NOT NULL").select(*keys, place("text").alias("h"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("h"))
    chosen = hashed.distinct()
    chosen = chosen.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth") if by else chosen.orderBy("h").limit(most)
    return rows.select("text", *keys, place("text").alias("h")).join(F.broadcast(chosen), [*keys, "h"]).groupBy(*keys, "h").agg(F.min("text").alias("text"))


#: Bits of the table that tells rows apart before a join, 64 to a row of it.
SIEVE_BITS = 1 << 24


def sifted(rows: DataFrame, keys: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """The ``rows`` whose ``column`` may stand in that of ``keys``, and those for which it can not.

    Hashes of the keys set bits of a table of bounded size (4 MB at most), which is broadcast. All rows with a key are among
    the first, and few others until the keys are about as many as bits; a join that follows shuffles the first ones only.
    """
    word = F.expr(f"(xxhash64({column}) & {SIEVE_BITS - 1}) div 64").alias("sieve_word")
    bit = f"shiftleft(1L, CAST(xxhash64({column}) & 63 AS INT))"
    table = keys.groupBy(word).agg(F.expr(f"bit_or({bit})").alias("sieve_bits"))
    told = rows.select("*", word).join(F.broadcast(table), "sieve_word", "left")
    may = F.expr(f"coalesce(sieve_bits & {bit}, 0) <> 0")
    return told.where(may).select(rows.columns), told.where(~may).select(rows.columns)


def forget(df: DataFrame) -> None:
    """Remove the folder of a kept table that nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.kept_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def light(df: DataFrame) -> DataFrame:
    """``df``, whose texts go to Python in Arrow batches of ``BATCH_BYTES``: the usual ones hold thousands of whole texts twice."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def slices(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = SLICE_CHARS) -> Iterator[tuple[list, ...]]:
    """Columns as Python lists, cut so that the text column of a piece holds
    about ``limit`` characters (one row at least; rows are never cut)."""
    for batch in batches:
        start, size = 0, 0
        lens = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
        for i, n in enumerate(lens):
            if size and size + n > limit:
                yield tuple(c.slice(start, i - start).to_pylist() for c in batch.columns)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield tuple(c.slice(start).to_pylist() for c in batch.columns)
