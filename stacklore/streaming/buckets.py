"""A keyed table in hash buckets that micro-batches upsert into, and sums that follow it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class BucketTable:
    """Rows by key in ``buckets`` folders; a batch rewrites only the buckets that it touches.

    A batch writes its buckets under its own number and is done when that folder has its mark; a bucket's rows are those of the
    last batch that is done. Older folders of a bucket go once the next batch has been written, so each bucket is read from one
    folder however many batches there were. A batch that runs again is left as it is if it is done, and
    replaces what it left behind if not. All rows of an item lie in one bucket, which ``bucket_by`` names.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], bucket_by: str, order: str, buckets: int = 16):
        self.spark, self.path, self.keys, self.bucket_by, self.order, self.buckets = spark, path, keys, bucket_by, order, buckets

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        p, fs = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def done(self) -> list[int]:
        """Numbers of the batches that are done, ascending."""
        runs = [n for n in self._names(self.path) if n.startswith("batch=")]
        return sorted(int(n.removeprefix("batch=")) for n in runs if "_SUCCESS" in self._names(f"{self.path}/{n}"))

    def current(self) -> dict[int, str]:
        """The folder of each bucket."""
        found = {}
        for n in self.done():
            found |= {int(b.removeprefix("bucket=")): f"{self.path}/batch={n}/{b}" for b in self._names(f"{self.path}/batch={n}") if b.startswith("bucket=")}
        return found

    def read(self, schema: str, only: list[int] | None = None) -> DataFrame:
        folders = [f for b, f in sorted(self.current().items()) if only is None or b in only]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.bucket_by), F.lit(self.buckets)).cast("int")

    def upsert(self, batch: DataFrame, number: int) -> None:
        """Put the rows of ``batch`` in place of those with their keys; of rows that share a key the last by ``order`` stays."""
        if number in self.done():
            return
        batch = batch.withColumn("bucket", self.bucket())
        touched = [r["bucket"] for r in batch.select("bucket").distinct().collect()]  # at most ``buckets``
        old = self.current()
        columns = [c for c in batch.columns if c != "bucket"]
        schema = batch.select(columns).schema
        was = [old[b] for b in touched if b in old]
        known = self.spark.read.schema(schema).parquet(*was) if was else self.spark.createDataFrame([], schema)
        both = known.withColumn("new", F.lit(0)).unionByName(batch.select(columns).withColumn("new", F.lit(1)))
        nth = F.row_number().over(Window.partitionBy(*self.keys).orderBy(F.desc(self.order), F.desc("new")))
        left = both.withColumn("nth", nth).where("nth = 1").drop("nth", "new").withColumn("bucket", self.bucket())
        left.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/batch={number}")
        self._drop_old(old, set(touched))

    def _drop_old(self, old: dict[int, str], touched: set[int]) -> None:
        """Remove folders that this batch has replaced."""
        for b in touched & set(old):
            p, fs = self._fs(old[b])
            fs.delete(p, True)


def refresh(table: BucketTable, sums: BucketTable, schema: str, by: str, measures: dict[str, Column]) -> Callable[[DataFrame, int], None]:
    """A batch function: upsert the batch, then count the touched items anew from their buckets alone."""

    def apply(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        table.upsert(batch, number)
        items = batch.select(by).distinct()
        touched = [r["b"] for r in items.select(F.pmod(F.xxhash64(by), F.lit(table.buckets)).cast("int").alias("b")).distinct().collect()]
        rows = table.read(schema, touched).join(items, by, "left_semi")
        sums.upsert(rows.groupBy(by).agg(*(F.sum(c).cast("long").alias(n) for n, c in measures.items())).withColumn("batch_number", F.lit(number).cast("long")), number)
        batch.unpersist()

    return apply
