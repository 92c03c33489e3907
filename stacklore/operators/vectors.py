"""Vector search and arithmetic over array<float> columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def unit(v: Column) -> Column:
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def with_units(df: DataFrame, vec: str = "vec") -> DataFrame:
    """The normalised vector in ``unit``, so that a pair costs one product."""
    return df.withColumn("unit", unit(F.col(vec)))


#: Query vectors held against the corpus in one reading of it, and pairs of one matrix product.
BLOCK_ROWS, STEP_PAIRS = 20_000, 1 << 20


def _by_length(vecs: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and normalised vectors of each length; null vectors and those with a null in them are left out."""
    vecs = vecs.combine_chunks() if isinstance(vecs, pa.ChunkedArray) else vecs
    length = pc.fill_null(pc.list_value_length(vecs), -1).to_numpy(zero_copy_only=False)
    if vecs.flatten().null_count:
        length = np.array([n if n < 0 or None not in v else -1 for n, v in zip(length, vecs.to_pylist())])
    out = {}
    for n in set(length.tolist()) - {-1}:
        at = np.flatnonzero(length == n)
        m = np.asarray(vecs.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(at), n)
        norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
        out[n] = at, np.where(norm > 0, m / np.where(norm > 0, norm, 1.0), m)
    return out


def _sims(a: dict, b: dict, rows: int, cols: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Likeness of each vector of ``a`` and of ``b``, and where there is none, as one is null or of another length."""
    if len(a) == len(b) == 1 and (same := a.keys() & b.keys()):
        (i, x), (j, y) = a[n := same.pop()], b[n]
        if len(i) == rows and len(j) == cols:
            return x @ y.T, None
    sims, none = np.zeros((rows, cols)), np.ones((rows, cols), bool)
    for n in a.keys() & b.keys():
        (i, x), (j, y) = a[n], b[n]
        sims[np.ix_(i, j)], none[np.ix_(i, j)] = x @ y.T, False
    return sims, none


def _against(queries: DataFrame, corpus: DataFrame, make: Callable, schema: T.StructType, block_rows: int) -> DataFrame:
    """The corpus through ``make(queries)`` for each block of queries, which all tasks hold; ``queries`` there are (ids, vectors as Arrow)."""
    q = queries.select(F.col("id").alias("query_id"), "vec")
    n = -(-q.count() // block_rows)
    out = corpus.sparkSession.createDataFrame([], schema)
    for i in range(n):
        part = (q if n == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i)).toArrow()
        found = corpus.mapInArrow(make(corpus.sparkSession.sparkContext.broadcast((part["query_id"].combine_chunks(), part["vec"].combine_chunks()))), schema)
        out = found if i == 0 else out.unionByName(found)
    return out


def _steps(asked, rows: int) -> Iterator[tuple[int, int, dict]]:
    """Start, number and vectors of as many queries at a time as make ``STEP_PAIRS`` pairs with ``rows`` rows."""
    ids, vecs = asked.value
    step = max(1, STEP_PAIRS // max(rows, 1))
    for at in range(0, len(ids), step):
        part = vecs.slice(at, step)
        yield at, len(part), _by_length(part)


def similar(queries: DataFrame, corpus: DataFrame, floor: float | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, the columns of ``corpus`` but vec, and sim of every query and corpus row, from about ``floor`` on if there is one
    (a little below it, so that no rounding loses a pair). A pair has no sim where a vector is null or their lengths differ."""
    others = [f for f in corpus.schema if f.name != "vec"]
    schema = T.StructType([T.StructField("query_id", queries.schema["id"].dataType), *others, T.StructField("sim", T.DoubleType())])

    def make(asked):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own, n = _by_length(batch.column("vec")), batch.num_rows
                for at, m, part in _steps(asked, n):
                    sims, none = _sims(part, own, m, n)
                    if floor is None:
                        r, c = (x.ravel() for x in np.indices((m, n)))
                    else:
                        able = ~(sims < floor - 1e-5)
                        r, c = np.nonzero(able if none is None else able & ~none)
                    sim = pa.array(sims[r, c], pa.float64(), mask=None if none is None else none[r, c])
                    cols = pa.array(c)
                    yield pa.RecordBatch.from_arrays([asked.value[0].take(pa.array(r + at)), *(batch.column(f.name).take(cols) for f in others), sim], schema.names)

        return run

    return _against(queries, corpus, make, schema, block_rows)


def closest(queries: DataFrame, corpus: DataFrame, k: int, weight: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, id, sim (or score, by the row's ``weight``), nth: the first ``k`` of ``corpus`` for each query, by likeness to six digits
    (a score has four), then id. A task gives on its own first ``k`` of each query, so no pair of the others is a row."""
    name = "score" if weight else "sim"
    schema = T.StructType([T.StructField("query_id", queries.schema["id"].dataType), corpus.schema["id"], T.StructField(name, T.DoubleType())])

    def make(asked):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = len(asked.value[0])
            least = np.full(total, -np.inf)  # what a query's k-th has, so what a row needs
            held = [np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0), np.empty(0, bool)]  # query, rank, id, value, null
            for batch in batches:
                own, n = _by_length(batch.column("vec")), batch.num_rows
                ids, found = batch.column("id").to_numpy(zero_copy_only=False), [held]
                w = batch.column(weight).to_numpy(zero_copy_only=False).astype(np.float64) if weight else None
                for at, m, part in _steps(asked, n):
                    value, none = _sims(part, own, m, n)
                    if weight:
                        value = _scored(value if none is None else np.where(none, np.nan, value), w)
                        none = None
                    rank = np.floor(value * 1e6 + 0.5)
                    rank[np.isnan(rank)] = np.inf
                    if none is not None:
                        rank[none] = -np.inf
                    floor = least[at : at + m]
                    if n > k and np.isneginf(floor).any():
                        floor = np.maximum(floor, np.partition(rank, n - k, axis=1)[:, n - k])
                    r, c = np.nonzero(rank >= floor[:, None])
                    found.append([r + at, rank[r, c], ids[c], value[r, c], np.zeros(len(r), bool) if none is None else none[r, c]])
                held = [np.concatenate(x) for x in zip(*found)]
                order = np.lexsort((held[2], -held[1], held[0]))
                query = held[0][order]
                nth = np.arange(len(query)) - np.searchsorted(query, query)
                held = [x[order[nth < k]] for x in held]
                last = nth[nth < k] == k - 1
                least[held[0][last]] = held[1][last]
            yield pa.RecordBatch.from_arrays([asked.value[0].take(pa.array(held[0])), pa.array(held[2]), pa.array(held[3], pa.float64(), mask=held[4])], schema.names)

        return run

    return nearest(_against(queries, corpus.select("id", "vec", *([weight] if weight else [])), make, schema, block_rows), k, name)


def _scored(sim: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """``weighted_score`` to four digits."""
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (1 - (1 - sim) / np.where(weight == 0.0001, np.nan, weight)) * 100
    return np.floor(np.fmax(score, 0.0) * 1e4 + 0.5) / 1e4


def most_similar(queries: DataFrame, corpus: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """id and sim, the greatest likeness to any query, to six digits; null where no query can be held against a row's vector."""
    schema = T.StructType([corpus.schema["id"], T.StructField("sim", T.DoubleType())])

    def make(asked):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own, n = _by_length(batch.column("vec")), batch.num_rows
                best = np.full(n, -np.inf)
                for _, m, part in _steps(asked, n):
                    sims, none = _sims(part, own, m, n)
                    best = np.maximum(best, (sims if none is None else np.where(none, -np.inf, sims)).max(axis=0))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(best, mask=np.isneginf(best))], schema.names)

        return run

    found = _against(queries, corpus.select("id", "vec"), make, schema, block_rows)
    return found.groupBy("id").agg(F.max(F.round("sim", 6)).alias("sim"))


def nearest(pairs: DataFrame, k: int, score: str = "sim") -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round(score, 6)), "id")
    return pairs.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k)


def weighted_score(sim: Column, weight: Column) -> Column:
    """Similarity as 0 to 100 after the distance is divided by the row's weight."""
    return F.greatest(F.lit(0.0), (1 - (1 - sim) / F.nullif(weight, F.lit(0.0001))) * 100)


def blend(total: Column, local: Column, horizon: float) -> Column:
    a = 0.9 - 0.6 * horizon
    return unit(F.zip_with(total, local, lambda x, y: a * x + (1 - a) * y))


def centroids(df: DataFrame, key: str) -> DataFrame:
    """Element-wise mean of each key's vectors, summed by position before any row is whole."""
    each = df.select(key, F.posexplode("vec").alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("x"))
    return each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


def near_duplicates(df: DataFrame, key: str, newest: int = 50, centre: float = 0.80, single: float = 0.85) -> DataFrame:
    """id, near_duplicate of vectors (key, id, vec): alike the mean of their key's vectors and any of its ``newest`` others (by id)."""
    units = with_units(df).select(key, "id", "unit")
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("id")))
    recent = units.withColumn("nth", nth).where(F.col("nth") <= newest).select(key, F.col("id").alias("other"), F.col("unit").alias("u"))
    mean = centroids(df.select(key, "id", F.col("vec").cast("array<double>").alias("vec")), key).select(key, unit(F.col("centroid")).alias("c"))
    best = units.join(recent, key).where("id <> other").groupBy("id").agg(F.max(F.round(dot(F.col("unit"), F.col("u")), 6)).alias("best"))
    own = units.join(mean, key).select("id", F.round(dot(F.col("unit"), F.col("c")), 6).alias("own"))
    return own.join(best, "id", "left").select("id", ((F.col("own") >= centre) & (F.coalesce("best", F.lit(0.0)) > single)).alias("near_duplicate"))


def dislike_penalty(sim: Column) -> Column:
    return F.when(F.coalesce(sim, F.lit(0.0)) <= 0.8, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (sim - 0.8) / 0.2))


def zone(sim: Column) -> Column:
    return F.when(sim >= 0.60, "syntopic").when(sim >= 0.45, "discovery").when(sim >= 0.35, "context")


def backfill(core: DataFrame, spare: DataFrame) -> DataFrame:
    """Core rows, and spare rows by how few the core has: all if none, else 4 less one for each ten (one at least) where it has under 35."""
    have = core.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    s = spare.where("score > 45").join(have, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < 35")  # others have no room
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    room = F.when(F.col("n") == 0, F.lit(2147483647)).when(F.col("n") < 35, F.greatest(4 - F.floor(F.col("n") / 10), F.lit(1))).otherwise(0)
    s = s.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= room)
    return core.select("query_id", "id", "score").unionByName(s.select("query_id", "id", "score"))
