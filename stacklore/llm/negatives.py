"""Hard negatives by a BOND scan: branch and bound over vertically stored dimensions.

Vectors are whole numbers, floor(256 x) of each component, so inner products are exact.
Rows fall by hash into blocks of at most ``ROWS``, anchors into groups of at most
``ANCHORS``; every group meets every block once, as one task's work. A block stands in
memory dimension by dimension, with the least and the largest number of each.

For one anchor the dimensions are read by descending size of its own components. After
each step every candidate has a partial product, and what the dimensions not yet read can
add lies between two sums of the block's least and largest numbers times the anchor's
components. Both bounds shrink a bitmap of candidates:

1. Positives. Among rows of the anchor's label the k-th best lower bound throws out all
   candidates whose upper bound is below it.
2. Negatives. Each positive opens a window of scores, from ``low`` to ``high`` of its
   own. A candidate of another label stays while it can lie in one of the windows and
   is not below the k-th best lower bound of those that lie in the window for certain.

Candidates that are left when all dimensions are read have exact scores; each block's
first ones of each window go on, and the first of all blocks are the result.

Rows with a null label, a null vector or a null, NaN or infinite component take no part.
A vector shorter than others counts 0 in what it lacks; components are cut where products
would not fit a long (``limit``). Higher scores come first, ties by smaller vec_id, null
ids last; rows that repeat an id are rows of their own, as positives (told apart by
``positive_rank``) and as negatives, and an id that repeats an anchor's is an anchor. An anchor
without positives, or a positive without rows in its window, gives no rows, nor does an
empty table. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stacklore.llm.base import keep

#: Rows of a block and anchors of a group, at most, about.
ROWS, ANCHORS = 65_536, 65_536
#: Dimensions read between two looks at the bounds.
STEP = 8
POSITIVES, NEGATIVES = 5, 10
LAST = np.iinfo(np.int64).max


def limit(dims: int) -> int:
    """The largest component whose products, times 100, still fit a long."""
    return math.isqrt((1 << 56) // max(dims, 1))


class Block:
    """The vectors of some rows, one array a dimension, ordered by id."""

    def __init__(self, table: pa.Table):
        ids = table.column("vec_id").to_pylist()
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i])), np.int64)
        self.ids = [ids[i] for i in order]
        self.rows = table.column("row").to_numpy()[order]
        self.label = np.array(table.column("label").to_pylist())[order]
        found = _matrix(table.column("vec"))[order]
        self.dims = np.ascontiguousarray(found.T)
        self.least, self.most = self.dims.min(axis=1, initial=0), self.dims.max(axis=1, initial=0)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Whole numbers, a row for each vector; doubles where their products are exact."""
    parts = column.combine_chunks()
    ends = parts.offsets.to_numpy().astype(np.int64)
    flat, size = parts.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]], np.diff(ends)
    out = np.zeros((len(size), int(size.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out


class Scan:
    """Partial products of one anchor with the candidates of a block, and what is left of the bounds."""

    def __init__(self, block: Block, anchor: np.ndarray, able: np.ndarray):
        n = min(len(anchor), len(block.dims))
        order = np.argsort(-np.abs(anchor[:n]), kind="stable")
        self.block, self.able, self.order = block, np.flatnonzero(able), order[anchor[order] != 0]
        self.weight = anchor[self.order]
        ends = (self.weight * block.least[self.order], self.weight * block.most[self.order])
        rest = lambda x: np.append(np.cumsum(x[::-1])[::-1], 0)
        self.under, self.over = rest(np.minimum(*ends)), rest(np.maximum(*ends))
        self.partial, self.read = np.zeros(len(self.able), anchor.dtype), 0

    def step(self) -> bool:
        """Read some dimensions; whether there were any."""
        to = min(self.read + STEP, len(self.order))
        if to == self.read or not len(self.able):
            return False
        dims = self.block.dims[self.order[self.read : to]]
        if len(self.able) < dims.shape[1]:
            dims = dims[:, self.able]
        self.partial = self.partial + self.weight[self.read : to] @ dims
        self.read = to
        return True

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        return self.partial + self.under[self.read], self.partial + self.over[self.read]

    def shrink(self, stay: np.ndarray) -> None:
        if not stay.all():
            self.able, self.partial = self.able[stay], self.partial[stay]


def _kth(values: np.ndarray, k: int):
    """The k-th largest value, None if there are fewer."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else None


def best(scan: Scan, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates that may be among the first ``k`` (ties stay), and their scores."""
    while scan.step():
        low, high = scan.bounds()
        if (bound := _kth(low, k)) is not None:
            scan.shrink(high >= bound)
    return scan.able, scan.partial


def windows(scan: Scan, spans: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates that may be among the first ``k`` of one of the spans (from, to) of scores, and their scores."""
    while True:
        more = scan.step()
        low, high = scan.bounds()
        stay = np.zeros(len(low), bool)
        for lo, hi in spans:
            can = (high >= lo) & (low <= hi)
            if (bound := _kth(low[(low >= lo) & (high <= hi)], k)) is not None:
                can &= high >= bound
            stay |= can
        scan.shrink(stay)
        if not more:
            return scan.able, scan.partial


def _first(block: Block, able: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """The first ``k`` by score and id: the block is ordered by id."""
    return np.lexsort((able, -score))[:k]


POSITIVE = "anchor long, anchor_id long, label string, vec array<long>, positive_row long, positive_id long, positive_score long"
NEGATIVE = "anchor long, anchor_id long, positive_rank int, positive_id long, positive_score long, negative_row long, negative_id long, negative_score long"


def _exact(*parts: np.ndarray) -> bool:
    """Whether all partial products are exact as doubles."""
    a, b = (float(np.abs(p).max(initial=0)) for p in parts)
    return a * b * max(parts[0].shape[-1], parts[1].shape[-1]) < 2**53


def _ready(rows: pa.Table, anchors: pa.Table) -> tuple[Block, np.ndarray]:
    block, vecs = Block(rows), _matrix(anchors.column("vec"))
    if _exact(vecs, block.dims.T):
        block.dims, block.least, block.most, vecs = (x.astype(np.float64) for x in (block.dims, block.least, block.most, vecs))
    return block, vecs


def _positives(k: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and anchors.num_rows:
            block, vecs = _ready(rows, anchors)
            plain = anchors.to_pylist()
            for a, v in zip(plain, vecs):
                able, score = best(Scan(block, v, (block.label == a["label"]) & (block.rows != a["row"])), k)
                out += [(a["row"], a["vec_id"], a["label"], a["vec"], int(block.rows[able[i]]), block.ids[able[i]], int(score[i])) for i in _first(block, able, score, k)]
        return _table(out, POSITIVE)

    return run


def _negatives(k: int, low: int, high: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and anchors.num_rows:
            block, vecs = _ready(rows, anchors)
            for a, v in zip(anchors.to_pylist(), vecs):
                # least and largest whole score of each window
                spans = [(-(-low * p["positive_score"] // 100), high * p["positive_score"] // 100) for p in a["positives"]]
                able, score = windows(Scan(block, v, block.label != a["label"]), spans, k)
                for p, (lo, hi) in zip(a["positives"], spans):
                    own = np.flatnonzero((score >= lo) & (score <= hi))
                    for i in own[_first(block, able[own], score[own], k)]:
                        told = (p["positive_rank"], p["positive_id"], p["positive_score"], int(block.rows[able[i]]), block.ids[able[i]], int(score[i]))
                        out.append((a["row"], a["anchor_id"], *told))
        return _table(out, NEGATIVE)

    return run


TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}


def _table(rows: list[tuple], schema: str) -> pa.Table:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.Table.from_arrays([pa.array(c, TYPES[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def _dealt(rows: DataFrame, anchors: DataFrame, blocks: int, groups: int) -> tuple:
    """Every block with every group of anchors: both sides grouped by (block, group)."""
    upto = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = rows.select("*", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), upto(groups, "group"))
    right = anchors.select("*", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(groups)).cast("int").alias("group"), upto(blocks, "block"))
    return left.groupBy("block", "group"), right.groupBy("block", "group")


def quantised(vectors: DataFrame) -> DataFrame:
    """row, vec_id, label, vec (whole numbers) of the rows of ``vectors`` (vec_id, label, embedding) that take part, kept."""
    whole = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>").alias("vec"))
    fit = F.col("label").isNotNull() & F.coalesce(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)), F.lit(False))
    most = whole.where(fit).agg(F.max(F.size("vec"))).first()[0] or 0
    top = F.lit(float(limit(most)))
    number = lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x * 256, top), -top)), top.cast("long")), -top.cast("long"))
    return keep(whole.where(fit).select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.transform("vec", number).alias("vec")), "vectors")


def hard_negatives(vectors: DataFrame, anchors: str, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank for ``vectors`` (vec_id, label, embedding).

    ``anchors`` is an SQL condition on vec_id. An anchor's positives are its first other rows of its label; each
    gives the first rows of other labels whose score is from ``low`` to ``high`` hundredths of its own.
    """
    rows = quantised(vectors)
    asked = rows.where(anchors)
    n, a = rows.count(), asked.count()
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks, groups = max(1, -(-n // ROWS), min(tasks, -(-n // 1024))), max(1, -(-a // ANCHORS))
    left, right = _dealt(rows, asked, blocks, groups)
    found = keep(left.cogroup(right).applyInArrow(_positives(positives), POSITIVE), "positives")
    order = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), F.col("positive_id").asc_nulls_last(), "positive_row")
    first = found.withColumn("positive_rank", F.row_number().over(order)).where(F.col("positive_rank") <= positives)
    held = first.groupBy(F.col("anchor").alias("row")).agg(
        F.first("anchor_id").alias("anchor_id"), F.first("label").alias("label"), F.first("vec").alias("vec"),
        F.array_sort(F.collect_list(F.struct("positive_rank", "positive_id", "positive_score"))).alias("positives"),
    )
    left, right = _dealt(rows, keep(held, "anchors"), blocks, groups)
    found = keep(left.cogroup(right).applyInArrow(_negatives(negatives, low, high), NEGATIVE), "negatives")
    order = Window.partitionBy("anchor", "positive_rank").orderBy(F.desc("negative_score"), F.col("negative_id").asc_nulls_last(), "negative_row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank")


#: The same rows as DuckDB SQL, for the query's parameters.
ORACLE_SQL = r"""
WITH fit AS (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
scores AS (
  SELECT a.row AS anchor, a.vec_id AS anchor_id, b.row, b.vec_id, a.label = b.label AS same, list_inner_product(a.vec, b.vec)::BIGINT AS score
  FROM fit a JOIN fit b ON a.row <> b.row AND a.vec_id % 100 = 0),
positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS nth FROM scores WHERE same) WHERE nth <= 5),
told AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.nth AS positive_rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.nth ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positives p JOIN scores n ON n.anchor = p.anchor AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank FROM told WHERE rank <= 10
"""
