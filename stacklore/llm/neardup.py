"""Near-duplicates of word-shingle multisets by BagMinHash, banding and verification.

A text's multiset of five-word shingles is a weighted set: a shingle that stands w
times has weight w. Weights are cut at the whole numbers, and the cuts are grouped
into the dyadic intervals (0,1], (1,2], (2,4], ...; each (shingle, interval) carries
its own Poisson process of the interval's length as rate, whose points fall on a
register and on a place in the interval. A point counts where its place is not
above w. Each register keeps its earliest point, so two texts agree in a register
with the probability of their weighted Jaccard similarity, and a weight of
thousands costs a few processes only. Points are made up to a time at which all
registers should be filled; texts with an empty one go on to twice that time.

Registers are banded; texts that agree in a whole band are candidates. Links are
looked for in three ways, each of which only adds links that the overlap of the
whole multisets confirms:

1. In each band's bucket the member that shares most with others is the hub. A text
   is held against one hub, that with which it shares most buckets, so n texts make
   n pairs at most, however large a bucket is.
2. Buckets whose members are still in different classes get further hubs of other
   classes, as long as that finds links.
3. What is left there meets under a second key: the rarest copies of its shingles.
   Two multisets that overlap by the threshold share one of the rarest
   size - threshold * size + 1 copies of each, so no link is lost, and texts of one
   bucket that only resemble each other share none of them.

Classes are the connected components of links, so pairs within a class need no test
of their own. Exact copies are one node from the start.

Rows are told apart by a number of their own, so different texts under one doc_id
stay different, rows that repeat a text are one class, and rows with a null doc_id
belong to classes too (their class_id is the least doc_id of the class, null if it
has none). Texts without words, null and empty ones belong to no class but their
own. A text of fewer than five words is one shingle. Ties between hubs go to the
larger row number. An empty table gives an empty result; extra columns are ignored,
or carried as they are by ``drop_near_duplicates``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stacklore.llm.base import forget, keep, light, numbered, passing, sifted, slices
from stacklore.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHINGLE, THRESHOLD = 5, 0.8
#: Registers, and how many bits of each are kept.
REGISTERS, BITS = 216, 10
#: What a pair at the threshold may fail by: the chance to share no band, and standard
#: deviations of agreeing registers below their expected number.
MISS, SIGMAS = 1e-4, 4.5
#: Rounds with hubs of other classes, and buckets that a text must share with its hub in them.
HUB_ROUNDS, LEAST_SHARED = 3, 3
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that like numbers get unlike hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, count), ordered by document and hash."""
    parts = [WORD.findall(t) if t else [] for t in texts]
    known = {w: xxhash.xxh3_64_intdigest(w) for w in set().union(*parts)} if parts else {}
    n = np.array([len(p) for p in parts], np.int64)
    words = np.fromiter((h for p in parts for h in map(known.__getitem__, p)), np.uint64, int(n.sum()))
    begin = np.cumsum(n) - n
    made = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    doc = np.repeat(np.arange(len(parts)), made)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(made) - made, made) + begin[doc]
    end = (begin + n)[doc]
    h = np.zeros(len(doc), np.uint64)
    for k in range(size):
        there = at + k < end
        w = words[np.where(there, at + k, 0)] if len(words) else h
        h = mixed(h + GOLDEN + np.where(there, w, np.uint64(k)))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(doc) != 0) | (h[1:] != h[:-1])))) if len(doc) else np.zeros(0, np.int64)
    return doc[first], h[first], np.diff(np.append(first, len(doc)))


def bag_signatures(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """n x registers point numbers; all 0 where a document has no items."""
    out = np.zeros((n, registers), np.uint64)
    total = np.bincount(doc, weight, minlength=n)
    todo = np.flatnonzero(total > 0)
    # (item, interval): interval 0 is (0,1], interval j is (2^(j-1), 2^j]
    top = np.ceil(np.log2(weight)).astype(np.int64) + 1 if len(weight) else weight
    own = np.repeat(np.arange(len(doc)), top)
    level = np.arange(len(own)) - np.repeat(np.cumsum(top) - top, top)
    key = mixed(item[own] + level.astype(np.uint64) * GOLDEN)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    rate = np.where(level == 0, 1, low).astype(np.float64)
    until = np.zeros(n)
    until[todo] = registers * (np.log(registers) + 2.0) / total[todo]
    while len(todo):
        at = np.flatnonzero(np.isin(doc[own], todo)) if len(todo) < n else np.arange(len(own))
        best, point = np.full(n * registers, np.inf), np.zeros(n * registers, np.uint64)
        time, k = np.zeros(len(at)), 0
        while len(at):
            k += 1
            h = mixed(key[at] + np.uint64(k * int(GOLDEN) % (1 << 64)))
            time = time - np.log(((h >> np.uint64(24)).astype(np.float64) + 0.5) * 2.0**-40) / rate[at]
            early = time <= until[doc[own[at]]]
            at, time, h = at[early], time[early], h[early]
            g = mixed(h)
            place = low[at] + 1 + ((g >> np.uint64(32)).astype(np.float64) * 2.0**-32 * rate[at]).astype(np.int64)
            counts = place <= weight[own[at]]
            slot = (doc[own[at]] * registers + ((g & np.uint64(0xFFFFFFFF)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64))[counts]
            t, h = time[counts], h[counts]
            np.minimum.at(best, slot, t)
            won = best[slot] == t
            point[slot[won]] = h[won]
        filled = np.isfinite(best.reshape(n, registers)[todo]).all(axis=1)
        done = todo[filled]
        out[done] = point.reshape(n, registers)[done]
        todo = todo[~filled]
        until[todo] *= 2
    return out


def overlap(a: list[str | None], b: list[str | None], size: int = SHINGLE) -> np.ndarray:
    """Weighted Jaccard similarity of the shingle multisets of each pair of texts."""
    n = len(a)
    (da, ha, wa), (db, hb, wb) = shingles(a, size), shingles(b, size)
    doc, h, w = np.concatenate((da, db)), np.concatenate((ha, hb)), np.concatenate((wa, wb))
    order = np.lexsort((h, doc))
    doc, h, w = doc[order], h[order], w[order]
    twin = np.flatnonzero((doc[1:] == doc[:-1]) & (h[1:] == h[:-1]))
    both = np.bincount(doc[twin], np.minimum(w[twin], w[twin + 1]), minlength=n)
    total = np.bincount(doc, w, minlength=n)
    return both / np.maximum(total - both, 1)


def rows_of_band(threshold: float) -> int:
    """Registers of a band: the most with which a pair at the threshold hardly ever shares no band."""
    able = [r for r in (6, 4, 3, 2) if (1 - threshold**r) ** (REGISTERS // r) <= MISS]
    return able[0] if able else 1


def least_agreement(threshold: float) -> int:
    """Registers in which a pair at the threshold agrees at least, but for a chance of a few in a million."""
    return max(0, int(REGISTERS * threshold - SIGMAS * (REGISTERS * threshold * (1 - threshold)) ** 0.5))


def _sign(rows: int):
    bands = REGISTERS // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, names, texts in slices(batches, text=2, limit=1_500_000):
            doc, item, weight = shingles(texts)
            points = bag_signatures(doc, item, weight, len(texts))
            some = np.zeros(len(texts), bool)
            some[doc] = True
            key = np.zeros((len(texts), bands), np.uint64)
            for k in range(rows):
                key = (key << np.uint64(BITS)) | (points[:, k::rows] & np.uint64((1 << BITS) - 1))
            columns = [
                pa.array(ids, pa.int64()),
                pa.array(names, pa.int64()),
                pa.array([xxhash.xxh3_128_digest(t) if s else None for t, s in zip(texts, some)], pa.binary()),
                pa.array(list(key.view(np.int64)), pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "copy", "bands"])

    return run


def agreement(a: Column, b: Column, rows: int) -> Column:
    """Registers in which two arrays of bands agree: fields that are zero in the
    exclusive or of their bands, counted a whole band at a time."""
    high = sum(1 << (BITS * i + BITS - 1) for i in range(rows))
    low = (1 << (BITS * rows)) - 1 - high
    total = F.lit(0)
    for i in range(REGISTERS // rows):
        z = a[i].bitwiseXOR(b[i])
        carried = (z.bitwiseAND(F.lit(low)) + F.lit(low)).bitwiseOR(z)
        total = total + (F.lit(rows) - F.bit_count(carried.bitwiseAND(F.lit(high))))
    return total


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, x, b, y in slices(batches, limit=1_000_000):
            sim = overlap(x, y)
            ok = sim >= threshold
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(a, np.int64)[ok]), pa.array(np.array(b, np.int64)[ok]), pa.array(sim[ok])], ["a", "b", "similarity"]
            )

    return run


def _links(pairs: DataFrame, members: DataFrame, threshold: float, agreeing: int = 0) -> DataFrame:
    """Those pairs (a, b) whose registers agree often enough and whose texts overlap enough, with their similarity."""
    names = ("text", "bands") if agreeing else ("text",)
    own = lambda x: members.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in names))
    both = pairs.join(own("a"), "a").join(own("b"), "b")
    if agreeing:
        both = both.where(agreement(F.col("bands_a"), F.col("bands_b"), rows_of_band(threshold)) >= agreeing)
    return both.select("a", "text_a", "b", "text_b").mapInArrow(_verify(threshold), "a long, b long, similarity double")


def _mixed_buckets(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """band, node, comp of the buckets whose members are not yet of one class."""
    own = buckets.join(labels, "node", "left").select("band", "node", F.coalesce("comp", "node").alias("comp"))
    torn = own.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("band")
    return own.join(torn, "band")


def _hub_pairs(left: DataFrame, degree: DataFrame, turn: int) -> DataFrame:
    """(a, b): each node of ``left`` (band, node, comp) with the hub of another class that it meets in most buckets."""
    weight = F.struct(F.xxhash64(F.lit(turn), F.col("comp")) if turn else F.lit(0).alias("turn"), "degree", "node")
    hub = left.join(degree, "node").groupBy("band").agg(F.max_by(F.struct(F.col("node").alias("hub"), F.col("comp").alias("of")), weight).alias("r")).select("band", "r.hub", "r.of")
    shared = left.join(hub, "band").where("comp <> of").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_SHARED)
    return shared.groupBy(F.col("node").alias("a")).agg(F.max(F.struct("n", "hub")).getField("hub").alias("b"))


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every copy of a shingle in each text as a number of its own: (node, element)."""
    for nodes, texts in slices(batches, text=1, limit=500_000):
        doc, item, weight = shingles(texts)
        own = np.repeat(np.arange(len(doc)), weight)
        nth = np.arange(len(own)) - np.repeat(np.cumsum(weight) - weight, weight)
        element = mixed(item[own] + (nth + 1).astype(np.uint64) * GOLDEN).view(np.int64)
        columns = (np.array(nodes, np.int64)[doc[own]], element)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["node", "element"])


def _rare_pairs(left: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of different classes among the nodes of ``left`` that share one of their rarest copies of shingles
    and whose sizes and places in that order let them reach the threshold: no pair that reaches it is missing."""
    nodes = left.select("node", "comp").distinct()
    texts = sifted(members.select("node", "text"), nodes, "node")[0].join(nodes, "node", "left_semi")
    every = keep(texts.mapInArrow(_copies, "node long, element long"), "elements")
    often = every.groupBy("element").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # copies that stand in one text only come first in its order, and meet nothing
    shared = every.join(often, "element")
    nth = Window.partitionBy("node").orderBy(F.desc("n"), "element")
    # counted from the end: what is left of the text from this place on, the place included
    ranked = shared.withColumn("rest", F.row_number().over(nth))
    # classes and sizes meet the copies of a text where these are together already
    ranked = ranked.join(nodes.join(every.groupBy("node").agg(F.count(F.lit(1)).alias("size")), "node"), "node")
    prefix = ranked.where(F.col("rest") >= F.ceil(F.col("size") * threshold - 1e-9)).select("element", "node", "comp", "size", "rest")
    other = prefix.select("element", *(F.col(c).alias(f"{c}2") for c in ("node", "comp", "size", "rest")))
    need = (F.col("size") + F.col("size2")) * (threshold / (1 + threshold)) - 1e-6
    able = (F.col("node") < F.col("node2")) & (F.col("comp") != F.col("comp2")) & (F.least("rest", "rest2") >= need) & (F.least("size", "size2") >= need)
    return prefix.join(other, "element").where(able).select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct()


def _classes(every: DataFrame, number: str, threshold: float, hub_rounds: int = HUB_ROUNDS, over: bool = False) -> DataFrame:
    """row, doc_id, class_id, copy_of, kept (one row of each class) of every row of ``every`` (doc_id, text and the column ``number``).

    If the kept table ``every`` is ``over`` with this, it goes after its last reader."""
    base = light(every).select(F.col(number).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = keep(base.mapInArrow(_sign(rows_of_band(threshold)), "row long, doc_id long, copy binary, bands array<long>"), "signed")
    worded = signed.where("copy IS NOT NULL")
    first = F.min(F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "row"))
    # texts that stand more than once, each with its first row
    twins = worded.groupBy("copy").agg(first.alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    twins = keep(twins.select("copy", F.col("f.row").alias("node"), F.col("f.doc_id").alias("copy_of")), "twins")
    # signatures of texts without a copy need not meet the twins
    doubtful, single = sifted(worded.select("row", "copy", "bands"), twins, "copy")
    doubtful = doubtful.join(twins.select("copy", "node"), "copy", "left").where("node IS NULL OR node = row")
    heads = keep(single.unionByName(doubtful.select(single.columns)).select(F.col("row").alias("node"), "bands"), "heads")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("copy_of")).alias("copy_of")
    of = worded.select("row", "doc_id", "copy").join(twins, "copy", "left").select("row", "doc_id", F.coalesce("node", "row").alias("node"), own)
    of, alone = keep(of, "rows"), keep(signed.where("copy IS NULL").select("row", "doc_id"), "alone")
    forget(signed)
    nodes = heads.select("node", F.posexplode("bands").alias("nth", "value")).select("node", F.xxhash64("nth", "value").alias("band"))
    shared = keep(nodes.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    buckets = keep(sifted(nodes, shared, "band")[0].join(shared, "band"), "buckets")
    degree = keep(buckets.groupBy("node").agg(F.sum("n").alias("degree")), "degrees")
    texts = base.select(F.col("row").alias("node"), "text")
    members = sifted(texts, degree, "node")[0].join(degree, "node").join(sifted(heads, degree, "node")[0], "node")
    members = keep(members.select("node", "bands", "text"), "members")
    for df in (heads, shared, *([every] if over else [])):
        forget(df)
    left = buckets.select("band", "node", F.col("node").alias("comp"))
    found = keep(_links(_hub_pairs(left, degree, 0), members, threshold), "links")
    labels = components(found)
    left = keep(_mixed_buckets(buckets, labels), "left")
    for turn in range(1, hub_rounds):
        new = keep(_links(_hub_pairs(left, degree, turn), sifted(members, left, "node")[0], threshold), "links")
        if not new.limit(1).count():
            break
        found = found.unionByName(new)
        labels = components(found)
        left = keep(_mixed_buckets(left.select("band", "node"), labels), "left")
    if left.limit(1).count():
        able = sifted(members, left, "node")[0]
        new = keep(_links(_rare_pairs(left, members, threshold), able, threshold, least_agreement(threshold)), "links")
        if new.limit(1).count():
            labels = components(found.unionByName(new))
    # the classes of linked texts, and then of all rows
    least = of.where("row = node").join(labels, "node").groupBy("comp").agg(first.alias("f"))
    placed = labels.join(least, "comp").select("node", F.col("f.doc_id").alias("class_id"), F.col("f.row").alias("chosen"), F.lit(True).alias("linked"))
    placed = keep(placed, "placed")
    known = of.join(placed, "node", "left").select(
        "row", "doc_id", F.when(F.col("linked"), F.col("class_id")).otherwise(F.col("copy_of")).alias("class_id"), "copy_of", (F.coalesce("chosen", "node") == F.col("row")).alias("kept")
    )
    return known.unionByName(alone.select("row", "doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"), F.lit(True).alias("kept")))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class) and copy_of (the least
    doc_id with the very same text) of every row of ``docs`` (doc_id, text)."""
    return _classes(*numbered(docs.select("doc_id", "text")), threshold, over=True).select("doc_id", "class_id", "copy_of")


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class, that with the least doc_id (null last; of
    rows that share it the first as numbered); all columns stay as they are."""
    every, number = numbered(docs)
    with passing() as kept:
        keep(_classes(every, number, threshold).where("NOT kept").select(F.col("row").alias(number)), "gone")
        gone = kept.pop()
    return every.join(gone, number, "left_anti").select(docs.columns)
