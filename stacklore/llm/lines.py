"""Line dedup over sharded cuckoo filters with exact reference counts, reversible document by document.

A ``LineIndex`` holds, for every line key (the line without blanks at its ends, A-Z in
lower case), in how many documents it stands. Adding documents adds to these counts,
removing documents takes away what they had added, so any order of both gives the
counts of the documents that are left. Keys are 128-bit hashes and lie in shards by hash.

Keys that stand in ``least`` documents or more repeat. Each shard keeps them in cuckoo
filters: a key's fingerprint lies in one of two buckets, each bucket's other one is told
by the fingerprint alone, so a key is put in when its count comes up to the limit and
taken out when it falls below, without the other keys. The exact counts say which keys
cross the limit, so nothing is taken out that was not put in. A filter that is full gets
another of twice its size behind it.

``apply`` asks the filters about the lines of documents, shard by shard; what they let
through is confirmed by the exact counts, so a false alarm costs a joined row and no
line. Lines of a shard are dealt by row where there are many, so a line that stands in a
third of all documents is spread out. Only lines that are confirmed go back to their
documents.

Null and empty texts are one empty line. Keys of fewer than ``least_chars`` code points
never repeat, nor does the empty key. A document is a row: repeated rows count each, also under one doc_id, and a
line that a document repeats counts once. An empty table gives an empty result. Extra
columns are ignored, or carried as they are by ``drop_lines``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stacklore.llm.base import forget, keep, light, numbered, slices

LEAST_DOCUMENTS, LEAST_CHARS = 10, 1
BLANK = b"\x20\t\n\x0b\x0c\r"
SHARDS = 256
#: Lines of a shard that one task asks its filters about, at least and at most, about.
PROBE_LEAST, PROBE_MOST = 2_000, 500_000
#: Slots of a bucket, and puts of one key before a filter is full.
SLOTS, PUTS = 4, 200


def line_key(line: bytes) -> bytes:
    return line.strip(BLANK).lower()


def _digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints; ``table`` has a row for each bucket, 0 is a free slot."""

    def __init__(self, buckets: int = 0, table: np.ndarray | None = None):
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    @staticmethod
    def sized(keys: int) -> Cuckoo:
        return Cuckoo(1 << max(2, int(np.ceil(np.log2(max(keys, 1) / (SLOTS * 0.8))))))

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets of each key, told by its two 64-bit halves (n x 2)."""
        print_ = (keys[:, 1] >> np.uint64(48)).astype(np.uint16) | np.uint16(1)
        one = (keys[:, 0] & np.uint64(len(self.table) - 1)).astype(np.int64)
        return print_, one, self.other(one, print_)

    def other(self, bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        return bucket ^ ((print_.astype(np.uint64) * np.uint64(0x5BD1E995) >> np.uint64(7)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        print_, one, two = self.places(keys)
        return (self.table[one] == print_[:, None]).any(axis=1) | (self.table[two] == print_[:, None]).any(axis=1)

    def _swap(self, bucket: int, was: int, now: int) -> bool:
        at = np.flatnonzero(self.table[bucket] == was)
        if len(at):
            self.table[bucket, at[0]] = now
        return bool(len(at))

    def put(self, key: np.ndarray) -> bool:
        """Whether the key is in now; a filter without room stays as it was."""
        print_, one, two = (x[0] for x in self.places(key[None]))
        if self._swap(one, 0, print_) or self._swap(two, 0, print_):
            return True
        moved, bucket = [], int(two)
        for n in range(PUTS):
            slot = n % SLOTS
            moved.append((bucket, slot))
            self.table[bucket, slot], print_ = print_, self.table[bucket, slot]
            bucket = int(self.other(np.array([bucket]), np.array([print_]))[0])
            if self._swap(bucket, 0, print_):
                return True
        for bucket, slot in reversed(moved):
            self.table[bucket, slot], print_ = print_, self.table[bucket, slot]
        return False

    def take(self, key: np.ndarray) -> bool:
        """Whether the key was in; it is out now."""
        print_, one, two = (x[0] for x in self.places(key[None]))
        return self._swap(one, print_, 0) or self._swap(two, print_, 0)


def _halves(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), ">u8").astype(np.uint64).reshape(-1, 2)


class Chain:
    """The filters of a shard, each of twice the size of the one before; bytes in and out."""

    def __init__(self, blobs: list[bytes] = ()):
        self.filters = [Cuckoo(table=np.frombuffer(b, np.uint16).reshape(-1, SLOTS).copy()) for b in blobs]

    def bytes(self) -> list[bytes]:
        return [f.table.tobytes() for f in self.filters]

    def put(self, keys: np.ndarray) -> None:
        for i, key in enumerate(keys):
            if not any(f.put(key) for f in reversed(self.filters)):
                last = SLOTS * len(self.filters[-1].table) if self.filters else 0
                self.filters.append(Cuckoo.sized(max(2 * last, len(keys) - i)))
                self.filters[-1].put(key)

    def take(self, keys: np.ndarray) -> None:
        for key in keys:
            any(f.take(key) for f in self.filters)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        found = np.zeros(len(keys), bool)
        for f in self.filters:
            found |= f.holds(keys)
        return found


def _keys(least_chars: int, shards: int):
    """(row, shard, key) of the distinct keys of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches):
            out: tuple[list, list] = ([], [])
            for row, text in zip(rows, texts):
                found = set(map(line_key, text.encode().split(b"\n"))) if text else ()
                made = [_digest(k) for k in found if k and (len(k) >= 4 * least_chars or len(k.decode()) >= least_chars)]
                out[0].extend([row] * len(made))
                out[1].extend(made)
            shard = (_halves(out[1])[:, 0] >> np.uint64(32)) % np.uint64(shards)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(shard.astype(np.int32)), pa.array(out[1], pa.binary())], ["row", "shard", "key"])

    return run


def _move(filters: pa.Table, moves: pa.Table) -> pa.Table:
    """The filters of a shard after keys came up to the limit or fell below it."""
    chain = Chain([b for bs in filters.column("blobs").to_pylist() for b in bs])
    if moves.num_rows:
        keys, up = _halves(moves.column("key").to_pylist()), moves.column("up").to_numpy(zero_copy_only=False).astype(bool)
        chain.take(keys[~up])
        chain.put(keys[up])
    shard = (filters if filters.num_rows else moves).column("shard")[0].as_py()
    return pa.Table.from_arrays([pa.array([shard], pa.int32()), pa.array([chain.bytes()], pa.list_(pa.binary()))], ["shard", "blobs"])


def _probe(lines: pa.Table, filters: pa.Table) -> pa.Table:
    """The lines that the filters of their shard may hold."""
    if lines.num_rows and filters.num_rows:
        chain = Chain([b for bs in filters.column("blobs").to_pylist() for b in bs])
        lines = lines.filter(pa.array(chain.holds(_halves(lines.column("key").to_pylist()))))
    else:
        lines = lines.slice(0, 0)
    return lines.select(["row", "key"])


def _kept(lines: list[bytes], gone: set[bytes]) -> list[bytes]:
    return [x for x in lines if not (k := line_key(x)) or _digest(k) not in gone] if gone else lines


class LineIndex:
    """Reference counts of line keys and the filters of those that repeat, as tables in the shared folder."""

    def __init__(self, spark: SparkSession, least: int = LEAST_DOCUMENTS, least_chars: int = LEAST_CHARS, shards: int = SHARDS):
        self.least, self.least_chars, self.shards = least, least_chars, shards
        self.counts = spark.createDataFrame([], "shard int, key binary, n long")
        self.filters = spark.createDataFrame([], "shard int, blobs array<binary>")

    def save(self, path: str) -> None:
        """Write the index to a new folder."""
        spark = self.counts.sparkSession
        spark.createDataFrame([(self.least, self.least_chars, self.shards)], "least int, least_chars int, shards int").write.parquet(f"{path}/settings")
        self.counts.write.parquet(f"{path}/counts")
        self.filters.write.parquet(f"{path}/filters")

    @staticmethod
    def load(spark: SparkSession, path: str) -> LineIndex:
        """The index that ``save`` wrote there; the folder stays as it is."""
        found = LineIndex(spark, *spark.read.parquet(f"{path}/settings").first())
        found.counts, found.filters = (spark.read.schema(x.schema).parquet(f"{path}/{name}") for name, x in (("counts", found.counts), ("filters", found.filters)))
        return found

    def lines(self, docs: DataFrame, number: str) -> DataFrame:
        """row, shard, key of the lines of ``docs`` (text and the column ``number``), kept."""
        made = light(docs).select(F.col(number).alias("row"), "text").mapInArrow(_keys(self.least_chars, self.shards), "row long, shard int, key binary")
        return keep(made, "lines")

    def _change(self, lines: DataFrame, by: int) -> None:
        n = F.col("n")
        delta = lines.groupBy("shard", "key").agg(F.count(F.lit(1)).alias("n")).select("shard", "key", F.lit(0).cast("long").alias("was"), (n * by).alias("more"))
        both = self.counts.select("shard", "key", n.alias("was"), F.lit(0).cast("long").alias("more")).unionByName(delta)
        made = keep(both.groupBy("shard", "key").agg(F.sum("was").alias("was"), F.sum(F.col("was") + F.col("more")).alias("n")), "counts")
        moves = made.where((F.col("was") >= self.least) != (n >= self.least)).select("shard", "key", (n >= self.least).alias("up"))
        new = keep(self.filters.groupBy("shard").cogroup(moves.groupBy("shard")).applyInArrow(_move, "shard int, blobs array<binary>"), "filters")
        for old in (self.counts, self.filters):
            if hasattr(old, "of"):
                forget(old.of)
        self.counts, self.filters = made.where("n > 0").select("shard", "key", "n"), new.select("shard", "blobs")
        self.counts.of, self.filters.of = made, new

    def add(self, docs: DataFrame) -> None:
        """Count the lines of ``docs`` (text)."""
        self._counted(docs, 1)

    def remove(self, docs: DataFrame) -> None:
        """Take away the lines of ``docs`` (text), which were added before."""
        self._counted(docs, -1)

    def _counted(self, docs: DataFrame, by: int) -> None:
        lines = self.lines(docs.select("text").withColumn("row", F.monotonically_increasing_id()), "row")
        self._change(lines, by)
        forget(lines)

    def repeated(self, lines: DataFrame) -> DataFrame:
        """row, keys (those that repeat) of each row of ``lines`` (row, shard, key) that has any."""
        size = lines.groupBy("shard").agg(F.count(F.lit(1)).alias("size")).agg(F.collect_list(F.struct("shard", "size")).alias("s"), F.avg("size").alias("mean")).first()
        most = min(PROBE_MOST, max(PROBE_LEAST, size["mean"] or 0))
        # one number for each shard: how many tasks share its lines
        parts = F.create_map(*(F.lit(x) for r in size["s"] or [] for x in (r["shard"], int(-(-r["size"] // most))))) if size["s"] else F.create_map(F.lit(0), F.lit(1))
        share = F.coalesce(F.element_at(parts, F.col("shard")), F.lit(1))
        dealt = lines.select("shard", F.pmod(F.xxhash64("row"), share).cast("int").alias("part"), "row", "key")
        held = self.filters.select("shard", F.explode(F.sequence(F.lit(0), share - 1)).alias("part"), "blobs")
        passed = dealt.groupBy("shard", "part").cogroup(held.groupBy("shard", "part")).applyInArrow(_probe, "row long, key binary")
        sure = self.counts.where(F.col("n") >= self.least).select("key")
        return passed.join(sure, "key").groupBy("row").agg(F.collect_list("key").alias("keys"))

    def apply(self, docs: DataFrame, number: str, lines: DataFrame | None = None) -> DataFrame:
        """``docs`` with the column ``keys``: the digests of its lines that repeat, null without any."""
        lines = self.lines(docs, number) if lines is None else lines
        gone = self.repeated(lines).select(F.col("row").alias(number), "keys")
        return docs.join(gone, number, "left")


def line_dedup(docs: DataFrame, least: int = LEAST_DOCUMENTS, least_chars: int = LEAST_CHARS, index: LineIndex | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each row of ``docs`` (doc_id, text), whose lines are added to ``index``, a new one by default."""
    index = index or LineIndex(docs.sparkSession, least, least_chars)
    every, number = numbered(docs.select(F.col("doc_id").cast("long"), "text"))
    lines = index.lines(every, number)
    index._change(lines, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, keys in slices(batches):
            n, dropped, digest = [], [], []
            for text, gone in zip(texts, keys):
                own = (text or "").encode().split(b"\n")
                left = _kept(own, set(gone or ()))
                n.append(len(own))
                dropped.append(len(own) - len(left))
                digest.append(hashlib.sha256(b"\n".join(left)).hexdigest())
            columns = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return light(index.apply(every, number, lines).select("doc_id", "text", "keys")).mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def drop_lines(docs: DataFrame, index: LineIndex) -> DataFrame:
    """``docs`` without the lines that repeat by ``index``; other columns stay as they are."""
    every, number = numbered(docs)
    gone = "keys"
    while gone in [c.lower() for c in every.columns]:
        gone += "_"
    found, kept = index.apply(every.select(number, "text"), number).select(number, F.col("keys").alias(gone)), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = batch.column("text").to_pylist(), batch.column(gone).to_pylist()
            out = [b"\n".join(_kept(t.encode().split(b"\n"), set(k))).decode() if k else t for t, k in zip(texts, keys)]
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(out, pa.string())).select(kept)

    return light(every.join(found, number, "left")).mapInArrow(run, docs.schema)


#: The same rows as DuckDB SQL, for the query's parameters.
ORACLE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
keyed AS (
  SELECT row, nth, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT row, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS nth FROM docs)),
repeated AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT row) >= 10),
told AS (SELECT *, key IN (SELECT key FROM repeated) AS gone FROM keyed)
SELECT d.doc_id, len(d.lines) AS n_lines, t.n_dropped, t.kept_sha256
FROM docs d JOIN (
  SELECT row, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (NOT gone), '')) AS kept_sha256
  FROM told GROUP BY row) t ON t.row = d.row
"""
