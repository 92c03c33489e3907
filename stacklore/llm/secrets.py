"""Secret scans over an incremental ledger of blobs.

A blob is a text named by the SHA-256 of its bytes; every (path, version) row
points to one. The ledger holds, for each (blob, rule version) that was scanned,
the spans that were found (none included). A run scans only blobs whose pair is
not in the ledger, each once however many rows point to it, appends what it found,
and joins the findings back to all rows. Appended parts are separate folders, so a
run that breaks off leaves the ledger as it was.

Null texts are the empty blob. Repeated rows and equal texts share one scan and
get equal findings, each under its own path. Spans that begin at one place are ordered
by kind. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacklore.llm.base import light, shared_dir, slices

RULES_VERSION = "1"
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
NAMES = ("passw", "secret", "token", "api_key", "apikey")


def secret_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, ordered by start and then kind."""
    found = []
    low = text.lower()
    if any(n in low for n in NAMES):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for blobs, texts in slices(batches):
        found = [secret_spans(t or "") for t in texts]
        columns = [pa.array(blobs, pa.string())]
        columns += [pa.array([sum(s[0] == k for s in x) for x in found], pa.int64()) for k in KINDS]
        columns.append(pa.array([",".join(f"{k}:{a}:{b}" for k, a, b in x) for x in found], pa.string()))
        yield pa.RecordBatch.from_arrays(columns, ["blob", "n_assign", "n_access", "n_hex", "spans"])


FOUND = "blob string, n_assign long, n_access long, n_hex long, spans string"


class BlobLedger:
    """Findings by blob and rule version, as Parquet parts under one shared folder."""

    def __init__(self, spark, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
        self.parts: list[str] = []

    def _folder(self, version: str) -> str:
        return f"{self.path}/rules={version}"

    def read(self, version: str = RULES_VERSION) -> DataFrame:
        """What is known for a rule version; empty if nothing was scanned with it."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder(version))
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        done = [str(s.getPath()) for s in fs.listStatus(folder) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{s.getPath()}/_SUCCESS"))] if fs.exists(folder) else []
        if not done:
            return self.spark.createDataFrame([], FOUND)
        # two runs at once may both have scanned a blob
        return self.spark.read.schema(FOUND).parquet(*done).dropDuplicates(["blob"])

    def scan(self, versions: DataFrame, rules: str = RULES_VERSION) -> DataFrame:
        """All rows of ``versions`` (path, text) with the findings of their blobs;
        blobs that the ledger lacks for these rules are scanned and added first."""
        named = light(versions).select("path", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
        known = self.read(rules)
        unseen = named.select("blob", "text")
        if known.limit(1).count():
            unseen = unseen.join(known.select("blob"), "blob", "left_anti")
        unseen.dropDuplicates(["blob"]).mapInArrow(_scan, FOUND).write.parquet(f"{self._folder(rules)}/part-{uuid.uuid4().hex}")
        return named.select("path", "blob").join(self.read(rules), "blob")


def scan_documents(docs: DataFrame, ledger: BlobLedger | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, blob of every row of
    ``docs`` (doc_id, text); the document is the path."""
    ledger = ledger or BlobLedger(docs.sparkSession)
    return ledger.scan(docs.select(F.col("doc_id").cast("long").alias("path"), "text")).select(
        F.col("path").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2("spans", 256).alias("base_sha256"), "spans", "blob"
    )
