"""Document blocks to paragraphs and chunks, section by section.

``blocks`` have doc, page, nth (the order on the page), kind, text and confidence, and may have heading_path. A heading
closes what stands before it, so a section, from one heading to the next, is the unit of work: its rows are brought together
by (doc, section), sorted and streamed, so a long document is spread over tasks and no task holds a section in memory.
The number of a section comes from one row for each page, its heading path from the headings alone.

Null and blank texts are left out; a null confidence is 1. Blocks at one place are ordered by their text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stacklore.operators.documents import chunk_quality, line_signature
from stacklore.sources.shared import kept

#: Kinds that never merge, flags whose blocks are no body, and words that go on with a sentence.
APART = ("heading", "table", "quote", "footnote", "toc", "bibliography", "front_matter", "imprint", "catalog")
ALONE = ("table", "quote", "list_cluster", "figure_caption")
PRUNED = ("bibliography_like", "toc_like", "front_matter_like", "imprint_like", "catalog_like", "address_like")
GOES_ON = re.compile(r"^(?:[-,;:)\]\"']|(?:ve|veya|ama|ancak|fakat|ile|ki|de|da|gibi|icin|için)\b)", re.I)
CLOSED = re.compile(r"[.!?\"')\]]\s*$")
HYPHEN = re.compile(r"(\w)-\s+(\w)")
#: Rows at the top and foot of a page that may be margins, and pages on which one must stand.
MARGIN, MARGIN_PAGES, MARGIN_SHARE = 2, 3, 0.2
#: Words at which a chunk closes, and beyond which it takes no further block.
TARGET_WORDS, CAP_WORDS = 269, 346


def plain(text: Column) -> Column:
    """Hyphenated breaks joined, blanks collapsed."""
    joined = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\r", "\n"), r"([\p{L}\p{N}_])-\s+([\p{L}\p{N}_])", "$1$2")
    return F.trim(F.regexp_replace(joined, r"\s+", " "))


def body_blocks(blocks: DataFrame) -> DataFrame:
    """``blocks`` in plain text without repeated margins, page marks at the margins, and what is no body."""
    on_page = Window.partitionBy("doc", "page")
    given = blocks if "heading_path" in blocks.columns else blocks.withColumn("heading_path", F.lit(None).cast("array<string>"))
    df = given.where(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0).withColumn("sig", line_signature(F.col("text")))
    df = df.withColumn("at", F.row_number().over(on_page.orderBy("nth", "text"))).withColumn("n", F.count(F.lit(1)).over(on_page))
    df = df.withColumn("edge", (F.col("at") <= MARGIN) | (F.col("at") > F.col("n") - MARGIN))
    judged = kept(chunk_quality(df.withColumn("raw", F.col("text")).withColumns({"text": plain(F.col("text")), "page_number": F.col("page"), "title": F.lit(""), "author": F.lit("")})), "judged")
    total = judged.groupBy("doc").agg(F.count_distinct("page").alias("pages"))
    often = judged.where("edge AND sig <> ''").groupBy("doc", "sig").agg(F.count_distinct("page").alias("on_pages")).join(total, "doc")
    often = often.where(F.col("on_pages") >= F.greatest(F.lit(MARGIN_PAGES), F.ceil(F.col("pages") * MARGIN_SHARE))).select("doc", "sig", F.lit(True).alias("repeats"))
    marked = judged.join(often, ["doc", "sig"], "left")
    margin = F.col("edge") & (F.coalesce("repeats", F.lit(False)) | F.array_contains("flags", "page_artifact"))
    other = F.col("skip") & F.arrays_overlap("flags", F.array(*map(F.lit, PRUNED)))
    return marked.where(~margin & ~other & (F.length("text") > 0)).select("doc", "page", "nth", "kind", "text", F.coalesce("confidence", F.lit(1.0)).alias("confidence"), "heading_path")


def with_sections(body: DataFrame) -> DataFrame:
    """``body`` with ``section``, the number of headings up to a block, and the heading path that holds there."""
    body = kept(body.withColumn("head", (F.col("kind") == "heading").cast("long")), "body")
    pages = body.groupBy("doc", "page").agg(F.sum("head").alias("heads"))
    before = F.sum("heads").over(Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    pages = pages.select("doc", "page", F.coalesce(before, F.lit(0)).alias("before"))
    upto = F.sum("head").over(Window.partitionBy("doc", "page").orderBy("nth", "text").rowsBetween(Window.unboundedPreceding, 0))
    numbered = kept(body.join(pages, ["doc", "page"]).withColumn("section", F.col("before") + upto).drop("before", "head"), "numbered")
    # a heading with a path of its own begins anew; others add themselves, unless they say the same again
    order = Window.partitionBy("doc").orderBy("section")
    heads = numbered.where("kind = 'heading'").select("doc", "section", "text", F.when(F.size("heading_path") > 0, F.col("heading_path")).alias("own"))
    heads = heads.withColumn("turn", F.count("own").over(order)).withColumn("said", F.coalesce(F.element_at("own", -1), F.lag("text").over(order)))
    heads = heads.withColumn("adds", F.when(F.col("said").isNull() | (F.col("said") != F.col("text")), F.col("text")))
    so_far = Window.partitionBy("doc", "turn").orderBy("section")
    path = F.concat(F.coalesce(F.first("own").over(so_far), F.array().cast("array<string>")), F.collect_list("adds").over(so_far))
    paths = heads.select("doc", "section", path.alias("path"))
    placed = numbered.join(paths, ["doc", "section"], "left").withColumn("path", F.coalesce("path", F.array().cast("array<string>")))
    own = (F.col("kind") != "heading") & (F.size("heading_path") > 0)
    return placed.select("doc", "section", "page", "nth", "kind", "text", "confidence", F.when(own, F.col("heading_path")).otherwise(F.col("path")).alias("path"))


def streamed(df: DataFrame, keys: list[str], order: list[str], step: Callable, schema: str) -> DataFrame:
    """``step(rows)`` over the rows of each key in order, as an iterator of named tuples; it yields tuples of ``schema``.

    Rows are dealt out by a hash of the keys, not the keys: Spark leaves a shuffle by the keys of a join before it out, and may
    then read that join's rows by mapper or in parts, as it does not know that a key's rows must stay together.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in schema.split(", ")]
        rows = (r for pdf in batches for r in pdf.itertuples(index=False))
        out: list[tuple] = []
        for row in _grouped(rows, keys, step):
            out.append(row)
            if len(out) >= 2000:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)

    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _grouped(rows: Iterator, keys: list[str], step: Callable) -> Iterator[tuple]:
    from itertools import groupby

    for _, own in groupby(rows, key=lambda r: tuple(getattr(r, k) for k in keys)):
        yield from step(own)


def merges(left: str, page: int, kind: str, right) -> str | None:
    """Why a block goes on with the paragraph that began on ``page`` and ends with ``left``, None if it does not."""
    if kind in APART or right.kind in APART or not 0 <= right.page - page <= 1:
        return None
    if left.endswith("-"):
        return "hyphen"
    if CLOSED.search(left):
        return None
    if right.page == page:
        return "same_page"
    return "next_page" if right.text[:1].islower() or GOES_ON.search(right.text) else None


PARAGRAPH = "doc long, section long, para long, kind string, text string, page long, page_end long, confidence double, origin string, n_blocks long, path array<string>"


def _paragraphs(rows: Iterator) -> Iterator[tuple]:
    first = why = None
    parts: list[str] = []
    para = n = 0
    least, last = 1.0, 0

    def made() -> tuple:
        text = re.sub(r"\s+", " ", HYPHEN.sub(r"\1\2", "".join(parts))).strip()
        return (first.doc, first.section, para, first.kind, text, first.page, last, least, why, n, list(first.path))

    for r in rows:
        reason = merges(parts[-1], first.page, first.kind, r) if first is not None else None
        if reason:
            if parts[-1].endswith("-"):
                parts[-1] = parts[-1].rstrip("-")
                parts.append(r.text.lstrip("-"))
            else:
                parts += [" ", r.text.lstrip("-")]
            why, n, least, last = reason, n + 1, min(least, r.confidence), r.page
            continue
        if first is not None:
            yield made()
            para += 1
        first, parts, why, n, least, last = r, [r.text], None, 1, r.confidence, r.page
    if first is not None:
        yield made()


def paragraphs(blocks: DataFrame) -> DataFrame:
    """Headings and paragraphs of ``blocks`` in order of (doc, section, para): kind, text, pages, least confidence, the last
    reason for a merge, number of blocks and heading path."""
    return streamed(with_sections(body_blocks(blocks)), ["doc", "section"], ["page", "nth", "text"], _paragraphs, PARAGRAPH)


CHUNK = "doc long, section long, chunk long, text string, page long, page_end long, prefix string, words long, kinds array<string>"


def _packer(target: int, cap: int):
    def run(rows: Iterator) -> Iterator[tuple]:
        held: list = []
        words = chunk = 0

        def made() -> tuple:
            f = held[0]
            return (f.doc, f.section, chunk, "\n\n".join(r.text for r in held), f.page, held[-1].page, " > ".join(f.path), words, [r.kind for r in held])

        for r in rows:
            n = len(r.text.split())
            alone = r.kind in ALONE or r.kind == "heading"
            if held and (alone or list(held[-1].path) != list(r.path) or words + n > cap):
                yield made()
                held, words, chunk = [], 0, chunk + 1
            if r.kind == "heading":
                continue
            held.append(r)
            words += n
            if alone or words >= target:
                yield made()
                held, words, chunk = [], 0, chunk + 1
        if held:
            yield made()

    return run


def section_chunks(paras: DataFrame, target: int = TARGET_WORDS, cap: int = CAP_WORDS) -> DataFrame:
    """Paragraphs packed in order: a chunk closes at ``target`` words and before one that would lead it past ``cap``, where the
    heading path changes, and on both sides of tables and quotes. It is led by its heading path as ``prefix``. A paragraph is never cut."""
    return streamed(paras, ["doc", "section"], ["para"], _packer(target, cap), CHUNK)


SENTENCE = re.compile(r"(?<=[.!?…])\s+")


def _sentence_packer(target: int, cap: int, overlap: int):
    def run(rows: Iterator) -> Iterator[tuple]:
        units = ((r, list(r.path), s.split()[at : at + cap - overlap]) for r in rows if r.kind != "heading" for s in SENTENCE.split(r.text) for at in range(0, len(s.split()), cap - overlap))
        first = path = None
        words: list[tuple[str, int]] = []
        kinds: list[str] = []
        fresh = chunk = 0

        def made() -> tuple:
            return (first.doc, first.section, chunk, " ".join(w for w, _ in words), words[0][1], words[-1][1], " > ".join(path), len(words), kinds)

        for r, own, unit in units:
            if fresh and (own != path or len(words) + len(unit) > cap):
                yield made()
                chunk += 1
                words, kinds, fresh = (words[-overlap:] if overlap and own == path else []), [], 0
            elif own != path:
                words = []
            first, path = r, own
            words = [*words, *((w, r.page) for w in unit)]
            kinds = kinds if r.kind in kinds else [*kinds, r.kind]
            fresh += len(unit)
            if len(words) >= target:
                yield made()
                chunk += 1
                words, kinds, fresh = words[-overlap:] if overlap else [], [], 0
        if fresh:
            yield made()

    return run


def sentence_chunks(paras: DataFrame, target: int = 350, cap: int = 450, overlap: int = 20) -> DataFrame:
    """Sentences packed to ``target`` words and ``cap`` at most within one heading path; each chunk is led by the last ``overlap``
    words of the one before, and its pages are those of its words. A sentence beyond ``cap`` is cut."""
    return streamed(paras, ["doc", "section"], ["para"], _sentence_packer(target, cap, overlap), CHUNK)
