"""Benchmark decontamination over a stored positional inverted index.

Documents are laid end to end in blocks of about ``SLICE_CHARS`` characters (a longer
document is a block of its own). For each block and each term of the test set the
sorted word places are one posting, written to the shared folder: (block, term,
places). Which terms belong to the test set is told by a bit table of fixed size, so
no vocabulary is sent about; the few other terms that it lets through do no harm.

Test items are cut into passages of at most ``RUN`` windows; equal passages are
searched once, whatever the number of items that hold them. The postings give every
test term's frequency over all documents. The places of each window's rarest terms by
those frequencies are joined first; a passage is sent only to blocks in which three of
them (``ON_LINE``; all of a shorter window) stand as far apart as in it, and meets the
block's postings there. So what is sent about grows with the matches, not with the
passages times the blocks. A window is found by intersecting the posting lists of its terms, shifted by
their offsets, from the rarest on; what all terms agree on is an exact phrase.

A window of n >= 4 words that does not stand in a document as it is has a proximity
match there if at a place s at least ``ceil(0.8 n)`` of its words i stand within
``slop`` words of s + i. At most n - ceil(0.8 n) words may be missing, so one of the
next rarest ones is there: the anchors are n - ceil(0.8 n) + 1 terms of each window.

The documents are read once, whatever the size of the test set, nothing of either is
collected, and results depend neither on the blocks nor on the partitions. A
document's words are the test of what is hit; items are told by their ids as strings.

Null and empty texts have no words and never match; items without words match
nothing; repeated rows are judged each on its own, also under one doc_id or without
any; an item_id that stands several times counts once, a null one is the empty string.
Empty tables give no matches. Extra columns are ignored, or carried as they are by
``drop_contaminated``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacklore.llm.base import keep, light, numbered, passing, slices

#: UTF-8 bytes of words after lower-casing A-Z.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Bits of the table of test terms, and windows of a passage.
FILTER_BITS, RUN = 1 << 22, 64
#: Share of a window's words that a proximity match needs, and the shortest window that has any.
NEAR_SHARE, LEAST_NEAR = 0.8, 4
#: Terms of a window that must stand on one line with it before its passage goes to a block.
ON_LINE = 3
#: Lines of a stripe.
STRIPE = 32
PAD, ABSENT, FAR = -1, -2, 1 << 60
#: Places looked at in one numpy step inside a task, about.
STEP = 250_000


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode().lower()) if text else []


def _needed(length: np.ndarray) -> np.ndarray:
    return np.ceil(length * NEAR_SHARE - 1e-9).astype(np.int64)


def _passages(window: int):
    """(passage, item, terms) of each run of windows of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for items, texts in slices(batches):
            rows = []
            for item, text in zip(items, texts):
                terms = words_of(text)
                for at in range(0, max(1, len(terms) - window + 1) if terms else 0, RUN):
                    part = terms[at : at + RUN + window - 1]
                    rows.append((xxhash.xxh3_128_digest(b" ".join(part)), item, part))
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.string(), pa.list_(pa.binary())))], ["passage", "item", "terms"])

    return run


def _term_bits(passages: DataFrame) -> np.ndarray:
    """The bit table of the terms of ``passages``, of FILTER_BITS bits."""
    bit = passages.select(F.explode("terms").alias("term")).select((F.pmod(F.xxhash64("term"), F.lit(FILTER_BITS)) + 1).alias("bit"))
    made = bit.groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    table = np.zeros((FILTER_BITS // 32768, 4096), np.uint8)
    for row in made.collect():
        table[row["part"] - 1] = np.frombuffer(row["bits"], np.uint8)
    return table.ravel()


INDEX = "block long, term binary, places array<int>, ids array<long>"


def _index(bits):
    """The postings of each block; one row with a null term holds its documents and where each begins."""

    def known(word: bytes) -> bool:
        h = xxhash.xxh64_intdigest(word, 42) % FILTER_BITS
        return bool(bits.value[h >> 3] >> (h & 7) & 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for ids, texts in slices(batches):
            parts = [words_of(t) for t in texts]
            begin = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
            vocab = sorted(filter(known, set().union(*parts)))
            get = {w: i for i, w in enumerate(vocab)}.get
            term = np.fromiter((t for p in parts for t in map(get, p, repeat(-1))), np.int64, int(begin[-1]))
            place = np.flatnonzero(term >= 0)
            place = place[np.argsort(term[place], kind="stable")]
            ends = np.concatenate(([0], np.cumsum(np.bincount(term[place], minlength=len(vocab)))))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(vocab) + 1, block)),
                    pa.array([None, *vocab], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends + len(begin))), pa.int32()), pa.array(np.concatenate((begin, place)), pa.int32())),
                    pa.array([ids, *repeat(None, len(vocab))], pa.list_(pa.int64())),
                ],
                ["block", "term", "places", "ids"],
            )
            block += 1

    return run


class Windows:
    """The windows of passages: term numbers (PAD behind short ones), frequencies, and the passage of each."""

    def __init__(self, terms: list[np.ndarray], often: list[np.ndarray], window: int):
        sizes = np.array([len(t) for t in terms], np.int64)
        made = np.maximum(sizes - window + 1, 1)
        self.passage = np.repeat(np.arange(len(terms)), made)
        at = np.arange(len(self.passage)) - np.repeat(np.cumsum(made) - made, made) + np.repeat(np.cumsum(sizes) - sizes, made)
        self.length = np.minimum(sizes, window)[self.passage]
        inside = np.arange(window) < self.length[:, None]
        cell = np.where(inside, at[:, None] + np.arange(window), 0)
        flat = lambda x: np.concatenate([*x, [0]])
        self.terms = np.where(inside, flat(terms)[cell], PAD)
        # offsets from the rarest term of all documents on
        self.order = np.argsort(np.where(inside, flat(often)[cell], FAR), axis=1, kind="stable")
        self.need = _needed(self.length)
        self.anchors = np.where(self.length >= LEAST_NEAR, self.length - self.need + 1, 1)


def _anchors(window: int, slop: int | None):
    """(number, term, pos, must): the rarest terms of the windows of each passage with their places in it, and how many
    of them must stand on one line with it in a document that holds one of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, terms, often = (c.to_pylist() for c in batch.columns)
            out = []
            for number, part, n in zip(numbers, terms, often):
                w = Windows([np.arange(len(part))], [np.array(n, np.int64)], window)
                length = int(w.length[0])
                lost = length - int(w.need[0]) if slop is not None and length >= LEAST_NEAR else 0
                must = min(length - lost, ON_LINE)
                used = {int(w.terms[i, k]) for i, order in enumerate(w.order) for k in order[: must + lost]}
                out += [(number, part[t], t, must) for t in used if n[t]]
            columns = list(zip(*out)) or [()] * 4
            kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["number", "term", "pos", "must"])

    return run


def _routes(counted: DataFrame, postings: DataFrame, window: int, slop: int | None) -> DataFrame:
    """(to, number): the blocks that may hold a window of each passage (number, terms, often).

    A place of a term less the term's place in the passage is the line that the passage would lie on. Terms of one match lie on lines
    that are at most twice the slop apart, so they meet in a stripe of ``STRIPE`` lines, if lines near the next one count for both.
    The terms of a stripe are told apart by their places modulo 64; those of one window never fall together.
    """
    anchors = counted.select("number", "terms", "often").mapInArrow(_anchors(window, slop), "number long, term binary, pos int, must int")
    met = anchors.join(postings.select("term", F.col("block").alias("to"), "places"), "term")
    line = met.select("number", "must", "to", "pos", F.expr("shiftleft(1L, pos % 64)").alias("bit"), F.explode("places").alias("place"))
    line = line.withColumn("line", F.col("place").cast("long") - F.col("pos"))
    width = STRIPE if slop else 1
    at = F.floor(F.col("line") / width)
    near = F.pmod("line", F.lit(width)) < 2 * (slop or 0)
    stripe = F.explode(F.when(near, F.array(at, at - 1)).otherwise(F.array(at))) if slop else at
    found = line.select("number", "must", "to", "bit", stripe.alias("stripe")).groupBy("number", "to", "stripe").agg(F.min("must").alias("must"), F.bit_or("bit").alias("bits"))
    return found.where(F.bit_count("bits") >= F.col("must")).select("to", "number").distinct()


def _spread(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges [start, start + size): the range of each number in them, and the numbers."""
    owner = np.repeat(np.arange(len(size)), size)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + start[owner]


class Postings:
    """The postings of a block: the places of each term, and the documents that they lie in."""

    def __init__(self, table: pa.Table):
        terms, places = table.column("term").to_pylist(), table.column("places").combine_chunks()
        ends = places.offsets.to_numpy()
        own = terms.index(None)
        flat = places.values.to_numpy().astype(np.int64)
        self.ids = table.column("ids")[own].as_py()
        self.begin = flat[ends[own] : ends[own + 1]]
        self.count = np.diff(ends).astype(np.int64)
        self.count[own] = 0
        self.number = {t: i for i, t in enumerate(terms) if t is not None}
        # (term, place) as one number, ascending
        self.wide = int(self.begin[-1]) + 1
        rows = np.flatnonzero(self.count)
        order, self.at = np.sort(rows), np.cumsum(self.count) - self.count
        own, at = _spread(ends[:-1].astype(np.int64)[order], self.count[order])
        self.place = flat[at]
        self.keys = order[own] * self.wide + self.place

    def within(self, term: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether each term stands at a place in [lo, hi)."""
        if not len(self.place):
            return np.zeros(len(term), bool)
        at = np.searchsorted(self.keys, term * self.wide + lo)
        found = self.keys[np.minimum(at, len(self.keys) - 1)]
        return (term >= 0) & (at < len(self.keys)) & (lo < hi) & (found < term * self.wide + hi)

    def occurrences(self, tests: Windows, win: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """Of the k-th rarest terms of windows: window, document, and where the window would begin."""
        off = tests.order[win, k]
        term = tests.terms[win, off]
        win, off, term = win[term >= 0], off[term >= 0], term[term >= 0]
        own, at = _spread(self.at[term], self.count[term])
        place = self.place[at]
        return win[own], np.searchsorted(self.begin, place, side="right") - 1, place - off[own]

    def exact(self, tests: Windows, able: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Exact matches of the windows ``able``: document, first place, window."""
        win, doc, first = self.occurrences(tests, able, 0)
        alive = np.flatnonzero((first >= self.begin[doc]) & (first + tests.length[win] <= self.begin[doc + 1]))
        for k in range(1, tests.terms.shape[1]):
            off = tests.order[win[alive], k]
            term, place = tests.terms[win[alive], off], first[alive] + off
            alive = alive[(term == PAD) | self.within(term, place, place + 1)]
        return doc[alive], first[alive], win[alive]

    def near(self, tests: Windows, able: np.ndarray, k: int, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """Matches within ``slop`` from the k-th rarest terms of the windows ``able``: document, window."""
        win, doc, first = self.occurrences(tests, able, k)
        # of the anchors and one term more at least two are there, the other within twice the slop
        other = tests.need[win] < 2
        for j in range(tests.terms.shape[1]):
            todo = np.flatnonzero(~other & (tests.anchors[win] >= j)) if j != k else []
            if len(todo):
                off, d = tests.order[win[todo], j], doc[todo]
                at = first[todo] + off
                other[todo] = self.within(tests.terms[win[todo], off], np.maximum(at - 2 * slop, self.begin[d]), np.minimum(at + 2 * slop + 1, self.begin[d + 1]))
        spots = np.stack((doc, win, first), axis=1)[other]
        doc, win, start = np.unique(np.concatenate([spots + [0, 0, d] for d in range(-slop, slop + 1)]), axis=0).T
        n, lo, hi = np.zeros(len(doc), np.int64), self.begin[doc], self.begin[doc + 1]
        for off in range(tests.terms.shape[1]):
            n += self.within(tests.terms[win, off], np.maximum(start + off - slop, lo), np.minimum(start + off + slop + 1, hi))
        good = n >= tests.need[win]
        return doc[good], win[good]

    def runs(self, tests: Windows, able: np.ndarray, k: int) -> list[np.ndarray]:
        """The windows ``able`` in runs whose k-th rarest terms stand at about ``STEP`` places."""
        if not len(able):
            return []
        term = tests.terms[able, tests.order[able, k]]
        size = np.cumsum(np.where(term >= 0, self.count[term], 0))
        return np.split(able, np.flatnonzero(np.diff(size // STEP)) + 1)

    def search(self, tests: Windows, slop: int | None) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
        """Exact matches (document, first place, window), and proximity matches (document, window)."""
        none = (np.zeros(0, np.int64),) * 3
        whole = np.flatnonzero((tests.terms != ABSENT).all(axis=1))
        exact = tuple(map(np.concatenate, zip(none, *(self.exact(tests, w) for w in self.runs(tests, whole, 0)))))
        found = [none[:2]]
        for k in range(int(tests.anchors.max(initial=0)) if slop is not None else 0):
            able = np.flatnonzero((tests.length >= LEAST_NEAR) & (tests.anchors > k))
            found += [self.near(tests, w, k, slop) for w in self.runs(tests, able, k)]
        pair = lambda d, w: d * (len(tests.length) + 1) + w
        got = np.setdiff1d(pair(*map(np.concatenate, zip(*found))), pair(exact[0], exact[2]))
        return exact, np.divmod(got, len(tests.length) + 1)


FOUND = "block long, nth int, doc_id long, n_words long, hits array<long>, exact array<binary>, near array<binary>"


def _meet(window: int, slop: int | None):
    def run(postings: pa.Table, routed: pa.Table) -> pa.Table:
        index = Postings(postings)
        keys, n = routed.column("passage").to_pylist(), len(index.ids)
        get = index.number.get
        terms = [np.fromiter((get(t, ABSENT) for t in p), np.int64, len(p)) for p in routed.column("terms").to_pylist()]
        tests = Windows(terms, [np.array(x, np.int64) for x in routed.column("often").to_pylist()], window)
        (doc, first, win), near = index.search(tests, slop)
        own, place = _spread(first - index.begin[doc], tests.length[win])

        def by_document(doc: np.ndarray, value: np.ndarray) -> list[np.ndarray]:
            pairs = np.unique(np.stack((doc, value), axis=1), axis=0) if len(doc) else np.zeros((0, 2), np.int64)
            return np.split(pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(1, n)))

        passages = lambda doc, win: [[keys[i] for i in x] for x in by_document(doc, tests.passage[win])]
        columns = (
            [postings.column("block")[0].as_py()] * n, range(n), index.ids, np.diff(index.begin), by_document(doc[own], place), passages(doc, win), passages(*near),
        )
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.binary()))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["block", "nth", "doc_id", "n_words", "hits", "exact", "near"])

    return run


def _find(docs: DataFrame, items: DataFrame, window: int, slop: int | None) -> tuple[DataFrame, DataFrame]:
    """What each row of ``docs`` (doc_id, text) holds of the passages, and (passage, item) of ``items`` (item_id, text)."""
    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    every = keep(named.mapInArrow(_passages(window), "passage binary, item string, terms array<binary>"), "passages")
    bits = docs.sparkSession.sparkContext.broadcast(_term_bits(every))
    index = keep(light(docs).mapInArrow(_index(bits), INDEX), "postings")
    postings = index.where("term IS NOT NULL")
    often = postings.groupBy("term").agg(F.sum(F.size("places")).alias("often"))
    passages = every.groupBy("passage").agg(F.first("terms").alias("terms"))
    counted = passages.select("passage", F.posexplode("terms").alias("at", "term")).join(often, "term", "left")
    counted = counted.groupBy("passage").agg(F.array_sort(F.collect_list(F.struct("at", "term", F.coalesce("often", F.lit(0)).alias("often")))).alias("r"))
    counted = keep(counted.select(F.monotonically_increasing_id().alias("number"), "passage", F.col("r.term").alias("terms"), F.col("r.often").alias("often")), "frequencies")
    routed = _routes(counted, postings, window, slop).join(counted, "number").drop("number")
    met = index.groupBy("block").cogroup(routed.groupBy("to")).applyInArrow(_meet(window, slop), FOUND)
    return met, every.select("passage", "item").distinct()


def find_items(docs: DataFrame, items: DataFrame, window: int = 13, slop: int = 3) -> DataFrame:
    """doc_id, n_words, hits (word places), items and near_items (item ids as strings, sorted) of each row of ``docs``.

    ``docs`` has doc_id and text, ``items`` item_id and text.
    """
    found, held = _find(docs.select(F.col("doc_id").cast("long"), "text"), items, window, slop)
    found = keep(found, "found")
    marked = lambda how: F.transform(how, lambda p: F.struct(p.alias("passage"), F.lit(how).alias("how")))
    each = F.explode(F.concat(marked("exact"), marked("near"))).alias("r")
    told = found.select("block", "nth", each).select("block", "nth", "r.*").join(held, "passage")
    named = [F.array_sort(F.collect_set(F.when(F.col("how") == how, F.col("item")))).alias(name) for how, name in (("exact", "items"), ("near", "near_items"))]
    told = told.groupBy("block", "nth").agg(*named)
    none = F.array().cast("array<string>")
    return found.join(told, ["block", "nth"], "left").select("doc_id", "n_words", "hits", *(F.coalesce(c, none).alias(c) for c in ("items", "near_items")))


def _contaminated(share: int):
    return (F.size("hits") > 0) & (F.size("hits").cast("long") * share >= F.col("n_words"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 13, slop: int = 3, share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items of each row of ``docs``.

    A document is contaminated if at least one in ``share`` of its words is hit.
    """
    return find_items(docs, items, window, slop).select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        _contaminated(share).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """``docs`` without contaminated rows, each judged on its own; all columns stay as they are."""
    every, number = numbered(docs)
    with passing() as kept:
        found, _ = _find(every.select(F.col(number).alias("doc_id"), "text"), items, window, None)
        keep(found.where(_contaminated(share)).select(F.col("doc_id").alias(number)), "contaminated")
        bad = kept.pop()
    return every.join(bad, number, "left_anti").select(docs.columns)
