"""Titles that a query means, by containment, words, and the best window of letters."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stacklore.functions.text import normalize_text

#: Queries that a task holds titles against at a time, and rows of titles in one numpy step.
BLOCK, STEP = 20_000, 512
WHOLE, WORDS = 100, 97
#: Words that say what a title is of.
MARKS = r"\b(?:highlight|insight|comment|yorum|notes?|pdf|epub)\b"
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "
WORD = re.compile(r"[a-z0-9]+")


def variants(title: Column) -> Column:
    """Forms of a title in plain letters: whole, without what follows a dash, and both without brackets; three letters at least."""
    raw = F.trim(F.coalesce(title, F.lit("")))
    bare = F.trim(F.regexp_replace(raw, r"\s*[\(\[\{][^)\]}]{1,64}[\)\]\}]\s*", " "))
    head = lambda c: F.trim(F.split_part(c, F.lit(" - "), F.lit(1)))
    plain = lambda c: normalize_text(F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), MARKS, " "), r"\s+", " ")))
    return F.array_distinct(F.filter(F.transform(F.array(raw, head(raw), bare, head(bare)), plain), lambda v: F.length(v) >= 3))


def _common(bits: dict[str, int], size: int, text: str) -> int:
    """Length of the longest common subsequence of a word, given as letter masks, and ``text``."""
    full = (1 << size) - 1
    s = full
    for c in text:
        u = s & bits.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return size - s.bit_count()


def partial_ratio(a: str, b: str) -> float:
    """The largest of 200 * common letters in order / all letters, of the shorter text and a window of the longer one as long at most
    (shorter windows at both ends)."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    m, n = len(a), len(b)
    if not m:
        return 100.0 if not n else 0.0
    bits: dict[str, int] = {}
    for i, c in enumerate(a):
        bits[c] = bits.get(c, 0) | 1 << i
    best = 0.0
    for start in range(1 - m, n):
        window = b[max(start, 0) : start + m]
        if window and (window[-1] in bits or window[0] in bits) and 200 * min(m, len(window)) / (m + len(window)) > best:
            best = max(best, 200 * _common(bits, m, window) / (m + len(window)))
    return best


def score(forms: list[str], query: str, query_words: set[str], least: int, able: list[bool]) -> int:
    """The best score of a title's forms, 0 below ``least``; ``able`` says which of them share letters enough with the query."""
    best = 0
    for form, may in zip(forms, able):
        words = [w for w in WORD.findall(form) if len(w) >= 3]
        if form in query:
            best = WHOLE
        elif len(words) >= 2 and query_words.issuperset(words):
            best = max(best, WORDS)
        elif may and best < WHOLE and (found := int(partial_ratio(form, query))) >= least:
            best = max(best, found)
    return best


def _counts(texts: list[str]) -> np.ndarray:
    """How often each letter stands in each text; what is none of ``LETTERS`` counts as one more."""
    out = np.zeros((len(texts), len(LETTERS) + 1), np.int16)
    place = {c: i for i, c in enumerate(LETTERS)}
    for i, t in enumerate(texts):
        for c in t:
            out[i, place.get(c, len(LETTERS))] += 1
    return out


def _match(asked, least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries = asked.value
        counts, sizes = _counts([q for _, q in queries]), np.array([len(q) for _, q in queries])
        words = [set(WORD.findall(q)) for _, q in queries]
        for pdf in batches:
            rows = [(item, f) for item, forms in zip(pdf["item_id"], pdf["forms"]) for f in forms]
            out: dict[tuple, int] = {}
            for at in range(0, len(rows), STEP):
                part = rows[at : at + STEP]
                own, n = _counts([f for _, f in part]), np.array([len(f) for _, f in part])
                told = np.array([sum(len(w) for w in WORD.findall(f) if len(w) >= 3) for _, f in part])
                for k, (query, text) in enumerate(queries):
                    # letters in common bound what a window can share; a window of length w shares w at most
                    shared = np.minimum(own, counts[k]).sum(axis=1)
                    short = np.minimum(n, sizes[k])
                    able = 200 * shared >= least * (short + np.minimum(shared, short))
                    for i in np.flatnonzero(able | (shared >= told)):
                        item, form = part[i]
                        if (found := score([form], text, words[k], least, [bool(able[i])])) >= least:
                            out[query, item] = max(found, out.get((query, item), 0))
            yield pd.DataFrame([(q, i, s) for (q, i), s in out.items()], columns=["query_id", "item_id", "score"]).astype({"score": "int64"})

    return run


def fuzzy_titles(titles: DataFrame, queries: DataFrame, least: int = 70) -> DataFrame:
    """query_id, item_id, score of the titles (item_id, title) that a query (query_id, text) means: 100 where the query holds a form of
    the title, 97 where it holds all its words (two or more), else by the best window, ``least`` at least.

    Titles stream past blocks of queries; counts of letters rule out nearly all pairs and none that reaches ``least``.
    """
    asked = queries.select("query_id", normalize_text(F.col("text")).alias("text")).where("text <> ''")
    forms = titles.select("item_id", variants(F.col("title")).alias("forms"))
    n, found = -(-asked.count() // BLOCK), None
    for k in range(n):
        part = asked if n == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == k)
        block = titles.sparkSession.sparkContext.broadcast([(r["query_id"], r["text"]) for r in part.collect()])
        own = forms.mapInPandas(_match(block, least), "query_id long, item_id long, score long")
        found = own if found is None else found.unionByName(own)
    if found is None:
        return titles.sparkSession.createDataFrame([], "query_id long, item_id long, score long")
    return found.groupBy("query_id", "item_id").agg(F.max("score").alias("score"))
