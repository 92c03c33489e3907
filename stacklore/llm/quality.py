"""Quality rules by divergence from language references.

For each language the corpus gives two references: shares of character classes,
and shares of its ``COMMON`` most frequent words with one bin for all others. They
are sums over all texts, counted in each task and summed by key. A text is held
against its language's references (without a known language: the nearest of all)
by Jensen-Shannon distance. It is dropped if its character classes or its common
words lie farther than a limit; the limit is wider for short texts, whose shares
scatter, and below a minimum length no verdict is taken from a histogram.

Base rules come first: too few words, or more than half of the words in repeated
three-word windows, fail whatever the distances are.

Null texts have no words and fail. Repeated rows are judged each on its own. Words as
frequent as the last common one are taken by code point. An empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stacklore.llm.base import keep, light, slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
COMMON = 40
#: Words that one task counts before it hands its counts on.
HELD = 150_000
#: Character classes, by code point below 128; 0 is any other ASCII character.
CLASSES = ("other", "blank", "symbol", "lower", "upper", "digit", "stop", "pause", "mark", "beyond")
LEAST_WORDS, LEAST_CHARS = 50, 300
#: Limits of the distances for long texts, and what 1 / length adds for short ones.
CHAR_LIMIT, CHAR_SLACK, WORD_LIMIT, WORD_SLACK = 0.24, 60, 0.33, 6


def _class_table() -> np.ndarray:
    t = np.zeros(129, np.int64)
    for name, chars in (
        ("blank", BLANK), ("symbol", SYMBOLS), ("lower", "abcdefghijklmnopqrstuvwxyz"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        ("digit", "0123456789"), ("stop", "."), ("pause", ",;:"), ("mark", "!?"),
    ):
        t[[ord(c) for c in chars]] = CLASSES.index(name)
    t[128] = CLASSES.index("beyond")
    return t


TABLE = _class_table()


def class_counts(texts: list[str]) -> np.ndarray:
    """Characters of each class in each text."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    own = np.repeat(np.arange(len(texts)) * len(CLASSES), lens)
    return np.bincount(own + TABLE[np.minimum(codes, 128)], minlength=len(texts) * len(CLASSES)).reshape(-1, len(CLASSES))


def repeated_words(words: list[str]) -> int:
    """Words inside three-word windows that stand twice or more."""
    runs = list(zip(words, words[1:], words[2:]))
    if len(set(runs)) == len(runs):
        return 0
    often = {r for r, n in Counter(runs).items() if n > 1}
    hit = bytearray(len(words))
    for i, r in enumerate(runs):
        if r in often:
            hit[i : i + 3] = b"\1\1\1"
    return sum(hit)


def repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    return len(lines) - len(set(lines))


def js_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Square root of the Jensen-Shannon divergence in bits, by row."""
    p, q = (x / np.maximum(x.sum(axis=1, keepdims=True), 1e-300) for x in (a.astype(float), b.astype(float)))
    m = (p + q) / 2
    part = lambda x: np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0).sum(axis=1)
    return np.sqrt(np.clip((part(p) + part(q)) / 2, 0, 1))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (lang, word or class number, n); classes have a null word."""
    words: dict[str, Counter] = {}
    classes: dict[str, np.ndarray] = {}

    def flush() -> pa.RecordBatch:
        rows = [(lang, w, -1, n) for lang, c in words.items() for w, n in c.items()]
        rows += [(lang, None, i, int(n)) for lang, c in classes.items() for i, n in enumerate(c)]
        words.clear()
        classes.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int32(), pa.int64()))], ["lang", "word", "class", "n"])

    for langs, texts in slices(batches):
        texts = [t or "" for t in texts]
        for lang, row in zip(langs, class_counts(texts)):
            classes[lang] = classes.get(lang, 0) + row
        for lang, t in zip(langs, texts):
            words.setdefault(lang, Counter()).update(WORD.findall(t.lower()))
        if sum(map(len, words.values())) > HELD:
            yield flush()
    if classes:
        yield flush()


class References:
    def __init__(self, rows: list):
        self.langs = sorted({r["lang"] for r in rows})
        self.chars, self.words, self.bins = {}, {}, {}
        for lang in self.langs:
            own = [r for r in rows if r["lang"] == lang]
            self.chars[lang] = np.array([sum(r["n"] for r in own if r["word"] is None and r["class"] == i) for i in range(len(CLASSES))], float)
            common = sorted((r["word"], r["n"], r["total"]) for r in own if r["word"] is not None)
            self.bins[lang] = {w: i for i, (w, *_) in enumerate(common)}
            n = [x for _, x, _ in common]
            self.words[lang] = np.array([*n, max(common[0][2] - sum(n), 0)] if common else [1.0], float)

    def distances(self, lang: str, chars: np.ndarray, words: list[str]) -> tuple[float, float]:
        bins = self.bins[lang]
        hist = np.bincount([bins.get(w, len(bins)) for w in words], minlength=len(bins) + 1)
        return float(js_distance(chars[None], self.chars[lang][None])[0]), float(js_distance(hist[None], self.words[lang][None])[0])

    def nearest(self, lang: str | None, chars: np.ndarray, words: list[str]) -> tuple[float, float]:
        among = [lang] if lang in self.bins else self.langs
        return min((self.distances(x, chars, words) for x in among), key=sum, default=(0.0, 0.0))


def references(docs: DataFrame, common: int = COMMON) -> References:
    """Over all rows of ``docs`` (lang, text); rows without lang are left out."""
    counted = light(docs).where("lang IS NOT NULL").select("lang", "text").mapInArrow(_count, "lang string, word string, class int, n long")
    counts = keep(counted.groupBy("lang", "word", "class").agg(F.sum("n").alias("n")), "counts")
    total = counts.where("word IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("total"))
    most = Window.partitionBy("lang", F.col("word").isNull()).orderBy(F.col("n").desc(), "word")
    # a table of the languages times some fifty numbers
    rows = counts.withColumn("nth", F.row_number().over(most)).where(F.col("nth") <= max(common, len(CLASSES))).join(total, "lang", "left")
    return References([r for r in rows.collect() if r["word"] is None or r["nth"] <= common])


def judge(docs: DataFrame, refs: References | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, char_distance, word_distance of each row of ``docs`` (doc_id, text, lang)."""
    shared = docs.sparkSession.sparkContext.broadcast(refs or references(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for ids, texts, langs in slices(batches):
            texts = [t or "" for t in texts]
            chars = class_counts(texts)
            out = []
            for t, lang, c in zip(texts, langs, chars):
                words = WORD.findall(t)
                n, again = len(words), repeated_words(words)
                failed = n < 50 or 100 * again > 50 * n
                dc, dw = known.nearest(lang, c, [w.lower() for w in words]) if n else (0.0, 0.0)
                far = (len(t) >= LEAST_CHARS and dc > CHAR_LIMIT + CHAR_SLACK / len(t)) or (n >= LEAST_WORDS and dw > WORD_LIMIT + WORD_SLACK / n)
                out.append((n, int(c.sum() - c[1]), int(c[2]), repeated_lines(t), again, failed, not failed and not far, dc, dw))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance"]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(x, k) for x, k in zip(zip(*out), kinds))], names)

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"
    return light(docs).select(F.col("doc_id").cast("long"), "text", "lang").mapInArrow(run, schema)
