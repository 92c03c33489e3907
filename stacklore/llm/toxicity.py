"""Toxic passages by maximum-scoring segment search.

Word counts of labelled texts, smoothed by a Dirichlet prior in proportion to the
pooled counts, give each word a log-odds score; words whose score is not
significant, and unknown ones, get a small negative drift. One linear scan over a
text's scores finds every maximal segment. Under random text the best segment's
score has an extreme-value law, fitted on clean labelled texts: a segment of score
S in n words has E = K n exp(-L S). Segments with E below ``most_e`` are the
significant passages; their bits above that bound are summed, and a logistic
calibration on labelled texts turns the sum and the number of passages into the
score.

How significant a word must be is chosen by cross-validation on the labelled texts:
the words of the other folds find the segments of each fold's texts, once for each of
``BOUNDS``, and the bound with the least log loss stays. The law and the calibration
are those of the texts scored in this way, so weak words are judged on texts that did
not choose them.

A word counts once for each text that holds it. Labels come from rows of the
caller's choice, at most about ``most`` of each class, picked by hash from all of
them; one text of each label and family of near copies counts, so a large group of
copies does not set the words. Null and empty texts and texts without a scored word have
the score of no passage. Repeated rows are scored each on its own. Without labels
of both classes every score is 0; an empty table gives an empty result. Ties between
bounds go to the stricter one. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stacklore.llm.base import below, light, place, slices

#: Labelled rows of each class that a fit uses, at most about.
FIT_ROWS = 8000
#: Words that the score table holds, the most significant ones, at most.
FIT_WORDS = 100_000
WORD = re.compile(r"[^\W\d_]+")
#: The prior counts this share of the pooled counts; a word's signed root of the
#: likelihood ratio against equal rates must reach one of BOUNDS, its log-odds LEAST_ODDS.
PRIOR, BOUNDS, LEAST_ODDS, DRIFT = 0.01, (5.5, 5.0, 4.5, 4.0, 3.5, 3.0, 2.5), 0.7, -0.12
FOLDS = 4


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), left to right, in linear time.

    A stack of candidates with the sums before and after each; a newcomer joins back
    over those that it can only improve.
    """
    total = np.concatenate(([0.0], np.cumsum(score)))
    rising = np.flatnonzero(score > 0)
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, before, after, last candidate with a smaller "before"
    for i in rising.tolist():
        start, before, after = i, float(total[i]), float(total[i + 1])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= before:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= after:
                stack.append((start, i + 1, before, after, j))
                break
            start, before = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, after - before) for a, b, before, after, _ in stack]


class ToxicModel:
    """Scores by word, the extreme-value law, and the calibration."""

    def __init__(self, words: dict[str, float]):
        self.words, self.rate, self.k, self.most_e = words, 1.0, 1.0, 0.5
        self.weights = np.zeros(3)
        self.ready = False
        #: Cross-validated (bound, log loss, recall and share of clean texts at a score of 0.7), and the bound chosen.
        self.bounds: list[tuple[float, float, float, float]] = []
        self.bound = None

    def passages(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """Words of the text, and its maximal segments."""
        words = words_of(text)
        s = np.fromiter(map(self.words.get, words, repeat(DRIFT)), np.float64, len(words))
        return len(words), segments(s) if len(s) and s.max() > 0 else []

    def significant(self, n: int, found: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
        """Segments whose E value is small, with their bits above the bound."""
        out = []
        for a, b, s in found:
            e = np.log(max(self.k * n, 1e-300)) - self.rate * s
            if e < np.log(self.most_e):
                out.append((a, b, float(np.log(self.most_e) - e) / np.log(2)))
        return out

    def traits(self, text: str | None) -> tuple[float, float]:
        bits = [x for *_, x in self.significant(*self.passages(text))]
        return float(np.log1p(sum(bits))), float(np.log1p(len(bits)))

    def score(self, traits: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.zeros(len(traits))
        z = self.weights[0] + traits @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _class_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each fold and class that hold each word, of one task's labelled texts."""
    counts: dict[str, list[int]] = {}
    for labels, texts, folds in slices(batches):
        for y, t, f in zip(labels, texts, folds):
            for w in set(words_of(t)):
                counts.setdefault(w, [0] * (2 * FOLDS))[2 * f + y] += 1
    names = list(counts)
    for i in range(0, len(names), 50_000):
        part = names[i : i + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.string()), *(pa.array([counts[w][k] for w in part], pa.int64()) for k in range(2 * FOLDS))], ["word", *_cells()]
        )


def _cells() -> list[str]:
    return [f"{c}{f}" for f in range(FOLDS) for c in ("clean", "toxic")]


def _evidence(clean: Column, toxic: Column, n_clean: float, n_toxic: float) -> tuple[Column, Column]:
    """Log-odds of a word, and the signed root of its likelihood ratio."""
    both = clean + toxic
    prior, all_prior = F.lit(PRIOR) * both, PRIOR * (n_clean + n_toxic)
    up, down = toxic + prior, clean + prior
    odds = F.log(up / (n_toxic + all_prior - up)) - F.log(down / (n_clean + all_prior - down))
    share = n_toxic / (n_clean + n_toxic)
    part = lambda n, p: F.when(n > 0, n * F.log(n / (both * p))).otherwise(0.0)
    z = F.signum(odds) * F.sqrt(F.greatest(2 * (part(toxic, share) + part(clean, 1 - share)), F.lit(0.0)))
    return F.when(both > 0, odds).otherwise(0.0), F.when(both > 0, z).otherwise(0.0)


def _family(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least hash of each text's three-word runs: most near copies share it, other texts hardly ever."""
    for ids, texts in slices(batches):
        keys = []
        for t in texts:
            w = words_of(t)
            keys.append(min(map(xxhash.xxh3_64_intdigest, map(" ".join, zip(w, w[1:], w[2:]))), default=xxhash.xxh3_64_intdigest(t or "")) >> 1)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64())], ["doc_id", "h"])


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> ToxicModel:
    """``docs`` (doc_id, text) and ``labels`` (doc_id, toxic) of the rows to learn from."""
    spark = docs.sparkSession
    labels = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    size = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    if len(size) < 2:
        return ToxicModel({})
    cut = F.create_map(*(F.lit(x) for y, n in size.items() for x in (y, below(most / n))))
    picked = labels.where(place("doc_id") <= F.element_at(cut, F.col("toxic")))
    # about 2 * most rows of two numbers, whatever the size of the tables
    rows = light(docs).join(F.broadcast(picked), "doc_id").select("doc_id", "text").mapInArrow(_family, "doc_id long, h long")
    first = rows.join(F.broadcast(picked), "doc_id").groupBy("toxic", "h").agg(F.min("doc_id").alias("doc_id"))
    own = {r["doc_id"] for r in first.select("doc_id").collect()}
    chosen = spark.createDataFrame([(int(i),) for i in sorted(own)], "doc_id long")
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    rows = docs.join(F.broadcast(picked.join(F.broadcast(chosen), "doc_id")), "doc_id").select(F.col("toxic").cast("int").alias("toxic"), "text", fold)
    counts = rows.mapInArrow(_class_words, "word string, " + ", ".join(f"{c} long" for c in _cells())).groupBy("word").agg(*(F.sum(c).alias(c) for c in _cells()))
    total = counts.agg(*(F.sum(c) for c in _cells())).first()
    n_clean, n_toxic = (sum(float(x or 0) for x in total[k::2]) for k in (0, 1))
    if not n_clean or not n_toxic:
        return ToxicModel({})
    clean, toxic = (sum(F.col(c) for c in _cells()[k::2]) for k in (0, 1))
    # the evidence of all folds, then without each of them
    sums = [(clean, toxic, n_clean, n_toxic)]
    sums += [(clean - F.col(f"clean{f}"), toxic - F.col(f"toxic{f}"), n_clean - float(total[2 * f] or 0), n_toxic - float(total[2 * f + 1] or 0)) for f in range(FOLDS)]
    told = [_evidence(*x) if min(x[2:]) > 0 else (F.lit(0.0), F.lit(0.0)) for x in sums]
    scored = counts.select("word", F.array(*(o for o, _ in told)).alias("odds"), F.array(*(z for _, z in told)).alias("z"))
    scored = scored.withColumn("most", F.array_max(F.transform("z", F.abs))).where(F.col("most") >= min(BOUNDS)).orderBy(F.desc("most"), "word").limit(FIT_WORDS).collect()
    names = [r["word"] for r in scored]
    odds, z = (np.array([r[c] for r in scored], float).reshape(-1, 1 + FOLDS) for c in ("odds", "z"))
    odds[np.abs(odds) < LEAST_ODDS] = np.nan
    odds = np.clip(odds, -4, 4)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments of each text by the words of the other folds, for each bound."""
        number = {w: i for i, w in enumerate(names)}
        tables = [[np.append(np.where((np.abs(z[:, 1 + f]) >= b) & ~np.isnan(odds[:, 1 + f]), odds[:, 1 + f], DRIFT), DRIFT) for b in BOUNDS] for f in range(FOLDS)]
        for ys, texts, folds in slices(batches):
            sizes, found = [], []
            for t, f in zip(texts, folds):
                words = words_of(t)
                at = np.fromiter(map(number.get, words, repeat(len(names))), np.int64, len(words))
                sizes.append(len(words))
                found.append([[s for *_, s in segments(x[at])] for x in tables[f]])
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.list_(pa.float64())))], ["toxic", "n", "found"])

    sample = rows.mapInArrow(read, "toxic int, n long, found array<array<double>>").collect()
    sample.sort(key=lambda r: (r["toxic"], r["n"], r["found"]))
    models = []
    for k, bound in enumerate(BOUNDS):
        use = (np.abs(z[:, 0]) >= bound) & ~np.isnan(odds[:, 0])
        model = ToxicModel({w: float(o) for w, o, u in zip(names, odds[:, 0], use) if u})
        models.append((*_calibrate(model, [(r["toxic"], r["n"], r["found"][k]) for r in sample], size), model))
    best = min(range(len(BOUNDS)), key=lambda k: models[k][0])
    model = models[best][-1]
    model.bound, model.bounds = BOUNDS[best], [(b, *m[:3]) for b, m in zip(BOUNDS, models)]
    return model


def _calibrate(model: ToxicModel, sample: list[tuple[int, int, list[float]]], size: dict[int, int]) -> tuple[float, float, float]:
    """Fit the law and the calibration on (label, words, segment scores); log loss, and the shares of toxic and of clean texts that score 0.7."""
    # the law of the best segment, by moments over clean texts: S - ln(n)/L is Gumbel
    clean = [(n, max(found, default=0.0)) for y, n, found in sample if y == 0 and n]
    best = np.array([s for _, s in clean])
    if len(best) > 10 and best.std() > 0:
        model.rate = float(min(np.pi / (best.std() * np.sqrt(6)), 4.0))
        mode = np.mean(best - np.log([n for n, _ in clean]) / model.rate) - 0.5772 / model.rate
        model.k = float(np.exp(np.clip(model.rate * mode, -30, 10)))
    y = np.array([y for y, *_ in sample], float)
    bits = [[b for *_, b in model.significant(n, [(0, 0, s) for s in found])] for _, n, found in sample]
    x = np.array([[1.0, np.log1p(sum(b)), np.log1p(len(b))] for b in bits]).reshape(-1, 3)
    # rows of a class stand for all labelled rows of it
    weight = np.where(y == 1, size[1] / max(y.sum(), 1), size[0] / max((1 - y).sum(), 1))
    weight /= weight.mean()
    w = np.zeros(3)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.1 * w)
        w += np.clip(step, -2, 2)
    model.weights, model.ready = w, True
    p = np.clip(model.score(x[:, 1:]), 1e-9, 1 - 1e-9)
    loss = -np.average(np.where(y == 1, np.log(p), np.log(1 - p)), weights=weight)
    return float(loss), float((p[y == 1] >= 0.7).mean()), float((p[y == 0] >= 0.7).mean())


def score_toxicity(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """doc_id, score, n_passages, passages (word ranges and bits of the significant ones) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for ids, texts in slices(batches):
            found = [m.significant(*m.passages(t)) for t in texts]
            traits = np.array([[np.log1p(sum(b for *_, b in x)), np.log1p(len(x))] for x in found]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(m.score(traits), pa.float64()),
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([",".join(f"{a}:{b}:{s:.2f}" for a, b, s in x) for x in found], pa.string()),
                ],
                ["doc_id", "score", "n_passages", "passages"],
            )

    return light(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, n_passages long, passages string")
