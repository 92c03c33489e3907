"""Language of words and texts by a linear-chain conditional random field.

Every word of a text has a language as its hidden label. A word's potentials sum
over hashed features: character n-grams of one to four with word borders (those at
a border are its affixes) and, for frequent words of the training texts, the word
itself (the lexicon, ``LEXICON`` words of each language). Transition potentials are learned too. Forward-backward over
the whole text gives each word's posterior; their mean over the text is its
distribution, the largest share the prediction and the score.

Texts carry one label each, so switching is learned from training sequences that
splice runs of words of different languages. The fit uses the ``most`` texts of each
language whose hashes come first among all labelled rows; equal texts count once.

Null texts and texts without a letter (digits and number signs are none) are ``und``
with score 0. Repeated rows are labelled each on its own. Ties between languages go to
the first by name. Without labelled rows everything is ``und``; an empty table gives an
empty result. Extra columns are ignored, or carried as they are by
``keep_known_languages``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacklore.llm.base import light, sampled, slices

#: Labelled texts of each language that a fit uses, at most.
FIT_TEXTS = 120
FIT_STEPS = 25
BUCKETS = 1 << 17
WORD = re.compile(r"[^\W\d_]+")
#: Words whose potentials a task keeps, and that it makes in one numpy step, at most about.
KNOWN, STEP = 200_000, 20_000
LEXICON = 300
#: Words handled in one forward-backward pass, at most about (texts are never cut).
PASS_WORDS, PASS_CHARS = 250_000, 1_200_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def has_letter(words: list[str]) -> bool:
    return any(any(map(str.isalpha, w)) for w in words)


def word_features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, feature bucket) of all features of a list of words."""
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 2
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lens)
    own, bucket = [], []
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, 5):
        # h[i] covers codes[i : i + n]
        h = (h[: len(codes) - n + 1] if n > 1 else h) * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(n)
        same = owner[: len(h)] == owner[n - 1 :]
        x = (h[same] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)
        own.append(owner[: len(h)][same])
        bucket.append((x % np.uint64(BUCKETS)).astype(np.int64))
    lex = np.array([lexicon.get(w, -1) for w in words], np.int64)
    own.append(np.flatnonzero(lex >= 0))
    bucket.append(BUCKETS + lex[lex >= 0])
    return np.concatenate(own), np.concatenate(bucket)


class Chain:
    """Sequences of unequal length, laid out step by step, longest first."""

    def __init__(self, lens: np.ndarray):
        self.order = np.argsort(-lens, kind="stable")
        self.lens = lens[self.order]
        longest = int(self.lens[0]) if len(lens) else 0
        self.width = np.searchsorted(-self.lens, -np.arange(longest), side="left")  # sequences that reach step t
        self.begin = np.concatenate(([0], np.cumsum(self.width)))
        rank = np.empty(len(lens), np.int64)
        rank[self.order] = np.arange(len(lens))
        own = np.repeat(np.arange(len(lens)), lens)
        step = np.arange(len(own)) - np.repeat(np.cumsum(lens) - lens, lens)
        self.slot = self.begin[step] + rank[own]  # where each word, in text order, lies

    def posteriors(self, potential: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Posterior of each word (in text order), expected transitions, log partition sum."""
        e = potential
        top = e.max(axis=1, keepdims=True)
        emit = np.empty_like(e)
        emit[self.slot] = np.exp(e - top)
        trans = np.exp(transition).astype(e.dtype)
        fore, norm = np.empty_like(emit), np.empty(len(emit), e.dtype)
        w, b = self.width, self.begin
        for t in range(len(w)):
            a = emit[b[t] : b[t + 1]]
            if t:
                a = (fore[b[t - 1] : b[t - 1] + w[t]] @ trans) * a
            s = a.sum(axis=1)
            norm[b[t] : b[t + 1]] = s
            fore[b[t] : b[t + 1]] = a / s[:, None]
        back = np.ones_like(emit)
        pairs = np.zeros((e.shape[1],) * 2)
        for t in range(len(w) - 2, -1, -1):
            n = w[t + 1]
            x = emit[b[t + 1] : b[t + 2]] * back[b[t + 1] : b[t + 2]] / norm[b[t + 1] : b[t + 2], None]
            back[b[t] : b[t] + n] = x @ trans.T
            pairs += fore[b[t] : b[t] + n].T @ x
        post = fore * back
        post /= post.sum(axis=1, keepdims=True)
        return post[self.slot], pairs * trans, float(np.log(norm).sum() + top.sum())


class LanguageModel:
    def __init__(self, names: list[str]):
        self.names, self.lexicon = names, {}
        self.weights = np.zeros((BUCKETS + LEXICON * len(names), max(len(names), 1)), np.float32)
        self.transition = np.zeros((max(len(names), 1),) * 2)

    def fit(self, texts: list[str], labels: list[int], steps: int = FIT_STEPS) -> LanguageModel:
        """Adagrad on the conditional likelihood of spliced sequences."""
        rng = np.random.default_rng(11)
        runs: list[tuple[list[str], int]] = []
        common: list[dict[str, int]] = [{} for _ in self.names]
        for t, y in zip(texts, labels):
            words, at = words_of(t), 0
            for w in words:
                common[y][w] = common[y].get(w, 0) + 1
            while at < len(words):
                n = int(rng.integers(5, 90))
                runs.append((words[at : at + n], y))
                at += n
        frequent = {w for c in common for w in sorted(c, key=lambda w: (-c[w], w))[:LEXICON] if c[w] > 2}
        self.lexicon = {w: i for i, w in enumerate(sorted(frequent))}
        rng.shuffle(runs)
        vocab: dict[str, int] = {}
        seq, gold, lens = [], [], []
        for i in range(0, len(runs), 4):
            part = runs[i : i + 4]
            seq += [vocab.setdefault(w, len(vocab)) for r, _ in part for w in r]
            gold += [y for r, y in part for _ in r]
            lens.append(sum(len(r) for r, _ in part))
        lens = np.array([n for n in lens if n], np.int64)
        if not len(lens) or len(self.names) < 2:
            return self
        seq, gold = np.array(seq), np.array(gold)
        k = len(self.names)
        truth = np.eye(k)[gold]
        ends = np.cumsum(lens)
        inner = np.setdiff1d(np.arange(len(seq)), ends - 1)
        seen = np.zeros((k, k))
        np.add.at(seen, (gold[inner], gold[inner + 1]), 1)
        own, bucket = word_features(list(vocab), self.lexicon)
        used, at = np.unique(bucket, return_inverse=True)
        starts = np.flatnonzero(np.concatenate(([True], np.diff(np.sort(own)) != 0)))
        by_word = np.argsort(own, kind="stable")
        w, trans = np.zeros((len(used), k)), np.zeros((k, k))
        gw, gt = np.full_like(w, 1e-2), np.full_like(trans, 1e-2)
        chain = Chain(lens)
        for _ in range(steps):
            words = np.add.reduceat(w[at[by_word]], starts, axis=0)
            post, pairs, _ = chain.posteriors(words[seq], trans)
            g = truth - post
            gword = np.stack([np.bincount(seq, g[:, j], minlength=len(vocab)) for j in range(k)], axis=1)
            grad = np.stack([np.bincount(at, gword[own, j], minlength=len(used)) for j in range(k)], axis=1) - 0.05 * w
            tgrad = seen - pairs - 0.05 * trans
            gw += grad**2
            gt += tgrad**2
            w += 0.35 * grad / np.sqrt(gw)
            trans += 0.35 * tgrad / np.sqrt(gt)
        self.weights[used] = w
        self.transition = trans
        return self

    def word_potentials(self, words: list[str]) -> np.ndarray:
        own, bucket = word_features(words, self.lexicon)
        order = np.argsort(own, kind="stable")
        starts = np.searchsorted(own[order], np.arange(len(words)))
        return np.add.reduceat(self.weights[bucket[order]], starts, axis=0)


class Labeller:
    """Applies a model to batches of texts, keeping the potentials of known words."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.potential = np.zeros((0, len(self.model.names)), np.float32)

    def posteriors(self, parts: list[list[str]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For runs of texts: the first one's number, their word counts and all their words' posteriors."""
        seen = set().union(*parts) if parts else set()
        if len(self.number) + len(seen) > KNOWN:
            self._forget()
        new = [w for w in seen if w not in self.number]
        if new:
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            made = [self.model.word_potentials(new[i : i + STEP]) for i in range(0, len(new), STEP)]
            self.potential = np.concatenate((self.potential, *made))
        start = 0
        while start < len(parts):
            end, n = start, 0
            while end < len(parts) and (end == start or n + len(parts[end]) <= PASS_WORDS):
                n += len(parts[end])
                end += 1
            lens = np.array([len(p) for p in parts[start:end]], np.int64)
            ids = np.fromiter((i for p in parts[start:end] for i in map(self.number.__getitem__, p)), np.int64, n)
            some = np.flatnonzero(lens)
            post = Chain(lens[some]).posteriors(self.potential[ids], self.model.transition)[0] if n else np.zeros((0, len(self.model.names)))
            yield start, lens, post
            start = end

    def texts(self, texts: list[str | None]) -> tuple[list[str], list[float], list[int]]:
        """Language, score, and switches between words of different languages, of each text."""
        names, parts = self.model.names, [words_of(t) for t in texts]
        lang, score, switches = ["und"] * len(texts), [0.0] * len(texts), [0] * len(texts)
        if not names:
            return lang, score, switches
        for start, lens, post in self.posteriors(parts):
            ends = np.cumsum(lens)
            some = np.flatnonzero(lens)
            if not len(some):
                continue
            mean = np.add.reduceat(post, (ends - lens)[some], axis=0) / lens[some, None]
            best = post.argmax(axis=1)
            turn = np.concatenate((best[1:] != best[:-1], [False]))
            turn[ends[some] - 1] = False
            turns = np.add.reduceat(turn.astype(np.int64), (ends - lens)[some])
            for i, m, k in zip(some.tolist(), mean, turns.tolist()):
                if has_letter(parts[start + i]):
                    lang[start + i], score[start + i], switches[start + i] = names[int(m.argmax())], float(min(m.max(), 1.0)), k
        return lang, score, switches


def fit(labelled: DataFrame, most: int = FIT_TEXTS) -> LanguageModel:
    """``labelled`` has text and lang; rows without either are left out. Copies of a text count once, however many there are."""
    sample = sampled(labelled.where("lang IS NOT NULL").select("text", "lang"), most, "lang").collect()
    sample.sort(key=lambda r: (r["lang"], r["h"]))
    names = sorted({r["lang"] for r in sample})
    return LanguageModel(names).fit([r["text"] for r in sample], [names.index(r["lang"]) for r in sample])


def label_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score, n_switches of each row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for ids, texts in slices(batches, limit=PASS_CHARS):
            lang, score, switches = labeller.texts(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(switches, pa.int64())],
                ["doc_id", "lang_pred", "score", "n_switches"],
            )

    return light(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, n_switches long")


def keep_known_languages(docs: DataFrame, model: LanguageModel, least: float = 0.3) -> DataFrame:
    """Rows of ``docs`` whose text has a language with at least that score; all columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for batch in batches:
            ok = []
            for (texts,) in slices(iter([batch.select(["text"])]), text=0, limit=PASS_CHARS):
                lang, score, _ = labeller.texts(texts)
                ok += [x != "und" and s >= least for x, s in zip(lang, score)]
            yield batch.filter(pa.array(ok, pa.bool_()))

    return light(docs).mapInArrow(run, docs.schema)
