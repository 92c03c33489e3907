"""Token counts by rank-synchronous merging of ragged arrays.

A text is split into pre-tokens. Those of a batch that are not known yet lie
end to end in one symbol array; in each step every pre-token merges all
occurrences of its own lowest-ranked pair at once, until no pair has a rank.
A merge only makes pairs of later rank, so this gives the symbols that merging
one pair at a time gives. What survives is counted.

Null and empty texts have no tokens. Repeated rows are counted each on its own.
The special string counts as one token wherever it stands in a text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacklore.llm.base import light, slices

#: How byte-level vocabularies split texts before merging.
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Pre-tokens whose counts one task keeps before it starts anew.
KNOWN = 600_000
#: Slots of each half of the pair table, as a power of two, and its two hash factors.
BITS, FACTORS = 17, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
NO_RANK = np.iinfo(np.int32).max


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is
    printable Latin-1, else the next free one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in own else next(free)) for b in range(256)]


def places(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two slots where a key may lie."""
    k = key.astype(np.uint64)
    return tuple(((k * np.uint64(f)) >> np.uint64(64 - BITS)).astype(np.int64) + i * (1 << BITS) for i, f in enumerate(FACTORS))


def two_place_table(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key in one of its two slots; a newcomer moves the holder to its other one."""
    slots, index = np.full(2 << BITS, -1, np.int64), np.zeros(2 << BITS, np.int32)
    both = np.stack(places(keys), axis=1).tolist()
    held: dict[int, int] = {}
    for i in range(len(keys)):
        at, item = both[i][0], i
        for _ in range(500):
            item, held[at] = held.get(at, -1), item
            if item < 0:
                break
            at = both[item][1] if at == both[item][0] else both[item][0]
        else:
            raise ValueError("the table is too full")
    where, what = np.array(list(held), np.int64), np.array(list(held.values()), np.int64)
    slots[where], index[where] = keys[what], what
    return slots, index


class RankMerger:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        self.base = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.slots, self.rank = two_place_table(keys)
        self.made = made
        self.first = np.array([vocab[c] for c in byte_symbols()], np.int64)
        self.special = [t["content"] for t in spec.get("added_tokens", ()) if t["special"]]
        self.split = regex.compile(SPLIT)
        self.known: dict[str, int] = {}

    def survivors(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols left of each piece (none of them empty)."""
        out = np.zeros(len(pieces), np.int64)
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        sym = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        ids = np.arange(len(pieces))
        while len(ids):
            ends = np.cumsum(lens)
            key = sym[:-1] * self.base + sym[1:]
            rank = np.full(len(sym), NO_RANK, np.int32)
            for at in places(key):
                found = np.flatnonzero(self.slots[at] == key)
                rank[found] = self.rank[at[found]]
            rank[ends - 1] = NO_RANK
            best = np.minimum.reduceat(rank, ends - lens)
            alive = best < NO_RANK
            out[ids[~alive]] = lens[~alive]
            hit = np.flatnonzero((rank == np.repeat(best, lens)) & np.repeat(alive, lens))
            if not len(hit):
                break
            # of overlapping occurrences (a run of one symbol) every second one merges
            begins = np.concatenate(([True], np.diff(hit) != 1))
            nth = np.arange(len(hit)) - np.maximum.accumulate(np.where(begins, np.arange(len(hit)), 0))
            hit = hit[nth % 2 == 0]
            sym[hit] = self.made[rank[hit]]
            stay = np.repeat(alive, lens)
            stay[hit + 1] = False
            gone = np.bincount(np.searchsorted(ends, hit, side="right"), minlength=len(lens))
            lens, ids, sym = (lens - gone)[alive], ids[alive], sym[stay]
        return out

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text."""
        parts, extra = [], []
        for text in texts:
            cut = [text or ""]
            for s in self.special:
                cut = [y for x in cut for y in x.split(s)]
            extra.append(len(cut) - 1)
            parts.append([w for x in cut for w in self.split.findall(x)] if len(cut) > 1 else self.split.findall(cut[0]))
        seen: set[str] = set()
        for words in parts:
            seen.update(words)
        if len(self.known) + len(seen) > KNOWN:
            self.known.clear()
        new = [w for w in seen if w not in self.known]
        # pieces of like length share an array, so that a long one holds up few
        new.sort(key=len)
        for group in _even(new):
            self.known.update(zip(group, self.survivors([w.encode() for w in group]).tolist()))
        return [n + sum(map(self.known.__getitem__, words)) for n, words in zip(extra, parts)]


def _even(words: list[str], most: int = 400_000) -> Iterator[list[str]]:
    """Runs of words of at most about ``most`` characters."""
    marks = [x // most for x in accumulate(map(len, words))]
    start = 0
    for i in range(1, len(words) + 1):
        if i == len(words) or marks[i] != marks[start]:
            yield words[start:i]
            start = i


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs``.

    ``vocabulary`` is the path of a byte-level BPE file in the tokenizers JSON
    format, readable on every executor. Needs the columns doc_id and text; others
    are ignored. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = RankMerger(vocabulary)
        for ids, texts in slices(batches):
            n = merger.count(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array(n, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    out = light(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
