"""Line dedup against plain Python; filters and counts that come back to what they were."""

import collections
import hashlib
import random

import numpy as np
import pytest

from stacklore.llm import lines

BLANK = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, keys string, row int, Text2 string"


def _key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def _brute(texts, least, chars=1):
    split = [(t or "").split("\n") for t in texts]
    n = collections.Counter(k for own in split for k in {_key(x) for x in own} if len(k) >= max(chars, 1))
    left = [[x for x in own if n[_key(x)] < least] for own in split]
    return [(len(own), len(own) - len(x), hashlib.sha256("\n".join(x).encode()).hexdigest()) for own, x in zip(split, left)]


def _texts():
    rng = random.Random(5)
    pool = ["Home", " home\t", "HOME\r", "Ünïcode", "ünïcode", "a", "ÀB", "\x0bhome", " home", *(f"line {i}" for i in range(40))]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(9))) for _ in range(120)]
    return [*texts, None, "", "\n", "home\n" * 50, "x" * 200_000 + "\nhome", "\n".join(f"long {i}" for i in range(20_000)), *["Home\nkeep"] * 30]


def _rows(texts):
    return [(i // 2 if i % 7 else None, t, "k", i, "z") for i, t in enumerate(texts)]


@pytest.mark.parametrize("least, chars", [(10, 1), (2, 3), (1, 1)])
def test_against_brute_force(spark, least, chars):
    texts = _texts()
    got = lines.line_dedup(spark.createDataFrame(_rows(texts), SCHEMA).repartition(5), least, chars).collect()
    want = [(r[0], *w) for r, w in zip(_rows(texts), _brute(texts, least, chars))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_documents_come_and_go(spark, tmp_path):
    """Adding, removing and adding again gives the tables of the documents that are left, also after a save."""
    texts = _texts()
    frame = lambda own: spark.createDataFrame(_rows(own), SCHEMA)
    index = lines.LineIndex(spark, 10)
    index.add(frame(texts[:80]))
    index.add(frame(texts[80:]))
    index.save(f"file://{tmp_path}/index")
    index = lines.LineIndex.load(spark, f"file://{tmp_path}/index")
    index.remove(frame(texts[:60]))
    fresh = lines.LineIndex(spark, 10)
    fresh.add(frame(texts[60:]))
    rows = lambda x: sorted((r.shard, bytes(r.key), r.n) for r in x.counts.collect())
    assert rows(index) == rows(fresh) and rows(index)
    often = {r[1] for r in rows(index) if r[2] >= 10}
    held = {r.shard: lines.Chain([bytes(b) for b in r.blobs]) for r in index.filters.collect()}
    for shard, key, n in rows(index):
        if n >= 10:
            assert held[shard].holds(lines._halves([key]))[0]
    full = sum(int((np.concatenate([f.table.ravel() for f in c.filters]) > 0).sum()) for c in held.values() if c.filters)
    assert full == len(often)  # what fell below the limit is out of the filters
    got = lines.drop_lines(frame(texts), index)
    assert got.columns == ["doc_id", "text", "keys", "row", "Text2"]
    count = collections.Counter(k for t in texts[60:] for k in {_key(x) for x in (t or "").split("\n")})
    want = {i: None if t is None else "\n".join(x for x in t.split("\n") if not _key(x) or count[_key(x)] < 10) for i, t in enumerate(texts)}
    assert {r.row: r.text for r in got.collect()} == want


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert lines.line_dedup(empty).collect() == []
    assert lines.drop_lines(empty, lines.LineIndex(spark)).collect() == []


def test_cuckoo_holds_what_is_in_and_grows():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1 << 63, (3000, 2)).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, (3000, 2)).astype(np.uint64)
    chain = lines.Chain()
    for part in np.array_split(keys, 7):
        chain.put(part)
        chain = lines.Chain(chain.bytes())
    assert chain.holds(keys).all() and len(chain.filters) > 1
    chain.take(keys[:1500])
    assert chain.holds(keys[1500:]).all() and chain.holds(keys[:1500]).mean() < 0.01
    chain.take(keys[1500:])
    assert not any(f.table.any() for f in chain.filters)


def test_full_filter_stays_as_it_was():
    f = lines.Cuckoo(4)
    keys = np.random.default_rng(4).integers(0, 1 << 62, (60, 2)).astype(np.uint64) << np.uint64(2)
    inside = [k for k in keys if f.put(k)]
    assert 8 < len(inside) <= 16 and f.holds(np.array(inside)).all()
