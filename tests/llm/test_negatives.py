"""Hard negatives against plain Python over odd rows, in one block and in many."""

import math
import random

import numpy as np
import pytest

from stacklore.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>, row string, vec string, block int"


def _brute(rows, least=0.3, most=0.9):
    fit = [(i, y, [math.floor(256 * x) for x in v]) for i, y, v, *_ in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    late = lambda i: (i is None, i)
    out = []
    for a, (i, y, v) in enumerate(fit):
        if i is None or i % 100:
            continue
        scores = [(dot(v, w), j, z) for b, (j, z, w) in enumerate(fit) if b != a]
        own = sorted(((-s, late(j), j) for s, j, z in scores if z == y))[:5]
        for nth, (p, _, j) in enumerate(own):
            p = -p
            good = sorted((-s, late(k), k) for s, k, z in scores if z != y and 30 * p <= 100 * s <= 90 * p)[:10]
            out += [(i, j, r + 1, k, p, -s, nth + 1) for r, (s, _, k) in enumerate(good)]
    return sorted(out, key=str)


def _rows(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = [rng.choice((0.0, rng.gauss(0, 1), 0.25)) for _ in range(6)]
        rows.append((i, rng.randrange(3), v, "x", "y", 1))
    rows += [rows[5], rows[100], (7, None, [1.0] * 6, "x", "y", 1), (8, 1, None, "x", "y", 1), (9, 1, [1.0, None], "x", "y", 1), (None, 1, [0.5] * 6, "x", "y", 1)]
    rows += [(300, 2, [math.nan] * 6, "x", "y", 1), (400, 0, [math.inf] * 6, "x", "y", 1), (500, 0, [0.5, 1.0], "x", "y", 1), (600, 1, [], "x", "y", 1), (700, 99, [1.0] * 6, "x", "y", 1)]
    return rows


@pytest.mark.parametrize("rows_, anchors", [(65_536, 65_536), (40, 2)])
def test_against_brute_force(spark, monkeypatch, rows_, anchors):
    monkeypatch.setattr(negatives, "ROWS", rows_)
    monkeypatch.setattr(negatives, "ANCHORS", anchors)
    rows = _rows(260, 3)
    got = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), "vec_id % 100 = 0").collect()
    assert sorted(map(tuple, got), key=str) == _brute(rows)


def test_empty_and_without_anchors(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], SCHEMA), "vec_id % 100 = 0").collect() == []
    assert negatives.hard_negatives(spark.createDataFrame(_rows(120, 1)[1:5], SCHEMA), "vec_id % 100 = 0").collect() == []


def test_scans_read_few_dimensions_where_bounds_tell(spark):
    """One strong dimension first: after a step only the rows that can win are left, and longs stay exact where doubles do not."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    vecs = rng.integers(-3, 4, (500, 32))
    vecs[:, 17] = rng.permutation(500) * 1000
    table = pa.table({"vec_id": list(range(500)), "row": list(range(500)), "label": ["a"] * 500, "vec": vecs.tolist()})
    block = negatives.Block(table)
    scan = negatives.Scan(block, vecs[3], np.ones(500, bool))
    scan.step()
    low, high = scan.bounds()
    scan.shrink(high >= negatives._kth(low, 5))
    assert len(scan.able) < 10
    able, score = negatives.best(negatives.Scan(block, vecs[3], np.ones(500, bool)), 5)
    assert sorted(score)[-5:] == sorted((vecs @ vecs[3]).tolist())[-5:] and set(score) <= set((vecs @ vecs[3]).tolist())
    big = np.full((3, 4), negatives.limit(4), np.int64)
    assert not negatives._exact(big, big) and 100 * 4 * negatives.limit(4) ** 2 < 2**63
