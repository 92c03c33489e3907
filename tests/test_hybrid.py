"""Hybrid search: lanes against plain Python, routes, fusion, tail policy, and what is shuffled."""

import random

import numpy as np
import pytest

from stacklore.operators import hybrid as h

CONTENT = "id long, content_type string, title string, text string"
QUERIES = "query_id long, text string, intent string, lemmas array<string>, vec array<double>"


def _hits(spark, docs, queries, vectors=(), pool=50):
    content = spark.createDataFrame(docs, CONTENT).repartition(3)
    vecs = spark.createDataFrame(list(vectors), "id long, vec array<double>").repartition(3)
    return h.lanes(content, vecs, spark.createDataFrame(queries, QUERIES), pool)


def test_scores_of_word_hits():
    assert h.word_hits(["gardens", "and", "gardener"], "", ["garden"]) == 80
    assert h.word_hits(["gardens"], "the garden", ["garden"]) == 79
    assert h.word_hits(["kindergarden"], "", ["garden"]) is None
    assert h.word_hits(["garden"], "kindergarden", ["garden"]) is None  # the title holds it inside a word only
    assert h.word_hits(["garden", "garden"], "kindergarden", ["garden"]) == 80
    assert h.word_hits(["ab"] * 9, "", ["ab"]) is None  # lemmas of three letters at least
    assert h.word_hits(["abc"] * 9, "", ["abc"]) == 95


def test_lanes_against_plain_python(spark):
    rng = random.Random(4)
    words = "rose garden gardens tulip Tulips stone, path. river".split()
    kinds = ["BOOK", "ARTICLE", "HIGHLIGHT", "PERSONAL_NOTE", None, "OTHER"]
    docs = [(i, rng.choice(kinds), rng.choice(["Rose book", "Path", None]), " ".join(rng.choices(words, k=rng.randrange(7))) or None) for i in range(80)]
    docs.append((99, "PERSONAL_NOTE", None, "<h1>Research Report rose garden"))
    vecs = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(70)] + [(70, None), (71, [0.0] * 4)]
    queries = [(1, "rose garden", "DIRECT", ["rose", "garden"], [1.0, 0.0, 0.0, 0.0]), (2, "Tulips", "NARRATIVE", ["tulip"], None), (3, "", "X", None, [0.0, 1.0, 1.0, 0.0])]
    pool = 7
    got = {(r.query_id, r.lane, r["rank"]): (r.id, round(r.score, 6)) for r in _hits(spark, docs, queries, vecs, pool).collect()}
    plain = lambda t: h.TOKEN.findall("".join(c for c in (t or "").lower() if c.isalnum() or c in " _"))
    prio = lambda k, t: 5.8 if k == "PERSONAL_NOTE" and "<h1>research report" in (t or "").lower() else h.PRIORITY.get(k or "", 7.0)
    want = {}
    for q, text, _, lemmas, vec in queries:
        exact = sorted((prio(k, t), i) for i, k, _, t in docs if plain(text) and set(plain(text)) <= set(plain(t)))
        want |= {(q, "exact", n + 1): (i, 100.0) for n, (_, i) in enumerate(exact[:pool])}
        scored = [(prio(k, t), h.word_hits(plain(t), " ".join(plain(title)), lemmas or []), i) for i, k, title, t in docs]
        word = sorted((p, -s, i) for p, s, i in scored if s is not None)
        want |= {(q, "lemma", n + 1): (i, -s) for n, (_, s, i) in enumerate(word[:pool])}
        if vec:
            cos = lambda v: float(np.dot(v, vec) / max(np.linalg.norm(v) * np.linalg.norm(vec), 1e-30))
            near = sorted((-max(0.0, round(cos(v), 6)), i) for i, v in vecs if v)
            want |= {(q, "semantic", n + 1): (i, round(-s * 100, 6)) for n, (s, i) in enumerate(near[:pool])}
    assert got == want


def test_what_is_shuffled_is_bounded(spark):
    """A word that all texts hold: no join, and no more than the pool leaves a task for each query."""
    docs = [(i, "BOOK", "T", "same word here") for i in range(3000)]
    queries = [(q, "same word", "DIRECT", ["same"], [1.0, float(q)]) for q in range(20)]
    hits = _hits(spark, docs, queries, [(i, [1.0, float(i)]) for i in range(3000)], pool=5)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan
    made = spark.createDataFrame(docs, CONTENT).repartition(3).select("id", "text", "title", h.F.lit(1.0).alias("p"))
    told = spark.sparkContext.broadcast([(q, ["same", "word"], ["same"]) for q in range(20)])
    assert made.mapInArrow(h._word_lanes(told, 5), h.HITS).count() == 3 * 20 * 2 * 5
    assert hits.count() == 20 * 3 * 5


def test_routes_and_rescue(spark):
    docs = [(1, "BOOK", "T", "apples grow here"), (2, "BOOK", "T", "pears")]
    vecs = [(1, [1.0, 0.0]), (2, [0.0, 1.0])]
    queries = [(1, "apples", "DIRECT", ["apple"], [0.0, 1.0]), (2, "plums", "DIRECT", ["plum"], [0.0, 1.0]), (3, "Adâlet nedir?", "DIRECT", [], [1.0, 0.0])]
    hits = _hits(spark, docs, queries, vecs)
    rows = {(r.query_id, r.lane) for r in h.routed(hits, spark.createDataFrame(queries, QUERIES), 50).collect()}
    # a direct question leaves the vector lane shut unless no word is found; a question about a concept opens it
    assert rows == {(1, "exact"), (1, "lemma"), (2, "semantic"), (3, "semantic")}


@pytest.mark.parametrize("asked, tail", [("life", 3), ("what is life", 6)])
def test_tail_caps_by_word_hits(spark, asked, tail):
    n = len(asked.split())
    found = [(1, i, i, "exact", 100.0, "HIGHLIGHT", "t", "x" * 180, n) for i in range(1, 26)]
    found += [(1, 100 + i, 25 + i, "semantic", 70.0 - i, "HIGHLIGHT" if i % 2 else "BOOK", "t", "x" * 180, n) for i in range(1, 11)]
    found.append((1, 200, 40, "semantic", 69.5, "HIGHLIGHT", "deneme", "x" * 100, n))
    df = spark.createDataFrame(found, "query_id long, id long, pos int, lane string, score double, content_type string, title string, text string, n_words int")
    got = [r.id for r in h.with_tail(df, 6, True).orderBy("pos").collect()]
    # types of the head come first, the draft stays out
    assert got == [*range(1, 26), *[101, 103, 105, 107, 109, 102][:tail]]
    weak = df.withColumn("score", h.F.when(df.lane == "semantic", df.score - 50).otherwise(df.score))
    best = [r.id for r in h.with_tail(weak, 6, True).where("lane = 'semantic'").collect()]
    assert len(best) == tail and max(best) <= 110


def test_weights_and_empty_tables(spark):
    both = spark.createDataFrame([("DIRECT", "exact"), ("SOCIETAL", "semantic"), ("X", "lemma")], "intent string, lane string")
    assert [r.w for r in both.select(h.weight(both.intent, both.lane).alias("w")).collect()] == [0.55, 0.60, 0.33]
    none = spark.createDataFrame([], QUERIES)
    docs, vecs = spark.createDataFrame([(1, "BOOK", "t", "x")], CONTENT), spark.createDataFrame([(1, [1.0])], "id long, vec array<double>")
    assert h.hybrid_search(docs, vecs, none).collect() == []
