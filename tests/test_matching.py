"""Fuzzy titles, citations, histograms, word sets and weighted evidence against plain Python."""

import random

from pyspark.sql import functions as F

from stacklore.operators import citations as ci
from stacklore.operators import evidence as ev
from stacklore.operators import fuzzy as fz
from stacklore.operators import reports as rp
from stacklore.operators import similarity as sm


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b, 1):
            row[j] = old[j - 1] + 1 if x == y else max(old[j], row[j - 1])
    return row[-1]


def _partial(a, b):
    a, b = sorted((a, b), key=len)
    windows = {b[max(s, 0) : s + len(a)] for s in range(1 - len(a), len(b))} - {""}
    return max((200 * _lcs(a, w) / (len(a) + len(w)) for w in windows), default=0.0)


def test_best_window_of_letters():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choices("abcd e", k=rng.randint(1, 12))) for _ in range(2))
        if len(a) != len(b):
            assert abs(fz.partial_ratio(a, b) - _partial(a, b)) < 1e-9
    assert fz.partial_ratio("fundation", "the foundation series") > 88 and fz.partial_ratio("abc", "xxabcxx") == 100


def test_titles_against_all_pairs(spark):
    rng = random.Random(5)
    words = ["Foundation", "of", "the", "Empire", "Sea", "Dune", "Çöl", "Notes", "White-Whale", "II"]
    titles = [(i, " ".join(rng.sample(words, rng.randint(1, 4))) + rng.choice(["", " (pdf)", " - Ann Lee", " [Highlight]"])) for i in range(60)] + [(100, None), (101, "ab"), (102, "  ")]
    queries = [(1, "what says fundation of it"), (2, "the empire of the sea"), (3, "dune"), (4, "white whale"), (5, "col"), (6, ""), (7, None), (8, "empire and sea")]
    t, q = spark.createDataFrame(titles, "item_id long, title string"), spark.createDataFrame(queries, "query_id long, text string")
    forms = {r.item_id: r.f for r in t.select("item_id", fz.variants(t.title).alias("f")).collect()}
    plain = {r.query_id: r.f for r in q.select("query_id", fz.normalize_text(q.text).alias("f")).collect()}
    for least in (60, 75, 97):
        want = {}
        for i, _ in titles:
            for k, text in plain.items():
                best = 0
                for f in forms[i] if text else ():
                    long = [w for w in fz.WORD.findall(f) if len(w) >= 3]
                    full = int(fz.partial_ratio(f, text))
                    best = max(best, 100 if f in text else 97 if len(long) >= 2 and set(long) <= set(fz.WORD.findall(text)) else full if full >= least else 0)
                if best >= least:
                    want[k, i] = best
        assert {(r.query_id, r.item_id): r.score for r in fz.fuzzy_titles(t, q, least).collect()} == want and want
    assert any(k == 1 for k, _ in want) is False and fz.fuzzy_titles(t, q.limit(0)).collect() == []


def test_citations_are_held_against_their_sources(spark):
    text = "The old sea wall was built of grey stone by people of the coast long ago"
    sources = [(1, 1, "The Sea Wall", text), (1, 2, "Gardens", "Roses need sun and water every day of the summer"), (2, 1, "Şehir ve Deniz", text), (4, 1, "A", None)]
    answers = [
        (1, f"{text} [ID: 1]\n{text} [ID: 2]\nold sea wall was built [ID: 1]\nthe wall was made of grey rock [ID:1]\nbananas are yellow [ID: 7]"),
        (2, "They say the old sea wall was built of grey stone [Kaynak: sehir ve deniz]\nthe old sea wall was built of stone [Kaynak: Sehir ve Denizz]\nx [Kaynak: Zebra]"),
        (3, "Nothing is cited here."), (4, "some words that no one said at all [ID: 1]"), (5, None),
    ]
    got = {r.answer_id: r for r in ci.verified(spark.createDataFrame(answers, "answer_id long, answer string"), spark.createDataFrame(sources, "answer_id long, nth long, title string, content string")).collect()}
    # right; another source's words; five words only, all there; two words of seven are not; no such source
    assert (round(got[1].score, 4), got[1].violations) == (round((1 + 0 + 0.9 + 0.5 + 0) / 5, 4), ["fabricated_quote", "hallucination_risk", "wrong_source"])
    assert (round(got[2].score, 4), got[2].violations) == (round(2 / 3, 4), ["wrong_source"])
    assert (got[3].score, got[3].n_citations, got[3].violations) == (0.6, 0, ["no_citations_for_verification"]) and got[5].score == 0.6
    assert (got[4].score, got[4].violations) == (0.0, ["fabricated_quote"])


def test_merged_hours_are_the_day(spark):
    rng = random.Random(3)
    rows = [(h, rng.expovariate(1 / 400)) for h in range(24) for _ in range(rng.randrange(40))] + [(25, None), (26, 50.0), (26, 20_000.0)]
    df = spark.createDataFrame(rows, "hour int, ms double")
    day = rp.merged(rp.histogram(df, "ms", "hour"), F.lit(1)).first().counts
    assert day == rp.histogram(df, "ms").first().counts == [*(sum(v is not None and v <= b for _, v in rows) for b in rp.BOUNDS), sum(v is not None for _, v in rows)]
    for q in (0.1, 0.5, 0.95, 0.999, 1.0):
        rank, low, before = q * day[-1], 0.0, 0
        want = rp.BOUNDS[-1]
        for b, n in zip(rp.BOUNDS, day):
            if n >= rank:
                want = low + (b - low) * (rank - before) / (n - before)
                break
            low, before = b, n
        got = spark.range(1).select(rp.histogram_quantile(F.array(*map(F.lit, day)), q).alias("v")).first().v
        assert abs(got - want) < 1e-9
    by = {r.hour: r.v for r in rp.histogram(df, "ms", "hour").select("hour", rp.histogram_quantile(F.col("counts"), 0.5).alias("v")).collect()}
    assert by[25] is None and by[26] == 50.0


def test_word_sets_against_all_pairs(spark):
    rng = random.Random(7)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(12):
        own = rng.sample(base, rng.randint(3, 50))
        for _ in range(8):
            own = [w if rng.random() > 0.02 else rng.choice(base) for w in own]
            texts.append("every " + " ".join(rng.sample(own, len(own))))
    texts += ["every", "every", "", None, "Every EVERY", "x y", " ".join(base), " ".join(base[:57])]
    sets = [frozenset((t or "").lower().split()) for t in texts]
    for percent in (92, 60):
        want = []
        for i, s in enumerate(sets):
            twin = min((j for j, o in enumerate(sets) if o == s), default=i) if s else i
            others = {min(j for j, o in enumerate(sets) if o == t) for t in set(sets) if t != s and t and s and 100 * len(s & t) >= percent * len(s | t)}
            first = min(others, default=None)
            want.append((i, twin, first if first is not None and first < twin else None, len(others)))
        df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4)
        assert sorted(map(tuple, sm.alike(df, percent).collect())) == want
        assert any(n for *_, n in want)


def test_evidence_is_rescored_before_the_cut(spark):
    rows = [(1, i, i, 1.0 if i < 45 else 2.5, "B", "short", "BOOK", "DIRECT", None, None, 0) for i in range(1, 50)]
    rows += [(2, 1, 1, 0.0, "C", "t", "GRAPH_RELATION", "DIRECT", 1.0, None, 0), (2, 2, 2, 3.0, "A", "t", "BOOK", "DIRECT", None, None, 2), (2, 3, 3, 0.1, "C", "t", "EXTERNAL_KB", "DIRECT", None, 0.5, 0), (2, 4, 4, 0.5, "C", "x" * 301, "BOOK", "SOCIETAL", None, None, 0)]
    schema = "query_id long, id long, place long, score double, level string, text string, source_type string, intent string, graph_score double, external_weight double, depth int"
    got = {(r.query_id, r.id): r for r in ev.weighted_rank(spark.createDataFrame(rows, schema)).collect()}
    assert {i for q, i in got if q == 1} == {*range(1, 41), *range(45, 50)} and got[1, 45].rank == 1
    assert (got[2, 1].score, got[2, 1].level, got[2, 1].weight) == (3.5, "A", 4.2)
    assert got[2, 2].weight == round(3.0 * 0.88**2 * 1.2, 6) and got[2, 3].weight == round(1.3 * 0.3, 6) and got[2, 4].weight == 0.6
    hits = spark.createDataFrame([(1, 10, 1, 2.0), (1, 11, 2, 1.0)], "query_id long, id long, place long, score double")
    parents = spark.createDataFrame([(10, 20), (11, 20), (20, 30), (30, 40), (11, 10)], "child long, parent long")
    all_of = spark.createDataFrame([(i, f"t{i}") for i in (10, 11, 20, 30, 40)], "id long, text string")
    assert sorted((r.id, r.score, r.depth) for r in ev.with_parents(hits, parents, all_of).collect()) == [(10, 2.0, 0), (11, 1.0, 0), (20, 2.0, 1), (30, 2.0, 2)]


def test_unseen_concepts_through_cells_and_nulls(spark):
    """Every pair but the known ones, whatever the size of a cell, with null ids as SQL's EXCEPT has them; no pair is shuffled."""
    from stacklore.operators.graph import unseen_concepts

    linked = [(c, c * 3 + i) for c in range(50) for i in range(2)] + [(None, 7), (None, 500)]
    saw = [(f"u{t}", t * k) for t in range(30) for k in range(4)] + [(None, 3), ("u31", None), ("u32", 7)]
    links, seen = spark.createDataFrame(linked, "concept_id long, content_id long"), spark.createDataFrame(saw, "tenant string, content_id long")
    known = {(t, c) for t, x in saw for c, y in linked if x is not None and x == y}
    want = {(t, c) for t in {t for t, _ in saw} for c in {c for c, _ in linked}} - known
    for cell in (1, 7, 1000):
        got = [tuple(r) for r in unseen_concepts(links, seen, cell).collect()]
        assert len(got) == len(want) and set(got) == want
    plan = unseen_concepts(links, seen)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan


def test_vector_searches_against_all_pairs(spark):
    """Blocks of queries, ties, null vectors and vectors of another length, held against every pair in plain Python."""
    import math

    from stacklore.operators import vectors as v

    vec = lambda i: None if i % 23 == 5 else [float(i * 7 % 5 - 2), float(i * 3 % 4), 1.0][: 2 if i % 19 == 3 else 3]
    rows = [(i, vec(i), 0.4 + i % 7 / 10) for i in range(150)]
    corpus = spark.createDataFrame(rows, "id long, vec array<float>, w double").repartition(5)
    queries = corpus.where("id % 6 = 1")

    def sim(a, b):
        if a is None or b is None or len(a) != len(b):
            return None
        both = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / both if both else 0.0

    asked = [r for r in rows if r[0] % 6 == 1]
    pairs = {(q[0], r[0]): sim(q[1], r[1]) for q in asked for r in rows}
    told = lambda x: None if x is None else round(x, 6) + 0.0
    for block in (4, 1000):
        got = v.similar(queries, corpus, block_rows=block).collect()
        assert len(got) == len(pairs) and all(told(r.sim) == told(pairs[r.query_id, r.id]) and r.w == rows[r.id][2] for r in got)
        high = {(r.query_id, r.id) for r in v.similar(queries, corpus, 0.5, block).where("round(sim, 6) >= 0.5").collect()}
        assert high == {p for p, s in pairs.items() if s is not None and round(s, 6) >= 0.5}
        best = {r.id: told(r.sim) for r in v.most_similar(queries, corpus, block).collect()}
        assert best == {i: told(max((pairs[q[0], i] for q in asked if pairs[q[0], i] is not None), default=None)) for i, *_ in rows}
        near = {(r.query_id, r.nth): r.id for r in v.closest(queries, corpus, 10, block_rows=block).collect()}
        score = {(r.query_id, r.nth): (r.id, r.score) for r in v.closest(queries, corpus, 10, "w", block).collect()}
        for q, *_ in asked:
            order = sorted((pairs[q, i] is None, -(told(pairs[q, i]) or 0), i) for i, *_ in rows)[:10]
            assert [near[q, n] for n in range(1, 11)] == [i for *_, i in order]
            scored = sorted((-round(0.0 if pairs[q, i] is None else max(0.0, (1 - (1 - pairs[q, i]) / w) * 100), 4), i) for i, _, w in rows)[:10]
            assert [score[q, n][0] for n in range(1, 11)] == [i for _, i in scored]
            assert all(abs(score[q, n][1] + s) < 2e-4 for n, (s, _) in enumerate(scored, 1))
    assert v.closest(queries.where("id < 0"), corpus, 3).count() == v.most_similar(queries.where("id < 0"), corpus).count() == 0


def test_same_author_in_lists_and_parts(spark):
    """Every pair once, however the anchors of a title and the chunks of an author are dealt out."""
    from stacklore.operators.joins import same_author

    rows = [(i, None if i % 31 == 7 else f"T{i % 4} - {'' if i % 5 == 4 else 'A'}{i % 3}") for i in range(120)] + [(None, "T9 - A1"), (200, "alone")]
    chunks = spark.createDataFrame(rows, "id long, title string")
    author = lambda t: t.split(" - ")[-1]
    told = [r for r in rows if r[1] is not None]
    want = sorted(((a, i, author(t)) for a, t in told for i, u in told if author(t) == author(u) and t != u), key=str)
    for block, part in ((1, 1), (3, 7), (1000, 20000)):
        assert sorted(map(tuple, same_author(chunks, chunks, block, part).collect()), key=str) == want


def test_common_neighbours_shuffle_lists_not_pairs(spark):
    """Blocks of a destination, repeated rows and nulls, held against every pair; pairs are counted where they are made."""
    import re

    from stacklore.operators.joins import common_neighbours

    rows = [(s, d) for d in range(1, 9) for s in range(40) if s % d == 0] * 2 + [(None, 1), (3, None)]
    to = {}
    for s, d in rows:
        if s is not None and d is not None:
            to.setdefault(s, set()).add(d)
    want = {(a, b): len(to[a] & to[b]) for a in to for b in to if a < b and len(to[a] & to[b]) >= 2}
    r = spark.createDataFrame(rows, "src long, dst long")
    for block in (1, 7, 2000):
        got = common_neighbours(r, 2, block).collect()
        assert len(got) == len(want) and {(x.a, x.b): x.shared for x in got} == want
    plan = common_neighbours(r)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(a#" in plan and not re.search(r"hashpartitioning\(a#\w+, b#", plan)
