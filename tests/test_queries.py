"""Every registered library query against its SQL, and a few whose rules SQL lacks."""

import pytest

from compare import same
from stacklore import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, data, duck, name):
    same(QUERIES[name](spark, data), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1


def test_mmr_by_relevance_alone_keeps_the_order(spark):
    from stacklore.operators.retrieval import mmr

    rows = [(1, i, float(10 - i), ["a", "b", str(i)]) for i in range(6)]
    got = mmr(spark.createDataFrame(rows, "query_id long, id long, score double, terms array<string>"), 6, 1.0).orderBy("pos").collect()
    assert [r.id for r in got] == list(range(6))


def test_suppression_drops_equal_word_sets(spark):
    from stacklore.operators.repair import suppress_similar

    rows = [(1, 1, 1, ["a", "b"]), (1, 2, 2, ["b", "a"]), (1, 3, 3, ["c"])]
    got = suppress_similar(spark.createDataFrame(rows, "query_id long, id long, rank int, words array<string>")).collect()
    assert sorted(r.id for r in got) == [1, 3]


def test_word_budget_chunks_lose_no_word(spark):
    from stacklore.operators.documents import word_budget_chunks

    rows = [(1, p, " ".join(f"w{p}_{i}" for i in range(n))) for p, n in enumerate((3, 500, 0, 40, 360))]
    got = word_budget_chunks(spark.createDataFrame(rows, "doc long, para long, text string")).orderBy("chunk").collect()
    assert " ".join(r.text for r in got).split() == " ".join(t for *_, t in rows).split()
    assert max(r.words for r in got) <= 450


def test_upsert_twice_is_once(spark):
    from stacklore.sources.sinks import upsert

    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, None)], "k long, v string")
    once = upsert(old, new, ["k"])
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, upsert(once, new, ["k"]).collect()), key=str) == [(1, "a"), (2, "c"), (3, None)]


def test_rebuild_loads_each_partition_once(spark, tmp_path):
    from stacklore.sources.sinks import rebuild

    parts = spark.createDataFrame([("a", 1), ("b", 2)], "part string, v long")
    assert rebuild(spark, parts.where("part = 'a'"), "part", str(tmp_path), "1") == 1
    assert rebuild(spark, parts, "part", str(tmp_path), "1") == 1
    assert rebuild(spark, parts, "part", str(tmp_path), "1") == 0
    assert spark.read.parquet(f"{tmp_path}/version=1").count() == 2


def test_exports_split_valid_from_quarantined(spark, tmp_path):
    from stacklore.sources.readers import read_exports

    (tmp_path / "x.json").write_text('{"book_id": "1", "title": "T", "tags": ["a"]}\n{"book_id": " ", "title": "T"}\n{"book_id": "2"}\nnot json\n')
    good, bad = read_exports(spark, str(tmp_path))
    assert good.count() == 1
    assert sorted(r.reason for r in bad.select("reason").collect()) == ["no_id", "no_title", "not_json"]


def test_collections_and_parser_pages(spark, tmp_path):
    import json

    from stacklore.sources.readers import read_collection, read_parser_pages

    (tmp_path / "c").mkdir()
    (tmp_path / "p").mkdir()
    row = {"hadithnumber": 1, "text": "x", "grades": [{"name": "n", "grade": "g"}], "reference": {"book": 2}}
    (tmp_path / "c/a.json").write_text(json.dumps({"metadata": {"name": "m", "sections": {"2": "two"}}, "hadiths": [row, row, row | {"hadithnumber": 2, "text": " "}]}))
    got = read_collection(spark, str(tmp_path / "c")).collect()
    assert [(r.id, r.chapter, r.grades, r.text) for r in got] == [("m:1", "two", "n: g", "x")]
    (tmp_path / "p/a.json").write_text(json.dumps({"pages": [{"page": 1, "text": "a"}]}))
    (tmp_path / "p/b.json").write_text(json.dumps({"result": {"pages": [{"page": 1, "text": "b"}, {"page": 2, "text": "c"}]}}))
    assert sorted(r.text for r in read_parser_pages(spark, str(tmp_path / "p")).collect()) == ["a", "b", "c"]


def test_turkish_rules(spark):
    from pyspark.sql import functions as F

    from stacklore.functions import text as t

    df = spark.createDataFrame([("İSTANBUL'da  IŞIK, çok güzel!",), (None,)], "s string")
    got = df.select(t.normalize_text(F.col("s")).alias("n"), t.normalize_canonical(F.col("s")).alias("c")).collect()
    assert got[0].n == "istanbulda isik cok guzel" and got[0].c == "istanbulda ışık çok güzel" and got[1].n == ""
    kinds = spark.createDataFrame([("bu bir kitap ve çok güzel",), ("the state of the nation",), ("xyz",)], "s string")
    assert [r.l for r in kinds.select(t.language_scores(F.col("s"))["language"].alias("l")).collect()] == ["tr", "en", None]


@pytest.mark.parametrize("name", ["joi06_either_end", "joi08_neighbours", "joi12_title_mismatches", "joi17_evidence_match"])
def test_no_cartesian_product(spark, data, name):
    plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_type_cap_loses_no_row(spark, data):
    from stacklore.operators.repair import type_cap
    from stacklore.sources.views import logs

    def placed(rows, head, most):
        count, first, rest = {}, [], []
        for i, k in rows:
            if len(first) < head and count.get(k, 0) >= most:
                rest.append(i)
            else:
                first.append(i)
                count[k] = count.get(k, 0) + 1
        return first + rest

    rows = [(q, i, i, "ab"[i % 2] if i < 60 or q == "y" else "cdef"[i % 4]) for q in ("x", "y") for i in range(1, 90)]
    got = type_cap(spark.createDataFrame(rows, "query_id string, id long, rank int, kind string"), 10, 3).collect()
    for q in ("x", "y"):
        own = [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.pos)]
        assert own == placed([(i, k) for g, i, _, k in rows if g == q], 10, 3)
    assert QUERIES["win05_type_cap"](spark, data).count() == logs(spark, data).count()


def test_chunk_quality_cases(spark):
    from stacklore.operators.documents import chunk_quality

    rows = [
        ("Alden, K. (1974) Rivers and Roads. Oxford: Harrow. Alden, K. (1981) Salt. Leeds: Fenn. Alden, K. (1983) Tin.", "", None, "bibliography_like"),
        ("yarim kalmis bir sayfanin devami olan bu satir kucuk harfle baslar ve nokta ile sona erer.", "", None, "broken_start"),
        ("İÇİNDEKİLER\n1. Deniz ........ 3\n2. Kıyı ........ 21\n3. Liman ........ 58", "", None, "toc_like"),
        ("SUNUŞ", "", 4, "front_matter_like"),
        ("dıkları günden beri köyün yolu hep aynı yerden geçer, çünkü dere her bahar taşar ve köprüyü götürür", "", 5, "orphan_fragment"),
        ("4- Ayşe Deniz / Kıyıda Bir Yaz 5- Mehmet Orman / Dağ Yolları", "", 5, "catalog_like"),
        ("ve sonra gelen satir onceki sayfadan kalan sozun devami olur", "", 10, "broken_start"),
        ("What? is a book (with signs) and What? (with signs) here", "What? (with signs", 90, None),
        ("He said What? (it) and then What? (it) once more.", "What? (it", 90, "title_repeat"),
        (None, None, None, "short_fragment"),
    ]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "id long, text string, title string, page_number long")
    got = {r.id: r for r in chunk_quality(df).collect()}
    for i, r in enumerate(rows):
        assert r[3] is None or r[3] in got[i].flags, r
    assert all(got[i].skip for i in (0, 2, 3, 4, 5, 9)) and "title_repeat" not in got[7].flags


def _alike(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b, 1):
            row[j] = old[j - 1] + 1 if x == y else max(old[j], row[j - 1])
    return 200 * row[-1] / (len(a) + len(b))


def test_closest_words_miss_no_pair(spark):
    import random

    from stacklore.operators.spelling import closest_words

    rng = random.Random(4)
    made = lambda n: "".join(rng.choices("abcde", k=n))
    known = sorted({made(rng.randint(2, 14)) for _ in range(300)})
    asked = {made(rng.randint(1, 14)) for _ in range(200)}
    for w in rng.sample(known, 150):
        x = list(w)
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(x) + 1)
            x[at : at + rng.randint(0, 1)] = rng.choices("abcde", k=rng.randint(0, 1))
        asked.add("".join(x))
    asked = sorted(asked - set(known) - {""}) + ["x" * 70]
    got = closest_words(spark.createDataFrame([(w,) for w in asked], "word string"), spark.createDataFrame([(w,) for w in known], "fix string"))
    want = {}
    for w in asked:
        best = max(((_alike(w, k), [-ord(c) for c in k] + [0], k) for k in known), default=None)
        if 3 <= len(w) <= 62 and best[0] > 80:
            want[w] = min((k for k in known if _alike(w, k) == best[0]))
    assert {r.word: r.fix for r in got.collect()} == want and len(want) > 100


def test_typo_rescue_asks_only_weak_queries_again(spark):
    from stacklore.operators.retrieval import term_hits
    from stacklore.operators.spelling import typo_rescue

    docs = spark.createDataFrame([(i, "yonetim notu") for i in range(1, 6)] + [(9, "hayatta")], "id long, text string")
    queries = spark.createDataFrame([(1, "yonetm"), (2, "notu"), (3, "qqqq")], "query_id long, text string")
    known = spark.createDataFrame([("yonetim",), ("notu",), ("not",)], "fix string")
    got = sorted(map(tuple, typo_rescue(queries, lambda q: term_hits(docs, q), known, limit=3).collect()))
    assert got == [(1, i, True) for i in (1, 2, 3)] + [(2, i, False) for i in (1, 2, 3, 4, 5)]


def test_provider_results_rank_by_isbn_or_likeness(spark):
    from difflib import SequenceMatcher

    from stacklore.operators.providers import first_of_each, ranked

    rows = [
        (1, "google-books", 0, "Şehir ve Köy", "A. Yazar", []), (1, "open-library", 1, "sehir ve koy ", "a. yazar", []), (1, "open-library", 2, "Other", "B", ["2", "1"]),
        (1, "open-library-bib", 3, "Else", "C", ["1", None, "2"]), (1, "open-library", 4, " ", None, None), (2, "open-library", 5, "X", "Y", ["9"]), (2, "open-library-bib", 6, "Z", "W", ["8"]),
    ]
    got = first_of_each(spark.createDataFrame(rows, "query_id long, provider string, nth long, title string, author string, isbns array<string>"))
    assert sorted((r.query_id, r.key, r.nth) for r in got.collect()) == [(1, "1,2", 2), (1, "sehir ve koy|a. yazar", 0), (2, "8", 6), (2, "9", 5)]
    queries = spark.createDataFrame([(1, "Sehir ve", []), (2, "9", ["9"])], "query_id long, text string, isbns array<string>")
    order = {(r.query_id, r.nth): (r.position, r.score) for r in ranked(got, queries).collect()}
    like = lambda a, b: SequenceMatcher(None, a, b).ratio()
    want = 0.58 * like("sehir ve", "sehir ve koy") + 0.22 * like("sehir ve", "a. yazar") + 0.20 + 0.04
    assert order[1, 0] == (1, round(want, 6)) and order[1, 2][0] == 2 and order[2, 5] == (1, 1.08) and order[2, 6] == (2, 0.12)


def test_hashed_vectors_agree_with_the_query(spark, data):
    from stacklore.functions.udfs import hashed_vector

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in QUERIES["udf01_embedding"](spark, data).collect():
        v = hashed_vector(docs[r.doc_id])
        assert abs(r.first - v[0]) < 1e-6 and abs(r.last - v[63]) < 1e-6


def test_a_rebuild_that_broke_off_loads_no_row_twice(spark, tmp_path):
    import shutil

    from stacklore.sources.sinks import read_current, rebuild

    parts = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "part string, v long")
    assert rebuild(spark, parts, "part", str(tmp_path), "1") == 2
    shutil.rmtree(tmp_path / "done")  # as if the run had ended before it noted what it did
    assert rebuild(spark, parts, "part", str(tmp_path), "1") == 2
    assert sorted(r.v for r in read_current(spark, str(tmp_path)).collect()) == [1, 2, 3]
    assert rebuild(spark, parts.where("part = 'a'"), "part", str(tmp_path), "2") == 1
    assert [r.v for r in read_current(spark, str(tmp_path)).collect()] == [1]


def test_runs_of_keys_across_chunks(spark):
    from pyspark.sql import functions as F

    from stacklore.operators.answering import without_repeats

    keys = "aabbbacccaab"
    df = spark.createDataFrame([("q", i, k) for i, k in enumerate(keys)] + [("p", 100, "a")], "query_id string, id long, key string")
    want = [i for i, k in enumerate(keys) if i == 0 or keys[i - 1] != k] + [100]
    for size in (1, 2, 5, 50):
        assert sorted(r.id for r in without_repeats(df, ["id"], F.floor(F.col("id") / size)).collect()) == want


def test_sentence_chunks_lose_no_word(spark, data):
    docs = {r.doc_id: (r.text or "").split() for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    chunks = {}
    for r in QUERIES["doc05_sentence_chunks"](spark, data).collect():
        chunks.setdefault(r.doc, []).append((r.chunk, r.text.split(), r.words))
    for doc, words in docs.items():
        own = sorted(chunks.get(doc, []))
        assert [c for c, *_ in own] == list(range(len(own))) and all(len(w) == n <= 450 for _, w, n in own)
        told = [w for c, ws, _ in own for w in (ws[20:] if c else ws)]
        assert told == words


def test_ingestion_decides_on_the_text_of_pages(spark, tmp_path):
    good = "<p>The first of these thoughts is stated at some length, so that it reads as a whole sentence and ends as one.</p>"
    rows = [(1, "u1", good), (2, "u2", "<script>x()</script><p>ve bu cumle ortadan baslar ve bitmeden biter gibi gorunur cunku sonunda nokta yok iste</p>"), (3, "u3", "<p>page 12</p>"), (4, "u4", "<div></div>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.id: r for r in QUERIES["doc12_ingestion_pipeline"](spark, str(tmp_path)).collect()}
    assert got[1].decision == "EMBED" and got[1].reasons == "" and {got[i].decision for i in (2, 3, 4)} == {"REJECT"}
    assert "broken_start" in got[2].reasons and "page_artifact" in got[3].reasons


def test_exact_quantiles_of_skewed_values(spark):
    import random

    import numpy as np

    from stacklore.operators.reports import quantiles

    rng = random.Random(8)
    rows = [("a", float(rng.choice([1, 1, 1, 2, 1000]))) for _ in range(500)] + [("b", rng.expovariate(1)) for _ in range(777)] + [("c", 5.0), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.k: r for r in quantiles(df, "v", shares, "k").collect()}
    for k in "abc":
        own = [v for x, v in rows if x == k]
        assert all(abs(got[k][n] - np.quantile(own, q)) < 1e-9 for n, q in shares.items())
    assert "d" not in got
    own = [v for _, v in rows if v is not None]
    assert all(abs(quantiles(df, "v", shares).first()[n] - np.quantile(own, q)) < 1e-9 for n, q in shares.items())


def test_hubs_in_blocks_give_the_same_pairs(spark):
    from stacklore.operators.joins import common_neighbours, title_mismatches

    edges = spark.createDataFrame([(s, d) for s in range(40) for d in range(6) if (s * 7 + d) % 3], "src long, dst long")
    whole, cut = (sorted(map(tuple, common_neighbours(edges, 2, n).collect())) for n in (1000, 3))
    assert whole == cut and len(whole) > 100
    items = spark.createDataFrame([("t", "1", "The Republic"), ("t", "2", "Plato: The Republic"), ("t", "3", "the republic"), ("t", "4", "Art"), ("t", "5", "Cartography"), ("u", "6", "Art"), ("t", "7", "X")], "tenant string, item_id string, title string")
    assert sorted((r.item_a, r.item_b) for r in title_mismatches(items).collect()) == [("1", "2"), ("1", "3"), ("2", "3"), ("4", "5")]
