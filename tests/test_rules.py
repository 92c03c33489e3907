"""Rules on records: languages, ISBNs, scholarly kinds, comparisons."""

from pyspark.sql import functions as F

from stacklore.functions import text as t
from stacklore.operators import evidence as ev


def test_language_of_a_record(spark):
    rows = [
        ("tr", "en", None, "The theory of the state", None, "tr", 1.0, "mode_override_tr"), (" EN ", None, "Deniz Yayınları", None, None, "en", 1.0, "mode_override_en"),
        ("auto", "Türkçe", None, "The theory of the state", None, "tr", 0.8, "source_language_hint"), (None, "german", "Kıyı Kitabevi", "The history of the law", None, "tr", 0.9, "publisher_hint_tr"),
        (None, None, None, None, None, "tr", 0.1, "default_fallback_tr"), ("x", "", "Press", "xyz", "Q", "tr", 0.1, "default_fallback_tr"),
    ]
    df = spark.createDataFrame([(i, *r[:5]) for i, r in enumerate(rows)] + [(9, None, None, "Press", "The history of the law and the state", "Ann")], "id int, mode string, hint string, publisher string, title string, author string")
    got = {r.id: r.p for r in df.select("id", t.resolved_language(*(F.col(c) for c in ("mode", "hint", "publisher", "title", "author"))).alias("p")).collect()}
    for i, r in enumerate(rows):
        assert (got[i].language, got[i].confidence, got[i].reason) == r[5:], r
    assert (got[9].language, got[9].reason) == ("en", "metadata_signal") and 0.1 < got[9].confidence <= 1


def test_isbn_forms(spark):
    rows = [("0-306-40615-2", ["0306406152", "9780306406157"]), ("978-0-306-40615-7", ["0306406152", "9780306406157"]), ("080442957X", ["080442957X", "9780804429573"]), ("9791090636071", ["9791090636071"]), ("0306406153", []), (None, []), ("", [])]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(rows)], "id int, x string")
    got = {r.id: r.e for r in df.select("id", t.equivalent_isbns(df.x).alias("e")).collect()}
    assert [got[i] for i in range(len(rows))] == [e for _, e in rows]


def test_scholarly_kinds(spark):
    rows = [(["Science "], "BOOK", None, True), (["novel"], "article ", None, True), (None, None, "https://doi.org/10.1000/abc.", True), (["novel"], "BOOK", "https://a.org", False), (None, None, None, False)]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "id int, tags array<string>, kind string, url string")
    got = {r.id: r.a for r in df.select("id", t.academic(df.tags, df.kind, df.url, ("science",)).alias("a")).collect()}
    assert [got[i] for i in range(len(rows))] == [r[3] for r in rows]


def test_comparison_over_judged_endpoints(spark):
    frame = lambda *rows: spark.createDataFrame(rows, "endpoint string, quality double, p95 double")
    a = frame(("search", 0.5, 100.0), ("smart", 0.7, 300.0), ("chat", 9.0, 1.0))
    b = frame(("search", 0.6, 105.0), ("smart", 0.7, 330.0), ("chat", 0.0, 9.0))
    row = ev.recommended(a, b, "endpoint", ("search", "smart")).first()
    assert tuple(row) == (8.33, 8.75, True, True, True)
    assert tuple(ev.recommended(a, a, "endpoint", ("search", "smart")).first()) == (0.0, 0.0, False, True, False)
    assert tuple(ev.recommended(a, a, "endpoint", ("none",)).first())[:2] == (0.0, 0.0)


def test_quantiles_hold_when_rows_come_in_another_order(spark):
    """Limits of bands are computed more than once, so they must not follow the order in which rows arrive."""
    from pyspark.sql import functions as F

    from stacklore.operators.reports import quantiles

    n = 300000
    rows = spark.range(0, n, 1, 16).select((F.col("id") % 2).alias("k"), (F.col("id") * 7919 % n).cast("double").alias("v"))
    plan = quantiles(rows, "v", {"p50": 0.5}, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan
    for _ in range(3):
        got = {r.k: (r.p50, r.p95) for r in quantiles(rows.repartition(16), "v", {"p50": 0.5, "p95": 0.95}, "k").collect()}
        for k in (0, 1):
            vs = sorted(float(i * 7919 % n) for i in range(k, n, 2))
            at = 0.95 * (len(vs) - 1)
            low = int(at)
            assert got[k][0] == (vs[len(vs) // 2 - 1] + vs[len(vs) // 2]) / 2
            assert abs(got[k][1] - (vs[low] + (vs[low + 1] - vs[low]) * (at - low))) < 1e-6
    one = quantiles(rows, "v", {"p50": 0.5}).collect()
    assert [r.p50 for r in one] == [(n - 1) / 2]


def test_ten_digits_come_first_though_they_begin_with_978(spark):
    rows = ["9789864256", "9789789864256", "978994344X", "0-306-40615-2"]
    got = {r.x: r.e for r in spark.createDataFrame([(x,) for x in rows], "x string").select("x", t.equivalent_isbns(F.col("x")).alias("e")).collect()}
    assert got[rows[0]] == got[rows[1]] == ["9789864256", "9789789864256"]
    assert got[rows[2]] == ["978994344X", "9789789943449"] and got[rows[3]] == ["0306406152", "9780306406157"]


def test_language_scores_split_a_text_once(spark):
    """What a text is told by is worked out once, and comes to what plain Python counts."""
    import re

    from stacklore.functions.text import EN_STOP, EN_TAGS, TR_PUBLISHERS, TR_STOP

    texts = ["The state of the nation and its movement", " \t\nBir kitap ve çok güzel bir eser\x0b\r\n", "Deniz YAYINLARI için", "İzmir'de ışık ve su", "history of friendship, the darkness", "", " \n", "x" * 50, None, "12 34", "KITAP kitabevi the the the"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, x string")
    got = {r.id: r.s for r in frame.select("id", t.language_scores(F.col("x")).alias("s")).collect()}
    for i, x in enumerate(texts):
        v = (x or "").strip(" \t\n\x0b\f\r")
        words = [w for w in re.sub("[^a-zA-ZçğıöşüÇĞİÖŞÜ']+", " ", v).lower().split(" ") if w]
        n = max(len(words), 1)
        tr = len(re.findall("[çğıöşüÇĞİÖŞÜ]", v)) / max(len(v), 1) * 3.0 + sum(w in TR_STOP for w in words) / n * 1.3 + (0.8 if any(p in v.lower() for p in TR_PUBLISHERS) else 0.0)
        en = sum(w in EN_STOP for w in words) / n * 1.5 + sum(w in EN_TAGS for w in words) / n * 1.1 + 0.25 * sum(w.endswith(("tion", "ment", "ness", "ship")) for w in words)
        top, gap = max(tr, en), abs(tr - en)
        sure = top >= 0.25 and gap >= 0.12
        assert got[i].language == (("tr" if tr > en else "en") if sure else None), x
        assert abs(got[i].tr - tr) < 1e-4 and abs(got[i].en - en) < 1e-4 and abs(got[i].confidence - (min(gap / max(top, 0.25), 1.0) if sure else 0.0)) < 1e-4
    plan = frame.select(t.language_scores(F.col("x"))["language"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 2
