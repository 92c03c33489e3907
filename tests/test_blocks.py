"""Blocks to paragraphs and chunks: small cases by hand, and packing against plain Python."""

import random

from stacklore.operators import blocks as bl
from stacklore.operators import documents as dc

BLOCKS = "doc long, page long, nth long, kind string, text string, confidence double, heading_path array<string>"


def _long(s):
    return s + " and these further words make of it a whole line of text that says enough to stand"


def _paras(spark, rows):
    # pages past the front matter
    df = spark.createDataFrame([(1, r[0] + 20, *r[1:], *((None,) * (6 - len(r)))) for r in rows], BLOCKS).repartition(3)
    return bl.paragraphs(df).orderBy("section", "para").collect()


def test_paragraphs_across_pages_headings_and_gaps(spark):
    rows = [
        (1, 1, "heading", "The Sea", 0.9), (1, 2, "body", _long("The first line goes on"), 0.8), (1, 3, "body", "With a line that ends here.", 0.6),
        (1, 4, "body", "Here a word is bro-", 1.0), (2, 1, "body", "ken over the page without any end", None), (2, 2, "body", "Then more on page two.", 1.0),
        (3, 1, "body", _long("This one is open"), 1.0), (4, 1, "body", "Capital, so it starts anew.", 1.0), (4, 2, "body", _long("Open once more"), 1.0), (6, 1, "body", "small, but a page is missing.", 1.0),
        (6, 2, "table", "| a | b |", 1.0), (6, 3, "heading", "The Shore", 1.0), (6, 4, "body", "A line under the shore, and it is long enough to be read.", 1.0),
        (7, 1, "heading", "Part Two", 1.0, ["Book", "Part Two"]), (7, 2, "body", "Another line under the part, and it is long enough to be read.", 1.0), (7, 3, "heading", "Sand", 1.0), (7, 4, "heading", "Sand", 1.0),
        (7, 5, "body", "The last of all lines, and it is long enough to be read.", 1.0), (7, 6, "body", "Its own path, and it is long enough to be read too.", 1.0, ["Own"]),
    ]
    got = _paras(spark, rows)
    told = [(r.section, r.kind, r.text, r.page - 20, r.page_end - 20, r.confidence, r.origin, r.n_blocks, list(r.path)) for r in got]
    sea, shore, two = ["The Sea"], ["The Sea", "The Shore"], ["Book", "Part Two"]
    first = _long("The first line goes on") + " With a line that ends here."
    assert told == [
        (1, "heading", "The Sea", 1, 1, 0.9, None, 1, sea), (1, "body", first, 1, 1, 0.6, "same_page", 2, sea),
        # on page two the paragraph of page one goes on only with a small letter or such a word
        (1, "body", "Here a word is broken over the page without any end", 1, 2, 1.0, "hyphen", 2, sea), (1, "body", "Then more on page two.", 2, 2, 1.0, None, 1, sea),
        (1, "body", _long("This one is open"), 3, 3, 1.0, None, 1, sea), (1, "body", "Capital, so it starts anew.", 4, 4, 1.0, None, 1, sea), (1, "body", _long("Open once more"), 4, 4, 1.0, None, 1, sea),
        (1, "body", "small, but a page is missing.", 6, 6, 1.0, None, 1, sea), (1, "table", "| a | b |", 6, 6, 1.0, None, 1, sea),
        (2, "heading", "The Shore", 6, 6, 1.0, None, 1, shore), (2, "body", rows[12][3], 6, 6, 1.0, None, 1, shore),
        (3, "heading", "Part Two", 7, 7, 1.0, None, 1, two), (3, "body", rows[14][3], 7, 7, 1.0, None, 1, two), (4, "heading", "Sand", 7, 7, 1.0, None, 1, [*two, "Sand"]),
        (5, "heading", "Sand", 7, 7, 1.0, None, 1, [*two, "Sand"]), (5, "body", rows[17][3], 7, 7, 1.0, None, 1, [*two, "Sand"]), (5, "body", rows[18][3], 7, 7, 1.0, None, 1, ["Own"]),
    ]


def test_margins_and_no_body_go(spark):
    body = lambda p: (p, 5, "body", f"Page number {'xyz'[p % 3]} has a line of its own that is quite long enough to read, and it ends.", 1.0)
    rows = [x for p in range(1, 6) for x in ((p, 1, "body", f"Old Title {p}", 1.0), (p, 2, "body", "Some other opening words that differ by " + "abcdefgh"[p] * 9 + ", and they end.", 1.0), body(p), (p, 9, "body", f"page {p}", 1.0))]
    rows.append((5, 6, "body", "Alden, K. (1974) Rivers. Oxford: Harrow. Alden, K. (1981) Salt. Leeds: Fenn. Alden, K. (1983) Tin.", 1.0))
    rows += [(5, 7, "body", "   ", 1.0), (5, 8, "body", None, 1.0)]
    texts = " ".join(r.text for r in _paras(spark, rows))
    assert "Old Title" not in texts and "page 3" not in texts and "Alden" not in texts and texts.count("line of its own") == 5


def _random_paras(spark, seed, long=0):
    rng = random.Random(seed)
    rows = []
    for doc in range(4):
        para = 0
        for section in range(5):
            kinds = ["heading", *(rng.choice(["body"] * 6 + ["table"]) for _ in range(rng.randrange(12)))]
            for k in kinds:
                n = rng.choice([3, 40, 120, 300, 400]) + long * (rng.random() < 0.2)
                text = " ".join(f"w{doc}.{para}.{i}" + ("." if rng.random() < 0.1 else "") for i in range(n))
                rows.append((doc, section, para, k, text, para // 3 + 1, para // 3 + 1, 1.0, None, 1, ["H", str(section)]))
                para += 1
    return rows, spark.createDataFrame(rows, bl.PARAGRAPH).repartition(5)


def test_section_chunks_against_plain_python(spark):
    rows, df = _random_paras(spark, 3)
    want = []
    for key in sorted({r[:2] for r in rows}):
        own, held, n = [r for r in rows if r[:2] == key], [], 0
        chunks = []
        for r in own:
            size = len(r[4].split())
            if held and (r[3] != "body" or n + size > bl.CAP_WORDS):
                chunks.append(held)
                held, n = [], 0
            if r[3] == "heading":
                continue
            held, n = [*held, r], n + size
            if r[3] == "table" or n >= bl.TARGET_WORDS:
                chunks.append(held)
                held, n = [], 0
        chunks += [held] * bool(held)
        want += [(*key, i, "\n\n".join(r[4] for r in c), c[0][5], c[-1][6], f"H > {key[1]}", sum(len(r[4].split()) for r in c)) for i, c in enumerate(chunks)]
    got = sorted((r.doc, r.section, r.chunk, r.text, r.page, r.page_end, r.prefix, r.words) for r in bl.section_chunks(df).collect())
    assert got == sorted(want)


def test_sentence_chunks_keep_words_pages_and_caps(spark):
    rows, df = _random_paras(spark, 5, long=900)
    chunks = {}
    for r in bl.sentence_chunks(df).collect():
        chunks.setdefault((r.doc, r.section), []).append(r)
    page_of = {w: r[5] for r in rows for w in r[4].split()}
    for key in {r[:2] for r in rows}:
        own = sorted(chunks.get(key, []), key=lambda r: r.chunk)
        assert [r.chunk for r in own] == list(range(len(own)))
        told = []
        for r in own:
            words = r.text.split()
            assert len(words) == r.words <= 450 and (r.page, r.page_end) == (page_of[words[0]], page_of[words[-1]]) and r.prefix == f"H > {key[1]}"
            assert not told or told[-20:] == words[:20]
            told += words[20:] if told else words
        assert told == [w for r in rows if r[:2] == key and r[3] != "heading" for w in r[4].split()]


def test_integrity_caps(spark):
    rows = [
        (["broken_start", "broken_end"], 0.9, 0.2, "QUARANTINE"), (["broken_end"], 0.8, 0.45, "REVIEW"), (["broken_start"], 0.3, 0.3, "QUARANTINE"), (["bibliography_like"], 0.4, 0.0, "QUARANTINE"),
        (["toc_like"], 1.0, 0.0, "QUARANTINE"), (["page_artifact"], 1.0, 0.0, "QUARANTINE"), (["short_fragment", "ocr_noise"], 0.7, 0.2, "QUARANTINE"), (["short_fragment"], 0.65, 0.65, "EMBED"), ([], 1.0, 1.0, "EMBED"),
    ]
    df = spark.createDataFrame([(i, "some text", f, s) for i, (f, s, *_) in enumerate(rows)] + [(99, " ", [], 1.0)], "id long, text string, flags array<string>, score double")
    got = {r.id: (r.integrity, r.decision) for r in dc.integrity(df).collect()}
    assert got == {i: r[2:] for i, r in enumerate(rows)} | {99: (0.0, "QUARANTINE")}


def test_noise_points_and_reasons(spark):
    rows = [
        ("Plain words here.", "", "", 0, []), ("ISBN: 978-3-16-148410-0 a", "", "", 3 + 1 + 2, ["isbn"]), ("see www.a.org and https://b.org/x for it all and the rest", "", "", 4 + 1, ["url"]),
        ("page 3\nbody of text\n12\n", "", "", 4, ["page_artifact"]), ("The Index of the bibliography", "", "", 6, ["biblio_marker"]), ("The Sea and the sea and THE SEA", "The Sea", "Ann", 4, ["title_repeat"]),
        ("abc\nabc\nabc\nxyz\nxyz\nq\nq", "", "", 4, ["repeated_short_lines"]), ("LOUD " * 30, "", "", 1, []), (None, None, None, 0, []),
    ]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "id long, text string, title string, author string")
    got = {r.id: (r.n.score, list(r.n.reasons)) for r in df.select("id", dc.noise(df.text, df.title, df.author).alias("n")).collect()}
    assert got == {i: (r[3], r[4]) for i, r in enumerate(rows)}


def test_what_is_in_the_library(spark):
    from stacklore.operators.evidence import coverage

    asked = spark.createDataFrame([(1, ["sea", "shore"]), (2, ["sea", "shore"]), (3, ["sea", "shore", "sand", "wind", "rain"]), (4, ["x"]), (5, ["sea", "fish"]), (6, ["sea", "fish"])], "query_id long, keywords array<string>")
    pool = [(1, 1, 5.0, "by the Sea", False), (2, 2, 3.5, "by the sea", False), (3, 3, 1.0, "sea shore sand", False), (3, 4, 1.0, "wind", False), (5, 5, 1.0, "sea", True), (6, 6, 1.9, "sea", False)]
    pool += [(1, 10 + i, 5.0, "shoreless", False) for i in range(6)]
    got = {r.query_id: (r.status, round(r.coverage, 2), r.missing) for r in coverage(asked, spark.createDataFrame(pool, "query_id long, id long, score double, text string, primary boolean")).collect()}
    assert got == {1: ("IN_NETWORK", 1.0, []), 2: ("HYBRID", 0.5, ["shore"]), 3: ("IN_NETWORK", 0.8, ["rain"]), 4: ("OUT_OF_NETWORK", 0.0, ["x"]), 5: ("IN_NETWORK", 0.5, ["fish"]), 6: ("OUT_OF_NETWORK", 0.5, ["fish"])}


def test_rows_of_a_key_stay_together_after_a_join_by_it(spark):
    from pyspark.sql import functions as F

    from stacklore.operators.blocks import streamed

    def counted(rows):
        own = list(rows)
        yield own[0].k, len(own)

    left = spark.range(0, 400000, 1, 8).select((F.col("id") % 100).alias("k"), F.xxhash64("id").alias("v"))
    few = spark.range(5000000).where("pmod(xxhash64(id), 5000000) < 10").select(F.col("id").alias("k"), F.lit(1).alias("x"))  # turns out small only while it runs
    got = streamed(left.join(few, "k", "left"), ["k"], ["v"], counted, "k long, n long").collect()
    assert sorted(map(tuple, got)) == [(k, 4000) for k in range(100)]
