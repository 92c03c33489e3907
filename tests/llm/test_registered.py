"""The registered queries' own columns against plain Python, and the pipeline over a table with every odd case."""

import hashlib
import random
import zlib

import pytest

from stacklore.llm import queries

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def table(spark, data):
    return {r.doc_id: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}


def _remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_language_query(spark, data, table):
    got = {r.doc_id: r for r in queries.op3_language_id(spark, data).collect()}
    assert set(got) == set(table)
    assert all(r.held_out == (_remainder(i, 4) == 2) and 0 <= r.score <= 1 for i, r in got.items())
    # a learned value, or und exactly where there is no letter
    known = {r.lang for i, r in table.items() if r.lang and _remainder(i, 4) != 2}
    assert all(got[i].lang_pred in (known if any(map(str.isalpha, r.text or "")) else {"und"}) for i, r in table.items())
    held = [(got[i].lang_pred, r.lang) for i, r in table.items() if got[i].held_out and r.lang and len(r.text or "") > 30]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def test_personal_data_query(spark, data, table):
    from test_operators import _brute_pii

    got = {r.doc_id: r for r in queries.op4_personal_data(spark, data).collect()}
    assert set(got) == set(table)
    for i, r in table.items():
        base = [f"{k}:{a}:{b}" for k, a, b in _brute_pii(r.text or "")]
        assert got[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        spans = [s for s in got[i].spans.split(",") if s]
        assert set(base) <= set(spans) and got[i].n_email == sum(s.startswith("email") for s in base)
        order = [(("email", "ip", "card", "phone").index(s.split(":")[0]), int(s.split(":")[1])) for s in spans]
        assert order == sorted(order) and all(0 <= int(s.split(":")[1]) < int(s.split(":")[2]) <= len(r.text) for s in spans)


def test_toxicity_query(spark, data, table):
    got = {r.doc_id: r for r in queries.op5_toxicity(spark, data).collect()}
    assert set(got) == set(table)
    assert all(r.held_out == (_remainder(i, 3) == 1) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for i, r in got.items())


def test_quality_query(spark, data, table):
    import collections
    import math
    import re

    word = re.compile(r"[^\x20\x09-\x0D]+")

    def kinds(text):
        out = [0] * 10
        for c in text:
            at = 0
            if ord(c) > 127:
                at = 9
            elif c in " \t\n\x0b\x0c\r":
                at = 1
            elif c in "#*$%&|<>":
                at = 2
            elif c.islower():
                at = 3
            elif c.isupper():
                at = 4
            elif c.isdigit():
                at = 5
            elif c in ".":
                at = 6
            elif c in ",;:":
                at = 7
            elif c in "!?":
                at = 8
            out[at] += 1
        return out

    def distance(p, q):
        p, q = ([x / (sum(v) or 1) for x in v] for v in (p, q))
        half = lambda a, b: sum(x * math.log2(x / ((x + y) / 2)) for x, y in zip(a, b) if x)
        return math.sqrt(min(max((half(p, q) + half(q, p)) / 2, 0), 1))

    chars, words = {}, {}
    for r in table.values():
        if r.lang is not None:
            old = chars.setdefault(r.lang, [0] * 10)
            chars[r.lang] = [a + b for a, b in zip(old, kinds(r.text or ""))]
            words.setdefault(r.lang, collections.Counter()).update(word.findall((r.text or "").lower()))
    refs = {}
    for lang, c in words.items():
        most = sorted(c.items(), key=lambda x: (-x[1], x[0]))[:40]
        refs[lang] = ([w for w, _ in most], [n for _, n in most] + [sum(c.values()) - sum(n for _, n in most)])

    def far(r):
        own, w = kinds(r.text), word.findall(r.text.lower())
        out = []
        for lang in [r.lang] if r.lang in refs else sorted(refs):
            c = collections.Counter(w)
            hist = [c[x] for x in refs[lang][0]]
            out.append((distance(own, chars[lang]), distance([*hist, len(w) - sum(hist)], refs[lang][1])))
        return min(out, key=sum)

    got = {r.doc_id: r for r in queries.op8_quality_rules(spark, data).collect()}
    assert set(got) == set(table)
    for i, r in table.items():
        g, n = got[i], len(word.findall(r.text or ""))
        if n:
            dc, dw = far(r)
            assert abs(g.char_distance - dc) < 1e-9 and abs(g.word_distance - dw) < 1e-9
            bad = (len(r.text) >= 300 and dc > 0.24 + 60 / len(r.text)) or (n >= 50 and dw > 0.33 + 6 / n)
            assert g.kept == (not g.base_failed and not bad)
        else:
            assert g.base_failed and not g.kept


def _odd_folder(spark, data, path, rows):
    """The small tables' folder with ``rows`` added to its documents, and columns whose names the stages use themselves."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    more = spark.createDataFrame(rows, docs.schema)
    names = ["row_number", "bucket", "band", "node", "score", "spans", "hits", "h", "s", "whole", "block"]
    both = docs.unionByName(more).selectExpr("*", *(f"'{c}' AS {c}" for c in names))
    both.repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{data}/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
    return names


def test_the_whole_pipeline_on_odd_rows(spark, data, table, tmp_path):
    from test_operators import _brute_items, _brute_pii

    long = max((r for r in table.values() if r.text and r.lang), key=lambda r: len(r.text))
    rng = random.Random(3)
    mixed_up = long.text.split()
    rng.shuffle(mixed_up)
    item = next(r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect() if len(r.text.split()) > 20)
    rows = [
        (None, None, None, None, None),
        (None, "", "en", "src0", 0),
        (10**6, " ".join(mixed_up * 8), long.lang, "src0", 1),
        (10**6, item, long.lang, None, 1),
        (10**6 + 1, "write to jane.roe@example.org or +1 (555) 010-9999 " + " ".join(mixed_up[:60]), long.lang, "src0", 1),
        (10**6 + 2, "² ½ 12 34 56", "en", "src0", 1),
        (10**6 + 3, " ".join(mixed_up * 8), long.lang, "src1", 1),
        (None, " ".join(mixed_up[100:200]), long.lang, "src1", 1),
        (None, " ".join(mixed_up[100:200]), long.lang, "src1", 1),
    ]
    names = _odd_folder(spark, data, tmp_path, rows)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and set(names) <= set(got[0].asDict()) and all(r[c] == c for r in got for c in names)
    ids = [r.doc_id for r in got]
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
    assert {10**6 + 2, 10**6 + 3}.isdisjoint(ids) and ids.count(None) <= 1
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    assert all(not _brute_items(r.text, items)[-1] for r in got if "[" not in r.text)
    assert not any(_brute_pii(r.text) for r in got) and all(r.taken > 0 for r in got)
    assert item not in [r.text for r in got]


def test_the_whole_pipeline_on_an_empty_table(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    docs.where("doc_id < 0").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{data}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
