"""The pipeline's stages over the small tables, each against its own rule."""

import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, data, tmp_path):
    from test_operators import _brute_items, _brute_pii

    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, data).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before)
        if n < 4:
            assert docs.columns == columns
        if name == "decontamination":
            assert set(after) == {i for i, r in before.items() if not _brute_items(r.text, items)[-1]}
        elif name == "personal_data":
            assert set(after) == set(before) and not any(_brute_pii(r.text or "") for r in after.values())
        elif name == "source_mix":
            assert all(0 < r.taken <= 2 * r.size == 2 * len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in after.values())
        else:
            assert len(after) >= 0.5 * len(before)


def test_columns_named_as_the_figures_of_the_mix(spark):
    rows = [(i, f"some words of text {i}", "a", 7, 8, "x") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, Size int, TAKEN int, size_ string")
    out = corpus_pipeline.mixed(spark, docs, "")
    got = {r.doc_id: r.asDict() for r in out.collect()}
    assert got and all(r["Size__"] == 7 and r["TAKEN_"] == 8 and r["size_"] == "x" and r["size"] == 5 for r in got.values())
    assert len({c.lower() for c in out.columns}) == len(out.columns)


def test_what_stages_keep_for_themselves_goes(spark, data, tmp_path):
    from stacklore.llm import base

    docs = spark.read.parquet(f"{data}/documents.parquet")
    with base.passing() as kept:
        stage = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, data)
        assert [k.kept_at.rpartition("/")[2].split("-")[0] for k in kept] == ["numbered"]
        n = stage.count()
        at = kept[0].kept_at.removeprefix("file:")
    assert 0 < n < docs.count() and not __import__("os").path.exists(at)
