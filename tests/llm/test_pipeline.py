"""The pipeline's stages against brute force on what each of them read."""

import corpus_pipeline
import pytest

from flowlake.llm import common, toxicity
from tests.llm import helpers as H


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = common.scratch(spark, f"test-{name}")
        stage(spark, frames[-1], sf).write.parquet(path)
        frames.append(spark.read.parquet(path))
    rows = [[tuple(r) for r in f.select("doc_id", "text").collect()] for f in frames[:-1]]
    for f in frames[:-1]:
        assert f.columns == docs.columns
    model = toxicity.fitted(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    good = {r[0] for r in toxicity.score(docs, model).where("score < 0.5").collect()}
    H.same(rows[1], [r for r in rows[0] if r[0] in good])
    H.same(rows[2], [r for r, c in zip(rows[1], H.brute_join(rows[1]), strict=True) if c[0] == c[2]])
    assert {r[0] for r in rows[3]} == {r[0] for r in rows[2]}
    seen, want = set(), {}
    for i, t in sorted(rows[2]):
        b, m = t.encode(), None
        m = H.covered(b, 100, seen)
        out, at = [], 0
        for ch in t:
            n = len(ch.encode())
            if not all(m[at : at + n]):
                out.append(ch)
            at += n
        want[i] = "".join(out)
    assert dict(rows[3]) == want
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    H.same(rows[4], [r for r, c in zip(rows[3], H.brute_decontaminate(rows[3], items), strict=True) if not c[5]])
    assert frames[5].count() == len(rows[4])


@pytest.mark.parametrize("make", [H.odd_docs, H.empty_docs])
def test_stages_on_odd_input(spark, sf, make):
    docs = make(spark)
    for name, stage in corpus_pipeline.STAGES:
        path = common.scratch(spark, f"test-{name}")
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "pieces":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    assert set(docs.columns) >= {"doc_id", "n_tokens"}


def test_one_row_of_a_repeated_id_stays(spark, sf):
    words = " ".join(f"w{k}" for k in range(80))
    rows = [(1, words, "en", "b", 3), (1, words, "en", "a", 3), (1, "other " + words, "en", "a", 3), (2, words, "en", "a", 3), (3, None, None, None, None), (3, None, None, None, None), (None, words, "en", "a", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.one_of_each_group(spark, docs, sf).collect()
    H.same(got, [(1, "other " + words, "en", "a", 3), (3, None, None, None, None), (None, words, "en", "a", 3)])


def test_run_leaves_its_last_table_only(spark, sf):
    before = list(common.SCRATCH)
    found = corpus_pipeline.run(spark, sf)
    assert found.count() > 0
    assert len([p for p in common.SCRATCH if p not in before]) == 1
