import importlib.util

import pytest

import __spark_entry__

pytestmark = pytest.mark.skipif(not importlib.util.find_spec("corpus_pipeline"), reason="no pipeline here")


@pytest.fixture(scope="module")
def kept(spark):
    import corpus_pipeline
    from assayer.session import materialize

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], folder), "stage"))
    return out


def test_stages_keep_columns_and_only_drop(kept):
    for before, after in zip(kept, kept[1:-1], strict=False):
        assert after.columns == before.columns
        assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()}


def test_each_decision_takes_effect(spark, kept):
    from assayer.llm import decontaminate, sanitise, setsketch, toxicity

    folder = "/root/testdata/sf0.001"
    labels, benchmark = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("labels", "benchmark"))
    ids = [{r.doc_id for r in t.collect()} for t in kept]
    assert ids[1] == {r.doc_id for r in toxicity.toxicity(kept[0], labels).collect() if not r.predicted}
    assert ids[2] == {r.doc_id for r in setsketch.near_duplicates(kept[1]).collect() if r.kept}
    assert ids[3] == ids[2] - {r.doc_id for r in decontaminate.overlaps(kept[2], benchmark).collect()}
    assert ids[4] == ids[3] == ids[5]
    spans = {r.doc_id: [s for s in r.spans if s.kind in sanitise.KINDS] for r in sanitise.sanitise(kept[4]).collect()}
    assert not any(s.kind == "email" for found in spans.values() for s in found)


def test_run_packs_every_kept_document(spark, kept):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in kept[4].collect()}


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()) == list(range(1, 14))
