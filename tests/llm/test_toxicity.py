import numpy as np

from assayer.llm import toxicity


def test_rows_and_folds(spark, odd, crowded, nothing, odd_rows):
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (6, None), (6, 1), (9, 0)], "doc_id long, toxic int")
    for table in (odd, crowded):
        got = toxicity.toxicity(table, labels).collect()
        assert sorted((r.doc_id for r in got), key=repr) == sorted((i for i, _ in odd_rows), key=repr)
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
        twice = [r.score for r in got if r.doc_id == 6]
        assert len(set(twice)) == 1
    assert toxicity.toxicity(nothing, labels).count() == 0
    none = toxicity.toxicity(odd, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    hits = sum(r.predicted and r.toxic for r in rows)
    assert hits / sum(r.predicted for r in rows) > 0.95
    assert hits / sum(r.toxic for r in rows) > 0.7


def test_labels_of_held_out_rows_do_not_matter(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    turned = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(), 1 - labels.toxic).otherwise(labels.toxic))
    one, other = (toxicity.fit(documents, t, ~toxicity.held_out()) for t in (labels, turned))
    assert all((a == b).all() for a, b in zip(one, other, strict=True))


def test_rates_are_per_coordinate_and_weights_sparse():
    model = toxicity.Ftrl(toxicity.Settings(buckets=16, l1=0.5))
    for _ in range(200):
        model.learn(np.array([1, 2]), 1)
        model.learn(np.array([1, 3]), 0)
    at, weight = model.model()
    weights = dict(zip(at.tolist(), weight.tolist(), strict=True))
    assert weights[2] > 1 and weights[3] < -1 and 7 not in weights
    assert model.n[1] > model.n[2] > 0


def test_clean_drops_predicted_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.withColumn("score", toxicity.F.lit(7))
    kept = {r.doc_id for r in toxicity.clean(docs, labels).collect()}
    assert kept == {r.doc_id for r in toxicity.toxicity(docs, labels).collect() if not r.predicted}
    assert toxicity.clean(docs, labels).columns == docs.columns
