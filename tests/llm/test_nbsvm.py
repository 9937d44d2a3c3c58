import numpy as np

from quantspan.llm import nbsvm
from quantspan.llm.samples import labelled, remainder

from cases import frame, none, odd, odd_rows, prose


def corpus(spark, n=240):
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = prose(i, 90)
        rows.append((i, " | ".join(text.split()) if bad else text))
        labels.append((i, 0 if bad else 1))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int")


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus(spark)
    model = nbsvm.fit(docs, labels, "quality", 3, 1)
    scored = nbsvm.score(docs, model).join(labels, "doc_id").withColumn("out", remainder(labels["doc_id"], 3))
    rows = scored.where("out = 1").select("score", "quality").collect()
    assert len(rows) > 50
    assert np.mean([(r.score >= 0.5) == (r.quality == 1) for r in rows]) >= 0.95
    got = nbsvm.score(odd(spark), model)
    assert got.count() == len(odd_rows()) and got.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert got.columns.count("score") == 1
    assert nbsvm.score(none(spark), model).count() == 0


def test_held_out_labels_never_enter(spark):
    docs, labels = corpus(spark, 120)
    sample, counts = labelled(docs, labels, "quality", 3, 1, 20)
    assert sample.where(remainder(sample["doc_id"], 3) == 1).count() == 0
    assert sample.groupBy("label").count().where("count > 20").count() == 0
    assert sum(counts.values()) == labels.where(remainder(labels["doc_id"], 3) != 1).count()


def test_without_labels_of_both_classes(spark):
    docs, labels = corpus(spark, 20)
    empty = nbsvm.fit(docs, labels.limit(0), "quality", 3, 1)
    assert {r.score for r in nbsvm.score(docs, empty).collect()} == {0.5}
    one = nbsvm.fit(docs, labels.where("quality = 1"), "quality", 3, 1)
    assert min(r.score for r in nbsvm.score(docs, one).collect()) > 0.9


def test_dual_descent_reaches_the_primal_optimum():
    """Two features, checked against a grid search of the hinge loss with a squared penalty."""
    x = np.array([[1.0, 0.2], [0.8, -0.1], [-0.9, 0.3], [-0.7, -0.4], [0.3, -0.9]])
    y = np.array([1.0, 1.0, -1.0, -1.0, -1.0])
    w = nbsvm.descend([np.arange(2)] * 5, list(x), y, 2, nbsvm.Settings(epochs=300))
    loss = lambda v: 0.5 * v @ v + np.maximum(0, 1 - y * (x @ v)).sum()
    grid = min(loss(np.array([a, b])) for a in np.linspace(-3, 3, 121) for b in np.linspace(-3, 3, 121))
    assert loss(w) <= grid + 1e-3
