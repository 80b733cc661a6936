"""Quality scores: parts against plain numpy, held-out accuracy, edge cases."""

import zlib

import numpy as np
import pytest

from tidegrid.llm import classifier
from tidegrid.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, statistics string, label int, score double"


def test_features_approximate_the_kernel():
    rows = np.random.default_rng(1).normal(size=(40, 6))
    z = classifier.Features(np.zeros(6), np.ones(6), count=20_000, width=3.0)(rows)[:, :-1]
    apart = ((rows[:, None] - rows[None]) ** 2).sum(axis=2)
    assert np.abs(z @ z.T - np.exp(-apart / 18)).max() < 0.05


def test_normal_equations_and_model_against_numpy(spark):
    rng = np.random.default_rng(2)
    x, fold = rng.normal(size=(500, 4)).astype(np.float32), rng.integers(0, classifier.FOLDS, 500)
    y = (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(float)
    rows = spark.createDataFrame([(a.tolist(), float(b), int(c)) for a, b, c in zip(x, y, fold)], "statistics array<float>, label double, fold int")
    f = classifier.Features(np.zeros(4), np.ones(4), count=32)
    sums, counts = classifier.normal_equations(rows.repartition(7), f)
    z = f(x.astype(float))
    for k in range(classifier.FOLDS):
        assert np.allclose(sums[k][:, :-1], z[fold == k].T @ z[fold == k]) and np.allclose(sums[k][:, -1], z[fold == k].T @ y[fold == k])
    assert counts.tolist() == np.bincount(fold, minlength=classifier.FOLDS).tolist()
    model = classifier.fit(rows)
    z = model.features(x.astype(float))
    want = classifier.solve(z.T @ z, z.T @ y, 500)
    assert np.allclose(model.features.mean, x.mean(axis=0), atol=1e-5) and np.allclose(z @ model.weights, z @ want, atol=1e-6)
    assert (np.diff(model.steps) >= 0).all() and 0 <= model.steps.min() and model.steps.max() <= 1
    assert ((model(x.astype(float)) > 0.5) == y).mean() > 0.85  # the width suits more statistics


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op13_quality_classifier"](spark, folder).toPandas().merge(
        spark.read.parquet(f"{folder}/labels.parquet").toPandas(), on="doc_id", how="left")
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    held = got[got.held_out & got.quality.notna()]
    assert len(held) > 50 and (held.predicted == held.quality).mean() > 0.95
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.98
    assert (held[held.quality == 1].predicted == 1).mean() > 0.97


def test_labels_of_held_out_rows_are_not_learned(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.selectExpr("doc_id", f"IF(crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0, 1 - quality, quality) AS quality")
    a, b = ({r["doc_id"]: r["score"] for r in classifier.classify(docs, x).collect()} for x in (labels, flipped))
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-9


@pytest.mark.parametrize("labelled", [0, 1, 2])
def test_edges(spark, labelled):
    texts = [None, "", "   ", "\n\n", "word " * 30000, "a", "日本語 テキスト", "one two. Three!", "one two. Three!", "\u0000$$$"]
    docs = spark.createDataFrame([(i, t, "x", 3, 9.0) for i, t in enumerate(texts)] + [(None, "some words", "x", 3, 9.0)] * 2, SCHEMA)
    labels = spark.createDataFrame([(i, (i or 0) % labelled if labelled else None) for i in (1, 2, 2, 3, 4, 6, 77, None)], "doc_id long, quality int")
    rows = classifier.classify(docs, labels).collect()
    assert len(rows) == len(texts) + 2 and all(0 <= r["score"] <= 1 for r in rows)
    assert labelled or {r["score"] for r in rows} == {0.5}
    assert classifier.classify(docs.limit(0), labels).count() == 0
