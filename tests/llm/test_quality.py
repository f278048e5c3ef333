import random
import zlib

import numpy as np

from weftline.llm.quality import Kernel, Settings, fit, isotonic, keep_good, measure, quality_scores

SCHEMA = "doc_id long, text string, score string, lang string"
LABELS = "doc_id long, quality int, text string"


def corpus(n=400):
    rng = random.Random(7)
    words = ["river", "stone", "under", "walk", "light", "the", "of", "green", "seven", "house"]
    docs, labels = [], []
    for k in range(n):
        good = k % 3 > 0
        w = [rng.choice(words) for _ in range(rng.randint(30, 90))]
        text = ". ".join(" ".join(w[i : i + 8]) for i in range(0, len(w), 8)) if good else " | ".join(x.upper() + "!!" for x in w)
        docs.append((k, text, "clash", "en"))
        if k % 2:
            labels.append((k, int(good), "clash"))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus()
    odd = [(5000, None, "x", None), (5001, "", "x", None), (None, "no id at all", "x", None), (1, docs[1][1], "x", "en"), (5002, "long " * 60_000, "x", None)]
    df = spark.createDataFrame(docs + odd, SCHEMA)
    lab = spark.createDataFrame([*labels, (1, 0, "x"), (None, 1, "x"), (7, None, "x")], LABELS)
    rows = quality_scores(df, lab).collect()
    assert len(rows) == len(docs) + len(odd)
    truth = {k: k % 3 > 0 for k, *_ in docs}
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    judged = [(r["predicted"] == truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean(judged) > 0.95
    kept = keep_good(df, lab)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in rows if r["predicted"]} == {r["doc_id"] for r in kept.collect()}


def test_held_out_labels_teach_nothing(spark):
    docs, labels = corpus(120)
    df = spark.createDataFrame(docs, SCHEMA)
    flipped = [(d, 1 - q if zlib.crc32(str(d).encode()) % 3 == 1 else q, t) for d, q, t in labels]
    a, b = (sorted(map(tuple, quality_scores(df, spark.createDataFrame(x, LABELS)).collect())) for x in (labels, flipped))
    assert a == b


def test_without_labels_and_without_rows(spark):
    docs, _ = corpus(6)
    none = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in quality_scores(spark.createDataFrame(docs, SCHEMA), none).collect()} == {0.5}
    assert quality_scores(spark.createDataFrame([], SCHEMA), none).collect() == []


def test_isotonic_is_monotone_and_keeps_the_mean():
    rng = np.random.default_rng(2)
    x = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-x))).astype(float)
    knots, values = isotonic(x, y)
    assert (np.diff(knots) > 0).all() and (np.diff(values) > 0).all()


def test_isotonic_equals_the_max_min_formula():
    rng = np.random.default_rng(4)
    for _ in range(10):
        x, y = np.sort(rng.normal(size=40)), (rng.random(40) < 0.5).astype(float)
        want = [max(min(y[a : b + 1].mean() for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
        knots, values = isotonic(x, y)
        # a block's knot is its mean score, so each score lies between the knots around its own block
        block = np.searchsorted(np.concatenate((values[1:], [np.inf])), np.array(want) + 1e-12)
        assert np.allclose(values[block], want)


def test_features_are_the_gaussian_kernel():
    rng = np.random.default_rng(9)
    s = Settings(features=20_000)
    x = rng.normal(size=(30, 6))
    f = Kernel(np.zeros(6), np.ones(6), s)(x)[:, : s.features]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * s.width**2))
    assert np.abs(f @ f.T - exact).max() < 0.05


def test_summed_normal_equations_are_ridge_regression(spark):
    docs, labels = corpus(150)
    df, lab = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS).selectExpr("doc_id", "quality as label")
    measured = measure(df)
    s = Settings(features=16, parts=3)
    model = fit(measured, lab, s)
    have = {r["doc_id"]: r["x"] for r in measured.collect()}
    x, y = np.array([have[d] for d, *_ in labels]), np.array([q for _, q, _ in labels], float)
    scale = x.std(0)
    kernel = Kernel(x.mean(0), np.where(scale > 1e-9, scale, 1.0), s)
    f = kernel(x)
    n = len(y)
    shrink = np.sqrt(np.append(np.full(f.shape[1] - 1, s.ridge * n), 1e-9 * n))
    direct, *_ = np.linalg.lstsq(np.vstack([f, np.diag(shrink)]), np.append(y, np.zeros(f.shape[1])), rcond=None)
    assert np.allclose(model.kernel(x) @ model.weights, f @ direct, atol=1e-6)


def test_rows_of_one_id_with_different_texts(spark):
    docs, labels = corpus(120)
    more = [(1, docs[0][1], "x", "en"), (1, docs[2][1], "x", "en")]
    runs = [sorted(map(tuple, quality_scores(spark.createDataFrame(x, SCHEMA).repartition(n), spark.createDataFrame(labels, LABELS)).collect())) for n, x in ((1, docs + more), (4, more + docs))]
    assert len(runs[0]) == 122 and np.allclose([r[2] for r in runs[0]], [r[2] for r in runs[1]], atol=1e-9)
