import numpy as np
import pytest

from weftline.llm.covertree import Settings, Traversal, build, cosine_links

SCHEMA = "vec_id long, embedding array<float>, key string, n_links int"


def vectors(seed=5):
    rng = np.random.default_rng(seed)
    near = [c + rng.normal(0, s, (n, 12)) for c, s, n in ((rng.normal(0, 1, 12), 0.15, 60), (rng.normal(0, 1, 12), 0.02, 80), (rng.normal(0, 1, 12), 0.3, 40))]
    return np.concatenate([*near, rng.normal(0, 1, (150, 12))]).astype(np.float32)


def brute(rows):
    good = [(i, np.asarray(v, float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]
    links, label = {}, {i: i for i, _ in good}
    edges = []
    for k, (i, x) in enumerate(good):
        for j, y in good[:k]:
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9:
                edges.append((i, j))
                links[i], links[j] = links.get(i, 0) + 1, links.get(j, 0) + 1
    changed = True
    while changed:
        changed = False
        for i, j in edges:
            m = min(label[i], label[j])
            if (label[i], label[j]) != (m, m):
                label[i] = label[j] = m
                changed = True
    return sorted((i, links.get(i, 0), label.get(i, i), label.get(i, i) == i) for i, _ in rows)


@pytest.mark.parametrize("shard", [64, 4096])
def test_links_equal_brute_force(spark, shard):
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(vectors())]
    rows += [(1000 + k, rows[70][1]) for k in range(5)] + [(2000, None), (2001, [0.0] * 12), (2002, [float("nan")] * 12), (2003, [float("inf")] * 12), (2004, []), (2005, [None, 1.0]), (2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (2008, [float(2 * x) for x in rows[0][1]])]
    df = spark.createDataFrame([(i, v, "clash", 3) for i, v in rows], SCHEMA)
    got = sorted(tuple(r) for r in cosine_links(df, Settings(shard_rows=shard, pivots=4)).collect())
    assert got == brute(rows)


def test_an_empty_table(spark):
    assert cosine_links(spark.createDataFrame([], SCHEMA)).collect() == []


def test_tree_levels_cover_and_separate():
    x = vectors().astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    t = build([str(k) for k in range(len(x))], x, np.ones(len(x)), 0.02)
    assert sorted(t.keys) == sorted(str(k) for k in range(len(x)))
    for centre, radius, first, last in zip(t.centre, t.radius, t.first, t.last, strict=True):
        for c, r, a, b in zip(centre, radius, first, last, strict=True):
            assert a <= c < b and np.linalg.norm(t.unit[a:b] - t.unit[c], axis=1).max() <= r + 1e-7
    counts, _ = Traversal(t, t, True, Settings()).counts()
    assert (np.rint(counts) == (t.unit @ t.unit.T >= 0.9).sum(1) - 1).all()


def test_any_finite_size_links(spark):
    rows = [(1, [1e200, 0.0]), (2, [1e200, 1.0]), (3, [1.0, 0.0]), (4, [1e-200, 0.0]), (5, [5e-324, 0.0]), (6, [0.0, 1.7e308]), (7, [0.0, -1.0]), (8, [9.0, 4.358898943540674])]
    got = sorted(tuple(r) for r in cosine_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert [g[2] for g in got] == [1, 1, 1, 1, 1, 6, 7, 1]
    assert [g[1] for g in got][5:7] == [0, 0]


@pytest.mark.parametrize("shard", [7, 30])
def test_rings_and_crowded_bins(spark, shard):
    rng = np.random.default_rng(shard)
    x = np.concatenate([np.round(rng.normal(0, 1, (120, 3)), 1), [[1, 0, 0], [0, 1, 0], [0, 0, 1]] * 3, [[1, k / 1e6, 0] for k in range(40)]])
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    got = sorted(tuple(r) for r in cosine_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), Settings(shard_rows=shard, pivots=3, most_pivots=5, bins=16)).collect())
    assert got == brute(rows)
