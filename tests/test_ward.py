"""Ward's hierarchy against merging by brute force."""
import numpy as np
import pandas as pd
import pytest

from demandspark.operators import cluster, scale, ward


def brute(x):
    """Ward's merges by looking at every pair each time: costs and the clusters after each."""
    clusters = [[i] for i in range(len(x))]
    costs, states = [], [list(clusters)]
    while len(clusters) > 1:
        best = None
        for i in range(len(clusters)):
            for j in range(i):
                a, b = x[clusters[i]], x[clusters[j]]
                d = len(a) * len(b) / (len(a) + len(b)) * ((a.mean(0) - b.mean(0)) ** 2).sum()
                if best is None or d < best[0]:
                    best = (d, i, j)
        d, i, j = best
        merged = clusters[i] + clusters[j]
        clusters = [c for k, c in enumerate(clusters) if k not in (i, j)] + [merged]
        costs.append(d)
        states.append(clusters)
    return costs, states


def frame(spark, x):
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(x.shape[1])])
    pdf["row_id"] = np.arange(len(x))
    return scale.assemble(spark.createDataFrame(pdf).repartition(3), [f"c{i}" for i in range(x.shape[1])])


def groups(labels):
    return {frozenset(np.flatnonzero(labels == v).tolist()) for v in set(labels.tolist())}


def labels_of(df):
    return np.array([r[0] for r in df.orderBy("row_id").select("hierarchical_cluster").collect()])


def test_exact_when_every_point_is_a_feature(spark):
    x = np.random.default_rng(4).normal(size=(60, 3))
    costs, states = brute(x)
    df = frame(spark, x)
    model = ward.fit(df)
    np.testing.assert_allclose([m.cost for m in model.merges], costs, rtol=1e-9)
    for k in (1, 2, 5, 17):
        got = labels_of(model.label(df, k, "features", "hierarchical_cluster"))
        assert groups(got) == {frozenset(c) for c in states[len(x) - k]} and set(got) == set(range(1, k + 1))


def test_repeated_points_weigh(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(17, 2))[rng.integers(0, 17, 80)]
    costs, states = brute(x)
    model = ward.fit(frame(spark, x))
    d = len(np.unique(x, axis=0))
    assert len(model.n) == d and model.n.sum() == 80
    np.testing.assert_allclose(sorted(m.cost for m in model.merges), [c for c in costs if c > 1e-12], rtol=1e-9)


@pytest.mark.parametrize("shift", [0.0, 5.0, -1000.0])
def test_always_min_of_k_and_distinct_points(spark, shift):
    x = np.array([[0.0, 0.0]] * 5 + [[1.0, 1.0]] * 4 + [[-1.0, -1.0]] * 4) + shift
    x -= 0 if shift else x.mean(0)
    for k in (1, 2, 3, 5):
        assert len(set(labels_of(cluster.hierarchical(frame(spark, x), k)))) == min(k, 3)


def test_bounded_features_find_separate_groups(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 20, (5, 3))
    truth = rng.integers(0, 5, 600)
    x = centres[truth] + rng.normal(0, 0.5, (600, 3))
    df = frame(spark, x)
    model = ward.fit(df, max_features=40)
    assert len(model.n) == 40 and model.n.sum() == 600
    assert groups(labels_of(model.label(df, 5, "features", "hierarchical_cluster"))) == groups(truth)
    total = ((x - x.mean(0)) ** 2).sum()
    assert abs(sum(m.cost for m in model.merges) + model.within - total) < 1e-6 * total
    assert model.linkage(spark).count() == 39


def test_passes_equal_the_small_path(spark, monkeypatch):
    """The tree of cuts is the same from distributed sums as from the points themselves."""
    x = np.random.default_rng(7).normal(size=(50, 2))
    df = frame(spark, x)
    one = ward.fit(df, max_features=50)
    points, d = ward._points(df, "features")
    tree = ward.CutTree()
    stats = ward._pass(points, tree, d)
    while ward.split_leaves(tree, stats, 50):
        stats = ward._pass(points, tree, d)
    assert len(stats) == 50 and groups(tree.leaves(x)) == groups(one.tree.leaves(x))


def test_empty_table_and_null_vectors(spark):
    df = frame(spark, np.zeros((1, 2)))
    assert cluster.hierarchical(df.filter("row_id < 0"), 3).count() == 0
    some = df.unionByName(df.selectExpr("c0", "c1", "row_id + 1 as row_id", "null as features").select(*df.columns))
    assert sorted(str(r[0]) for r in cluster.hierarchical(some, 3).select("hierarchical_cluster").collect()) == ["1", "None"]
