"""Complete linkage against merging the nearest pair again and again."""

import numpy as np
import pytest

from sylvaflow.operators import clustering
from sylvaflow.operators.clustering import clustered_profiles, farthest, leaf_order, merges


def naive(points):
    groups, heights = [[k] for k in range(len(points))], []
    far = lambda a, b: max(np.linalg.norm(points[i] - points[j]) for i in a for j in b)
    sets = []
    while len(groups) > 1:
        h, i, j = min((far(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i))
        groups[j] += groups[i]
        sets.append(frozenset(groups[j]))
        del groups[i]
        heights.append(h)
    return heights, sets


@pytest.mark.parametrize(("n", "seed"), [(1, 0), (2, 1), (17, 2), (40, 3)])
def test_merges_are_those_of_brute_force(n, seed):
    points = np.random.default_rng(seed).normal(size=(n, 5))
    joined = merges(points)
    heights, sets = naive(points)
    assert np.allclose([m[2] for m in joined], heights)
    members = [frozenset([k]) for k in range(n)]
    for a, b, _, size in joined:
        members.append(members[a] | members[b])
        assert len(members[-1]) == size
    assert set(members[n:]) == set(sets)
    order = leaf_order(n, joined)
    assert sorted(order) == list(range(n))
    for group in sets:  # every cluster is one stretch of the leaves
        at = sorted(order.index(k) for k in group)
        assert at[-1] - at[0] == len(group) - 1


def test_profiles_of_classes(spark):
    rows = [("a", 1.0, 2.0, 3.0), ("a", 3.0, 4.0, 5.0), ("b", 3.0, 2.0, 1.0), ("c", 2.0, 4.0, 6.5), ("d", 5.0, 5.0, 5.0), (None, 9.0, None, 1.0)]
    got = {r.k: r for r in clustered_profiles(spark.createDataFrame(rows, "k string, x double, y double, z double"), "k", ["x", "y", "z"]).collect()}
    assert len(got) == 5 and sorted(r.leaf for r in got.values()) == [0, 1, 2, 3, 4] and abs(got["a"].leaf - got["c"].leaf) == 1
    assert (got["d"].x, got["d"].y, got["d"].z) == (0.0, 0.0, 0.0) and got["a"].height == got["c"].height < got["b"].height
    assert clustered_profiles(spark.createDataFrame([], "k string, x double"), "k", ["x"]).count() == 0


def test_many_classes_cluster_in_tables_as_on_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(f"c{k:04d}", *map(float, rng.normal(size=4) * (1, 1, 1, 0.05 if k % 3 else 1))) for k in range(60)]
    rows += [*((d, 1.0, 2.0, 4.0, 2.0) for d in ("d1", "d2", "d3")), (None, 9.0, None, 1.0, 3.0)]
    frame = spark.createDataFrame(rows, "k string, w double, x double, y double, z double")
    rows_of = lambda: {r.k: r for r in clustered_profiles(frame, "k", ["w", "x", "y", "z"]).collect()}
    want = rows_of()
    monkeypatch.setattr(clustering, "MOST", 10)
    got = rows_of()
    assert got.keys() == want.keys() and sorted(r.leaf for r in got.values()) == list(range(64))
    for k, r in want.items():
        assert got[k].leaf == r.leaf and got[k][1:5] == r[1:5] and abs(got[k].height - r.height) < 1e-12


def test_the_farthest_pair_is_that_of_all():
    rng = np.random.default_rng(1)
    for m, n in ((1, 1), (1, 7), (40, 300)):
        x, y = rng.normal(size=(m, 3)), rng.normal(size=(n, 3)) + 1
        assert farthest(x, y) == np.sqrt(((x[:, None] - y[None]) ** 2).sum(2)).max()
