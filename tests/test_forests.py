"""Forests: splits are the best ones, trees lie in a table, the work is a few jobs however deep the trees."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sylvaflow.operators import forests, learning


def best(x, y, w, total):
    """Gain of the best split by trying all."""
    n, gains = total.sum(), []
    for f in range(x.shape[1]):
        for cut in range(forests.BINS - 1):
            one = x[:, f] <= cut
            if one.any() and not one.all():
                left = np.bincount(y[one], w[one], len(total))
                gains.append(((left**2).sum() / left.sum() + ((total - left) ** 2).sum() / (total - left).sum()) / n - ((total / n) ** 2).sum())
    return max(gains)


def test_histograms_and_sorted_rows_find_the_best_split():
    draw = np.random.default_rng(1)
    n, p, k, nodes = 500, 4, 3, 6
    x, y, s = draw.integers(0, 32, (n, p)).astype(np.uint8), draw.integers(0, k, n), draw.integers(0, nodes, n)
    w = draw.integers(1, 4, n) * np.array([0.5, 1.0, 2.0])[y]
    total = np.array([np.bincount(y[s == i], w[s == i], k) for i in range(nodes)])
    counts = np.stack([np.bincount((s * forests.BINS + x[:, j]) * k + y, w, nodes * forests.BINS * k) for j in range(p)]).reshape(p, nodes, forests.BINS, k)
    dense = forests._dense(counts, total)
    keys = np.concatenate([((s * p + j) * forests.BINS + x[:, j]) * k + y for j in range(p)])
    sparse = forests._sparse(keys, np.tile(w, p), total, p)
    for i in range(nodes):
        m = s == i
        assert dense[0][i] == pytest.approx(best(x[m], y[m], w[m], total[i]), abs=1e-9) and sparse[0][i] == pytest.approx(dense[0][i], abs=1e-9)
        assert (dense[1][i], dense[2][i]) == (sparse[1][i], sparse[2][i])
        for _, j, cut, left in (dense, sparse):
            one = m & (x[:, j[i]] <= cut[i])
            assert np.allclose(left[i], np.bincount(y[one], w[one], k))


def test_thresholds_lie_between_values(spark, monkeypatch):
    names = ["few", "many", "one"]
    frame = spark.range(1000).select(F.when(F.col("id") < 990, 0.0).when(F.col("id") < 995, 1.0).otherwise(3.0).alias("few"), F.col("id").cast("double").alias("many"), F.lit(2.0).alias("one"), F.lit("a").alias("y"))
    path = forests.written(forests.values(frame, names, "y", None), "values")
    for held in (forests.HELD, 100):  # features that a task holds, and features that none holds
        monkeypatch.setattr(forests, "HELD", held)
        cuts = forests.thresholds(path, spark, names)
        assert cuts["few"] == [0.5, 2.0] and cuts["one"] == []
        assert len(cuts["many"]) == 31 and all(c % 1 == 0.5 for c in cuts["many"]) and np.abs(np.diff(cuts["many"]) - 1000 / 32).max() < 3


def planted(spark, n, seed=0):
    frame = spark.range(n).select("id", *(F.rand(seed + k).alias(f"f{k}") for k in range(6)))
    frame = frame.withColumn("y", F.when((F.col("f0") > 0.5) != (F.col("f1") > 0.5), "a").when(F.col("f2") > 0.7, "b").otherwise("c"))
    rows = frame.collect()
    return spark.createDataFrame(rows, frame.schema)


def test_it_learns_what_spark_forests_learn(spark):
    names = [f"f{k}" for k in range(6)]
    frame = planted(spark, 3000)
    train, test = frame.filter("id % 3 > 0"), frame.filter("id % 3 = 0")
    model = learning.train_forest(train, names, "y", trees=60, depth=8, weight=False)
    ours = {r.id: r for r in learning.predict(model, test, ["id", "y"]).collect()}
    code = F.when(F.col("y") == "a", 0.0).when(F.col("y") == "b", 1.0).otherwise(2.0)
    vectors = VectorAssembler(inputCols=names, outputCol="x").transform(frame.withColumn("c", code))
    theirs = RandomForestClassifier(featuresCol="x", labelCol="c", numTrees=60, maxDepth=8, featureSubsetStrategy="sqrt", seed=1).fit(vectors.filter("id % 3 > 0"))
    shares = {r.id: r.p for r in theirs.transform(vectors.filter("id % 3 = 0")).select("id", vector_to_array("probability").alias("p")).collect()}
    right = lambda said: np.mean([said(i) == r.y for i, r in ours.items()])
    assert right(lambda i: ours[i].predicted) > right(lambda i: "abc"[int(np.argmax(shares[i]))]) - 0.02 > 0.85
    assert all(sum(r.probability) == pytest.approx(1.0) and r.confidence == max(r.probability) for r in ours.values())
    assert np.mean([np.abs(np.subtract(ours[i].probability, shares[i])).max() for i in ours]) < 0.06
    assert np.abs(np.subtract([dict(learning.importance(model))[c] for c in names], theirs.featureImportances.toArray())).max() < 0.06


def test_jobs_do_not_grow_with_depth_or_trees(spark):
    names = [f"f{k}" for k in range(6)]
    frame, jobs = planted(spark, 300), []
    for trees, depth in ((2, 2), (40, 10)):
        spark.sparkContext.setJobGroup(f"forest-{trees}", "")
        learning._fit(frame, names, "y", trees, depth, 1, False)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"forest-{trees}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]


def test_selection_finds_thresholds_once_and_writes_each_run_once(spark, monkeypatch):
    asked, written, real, write = [], [], forests.thresholds, forests.written
    monkeypatch.setattr(forests, "thresholds", lambda path, session, names: asked.append(names) or real(path, session, names))
    monkeypatch.setattr(forests, "written", lambda frame, name: written.append(name) or write(frame, name))
    found = learning.select_by_shadows(planted(spark, 300), ["f0", "f1", "f5"], "y", "id", runs=3, trees=10, depth=4)
    assert asked == [["f0", "f1", "f5"]] and written == ["values", *["binned", "trees"] * 3]
    assert {c for c, _, _ in found} == {"f0", "f1", "f5"}


def test_trees_lie_in_a_table_and_rows_read_again_grow_the_same_ones(spark, monkeypatch):
    names, found = [f"f{k}" for k in range(6)], []
    rows = planted(spark, 400).coalesce(1)
    cuts = {c: [k / 32 for k in range(1, 32)] for c in names}
    for held in (forests.HELD, 0):  # rows that a task keeps, and rows read again for each level
        monkeypatch.setattr(forests, "HELD", held)
        model = learning._fit(rows, names, "y", 8, 3, 1, False, cuts, ["a", "b", "c"])
        found.append({r.tree: (bytes(r.feature), bytes(r.cut), bytes(r.left)) for r in spark.read.parquet(model.path).collect()})
    assert len(found[0]) == 8 and found[0] == found[1]
