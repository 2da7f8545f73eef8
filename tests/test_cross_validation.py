"""Cross-validation grows every forest of every fold and repeat, and predicts once."""

from conftest import SMALL
from pyspark.sql import functions as F

import __spark_entry__
from sylvaflow.operators import learning


def test_the_query_grows_whole_forests_for_all_folds_and_repeats(spark, monkeypatch):
    asked, real = [], learning._fit
    monkeypatch.setattr(learning, "_fit", lambda ready, features, label, trees, depth, *rest: asked.append((len(features), trees, depth)) or real(ready, features, label, 1, 2, *rest))
    rows = __spark_entry__.queries()["fold_scores"](spark, SMALL).collect()
    assert asked == [(64, 500, 12)] * 15
    assert [(r["repeat"], r["fold"]) for r in rows] == [(r, f) for r in range(3) for f in range(5)]


def test_each_repeat_scores_every_row_once_from_stored_predictions(spark, monkeypatch):
    seen, real = [], learning.evaluation
    monkeypatch.setattr(learning, "evaluation", lambda scored, *rest: seen.append(scored) or real(scored, *rest))
    frame = spark.range(90).select("id", (F.col("id") % 3).cast("double").alias("a"), F.rand(1).alias("b"), (F.col("id") % 3).cast("string").alias("y"))
    got = learning.cross_validate(frame, ["a", "b"], "y", "id", k=3, repeats=2, trees=20)
    assert [(s["repeat"], s["fold"], s["n"]) for s in got] == [(r, f, 30.0) for r in range(2) for f in range(3)]
    assert all(s["accuracy"] > 0.9 for s in got)  # a tells the classes
    keys = sorted(r.id for scored in seen for r in scored.select("id").collect())
    assert keys == sorted([*range(90)] * 2)
    assert all("UDF" not in scored._jdf.queryExecution().optimizedPlan().toString() and scored.inputFiles() for scored in seen)
