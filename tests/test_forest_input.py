"""Forests read rows that are made once, and medians are taken only where values are missing."""

from pyspark.sql import functions as F

from sylvaflow.operators import learning, tables


def test_rows_are_made_once_and_dealt_over_all_cores(spark, monkeypatch):
    seen, real = [], learning._fit
    monkeypatch.setattr(learning, "_fit", lambda ready, *rest: seen.append(ready) or real(ready, *rest))
    frame = spark.range(200).coalesce(1).select(F.col("id").cast("double").alias("a"), F.rand(1).alias("b"), (F.col("id") % 2).cast("string").alias("y"))
    learning.train_forest(frame, ["a", "b"], "y", trees=2, depth=2)
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan and "Relation" in plan and seen[0].inputFiles() and len(seen[0].inputFiles()) == 8
    assert seen[0].count() == 200


def test_medians_are_only_taken_of_columns_with_gaps(spark, monkeypatch):
    asked, real = [], tables.column_quantiles
    monkeypatch.setattr(tables, "column_quantiles", lambda frame, columns, shares: asked.append(columns) or real(frame, columns, shares))
    frame = spark.createDataFrame([(1.0, 1.0, None), (2.0, None, None), (4.0, 5.0, None)], "a double, b double, c double")
    got = tables.impute_median(frame, ["a", "b", "c"]).collect()
    assert [tuple(r) for r in got] == [(1.0, 1.0, 0.0), (2.0, 3.0, 0.0), (4.0, 5.0, 0.0)] and asked == [["b", "c"]]
    assert tables.impute_median(frame, ["a"]).count() == 3 and len(asked) == 1
