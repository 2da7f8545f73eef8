"""Selection by shadows: copies are bijections, planted columns are told apart."""

from pyspark.sql import functions as F

from sylvaflow.operators import learning


def test_each_shadow_is_its_column_in_another_order(spark):
    frame = spark.range(301).select(F.col("id").alias("key"), F.col("id").cast("double").alias("a"), (F.col("id") * 2).cast("double").alias("b"), F.lit("x").alias("y"))
    numbered = learning._numbered(frame, "key", 3)
    assert sorted(r._i for r in numbered.collect()) == list(range(301))
    got = learning.with_shadows(numbered, 301, ["a", "b", "a"], 5).collect()
    assert sorted(r.key for r in got) == list(range(301)) and all(r.a == r.key and r.b == 2 * r.key and r.y == "x" for r in got)
    for column, scale in (("shadow_0", 1), ("shadow_1", 2), ("shadow_2", 1)):
        assert sorted(r[column] for r in got) == [scale * k for k in range(301)] and sum(r[column] == scale * r.key for r in got) < 10
    assert [r.shadow_0 for r in got] != [r.shadow_2 for r in got]


def test_one_shuffle_a_run(spark):
    numbered = spark.range(50).select(F.col("id").alias("_i"), F.rand(1).alias("a"), F.rand(2).alias("b"))
    plan = learning.with_shadows(numbered, 50, ["a", "b"], 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_planted_columns_are_told_apart(spark):
    x = spark.range(400).select("id", F.rand(1).alias("u"), F.rand(2).alias("v"), *(F.rand(k + 10).alias(f"noise{k}") for k in range(4)), F.lit(1.0).alias("constant"))
    x = x.withColumn("label", F.when(F.col("u") + F.col("v") > 1, "a").otherwise("b")).withColumn("u", F.when(F.col("id") % 50 > 0, F.col("u")))
    rows = x.collect()
    frame = spark.createDataFrame(rows, x.schema)
    found = learning.select_by_shadows(frame, ["u", "v", *(f"noise{k}" for k in range(4)), "constant"], "label", "id", runs=12, trees=20, depth=5)
    assert {c: d for c, d, _ in found} == {"u": "confirmed", "v": "confirmed", **{f"noise{k}": "rejected" for k in range(4)}}
