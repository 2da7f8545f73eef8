"""The prefix trie against its SQL form, over odd rows and conversations that lie over several tasks."""

import random

import duckdb
import pandas as pd
import pytest
from conftest import SMALL

from sylvaflow.llm.prefix_trie import TRIE_SQL, prefix_trie

KIND = "conv_id long, turn long, role string, text string"


def by_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    return ordered(con.execute(TRIE_SQL).fetchall())


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0], r[1]))


@pytest.fixture
def many_tasks(spark):
    """Small tables stay in as many partitions as there are."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert ordered(prefix_trie(spark.read.parquet(f"{SMALL}/conversations.parquet")).collect()) == by_sql(rows)


def test_odd_rows_over_many_tasks(spark, many_tasks):
    rng = random.Random(3)
    says = ["a", "b", "", None, "ab", "1:a", "é𝄞", "x" * 90 + "1", "x" * 90 + "2"]
    ids = [-205, -101, -100, -7, 0, 1, 5, 7, 12, 99, 100, 101, 150, 212, 300, 301, 302, 2**40 + 3]
    rows = [(c, rng.choice([None, *range(4)]), rng.choice(["u", "v", None]), rng.choice(says)) for c in ids for _ in range(rng.choice([1, 2, 3, 9]))]
    rows += [(300, k, "u", "t" * (k % 3)) for k in range(150)] + [(301, k, "u", "t" * (k % 3)) for k in range(150)] + [(700, 1, "u", "same")] * 40 + [(None, 1, "u", "nobody's")]
    frame = spark.createDataFrame(pd.DataFrame([(*r, 1, 2, 3) for r in rows], columns=["conv_id", "turn", "role", "text", "n", "a", "depth"], dtype=object), f"{KIND}, n int, a int, depth int")
    assert ordered(prefix_trie(frame.repartition(5)).collect()) == by_sql(rows)


def test_many_ends_of_one_node(spark, many_tasks):
    rows = [(c, 0, "u", "hello") for c in range(3000)]
    got = ordered(prefix_trie(spark.createDataFrame(rows, KIND)).collect())
    assert got == by_sql(rows)
    assert max(r[3] for r in got if r[1] == 1) > 2000


def test_texts_are_whole_and_ties_have_one_order(spark):
    long = "word " * 400_000
    rows = [(1, 0, "u", long), (2, 0, "u", long + "!"), (101, None, "u", "z"), (101, None, "u", "y"), (101, 0, "a", "x")]
    assert ordered(prefix_trie(spark.createDataFrame(rows, KIND)).collect()) == by_sql(rows)


def test_no_conversations(spark):
    assert prefix_trie(spark.createDataFrame([], KIND)).collect() == []
    assert prefix_trie(spark.createDataFrame([(None, 1, "u", "a")], KIND)).collect() == []
