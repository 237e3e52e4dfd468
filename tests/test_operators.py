"""Skew-safe joins, global positions, top-k and session logs."""

import random

from pyspark.sql import functions as F

from glossa.operators.ids import dense_ids, top_k, with_previous
from glossa.operators.joins import hot_keys, salted_join
from glossa.streaming.sessions import page_sizes


def test_salted_join_is_the_join(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("key"), F.col("id").alias("v"))
    right = spark.range(60).select(F.col("id").alias("key"), (F.col("id") * 2).alias("w")).filter("key <> 9")
    assert hot_keys(left.select("key"), min_rows=500).collect()[0]["key"] == 7
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(map(tuple, left.join(right, "key", how).collect()), key=str)
        got = sorted(map(tuple, salted_join(left, right, "key", how, min_rows=500).collect()), key=str)
        assert got == want, how


def test_hot_key_is_spread(spark):
    left = spark.range(20000).select(F.lit("hot").alias("key"), F.col("id").alias("v"))
    right = spark.createDataFrame([("hot", 1)], "key string, w int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = salted_join(left, right, "key").groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in joined) == 20000 and len(joined) > 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_dense_ids_and_previous(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 40), i) for i in range(997)]
    rng.shuffle(rows)
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "cost int, line int").repartition(parts)
        got = dense_ids(df, ["cost", "line"], "id").orderBy("id").collect()
        assert [(r["cost"], r["line"]) for r in got] == sorted(rows)
        assert [r["id"] for r in got] == list(range(len(rows)))
        prev = with_previous(df, ["cost", "line"], "line", "prev", -1).orderBy("cost", "line").collect()
        assert [r["prev"] for r in prev] == [-1] + [line for _, line in sorted(rows)][:-1]


def test_top_k_of_a_hot_group(spark):
    df = spark.range(6000).select((F.col("id") % 3 % 2).alias("g"), F.col("id").alias("v"), F.lit(2500).alias("k"))
    for k_max in (2500, 20):
        got = top_k(df.withColumn("k", F.lit(k_max)), "g", ["v"], "k", k_max).groupBy("g").agg(F.max("v").alias("v"), F.count("*").alias("n"))
        want = {g: sorted(v for v in range(6000) if v % 3 % 2 == g)[:k_max] for g in (0, 1)}
        assert {r["g"]: (r["v"], r["n"]) for r in got.collect()} == {g: (v[-1], len(v)) for g, v in want.items()}


def test_top_k_limits_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 3 as g", "id as v", "5 as k")
    plan = top_k(df, "g", ["v"], "k", 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def replay(log):
    """The page size state machine, one event at a time."""
    current, presses, out = {}, {}, []
    for session, _, event, query in sorted(log):
        if query is None:
            presses[session] = presses.get(session, 0) + 1
        elif query == "" or query != current.get(session, ""):
            current[session], presses[session] = query, 0
        out.append((session, event, presses.get(session, 0), 12 << min(presses.get(session, 0), 58)))
    return sorted(out)


def random_log(seed, n=600):
    rng = random.Random(seed)
    return [(rng.choice([1, 1, 1, 2, 3]), i // 2, i, rng.choice([None, None, None, "a", "a", "b", ""])) for i in range(n)]


def test_page_sizes(spark):
    """One session holds most of the log and is spread over several tasks."""
    log = random_log(11)
    df = spark.createDataFrame(log, "session bigint, t bigint, event_id bigint, query string")
    got = page_sizes(df, "session", ["t", "event_id"]).select("session", "event_id", "presses", "page_size")
    assert sorted(map(tuple, got.collect())) == replay(log)
