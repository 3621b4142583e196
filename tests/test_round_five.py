"""Findings of round 4: pairs of queries and entries are made evenly, and at the end."""

from pyspark.sql import functions as F

from sparkloom.operators import search


def test_one_answer_for_many_queries_is_dealt_to_all_tasks(spark):
    """600 queries for a text that 2,400 entries hold: packed rows meet, pairs come after the last join, and no task makes many of them."""
    found = spark.range(2400).select(F.lit("opening").alias("asked"), "id", F.lit(1).alias("tier"))
    asked = spark.range(600).select(F.lit("opening").alias("asked"), F.col("id").alias("query_id"))
    pairs = search.for_each_query(found, asked, ["asked"])
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 2 and plan.rindex("Generate explode") < plan.index("Join")
    made = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(made) == 600 * 2400 and max(made) < sum(made) / 8


def test_packed_rows_lose_nothing(spark, monkeypatch):
    """Answers and queries that fill several packed rows, null ids and queries, equal rows, queries without answer and answers without query."""
    for name, n in (("DEALS", 3), ("SHARDS", 2), ("IDS", 4), ("QUERIES", 3)):
        monkeypatch.setattr(search, name, n)
    held = {("a", "x"): [None, *range(40)], ("b",): [7], ("c",): [1, 2]}
    asking = {("a", "x"): [None, *range(100, 120)], ("b",): [1, 2], ("d",): [3]}
    tier = lambda k: 0 if k == ("b",) else 1
    found = spark.createDataFrame([(list(k), i, tier(k)) for k, ids in held.items() for i in ids] + [(["b"], 7, 0)], "asked array<string>, id long, tier int")
    asked = spark.createDataFrame([(list(k), q) for k, qs in asking.items() for q in qs], "asked array<string>, query_id long")
    got = search.for_each_query(found.repartition(3), asked, ["asked"]).select("query_id", "id", "tier").collect()
    want = [(q, i, tier(k)) for k, qs in asking.items() for q in qs for i in held.get(k, [])]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
