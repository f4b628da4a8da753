"""Recommending from a similarity deals the scores once."""

from pyspark.sql import functions as F

from quillon.operators import graph


def test_recommend_from_deals_scores_once(spark, monkeypatch):
    cells = spark.range(900).selectExpr("id div 15 AS u", "(id * id + id div 7) % 40 AS i", "1.0d + id % 3 AS r").dropDuplicates(["u", "i"]).localCheckpoint()
    near = spark.range(400).selectExpr("id div 10 AS i", "(id * 7 + 3) % 40 AS j", "1.0d / (1 + id % 9) AS w").where("i <> j")
    rows = lambda d: {(r["user_id"], r["item_id"], r["pos"], round(r["score"], 9)) for r in d.collect()}
    want = rows(graph.recommend(graph.score(cells, near), cells, 5))
    monkeypatch.setattr(graph, "DEALT", 500)
    made = graph.recommend_from(cells, near, 5)
    assert rows(made.withColumn("pos", F.col("pos"))) == want and len(want) == 300
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" not in plan and plan.split("Initial Plan")[-1].count("hashpartitioning(u") == 1
