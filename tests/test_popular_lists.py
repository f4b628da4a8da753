"""Lists of the most popular items make a few rows a user, however many items the user has seen."""

from pyspark.sql import functions as F

from quillon.plans import evaluate


def test_lists_are_made_of_free_places(spark, monkeypatch):
    rows = [(u, i) for u in range(30) for i in range(40) if (u * 7 + i * i) % (3 + u % 5) or u == 4]
    train = spark.createDataFrame(rows, "user_id long, item_id long")
    users = spark.range(32).withColumnRenamed("id", "user_id")
    counts = {i: sum(j == i for _, j in rows) for _, i in rows}
    order = sorted(counts, key=lambda i: (-counts[i], i))
    want = {(u, i, n + 1, float(counts[i])) for u in range(32) for n, i in enumerate([i for i in order if (u, i) not in set(rows)][:5])}
    for head in (100_000, 7):
        monkeypatch.setattr(evaluate, "HEAD", head)
        monkeypatch.setattr(evaluate, "DEALT", 50, raising=False)
        made = evaluate.most_popular(train, users, 5)
        assert {tuple(r) for r in made.select("user_id", "item_id", F.col("pos").cast("int"), "score").collect()} == want
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "LeftAnti" not in plan
