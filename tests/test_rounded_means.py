"""Means that are rounded near a tie do not depend on how their rows are dealt."""

import functools
import operator
import random

from quillon import more_queries, queries


def test_means_are_summed_in_order_of_rows(spark, tmp_path):
    """The rows of a user come last first and from several files; the results are those of sums in the order of ids."""
    dice, rows, want, whole = random.Random(5), [], {}, {}
    for user in range(400):
        for kind in ("click", "view"):
            values = [dice.randrange(10000) for _ in range(19)]
            values.append((10 * dice.randrange(1, 300) + 5) * 20 * 10 // 10 - sum(values) % 2000)  # a tie of the mean in most cases
            values = [v / 100 for v in values]
            mean = functools.reduce(operator.add, values, 0.0) / len(values)
            x = (mean - 50) * 10
            want[user, "a" if kind == "click" else "b"] = (int(abs(x) + 0.5) * (1 if x > 0 else -1)) / 10
            whole[user, kind] = float(int(mean + 0.5))
            rows += [(len(rows) + n, user, kind, v) for n, v in enumerate(values)]
    df = spark.createDataFrame([(i, u, k, v) for i, u, k, v in reversed(rows)], "event_id long, user_id long, event_type string, value double")
    df.repartition(7).sortWithinPartitions("value").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r["user_id"], r["other"]): r["d"] for r in queries._differences(spark, str(tmp_path)).collect()}
    assert got == {k: v + 0.0 for k, v in want.items()}
    events = spark.read.parquet(f"{tmp_path}/events.parquet")
    made = events.groupBy("user_id", "event_type").agg(more_queries.mean_in_order(events["value"], events["event_id"]).alias("m")).collect()
    assert {(r["user_id"], r["event_type"]): float(int(r["m"] + 0.5)) for r in made} == whole
