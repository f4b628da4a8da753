"""Shards of a corpus by vector bin packing: bytes, tokens and rows are balanced jointly.

Groups of equal texts stay together where a shard can hold them. Groups too light to matter one by one are dealt by
their hash into a fixed number of cells; heavier groups (over 1/512 of a shard in some measure, hence at most 1536 times
the shard count) are units of their own. Units, a bounded number, are placed on the driver in order of size, each in the
shard whose residual capacity has the highest dot product with the unit's load. A group that no shard can hold whole is
cut into parts of 1/128 of a shard, which are placed one by one. (Kept whole, a group of a third of all rows would make shards
of near equal size impossible.)

Null text counts as empty. The law that holds is `bytes`: shard sizes are near equal. Rows get numbers as they are
written, and their place in a unit from counts of chunks of these numbers and prefix sums, so no group is sorted in one
task. Slots are numbered from 0 in each shard by unit, then by chunk. Rows that repeat a doc_id, or have none, get slots
of their own; equal loads are placed in the order of their units. An empty table gives an empty one. Other columns are
ignored. Texts of any length count whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import materialize

CELLS, HEAVY = 8192, 512
#: By how much of its capacity a shard may be overfilled to take a group whole, and the parts that others are cut into.
SLACK, PART = 1 / 256, 1 / 128
#: Rows of a unit that are numbered together.
CHUNK = 20_000


def place(loads: np.ndarray, shards: int, whole: np.ndarray | None = None) -> list[tuple[int, int, int, int]]:
    """(unit, first row, rows, shard): loads has a row per unit, its columns are measures, the last one rows.

    whole: units that are not cut; the others have equal rows, which are cut where no shard can take all of them.
    """
    total = loads.sum(axis=0)
    share = loads / np.maximum(total, 1e-9) * shards  # a shard's capacity is 1 in every measure
    residual = np.ones((shards, loads.shape[1]))
    out = []
    for i in np.argsort(-share.max(axis=1), kind="stable"):
        rows, first = int(loads[i, -1]), 0
        each, least = share[i] / max(rows, 1), max(1, int(rows * PART / share[i].max()))
        cut = not (whole is not None and whole[i]) and not (residual + SLACK >= share[i]).all(axis=1).any()
        while rows:
            n = min(rows, least) if cut else rows  # in small parts, so that the shards' measures stay alike
            by_dot = np.argsort(-(residual @ (each * n)), kind="stable")
            fits = by_dot[(residual[by_dot] + SLACK >= each * n).all(axis=1)]
            s = fits[0] if len(fits) else by_dot[0]
            out.append((int(i), first, n, int(s)))
            residual[s] -= each * n
            first, rows = first + n, rows - n
    return out


def measured(docs: DataFrame) -> DataFrame:
    """What sharding needs of each document, without its text."""
    text = F.coalesce("text", F.lit(""))
    trimmed = F.expr("trim(BOTH ' \\t\\n\\r' FROM coalesce(text, ''))")
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, "\\s+"))).cast("bigint").alias("tokens"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("same"),
    )


def shard(docs: DataFrame, *, shards: int = 8, cells: int = CELLS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, tokens of every document."""
    spark = docs.sparkSession
    rows, _ = materialize(spark, measured(docs).withColumn("row", F.monotonically_increasing_id()), "sizes")
    load = [F.sum("size").cast("double").alias("bytes"), F.sum("tokens").cast("double").alias("tokens"), F.count("*").cast("double").alias("rows")]
    whole = rows.agg(*load).first()
    total = {k: whole[k] or 0.0 for k in ("bytes", "tokens", "rows")}
    most = F.greatest(*[F.col(k) / max(v, 1.0) * shards for k, v in total.items()]).alias("most")
    # each measure has at most shards * HEAVY groups over 1 / (shards * HEAVY) of it
    heavy = rows.groupBy("same").agg(*load).select("same", most).where(F.col("most") > 1 / HEAVY).orderBy("same").collect()
    own = spark.createDataFrame([(r["same"], cells + i) for i, r in enumerate(heavy)], "same bigint, heavy bigint")
    units = rows.join(F.broadcast(own), "same", "left").withColumn("unit", F.coalesce("heavy", F.pmod(F.col("same"), F.lit(cells))))
    # a bounded list: cells and heavy groups
    loads = units.groupBy("unit").agg(*load).orderBy("unit").collect()
    table = np.array([[r["bytes"], r["tokens"], r["rows"]] for r in loads]).reshape(-1, 3)
    filled, placed = [0] * shards, []
    for i, first, n, s in sorted(place(table, shards, np.array([r["unit"] < cells for r in loads]))):
        placed.append((loads[i]["unit"], first, first + n, s, filled[s] - first))
        filled[s] += n
    places = spark.createDataFrame(placed, "unit bigint, first bigint, after bigint, shard int, base bigint")
    sizes = spark.createDataFrame([(r["unit"], int(r["rows"]) // CHUNK + 1) for r in loads], "unit bigint, chunks int")
    chunked = units.join(F.broadcast(sizes), "unit").withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("chunks")))
    counts = chunked.groupBy("unit", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("unit").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each 20,000 rows of a unit
    starts = counts.select("unit", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("unit", "chunk").orderBy("doc_id", "row")) - 1
    ranked = chunked.withColumn("within", within).join(starts, ["unit", "chunk"]).withColumn("rank", F.col("start") + F.col("within"))
    at = F.broadcast(places)
    return ranked.join(at, (ranked["unit"] == at["unit"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("after"))).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("base") + F.col("rank")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "tokens",
    )
