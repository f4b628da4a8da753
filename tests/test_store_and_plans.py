"""Bundles, the codec, searches, pools, streams; and that the package does without its subpackage."""

import enum
import subprocess
import sys
from pathlib import Path

import pytest

from quillon.plans import search
from quillon.sources.store import Bundle, Codec, digest, read_any, read_or_build, read_or_build_all
from quillon.streaming.counts import events_stream, windowed_counts


class Colour(enum.Enum):
    RED = 1


def test_read_through(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for _ in range(2):
        assert read_or_build(spark, f"{tmp_path}/t", build).count() == 3
    assert len(built) == 1
    both = {f"{tmp_path}/t": build, f"{tmp_path}/u": build}
    assert {df.count() for df in read_or_build_all(spark, both).values()} == {3} and len(built) == 3


def test_bundle_and_codec(spark, tmp_path):
    codec = Codec()
    codec.register(Colour)
    b = Bundle(spark, f"{tmp_path}/b", codec)
    with pytest.raises(FileNotFoundError):
        b.load()
    b.save({"t": spark.range(2), "c": {"colour": Colour.RED, "n": [1, 2]}, "deep": {"inner": spark.range(4)}})
    got = b.load()
    assert got["t"].count() == 2 and got["c"] == {"colour": Colour.RED, "n": [1, 2]} and got["deep"]["inner"].count() == 4
    assert b.save_config({"a": 1}) == b.save_config({"a": 1}) == digest({"a": 1})
    with pytest.raises(ValueError):
        codec.register(enum.Enum("Colour", "BLUE"))
    with pytest.raises(ValueError):
        b.save({".hidden": 1})
    with pytest.raises(ValueError):
        read_any(spark, "x.h5x")


def test_search_and_pool():
    best, value, tried = search.search(lambda s: -((s["x"] - 2) ** 2), search.grid({"x": [0, 1, 2, 3]}))
    assert best == {"x": 2} and value == 0 and len(tried) == 4
    assert list(search.draws(search.SPACES["p3_alpha"], 3, 1)) == list(search.draws(search.SPACES["p3_alpha"], 3, 1))
    fails = []
    assert search.pool([lambda: 1, lambda: fails.append(1) or 1 / 0]) == [1, None] and len(fails) == 3
    assert search.or_none(lambda: 1 / 0)() is None and search.timed(lambda: 5)() == 5


def test_stream_counts(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = windowed_counts(events_stream(spark, f"{tmp_path}/in", e.schema), "ts", "event_type", width="1 day", late="3650 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(n) from counts").first()[0] == e.count()


def test_entry_point_without_the_subpackage(tmp_path):
    root = Path(__file__).parents[1]
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op1_') for n in q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "quillon"):
        if (root / name).exists():
            subprocess.run(["cp", "-r", root / name, tmp_path / name], check=True)
    subprocess.run(["rm", "-rf", tmp_path / "quillon/llm"], check=True)
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin", "HOME": "/tmp"}, capture_output=True, text=True, timeout=120)
    n, has, pipeline, held = out.stdout.split()
    assert int(n) > 80 and (has, pipeline, held) == ("False", "False", "True")


def test_models_share_a_contract(spark, tmp_path):
    from quillon.plans import models

    cells = spark.createDataFrame([(u, i, 1.0) for u in range(12) for i in range(12) if (u + i) % 3], "u long, i long, r double")
    small = {"mf": {"width": 2, "epochs": 1}, "bpr": {"width": 2, "epochs": 1}, "lightgcn": {"width": 2, "layers": 1, "epochs": 1}, "slim_bpr": {"epochs": 1}, "slim_elastic_net": {"candidates": 5}}
    seen = {(r.u, r.i) for r in cells.collect()}
    for name in ("p3_alpha", "rp3_beta", "item_knn", "slim_elastic_net", "slim_bpr", "mf", "bpr", "lightgcn"):
        m = models.fit(name, cells, samples=200, **small.get(name, {})).check()
        got = m.recommend(3, users=spark.createDataFrame([(1,), (2,)], "user_id long"), ignored=spark.createDataFrame([(0,)], "item_id long")).collect()
        assert got and {r.user_id for r in got} <= {1, 2} and not {(r.user_id, r.item_id) for r in got} & seen and all(r.item_id != 0 and 1 <= r.pos <= 3 for r in got), name
    m = models.fit("p3_alpha", cells, k=4)
    m.save(f"{tmp_path}/m")
    again = models.load(spark, f"{tmp_path}/m")
    assert again.settings == {"k": 4} and again.recommend(2).exceptAll(m.recommend(2)).isEmpty()
    assert models.load_or_none(spark, f"{tmp_path}/none") is None
    with pytest.raises(ValueError):
        models.fit("svd", cells)
