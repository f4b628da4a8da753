"""The pipeline's stages keep what they should and fit together."""

import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    had = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, docs, SF)
        assert new.columns == docs.columns and new.dtypes == docs.dtypes, name
        kept = new.join(docs.select("doc_id"), "doc_id", "left_semi").count()
        assert 0.4 * had < kept <= docs.count() == docs.select("doc_id").distinct().count(), name
        docs = spark.createDataFrame(new.collect(), new.schema)
    assert docs.where(F.char_length("text") != F.col("n_chars")).count() == 0
    placed = corpus_pipeline.run(spark, SF)
    assert placed.select("doc_id").distinct().count() == docs.count()
    assert placed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_empty(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_edges(spark):
    """Nulls in any column, repeated rows, ties, long texts and clashing names: stages keep rows whole and do not crash."""
    good = " ".join(f"word{i} stands here and there" for i in range(30))
    rows = [
        (1, good, "en", "s", 5), (1, good, "en", "s", 5), (2, good, None, None, None), (None, good + " tail", "en", "s", 1), (4, None, "en", "s", 0), (5, "", "en", None, 0),
        (6, "1234 5678 " * 20, "en", "s", 200), (7, " ".join(f"other{i} text" for i in range(40_000)), "de", "s", 1), (8, "x", "en", "s", 1), (9, good.upper(), "en", "s", 9),
    ]
    docs = spark.createDataFrame([(*r, "k", 1.5, ["w"]) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string, score double, _words array<string>")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, docs, SF)
        assert new.columns == docs.columns, name
        got = new.collect()
        assert all(r.kept == "k" and r.score == 1.5 and r._words == ["w"] for r in got)
        assert {r.doc_id for r in got} >= {1, 7}, name
        assert stage(spark, docs.limit(0), SF).count() == 0
    by_id = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, docs, SF).collect()}
    assert by_id[2] == "" and by_id[7] == rows[7][1]
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()} == {1, None, 4, 5, 6, 7, 8}
    pieces = corpus_pipeline.packed(spark, docs, SF)
    assert pieces.where("doc_id = 7").count() > 100 and pieces.where("doc_id = 4").first().length == 1


def test_each_stage_against_brute_force(spark):
    """Quality by SQL, near duplicates and passages by comparing all, packing by the tokenizers library."""
    import duckdb
    import public_tokenizers
    from tokenizers import Tokenizer

    from quillon.llm.packing import cut
    from quillon.llm.queries import oracle_sql
    from tests.llm.test_minhash import brute as groups
    from tests.llm.test_repeats import brute as passages

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    good = {r[0] for r in con.execute(f"select doc_id from ({oracle_sql()['op7_quality']}) where kept").fetchall()}
    docs = corpus_pipeline.quality_rules(spark, docs, SF)
    assert {r.doc_id for r in docs.select("doc_id").collect()} == good
    docs = corpus_pipeline.language_id(spark, docs, SF)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert len(rows) > 0.97 * len(good)
    alone = {i for i, (_, top) in groups(rows, 5, 80).items() if i == top}
    docs = corpus_pipeline.near_duplicates(spark, docs, SF)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {i for i, _ in rows} == alone
    left = {i: w[4].decode("utf-8", "ignore") for i, w in passages(rows).items()}
    docs = corpus_pipeline.repeated_passages(spark, docs, SF)
    assert {r.doc_id: r.text for r in docs.collect()} == left
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {(i, n, a, b) for i, t in left.items() for n, (a, b) in enumerate(cut(len(lib.encode(t, add_special_tokens=False).ids) + 1, 1024))}
    placed = corpus_pipeline.packed(spark, docs, SF).collect()
    assert {(r.doc_id, r.piece, r.start, r.length) for r in placed} == want and len(placed) == len(want)
    assert len({r.sequence_id for r in placed}) <= -(-sum(r.length for r in placed) // 1024) * 1.02 + 1


def test_packed_stage_on_added_tokens_and_long_white_space(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "wo<|endoftext|>rd", "\n" * 2_000_000]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = {r.doc_id: r.n for r in corpus_pipeline.packed(spark, docs, SF).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert n == {i: len(lib.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}


def test_run_leaves_no_tables_of_earlier_stages(spark):
    from quillon.llm.common import written

    before = set(written())
    placed = corpus_pipeline.run(spark, SF)
    left = {p.rpartition("/")[2].rsplit("-", 1)[0] for p in set(written()) - before}
    assert left == {"quillon-repeated_passages", "quillon-pieces"} and placed.count() > 0


def test_stages_send_workers_small_batches(spark):
    """A batch is held by the JVM and by the worker; 64 MB of it for each task doesn't fit an executor of 3 GB."""
    import pyarrow as pa

    key, docs = "spark.sql.execution.arrow.maxBytesPerBatch", spark.read.parquet(f"{SF}/documents.parquet")
    wide = spark.range(0, 1000, 1, 1).select(F.repeat(F.lit("x"), 20_000).alias("text"))
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches)
    was = spark.conf.get(key)
    try:
        for name, stage in corpus_pipeline.STAGES[1:]:
            spark.conf.set(key, "64m")
            stage(spark, docs, SF)
            got = [r.n for r in wide.mapInArrow(sizes, "n bigint").collect()]
            assert sum(got) >= 20_000_000 and max(got) <= 3 << 20, name
        spark.conf.set(key, "100k")  # what the session has set lower stays
        corpus_pipeline.language_id(spark, docs, SF)
        assert spark.conf.get(key) in ("100k", "102400b")
    finally:
        spark.conf.set(key, was)
