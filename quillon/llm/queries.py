"""The operators' queries over their whole tables, with production parameters, and the SQL that some can be held to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.repeats import removal_digests

    return removal_digests(table(spark, sf_dir, "documents"), least=100)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.pieces import encode_digests

    return encode_digests(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.language import identify, learn

    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.sharding import shard

    return shard(table(spark, sf_dir, "documents"), shards=8)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.quality import measure

    return measure(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.toxicity import learn, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.media import store_and_read

    return store_and_read(table(spark, sf_dir, "documents"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), size=4, share=80)


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can state of op9_media."""
    return op9_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "strip_sha256")


def shard_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can state of op6_sharding: all rows and bytes are there, sizes are near equal, slots have no gaps."""
    rows = op6_sharding(spark, sf_dir)
    of = rows.groupBy("shard").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.count_distinct("slot").alias("slots"), F.max("slot").alias("last"), F.max("law").alias("law"))
    return of.agg(
        F.max("law").alias("law"), F.count("*").alias("shards"), F.sum("n").alias("n"), F.sum("size").cast("bigint").alias("size"),
        (F.max("size") <= 1.02 * F.min("size")).alias("near_equal"), F.every((F.col("slots") == F.col("n")) & (F.col("last") == F.col("n") - 1)).alias("gapless"),
    )


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_sharding(spark, sf_dir).select("doc_id", "size", "tokens")


def piece_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces put together again are the text, but for the space symbol, which stands for a space."""
    return op2_sentencepiece(spark, sf_dir).select("doc_id", "decoded_sha256")


def packing_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can state of op3_packing: every document is there, whole and in order, and no sequence is too long."""
    rows = op3_packing(spark, sf_dir)
    by_doc = Window.partitionBy("doc_id").orderBy("piece")
    steps = rows.withColumn("good", F.col("start") == F.coalesce(F.sum("length").over(by_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    docs = steps.groupBy("doc_id").agg(F.every("good").alias("in_order"), F.max("piece").alias("last"), F.count("*").alias("n"))
    fill = rows.groupBy("sequence_id").agg(F.sum("length").alias("used"), F.max(F.col("offset") + F.col("length")).alias("end"))
    good = docs.select("doc_id", (F.col("in_order") & (F.col("last") == F.col("n") - 1)).alias("whole"))
    return good.crossJoin(fill.agg((F.max("used") <= 1024).alias("fits"), F.every(F.col("used") == F.col("end")).alias("gapless")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_packing": op3_packing,
        "op4_language": op4_language,
        "op5_warc": op5_warc,
        "op6_sharding": op6_sharding,
        "op7_quality": op7_quality,
        "op8_toxicity": op8_toxicity,
        "op9_media": op9_media,
        "op10_minhash": op10_minhash,
        "media_payloads": media_payloads,
        "shard_law": shard_law,
        "shard_sizes": shard_sizes,
        "piece_decoded": piece_decoded,
        "packing_laws": packing_laws,
    }


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express; tests/llm holds the others to brute force."""
    return {
        "op1_suffix_dedup": r"""WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
            w AS (SELECT doc_id, p, md5_number(b[p:p + 99]) AS s FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 98)) AS p FROM d)),
            r AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1),
            g AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER o <= 100 THEN 0 ELSE 1 END AS new FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
            i AS (SELECT doc_id, min(p) AS a, max(p) + 99 AS z FROM (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM g) GROUP BY doc_id, island),
            k AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS f, a - 1 AS t FROM i UNION ALL SELECT doc_id, max(z) + 1, 1000000000 FROM i GROUP BY doc_id),
            h AS (SELECT doc_id, sha256(unhex(string_agg(hex(b[f:t]), '' ORDER BY f))) AS kept FROM k JOIN d USING (doc_id) GROUP BY doc_id),
            n AS (SELECT doc_id, sum(z - a + 1) AS removed, count(*) AS spans FROM i GROUP BY doc_id)
            SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, coalesce(kept, sha256(b)) AS kept_sha256 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN h USING (doc_id)""",
        "op5_warc": """WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
            d AS (SELECT *, CAST(octet_length(encode(html)) AS BIGINT) AS n FROM p),
            f AS (SELECT html, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY html)
            SELECT page_id, n AS payload_bytes, sha256(html) AS payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
                CASE WHEN first < page_id THEN first END AS refers_to, url, true AS digest_holds
            FROM d LEFT JOIN f USING (html)""",
        "op7_quality": r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
            w AS (SELECT doc_id, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM t),
            m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda y: length(y))), 0) AS BIGINT) AS word_chars,
                CAST(len(regexp_extract_all(x, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines,
                length(x) - length(regexp_replace(x, '\p{Lu}', '', 'g')) AS upper, length(regexp_replace(x, '[^\p{L}]', '', 'g')) AS letters FROM w),
            u AS (SELECT doc_id, unnest(ws) AS y, generate_subscripts(ws, 1) AS i FROM w),
            g AS (SELECT doc_id, i, concat_ws(' ', y, lead(y, 1) OVER o, lead(y, 2) OVER o, lead(y, 3) OVER o, lead(y, 4) OVER o) AS k, lead(y, 4) OVER o AS last FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
            c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM g WHERE last IS NOT NULL),
            s AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM c WHERE n > 1),
            r AS (SELECT doc_id, CAST(sum(CASE WHEN p IS NULL THEN 5 ELSE least(5, i - p) END) AS BIGINT) AS n_repeat_words FROM s GROUP BY doc_id),
            b AS (SELECT m.*, coalesce(n_repeat_words, 0) AS n_repeat_words FROM m LEFT JOIN r USING (doc_id)),
            f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
            SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
                NOT (base_failed OR 10 * n_symbols > word_chars OR word_chars > 25 * n_words OR word_chars < 2 * n_words OR 100 * n_dup_lines > 50 * n_lines OR 10 * upper > 6 * letters OR 2 * letters < word_chars) AS kept FROM f""",
        "op10_minhash": r"""WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
            s AS (SELECT DISTINCT doc_id, md5_number(s) AS s FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: concat_ws(' ', ws[i], ws[i + 1], ws[i + 2], ws[i + 3])) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM t)),
            n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
            c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
            l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
            e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
            r AS (SELECT doc_id AS x, doc_id AS y FROM t UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
            m AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
            SELECT t.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, t.doc_id = component_id AS kept FROM t JOIN m ON m.x = t.doc_id LEFT JOIN n ON n.doc_id = t.doc_id""",
        "media_payloads": """WITH p AS (SELECT doc_id, coalesce(text, '') AS t, octet_length(encode(coalesce(text, ''))) AS n FROM documents), q AS (SELECT doc_id, n, encode(t || repeat(' ', CAST(greatest(1, ceil(n / 192.0)) * 192 - n AS BIGINT))) AS b FROM p)
            SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha256(b) AS payload_sha256, sha256(rpad(CASE WHEN n = 0 THEN '0' ELSE CAST(length(bin(n)) AS VARCHAR) END || ' bits', 192, ' ')) AS strip_sha256 FROM q""",
        "shard_law": "SELECT 'bytes' AS law, CAST(8 AS BIGINT) AS shards, count(*) AS n, CAST(sum(octet_length(encode(coalesce(text, ''))) + 1) AS BIGINT) AS size, true AS near_equal, true AS gapless FROM documents",
        "shard_sizes": r"SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens FROM documents",
        "piece_decoded": "SELECT doc_id, sha256(replace(coalesce(text, ''), '▁', ' ')) AS decoded_sha256 FROM documents",
        "packing_laws": "SELECT doc_id, true AS whole, true AS fits, true AS gapless FROM documents",
    }
