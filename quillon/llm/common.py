"""What the operators share: tables, the shared folder, and views of Arrow text as bytes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a kernel works on at once. What Spark sends at once it bounds by bytes (arrow.maxBytesPerBatch).
BATCH_ROWS = 512
#: Bytes of rows that Spark sends to a worker at once, where the session has to hold its memory down.
SENT_BYTES = 2 << 20
_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def short(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few hundred rows, so that what a kernel derives from them stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def send_less(spark: SparkSession, most: int = SENT_BYTES) -> None:
    """From now on the session sends its workers Arrow batches of about `most` bytes, if it sends larger ones.

    The JVM and the worker both hold a whole batch, and what they allocate for it mostly stays with them. Results don't
    depend on it. The batch size is read when a query runs, so it is not set back here.
    """
    if not 0 < spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= most:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a session that runs in one process (tests) gets a folder of its own; any other raises.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillon-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    _written.append(f"{shared_dir(spark)}/quillon-{tag}-{uuid.uuid4().hex}")
    return _written[-1]


def materialize(spark: SparkSession, df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, fixes row identity."""
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables that no later step reads."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        if path in _written:
            _written.remove(path)


def written() -> list[str]:
    """Intermediate tables that this process has written and not deleted."""
    return list(_written)


def discard_all(spark: SparkSession, *keep: str, since: list[str] = ()) -> None:
    """Delete the intermediate tables but those to keep and those listed in since.

    A result that an operator returns may read them when it is computed: write it, or collect it, first.
    """
    discard(spark, *[p for p in _written if p not in keep and p not in since])


def partitions(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def held_out(doc_id) -> "F.Column":
    """Rows kept out of learning: crc32 of the decimal doc_id leaves remainder 2 modulo 4."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def only(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns and no others, so that extra columns with clashing names do no harm."""
    return docs.select(*[F.col(f"`{n}`") for n in names])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text or binary array as one uint8 buffer and n + 1 offsets from 0; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    return data, ends - ends[0]


def runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows whose sizes add up to about `most` (a larger row stands alone)."""
    begin, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))
