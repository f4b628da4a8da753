"""Read-through tables, bundles of named values, and a JSON codec for configurations."""

from __future__ import annotations

import enum
import hashlib
import io
import json
import uuid
import zipfile
from collections.abc import Callable
from dataclasses import asdict, dataclass, is_dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table that was written to its end is there (its commit leaves a _SUCCESS file)."""
    fs, p = _fs(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def read_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame], *, partition_by: list[str] = ()) -> DataFrame:
    """The table at path, built and written first where it is missing. What is returned is always read back."""
    if not exists(spark, path):
        writer = build().write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.parquet(path)


def read_or_build_all(spark: SparkSession, tables: dict[str, Callable[[], DataFrame]]) -> dict[str, DataFrame]:
    """Several tables by path; if one is missing, all are built anew so that they fit together."""
    if not all(exists(spark, p) for p in tables):
        for p, build in tables.items():
            build().write.mode("overwrite").parquet(p)
    return {p: spark.read.parquet(p) for p in tables}


class Codec:
    """JSON with registered enums as {"__enum__": "Class.MEMBER"}; numpy scalars and arrays become plain numbers."""

    def __init__(self):
        self.enums: dict[str, type[enum.Enum]] = {}

    def register(self, kind: type[enum.Enum]) -> type[enum.Enum]:
        if self.enums.get(kind.__name__, kind) is not kind:
            raise ValueError(f"an enum named {kind.__name__} is registered already")
        self.enums[kind.__name__] = kind
        return kind

    def _out(self, value):
        if isinstance(value, enum.Enum):
            if type(value).__name__ not in self.enums:
                raise TypeError(f"{type(value).__name__} is not registered")
            return {"__enum__": f"{type(value).__name__}.{value.name}"}
        if is_dataclass(value) and not isinstance(value, type):
            return {k: self._out(v) for k, v in asdict(value).items()}
        if isinstance(value, dict):
            return {str(k): self._out(v) for k, v in value.items()}
        if isinstance(value, list | tuple):
            return [self._out(v) for v in value]
        if hasattr(value, "tolist"):
            return value.tolist()
        return value

    def dumps(self, value) -> str:
        return json.dumps(self._out(value), sort_keys=True)

    def loads(self, text: str):
        def back(d: dict):
            if set(d) == {"__enum__"}:
                kind, _, member = d["__enum__"].partition(".")
                return self.enums[kind][member]
            return d

        return json.loads(text, object_hook=back)


def digest(config) -> str:
    """SHA-256 of a configuration in canonical JSON."""
    return hashlib.sha256(Codec().dumps(config).encode()).hexdigest()


@dataclass(frozen=True)
class Matrix:
    """A sparse matrix: its cells (u, i, r) and its shape, which empty rows and columns count in."""

    cells: DataFrame
    shape: tuple[int, int]


def _array_table(spark: SparkSession, values: dict[str, np.ndarray]) -> DataFrame:
    """key, pos, value of arrays in driver memory, flattened; numbers become doubles or longs, all else text."""
    parts = []
    for key, x in values.items():
        flat = np.asarray(x).ravel()
        number = flat.dtype.kind in "iub"
        columns = {"key": [key] * len(flat), "pos": np.arange(len(flat)), "whole": None, "real": None, "text": None}
        columns["whole" if number else "real" if flat.dtype.kind == "f" else "text"] = flat.astype(np.int64) if number else flat.astype(float) if flat.dtype.kind == "f" else flat.astype(str)
        kinds = (("key", pa.string()), ("pos", pa.int64()), ("whole", pa.int64()), ("real", pa.float64()), ("text", pa.string()))
        parts.append(pa.table({n: pa.nulls(len(flat), t) if columns[n] is None else pa.array(columns[n], t) for n, t in kinds}))
    return spark.createDataFrame(pa.concat_tables(parts))


class Bundle:
    """A folder of named tables, matrices, arrays and JSON values with a manifest.

    A bundle is written beside its place and moved there when it is whole, so readers see the old one or the new one.
    """

    def __init__(self, spark: SparkSession, path: str, codec: Codec | None = None):
        self.spark, self.path, self.codec = spark, path.rstrip("/"), codec or Codec()

    def save(self, values: dict[str, object]) -> None:
        """DataFrames become Parquet tables, matrices tables with a shape, numpy arrays and dicts of arrays tables of their
        values, other dicts nested bundles, everything else JSON. Names may not start with a dot or an underscore.
        """
        for name in values:
            if name.startswith((".", "_")) or "/" in name:
                raise ValueError(f"{name!r} is no name for a value")
        beside = f"{self.path}.new-{uuid.uuid4().hex}"
        Bundle(self.spark, beside, self.codec)._write(values)
        fs, new = _fs(self.spark, beside)
        _, at = _fs(self.spark, self.path)
        _, old = _fs(self.spark, f"{self.path}.old-{uuid.uuid4().hex}")
        had = fs.exists(at)
        if had and not fs.rename(at, old):
            raise OSError(f"{self.path} can't be replaced")
        fs.mkdirs(at.getParent())
        if not fs.rename(new, at):
            raise OSError(f"{self.path} can't be written")
        if had:
            fs.delete(old, True)

    def _write(self, values: dict[str, object]) -> None:
        kinds = {}
        for name, value in values.items():
            at = f"{self.path}/{name}"
            if isinstance(value, DataFrame):
                value.write.parquet(at)
                kinds[name] = {"kind": "table"}
            elif isinstance(value, Matrix):
                value.cells.write.parquet(at)
                kinds[name] = {"kind": "matrix", "shape": list(value.shape)}
            elif isinstance(value, np.ndarray) or (isinstance(value, dict) and value and all(isinstance(v, np.ndarray) for v in value.values())):
                arrays = value if isinstance(value, dict) else {"": value}
                _array_table(self.spark, arrays).write.parquet(at)
                kinds[name] = {"kind": "arrays" if isinstance(value, dict) else "array", "of": {k: [v.dtype.str, list(v.shape)] for k, v in arrays.items()}}
            elif isinstance(value, dict) and any(isinstance(v, DataFrame | Matrix | dict | np.ndarray) for v in value.values()):
                Bundle(self.spark, at, self.codec)._write(value)
                kinds[name] = {"kind": "bundle"}
            else:
                kinds[name] = {"kind": "json", "value": self.codec.dumps(value)}
        row = self.spark.createDataFrame([(json.dumps(kinds),)], "value string")
        row.coalesce(1).write.text(f"{self.path}/_manifest")

    def manifest(self) -> dict[str, dict]:
        if not exists(self.spark, f"{self.path}/_manifest"):
            raise FileNotFoundError(self.path)
        return json.loads(self.spark.read.text(f"{self.path}/_manifest").first()[0])

    def get(self, name: str, kind: dict | None = None) -> object:
        """One value; tables are read when they are used."""
        known = kind or self.manifest().get(name)
        if known is None:
            raise FileNotFoundError(f"{self.path}/{name}")
        at = f"{self.path}/{name}"
        if known["kind"] == "table":
            return self.spark.read.parquet(at)
        if known["kind"] == "matrix":
            return Matrix(self.spark.read.parquet(at), tuple(known["shape"]))
        if known["kind"] in ("array", "arrays"):
            rows = self.spark.read.parquet(at).orderBy("key", "pos").toArrow()  # it was in the driver's memory when it was saved
            out = {}
            for key, (dtype, shape) in known["of"].items():
                own = rows.filter(pc.equal(rows["key"], key))
                column = {"f": "real"}.get(np.dtype(dtype).kind, "whole" if np.dtype(dtype).kind in "iub" else "text")
                out[key] = np.array(own[column].to_pylist()).astype(dtype).reshape(shape)
            return out if known["kind"] == "arrays" else out[""]
        if known["kind"] == "bundle":
            return Bundle(self.spark, at, self.codec).load()
        return self.codec.loads(known["value"])

    def load(self) -> dict[str, object]:
        return {name: self.get(name, kind) for name, kind in self.manifest().items()}

    def save_config(self, config) -> str:
        """Write a configuration and its digest once; a second call changes nothing."""
        at = f"{self.path}/config-{digest(config)}"
        if not exists(self.spark, at):
            self.spark.createDataFrame([(self.codec.dumps(config), digest(config))], "config string, sha256 string").coalesce(1).write.mode("overwrite").json(at)
        return digest(config)


def _npz(spark: SparkSession, path: str) -> DataFrame:
    """key, pos, value of the arrays in .npy, .npz or zipped .npy files; a sparse matrix saved as npz gives u, i, r.

    Every file is read by one task, without pickles.
    """

    def run(batches):
        for b in batches:
            for content in b.column(0):
                raw = content.as_py()
                if raw[:2] == b"PK":
                    with np.load(io.BytesIO(raw), allow_pickle=False) as z:
                        arrays = {k: z[k] for k in z.files}
                else:
                    arrays = {"": np.load(io.BytesIO(raw), allow_pickle=False)}
                for key, x in arrays.items():
                    flat = x.ravel()
                    real = flat.dtype.kind in "iufb"
                    for low in range(0, len(flat), 1 << 16):
                        part = flat[low : low + (1 << 16)]
                        none = pa.nulls(len(part), pa.string() if real else pa.float64())
                        values = [pa.array(part.astype(float)), none] if real else [none, pa.array(part.astype(str))]
                        yield pa.RecordBatch.from_arrays([pa.array([key] * len(part)), pa.array(np.arange(low, low + len(part))), *values], names=["key", "pos", "value", "text"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "key string, pos bigint, value double, text string")


def sparse_from_arrays(arrays: DataFrame) -> Matrix:
    """A matrix saved as the arrays of its compressed rows (indptr, indices, data, shape), as `read_any` reads them."""
    of = lambda key, name: arrays.where(F.col("key") == key).select("pos", F.col("value").alias(name))
    shape = tuple(int(r[0]) for r in of("shape", "n").orderBy("pos").select("n").collect())  # two numbers
    starts = of("indptr", "begin").join(of("indptr", "end").withColumn("pos", F.col("pos") - 1), "pos").where("begin < end")
    places = starts.select(F.col("pos").alias("u"), F.explode(F.sequence(F.col("begin").cast("bigint"), F.col("end").cast("bigint") - 1)).alias("pos"))
    cells = places.join(of("indices", "i"), "pos").join(of("data", "r"), "pos")
    return Matrix(cells.select("u", F.col("i").cast("bigint").alias("i"), "r"), shape)


def _zipped(spark: SparkSession, path: str) -> DataFrame:
    """name and content of the files in archives; hidden ones are left out."""

    def run(batches):
        for b in batches:
            for content in b.column(0):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for name in z.namelist():
                        if not name.rpartition("/")[2].startswith(".") and not name.endswith("/"):
                            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([z.read(name)], pa.binary())], names=["name", "content"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "name string, content binary")


def _hdf(spark: SparkSession, path: str) -> DataFrame:
    try:
        import h5py
    except ImportError:
        raise ValueError("reading HDF5 needs the h5py library") from None

    def run(batches):
        for b in batches:
            for content in b.column(0):
                with h5py.File(io.BytesIO(content.as_py())) as f:
                    found = []
                    f.visititems(lambda n, x: found.append((n, x[()])) if isinstance(x, h5py.Dataset) else None)  # noqa: B023
                for key, x in found:
                    flat = np.asarray(x).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(flat)), pa.array(np.arange(len(flat))), pa.array(flat.astype(float)), pa.nulls(len(flat), pa.string())], names=["key", "pos", "value", "text"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "key string, pos bigint, value double, text string")


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A table by its file name's ending: parquet, csv, json, npy, npz, zip, h5; an unknown ending is an error."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "csv":
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    if kind == "json":
        return spark.read.json(path)
    readers = {"npy": _npz, "npz": _npz, "zip": _zipped, "h5": _hdf, "hdf5": _hdf}
    if kind not in readers:
        raise ValueError(f"no reader for .{kind}")
    return readers[kind](spark, path)
