"""Helpers shared by the corpus operators: scratch tables, Arrow streaming, hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions.arrow import short


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def only_texts(docs: DataFrame) -> DataFrame:
    """doc_id (long) and text. Without a needless cast, two uses of it in one plan are alike and share an exchange."""
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id" if kind == "bigint" else F.col("doc_id").cast("long").alias("doc_id"), "text")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


class Scratch:
    """Intermediate tables as Parquet in the folder that the cluster names in spark.checkpoint.dir.

    Tables there survive lost executors and cut lineage. ``drop`` removes one that is no longer read.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        top = spark.conf.get("spark.checkpoint.dir", None)
        if not top:
            top = tempfile.mkdtemp(prefix="turnloom-")
            spark.conf.set("spark.checkpoint.dir", top) if spark.conf.isModifiable("spark.checkpoint.dir") else None
        self.root = f"{top.rstrip('/')}/turnloom-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame) -> str:
        self.n += 1
        path = f"{self.root}/t{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        return path

    def keep(self, df: DataFrame) -> DataFrame:
        """The same rows, read back from a written table."""
        schema = df.schema
        return self.spark.read.schema(schema).parquet(self.write(df))

    def drop(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def _arrow(kind: str) -> pa.DataType:
    fixed = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "byte": pa.int8()}
    if kind.startswith("array<"):
        return pa.list_(_arrow(kind[6:-1]))
    return fixed[kind]


def arrow_types(schema: str) -> dict[str, pa.DataType]:
    return {x.strip().split()[0]: _arrow(x.strip().split()[1]) for x in schema.split(",")}


def record(columns: dict, types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x := columns[k], pa.Array) else pa.array(x, type=t) for k, t in types.items()], names=list(types))


def text_bytes(b: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The column's texts as UTF-8, null as empty."""
    return [x or b"" for x in b.column(name).cast(pa.binary()).to_pylist()]


def held_out(doc_id, modulus: int, rest: int):
    """Whether crc32 of the id as text leaves ``rest``; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == rest, F.lit(False))


M1 = np.uint64(0xBF58476D1CE4E5B9)
M2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * M1
    x = x ^ (x >> np.uint64(27))
    x = x * M2
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    x = 1
    for i in range(n):
        out[i] = x
        x = x * base % (1 << 64)
    return out


def window_hash(units: np.ndarray, width: int, base: int) -> np.ndarray:
    """A 64-bit polynomial hash of each ``width`` consecutive units (uint64, already scrambled)."""
    n = len(units) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    b = np.uint64(base)
    for k in range(width):
        out *= b
        out += units[k : k + n]
    return mix(out)


def rewritten(docs: DataFrame, table: DataFrame, change: Callable[..., bytes]) -> DataFrame:
    """``docs`` with text replaced by change(text, *columns of ``table`` from _tl_ on), joined by doc_id; n_chars, if there, follows.

    Rows that ``table`` does not have, or that come out as they were, keep their text, null included. All other columns stay as they are.
    """
    names = [c for c in table.columns if c.startswith("_tl_")]
    key = table.withColumnRenamed("doc_id", "_tl_doc")
    both = docs.join(key, docs["doc_id"] == key["_tl_doc"], "left").drop("_tl_doc")
    fields = docs.schema

    def run(batches):
        for b in short(batches):
            old = b.column("text").to_pylist()
            new = []
            for t, *x in zip(old, *(b.column(c).to_pylist() for c in names), strict=True):
                if t is None or x[0] is None:
                    new.append(t)
                else:
                    new.append(change(t.encode(), *x).decode("utf-8", "replace"))
            own = {f.name: b.column(f.name) for f in fields}
            own["text"] = pa.array(new, own["text"].type)
            if "n_chars" in own:
                own["n_chars"] = pa.array([c if t is n or t == n else len(n) for t, n, c in zip(old, new, own["n_chars"].to_pylist(), strict=True)], own["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(own.values()), names=list(own))

    return both.mapInArrow(run, fields)
