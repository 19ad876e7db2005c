"""What the operators of this subpackage share: the shared folder, written cuts, Arrow batch helpers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset (local tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tessella-")
    return _own[app]


_scopes: list[str] = []


def fresh(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing else uses; within a scope, one that ends with it."""
    return "/".join([shared_dir(spark), "tessella", *_scopes[-1:], f"{what}-{uuid.uuid4().hex}"])


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """What operators write within it is deleted at its end, so results must be written elsewhere or used by then."""
    _scopes.append(f"scope-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        delete(spark, f"{shared_dir(spark)}/tessella/{_scopes.pop()}")


def cut(df: DataFrame, what: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: cuts the lineage, computes once, and outlives lost executors."""
    spark = df.sparkSession
    path = fresh(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1_000, size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Batches in slices of so many rows and about so many bytes of text, so that no more are Python objects at a time.

    A longer text is a slice of its own. When the task ends, memory that its batches took goes back to the system.
    """
    try:
        for b in batches:
            weight = np.zeros(b.num_rows, np.int64)
            for c in b.columns:
                if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
                    weight += pc.fill_null(pc.binary_length(c), 0).to_numpy()
            total = np.cumsum(weight)
            at = 0
            while at < b.num_rows:
                end = int(np.searchsorted(total, (total[at - 1] if at else 0) + size, "right"))
                end = min(max(end, at + 1), at + rows, b.num_rows)
                yield b.slice(at, end - at)
                at = end
    finally:
        trim()


def trim() -> None:
    """Gives freed memory back to the system: workers are reused, and what one stage leaves would count against the next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """One output batch for each slice of the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield fn(b)

    return df.mapInArrow(run, schema)


def row_key(df: DataFrame) -> Column:
    """A hash of all columns of a row by name, nulls included: rows that differ, if only in where a null stands, have keys of their own."""

    def plain(c: Column, kind) -> Column:
        return F.to_json(F.struct(c.alias("x"))) if "map" in kind.simpleString() or "variant" in kind.simpleString() else c

    columns = [plain(F.col(f"`{f.name}`"), f.dataType) for f in df.schema]
    return F.xxhash64(*columns, F.array(*(F.col(f"`{f.name}`").isNull() for f in df.schema)))


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like those wanted that df does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for w in wanted:
        while w.lower() in taken:
            w += "_"
        taken.add(w.lower())
        out.append(w)
    return out


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def n_words(c: Column) -> Column:
    """Number of words of WORD in a text, null: 0. Each gap becomes one blank, so the count is that of blanks plus one."""
    body = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), GAP, " "))
    return F.when(body == "", F.lit(0)).otherwise(F.length(body) - F.length(F.translate(body, " ", "")) + 1).cast("long")


_HELD: dict[str, Callable[[], None]] = {}


def take_over(name: str, clear: Callable[[], None]) -> None:
    """Called in a Python worker by the operator that runs there: caches of other operators, left from earlier stages, go."""
    for other in [k for k in _HELD if k != name]:
        _HELD.pop(other)()
    _HELD[name] = clear


def unsigned_mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
