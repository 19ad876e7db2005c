"""A ledger of model calls: what was paid for is kept, whatever happens to executors or runs.

A call is known by the digest of its stage, attempt, prompt and film. Rows whose call has a reply already are answered
from the ledger; the different calls that are left are dealt over shards and asked in small batches. A worker appends the
replies of each batch to its shard, under a name that readers do not see until it is whole, before it asks on. A task that
runs again, on whatever executor and in whatever run, reads its shard first and asks only what has no reply. So a call is
repeated only if its worker dies between the reply and the append. (Speculative execution should be off: it runs a task
twice at a time.) Errors are kept as well, but do not count as replies: the next run asks again.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .trace import Trace

Replies = Callable[[list[str], list[str]], list[str]]
RETRIES, TIMEOUT_S = 1, 60
CALLS = "key string, name string, reply string, error string, seconds double, input_chars long, output_chars long, at double"
_ARROW = pa.schema([(c.split()[0], {"string": pa.string(), "double": pa.float64(), "long": pa.int64()}[c.split()[1]]) for c in CALLS.split(", ")])


def ask(client: Replies, prompts: list[str], paths: list[str], timeout: float = TIMEOUT_S, retries: int = RETRIES) -> tuple[list[str | None], str | None]:
    """Replies to a batch, or its error: one that fails, takes over timeout seconds a prompt or has the wrong length is tried once more."""
    error = None
    for _ in range(retries + 1):
        pool = ThreadPoolExecutor(1)
        try:
            out = list(pool.submit(client, prompts, paths).result(timeout * len(prompts)))
            if len(out) != len(prompts):
                raise ValueError(f"{len(out)} replies to {len(prompts)} prompts")
            return out, None
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
        finally:
            pool.shutdown(wait=False, cancel_futures=True)
    return [None] * len(prompts), error


def _shard(root: str, shard: int) -> tuple[pyarrow.fs.FileSystem, str]:
    fs, path = pyarrow.fs.FileSystem.from_uri(root)
    path = f"{path}/shard={shard}"
    fs.create_dir(path, recursive=True)
    return fs, path


def _kept(fs: pyarrow.fs.FileSystem, path: str) -> set[str]:
    """Keys of a shard that have replies."""
    out: set[str] = set()
    for f in fs.get_file_info(pyarrow.fs.FileSelector(path)):
        if f.base_name.startswith("part-"):
            t = pq.read_table(f.path, columns=["key", "reply"], filesystem=fs, partitioning=None)
            out |= {k for k, r in zip(t["key"].to_pylist(), t["reply"].to_pylist()) if r is not None}
    return out


class Ledger:
    """root: a folder that driver and executors share; batch: calls between two appends."""

    def __init__(self, spark: SparkSession, root: str, shards: int = 64, batch: int = 8, trace: Trace | None = None):
        self.spark, self.root, self.shards, self.batch, self.trace = spark, root if "://" in root else f"file://{root}", shards, batch, trace
        self._folder()

    def _folder(self, *inner: str) -> str:
        path = "/".join([self.root, *inner])
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(where)
        return path

    def read(self) -> DataFrame:
        """Every call."""
        return self.spark.read.schema(f"{CALLS}, stage string, attempt int, shard int").parquet(self.root)

    def replies(self, folder: str) -> DataFrame:
        """key, reply, error of the calls in a folder: the reply of each, or its last error where it has none.

        A stage and attempt have a folder of their own: a plan that holds two scans of one folder takes them for equal,
        even if replies came between them.
        """
        best = F.max(F.struct(F.col("reply").isNotNull().alias("ok"), "at", "reply", "error"))
        return self.spark.read.schema(CALLS).parquet(folder).groupBy("key").agg(best.alias("x")).select("key", "x.reply", F.when(~F.col("x.ok"), F.col("x.error")).alias("error"))

    def answered(self, rows: DataFrame, client: Replies, prompt: Column, image: Column, name: str = "model", attempt: int = 1, timeout: float = TIMEOUT_S) -> DataFrame:
        """rows with said (reply and error). Rows of one prompt and film share a call."""
        text, film = F.coalesce(prompt, F.lit("")), F.coalesce(image, F.lit(""))
        keyed = rows.withColumn("_key", F.sha2(F.concat_ws("\x1f", F.lit(name), F.lit(attempt), text, film), 256))
        folder = self._folder(f"stage={name}", f"attempt={attempt}")
        known = self.replies(folder).where("reply IS NOT NULL").select(F.col("key").alias("_key"))
        left = keyed.select("_key", text.alias("prompt"), film.alias("film")).dropDuplicates(["_key"]).join(known, "_key", "left_anti")
        left = left.withColumn("shard", F.pmod(F.xxhash64("_key"), F.lit(self.shards)).cast("int"))
        size = self.batch

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            kept: dict[int, set[str]] = {}
            for b in batches:
                for shard, own in b.groupby("shard", sort=True):
                    fs, path = _shard(folder, shard)
                    if shard not in kept:
                        kept[shard] = _kept(fs, path)
                    todo = own[~own["_key"].isin(kept[shard])]
                    for at in range(0, len(todo), size):
                        some = todo.iloc[at : at + size]
                        prompts, began = some["prompt"].tolist(), time.perf_counter()
                        said, error = ask(client, prompts, some["film"].tolist(), timeout)
                        each = (time.perf_counter() - began) / len(prompts)
                        out = pd.DataFrame({"key": some["_key"].to_numpy(), "name": name, "reply": pd.Series(said, dtype=object), "error": pd.Series([error] * len(prompts), dtype=object), "seconds": each, "input_chars": [len(x) for x in prompts], "output_chars": [len(x or "") for x in said], "at": time.time()})
                        hidden = f"{path}/.part-{uuid.uuid4().hex}.parquet"
                        pq.write_table(pa.Table.from_pandas(out, _ARROW, preserve_index=False), hidden, filesystem=fs)
                        fs.move(hidden, hidden.replace("/.part-", "/part-"))
                        yield out

        asked = left.repartition(self.shards, "shard").mapInPandas(run, CALLS)
        if self.trace is not None:
            asked = self.trace.watch(asked, name, F.coalesce("error", "reply"), seconds=F.col("seconds"), errors=F.col("error").isNotNull().cast("int"), input_chars=F.col("input_chars"), output_chars=F.col("output_chars"))
        asked.write.format("noop").mode("overwrite").save()
        said = self.replies(folder).select(F.col("key").alias("_key"), F.struct("reply", "error").alias("said"))
        return keyed.join(said, "_key", "left").drop("_key")
