"""Session helpers: a tuned local session, and shipping this package to Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Bytes of an Arrow batch, so that rows with long texts don't fill a worker's memory ten thousand at a time.
ARROW_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "8000000")


def local_session(app: str = "tessella", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session as tests and the benchmark use it. AQE is on, so shuffles shrink to the data."""
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    return SparkSession.builder.master(f"local[{cpus}]").appName(app).config(map=base | conf).getOrCreate()


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the folder that driver and executors share: that of spark.checkpoint.dir, or one of our own where that is unset (local masters only)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tessella-")
    return f"{named.rstrip('/')}/tessella/{what}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> SparkSession:
    """Gives executors this package, once for each application, so that its functions can be unpickled by name there.

    Bounds Arrow batches by bytes as well, unless the application's configuration does.
    """
    sc = spark.sparkContext
    if not sc.getConf().contains(ARROW_BYTES[0]):
        spark.conf.set(*ARROW_BYTES)
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[1]
        path = os.path.join(tempfile.mkdtemp(prefix="tessella-ship-"), "tessella.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(p.relative_to(root.parent)))
        sc.addPyFile(path)
        _shipped.add(sc.applicationId)
    return spark
