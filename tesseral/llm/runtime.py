"""What every operator of this subpackage needs from the session.

Lineage is cut with ``checkpoint()`` into the folder that ``spark.checkpoint.dir`` names, which all
executors share; only where that setting is missing (tests, a laptop) a temporary folder is used.
"""

from __future__ import annotations

import gc
import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
#: In a Python worker: what to call to forget remembered words and tables, and whose they are.
FORGET: list = []
_OWNER = [""]


def enter(owner: str) -> None:
    """At the start of a task: a worker that turns to another operator forgets what the last one remembered."""
    if _OWNER[0] != owner:
        _OWNER[0] = owner
        for forget in FORGET:
            forget()
        gc.collect()
        trim()


def trim() -> None:
    """Gives memory that is free in this process back to the machine."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: it keeps its own counsel


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.dirname(root)
    to = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{os.path.basename(root)}_code.zip")
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    p = os.path.join(at, n)
                    z.write(p, os.path.relpath(p, base))
    sc.addPyFile(to)
    if "spark.sql.execution.arrow.maxRecordsPerBatch" not in dict(sc.getConf().getAll()):
        # whole texts cross to Python: batches of some MB rather than ten thousand rows
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. A local session that names none gets a temporary one; on a cluster that is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computed once, read again from the shared folder, removed with its last user."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps now; Spark drops them with the driver's last reference."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str | Column = "text") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string"), F.lit(""))
