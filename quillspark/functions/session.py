"""Session helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def _end(spark: SparkSession, path: str) -> None:
    with suppress(Py4JError, OSError):  # the JVM may have gone before
        if spark.sparkContext._jsc is not None:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of this application, which all executors share; local mode may do without and gets one of its own.

    It goes when the driver ends.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = context.getConf().get("spark.checkpoint.dir", None)
        if not named and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="quillspark-"))
    own = context._jsc.sc().getCheckpointDir().get()
    if own not in _KNOWN:
        _KNOWN.add(own)
        atexit.register(_end, spark, own)
    return own.rstrip("/")


_KNOWN: set[str] = set()
#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = 3 << 20


def shared_path(spark: SparkSession, label: str) -> str:
    """A new place in ``shared_dir``."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    return f"file://{path[5:]}" if path.startswith("file:/") and not path.startswith("file://") else path


def bounded(spark: SparkSession) -> None:
    """Rows go to Python workers in batches of ``BATCH_BYTES``, however large files are; a smaller setting of the user stands."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key)).removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the plan here, in the folder that all executors share."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``checkpoint`` and how many rows there are: the job that writes them counts them."""
    seen = Observation()
    cut = checkpoint(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return cut, seen.get["rows"]
