"""What every operator of this subpackage needs from the session: shared scratch tables and connected components.

Scratch tables of an application lie in one folder below the one that all executors share. Operators discard those that
nothing will read again; what a returned DataFrame still reads goes with ``clear``, or when the driver ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable
from contextlib import contextmanager, suppress

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = 3 << 20


def bounded(spark: SparkSession) -> None:
    """Rows go to Python workers in batches of about one step of an operator, however long texts are.

    The setting stays in the session: what an operator returns is computed later. One that the user made smaller stands.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key)).removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Local mode may do without and gets one of its own."""
    own = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir()
    if hasattr(own, "isDefined"):
        own = own.get() if own.isDefined() else None
    if not own:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.sparkContext.setCheckpointDir(own)
    return own.rstrip("/")


_KNOWN: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    root = f"{shared_dir(spark)}/quillspark/{spark.sparkContext.applicationId}"
    if root not in _KNOWN:
        _KNOWN.add(root)
        atexit.register(_end, spark, root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete all scratch tables and files of this application: for when its results have been written elsewhere."""
    _delete(spark, scratch_root(spark))


def _end(spark: SparkSession, root: str) -> None:
    with suppress(Py4JError, OSError):  # the JVM may have gone before
        if spark.sparkContext._jsc is not None:
            _delete(spark, root)


@contextmanager
def _shuffles_removed(spark: SparkSession):
    """Shuffle files of the queries run inside go as soon as each has ended."""
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN_UP) if before is None else spark.conf.set(_CLEAN_UP, before)


def scratch(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with _shuffles_removed(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing will read again."""
    for table in tables:
        _delete(table.sparkSession, table.scratch_path)


def schema_with(fields: Iterable[T.StructField], more: str) -> T.StructType:
    """``fields`` as they are, whatever their names, and then those of a DDL string."""
    return T.StructType([*fields, *T.StructType.fromDDL(more)])


def carried(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, rest)``: all other columns in one struct, where their names clash with none of an operator's."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*rest).alias("rest"))


def restored(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that ``carried`` put away, in their order, with ``text`` as it is now."""
    return rows.select(*(F.col("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in columns))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links(a, b)`` -> ``(id, component)``: for every id in a link, the smallest id it can reach. Null ids have no links.

    Alternating large-star and small-star steps; each round is a map-side combined minimum and a join that adaptive
    execution can split, so neither a hub nor a long chain meets in one task. Rounds end when nothing changes.
    """
    edges = scratch(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc"
    )

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = state(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        grown = scratch(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct(), "cc")
        discard(edges)
        edges = grown
        after = state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    tops = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    out = edges.select(F.col("u").alias("id"), F.col("v").alias("component")).groupBy("id").agg(F.min("component").alias("component")).unionByName(tops)
    out = scratch(out, "components")
    discard(edges)
    return out
