"""Keeping a store current with Structured Streaming.

``watch`` runs an incremental cycle at each tick: a stream of files sees neither changes nor deletions, a cycle does.
``stream_documents`` is for folders that only ever get new files: each micro-batch is parsed and loaded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.functions import session
from quillspark.functions.embed import Embedder
from quillspark.operators.documents import parse
from quillspark.plans import ingest
from quillspark.sources.config import Source
from quillspark.sources.store import Change, Store


class Progress:
    """What a watch has done: ``state`` is idle, running, or failed; ``last`` are the metrics of the last cycle."""

    def __init__(self):
        self.state, self.cycles, self.last, self.error = "idle", 0, ingest.Metrics(), ""


def watch(store: Store, sources: Sequence[Source], embedder: Embedder | None = None, every: str = "60 seconds", progress: Progress | None = None) -> StreamingQuery:
    """Sync ``sources`` at every tick until the query is stopped."""
    told = progress or Progress()

    def cycle(_: DataFrame, __: int) -> None:
        told.state = "running"
        try:
            told.last = ingest.sync_all({"": store}, {"": list(sources)}, embedder)
            told.state, told.cycles, told.error = "idle", told.cycles + 1, ""
        except Exception as e:
            told.state, told.error = "failed", str(e)
            raise

    clock = store.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(cycle).trigger(processingTime=every).start()


def stream_documents(spark: SparkSession, folder: str, source_id: str) -> DataFrame:
    """New files of a folder as parsed documents, each once; they are named by their path from the folder."""
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(folder)
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath().rstrip("/") + "/"
    path = F.url_decode(F.regexp_replace(F.regexp_replace("_metadata.file_path", r"^[a-z0-9]+:(//[^/]*)?(?=/)", ""), r"\+", "%2B"))
    name = F.when(F.startswith(path, F.lit(root)), F.substr(path, F.lit(len(root) + 1))).otherwise(path)
    return parse(files.select(F.lit(source_id).alias("source_id"), name.alias("fs_rel"), F.encode("value", "UTF-8").alias("raw")))


def load_stream(store: Store, parsed: DataFrame, source: Source, checkpoint: str, embedder: Embedder | None = None) -> StreamingQuery:
    """Load each micro-batch of ``parsed`` into the store; a batch that is run again writes the same rows again.

    A document replaces the chunks, links and code that its path had. What a batch writes is in proportion to the batch.
    Loaded files are remembered with the time of loading, so that a later cycle over the same folder knows them. Where
    several files of a batch have one path, rows with equal keys are those of the last in the order of their names.
    """

    def load(batch: DataFrame, _: int) -> None:
        with store.lock():
            old = ingest._own(store, source.id)
            good = session.checkpoint(batch.where("error IS NULL"))
            now = good.select("source_id", "fs_rel", F.unix_timestamp().alias("mtime"), F.col("path").alias("contract_path"))
            tables = ingest._changes(old, good, good.select("source_id", "path"), embedder)
            ingest._commit(store, source, tables, Change(now, now.select(F.col("fs_rel").alias("key"))), whole=store.outdated(source.id))

    return parsed.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
