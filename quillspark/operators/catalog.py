"""Lookups and counts over the tables of one or several stores (rows tagged with ``store_idx``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The order in which a document is read.
READING = ["source_id", "position", "char_offset", "chunk_id"]


def first_store_wins(rows: DataFrame, key: str) -> DataFrame:
    """Of rows with one key, that of the first store (within a store keys are unique)."""
    columns = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*columns), F.col("store_idx")).alias("_row")).select(key, "_row.*").select(*rows.columns)


def list_sources(sources: DataFrame) -> DataFrame:
    return first_store_wins(sources, "source_id").orderBy("source_id")


def get_chunk(chunks: DataFrame, chunk_id: str) -> DataFrame:
    return chunks.where(F.col("chunk_id") == chunk_id).orderBy("store_idx").limit(1)


def get_document(chunks: DataFrame, path: str, source_id: str | None = None) -> DataFrame:
    """The chunks at a path in reading order, each chunk once; a source filter acts on what is left."""
    found = first_store_wins(chunks.where(F.col("path") == path), "chunk_id")
    source = (source_id or "").strip()
    return (found.where(F.col("source_id") == source) if source else found).orderBy(*READING)


def chunks_of_source(chunks: DataFrame, source_id: str) -> DataFrame:
    return chunks.where(F.col("source_id") == source_id).orderBy("path", "position")


def chunks_at_path(chunks: DataFrame, path: str) -> DataFrame:
    return chunks.where(F.col("path") == path).orderBy("position", "chunk_id")


def chunks_per_source(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source_id").agg(F.count("*").alias("n_chunks"))


def status(sources: DataFrame, chunks: DataFrame, versions: DataFrame) -> DataFrame:
    """One row: sources and chunks of all stores added up, and the highest layout version; zeros without stores."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    version = versions.agg(F.coalesce(F.max("schema_version"), F.lit(0)).cast("long").alias("schema_version"))
    return count(sources, "source_count").crossJoin(count(chunks, "chunk_count")).crossJoin(version)


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with one key, the last one in ``order``. A pre-aggregated maximum: no key's rows meet in one sort."""
    columns = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.col(order)).alias("_row")).select(*keys, "_row.*").select(*rows.columns)


def vectors_of(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """``(chunk_id, embedding)`` of ``ids(chunk_id)``: those that are there and have one."""
    found = chunks.where("embedding IS NOT NULL").select("chunk_id", "embedding")
    return found.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")


def paths_of_several_sources(chunks: DataFrame) -> DataFrame:
    """``(path, n_sources)`` of documents whose path more than one source has taken in."""
    return chunks.groupBy("path").agg(F.count_distinct("source_id").alias("n_sources")).where("n_sources > 1")
