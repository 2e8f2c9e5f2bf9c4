"""Keyed writes as DataFrames: upserts, vectors, deletions with all that depends on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.catalog import last_wins


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with their key; of equal keys in ``new`` the last in ``order``."""
    fresh = last_wins(new, keys, order).drop(order) if order else new
    return old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh.select(*old.columns))


def upsert_chunks(old: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """As ``upsert``; a chunk that comes without an embedding keeps the one it had."""
    fresh = last_wins(new, ["chunk_id"], order).drop(order) if order else new
    had = old.where("embedding IS NOT NULL").select("chunk_id", F.col("embedding").alias("_had"))
    fresh = fresh.join(had, "chunk_id", "left").withColumn("embedding", F.coalesce("embedding", "_had")).drop("_had")
    return upsert(old, fresh, ["chunk_id"])


def put_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Set the embeddings of ``vectors(chunk_id, embedding)``; ids without a chunk do nothing."""
    given = vectors.select("chunk_id", F.col("embedding").alias("_new"))
    return chunks.join(given, "chunk_id", "left").withColumn("embedding", F.coalesce("_new", "embedding")).select(*chunks.columns)


def put_attempts(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row ``(attempted, stored)``: how many vectors were given, and how many of them have a chunk."""
    known = chunks.select("chunk_id").distinct().withColumn("_has", F.lit(True))
    return vectors.join(known, "chunk_id", "left").agg(F.count("*").alias("attempted"), F.count("_has").alias("stored"))


def null_vectors(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Chunks of ``ids(chunk_id)`` lose their embedding."""
    gone = ids.select("chunk_id").distinct().withColumn("_gone", F.lit(True))
    none = F.when(F.col("_gone"), F.lit(None)).otherwise(F.col("embedding"))
    return chunks.join(gone, "chunk_id", "left").withColumn("embedding", none).select(*chunks.columns)


def chunks_of_documents(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """``(chunk_id)`` of the chunks at ``gone(path)`` or ``gone(source_id, path)``: what ``delete_documents`` deletes."""
    keys = [c for c in ("source_id", "path") if c in gone.columns]
    return chunks.join(gone.select(*keys).distinct(), keys, "left_semi").select("chunk_id").distinct()


def delete_documents(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """``tables`` without the chunks at ``gone(path)`` or ``gone(source_id, path)`` and what depends on them."""
    return delete_chunks(tables, chunks_of_documents(tables["chunks"], gone))


def delete_chunks(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    without = lambda df, c="chunk_id": df.join(ids.withColumnRenamed("chunk_id", c), c, "left_anti").select(*df.columns)
    return tables | {
        "chunks": without(tables["chunks"]),
        "edges": without(tables["edges"], "src_chunk_id"),
        "code": without(tables["code"]),
        "urls": without(tables["urls"]),
    }


def url_collisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Canonical URLs that ``new`` takes from another chunk: ``(canonical_url, old_chunk_id, new_chunk_id)``."""
    a, b = old.select("canonical_url", F.col("chunk_id").alias("old_chunk_id")), new.select("canonical_url", F.col("chunk_id").alias("new_chunk_id"))
    return a.join(b, "canonical_url").where("old_chunk_id <> new_chunk_id")
