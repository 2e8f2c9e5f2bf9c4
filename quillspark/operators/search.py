"""Keyword and vector search over one or several stores.

Stores are rows tagged with ``store_idx``. Results of several stores are merged in turns: the first of every store, then
the second of every store, and so on, each chunk once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.exprs import cosine_distance, includes
from quillspark.functions.session import checkpoint

TOP_K, MOST = 10, 50


def clamp(wanted: int, most: int = MOST) -> int:
    return max(0, min(wanted, most))


def keyword_hits(chunks: DataFrame, query: str) -> DataFrame:
    """Chunks whose content holds the query, whatever the case."""
    return chunks.where(includes(F.col("content"), query))


def scored(chunks: DataFrame, vector: Sequence[float]) -> DataFrame:
    """All chunks that have a cosine ``distance`` from the vector, in no order.

    Distances are rounded to six places, below which single-precision vectors do not tell anything.
    """
    return chunks.where("embedding IS NOT NULL").withColumn("distance", F.round(cosine_distance(F.col("embedding"), vector), 6)).where("distance IS NOT NULL")


def nearest(chunks: DataFrame, vector: Sequence[float], k: int, by_store: bool = False) -> DataFrame:
    """The exact ``k`` nearest chunks by cosine distance (of each store), with ``distance``; ties by ``chunk_id``."""
    found = scored(chunks, vector)
    if not by_store:
        return found.orderBy("distance", "chunk_id").limit(k)
    rank = F.row_number().over(Window.partitionBy("store_idx").orderBy("distance", "chunk_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


#: Leading characters of a chunk's id that make a stretch of the order.
STRETCH = 3


def ranked(hits: DataFrame) -> DataFrame:
    """``hits`` with ``rn``, their place by ``chunk_id`` among all hits of their store, without one task for a store.

    Ids with the same first characters make a stretch; places within a stretch go on from the number of hits before it.
    """
    hits = hits.withColumn("_stretch", F.substring("chunk_id", 1, STRETCH))
    counts = hits.groupBy("store_idx", "_stretch").count()
    before = F.sum("count").over(Window.partitionBy("store_idx").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("store_idx", "_stretch", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("store_idx", "_stretch").orderBy("chunk_id"))
    out = hits.withColumn("_inside", inside).join(counts, ["store_idx", "_stretch"])
    return out.withColumn("rn", (F.col("_before") + F.col("_inside")).cast("int")).drop("_before", "_inside", "_stretch")


def round_robin(hits: DataFrame, order: Sequence[str] = ("chunk_id",), limit: int | None = None) -> DataFrame:
    """``hits`` with the place ``rn`` in their store's list, each ``chunk_id`` at its first turn only.

    With a limit only the first ``limit`` of each store are ranked: after r turns at least r different chunks are out.
    Without one they are in the order of ``chunk_id``.
    """
    if limit is None:
        places = ranked(hits)
    else:
        place = F.row_number().over(Window.partitionBy("store_idx").orderBy(*order))
        places = hits.withColumn("rn", place).where(F.col("rn") <= limit)
    first = F.row_number().over(Window.partitionBy("chunk_id").orderBy("rn", "store_idx"))
    merged = places.withColumn("_turn", first).where("_turn = 1").drop("_turn")
    return merged.orderBy("rn", "store_idx").limit(limit) if limit is not None else merged


def first_of_source(hits: DataFrame, source_id: str, k: int) -> DataFrame:
    """The first ``k`` hits of a source in the merged list of all hits, with their places in it.

    Only the first ``k`` of the source in each store can be among them, and only their places are told: hits are counted by
    stretch, and within the stretches of those few they are held against them. Nothing is ordered but those few.
    """
    keys = checkpoint(hits.select("chunk_id", "source_id", "store_idx", F.substring("chunk_id", 1, STRETCH).alias("_stretch")))
    place = F.row_number().over(Window.partitionBy("store_idx").orderBy("chunk_id"))
    few = checkpoint(keys.where(F.col("source_id") == source_id).distinct().withColumn("_place", place).where(F.col("_place") <= k).drop("_place", "source_id"))
    counts = keys.groupBy("store_idx", "_stretch").count()
    before = F.sum("count").over(Window.partitionBy("store_idx").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("store_idx", "_stretch", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.broadcast(few)  # k rows a store
    inside = keys.select(F.col("chunk_id").alias("_other"), "store_idx", "_stretch").join(own, ["store_idx", "_stretch"]).where("_other <= chunk_id")
    inside = inside.groupBy("store_idx", "_stretch", "chunk_id").agg((F.count_if(F.col("_other") < F.col("chunk_id")) + 1).alias("_inside"))
    places = inside.join(counts, ["store_idx", "_stretch"]).select("store_idx", "chunk_id", (F.col("_before") + F.col("_inside")).cast("int").alias("rn"))
    first = F.row_number().over(Window.partitionBy("chunk_id").orderBy("rn", "store_idx"))
    chosen = places.withColumn("_turn", first).where("_turn = 1").drop("_turn").orderBy("rn", "store_idx").limit(k)
    rows = hits.where(F.col("source_id") == source_id).join(F.broadcast(chosen), ["store_idx", "chunk_id"])
    return rows.dropDuplicates(["store_idx", "chunk_id"]).orderBy("rn", "store_idx")


def search_text(chunks: DataFrame, query: str, source_id: str | None = None, top_k: int = TOP_K) -> DataFrame:
    """Keyword search. The source filter acts on the merged list: places in it are those of all sources."""
    k, source = clamp(top_k), (source_id or "").strip()
    hits = keyword_hits(chunks, query)
    if not source:
        return round_robin(hits, limit=k)
    return first_of_source(hits, source, k)


def search_semantic(chunks: DataFrame, vector: Sequence[float], top_k: int = TOP_K) -> DataFrame:
    """The nearest of each store, merged in turns (no ranking across stores)."""
    k = clamp(top_k)
    return round_robin(nearest(chunks, vector, k, by_store=True), ("distance", "chunk_id"), limit=k)
