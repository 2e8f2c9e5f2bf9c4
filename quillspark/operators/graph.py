"""The link graph: resolving targets, bounded breadth-first search, and research (search, then search around the hits).

Levels are joins over all of a level's chunks at once, so a search of depth d is d jobs whatever the number of links.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.session import checkpoint, counted
from quillspark.operators.search import clamp

DEPTH, MOST_DEPTH = 2, 5
#: Rows of a level that are sent to all tasks; more are shuffled.
BROADCAST_ROWS = 100_000
RESEARCH_TOP, RESEARCH_MOST, RESEARCH_DEPTH, RESEARCH_MOST_DEPTH, MOST_SEEDS = 5, 20, 1, 3, 3


def resolve_url(urls: DataFrame, chunks: DataFrame) -> DataFrame:
    """Canonical URLs that lead to a chunk that is there."""
    return urls.join(chunks, "chunk_id")


def resolve(edges: DataFrame, chunks: DataFrame, urls: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """``edges`` that carry ``source_id``, their own chunk's -> ``(…, to_chunk_id, to_source_id, to_path, tier)``.

    Tier 1: all chunks of the document at the target path in the same source. Tier 2, for absolute targets: the chunk
    that has the target as its canonical URL, in whatever source. Links stay within equal values of ``within``.
    """
    to = chunks.select(F.col("chunk_id").alias("to_chunk_id"), F.col("source_id").alias("to_source_id"), F.col("path").alias("to_path"), *within)
    near = edges.join(to.withColumnsRenamed({"to_source_id": "source_id", "to_path": "target_path"}), ["source_id", "target_path", *within])
    near = near.withColumns({"to_source_id": F.col("source_id"), "to_path": F.col("target_path"), "tier": F.lit(1)})
    owned = urls.select(F.col("canonical_url").alias("target_path"), F.col("chunk_id").alias("to_chunk_id"), *within).join(to, ["to_chunk_id", *within])
    far = edges.where(F.startswith("target_path", F.lit("/"))).join(owned, ["target_path", *within]).withColumn("tier", F.lit(2))
    columns = [*edges.columns, "to_chunk_id", "to_source_id", "to_path", "tier"]
    return near.select(*columns).unionByName(far.select(*columns))


def edges_of(edges: DataFrame, chunk_id: str) -> DataFrame:
    """The links of one chunk; stores keep a Bloom filter for it."""
    return edges.where(F.col("src_chunk_id") == chunk_id)


def dangling(edges: DataFrame, urls: DataFrame) -> DataFrame:
    """Links whose target is no canonical URL."""
    return edges.join(urls.select(F.col("canonical_url").alias("target_path")).distinct(), "target_path", "left_anti").select(*edges.columns)


def _sent(rows: DataFrame, number: int) -> DataFrame:
    return F.broadcast(rows) if number <= BROADCAST_ROWS else rows


def bfs(seeds: DataFrame, edges: DataFrame, chunks: DataFrame, urls: DataFrame, depth: int, within: Sequence[str] = ()) -> DataFrame:
    """``seeds(seed, source_id)`` -> ``(seed, chunk_id, source_id, path, depth, cross_source)``.

    The seed itself is left out; each chunk is found once for each seed, at its least depth; ``cross_source`` tells that
    its source is not the seed's. With ``within`` (``store_idx``) all four tables have these columns, and so has the
    result: chunks of different values are apart. A level is counted by the job that cuts it, and broadcast while it is small.
    """
    seen, number = counted(seeds.select("seed", F.col("seed").alias("chunk_id"), "source_id", F.lit(None).cast("string").alias("path"), F.lit(0).alias("depth"), *within))
    frontier = seen
    for level in range(1, depth + 1):
        start = frontier.select("seed", F.col("chunk_id").alias("src_chunk_id"), "source_id", *within)
        out, links = counted(edges.select("src_chunk_id", "target_path", *within).join(_sent(start, number), ["src_chunk_id", *within]))
        found = resolve(_sent(out, links), chunks, urls, within)
        found = found.select("seed", F.col("to_chunk_id").alias("chunk_id"), F.col("to_source_id").alias("source_id"), F.col("to_path").alias("path"), *within)
        fresh = found.distinct().join(seen.select("seed", "chunk_id", *within), ["seed", "chunk_id", *within], "left_anti")
        frontier, number = counted(fresh.withColumn("depth", F.lit(level)))
        if not number:
            break
        seen = seen.unionByName(frontier)
    home = seeds.select("seed", F.col("source_id").alias("home"), *within)
    return seen.where("depth > 0").join(home, ["seed", *within]).withColumn("cross_source", F.col("source_id") != F.col("home")).drop("home")


def traverse(spark: SparkSession, chunks: DataFrame, edges: DataFrame, urls: DataFrame, chunk_id: str, depth: int = DEPTH) -> DataFrame:
    """Breadth-first search within the first store that has the chunk; nothing for an unknown chunk."""
    owner = chunks.where(F.col("chunk_id") == chunk_id).orderBy("store_idx").select("store_idx", "source_id").first()
    at = -1 if owner is None else owner["store_idx"]
    seeds = spark.createDataFrame([] if owner is None else [(chunk_id, owner["source_id"])], "seed string, source_id string")
    own = lambda df: df.where(F.col("store_idx") == at).drop("store_idx")
    return bfs(seeds, own(edges), own(chunks), own(urls), clamp(depth, MOST_DEPTH)).drop("seed").orderBy("depth", "chunk_id")


def around(hits: Sequence[tuple[str, str]], edges: DataFrame, chunks: DataFrame, urls: DataFrame, depth: int, shown: Sequence[str]) -> DataFrame:
    """What lies around the first hits ``(chunk_id, source_id)`` and is not shown already, in one search for all of them.

    A chunk that several seeds find keeps the depth of the first of them. Where the tables have ``store_idx``, each seed is
    searched around in the first store that has it.
    """
    spark = edges.sparkSession
    seeds = spark.createDataFrame([(c, s, i) for i, (c, s) in enumerate(hits[:MOST_SEEDS])], "seed string, source_id string, seed_rank int")
    within = [c for c in ("store_idx",) if c in chunks.columns]
    if within:
        owner = chunks.where(F.col("chunk_id").isin([c for c, _ in hits[:MOST_SEEDS]])).groupBy(F.col("chunk_id").alias("seed"))
        seeds = checkpoint(seeds.drop("source_id").join(owner.agg(F.min("store_idx").alias("store_idx"), F.min_by("source_id", "store_idx").alias("source_id")), "seed"))
    found = bfs(seeds.select("seed", "source_id", *within), edges, chunks, urls, clamp(depth, RESEARCH_MOST_DEPTH), within).where(~F.col("chunk_id").isin(list(shown)))
    first = F.row_number().over(Window.partitionBy("chunk_id").orderBy("seed_rank"))
    return found.join(F.broadcast(seeds.select("seed", "seed_rank")), "seed").withColumn("_first", first).where("_first = 1").drop("_first", "seed", *within)
