"""What an incremental cycle has to do, from the files that are there and those that were ingested."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FILE = ["source_id", "fs_rel"]


def file_diff(current: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """``current(source_id, fs_rel, mtime)`` against ``stored`` -> one row for each file with its ``change``.

    A file is modified only if it is newer than it was. ``force`` takes every stored file for older than it is, so
    deletions are still told from changes.
    """
    old = stored.select(*FILE, (F.lit(0) if force else F.col("mtime")).cast("long").alias("old_mtime"), F.lit(True).alias("_old"))
    both = current.select(*FILE, "mtime", F.lit(True).alias("_new")).join(old, FILE, "full_outer")
    change = (
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted")
        .when(F.col("mtime") > F.col("old_mtime"), "modified").otherwise("unchanged")
    )
    return both.select(*FILE, "mtime", "old_mtime", change.alias("change"))


def identity_of(stored: DataFrame) -> DataFrame:
    """Stored files with the identity that their chunks are under."""
    return stored.withColumn("path", F.coalesce("contract_path", "fs_rel"))


def duplicate_paths(files: DataFrame) -> DataFrame:
    """All ``files(source_id, fs_rel, path)`` that share their path with another file of the source."""
    return files.withColumn("_n", F.count("*").over(Window.partitionBy("source_id", "path"))).where("_n > 1").drop("_n")


def collisions_with_unchanged(changed: DataFrame, diff: DataFrame, stored: DataFrame) -> DataFrame:
    """Changed files whose path is that of a stored file that this cycle does not touch."""
    busy = diff.where("change <> 'unchanged'").select(*FILE)
    kept = identity_of(stored).join(busy, FILE, "left_anti").select("source_id", "path").distinct()
    return changed.join(kept, ["source_id", "path"], "left_semi")


def swaps(changed: DataFrame, stored: DataFrame) -> DataFrame:
    """Both files of each pair of changed files of which one takes the path that the other had: ``(source_id, fs_rel)``."""
    had = identity_of(stored).select("source_id", F.col("fs_rel").alias("owner"), F.col("path")).join(
        changed.select("source_id", F.col("fs_rel").alias("owner")), ["source_id", "owner"], "left_semi"
    )
    pairs = changed.join(had, ["source_id", "path"]).where("fs_rel <> owner")
    return pairs.select("source_id", F.explode(F.array("fs_rel", "owner")).alias("fs_rel")).distinct()


def next_state(diff: DataFrame, stored: DataFrame, done: DataFrame, failed: DataFrame) -> DataFrame:
    """The files to remember: ``done(source_id, fs_rel, contract_path)`` at their new mtime, unchanged ones as they were.

    A file that failed keeps its old row, so that it is tried again, or has none if it is new; a deletion that failed
    keeps its row unless another file has taken its identity.
    """
    old = stored.select(*FILE, F.col("mtime").alias("_had"), "contract_path")
    fresh = diff.join(done, FILE).select(*FILE, "mtime", "contract_path")
    same = diff.where("change = 'unchanged'").join(old, FILE).select(*FILE, F.col("_had").alias("mtime"), "contract_path")
    again = old.join(failed.select(*FILE).distinct(), FILE, "left_semi").join(done.select(*FILE), FILE, "left_anti")
    taken = done.select("source_id", F.coalesce("contract_path", "fs_rel").alias("_path"))
    kept = again.withColumn("_path", F.coalesce("contract_path", "fs_rel")).join(taken, ["source_id", "_path"], "left_anti")
    kept = kept.join(same.select(*FILE), FILE, "left_anti").select(*FILE, F.col("_had").alias("mtime"), "contract_path")
    return fresh.unionByName(same).unionByName(kept)
