"""Directories of documents as DataFrames: names and times, then contents, through the ``document_files`` source.

A source's folder is a local path or a URI. Symbolic links are not followed, and hidden names count.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from pathlib import Path

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.errors import PathError, SyncError
from quillspark.sources.document_files import opened, read_files


#: Files that one task reads, where they are dealt out by number.
PER_TASK = 500


def contained(path: str, root: str) -> str:
    """The real path, if it lies in ``root``; URIs are compared as they are."""
    if "://" in path or "://" in root:
        inside = os.path.normpath(path.partition("://")[2]) + "/"
        if path.partition("://")[0] != root.partition("://")[0] or not inside.startswith(os.path.normpath(root.partition("://")[2]).rstrip("/") + "/"):
            raise PathError(f"{path} is outside {root}")
        return path
    real = Path(path).resolve()
    if not real.is_relative_to(Path(root).resolve()):
        raise PathError(f"{path} is outside {root}")
    return str(real)


def list_files(
    spark: SparkSession, source_id: str, root: str, include: Sequence[str] = (), exclude: Sequence[str] = (), formats: Sequence[str] = (), ignored: Sequence[str] = ()
) -> DataFrame:
    """``(source_id, root, fs_rel, mtime)`` of a source's files that pass its globs and formats."""
    system, top = opened(root)
    if system.get_file_info(top).type != fs.FileType.Directory:
        raise SyncError(f"source {source_id}: {root} is not a directory")
    files = read_files(spark, root, contents=False, include=include, exclude=exclude, formats=formats, ignored=[opened(p)[1] for p in ignored])
    return files.select(F.lit(source_id).alias("source_id"), F.lit(root).alias("root"), "fs_rel", "mtime")


def _contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for i in range(len(batch)):  # one file at a time
            row = batch.iloc[i : i + 1]
            system, top = opened(row["root"].iloc[0])
            with system.open_input_stream(f"{top.rstrip('/')}/{row['fs_rel'].iloc[0]}") as stream:
                yield row.assign(raw=[stream.read()])


def contents(files: DataFrame, number: int | None = None) -> DataFrame:
    """``files`` with the bytes of each as ``raw``, read where they are parsed.

    ``number``, if told, is how many there are: they are then dealt out anew, which rows that come from a join need.
    """
    if number is not None:
        files = files.repartition(-(-max(number, 1) // PER_TASK))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInPandas(_contents, f"{kept}, raw binary")
