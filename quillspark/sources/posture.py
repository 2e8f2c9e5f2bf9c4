"""Which of the served stores may be written: those, and only those, for which there is something to load.

A store is open for generation if a local source that goes into it lies in the allowed root and has at least one file that
passes its globs and formats. Everything else is read-only: stores that no source names, and those of sources that are
absent, empty, outside the root, or that can't be listed to the end (any error of a walk counts against the source, also
after a file was found). Stores are told apart by their real paths.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from typing import NamedTuple

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from quillspark.errors import EngineError, StoreError
from quillspark.sources.config import Source, by_store
from quillspark.sources.listing import contained, list_files
from quillspark.sources.store import Store


class Posture(NamedTuple):
    path: str
    #: Whether syncs may write it.
    generation: bool


class Postures(NamedTuple):
    """All served stores in their order, and the sources that may be loaded: never those of a read-only store."""

    stores: list[Posture]
    sources: list[Source]


def has_content(spark: SparkSession, source: Source, allowed_root: str) -> bool:
    """Whether a source has a file to load; false whenever that can't be told for sure."""
    try:
        root = contained(source.path, allowed_root)
        return list_files(spark, source.id, root, source.include, source.exclude, source.formats).count() > 0
    except (EngineError, OSError, ValueError, PySparkException, Py4JError):
        return False


def _real(path: str) -> str:
    return path.rstrip("/") if "://" in path and not path.startswith("file://") else os.path.realpath(path.removeprefix("file://"))


def postures(spark: SparkSession, served: Sequence[str], sources: Sequence[Source], base: str, allowed_root: str, read_only: bool = False) -> Postures:
    """The posture of every path of ``served``; ``base`` is where sources' stores lie, ``read_only`` opens nothing for writing."""
    loaded: dict[str, list[Source]] = {}
    if not read_only:
        for path, group in by_store(sources, base).items():
            loaded.setdefault(_real(path), []).extend(s for s in group if has_content(spark, s, allowed_root))
    stores = [Posture(p, bool(loaded.get(_real(p)))) for p in served]
    return Postures(stores, [s for p in stores if p.generation for s in loaded[_real(p.path)]])


def opened_stores(spark: SparkSession, found: Postures) -> list[Store]:
    """The stores in order, each opened as its posture says. A read-only one that isn't there is left out."""
    out = []
    for path, generation in found.stores:
        try:
            out.append(Store(spark, path, writable=generation))
        except StoreError:
            if generation:
                raise
    return out
