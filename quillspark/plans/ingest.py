"""Syncing sources into a store: whole, or what has changed.

A cycle lists files once; the same listing is loaded and remembered. Files are parsed once, in tasks, and all tables of a
source become current together. Wrong files are rows with an error and leave what was there of them untouched.
"""

from __future__ import annotations

import json
import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillspark.errors import ConfigError, PathError, SyncError
from quillspark.format import iso_time, percent, prewarm_record
from quillspark.functions.embed import Embedder, embedded
from quillspark.functions.exprs import allowed_format
from quillspark.functions.session import checkpoint
from quillspark.operators import sync
from quillspark.operators.catalog import last_wins
from quillspark.operators.documents import parse, tables_of
from quillspark.operators.upsert import chunks_of_documents, delete_chunks, upsert, upsert_chunks, url_collisions
from quillspark.schema import KEYS
from quillspark.sources.config import Source, duplicate_intake, report
from quillspark.sources.listing import contained, contents, list_files
from quillspark.sources.store import Change, Store

#: Changes when what is derived from a file changes; a stored other value makes the next cycle a full one.
EPOCH = "1"
FILE = sync.FILE


@dataclass
class Metrics:
    added: int = 0
    modified: int = 0
    deleted: int = 0
    unchanged: int = 0
    chunks: int = 0
    links: int = 0
    code: int = 0
    #: Files that pass the globs but have another format, and canonical URLs that went from one chunk to another.
    skipped: int = 0
    moved_urls: int = 0
    errors: list[dict] = field(default_factory=list)
    duration_ms: int = 0

    def __add__(self, other: Metrics) -> Metrics:
        names = ("added", "modified", "deleted", "unchanged", "chunks", "links", "code", "skipped", "moved_urls", "duration_ms")
        return Metrics(**{n: getattr(self, n) + getattr(other, n) for n in names}, errors=self.errors + other.errors)

    @property
    def exit_code(self) -> int:
        return 1 if self.errors else 0


@dataclass(frozen=True)
class Planned:
    """A source that a run will scan, and the real directory that it will read."""

    source: Source
    directory: str


def plan(sources: Sequence[Source], allowed_root: str, spark: SparkSession | None = None) -> list[Planned]:
    """What a run over ``sources`` would scan; nothing is written. Served stores are left out.

    Whatever is wrong with the sources is told at once: directories that aren't there or lie outside ``allowed_root``, globs,
    formats. Sources that would put one file into several stores are refused as well.
    """
    told = report(sources, allowed_root)
    if not told.is_valid:
        kind = PathError if all(p.field == "path" for p in told.problems) else ConfigError
        raise kind(f"{told.total - told.valid} of {told.total} sources can't be read: " + "; ".join(f"{p.source_id} ({p.field}): {p.message}" for p in told.problems))
    twice = duplicate_intake(sources, spark=spark)
    if twice:
        raise ConfigError("files would go into several stores: " + ", ".join(f"{a} and {b}" for a, b in twice))
    return [Planned(s, contained(s.path, allowed_root)) for s in sources if s.ingestible]


def dry_run(spark: SparkSession, planned: Sequence[Planned]) -> DataFrame:
    """The files that a run would read: ``(source_id, root, fs_rel, mtime)``."""
    out = spark.createDataFrame([], "source_id string, root string, fs_rel string, mtime long")
    for p in planned:
        out = out.unionByName(list_files(spark, p.source.id, p.directory, p.source.include, p.source.exclude, p.source.formats))
    return out


def _listing(store: Store, source: Source, allowed_root: str | None = None) -> tuple[DataFrame, int, int]:
    """The files of a source, how many there are, and how many more have another format: counted while they are listed."""
    if not source.ingestible:
        raise SyncError(f"source {source.id} is only served")
    if allowed_root is not None:
        contained(source.path, allowed_root)
    allowed, seen = allowed_format(F.col("fs_rel"), source.formats), Observation()
    every = list_files(store.spark, source.id, source.path, source.include, source.exclude, ignored=[store.path])
    every = checkpoint(every.observe(seen, F.count("*").alias("all"), F.count_if(allowed).alias("allowed")))
    return every.where(allowed), seen.get["allowed"], seen.get["all"] - seen.get["allowed"]


def _own(store: Store, source_id: str) -> dict[str, DataFrame]:
    return {t: store._read(t, source_id) for t in ("chunks", "edges", "code", "urls", "files", "syncs")}


def _split(parsed: DataFrame, rejected: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(documents to load, errors ``(source_id, fs_rel, path, error)``, counts of what is loaded, which the same job observes).

    ``rejected`` come with their own ``reason``.
    """
    named = rejected.groupBy(*FILE).agg(F.min("reason").alias("reason"))
    seen, good = Observation(), F.col("error").isNull()
    sizes = (F.coalesce(F.sum(F.when(good, F.size(c))), F.lit(0)).alias(c) for c in ("chunks", "links", "code"))
    both = parsed.join(named, FILE, "left").withColumn("error", F.coalesce("error", "reason")).drop("reason")
    both = checkpoint(both.observe(seen, *sizes))
    return both.where("error IS NULL"), both.where("error IS NOT NULL").select(*FILE, "path", "error"), seen.get


def _reason(files: DataFrame, text: str) -> DataFrame:
    return files.select(*FILE, F.lit(text).alias("reason"))


def _loaded(old: dict[str, DataFrame], good: DataFrame, embedder: Embedder | None) -> dict[str, DataFrame]:
    """``old`` with the documents ``good``; a chunk keeps its stored embedding unless there is a fresh one."""
    new = tables_of(good)
    chunks = new["chunks"]
    if embedder is not None:
        chunks = last_wins(chunks, ["chunk_id"], "seq").withColumn("embedding", embedded(F.col("content"), embedder)).withColumn("seq", F.lit(0))
    return old | {
        "chunks": upsert_chunks(old["chunks"], chunks, "seq"),
        "edges": upsert(old["edges"], new["edges"], ["src_chunk_id", "target_path"], "seq"),
        "code": upsert(old["code"], new["code"], ["snippet_id"], "seq"),
        "urls": upsert(old["urls"], new["urls"], ["canonical_url"], "seq"),
    }


def _changes(old: dict[str, DataFrame], good: DataFrame, gone: DataFrame, embedder: Embedder | None) -> dict[str, Change]:
    """What the documents ``good`` change in the tables of a source from which those at ``gone(source_id, path)`` go.

    Embeddings of chunks that come again are kept: they are looked up in what was stored before.
    """
    new = {t: last_wins(rows, KEYS[t], "seq").drop("seq") for t, rows in tables_of(good).items()}
    chunks = new["chunks"]
    if embedder is not None:
        chunks = chunks.withColumn("embedding", embedded(F.col("content"), embedder))
    stored = old["chunks"].where("embedding IS NOT NULL").select("chunk_id", F.col("embedding").alias("_had"))
    chunks = chunks.join(stored, "chunk_id", "left").withColumn("embedding", F.coalesce("embedding", "_had")).drop("_had")
    left = chunks_of_documents(old["chunks"], gone)
    ids = checkpoint(left.unionByName(new["chunks"].select("chunk_id")).distinct().withColumnRenamed("chunk_id", "key"))
    lost = old["urls"].join(ids.withColumnRenamed("key", "chunk_id"), "chunk_id", "left_semi").select("canonical_url")
    urls = lost.unionByName(new["urls"].select("canonical_url")).distinct().withColumnRenamed("canonical_url", "key")
    return {"chunks": Change(chunks, ids), "edges": Change(new["edges"], ids), "code": Change(new["code"], ids), "urls": Change(new["urls"], urls)}


def _files_change(old: DataFrame, state: DataFrame) -> Change:
    """What turns the remembered files ``old`` of a source into ``state``."""
    state = state.select(*old.columns)
    return Change(state.exceptAll(old), old.exceptAll(state).select(F.col("fs_rel").alias("key")))


def _commit(store: Store, source: Source, tables: dict[str, DataFrame | Change], files: DataFrame | Change, whole: bool = False) -> None:
    spark = store.spark
    known = store._read("sources").where(F.col("source_id") != source.id)
    own = spark.createDataFrame([(source.id, source.path, source.type, source.id, None)], known.schema)
    stamp = spark.createDataFrame([(source.id, iso_time(time.time()), EPOCH)], store._read("syncs").schema)
    store.commit(
        {
            ("sources", ""): known.unionByName(own), ("urls", ""): tables["urls"], ("files", source.id): files, ("syncs", source.id): stamp,
            **{(t, source.id): tables[t] for t in ("chunks", "edges", "code")},
        },
        whole,
    )


def _count(metrics: Metrics, counts: dict[str, int], errors: DataFrame) -> Metrics:
    metrics.chunks, metrics.links, metrics.code = (int(counts[c]) for c in ("chunks", "links", "code"))
    metrics.errors = [r.asDict() for r in errors.orderBy(*FILE).collect()]
    return metrics


def full_sync(store: Store, source: Source, embedder: Embedder | None = None, prune: bool = False, allowed_root: str | None = None) -> Metrics:
    """Load every file of a source. What files that are gone left behind stays until an incremental cycle, or ``prune``.

    A directory outside ``allowed_root``, if that is given, is refused.
    """
    with store.lock():
        return _full_sync(store, source, embedder, prune, allowed_root)


def _full_sync(store: Store, source: Source, embedder: Embedder | None, prune: bool, allowed_root: str | None) -> Metrics:
    began = time.time()
    files, number, skipped = _listing(store, source, allowed_root)
    parsed = checkpoint(parse(contents(files)))
    twice = sync.duplicate_paths(parsed.where("path IS NOT NULL").select(*FILE, "path"))
    good, errors, counts = _split(parsed, _reason(twice, "source_path is used by several files"))
    old = _own(store, source.id)
    if prune:
        gone = old["chunks"].select("chunk_id")
        old = delete_chunks(old, gone)
    tables = _loaded(old, good, embedder)
    done = good.select(*FILE, F.col("path").alias("contract_path"))
    state = files.select(*FILE, "mtime").join(done, FILE)
    # Files that failed, and stored ones that are not listed now, are remembered as they were unless their identity is taken.
    rest = old["files"].join(state.select(*FILE), FILE, "left_anti").withColumn("_path", F.coalesce("contract_path", "fs_rel"))
    rest = rest.join(done.select("source_id", F.col("contract_path").alias("_path")), ["source_id", "_path"], "left_anti").drop("_path")
    metrics = _count(Metrics(added=number, skipped=skipped), counts, errors)
    metrics.moved_urls = url_collisions(old["urls"], tables["urls"]).count()
    _commit(store, source, tables, state.unionByName(rest.select(*state.columns)) if not prune else state)
    metrics.duration_ms = max(1, int(1000 * (time.time() - began)))
    return metrics


def incremental_sync(store: Store, source: Source, embedder: Embedder | None = None, allowed_root: str | None = None) -> Metrics:
    """Load what has changed since the last cycle and delete what is gone; nothing is written if nothing changed.

    Where what is derived from a file has changed, or the store's layout, a cycle loads all files of the source. Without an
    embedder it is refused if embeddings are stored, which it would lose.
    """
    with store.lock():
        return _incremental_sync(store, source, embedder, allowed_root)


def _incremental_sync(store: Store, source: Source, embedder: Embedder | None, allowed_root: str | None) -> Metrics:
    began = time.time()
    (files, _, skipped), old = _listing(store, source, allowed_root), _own(store, source.id)
    last = old["syncs"].first()
    force = store.outdated(source.id) or last is None or last["contract_epoch"] != EPOCH
    if force and embedder is None and not old["chunks"].where("embedding IS NOT NULL").isEmpty():
        raise SyncError("a rebuild without an embedder would lose the stored embeddings")
    seen, kinds = Observation(), ("added", "modified", "deleted", "unchanged")
    diff = checkpoint(sync.file_diff(files, old["files"], force).observe(seen, *(F.count_if(F.col("change") == k).alias(k) for k in kinds)))
    metrics = Metrics(**seen.get, skipped=skipped)
    if not (metrics.added or metrics.modified or metrics.deleted):
        metrics.duration_ms = max(1, int(1000 * (time.time() - began)))
        return metrics
    changed = files.join(diff.where("change IN ('added', 'modified')").select(*FILE), FILE, "left_semi")
    parsed = checkpoint(parse(contents(changed, metrics.added + metrics.modified)))
    named = parsed.where("path IS NOT NULL").select(*FILE, "path")
    if store.outdated(source.id) and not sync.duplicate_paths(named).isEmpty():
        raise SyncError("the store can't be rebuilt: a source_path is used by several files")
    rejected = (
        _reason(sync.duplicate_paths(named), "source_path is used by several files")
        .unionByName(_reason(sync.collisions_with_unchanged(named, diff, old["files"]), "source_path belongs to an unchanged file"))
        .unionByName(_reason(sync.swaps(named, old["files"]), "source_path was that of another changed file"))
    )
    good, errors, counts = _split(parsed, rejected)
    done = good.select(*FILE, F.col("path").alias("contract_path"))
    before = sync.identity_of(old["files"])
    gone = before.join(diff.where("change = 'deleted'").unionByName(diff.join(done.select(*FILE), FILE, "left_semi")).select(*FILE).distinct(), FILE, "left_semi")
    gone = gone.select("source_id", "path").unionByName(good.select("source_id", "path")).distinct()
    tables = _changes(old, good, gone, embedder)
    state = sync.next_state(diff, old["files"], done, errors)
    metrics = _count(metrics, counts, errors)
    metrics.moved_urls = url_collisions(old["urls"], tables["urls"].rows).count()
    _commit(store, source, tables, _files_change(old["files"], state), whole=force)
    metrics.duration_ms = max(1, int(1000 * (time.time() - began)))
    return metrics


def sync_all(stores: dict[str, Store], sources: dict[str, list[Source]], embedder: Embedder | None = None, full: bool = False, allowed_root: str | None = None) -> Metrics:
    """Sync every source into its store, one writer for each store; a source that fails does not stop the others."""
    total = Metrics()
    for name, group in sources.items():
        with stores[name].lock():
            for source in group:
                try:
                    total = total + (full_sync if full else incremental_sync)(stores[name], source, embedder, allowed_root=allowed_root)
                except (SyncError, PathError, OSError) as e:
                    total.errors.append({"source_id": source.id, "fs_rel": None, "path": source.path, "error": str(e)})
    return total


def prewarm(stores: dict[str, Store], sources: dict[str, list[Source]], embedder: Embedder | None = None, allowed_root: str | None = None, sink: str | None = None) -> Metrics:
    """A first load of every source, or what has changed since; the record of its end is a line of ``sink``, if that is given.

    Each source that is done is a line as well, so that whoever follows the file sees how far the run is.
    """
    total, number, count = Metrics(), 0, sum(map(len, sources.values()))
    for name, group in sources.items():
        for source in group:
            found, number = sync_all(stores, {name: [source]}, embedder, allowed_root=allowed_root), number + 1
            total = total + found
            if sink:
                payload = {"source": source.id, "percent": percent(number, count), "files": found.added + found.modified, "errors": len(found.errors)}
                _append(sink, json.dumps({"event_type": "prewarm.progress", "timestamp": iso_time(time.time()), "payload": payload}))
    if sink:
        _append(sink, prewarm_record(total, count, time.time()))
    return total


def _append(sink: str, line: str) -> None:
    with open(sink, "a", encoding="utf-8") as f:
        f.write(line + "\n")
