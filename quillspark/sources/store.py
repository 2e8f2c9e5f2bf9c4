"""A store: Parquet tables in immutable versions, and one pointer file that says which are current.

Tables are kept by source (``urls`` and ``sources`` whole), so a cycle touches its own sources and no others. What a source
has of a table is one fragment, or several: a later one holds new rows and the keys of rows that earlier ones no longer
count for, so that a small change is a small write. Reading joins these keys away; after ``MOST_FRAGMENTS`` a commit
writes the table whole again. All
tables of a commit become current at once, by one rename; readers keep the version they opened. Writers hold the lock:
taking it reads what is current, so that a commit always goes on from the last one. Sources that an older layout left
are remembered one by one until each has been rebuilt.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from functools import reduce
from typing import NamedTuple

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, SparkRuntimeException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.errors import LockError, SchemaError, StoreError
from quillspark.schema import GONE_BY, SCHEMA_VERSION, TABLES
from quillspark.sources.files import Files

WHOLE = ("sources", "urls")
STALE_SECONDS = 3600
_POINTER, _LOCK, _STATE = "_current", "_lock", "_state"
#: Columns of tables by which single rows are looked up: Parquet keeps a Bloom filter of them for each row group.
LOOKED_UP = {"chunks": ("chunk_id",), "edges": ("src_chunk_id",), "code": ("chunk_id",), "urls": ("canonical_url", "chunk_id")}

#: Fragments that a read puts together at most; a commit beyond writes the table whole.
MOST_FRAGMENTS = 16
_KEY = "key string"


class Change(NamedTuple):
    """A change of a table: ``rows`` come in, and stored rows whose ``GONE_BY`` column is in ``gone(key)`` go."""

    rows: DataFrame
    gone: DataFrame


def _fragments(value: str | list) -> list[tuple[str, str | None]]:
    """``(place of rows, place of gone keys)`` of a table's entry in the state; one that was written whole is its place."""
    return [(value, None)] if isinstance(value, str) else [(rows, gone) for rows, gone in value]


def _places(state: dict) -> list[tuple[str, str | None]]:
    """All places of a state: ``(place, table)``, and ``(place, None)`` for those of gone keys, each once."""
    out = {}
    for table, parts in state["tables"].items():
        for value in parts.values():
            for rows, gone in _fragments(value):
                out[rows] = table
                if gone:
                    out[gone] = None
    return list(out.items())


def _folders(state: dict) -> set[str]:
    return {place.split("/")[0] for place, _ in _places(state)}


class Store:
    def __init__(self, spark: SparkSession, path: str, writable: bool = True):
        self.spark, self.path, self.writable, self.files = spark, path.rstrip("/"), writable, Files(spark)
        self.held: Lock | None = None
        self.damaged = False
        if not self._opened() and not writable:
            raise StoreError(f"no store at {path}, or none that can be read")

    def _opened(self) -> bool:
        """As ``reload``; a pointer that can't be read leaves the store damaged: it is empty, and takes nothing but a repair."""
        try:
            self.damaged = False
            return self.reload()
        except (ValueError, KeyError, Py4JError):
            self.damaged, self.state = True, {"version": 0, "schema": SCHEMA_VERSION, "tables": {}, "old": {}}
            return False

    def _current(self) -> dict | None:
        at = f"{self.path}/{_POINTER}"
        return json.loads(self.files.read(at)) if self.files.exists(at) else None

    def reload(self) -> bool:
        """Read what is current; false if nothing was ever committed."""
        found = self._current()
        self.state = {"version": 0, "schema": SCHEMA_VERSION, "tables": {}} | (found or {})
        if "old" not in self.state:  # of each source that has an older layout, which
            outdated = self.state["schema"] < SCHEMA_VERSION
            self.state["old"] = dict.fromkeys(self.source_ids(), self.state["schema"]) if outdated else {}
        return found is not None

    @property
    def schema_version(self) -> int:
        """The oldest layout that a source of the store has."""
        return min(self.state["old"].values(), default=self.state["schema"])

    @property
    def needs_rebuild(self) -> bool:
        return 0 < self.schema_version < SCHEMA_VERSION

    def outdated(self, source_id: str) -> bool:
        """Whether this source must be rebuilt."""
        return self.needs_rebuild and (source_id in self.state["old"] or not self.state["old"])

    def read(self, table: str, source_id: str | None = None) -> DataFrame:
        """A table, or what one source has of it; empty where nothing was written."""
        if self.damaged:
            raise StoreError("the store's pointer can't be read: repair it")
        if self.needs_rebuild:
            raise SchemaError(f"the store has layout {self.schema_version}; sync it to rebuild it as {SCHEMA_VERSION}")
        return self._read(table, source_id)

    def _read(self, table: str, source_id: str | None = None) -> DataFrame:
        parts = self.state["tables"].get(table, {})
        mine = [_fragments(v) for s, v in sorted(parts.items()) if source_id in (None, s) or table in WHOLE]
        whole = [fragments[0][0] for fragments in mine if len(fragments) == 1]
        found = [self._scan(TABLES[table], whole)] if whole else []
        found += [self._layered(table, fragments) for fragments in mine if len(fragments) > 1]
        return reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], TABLES[table])

    def _scan(self, schema, places: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{p}" for p in places))

    def _layered(self, table: str, fragments: list[tuple[str, str | None]]) -> DataFrame:
        """Rows of all fragments whose key no later fragment has among its gone ones."""
        rows = [self._scan(TABLES[table], [place]).withColumn("_n", F.lit(n)) for n, (place, _) in enumerate(fragments)]
        gone = [self._scan(_KEY, [place]).select(F.col("key").alias("_gone"), F.lit(n).alias("_by")) for n, (_, place) in enumerate(fragments) if place]
        later = (F.col(GONE_BY[table]) == F.col("_gone")) & (F.col("_n") < F.col("_by"))
        return reduce(DataFrame.unionByName, rows).join(reduce(DataFrame.unionByName, gone), later, "left_anti").drop("_n")

    def fragments(self, table: str, source_id: str) -> int:
        """How many fragments a source's part of a table has."""
        value = self.state["tables"].get(table, {}).get("" if table in WHOLE else source_id)
        return len(_fragments(value)) if value else 0

    def tables(self) -> list[str]:
        return sorted(TABLES)

    def source_ids(self) -> list[str]:
        return sorted(self.state["tables"].get("chunks", {}))

    def commit(self, parts: dict[tuple[str, str], DataFrame | Change], whole: bool = False) -> int:
        """Write ``(table, source_id) -> rows`` (``""`` for whole tables) and make them current together.

        A ``Change`` becomes a fragment beside those that are there, unless ``whole`` is set; changes with the same ``gone``
        share its keys.
        """
        if not self.writable:
            raise StoreError("the store was opened for reading")
        if self.held is None:
            raise LockError("a commit needs the store's lock")
        if self.damaged:
            raise StoreError("the store's pointer can't be read: repair it")
        version = self.state["version"] + 1
        folder = f"v{version}-{uuid.uuid4().hex[:12]}"  # a name of its own: no commit can write over another's tables
        tables = {t: dict(p) for t, p in self.state["tables"].items()}
        keys: dict[int, str] = {}
        for (table, source), new in parts.items():
            place, before = f"{folder}/{table}/{source.encode().hex() or 'all'}", tables.get(table, {}).get(source)
            entry: str | list = place
            if isinstance(new, Change):
                if before is None:
                    new = new.rows
                elif whole or len(_fragments(before)) >= MOST_FRAGMENTS:
                    kept = self._read(table, source)
                    new = kept.join(new.gone.select(F.col("key").alias(GONE_BY[table])), GONE_BY[table], "left_anti").unionByName(new.rows.select(*kept.columns))
                else:
                    if id(new.gone) not in keys:
                        keys[id(new.gone)] = f"{folder}/gone/{len(keys)}"
                        new.gone.select("key").write.parquet(f"{self.path}/{keys[id(new.gone)]}")
                    entry, new = [*_fragments(before), (place, keys[id(new.gone)])], new.rows
            self._write(table, new, place, small=entry is not place)
            tables.setdefault(table, {})[source] = entry
        done = {source for _, source in parts}
        old = {s: layout for s, layout in self.state["old"].items() if s not in done}
        if not self.held.own() or (self._current() or {"version": 0})["version"] != self.state["version"]:
            self.files.delete(f"{self.path}/{folder}")
            raise LockError("another process has committed in between; nothing was changed")
        self.state = {"version": version, "schema": SCHEMA_VERSION, "tables": tables, "old": old}
        self.files.replace(f"{self.path}/{folder}/{_STATE}", json.dumps(self.state))
        self.files.replace(f"{self.path}/{_POINTER}", json.dumps(self.state))
        return version

    def _write(self, table: str, rows: DataFrame, place: str, small: bool) -> None:
        ordered = rows.select(*TABLES[table].names)
        if table == "chunks":  # documents side by side, so that a path is found by row group statistics
            ordered = ordered.repartitionByRange("path", "chunk_id").sortWithinPartitions("path", "position")
        write = ordered.write
        for column in LOOKED_UP.get(table, ()):  # ids have no order, so that statistics can't tell where one is
            write = write.option(f"parquet.bloom.filter.enabled#{column}", "true").option("parquet.bloom.filter.adaptive.enabled", str(small).lower())
        write.parquet(f"{self.path}/{place}")

    def problems(self) -> list[str]:
        """What is wrong with what lies on disk: an unreadable pointer, tables that are gone, torn or unreadable, left-over folders."""
        try:
            found = self._current()
        except (ValueError, Py4JError):
            return ["the pointer can't be read"]
        out = [] if found is None else self._broken(found)
        used = _folders(found or {"tables": {}})
        for folder in self.files.folders(self.path):
            name = folder.rsplit("/", 1)[-1]
            if name[:1] == "v" and name not in used and not self.files.exists(f"{folder}/{_STATE}"):
                out.append(f"{name} is of a commit that never ended")
        return out

    def _broken(self, state: dict) -> list[str]:
        out = []
        for place, table in _places(state):
            at = f"{self.path}/{place}"
            if not self.files.exists(at):
                out.append(f"{place} is gone")
            elif not self.files.exists(f"{at}/_SUCCESS"):
                out.append(f"{place} was not written to the end")
            else:
                try:  # footers of all its files
                    have = self.spark.read.option("mergeSchema", "true").parquet(at).columns
                    if not set(TABLES[table].names if table else ["key"]) <= set(have):
                        out.append(f"{place} lacks columns")
                except (AnalysisException, Py4JError, SparkRuntimeException) as e:
                    if "UNABLE_TO_INFER_SCHEMA" not in str(e):
                        out.append(f"{place} can't be read")
        return out

    def repair(self) -> list[str]:
        """Mend what can be: point to the last commit that is whole, and delete what commits that never ended left. Needs the lock.

        Returns what was done; a store that has no whole commit is empty afterwards, and its next sync loads everything.
        """
        if self.held is None:
            raise LockError("a repair needs the store's lock")
        done = []
        try:
            found = self._current()
        except (ValueError, Py4JError):
            found = None
        if self.problems() and (found is None or self._broken(found)):
            states = []
            for folder in self.files.folders(self.path):
                try:
                    states.append(json.loads(self.files.read(f"{folder}/{_STATE}")))
                except (ValueError, Py4JError):
                    continue
            whole = next((s for s in sorted(states, key=lambda s: -s["version"]) if not self._broken(s)), None)
            last = max([s["version"] for s in states], default=0)
            kept = whole or {"schema": SCHEMA_VERSION, "tables": {}, "old": {}}
            self.files.replace(f"{self.path}/{_POINTER}", json.dumps(kept | {"version": last + 1}))
            done.append(f"version {whole['version']} is current again" if whole else "nothing whole was found: the store is empty")
            self._opened()
        for folder in self.files.folders(self.path):
            name = folder.rsplit("/", 1)[-1]
            if name[:1] == "v" and not self.files.exists(f"{folder}/{_STATE}") and name not in _folders(self.state):
                self.files.delete(folder)
                done.append(f"{name} is deleted")
        return done

    def vacuum(self, keep: int = 2) -> None:
        """Delete versions that no current table is in, but for the latest ``keep``."""
        used = _folders(self.state)
        for folder in self.files.folders(self.path):
            name = folder.rsplit("/", 1)[-1]
            number = name[1:].split("-")[0]
            if name[:1] == "v" and number.isdigit() and name not in used and int(number) <= self.state["version"] - keep:
                self.files.delete(folder)

    def lock(self, force: bool = False) -> Lock:
        return Lock(self, force)


class Lock:
    """One writer at a time; a lock older than an hour, or of a process that is gone from this host, is taken over.

    Entering reads the store's state anew. Within a lock that the same ``Store`` holds, another one is the same.
    """

    def __init__(self, store: Store, force: bool = False):
        self.store, self.files, self.path, self.force = store, store.files, f"{store.path}/{_LOCK}", force
        self.text, self.inner = "", False

    def own(self) -> bool:
        return self.files.exists(self.path) and self.files.read(self.path) == self.text

    def __enter__(self):
        if self.store.held is not None:
            self.inner = True
            return self
        self.text = json.dumps({"pid": os.getpid(), "host": os.uname().nodename, "since": time.time(), "token": uuid.uuid4().hex})
        if not self.files.create(self.path, self.text):
            held = json.loads(self.files.read(self.path) or "{}")
            stale = self.files.age_seconds(self.path) > STALE_SECONDS or (held.get("host") == os.uname().nodename and not _alive(held.get("pid", 0)))
            if not (stale or self.force):
                raise LockError(f"the store is being written by process {held.get('pid')} on {held.get('host')}")
            self.files.delete(self.path)
            if not self.files.create(self.path, self.text):
                raise LockError("another process took the lock over")
        self.store._opened()
        self.store.held = self
        return self

    def __exit__(self, *_):
        if self.inner:
            return
        self.store.held = None
        if self.own():  # one that was taken over is another's
            self.files.delete(self.path)


def _alive(pid: int) -> bool:
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except OSError:
        return True
    return pid > 0


def tagged(stores: list[Store], table: str) -> DataFrame:
    """A table of several stores, with ``store_idx`` in the order of the stores."""
    out = None
    for i, store in enumerate(stores):
        rows = store.read(table).withColumn("store_idx", F.lit(i))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise StoreError("no stores")
    return out
