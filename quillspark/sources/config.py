"""The registry of sources: ``*.sources.yaml`` files, or one ``sources.yaml``."""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass, replace
from pathlib import Path, PurePosixPath
from typing import NamedTuple

import yaml
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillspark.errors import ConfigError, PathError
from quillspark.functions.exprs import glob_regex
from quillspark.sources.document_files import opened
from quillspark.sources.listing import contained, list_files

FORMATS = ("md", "markdown")
_KEYS = {"local": {"type", "id", "path", "include", "exclude", "formats", "database"}, "database": {"type", "id", "path"}}


@dataclass(frozen=True)
class Source:
    """A directory to ingest (``local``), or a store that is only served (``database``)."""

    type: str
    id: str
    path: str
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    formats: tuple[str, ...] = ("md",)
    database: str | None = None

    @property
    def ingestible(self) -> bool:
        return self.type == "local"


def config_files(folder: str) -> list[str]:
    """``*.sources.yaml`` by name, else ``sources.yaml``; none if there is no such folder."""
    if not os.path.isdir(folder):
        return []
    names = sorted(n for n in os.listdir(folder) if n.endswith(".sources.yaml") and n != ".sources.yaml")
    names = names or [n for n in ("sources.yaml",) if os.path.isfile(os.path.join(folder, n))]
    return [os.path.join(folder, n) for n in names]


def parse(text: str) -> list[Source]:
    given = yaml.safe_load(text) or {}
    if not isinstance(given, dict) or not isinstance(given.get("sources", []), list):
        raise ConfigError("a configuration is a mapping with a list of sources")
    out = []
    for row in given.get("sources") or []:
        kind = row.get("type")
        if kind not in _KEYS:
            raise ConfigError(f"unknown source type {kind!r}")
        unknown = set(row) - _KEYS[kind]
        if unknown and kind == "database":
            raise ConfigError(f"unknown keys for a database source: {sorted(unknown)}")
        if not row.get("id") or not row.get("path"):
            raise ConfigError("a source needs an id and a path")
        lists = {k: tuple(map(str, row[k])) for k in ("include", "exclude", "formats") if row.get(k) is not None}
        out.append(Source(kind, str(row["id"]), str(row["path"]), database=row.get("database"), **lists))
    return out


def load(files: Sequence[str]) -> list[Source]:
    """All sources of some files; with several files each local source must name its store."""
    out = [s for f in files for s in parse(Path(f).read_text(encoding="utf-8"))]
    if len(files) > 1:
        for s in out:
            if s.ingestible and not s.database:
                raise ConfigError(f"source {s.id!r} must name a database when there are several configuration files")
    problems = problems_of(out)
    if problems:
        raise ConfigError("; ".join(problems))
    return out


def problems_of(sources: Sequence[Source]) -> list[str]:
    """Everything that is wrong, not just the first thing."""
    out, seen = [], set()
    for s in sources:
        if not s.id.strip() or "/" in s.id or "\\" in s.id:
            out.append(f"source id {s.id!r} is empty or has a separator")
        if s.id in seen:
            out.append(f"source id {s.id!r} is used twice")
        seen.add(s.id)
        if s.database is not None and (not s.database.strip() or {"/", "\\"} & set(s.database) or s.database in (".", "..")):
            out.append(f"source {s.id!r}: {s.database!r} is not a bare database name")
        out += [f"source {s.id!r}: unknown format {f!r}" for f in s.formats if f.lower() not in FORMATS]
        for glob in (*s.include, *s.exclude):
            try:
                glob_regex(glob)
            except ValueError as e:
                out.append(f"source {s.id!r}: {e}")
    return out


class Problem(NamedTuple):
    source_id: str
    field: str
    message: str


class Report(NamedTuple):
    """Everything that is wrong with the sources of a run, and how many sources have nothing wrong."""

    problems: list[Problem]
    valid: int
    total: int

    @property
    def is_valid(self) -> bool:
        return not self.problems


def report(sources: Sequence[Source], allowed_root: str) -> Report:
    """All problems of all local sources in one pass: directories, globs, formats. Served stores have none of these."""
    found = []
    for s in sources:
        if not s.ingestible:
            continue
        try:
            system, path = opened(s.path)
            if system.get_file_info(path).type == fs.FileType.NotFound:
                found.append(Problem(s.id, "path", f"path does not exist: {s.path!r}"))
            else:
                contained(s.path, allowed_root)
        except (PathError, OSError, ValueError) as e:
            found.append(Problem(s.id, "path", str(e)))
        for field in ("include", "exclude"):
            for glob in getattr(s, field):
                try:
                    glob_regex(glob)
                except ValueError as e:
                    found.append(Problem(s.id, field, str(e)))
        found += [Problem(s.id, "formats", f"unknown format {f!r}") for f in s.formats if f.lower() not in FORMATS]
    return Report(found, len(sources) - len({p.source_id for p in found}), len(sources))


def normal(path: str) -> str:
    return os.path.normpath(path.replace("\\", "/")).replace(os.sep, "/")


def duplicate_intake(sources: Sequence[Source], default: str = "default", spark: SparkSession | None = None) -> list[tuple[str, str]]:
    """Pairs of local sources that would put one file into different stores. There are tens of sources at most.

    Directory trees must overlap; with a session the files of both are listed, and only a common one is a conflict. A
    directory that isn't there counts as one.
    """
    local = [(s, PurePosixPath(normal(s.path))) for s in sources if s.ingestible]
    pairs = [
        (a, b) for i, (a, p) in enumerate(local) for b, q in local[i + 1 :]
        if (a.database or default) != (b.database or default) and (p.is_relative_to(q) or q.is_relative_to(p))
    ]
    return [(a.id, b.id) for a, b in pairs if spark is None or _common_file(spark, a, b)]


def _common_file(spark: SparkSession, a: Source, b: Source) -> bool:
    if not (os.path.isdir(a.path) and os.path.isdir(b.path)):
        return True
    full = F.concat("root", F.lit("/"), "fs_rel").alias("file")
    one, other = (list_files(spark, s.id, os.path.realpath(s.path), s.include, s.exclude, s.formats).select(full) for s in (a, b))
    return not one.join(other, "file", "left_semi").isEmpty()


def by_store(sources: Sequence[Source], base: str, default: str = "default") -> dict[str, list[Source]]:
    """Local sources by the path of the store they go to."""
    out: dict[str, list[Source]] = {}
    for s in sources:
        if s.ingestible:
            out.setdefault(f"{base.rstrip('/')}/{s.database or default}", []).append(replace(s))
    return out


def served(sources: Sequence[Source], base: str, given: Sequence[str] = ()) -> list[str]:
    """Paths of all stores to serve: configured ones, those given, those found below ``base``; each once, first wins."""
    found = sorted(str(p.parent) for p in Path(base).glob("*/_current")) if os.path.isdir(base) else []
    paths = [*by_store(sources, base), *(s.path for s in sources if not s.ingestible), *given, *found]
    return list(dict.fromkeys(os.path.realpath(p) for p in paths))
