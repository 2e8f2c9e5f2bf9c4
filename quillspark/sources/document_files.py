"""A Spark data source over folders of documents: ``spark.read.format("document_files").load(root)``.

``root`` is a local folder or a URI of a file system that Arrow knows (``file:``, ``hdfs:``, ``viewfs:``, ``s3:``, ``gs:``);
tasks open it themselves, so nothing needs to be mounted. The folders are listed in parallel where the read is planned.
Their files in order of name are cut into partitions of up to ``files`` files and ``bytes`` bytes; a partition is remembered
as ranges of names in folders, not as a list of files, and one folder of any number of files becomes as many partitions as
it needs. Globs and formats are applied while listing, and so are filters on ``fs_rel`` and ``mtime`` that Spark pushes down.

Rows are ``(fs_rel, mtime, size, raw)``: the path below ``root`` with forward slashes, whole seconds, bytes, and with
``contents`` the bytes themselves (else null; no file is opened). Local symbolic links are not followed; hidden names
count. A file that goes between planning and reading is left out of a listing, and is an error where it is read.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, StringStartsWith

from quillspark.functions.exprs import glob_regex

NAME = "document_files"
SCHEMA = "fs_rel string, mtime long, size long, raw binary"
#: Files and bytes of a partition, and folders that are listed at once.
FILES, BYTES, AT_ONCE = 2000, 64 << 20, 16
#: Bytes of contents in one Arrow batch.
BATCH = 16 << 20


def opened(root: str) -> tuple[fs.FileSystem, str]:
    if "://" not in root and not re.match(r"file:", root):
        return fs.LocalFileSystem(), os.path.abspath(root)
    return fs.FileSystem.from_uri("file://" + root[5:] if re.match(r"file:/(?!/)", root) else root)


class Entry(NamedTuple):
    name: str
    folder: bool
    mtime: int
    size: int


def listed(system: fs.FileSystem, path: str) -> list[Entry]:
    """What stands in one folder, by name. Local links are left out; any error is one."""
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(path) as found:
            own = [(e.name, e.is_dir(follow_symlinks=False), e.stat(follow_symlinks=False)) for e in found if e.is_dir(follow_symlinks=False) or e.is_file(follow_symlinks=False)]
        return sorted(Entry(n, d, int(s.st_mtime), s.st_size) for n, d, s in own)
    infos = system.get_file_info(fs.FileSelector(path, recursive=False))
    return sorted(Entry(i.base_name, i.type == fs.FileType.Directory, int((i.mtime_ns or 0) // 1_000_000_000), i.size or 0) for i in infos)


@dataclass(frozen=True)
class Wanted:
    """Which files of a tree count; all tests are on the path below the root, and times."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    formats: tuple[str, ...] = ()
    prefix: str = ""
    paths: tuple[str, ...] | None = None
    after: int | None = None

    def __post_init__(self):
        any_of = lambda globs: re.compile("|".join(f"(?:{glob_regex(g)[4:]})" for g in globs), re.S) if globs else None
        object.__setattr__(self, "_in", any_of(self.include))
        object.__setattr__(self, "_out", any_of(self.exclude))
        object.__setattr__(self, "_formats", {"md" if f.lower() == "markdown" else f.lower() for f in self.formats})
        object.__setattr__(self, "_paths", None if self.paths is None else set(self.paths))

    def file(self, path: str, mtime: int) -> bool:
        return (
            path.startswith(self.prefix)
            and (self._paths is None or path in self._paths)
            and (self.after is None or mtime >= self.after)
            and (self._in is None or self._in.search(path) is not None)
            and (self._out is None or self._out.search(path) is None)
            and (not self._formats or format_of(path) in self._formats)
        )

    def folder(self, path: str) -> bool:
        """Whether anything below can count."""
        below = path + "/"
        if not (below.startswith(self.prefix) or self.prefix.startswith(below)):
            return False
        return self._paths is None or any(p.startswith(below) for p in self._paths)


def format_of(path: str) -> str:
    """Lower-case extension without the dot, ``markdown`` as ``md``."""
    m = re.search(r"[^/.][^/]*\.([^./]+)$", path)
    ext = m[1].lower() if m else ""
    return "md" if ext == "markdown" else ext


class Stretch(NamedTuple):
    """Files of one folder from one name to another."""

    folder: str
    first: str
    last: str


class Part(InputPartition):
    def __init__(self, stretches: tuple[Stretch, ...]):
        super().__init__(stretches)


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        given = lambda k: tuple(json.loads(options.get(k, "[]")))
        self.root = options.get("path") or options["root"]
        self.contents = options.get("contents", "true").lower() == "true"
        self.wanted = Wanted(given("include"), given("exclude"), given("formats"))
        self.ignored, self.files, self.bytes = set(given("ignored")), int(options.get("files", FILES)), int(options.get("bytes", BYTES))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes over what paths and times can answer; Spark evaluates the rest."""
        w = self.wanted
        have = {"include": w.include, "exclude": w.exclude, "formats": w.formats, "prefix": w.prefix, "paths": w.paths, "after": w.after}
        both = lambda names: tuple(names) if have["paths"] is None else tuple(set(have["paths"]) & set(names))
        for f in filters:
            match f:
                case EqualTo(("fs_rel",), str() as path):
                    have["paths"] = both([path])
                case In(("fs_rel",), paths) if all(isinstance(p, str) for p in paths):
                    have["paths"] = both(paths)
                case StringStartsWith(("fs_rel",), str() as start) if not have["prefix"] or start.startswith(have["prefix"]):
                    have["prefix"] = start
                case GreaterThan(("mtime",), int() as t):
                    have["after"] = max(t + 1, have["after"] if have["after"] is not None else t + 1)
                case GreaterThanOrEqual(("mtime",), int() as t):
                    have["after"] = max(t, have["after"] if have["after"] is not None else t)
                case _:
                    yield f
        self.wanted = Wanted(**have)

    def _kept(self, system: fs.FileSystem, top: str, folder: str) -> tuple[list[Entry], list[str]]:
        """The files of a folder that count and its folders, as paths below the root."""
        files, folders = [], []
        for e in listed(system, f"{top}/{folder}" if folder else top):
            path = f"{folder}/{e.name}" if folder else e.name
            if e.folder:
                if f"{top}/{path}" not in self.ignored and self.wanted.folder(path):
                    folders.append(path)
            elif self.wanted.file(path, e.mtime):
                files.append(e._replace(name=path))
        return files, folders

    def partitions(self) -> Sequence[InputPartition]:
        system, top = opened(self.root)
        top = top.rstrip("/")
        out: list[Part] = []
        held: list[Stretch] = []
        number = size = 0
        with ThreadPoolExecutor(AT_ONCE) as pool:
            level = [""]
            while level:
                deeper: list[str] = []
                for k in range(0, len(level), AT_ONCE):  # the names of so many folders are held at once
                    some = level[k : k + AT_ONCE]
                    for folder, (files, folders) in zip(some, pool.map(lambda f: self._kept(system, top, f), some), strict=True):
                        deeper += folders
                        first = None
                        for e in files:
                            if number and (number >= self.files or size + e.size > self.bytes):
                                if first is not None:
                                    held.append(Stretch(folder, first, last))
                                out.append(Part(tuple(held)))
                                held, first, number, size = [], None, 0, 0
                            first, last = first or e.name, e.name
                            number, size = number + 1, size + e.size
                        if first is not None:
                            held.append(Stretch(folder, first, last))
                level = deeper
        if held:
            out.append(Part(tuple(held)))
        return out or [Part(())]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, top = opened(self.root)
        top = top.rstrip("/")
        rows: list[tuple] = []
        size = 0
        for s in partition.value:
            for e in self._kept(system, top, s.folder)[0]:
                if s.first <= e.name <= s.last:
                    raw = None
                    if self.contents:
                        with system.open_input_stream(f"{top}/{e.name}") as stream:
                            raw = stream.read()
                    rows.append((e.name, e.mtime, e.size, raw))
                    size += e.size if self.contents else 64
                    if size >= BATCH:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["fs_rel", "mtime", "size", "raw"])


class DocumentFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with push-down of filters to Python sources."""
    spark.dataSource.register(DocumentFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_files(spark: SparkSession, root: str, contents: bool = True, include: Sequence[str] = (), exclude: Sequence[str] = (), formats: Sequence[str] = (), ignored: Sequence[str] = (), **sizes: int):
    """The files below ``root`` as ``SCHEMA`` rows; ``files`` and ``bytes`` bound a partition."""
    register(spark)
    lists = {"include": include, "exclude": exclude, "formats": formats, "ignored": ignored}
    options = {k: json.dumps(list(v)) for k, v in lists.items()} | {k: str(v) for k, v in sizes.items()}
    return spark.read.format(NAME).options(contents=str(contents).lower(), **options).load(root)
