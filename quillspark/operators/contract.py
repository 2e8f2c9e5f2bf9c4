"""The frontmatter contract of documents: what a file must say about itself before it is ingested."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract.
REQUIRED = ("title", "source", "ingested_at", "doc_type")
DEFAULT_STRATEGY, DEFAULT_VERSION, MAJOR = "h1-h2-h3", "1.0", 1


class ContractError(ValueError):
    """A document that breaks the contract; ``field`` names the field at fault, if it is one."""

    def __init__(self, message: str, field: str | None = None):
        super().__init__(message)
        self.field = field


class _Plain(yaml.SafeLoader):
    """Scalars stay text as written: neither dates nor numbers."""


_Plain.yaml_implicit_resolvers = {
    first: [(tag, pattern) for tag, pattern in known if tag == "tag:yaml.org,2002:null"] for first, known in yaml.SafeLoader.yaml_implicit_resolvers.items()
}


def split(text: str) -> tuple[str | None, str]:
    """(frontmatter with LF line ends, body). It opens at the first byte; the earliest ``---`` or ``...`` line start ends it.

    What follows the end mark on its line is taken for body.
    """
    if not text.startswith(("---\n", "---\r\n")):
        return None, text
    rest = text[text.index("\n") + 1 :]
    found = [(at, len(mark)) for eol in ("\n", "\r\n") for mark in (f"{eol}---", f"{eol}...") if (at := rest.find(mark)) >= 0]
    if not found:
        return None, text
    at, size = min(found)
    body = rest[at + size :]
    for eol in ("\r\n", "\n"):
        if body.startswith(eol):
            body = body[len(eol) :]
            break
    return rest[:at].replace("\r\n", "\n"), body


def fields(front: str) -> dict[str, str | None]:
    try:
        found = yaml.load(front, Loader=_Plain)  # noqa: S506  a safe loader
    except yaml.YAMLError as e:
        raise ContractError(f"malformed frontmatter: {e}") from e
    if found is None:
        return {}
    if not isinstance(found, dict):
        raise ContractError("frontmatter is not a mapping")
    return {str(k): v if v is None or isinstance(v, str) else str(v) for k, v in found.items()}


def source_path(raw: str | None) -> str:
    """A relative path of plain segments, with forward slashes."""
    path = (raw or "").replace("\\", "/")
    problem = None
    if not path:
        problem = "is required"
    elif path[0] == "/":
        problem = "must be relative"
    elif len(path) > 1 and path[0].isascii() and path[0].isalpha() and path[1] == ":":
        problem = "must not name a drive"
    elif {".", ".."} & set(path.split("/")):
        problem = "must not have '.' or '..' segments"
    elif "" in path.split("/"):
        problem = "must not have empty segments"
    if problem:
        raise ContractError(f"source_path {problem}: {path!r}", "source_path")
    return path


@dataclass(frozen=True)
class Front:
    title: str
    source: str
    ingested_at: str
    doc_type: str
    source_path: str
    description: str = ""
    content_sha256: str = ""
    chunk_strategy: str = DEFAULT_STRATEGY
    schema_version: str = DEFAULT_VERSION
    canonical_url: str | None = None


def validate(front: str | None, body: str, given: dict[str, str | None] | None = None) -> Front:
    """``given``: the ``fields`` of ``front``, where they are known."""
    if front is None:
        raise ContractError("no frontmatter")
    given = fields(front) if given is None else given
    for name in REQUIRED:
        if not given.get(name):
            raise ContractError(f"{name} is {'empty' if given.get(name) == '' else 'missing'}", name)
    path = source_path(given.get("source_path"))
    version = given.get("schema_version") or DEFAULT_VERSION
    major = version.split(".")[0].strip()
    if not (major.isascii() and major.isdigit() and len(major) < 10 and int(major) == MAJOR):
        raise ContractError(f"schema_version {version!r} is not supported", "schema_version")
    digest = given.get("content_sha256") or ""
    if digest and digest.lower() != hashlib.sha256(body.replace("\r\n", "\n").encode()).hexdigest():
        raise ContractError("content_sha256 does not match the body", "content_sha256")
    url = (given.get("canonical_url") or "").strip() or None
    return Front(
        given["title"], given["source"], given["ingested_at"], given["doc_type"], path, given.get("description") or "", digest,
        given.get("chunk_strategy") or DEFAULT_STRATEGY, version, url,
    )


def _checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = []
        for raw in batch["raw"]:
            try:
                found.append((source_path(raw), None))
            except ContractError as e:
                found.append((None, str(e).split(":", 1)[0].removeprefix("source_path ")))
        yield batch.assign(path=[f[0] for f in found], problem=[f[1] for f in found])


def checked_paths(paths: DataFrame, column: str) -> DataFrame:
    """``paths`` with ``raw`` (the column), the ``path`` that a document with it gets, or the ``problem`` for which it is refused."""
    rows = paths.withColumn("raw", F.col(column))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(_checked, f"{kept}, path string, problem string")
