"""Files to documents: one parse of each file in a distributed stage, then plain projections to the tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.session import bounded
from quillspark.operators.contract import ContractError, source_path, split, validate, fields
from quillspark.operators.markdown import parse_body

_CHUNK = "struct<chunk_id:string,position:bigint,char_offset:bigint,heading_hierarchy:array<string>,content:string>"
_LINK = "struct<src_chunk_id:string,target_path:string,link_text:string,anchor:string>"
_CODE = "struct<snippet_id:string,chunk_id:string,language:string,content:string>"
PARSED = (
    "source_id string, fs_rel string, path string, title string, canonical_url string, error string, error_field string, "
    f"chunks array<{_CHUNK}>, links array<{_LINK}>, code array<{_CODE}>"
)


_TEXT, _LONG = pa.string(), pa.int64()
_ARROW = pa.schema(
    [
        *((c, _TEXT) for c in ("source_id", "fs_rel", "path", "title", "canonical_url", "error", "error_field")),
        ("chunks", pa.list_(pa.struct([("chunk_id", _TEXT), ("position", _LONG), ("char_offset", _LONG), ("heading_hierarchy", pa.list_(_TEXT)), ("content", _TEXT)]))),
        ("links", pa.list_(pa.struct([(c, _TEXT) for c in ("src_chunk_id", "target_path", "link_text", "anchor")]))),
        ("code", pa.list_(pa.struct([(c, _TEXT) for c in ("snippet_id", "chunk_id", "language", "content")]))),
    ]
)
#: Lists of a parsed document.
PARTS = ("chunks", "links", "code")
#: Bytes of files whose rows are held before they go on.
PIECE_BYTES = 1 << 20


def parse_file(raw: bytes, source_id: str, fs_rel: str, contract: bool = True) -> dict:
    """One document as a row. What is wrong with it stands in ``error``; ``path`` is told whenever it can be.

    Without ``contract`` any text is a document: it is under its file's path, frontmatter that is there and readable gives
    title and URL, and the first heading of the first level is the title where there is no other.
    """
    row = {"source_id": source_id, "fs_rel": fs_rel, "path": None, "title": None, "canonical_url": None, "error": None, "error_field": None, "chunks": [], "links": [], "code": []}
    try:
        front, body = split(bytes(raw).decode("utf-8", "strict"))
        if not contract:
            try:
                given = fields(front) if front is not None else {}
            except ContractError:
                given = {}
            row["path"] = fs_rel
            row["chunks"], row["links"], row["code"], first = parse_body(body, source_id, fs_rel)
            return row | {"title": given.get("title") or first, "canonical_url": (given.get("canonical_url") or "").strip() or None}
        given = None
        if front is not None:
            try:
                given = fields(front)
                row["path"] = source_path(given.get("source_path"))
            except ContractError:
                pass  # the whole contract says it below
        told = validate(front, body, given)
        row["chunks"], row["links"], row["code"], _ = parse_body(body, source_id, told.source_path)
        row |= {"path": told.source_path, "title": told.title, "canonical_url": told.canonical_url}
    except UnicodeDecodeError as e:
        row["error"] = f"not UTF-8: {e.reason} at byte {e.start}"
    except ContractError as e:
        row["error"], row["error_field"] = str(e), e.field
    except Exception as e:  # whatever is wrong with a file costs that file only
        row["error"] = f"not parsed: {type(e).__name__}: {e}"
    if row["error"] is not None:
        row |= {"chunks": [], "links": [], "code": []}
    return row


def _parse(contract: bool, parts: tuple[str, ...]):
    left_out = {c: [] for c in PARTS if c not in parts}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for raw, source_id, fs_rel in zip(batch.column("raw"), batch.column("source_id"), batch.column("fs_rel"), strict=True):
                raw = raw.as_py()
                rows.append(parse_file(raw, source_id.as_py(), fs_rel.as_py(), contract) | left_out)
                held += len(raw or b"")
                if held >= PIECE_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return run


def parse(files: DataFrame, contract: bool = True, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """``files(source_id, fs_rel, raw)`` -> one row for each file, with its chunks, links and code, or its error.

    Files are parsed whole; lists that are not among ``parts`` stay in the task, and are empty in the rows.
    """
    bounded(files.sparkSession)
    return files.select("source_id", "fs_rel", "raw").mapInArrow(_parse(contract, parts), PARSED)


def tables_of(parsed: DataFrame) -> dict[str, DataFrame]:
    """Good documents as rows of the tables, each with its order ``seq`` (later rows win over equal keys)."""
    good = parsed.where("error IS NULL")
    each = lambda c, *more: good.select("source_id", "path", "fs_rel", *more, F.posexplode(c).alias("_i", "_x"))
    seq = F.struct("fs_rel", "_i").alias("seq")
    chunks = each("chunks").select(
        "_x.chunk_id", "source_id", "path", F.lit(None).cast("string").alias("title"), "_x.position", "_x.char_offset", "_x.heading_hierarchy", "_x.content",
        F.lit(None).cast("array<float>").alias("embedding"), seq,
    )
    first = good.where("canonical_url IS NOT NULL AND size(chunks) > 0")
    return {
        "chunks": chunks,
        "edges": each("links").select("_x.*", seq),
        "code": each("code").select("_x.*", seq),
        "urls": first.select("canonical_url", F.col("chunks")[0]["chunk_id"].alias("chunk_id"), F.struct("fs_rel", F.lit(0).alias("_i")).alias("seq")),
    }
