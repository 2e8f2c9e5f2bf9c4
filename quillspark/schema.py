"""Tables of a store, and their keys."""

from __future__ import annotations

from pyspark.sql import types as T

#: Layout version of a store; a store of an older one is not read until it is rebuilt.
SCHEMA_VERSION = 4
#: Length of embeddings unless a caller says otherwise.
DIMENSION = 384


def _fields(**kinds: T.DataType | tuple[T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, k[0] if isinstance(k, tuple) else k, isinstance(k, tuple)) for n, k in kinds.items()])


_S, _L, _OPTIONAL = T.StringType(), T.LongType(), (T.StringType(), True)

SOURCES = _fields(source_id=_S, url=_S, kind=_S, name=_S, synced_at=_OPTIONAL)
CHUNKS = _fields(
    chunk_id=_S, source_id=_S, path=_S, title=_OPTIONAL, position=_L, char_offset=_L,
    heading_hierarchy=T.ArrayType(T.StringType(), False), content=_S, embedding=(T.ArrayType(T.FloatType(), False), True),
)
EDGES = _fields(src_chunk_id=_S, target_path=_S, link_text=_S, anchor=_OPTIONAL)
CODE = _fields(snippet_id=_S, chunk_id=_S, language=_OPTIONAL, content=_S)
URLS = _fields(canonical_url=_S, chunk_id=_S)
#: Files that were ingested: their mtime in seconds, and the identity that their frontmatter gave them.
FILES = _fields(source_id=_S, fs_rel=_S, mtime=_L, contract_path=_OPTIONAL)
SYNCS = _fields(source_id=_S, last_sync=_OPTIONAL, contract_epoch=_OPTIONAL)

TABLES: dict[str, T.StructType] = {"sources": SOURCES, "chunks": CHUNKS, "edges": EDGES, "code": CODE, "urls": URLS, "files": FILES, "syncs": SYNCS}
KEYS: dict[str, list[str]] = {
    "sources": ["source_id"], "chunks": ["chunk_id"], "edges": ["src_chunk_id", "target_path"], "code": ["snippet_id"],
    "urls": ["canonical_url"], "files": ["source_id", "fs_rel"], "syncs": ["source_id"],
}
#: The column by whose values rows of earlier fragments of a store are taken out (see ``sources.store``).
GONE_BY: dict[str, str] = {"chunks": "chunk_id", "edges": "src_chunk_id", "code": "chunk_id", "urls": "canonical_url", "files": "fs_rel"}
#: What search results show; never the embedding.
HIT = ["chunk_id", "source_id", "path", "heading_hierarchy", "content"]
