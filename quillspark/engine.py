"""The query surface over open stores: what a user asks, guarded, clamped, and answered with a few rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quillspark.errors import EmbeddingError, QueryError
from quillspark.functions.embed import Embedder
from quillspark.operators import catalog, graph, search
from quillspark.schema import HIT
from quillspark.sources.store import Store, tagged

#: Name -> what it does, sorted.
TOOLS = {
    "get_chunk_by_id": "One chunk by its id.",
    "get_document": "All chunks of a document in reading order.",
    "get_status": "Sources, chunks and layout version.",
    "list_sources": "All sources.",
    "research_topic": "Search, then what the first hits link to.",
    "search_local_docs": "Chunks that hold a text.",
    "search_semantic": "Chunks nearest in meaning.",
    "traverse_doc_links": "What a chunk links to, level by level.",
}


def _given(value: str, what: str) -> str:
    if not value.strip():
        raise QueryError(f"{what} must not be blank")
    return value


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


class Engine:
    """Stores in order; of rows that several have, the first store's counts."""

    def __init__(self, stores: list[Store], embedder: Embedder | None = None):
        self.stores, self.embedder, self.spark = stores, embedder, stores[0].spark

    def _table(self, name: str) -> DataFrame:
        return tagged(self.stores, name)

    def _links(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return self._table("chunks").select("chunk_id", "source_id", "path", "store_idx"), self._table("edges"), self._table("urls")

    def search_text(self, query: str, source_id: str | None = None, top_k: int = search.TOP_K) -> list[dict]:
        _given(query, "query")
        return _rows(search.search_text(self._table("chunks").select(*HIT, "store_idx"), query, source_id, top_k).select(*HIT))

    def search_semantic(self, query: str, top_k: int = search.TOP_K) -> list[dict]:
        _given(query, "query")
        if self.embedder is None:
            raise EmbeddingError("no embedding model is available")
        vector = self.embedder.embed([query])[0].tolist()
        found = search.search_semantic(self._table("chunks").select(*HIT, "embedding", "store_idx"), vector, top_k)
        return _rows(found.select(*HIT))

    def research(self, query: str, top_k: int = graph.RESEARCH_TOP, depth: int = graph.RESEARCH_DEPTH) -> tuple[list[dict], list[dict]]:
        """(hits, what lies around the first of them); by keyword where there is no embedder."""
        k = search.clamp(top_k, graph.RESEARCH_MOST)
        hits = self.search_semantic(query, k) if self.embedder is not None else self.search_text(query, top_k=k)
        if not hits:
            return hits, []
        chunks, edges, urls = self._links()
        found = graph.around([(h["chunk_id"], h["source_id"]) for h in hits], edges, chunks, urls, depth, [h["chunk_id"] for h in hits])
        return hits, _rows(found.orderBy("seed_rank", "depth", "chunk_id").drop("seed_rank"))

    def traverse(self, chunk_id: str, depth: int = graph.DEPTH) -> list[dict]:
        chunks, edges, urls = self._links()
        return _rows(graph.traverse(self.spark, chunks, edges, urls, _given(chunk_id, "chunk_id"), depth))

    def list_sources(self) -> list[dict]:
        return _rows(catalog.list_sources(self._table("sources")).drop("store_idx"))

    def get_chunk(self, chunk_id: str) -> dict | None:
        found = _rows(catalog.get_chunk(self._table("chunks").drop("embedding"), _given(chunk_id, "chunk_id")))
        return found[0] if found else None

    def get_document(self, path: str, source_id: str | None = None) -> list[dict]:
        return _rows(catalog.get_document(self._table("chunks").drop("embedding"), _given(path, "path"), source_id))

    def status(self) -> dict:
        versions = self.spark.createDataFrame([(s.schema_version,) for s in self.stores], "schema_version int")
        return _rows(catalog.status(self._table("sources"), self._table("chunks"), versions))[0]
