"""Every operator as a registered query over the driver's tables, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import exprs as E
from quillspark.functions.session import shared_path
from quillspark.operators import catalog, graph, search, sync, upsert
from quillspark.operators.contract import checked_paths
from quillspark.operators.documents import parse, tables_of
from quillspark.plans import views as V
from quillspark.sources.document_files import opened, read_files
from quillspark.sources.store import Change, Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The stand-in views once more, for the checking SQL.
WITH = r"""
v_chunks AS (SELECT sha256(concat_ws(chr(0), text, source, lang||'/'||(doc_id % 7)||'.md')) AS chunk_id, source AS source_id,
  lang||'/'||(doc_id % 7)||'.md' AS path, doc_id AS position, 0::BIGINT AS char_offset, text AS content, (doc_id % 3)::INT AS store_idx FROM documents),
v_one AS (SELECT * REPLACE (0 AS store_idx) FROM v_chunks),
v_vectors AS (SELECT 'v'||vec_id AS chunk_id, (vec_id % 3)::INT AS store_idx, CASE WHEN vec_id % 10 <> 0 THEN embedding::DOUBLE[] END AS e FROM embeddings),
v_scored AS (SELECT chunk_id, store_idx, round(1 - list_cosine_similarity(e, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS distance
  FROM v_vectors WHERE e IS NOT NULL),
v_pages AS (SELECT 'p'||page_id AS chunk_id, 'site'||(page_id % 4) AS source_id, '/'||regexp_extract(html,'<h1>([^ <]*)',1) AS canonical_url,
  '/'||regexp_extract(html,'<h1>([^ <]*)',1) AS path, page_id AS seq, (page_id % 2)::INT AS store_idx FROM pages),
v_urls AS (SELECT canonical_url, arg_max(chunk_id, seq) AS chunk_id FROM v_pages GROUP BY 1),
v_href AS (SELECT 'p'||page_id AS src_chunk_id, unnest(regexp_extract_all(html,'href="([^"]*)"',1)) AS u,
  unnest(range(len(regexp_extract_all(html,'href="([^"]*)"',1)))) AS place FROM pages),
v_links AS (SELECT src_chunk_id, place, split_part(u,'#',1) AS target_path,
  CASE WHEN instr(u,'#') > 0 THEN nullif(substr(u, instr(u,'#') + 1), '') END AS anchor FROM v_href),
v_edges AS (SELECT DISTINCT src_chunk_id, target_path FROM v_links),
v_from AS (SELECT e.*, p.source_id FROM v_edges e JOIN v_pages p ON p.chunk_id = e.src_chunk_id),
v_resolved AS (SELECT f.src_chunk_id, f.source_id, f.target_path, p.chunk_id AS to_chunk_id, p.source_id AS to_source_id, p.path AS to_path, 1 AS tier
  FROM v_from f JOIN v_pages p ON p.source_id = f.source_id AND p.path = f.target_path
  UNION ALL SELECT f.src_chunk_id, f.source_id, f.target_path, p.chunk_id, p.source_id, p.path, 2
  FROM v_from f JOIN v_urls u ON u.canonical_url = f.target_path JOIN v_pages p ON p.chunk_id = u.chunk_id WHERE starts_with(f.target_path, '/')),
v_stored AS (SELECT source AS source_id, 'f'||doc_id AS fs_rel, n_chars - doc_id % 3 + 1 AS mtime,
  CASE WHEN doc_id % 2 = 0 THEN 'c'||(doc_id // 10) END AS contract_path FROM documents WHERE doc_id % 4 <> 0),
v_current AS (SELECT source AS source_id, 'f'||doc_id AS fs_rel, n_chars AS mtime, 'c'||((doc_id + 20) // 40) AS path FROM documents WHERE doc_id % 5 <> 0),
v_diff AS (SELECT coalesce(c.source_id, s.source_id) AS source_id, coalesce(c.fs_rel, s.fs_rel) AS fs_rel, c.mtime, s.mtime AS old_mtime,
  CASE WHEN s.fs_rel IS NULL THEN 'added' WHEN c.fs_rel IS NULL THEN 'deleted' WHEN c.mtime > s.mtime THEN 'modified' ELSE 'unchanged' END AS change
  FROM v_current c FULL JOIN v_stored s ON c.source_id = s.source_id AND c.fs_rel = s.fs_rel),
v_changed AS (SELECT c.source_id, c.fs_rel, c.path FROM v_current c JOIN v_diff d ON c.source_id = d.source_id AND c.fs_rel = d.fs_rel
  WHERE d.change IN ('added', 'modified')),
v_identity AS (SELECT source_id, fs_rel, coalesce(contract_path, fs_rel) AS path FROM v_stored)"""


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = f"WITH RECURSIVE {WITH.strip()} {sql}" if not sql.lstrip().startswith(",") else f"WITH RECURSIVE {WITH.strip()}{sql.lstrip()}"
        return f

    return add


HIT = ["chunk_id", "source_id", "path", "content", "rn", "store_idx"]
WORD, PHRASE = "erth", "the and"

# Identities and expressions


@query("SELECT chunk_id, source_id, path, position FROM v_chunks")
def chunk_identity(spark, sf_dir):
    return V.chunks(spark, sf_dir).select("chunk_id", "source_id", "path", "position")


@query("SELECT doc_id, sha256(concat_ws(chr(0), 'c'||doc_id, lang, text, 'code-snippet', 'c'||doc_id)) AS snippet_id FROM documents")
def snippet_identity(spark, sf_dir):
    chunk = F.concat(F.lit("c"), F.col("doc_id"))
    return V.table(spark, sf_dir, "documents").select("doc_id", E.snippet_id(chunk, F.col("lang"), F.col("text")).alias("snippet_id"))


@query("SELECT src_chunk_id, place, target_path FROM v_links")
def link_extract(spark, sf_dir):
    return V.links(spark, sf_dir).select("src_chunk_id", "place", "target_path")


@query("SELECT src_chunk_id, place, target_path, anchor FROM v_links")
def link_split_anchor(spark, sf_dir):
    return V.links(spark, sf_dir)


_PATH = "CASE doc_id % 8 WHEN 0 THEN '' WHEN 1 THEN '/a/'||doc_id WHEN 2 THEN 'C:\\x'||doc_id WHEN 3 THEN 'a/../b' WHEN 4 THEN 'a//'||doc_id WHEN 5 THEN 'a\\b'||doc_id WHEN 6 THEN './a' ELSE lang||'/'||doc_id||'.md' END"


@query(
    f""", p AS (SELECT doc_id, replace({_PATH}, '\\', '/') AS p FROM documents)
SELECT doc_id, p AS path, CASE WHEN p = '' THEN 'empty' WHEN p LIKE '/%' THEN 'absolute' WHEN regexp_matches(p, '^[A-Za-z]:') THEN 'drive'
 WHEN list_contains(string_split(p, '/'), '.') OR list_contains(string_split(p, '/'), '..') THEN 'dots'
 WHEN list_contains(string_split(p, '/'), '') THEN 'empty segment' END AS problem FROM p"""
)
def contract_path_check(spark, sf_dir):
    raw = F.expr(_PATH.replace("\\", "\\\\"))
    return V.table(spark, sf_dir, "documents").select("doc_id", E.normal_path(raw).alias("path"), E.path_problem(raw).alias("problem"))


@query(
    f""", p AS (SELECT doc_id, replace({_PATH}, '\\', '/') AS p FROM documents),
c AS (SELECT doc_id, p, CASE WHEN p = '' THEN 'is required' WHEN p LIKE '/%' THEN 'must be relative' WHEN regexp_matches(p, '^[A-Za-z]:') THEN 'must not name a drive'
 WHEN list_contains(string_split(p, '/'), '.') OR list_contains(string_split(p, '/'), '..') THEN 'must not have ''.'' or ''..'' segments'
 WHEN list_contains(string_split(p, '/'), '') THEN 'must not have empty segments' END AS problem FROM p)
SELECT doc_id, CASE WHEN problem IS NULL THEN p END AS path, problem FROM c"""
)
def contract_source_path(spark, sf_dir):
    """The check that ingestion makes of each document's own path."""
    raw = V.table(spark, sf_dir, "documents").select("doc_id", F.expr(_PATH.replace("\\", "\\\\")).alias("given"))
    return checked_paths(raw, "given").select("doc_id", "path", "problem")


@query("SELECT chunk_id, path FROM v_chunks WHERE regexp_matches(path, '^(en/.*|.*/[0-3].md)$') AND NOT regexp_matches(path, '^.*5.md$')")
def glob_filter(spark, sf_dir):
    return V.chunks(spark, sf_dir).select("chunk_id", "path").where(E.passes_globs(F.col("path"), ["en/*", "*/[0-3].md"], ["*5.md"]))


@query("SELECT 'd'||doc_id||ext AS path FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.Markdown' WHEN 2 THEN '.pdf' ELSE '' END AS ext FROM documents) WHERE lower(ext) IN ('.md', '.markdown')")
def format_filter(spark, sf_dir):
    ext = F.expr("CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.Markdown' WHEN 2 THEN '.pdf' ELSE '' END")
    files = V.table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id"), ext).alias("path"))
    return files.where(E.allowed_format(F.col("path"), ["md"]))


@query(
    """, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM documents)
SELECT doc_id, place, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_offset FROM l"""
)
def char_offset_running(spark, sf_dir):
    lines = V.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    before = Window.partitionBy("doc_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return lines.select("doc_id", F.col("place").cast("long").alias("place"), F.coalesce(F.sum(F.octet_length("line") + 1).over(before), F.lit(0)).alias("char_offset"))


@query(
    """, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM documents),
s AS (SELECT *, sum(CASE WHEN length(line) < 20 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY place) AS section FROM l)
SELECT doc_id, section::BIGINT AS section, count(*) AS n_lines, sum(strlen(line))::BIGINT AS n_bytes FROM s GROUP BY 1, 2"""
)
def sections_from_lines(spark, sf_dir):
    """Sections start at short lines, as chunks do at headings."""
    lines = V.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    starts = F.sum((F.length("line") < 20).cast("long")).over(Window.partitionBy("doc_id").orderBy("place"))
    return lines.withColumn("section", starts).groupBy("doc_id", "section").agg(F.count("*").alias("n_lines"), F.sum(F.octet_length("line")).alias("n_bytes"))


# Search


def _hits(where: str, of: str) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY store_idx ORDER BY chunk_id, position) AS rn FROM {of} WHERE {where}"


def _merged(where: str, tail: str, of: str = "v_chunks") -> str:
    return f""", h AS ({_hits(where, of)}), f AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY rn, store_idx) AS turn FROM h)
SELECT chunk_id, source_id, path, content, rn::INT AS rn, store_idx FROM f WHERE turn = 1 {tail}"""


def _one_store(spark, sf_dir):
    """The whole table as one store."""
    return V.chunks(spark, sf_dir).withColumn("store_idx", F.lit(0))


def _text(chunks, q, **more):
    return search.search_text(chunks.drop("position", "char_offset"), q, **more).select(*HIT)


@query(f"SELECT chunk_id, source_id, path, content, store_idx FROM v_chunks WHERE contains(lower(content), lower('{WORD}'))")
def keyword_filter(spark, sf_dir):
    return search.keyword_hits(V.chunks(spark, sf_dir), WORD.upper()).select("chunk_id", "source_id", "path", "content", "store_idx")


@query(_merged(f"contains(lower(content), '{WORD}')", "ORDER BY rn, store_idx LIMIT 10", "v_one"))
def keyword_search(spark, sf_dir):
    return _text(_one_store(spark, sf_dir), WORD)


@query(_merged(f"contains(lower(content), '{WORD}')", "AND source_id = 'src3' ORDER BY rn, store_idx LIMIT 10", "v_one"))
def keyword_search_source_filter(spark, sf_dir):
    return _text(_one_store(spark, sf_dir), WORD, source_id=" src3 ")


@query(_merged(f"contains(lower(content), '{WORD}')", "ORDER BY rn, store_idx LIMIT 50", "v_one"))
def keyword_topk_clamp(spark, sf_dir):
    return _text(_one_store(spark, sf_dir), WORD, top_k=5000)


@query(_merged(f"contains(lower(content), '{PHRASE}')", "ORDER BY rn, store_idx LIMIT 20"))
def multi_store_round_robin(spark, sf_dir):
    return _text(V.chunks(spark, sf_dir), PHRASE, top_k=20)


@query(_merged(f"contains(lower(content), '{PHRASE}')", "AND source_id = 'src5' ORDER BY rn, store_idx LIMIT 20"))
def round_robin_then_source_filter(spark, sf_dir):
    return _text(V.chunks(spark, sf_dir), PHRASE, source_id="src5", top_k=20)


@query("SELECT chunk_id, distance FROM v_scored ORDER BY distance, chunk_id LIMIT 10")
def semantic_topk(spark, sf_dir):
    v = V.vectors(spark, sf_dir)
    return search.nearest(v, V.query_vector(spark, sf_dir), 10).select("chunk_id", "distance")


@query(
    """, r AS (SELECT *, row_number() OVER (PARTITION BY store_idx ORDER BY distance, chunk_id) AS rn FROM v_scored)
SELECT chunk_id, distance, rn::INT AS rn, store_idx FROM r ORDER BY rn, store_idx LIMIT 10"""
)
def semantic_multi_store(spark, sf_dir):
    return search.search_semantic(V.vectors(spark, sf_dir), V.query_vector(spark, sf_dir)).select("chunk_id", "distance", "rn", "store_idx")


@query("SELECT chunk_id, distance FROM v_scored")
def semantic_null_excluded(spark, sf_dir):
    v = V.vectors(spark, sf_dir)
    return search.scored(v, V.query_vector(spark, sf_dir)).select("chunk_id", "distance")


@query("SELECT chunk_id, unnest(range(len(e))) AS place, round(unnest(e), 4) AS value FROM v_vectors WHERE chunk_id IN ('v11', 'v12', 'v20', 'v29')")
def vector_point_fetch(spark, sf_dir):
    """Four ids, of which one has no vector, and one that is nowhere."""
    v = catalog.vectors_of(V.vectors(spark, sf_dir), spark.createDataFrame([(f"v{i}",) for i in (11, 12, 20, 29)] + [("none",)], "chunk_id string"))
    each = v.select("chunk_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("place", "x"))
    return each.select("chunk_id", F.col("place").cast("long").alias("place"), F.round("x", 4).alias("value"))


# Catalogue

_COLUMNS = ["chunk_id", "source_id", "path", "position", "char_offset", "content"]
_LIST = ", ".join(_COLUMNS)
_FIRST = "(SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY store_idx, position) AS k FROM v_chunks WHERE {})"


def _document(where: str, tail: str = "") -> str:
    return f"SELECT chunk_id, source_id, path, content, char_offset FROM {_FIRST.format(where)} WHERE k = 1 {tail}"


@query("SELECT chunk_id, source_id, path, content, store_idx FROM v_chunks WHERE position = 3")
def get_chunk(spark, sf_dir):
    wanted = V.chunks(spark, sf_dir).where("position = 3").first()
    return catalog.get_chunk(V.chunks(spark, sf_dir), wanted["chunk_id"] if wanted else "").select("chunk_id", "source_id", "path", "content", "store_idx")


@query("SELECT chunk_id, min(store_idx) AS store_idx FROM v_chunks GROUP BY 1")
def get_chunk_first_store_wins(spark, sf_dir):
    return catalog.first_store_wins(V.chunks(spark, sf_dir).select("chunk_id", "store_idx"), "chunk_id")


@query(_document("path = 'en/3.md'"))
def get_document(spark, sf_dir):
    return catalog.get_document(V.chunks(spark, sf_dir), "en/3.md").select("chunk_id", "source_id", "path", "content", "char_offset")


@query(_document("path = 'en/3.md'", "AND source_id = 'src3'"))
def get_document_source_filter(spark, sf_dir):
    return catalog.get_document(V.chunks(spark, sf_dir), "en/3.md", "src3").select("chunk_id", "source_id", "path", "content", "char_offset")


@query("SELECT chunk_id, path, position FROM v_chunks WHERE source_id = 'src2'")
def chunks_of_source(spark, sf_dir):
    return catalog.chunks_of_source(V.chunks(spark, sf_dir), "src2").select("chunk_id", "path", "position")


@query("SELECT chunk_id, source_id, position FROM v_chunks WHERE path = 'de/1.md'")
def chunks_at_path(spark, sf_dir):
    return catalog.chunks_at_path(V.chunks(spark, sf_dir), "de/1.md").select("chunk_id", "source_id", "position")


def _sources(spark, sf_dir):
    return V.chunks(spark, sf_dir).select("source_id", "store_idx").distinct()


@query("SELECT source_id, min(store_idx) AS store_idx FROM v_chunks GROUP BY 1")
def list_sources(spark, sf_dir):
    return catalog.list_sources(_sources(spark, sf_dir))


@query("SELECT (SELECT count(DISTINCT source_id) FROM v_chunks) AS source_count, count(*) AS chunk_count, 4::BIGINT AS schema_version FROM v_chunks")
def status(spark, sf_dir):
    sources = _one_store(spark, sf_dir).select("source_id", "store_idx").distinct()
    return catalog.status(sources, _one_store(spark, sf_dir), spark.createDataFrame([(4,)], "schema_version int"))


@query("SELECT (SELECT count(*) FROM (SELECT DISTINCT source_id, store_idx FROM v_chunks)) AS source_count, count(*) AS chunk_count, 4::BIGINT AS schema_version FROM v_chunks")
def status_multi_store(spark, sf_dir):
    return catalog.status(_sources(spark, sf_dir), V.chunks(spark, sf_dir), spark.createDataFrame([(4,), (3,), (4,)], "schema_version int"))


@query("SELECT source_id, count(*) AS n_chunks FROM v_chunks GROUP BY 1")
def chunks_per_source(spark, sf_dir):
    return catalog.chunks_per_source(V.chunks(spark, sf_dir))


@query("SELECT chunk_id, max(position) AS position FROM v_chunks GROUP BY 1")
def chunk_dedupe_last_wins(spark, sf_dir):
    rows = V.chunks(spark, sf_dir).select("chunk_id", "position").withColumn("seq", F.col("position"))
    return catalog.last_wins(rows, ["chunk_id"], "seq").select("chunk_id", "position")


# URLs and links


@query("SELECT canonical_url, chunk_id FROM v_urls")
def url_index_build(spark, sf_dir):
    return catalog.last_wins(V.pages(spark, sf_dir).select("canonical_url", "chunk_id", "seq"), ["canonical_url"], "seq").select("canonical_url", "chunk_id")


@query("SELECT u.canonical_url, u.chunk_id, p.source_id, p.path FROM v_urls u JOIN v_pages p USING (chunk_id)")
def url_resolve(spark, sf_dir):
    pages = V.pages(spark, sf_dir).select("chunk_id", "source_id", "path")
    return graph.resolve_url(V.urls(spark, sf_dir), pages).select("canonical_url", "chunk_id", "source_id", "path")


@query("SELECT src_chunk_id, target_path FROM v_edges WHERE target_path NOT IN (SELECT canonical_url FROM v_urls)")
def url_dangling(spark, sf_dir):
    return graph.dangling(V.edges(spark, sf_dir).select("src_chunk_id", "target_path"), V.urls(spark, sf_dir))


@query(
    """SELECT a.canonical_url, a.chunk_id AS old_chunk_id, b.chunk_id AS new_chunk_id
FROM (SELECT canonical_url, arg_min(chunk_id, seq) AS chunk_id FROM v_pages GROUP BY 1) a JOIN v_urls b USING (canonical_url) WHERE a.chunk_id <> b.chunk_id"""
)
def url_collision_report(spark, sf_dir):
    first = V.pages(spark, sf_dir).groupBy("canonical_url").agg(F.min_by("chunk_id", "seq").alias("chunk_id"))
    return upsert.url_collisions(first, V.urls(spark, sf_dir))


_RESOLVED = ["src_chunk_id", "target_path", "to_chunk_id", "to_source_id", "tier"]


def _resolved(spark, sf_dir):
    pages = V.pages(spark, sf_dir)
    own = V.edges(spark, sf_dir).join(pages.select(F.col("chunk_id").alias("src_chunk_id"), "source_id"), "src_chunk_id")
    return graph.resolve(own, pages, V.urls(spark, sf_dir)).select(*_RESOLVED)


@query(f"SELECT {', '.join(_RESOLVED)} FROM v_resolved WHERE tier = 1")
def edges_resolve_tier1(spark, sf_dir):
    return _resolved(spark, sf_dir).where("tier = 1")


@query(f"SELECT {', '.join(_RESOLVED)} FROM v_resolved")
def edges_resolve_two_tier(spark, sf_dir):
    return _resolved(spark, sf_dir)


@query("SELECT src_chunk_id, target_path FROM v_edges WHERE src_chunk_id = 'p7'")
def edges_of_chunk(spark, sf_dir):
    return graph.edges_of(V.edges(spark, sf_dir), "p7")


def _walk(depth: int, seeds: str = "SELECT 'p0' AS seed, 0 AS seed_rank") -> str:
    return f""", seeds AS ({seeds}),
walk(seed, seed_rank, chunk_id, depth) AS (SELECT seed, seed_rank, seed, 0 FROM seeds
 UNION SELECT w.seed, w.seed_rank, r.to_chunk_id, w.depth + 1 FROM walk w JOIN v_resolved r ON r.src_chunk_id = w.chunk_id WHERE w.depth < {depth}),
found AS (SELECT seed, seed_rank, chunk_id, min(depth) AS depth FROM walk WHERE chunk_id <> seed GROUP BY 1, 2, 3)"""


_FOUND = """ SELECT f.chunk_id, p.source_id, p.path, f.depth::INT AS depth, p.source_id <> 'site0' AS cross_source FROM found f JOIN v_pages p USING (chunk_id)"""


def _traverse(depth: int):
    def run(spark, sf_dir):
        pages = V.pages(spark, sf_dir).withColumn("store_idx", F.lit(0)).select("chunk_id", "source_id", "path", "store_idx")
        tag = lambda df: df.withColumn("store_idx", F.lit(0))
        return graph.traverse(spark, pages, tag(V.edges(spark, sf_dir)), tag(V.urls(spark, sf_dir)), "p0", depth).select("chunk_id", "source_id", "path", "depth", "cross_source")

    return run


for _depth in range(1, 6):
    query(_walk(_depth) + _FOUND, f"traverse_bfs_d{_depth}")(_traverse(_depth))
query(_walk(5) + _FOUND + " WHERE p.source_id <> 'site0'", "traverse_cross_source")(lambda spark, sf_dir: _traverse(5)(spark, sf_dir).where("cross_source"))

_SEEDS = "SELECT chunk_id AS seed, (row_number() OVER (ORDER BY chunk_id) - 1)::INT AS seed_rank FROM (SELECT chunk_id FROM v_pages WHERE contains(lower(path), 'e') ORDER BY chunk_id LIMIT 3)"


@query(
    _walk(3, _SEEDS)
    + """, shown AS (SELECT chunk_id FROM v_pages WHERE contains(lower(path), 'e') ORDER BY chunk_id LIMIT 5),
one AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY seed_rank) AS k FROM found WHERE chunk_id NOT IN (SELECT chunk_id FROM shown))
SELECT chunk_id, depth::INT AS depth, seed_rank FROM one WHERE k = 1"""
)
def research_keyword(spark, sf_dir):
    """Pages whose heading has an e, then what lies within three links of the first of them."""
    pages = V.pages(spark, sf_dir).withColumn("content", F.col("path")).select("chunk_id", "source_id", "path", "content")
    hits = search.search_text(pages.withColumn("store_idx", F.lit(0)), "E", top_k=5).select("chunk_id", "source_id").collect()
    found = graph.around([tuple(h) for h in hits], V.edges(spark, sf_dir), pages, V.urls(spark, sf_dir), 3, [h["chunk_id"] for h in hits])
    return found.select("chunk_id", "depth", "seed_rank")


# Files and cycles


def _no_nulls(diff):
    return diff.fillna(-1, ["mtime", "old_mtime"])


@query("SELECT source_id, fs_rel, coalesce(mtime, -1) AS mtime, coalesce(old_mtime, -1) AS old_mtime, change FROM v_diff")
def file_diff(spark, sf_dir):
    return _no_nulls(sync.file_diff(V.current_files(spark, sf_dir).drop("path"), V.stored_files(spark, sf_dir)))


@query(
    """SELECT source_id, fs_rel, coalesce(mtime, -1) AS mtime, CASE WHEN old_mtime IS NOT NULL THEN 0::BIGINT ELSE -1 END AS old_mtime,
CASE WHEN change = 'unchanged' AND mtime > 0 THEN 'modified' ELSE change END AS change FROM v_diff"""
)
def forced_rebuild_diff(spark, sf_dir):
    return _no_nulls(sync.file_diff(V.current_files(spark, sf_dir).drop("path"), V.stored_files(spark, sf_dir), force=True))


def _changed(spark, sf_dir):
    current, stored = V.current_files(spark, sf_dir), V.stored_files(spark, sf_dir)
    diff = sync.file_diff(current.drop("path"), stored)
    busy = diff.where("change IN ('added', 'modified')").select("source_id", "fs_rel")
    return current.join(busy, ["source_id", "fs_rel"]).select("source_id", "fs_rel", "path"), diff, stored


@query("SELECT source_id, fs_rel, path FROM (SELECT *, count(*) OVER (PARTITION BY source_id, path) AS n FROM v_changed) WHERE n > 1")
def duplicate_source_path(spark, sf_dir):
    return sync.duplicate_paths(_changed(spark, sf_dir)[0])


@query(
    """SELECT source_id, fs_rel, path FROM v_changed c WHERE EXISTS (SELECT 1 FROM v_identity i JOIN v_diff d
 ON d.source_id = i.source_id AND d.fs_rel = i.fs_rel WHERE d.change = 'unchanged' AND i.source_id = c.source_id AND i.path = c.path)"""
)
def collision_unchanged(spark, sf_dir):
    return sync.collisions_with_unchanged(*_changed(spark, sf_dir)).select("source_id", "fs_rel", "path")


@query(
    """, pairs AS (SELECT c.source_id, c.fs_rel, o.fs_rel AS owner FROM v_changed c JOIN (SELECT i.* FROM v_identity i JOIN v_changed k
 ON k.source_id = i.source_id AND k.fs_rel = i.fs_rel) o ON o.source_id = c.source_id AND o.path = c.path AND o.fs_rel <> c.fs_rel)
SELECT source_id, fs_rel FROM pairs UNION SELECT source_id, owner FROM pairs"""
)
def swap_steal(spark, sf_dir):
    changed, _, stored = _changed(spark, sf_dir)
    return sync.swaps(changed, stored)


@query("SELECT path, count(DISTINCT source_id) AS n_sources FROM v_chunks GROUP BY 1 HAVING count(DISTINCT source_id) > 1")
def duplicate_intake(spark, sf_dir):
    return catalog.paths_of_several_sources(V.chunks(spark, sf_dir))


# Writes


def _old_new(spark, sf_dir):
    v = V.table(spark, sf_dir, "embeddings")
    row = lambda cond, e, tag: v.where(cond).select(F.concat(F.lit("v"), F.col("vec_id")).alias("chunk_id"), F.lit(tag).alias("content"), F.expr(e).alias("embedding"))
    return row("vec_id % 2 = 0", "if(vec_id % 4 = 0, embedding, null)", "old"), row("vec_id % 3 = 0", "if(vec_id % 5 = 0, embedding, null)", "new")


@query(
    """, o AS (SELECT vec_id, 'old' AS content, vec_id % 4 = 0 AS has FROM embeddings WHERE vec_id % 2 = 0), n AS (SELECT vec_id, 'new' AS content, vec_id % 5 = 0 AS has FROM embeddings WHERE vec_id % 3 = 0)
SELECT 'v'||coalesce(n.vec_id, o.vec_id) AS chunk_id, coalesce(n.content, o.content) AS content, coalesce(n.has, false) OR coalesce(o.has, false) AS has_embedding FROM o FULL JOIN n ON o.vec_id = n.vec_id"""
)
def upsert_preserve_embedding(spark, sf_dir):
    return upsert.upsert_chunks(*_old_new(spark, sf_dir)).select("chunk_id", "content", F.col("embedding").isNotNull().alias("has_embedding"))


@query("SELECT 'v'||vec_id AS chunk_id, vec_id % 4 = 0 OR (vec_id % 3 = 0 AND vec_id % 5 = 0) AS has_embedding FROM embeddings WHERE vec_id % 2 = 0")
def vector_join_put(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    return upsert.put_vectors(old, new.where("embedding IS NOT NULL")).select("chunk_id", F.col("embedding").isNotNull().alias("has_embedding"))


@query("SELECT 'v'||vec_id AS chunk_id, vec_id % 4 = 0 AND vec_id % 3 <> 0 AS has_embedding FROM embeddings WHERE vec_id % 2 = 0")
def vector_null_out(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    return upsert.null_vectors(old, new).select("chunk_id", F.col("embedding").isNotNull().alias("has_embedding"))


def _tables(spark, sf_dir):
    pages = V.pages(spark, sf_dir)
    return {"chunks": pages.select("chunk_id", "source_id", "path"), "edges": V.edges(spark, sf_dir), "urls": V.urls(spark, sf_dir), "code": pages.select("chunk_id")}


_GONE = "SELECT chunk_id FROM v_pages WHERE path < '/E'"
_LEFT = """SELECT 'chunks' AS tab, chunk_id AS k FROM v_pages WHERE chunk_id NOT IN (SELECT chunk_id FROM gone)
UNION ALL SELECT 'edges', src_chunk_id||' '||target_path FROM v_edges WHERE src_chunk_id NOT IN (SELECT chunk_id FROM gone)
UNION ALL SELECT 'urls', canonical_url FROM v_urls WHERE chunk_id NOT IN (SELECT chunk_id FROM gone)"""


def _left(tables):
    row = lambda t, k: tables[t].select(F.lit(t).alias("tab"), k.alias("k"))
    return row("chunks", F.col("chunk_id")).unionAll(row("edges", F.concat("src_chunk_id", F.lit(" "), "target_path"))).unionAll(row("urls", F.col("canonical_url")))


@query(f", gone AS ({_GONE}) {_LEFT}")
def cascade_delete(spark, sf_dir):
    gone = V.pages(spark, sf_dir).where("path < '/E'").select("path")
    return _left(upsert.delete_documents(_tables(spark, sf_dir), gone))


@query(f", gone AS ({_GONE} AND source_id = 'site1') {_LEFT}")
def delete_scoped_by_source(spark, sf_dir):
    gone = V.pages(spark, sf_dir).where("path < '/E' AND source_id = 'site1'").select("source_id", "path")
    return _left(upsert.delete_documents(_tables(spark, sf_dir), gone))


@query(
    """SELECT e.src_chunk_id, e.target_path FROM v_edges e JOIN v_pages p ON p.chunk_id = e.src_chunk_id WHERE p.path >= '/C' AND p.path < '/T'
UNION ALL SELECT chunk_id AS src_chunk_id, '/home' AS target_path FROM v_pages WHERE path >= '/T'"""
)
def store_fragments(spark, sf_dir):
    """Edges of a store after two changes: some pages go, of which some come again, and others get one link in place of theirs."""
    rows = lambda df: df.select("src_chunk_id", "target_path", F.lit("").alias("link_text"), F.lit(None).cast("string").alias("anchor"))
    edges, pages, store = V.edges(spark, sf_dir), V.pages(spark, sf_dir).select("path", F.col("chunk_id").alias("src_chunk_id")), Store(spark, shared_path(spark, "store"))
    key = F.col("src_chunk_id").alias("key")
    again = edges.join(pages.where("path >= '/C' AND path < '/E'"), "src_chunk_id", "left_semi")
    home = pages.where("path >= '/T'").withColumn("target_path", F.lit("/home"))
    with store.lock():
        store.commit({("edges", "site"): rows(edges)})
        store.commit({("edges", "site"): Change(rows(edges.limit(0)), pages.where("path < '/E'").select(key))})
        store.commit({("edges", "site"): Change(rows(again).unionByName(rows(home)), home.select(key))})
    return store.read("edges", "site").select("src_chunk_id", "target_path")


# Files


def _written(root: str):
    """Each document as a file of its own below ``root``."""

    def run(batches):
        for batch in batches:
            system, top = opened(root)
            for path, text in zip(batch.column("fs_rel").to_pylist(), batch.column("text").to_pylist(), strict=True):
                system.create_dir(f"{top}/{path.rpartition('/')[0]}", recursive=True)
                with system.open_output_stream(f"{top}/{path}") as sink:
                    sink.write(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["files"])

    return run


_FILE = "source||'/'||doc_id||CASE doc_id % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.Markdown' WHEN 2 THEN '.pdf' ELSE '' END"


@query(
    f""", f AS (SELECT {_FILE} AS fs_rel, text FROM documents WHERE doc_id % 4 < 2)
SELECT fs_rel, strlen(text)::BIGINT AS size, sha256(text) AS digest FROM f WHERE NOT regexp_matches(fs_rel, '^src1/') AND fs_rel > 'src0/3'"""
)
def document_files(spark, sf_dir):
    """Documents written as files, and read again by format and glob through the source of files."""
    root = shared_path(spark, "documents")
    V.table(spark, sf_dir, "documents").select(F.expr(_FILE).alias("fs_rel"), "text").mapInArrow(_written(root), "files long").agg(F.sum("files")).first()
    files = read_files(spark, root, formats=["md"], exclude=["src1/*"]).where("fs_rel > 'src0/3'")
    return files.select("fs_rel", "size", F.sha2("raw", 256).alias("digest"))


# Parsing

_MARKS = r"([\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E])"


def _markdown_files(spark, sf_dir):
    """Each document as a Markdown file with frontmatter: a title, a section for each line, a link and a code block.

    Marks in the text are escaped, so that what is parsed is the text.
    """
    d = V.table(spark, sf_dir, "documents")
    escaped = F.regexp_replace("text", _MARKS, r"\\$1")
    body = F.concat_ws(
        "\n\n", F.concat(F.lit("# Document "), F.col("doc_id")),
        F.array_join(F.transform(F.split(escaped, "\n"), lambda line, i: F.concat(F.lit("## Part "), i, F.lit("\n\n"), line)), "\n\n"),
        F.concat(F.lit("See [next](doc"), F.col("doc_id") + 1, F.lit(".md#top).\n\n```text\n"), F.col("lang"), F.lit("\n```")),
    )
    front = F.concat(F.lit("---\ntitle: Document "), F.col("doc_id"), F.lit("\nsource: "), F.col("source"), F.lit("\ningested_at: 2026-01-01\ndoc_type: page\nsource_path: doc"), F.col("doc_id"), F.lit(".md\n---\n"))
    return d.select(F.col("source").alias("source_id"), F.concat(F.lit("doc"), F.col("doc_id"), F.lit(".md")).alias("fs_rel"), F.encode(F.concat(front, body), "UTF-8").alias("raw"))


def _parsed(table: str):
    def run(spark, sf_dir):
        part = "links" if table == "edges" else table
        return tables_of(parse(_markdown_files(spark, sf_dir), parts=(part,)))[table].drop("seq")

    return run


#: The same chunks by what the files hold: a title, a section for each line, and in the last one a link, its paragraph and a block of code.
_SECTIONS = """, md_lines AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i, len(string_split(text, chr(10))) AS n FROM documents),
md_parts AS (SELECT doc_id, source, -1 AS i, '# Document '||doc_id AS content FROM documents UNION ALL
  SELECT doc_id, source, i, '## Part '||i||CASE WHEN trim(line, ' ') = '' THEN '' ELSE chr(10)||trim(line, ' ') END||CASE WHEN i = n - 1
    THEN chr(10)||'[next](doc'||(doc_id + 1)||'.md#top)'||chr(10)||'See next.'||chr(10)||'```text'||chr(10)||lang||chr(10)||'```' ELSE '' END FROM md_lines),
md_chunks AS (SELECT *, 'doc'||doc_id||'.md' AS path, sha256(concat_ws(chr(0), content, source, 'doc'||doc_id||'.md')) AS chunk_id FROM md_parts),
md_last AS (SELECT c.*, d.lang FROM md_chunks c JOIN documents d ON d.doc_id = c.doc_id WHERE c.content LIKE '%```')"""

query(
    _SECTIONS
    + """ SELECT chunk_id, source AS source_id, path, (i + 1)::BIGINT AS position,
  coalesce(sum(strlen(content) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_offset,
  CASE WHEN i < 0 THEN 'Document '||doc_id ELSE 'Document '||doc_id||' > Part '||i END AS headings, content FROM md_chunks""",
    "markdown_chunks",
)(lambda spark, sf_dir: _parsed("chunks")(spark, sf_dir).withColumn("headings", F.array_join("heading_hierarchy", " > ")).drop("embedding", "title", "heading_hierarchy"))
query(_SECTIONS + " SELECT chunk_id AS src_chunk_id, 'doc'||(doc_id + 1)||'.md' AS target_path, 'next' AS link_text, 'top' AS anchor FROM md_last", "markdown_links")(_parsed("edges"))
query(
    _SECTIONS + " SELECT sha256(concat_ws(chr(0), chunk_id, 'text', lang, 'code-snippet', chunk_id)) AS snippet_id, chunk_id, 'text' AS language, lang AS content FROM md_last", "code_snippets"
)(_parsed("code"))


@query("SELECT doc_id, doc_id % 2 = 0 AS ok, CASE WHEN doc_id % 2 = 1 THEN 'doc_type' END AS error_field FROM documents")
def frontmatter_contract(spark, sf_dir):
    """Every second file lacks a required field."""
    files = _markdown_files(spark, sf_dir).withColumn("doc_id", F.regexp_extract("fs_rel", r"(\d+)", 1).cast("long"))
    broken = F.when(F.col("doc_id") % 2 == 1, F.encode(F.replace(F.decode("raw", "UTF-8"), F.lit("doc_type: page\n"), F.lit("")), "UTF-8")).otherwise(F.col("raw"))
    out = parse(files.withColumn("raw", broken), parts=())
    return out.select(F.regexp_extract("fs_rel", r"(\d+)", 1).cast("long").alias("doc_id"), F.col("error").isNull().alias("ok"), "error_field")
