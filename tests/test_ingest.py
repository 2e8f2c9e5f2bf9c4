"""Whole cycles over folders of files."""

import os
import time

import pytest

from quillspark import format as fmt
from quillspark.engine import Engine
from quillspark.errors import ConfigError, EmbeddingError, LockError, PathError, QueryError, StoreError, SyncError
from quillspark.functions.embed import HashingEmbedder, resolve
from quillspark.plans.ingest import dry_run, full_sync, incremental_sync, plan, sync_all
from quillspark.sources import config
from quillspark.sources.config import Source
from quillspark.sources.listing import contained, list_files
from quillspark.sources.store import Store

CLOCK = [time.time() - 10_000]


def write(root, name, body, path=None, **more):
    lines = "".join(f"{k}: {v}\n" for k, v in more.items())
    file = root / name
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_bytes(f"---\ntitle: T\nsource: s\ningested_at: now\ndoc_type: page\nsource_path: {path or name}\n{lines}---\n{body}".encode())
    CLOCK[0] += 5
    os.utime(file, (CLOCK[0], CLOCK[0]))


@pytest.fixture
def world(spark, tmp_path):
    root = tmp_path / "docs"
    write(root, "a.md", "# Alpha\n\nhello [b](b.md) and [far](/home)")
    write(root, "sub/b.md", "# Beta\n\nworld", "b.md")
    write(root, "home.markdown", "# Home", canonical_url="/home")
    (root / "skip.pdf").write_bytes(b"x")
    (root / "bad.md").write_bytes(b"\xff\xfe")
    (root / "link.md").symlink_to(root / "a.md")
    return root, Store(spark, str(tmp_path / "store")), Source("local", "s", str(root))


def paths(store):
    return sorted(r["path"] for r in store.read("chunks").select("path").distinct().collect())


def test_cycles(spark, world):
    root, store, source = world
    m = full_sync(store, source)
    assert m.chunks == 3 and m.links == 2 and [e["fs_rel"] for e in m.errors] == ["bad.md"] and m.exit_code == 1
    assert paths(store) == ["a.md", "b.md", "home.markdown"]
    # Nothing new: the file that failed is tried again, the store keeps its rows.
    m = incremental_sync(store, source)
    assert (m.added, m.modified, m.deleted) == (1, 0, 0) and len(m.errors) == 1
    (root / "bad.md").unlink()
    version = store.state["version"]
    assert incremental_sync(store, source).chunks == 0 and store.state["version"] == version
    # A change, a deletion, a rename of the identity.
    write(root, "a.md", "# Alpha\n\nchanged", "renamed.md")
    (root / "home.markdown").unlink()
    m = incremental_sync(store, source)
    assert (m.modified, m.deleted, m.errors) == (1, 1, [])
    assert paths(store) == ["b.md", "renamed.md"] and store.read("edges").count() == 0 and store.read("urls").count() == 0
    # Two files with one identity; one that takes an unchanged file's; a swap.
    write(root, "x.md", "x", "same.md")
    write(root, "y.md", "y", "same.md")
    write(root, "z.md", "z", "b.md")
    m = incremental_sync(store, source)
    assert sorted(e["fs_rel"] for e in m.errors) == ["x.md", "y.md", "z.md"] and paths(store) == ["b.md", "renamed.md"]
    for f in ("x.md", "y.md", "z.md"):
        (root / f).unlink()
    write(root, "a.md", "A", "b.md")
    write(root, "sub/b.md", "B", "renamed.md")
    m = incremental_sync(store, source)
    assert sorted(e["fs_rel"] for e in m.errors) == ["a.md", "sub/b.md"]
    # A reader of the old version still reads it.
    assert Store(spark, store.path, writable=False).read("chunks").count() == 2
    with pytest.raises(StoreError):
        Store(spark, store.path, writable=False).commit({})


def test_embeddings_survive(spark, world):
    root, store, source = world
    full_sync(store, source, HashingEmbedder(8))
    before = {r["chunk_id"]: r["embedding"] for r in store.read("chunks").collect()}
    assert all(len(v) == 8 for v in before.values())
    full_sync(store, source)
    assert {r["chunk_id"]: r["embedding"] for r in store.read("chunks").collect()} == before
    write(root, "a.md", "# Alpha\n\nhello [b](b.md) and [far](/home)\n\n## New\n\nx")
    incremental_sync(store, source)
    after = {r["chunk_id"]: r["embedding"] for r in store.read("chunks").collect()}
    assert len(after) == 4 and sum(v is None for v in after.values()) == 1
    assert {k: v for k, v in after.items() if v is not None} == before


def test_engine(spark, world):
    _, store, source = world
    full_sync(store, source, HashingEmbedder(8))
    engine = Engine([store, store], HashingEmbedder(8))
    hit = engine.search_text("HELLO")[0]
    assert hit["path"] == "a.md" and hit["heading_hierarchy"] == ["Alpha"]
    assert {r["path"]: r["cross_source"] for r in engine.traverse(hit["chunk_id"])} == {"b.md": False, "home.markdown": False}
    assert engine.search_semantic("world", 1)[0]["path"] == "b.md"
    hits, related = Engine([store]).research("hello")
    assert [h["path"] for h in hits] == ["a.md"] and len(related) == 2
    assert engine.status() == {"source_count": 2, "chunk_count": 6, "schema_version": 4}
    assert [s["source_id"] for s in engine.list_sources()] == ["s"] and engine.get_chunk("zz") is None
    assert len(engine.get_document("a.md")) == 1 and engine.get_document("a.md", "other") == []
    with pytest.raises(QueryError):
        engine.search_text("  ")
    with pytest.raises(EmbeddingError):
        Engine([store]).search_semantic("x")
    text = fmt.search_results([hit])
    assert text.startswith("## Search Results\n\n### Result 1\n\n**Chunk ID:** `") and "**Headings:** Alpha" in text
    assert "last synced: `never`" in fmt.sources(engine.list_sources()) and fmt.search_results([]) == "No results found."
    assert fmt.document("q", []) == "No chunks found for document `q`." and "(ID: `" in fmt.document("a.md", engine.get_document("a.md"))
    assert "### Related Context" in fmt.research("q", hits, related) and "-32000" in fmt.failure(QueryError("x"))
    assert "**Position:** 0" in fmt.chunk(engine.get_chunk(hit["chunk_id"])) and "**Chunks:** 6" in fmt.status(engine.status())


def test_lock_and_layout(spark, tmp_path):
    store, other = (Store(spark, str(tmp_path / "s")) for _ in range(2))
    with store.lock():
        with pytest.raises(LockError):
            other.lock().__enter__()
        with store.lock():  # the same writer
            pass
        with other.lock(force=True):
            assert not store.held.own()
        with pytest.raises(LockError):
            store.commit({})
    with store.lock():
        pass
    with pytest.raises(LockError):
        store.commit({})
    store.state |= {"schema": 3, "old": {"s": 3}}
    with pytest.raises(StoreError):
        store.read("chunks")
    with pytest.raises(StoreError):
        Store(spark, str(tmp_path / "none"), writable=False)


def test_a_lock_that_was_taken_over_stays(spark, tmp_path):
    mine, other = (Store(spark, str(tmp_path / "s")) for _ in range(2))
    lock = mine.lock().__enter__()
    other_lock = other.lock(force=True).__enter__()
    lock.__exit__()
    assert other_lock.own()
    other_lock.__exit__()
    assert not other_lock.own()


def test_two_writers_lose_nothing(spark, tmp_path):
    """Two stores opened at the same version commit one after the other: both commits are there."""
    for name in ("a", "b"):
        write(tmp_path / name, "x.md", f"# {name}")
    stores = [Store(spark, str(tmp_path / "s")) for _ in range(2)]
    for store, name in zip(stores, ("a", "b"), strict=True):
        full_sync(store, Source("local", name, str(tmp_path / name)))
    now = Store(spark, str(tmp_path / "s"), writable=False)
    assert sorted(r["source_id"] for r in now.read("chunks").collect()) == ["a", "b"] and now.state["version"] == 2
    assert sorted(r["source_id"] for r in now.read("sources").collect()) == ["a", "b"]
    now.vacuum(keep=0)
    assert now.read("chunks").count() == 2


def test_each_source_of_an_old_layout_is_rebuilt(spark, tmp_path):
    import json

    for name in ("a", "b"):
        write(tmp_path / name, "x.md", f"# {name}")
    sources, store = [Source("local", n, str(tmp_path / n)) for n in ("a", "b")], Store(spark, str(tmp_path / "s"))
    for source in sources:
        full_sync(store, source, HashingEmbedder(8))
    store.files.replace(f"{store.path}/_current", json.dumps({k: v for k, v in store.state.items() if k != "old"} | {"schema": 3}))
    store = Store(spark, store.path)
    with pytest.raises(SyncError):
        incremental_sync(store, sources[0])  # would lose the embeddings
    assert incremental_sync(store, sources[0], HashingEmbedder(8)).modified == 1
    with pytest.raises(StoreError):
        Store(spark, store.path, writable=False).read("chunks")
    assert incremental_sync(store, sources[1], HashingEmbedder(8)).modified == 1
    assert Store(spark, store.path, writable=False).read("chunks").count() == 2 and incremental_sync(store, sources[0]).modified == 0


def test_changed_epoch_without_an_embedder_is_refused(spark, world, monkeypatch):
    from quillspark.plans import ingest

    _, store, source = world
    full_sync(store, source, HashingEmbedder(8))
    monkeypatch.setattr(ingest, "EPOCH", "2")
    with pytest.raises(SyncError):
        incremental_sync(store, source)
    assert incremental_sync(store, source, HashingEmbedder(8)).chunks == 3


def test_rebuild_stops_at_duplicate_paths(spark, world):
    root, store, source = world
    full_sync(store, source)
    store.files.replace(f"{store.path}/_current", store.files.read(f"{store.path}/_current").replace('"schema": 4', '"schema": 3').replace(', "old": {}', ""))
    write(root, "again.md", "x", "a.md")
    with pytest.raises(SyncError, match="several files"):
        incremental_sync(Store(spark, store.path), source)


def test_plan_and_duplicate_intake(spark, tmp_path, world):
    root, _, source = world
    docs = str(root)
    assert [p.directory for p in plan([source, Source("database", "d", "x")], str(tmp_path))] == [docs]
    assert sorted(r["fs_rel"] for r in dry_run(spark, plan([source], str(tmp_path))).collect()) == ["a.md", "bad.md", "home.markdown", "sub/b.md"]
    with pytest.raises(PathError):
        plan([source], str(root / "sub"))
    both = [source, Source("local", "t", str(root / "sub"), database="other")]
    with pytest.raises(ConfigError):
        plan(both, str(tmp_path), spark)
    apart = [Source("local", "s", docs, exclude=("sub/*",)), both[1]]
    assert config.duplicate_intake(apart) == [("s", "t")] and config.duplicate_intake(apart, spark=spark) == []
    missing = [source, Source("local", "m", str(root / "none"), database="other")]
    assert config.duplicate_intake(missing, spark=spark) == [("s", "m")]
    assert config.served(both, str(tmp_path / "stores"), [str(tmp_path / "stores/default")]) == [str(tmp_path / "stores/default"), str(tmp_path / "stores/other")]


def test_figures_as_text(spark, world):
    _, store, source = world
    m = full_sync(store, source)
    assert m.skipped == 1 and m.moved_urls == 0 and '"skipped": 1' in fmt.metrics(m)
    assert fmt.iso_time(951_782_400) == "2000-02-29T00:00:00Z" and fmt.percent(1, 3) == 33 and fmt.percent(1, 0) == 0
    assert [fmt.file_size(n) for n in (1023, 1536, 1 << 20, 5 << 30)] == ["1023 B", "1.5 KiB", "1.0 MiB", "5.0 GiB"]
    assert [fmt.duration(n) for n in (7, 1500, 61_000, 3_723_000)] == ["7ms", "1.500s", "1m01s", "1h02m03s"]
    record = fmt.prewarm_record(m, 1, 0)
    assert '"prewarm.complete"' in record and '"1970-01-01T00:00:00Z"' in record and '"files_synced": 3' in record
    assert fmt.exit_code(m) == 1 and fmt.exit_code(QueryError("x")) == 2


def test_listing(spark, tmp_path, world):
    root, _, _ = world
    names = lambda **k: sorted(r["fs_rel"] for r in list_files(spark, "s", str(root), **k).collect())
    assert names() == ["a.md", "bad.md", "home.markdown", "skip.pdf", "sub/b.md"]
    assert names(formats=["md"]) == ["a.md", "bad.md", "home.markdown", "sub/b.md"]
    assert names(include=["*.md"], exclude=["sub/*"]) == ["a.md", "bad.md"]
    with pytest.raises(PathError):
        contained(str(tmp_path / "docs/../.."), str(root))


def test_config(tmp_path):
    text = "sources:\n- {type: local, id: a, path: docs, formats: [md]}\n- {type: database, id: d, path: x}\n"
    (tmp_path / "sources.yaml").write_text(text)
    found = config.load(config.config_files(str(tmp_path)))
    assert [(s.id, s.ingestible) for s in found] == [("a", True), ("d", False)]
    (tmp_path / "b.sources.yaml").write_text(text)
    (tmp_path / "c.sources.yaml").write_text("sources: []")
    with pytest.raises(ConfigError, match="must name a database"):
        config.load(config.config_files(str(tmp_path)))
    assert config.config_files(str(tmp_path / "none")) == []
    bad = [Source("local", "x/y", "p", formats=("pdf",), include=("{",)), Source("local", "q", "p", database="a/b"), Source("local", "q", "p/r")]
    assert len(config.problems_of(bad)) == 5
    assert config.duplicate_intake([Source("local", "a", "p"), Source("local", "b", "p/./q", database="other"), Source("local", "c", "pq", database="o")]) == [("a", "b")]
    with pytest.raises(ConfigError):
        config.parse("sources: [{type: git, id: a, path: b}]")
    assert resolve(True) is None and resolve(load=lambda: 1 / 0) is None


def test_sync_all_goes_on(spark, world, tmp_path):
    _, store, source = world
    m = sync_all({"": store}, {"": [Source("local", "none", str(tmp_path / "missing")), source]}, full=True)
    assert m.chunks == 3 and {e["source_id"] for e in m.errors} == {"none", "s"}


def test_stream(spark, world, tmp_path):
    from quillspark.streaming.watch import Progress, load_stream, stream_documents, watch

    root, store, source = world
    (root / "bad.md").unlink()
    load_stream(store, stream_documents(spark, str(root), "s"), source, str(tmp_path / "cp")).awaitTermination()
    assert "b.md" in paths(store)
    assert {"a.md", "sub/b.md"} <= {r["fs_rel"] for r in store.read("files").collect()}
    told = Progress()
    query = watch(store, [source], every="1 second", progress=told)
    try:
        for _ in range(120):
            if told.cycles or told.state == "failed":
                break
            time.sleep(0.5)
    finally:
        query.stop()
    assert told.cycles and "home.markdown" in paths(Store(spark, store.path))


def test_a_stream_writes_what_its_batch_changes(spark, world, tmp_path):
    from quillspark.streaming.watch import load_stream, stream_documents

    root, store, source = world
    (root / "bad.md").unlink()
    load_stream(store, stream_documents(spark, str(root), "s"), source, str(tmp_path / "cp")).awaitTermination()
    # A file that comes with the path of a loaded document replaces what that had, and nothing else is written.
    write(root, "later.md", "# Alpha\n\nonly this", "a.md")
    before = store.fragments("chunks", "s")
    load_stream(store, stream_documents(spark, str(root), "s"), source, str(tmp_path / "cp")).awaitTermination()
    assert store.fragments("chunks", "s") == store.fragments("files", "s") == before + 1
    assert ["only this" in r["content"] for r in store.read("chunks").where("path = 'a.md'").collect()] == [True]
    assert store.read("edges").count() == 0 and {"a.md", "later.md"} <= {r["fs_rel"] for r in store.read("files").collect()}


def folder_size(root):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names)


def test_a_small_change_is_a_small_write(spark, tmp_path):
    root, store, source = tmp_path / "many", Store(spark, str(tmp_path / "store")), Source("local", "m", str(tmp_path / "many"))
    for i in range(200):
        write(root, f"{i:03}.md", f"# Title {i}\n\n" + " ".join(f"word{i * j % 9973}" for j in range(1, 300)) + f"\n\n[next]({(i + 1) % 200:03}.md)\n\n```py\nx = {i}\n```", canonical_url=f"/u/{i}")
    full_sync(store, source)
    first = folder_size(store.path)
    write(root, "007.md", "# Title 7\n\nchanged [to](008.md)", canonical_url="/u/7")
    write(root, "008.md", "# Title 8", canonical_url="/u/7777")
    (root / "009.md").unlink()
    m = incremental_sync(store, source)
    assert (m.added, m.modified, m.deleted, m.unchanged) == (0, 2, 1, 197)
    assert folder_size(store.path) - first < first / 5
    assert all(store.fragments(t, "m") == 2 for t in ("chunks", "edges", "code", "urls", "files"))
    # What is read is what a store that loads the folder anew has.
    anew = Store(spark, str(tmp_path / "anew"))
    full_sync(anew, source)
    for table in ("chunks", "edges", "code", "urls", "files"):
        a, b = (sorted(map(str, s.read(table).collect())) for s in (store, anew))
        assert a == b and a, table
    # A reader that opens the store anew and a point lookup see the fragments as well.
    there = Store(spark, store.path, writable=False)
    content = there.read("chunks", "m").where("path = '007.md'").collect()
    assert len(content) == 1 and "changed" in content[0]["content"] and there.read("chunks").where("path = '009.md'").count() == 0
    assert store.problems() == []


def test_fragments_become_one_table_again(spark, world, monkeypatch):
    root, store, source = world
    (root / "bad.md").unlink()
    monkeypatch.setattr("quillspark.sources.store.MOST_FRAGMENTS", 3)
    full_sync(store, source)
    seen = []
    for n in range(4):
        write(root, "a.md", f"# Alpha\n\nversion {n} [b](b.md)")
        incremental_sync(store, source)
        seen.append(store.fragments("chunks", "s"))
        rows = store.read("chunks").where("path = 'a.md'").collect()
        assert len(rows) == 1 and f"version {n}" in rows[0]["content"] and paths(store) == ["a.md", "b.md", "home.markdown"]
        assert [r["target_path"] for r in store.read("edges").collect()] == ["b.md"]
    assert seen == [2, 3, 1, 2]
    # A row that went and comes again counts; old versions are kept while a fragment of theirs is current.
    (root / "a.md").rename(root / "a.off")
    incremental_sync(store, source)
    assert paths(store) == ["b.md", "home.markdown"]
    (root / "a.off").rename(root / "a.md")
    incremental_sync(store, source)
    with store.lock():
        store.vacuum(keep=0)
    assert paths(store) == ["a.md", "b.md", "home.markdown"] and store.problems() == []


def test_a_lost_fragment_is_told_and_repaired(spark, world):
    root, store, source = world
    full_sync(store, source)
    write(root, "a.md", "# Alpha\n\nnewer")
    incremental_sync(store, source)
    rows, gone = store.state["tables"]["chunks"]["s"][-1]
    store.files.delete(f"{store.path}/{gone}")
    assert store.problems() == [f"{gone} is gone"]
    with store.lock():
        store.repair()
    assert store.problems() == [] and "hello" in store.read("chunks").where("path = 'a.md'").first()["content"]
