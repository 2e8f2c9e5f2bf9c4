"""Which stores may be written, reports of sources, repairs of stores, and lookups by Bloom filters."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.errors import ConfigError, PathError, StoreError
from quillspark.operators import upsert
from quillspark.plans.ingest import full_sync, plan, prewarm
from quillspark.sources.config import Problem, Source, report
from quillspark.sources.posture import Posture, has_content, opened_stores, postures
from quillspark.sources.store import Store

FILE = "---\ntitle: T{0}\nsource: s\ningested_at: 2026-01-01\ndoc_type: page\nsource_path: p{0}.md\n---\n# T{0}\n\ntext {0}\n"


@pytest.fixture
def folder(tmp_path):
    for name, files in {"full": ["a.md"], "empty": [], "other": ["a.pdf"], "deep": ["x/y/b.markdown"]}.items():
        (tmp_path / "in" / name).mkdir(parents=True)
        for f in files:
            (tmp_path / "in" / name / f).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / "in" / name / f).write_text(FILE.format(len(f)))
    return tmp_path


def source(folder, name, database, **more):
    return Source("local", name, str(folder / "in" / name), database=database, **more)


def test_only_stores_with_content_are_written(spark, folder):
    base = str(folder / "stores")
    sources = [source(folder, "full", "one"), source(folder, "empty", "two"), source(folder, "other", "three"), source(folder, "absent", "four"), source(folder, "deep", "five"), source(folder, "full", "six", exclude=("*.md",))]
    served = [f"{base}/{n}" for n in ("one", "two", "three", "four", "five", "six", "dropped")]
    found = postures(spark, served, sources, base, str(folder / "in"))
    assert [p.generation for p in found.stores] == [True, False, False, False, True, False, False]
    assert [p.path for p in found.stores] == served and [s.id for s in found.sources] == ["full", "deep"]
    # A source outside the root promotes nothing; nor does anything when all is to be read only, or without sources.
    assert not any(p.generation for p in postures(spark, served, sources, base, str(folder / "stores")).stores)
    assert postures(spark, served, sources, base, str(folder / "in"), read_only=True) == ([Posture(p, False) for p in served], [])
    assert not any(p.generation for p in postures(spark, served, [], base, str(folder)).stores)
    # The same store by another name; a store is opened as its posture says, absent read-only ones are left out.
    (folder / "stores").mkdir()
    (folder / "link").symlink_to(folder / "stores")
    again = postures(spark, [f"{folder}/link/one", served[1]], sources, base, str(folder / "in"))
    assert [p.generation for p in again.stores] == [True, False]
    assert [(s.path, s.writable) for s in opened_stores(spark, again)] == [(f"{folder}/link/one", True)]
    assert opened_stores(spark, postures(spark, [], [], base, str(folder))) == []


def test_walk_errors_count_against_a_source(spark, folder, monkeypatch):
    from quillspark.sources import posture

    def broken(*_):
        raise OSError("gone")

    assert has_content(spark, source(folder, "full", None), str(folder))
    monkeypatch.setattr(posture, "list_files", broken)
    assert not has_content(spark, source(folder, "full", None), str(folder))


def test_report_tells_everything(folder):
    sources = [source(folder, "full", None), source(folder, "absent", None, include=("{a",)), source(folder, "deep", None, formats=("docx",)), Source("database", "d", "/nowhere")]
    told = report(sources, str(folder))
    assert (told.valid, told.total, told.is_valid) == (2, 4, False)
    assert [(p.source_id, p.field) for p in told.problems] == [("absent", "path"), ("absent", "include"), ("deep", "formats")]
    assert isinstance(told.problems[0], Problem) and "does not exist" in told.problems[0].message
    assert [p.field for p in report(sources[:1], str(folder / "stores")).problems] == ["path"]
    with pytest.raises(ConfigError, match="2 of 4 sources"):
        plan(sources, str(folder))
    with pytest.raises(PathError):
        plan(sources[:1], str(folder / "in" / "deep"))


def test_sync_checks_containment_and_prewarm_tells_progress(spark, folder):
    store = Store(spark, f"file://{folder}/store")
    with pytest.raises(PathError):
        full_sync(store, source(folder, "full", None), allowed_root=str(folder / "stores"))
    sink = folder / "log.jsonl"
    m = prewarm({"s": store}, {"s": [source(folder, "full", None), source(folder, "deep", None)]}, allowed_root=str(folder), sink=str(sink))
    lines = [json.loads(x) for x in sink.read_text().splitlines()]
    assert [x["event_type"] for x in lines] == ["prewarm.progress"] * 2 + ["prewarm.complete"] and [x["payload"].get("percent") for x in lines] == [50, 100, None]
    assert (m.added, m.chunks, m.errors) == (2, 2, []) and lines[2]["payload"]["files_synced"] == 2
    assert {r["last_sync"][-1] for r in store.read("syncs").collect()} == {"Z"}


def test_repair(spark, folder):
    store = Store(spark, f"file://{folder}/store")
    full_sync(store, source(folder, "full", None))
    full_sync(store, source(folder, "deep", None))
    assert store.problems() == []
    # A commit that never ended.
    (folder / "store" / "v9-torn" / "chunks" / "66").mkdir(parents=True)
    assert store.problems() == ["v9-torn is of a commit that never ended"]
    with store.lock():
        assert store.repair() == ["v9-torn is deleted"] and store.problems() == []
    # A torn table of the last commit: the one before is current again, in a new version.
    last = store.state["tables"]["chunks"]["deep"]
    (folder / "store" / last / "_SUCCESS").unlink()
    assert [p for p in store.problems() if p.startswith(last)]
    with store.lock():
        assert store.repair() == ["version 1 is current again"]
    assert store.source_ids() == ["full"] and store.state["version"] == 3 and store.read("chunks").count() == 1
    full_sync(store, source(folder, "deep", None))
    assert Store(spark, store.path).source_ids() == ["deep", "full"]
    # An unreadable pointer: nothing is read or written until it is mended.
    (folder / "store" / "_current").write_text("{")
    (folder / "store" / "._current.crc").unlink(missing_ok=True)
    broken = Store(spark, store.path)
    assert broken.problems() == ["the pointer can't be read"]
    with pytest.raises(StoreError, match="repair"):
        broken.read("chunks")
    with broken.lock():
        assert broken.repair() == ["version 4 is current again"]
    assert broken.read("chunks").count() == 2
    # A file that is no Parquet, and then nothing whole at all.
    for version in (folder / "store").glob("v*"):
        for part in version.rglob("part-*.parquet"):
            part.write_bytes(b"nothing")
        for crc in version.rglob(".part-*.crc"):
            crc.unlink()
    assert any("can't be read" in p for p in broken.problems())
    with broken.lock():
        assert broken.repair() == ["nothing whole was found: the store is empty"]
    assert broken.source_ids() == []


def test_lookup_reads_one_row_group(spark, tmp_path):
    """A chunk is looked up by Bloom filters of row groups whose statistics can't tell."""
    from quillspark.schema import TABLES

    store = Store(spark, f"file://{tmp_path}/store")
    rows = spark.range(0, 40_000, 1, 1).select(
        F.sha2(F.col("id").cast("string"), 256).alias("chunk_id"), F.lit("s").alias("source_id"), F.concat(F.lit("p"), F.col("id")).alias("path"), F.lit(None).cast("string").alias("title"),
        F.col("id").alias("position"), F.lit(0).cast("long").alias("char_offset"), F.array().cast("array<string>").alias("heading_hierarchy"), F.repeat(F.lit("x"), 30).alias("content"), F.lit(None).cast("array<float>").alias("embedding"),
    )
    spark.conf.set("parquet.block.size", str(256 << 10))
    try:
        with store.lock():
            store.commit({("chunks", "s"): spark.createDataFrame(rows.select(*TABLES["chunks"].names).rdd, TABLES["chunks"])})
    finally:
        spark.conf.unset("parquet.block.size")
    import pyarrow.parquet as pq

    groups = [pq.ParquetFile(p).num_row_groups for p in (tmp_path / "store").rglob("part-*.parquet")]
    assert sum(groups) >= 8
    one = store.read("chunks").where(F.col("chunk_id") == F.sha2(F.lit("777"), 256))
    found = one.collect()
    plan_ = one._jdf.queryExecution().executedPlan()
    assert [r["path"] for r in found] == ["p777"] and "PushedFilters: [IsNotNull(chunk_id), EqualTo(chunk_id," in plan_.toString()
    scan = plan_
    while scan.children().size():
        scan = scan.children().head()
    assert scan.metrics().apply("numOutputRows").value() <= 2 * 40_000 // sum(groups)


def test_attempts_and_ids(spark):
    chunks = spark.createDataFrame([("a", "s", "p"), ("b", "s", "q"), ("c", "t", "p")], "chunk_id string, source_id string, path string")
    vectors = spark.createDataFrame([("a", [1.0]), ("x", [1.0])], "chunk_id string, embedding array<double>")
    assert tuple(upsert.put_attempts(chunks, vectors).first()) == (2, 1)
    ids = lambda rows, ddl: sorted(r[0] for r in upsert.chunks_of_documents(chunks, spark.createDataFrame(rows, ddl)).collect())
    assert ids([("p",)], "path string") == ["a", "c"] and ids([("t", "p"), ("t", "p")], "source_id string, path string") == ["c"]
