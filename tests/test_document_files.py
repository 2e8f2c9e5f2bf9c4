"""The source of files: partitions, push-down, locations and contents."""

import os

import pytest
from pyspark.sql import functions as F

from quillspark.errors import PathError, SyncError
from quillspark.functions.exprs import allowed_format, passes_globs
from quillspark.sources.document_files import Reader, Wanted, format_of, read_files
from quillspark.sources.listing import contained, contents, list_files


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in {"a.md": "A", "b.Markdown": "BB", ".hidden.md": "H", "_under.md": "U", "c.pdf": "", "sub/d.md": "DDD", "sub/deep/é ü.md": "é", "sub/deep/x[1].md": "X", "other/e.md": "E"}.items():
        file = root / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    for k, path in enumerate(sorted(root.rglob("*.*"))):
        os.utime(path, (1000 + k, 1000 + k))
    (root / "link.md").symlink_to(root / "a.md")
    (root / "loop").symlink_to(root)
    (root / "empty").mkdir()
    return root


@pytest.fixture(scope="module")
def flat(tmp_path_factory):
    root = tmp_path_factory.mktemp("flat")
    for k in range(3000):
        (root / f"f{k:04}.md").write_bytes(b"x" * (k % 5))
    return root


def names(df):
    return sorted(r["fs_rel"] for r in df.select("fs_rel").collect())


EVERY = sorted(["a.md", "b.Markdown", ".hidden.md", "_under.md", "c.pdf", "sub/d.md", "sub/deep/é ü.md", "sub/deep/x[1].md", "other/e.md"])


@pytest.mark.parametrize("form", ["{}", "file://{}", "file:{}", "{}/"])
def test_every_file_once(spark, tree, form):
    df = read_files(spark, form.format(tree), files=2)
    assert names(df) == EVERY
    assert {r["fs_rel"]: bytes(r["raw"]) for r in df.collect()}["sub/deep/é ü.md"] == "é".encode()
    assert df.where("size <> length(raw)").count() == 0


def test_one_folder_is_many_partitions(spark, flat):
    df = read_files(spark, str(flat), contents=False, files=250)
    per = [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(per) == 12 and max(per) == 250 and sum(per) == 3000 and df.where("raw IS NOT NULL").count() == 0
    by_size = read_files(spark, str(flat), bytes=600)
    per = [r["n"] for r in by_size.groupBy(F.spark_partition_id()).agg(F.sum("size").alias("n")).collect()]
    assert len(per) >= 10 and max(per) <= 600 and sum(per) == 6000


def test_partitions_hold_ranges_not_files(flat):
    parts = Reader({"path": str(flat), "contents": "false"}).partitions()
    assert [len(p.value) for p in parts] == [1, 1] and parts[0].value[0].first == "f0000.md" and parts[1].value[0].last == "f2999.md"


def test_filters_reach_the_listing(spark, tree):
    df = read_files(spark, str(tree), contents=False)
    assert names(df.where("fs_rel LIKE 'sub/%'")) == ["sub/d.md", "sub/deep/x[1].md", "sub/deep/é ü.md"]
    assert names(df.where("fs_rel = 'a.md'")) == ["a.md"] and names(df.where("fs_rel IN ('a.md', 'sub/d.md', 'none')")) == ["a.md", "sub/d.md"]
    assert names(df.where("mtime > 1003 AND fs_rel <> 'c.pdf'")) == names(df.where("mtime >= 1004").where("fs_rel <> 'c.pdf'"))
    plan = df.where("fs_rel LIKE 'sub/%' AND mtime >= 1")._jdf.queryExecution().executedPlan().toString()
    assert "StartsWith" not in plan and ">=" not in plan  # the source has taken both
    reader = Reader({"path": str(tree), "contents": "false"})
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringStartsWith

    rest = list(reader.pushFilters([StringStartsWith(("fs_rel",), "sub/"), GreaterThan(("mtime",), 0), GreaterThan(("size",), 0), EqualTo(("fs_rel",), "sub/d.md"), EqualTo(("fs_rel",), "a.md")]))
    assert [f.attribute for f in rest] == [("size",)] and reader.partitions()[0].value == ()
    assert not reader.wanted.folder("other")


GLOBS = [((), ()), (("*.md",), ()), (("sub/**",), ("*x*",)), (("**/*.md",), ("_*", ".*")), (("{a,b}.*", "sub/*/?*.md"), ()), (("[!a]*",), ("sub/*",))]


@pytest.mark.parametrize("include, exclude", GLOBS)
@pytest.mark.parametrize("formats", [(), ("md",), ("markdown", "PDF")])
def test_globs_and_formats_as_the_columns_say(spark, tree, include, exclude, formats):
    """The test of a path in the source is that of the column expressions."""
    wanted = Wanted(include, exclude, formats)
    every = spark.createDataFrame([(p,) for p in [*EVERY, "x.MD", "noext", "a.b/c", ".md", "d/.md", "line\nbreak.md"]], "p string")
    by_column = {r["p"] for r in every.where(passes_globs(F.col("p"), include, exclude) & allowed_format(F.col("p"), formats)).collect()}
    assert {r["p"] for r in every.collect() if wanted.file(r["p"], 0)} == by_column


def test_list_files_and_contents(spark, tree):
    files = list_files(spark, "s", str(tree), formats=["md"], exclude=["sub/deep/*"], ignored=[str(tree / "other")])
    assert names(files) == [".hidden.md", "_under.md", "a.md", "b.Markdown", "sub/d.md"] and files.columns == ["source_id", "root", "fs_rel", "mtime"]
    read = contents(files, 5)
    assert {r["fs_rel"]: bytes(r["raw"]) for r in read.collect()} == {".hidden.md": b"H", "_under.md": b"U", "a.md": b"A", "b.Markdown": b"BB", "sub/d.md": b"DDD"}
    assert contents(files.limit(3), 1200).rdd.getNumPartitions() == 3
    assert {r["root"] for r in list_files(spark, "s", f"file://{tree}").collect()} == {f"file://{tree}"}


def test_nothing_there(spark, tree, tmp_path):
    assert names(read_files(spark, str(tree / "empty"))) == [] == names(read_files(spark, str(tree), formats=["docx"]))
    for bad in (tmp_path / "no", tree / "a.md"):
        with pytest.raises(SyncError):
            list_files(spark, "s", str(bad))


def test_contained_in_uris():
    assert contained("hdfs://n/a/b", "hdfs://n/a") == "hdfs://n/a/b"
    for path, root in (("hdfs://n/a/../b", "hdfs://n/a"), ("hdfs://n/ab", "hdfs://n/a"), ("s3://n/a/b", "hdfs://n/a"), ("/n/a", "hdfs://n/a")):
        with pytest.raises(PathError):
            contained(path, root)


def test_format_of():
    assert [format_of(p) for p in ("a.MD", "x/b.markdown", ".md", "x/.md", "a", "a.b/c", "a.tar.gz")] == ["md", "md", "", "", "", "", "gz"]
