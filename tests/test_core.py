"""Expressions, search and graph on small frames."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import exprs as E
from quillspark.operators import catalog, graph, search, sync, upsert


def test_glob():
    import re

    match = lambda g, p: bool(re.search(E.glob_regex(g), p))
    assert match("*.md", "a/b.md") and match("**/x.md", "x.md") and match("**/x.md", "a/b/x.md") and match("a/{b,c}?.md", "a/c1.md")
    assert not match("*.md", "a.MD") and match("[!a]x", "bx") and not match("[!a]x", "ax") and match("a.b+c", "a.b+c") and not match("a.b", "axb")
    with pytest.raises(ValueError):
        E.glob_regex("a{b")


def test_expressions(spark):
    row = spark.range(1).select(
        E.chunk_id(F.lit("c"), F.lit("s"), F.lit("")).alias("none"), E.link_anchor(F.lit("a#")).alias("empty"), E.link_anchor(F.lit("a#b#c")).alias("anchor"),
        E.link_path(F.lit("#x")).alias("path"), E.includes(F.lit("50% ÉCOLE"), "% é").alias("inc"), E.includes(F.lit("50x"), "5_x").alias("not"),
        E.cosine_distance(F.array(F.lit(0.0), F.lit(0.0)), [1, 0]).alias("zero"), E.cosine_distance(F.array(F.lit(0.0), F.lit(2.0)), [1, 0]).alias("right"),
        E.format_of(F.lit("a.b/C.MarkDown")).alias("ext"), E.format_of(F.lit("a.b/c")).alias("noext"),
    ).first()
    assert row.asDict() == {"none": None, "empty": None, "anchor": "b#c", "path": "", "inc": True, "not": False, "zero": None, "right": 1.0, "ext": "md", "noext": ""}


def chunks(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, source_id string, path string, content string, store_idx int")


def test_round_robin(spark):
    c = chunks(spark, [("a", "s", "p", "x", 0), ("b", "s", "p", "x", 0), ("b", "t", "p", "x", 1), ("c", "t", "p", "x", 1), ("d", "t", "p", "X", 1)])
    assert [r["chunk_id"] for r in search.search_text(c, "x").collect()] == ["a", "b", "c", "d"]
    assert [(r["chunk_id"], r["store_idx"]) for r in search.search_text(c, "x", top_k=2).collect()] == [("a", 0), ("b", 1)]
    assert [r["chunk_id"] for r in search.search_text(c, "x", source_id=" t ").collect()] == ["b", "c", "d"]
    assert search.search_text(c, "x", top_k=0).count() == 0 and search.clamp(99) == 50


def test_vectors(spark):
    rows = [(f"v{i}", [1.0 if j == i else 0.0 for j in range(4)], 0) for i in range(4)] + [("n", None, 0)]
    v = spark.createDataFrame(rows, "chunk_id string, embedding array<float>, store_idx int")
    assert [r["chunk_id"] for r in search.nearest(v, [0, 0, 1, 0], 2).collect()] == ["v2", "v0"]
    assert search.nearest(v, [0, 0, 1, 0], 0).count() == 0 and search.nearest(v, [0, 0, 1, 0], 9).count() == 4


def test_graph(spark):
    """A chain, a cycle, a link into another source and on from there, dangling links."""
    c = chunks(spark, [("a", "s", "a.md", "", 0), ("b", "s", "b.md", "", 0), ("b2", "s", "b.md", "", 0), ("t", "t", "t.md", "", 0), ("tb", "t", "b.md", "", 0), ("lone", "s", "l.md", "", 0), ("a", "z", "a.md", "", 1)])
    e = spark.createDataFrame([("a", "b.md", 0), ("b", "a.md", 0), ("b", "/t", 0), ("t", "b.md", 0), ("a", "/none", 0), ("a", "../b.md", 0)], "src_chunk_id string, target_path string, store_idx int")
    u = spark.createDataFrame([("/t", "t", 0), ("/dead", "zz", 0)], "canonical_url string, chunk_id string, store_idx int")
    go = lambda start, d: {r["chunk_id"]: (r["depth"], r["cross_source"]) for r in graph.traverse(spark, c, e, u, start, d).collect()}
    assert go("a", 1) == {"b": (1, False), "b2": (1, False)}
    assert go("a", 2) == {"b": (1, False), "b2": (1, False), "t": (2, True)}
    assert go("a", 9)["tb"] == (3, True) and "a" not in go("a", 9)
    assert go("a", 0) == {} and go("lone", 3) == {} and go("unknown", 3) == {}


def test_writes(spark):
    old = spark.createDataFrame([("a", [1.0]), ("b", None), ("c", [2.0])], "chunk_id string, embedding array<float>")
    new = spark.createDataFrame([("a", None, 1), ("b", [3.0], 1), ("b", [4.0], 2), ("d", None, 1)], "chunk_id string, embedding array<float>, seq int")
    got = {r["chunk_id"]: r["embedding"] for r in upsert.upsert_chunks(old, new, "seq").collect()}
    assert got == {"a": [1.0], "b": [4.0], "c": [2.0], "d": None}
    ids = spark.createDataFrame([("c",), ("zz",)], "chunk_id string")
    assert {r["chunk_id"]: r["embedding"] for r in upsert.null_vectors(old, ids).collect()}["c"] is None


def test_cycle_state(spark):
    F3 = "source_id string, fs_rel string, mtime long"
    stored = spark.createDataFrame([("s", "same", 5, None), ("s", "newer", 5, "n"), ("s", "older", 5, None), ("s", "gone", 5, "g"), ("s", "fails", 5, "f")], F3 + ", contract_path string")
    current = spark.createDataFrame([("s", "same", 5), ("s", "newer", 6), ("s", "older", 4), ("s", "fails", 9), ("s", "fresh", 1), ("s", "bad", 1)], F3)
    diff = sync.file_diff(current, stored)
    assert {r["fs_rel"]: r["change"] for r in diff.collect()} == {"same": "unchanged", "newer": "modified", "older": "unchanged", "gone": "deleted", "fails": "modified", "fresh": "added", "bad": "added"}
    done = spark.createDataFrame([("s", "newer", "n2"), ("s", "fresh", "x")], "source_id string, fs_rel string, contract_path string")
    failed = spark.createDataFrame([("s", "fails"), ("s", "bad")], "source_id string, fs_rel string")
    state = {r["fs_rel"]: (r["mtime"], r["contract_path"]) for r in sync.next_state(diff, stored, done, failed).collect()}
    assert state == {"same": (5, None), "older": (5, None), "newer": (6, "n2"), "fresh": (1, "x"), "fails": (5, "f")}
    assert {r["change"] for r in sync.file_diff(current, stored, force=True).collect()} == {"modified", "added", "deleted"}


def test_catalogue(spark):
    c = chunks(spark, [("a", "s", "p", "1", 1), ("a", "t", "p", "0", 0)])
    assert catalog.get_chunk(c, "a").first()["source_id"] == "t" and catalog.get_chunk(c, "zz").first() is None
    assert [r["content"] for r in catalog.first_store_wins(c, "chunk_id").collect()] == ["0"]


def test_mean_pool():
    import numpy as np

    from quillspark.functions.embed import mean_pool

    states = np.arange(12, dtype=np.float32).reshape(2, 3, 2)
    assert mean_pool(states, np.array([[1, 1, 0], [0, 0, 0]], bool)).tolist() == [[1, 2], [0, 0]]


def test_ranks_without_a_window_over_a_store(spark):
    import random

    rng = random.Random(0)
    ids = rng.sample([f"{i:x}é" for i in range(5000)], 400) + ["", "é", "日本語の文", "日本語の本"]
    hits = spark.createDataFrame([(c, k % 3) for k, c in enumerate(ids)], "chunk_id string, store_idx int")
    wanted = {c: n for s in range(3) for n, c in enumerate(sorted(ids[s::3], key=str.encode), 1)}
    assert {r["chunk_id"]: r["rn"] for r in search.ranked(hits).collect()} == wanted


def test_search_stays_within_a_store(spark):
    """With ``store_idx`` links don't lead into another store, and each hit is searched around in the first store that has it."""
    c = chunks(spark, [("a", "s", "a.md", "", 1), ("a", "s", "a.md", "", 0), ("b", "s", "b.md", "", 1), ("c", "s", "c.md", "", 0), ("d", "t", "d.md", "", 1)])
    e = spark.createDataFrame([("a", "b.md", 0), ("a", "b.md", 1), ("a", "c.md", 0), ("c", "/d", 0), ("d", "b.md", 1)], "src_chunk_id string, target_path string, store_idx int")
    u = spark.createDataFrame([("/d", "d", 1)], "canonical_url string, chunk_id string, store_idx int")
    assert [(r["chunk_id"], r["depth"]) for r in graph.around([("a", "s")], e, c, u, 3, ["a"]).collect()] == [("c", 1)]


def test_first_of_a_source_is_that_of_the_merged_list(spark):
    """Also with chunks that several stores have, and with rows that are there twice."""
    import random

    rng = random.Random(4)
    rows = [(f"{rng.randrange(400):03x}", f"s{rng.randrange(3)}", rng.randrange(3), "x") for _ in range(500)]
    rows = [(c, f"s{int(c, 16) % 3}", i, x) for c, _, i, x in rows] + [("00f", "s0", 0, "x")] * 2
    hits = spark.createDataFrame(rows, "chunk_id string, source_id string, store_idx int, content string")
    for k in (1, 7, 50):
        places = {}
        for i in range(3):
            for rn, c in enumerate(sorted(r[0] for r in rows if r[2] == i), 1):
                places.setdefault(c, []).append((rn, i))
        order = sorted((min(p), c) for c, p in places.items() if int(c, 16) % 3 == 1)[:k]
        found = [(r["rn"], r["store_idx"], r["chunk_id"]) for r in search.first_of_source(hits, "s1", k).collect()]
        assert found == [(*p, c) for p, c in order]
