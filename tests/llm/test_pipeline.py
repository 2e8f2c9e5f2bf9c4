"""The pipeline against a brute-force version of each stage's decision on its own input."""

import random
import zlib

import corpus_pipeline as pipeline
import numpy as np
from pyspark.sql import functions as F
from test_operators import WORD, check_packing, components, reference_ids, shingles

from quillspark.llm import language_id, quality

SF = "/root/testdata/sf0.001"


def rows(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_stages(spark, tmp_path):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    frames = [source]
    for name, stage in pipeline.STAGES:
        stage(spark, frames[-1], SF).write.parquet(f"file://{tmp_path}/{name}")
        frames.append(spark.read.parquet(f"file://{tmp_path}/{name}"))
        if name != pipeline.STAGES[-1][0]:
            assert frames[-1].columns == source.columns
    tables = [rows(f) for f in frames[:-1]]

    judged = {r["doc_id"]: r["quality_keep"] for r in quality.judged(frames[0], quality.train(frames[0])).collect()}
    assert set(tables[1]) == {i for i, keep in judged.items() if keep} and len(tables[1]) < len(tables[0])
    gold = rows(spark.read.parquet(f"{SF}/labels.parquet"))
    assert all(i in tables[1] for i, g in gold.items() if g["quality"])

    told = rows(language_id.identified(frames[1]))
    assert set(tables[2]) == {i for i, r in told.items() if r["lang_pred"] != "und" and r["score"] >= 0.5 and r["fit"] >= 1 / 3}
    assert all(i in tables[2] for i, g in gold.items() if g["quality"])

    ids = sorted(tables[2])
    groups = components([shingles(tables[2][i]["text"]) for i in ids])
    assert set(tables[3]) == {ids[g] for g in groups}
    assert all(tables[3][i] == tables[2][i] for i in tables[3])

    first = {}
    wanted = {}
    for i in sorted(tables[3]):
        w = WORD.findall(tables[3][i]["text"])
        for s in range(len(w) - 49):
            first.setdefault(tuple(w[s : s + 50]), (i, s))
    shared = {}
    for i in sorted(tables[3]):
        w = WORD.findall(tables[3][i]["text"])
        for s in range(len(w) - 49):
            shared.setdefault(tuple(w[s : s + 50]), set()).add(i)
    for i in tables[3]:
        w = WORD.findall(tables[3][i]["text"])
        gone = {p for s in range(len(w) - 49) if len(shared[tuple(w[s : s + 50])]) > 1 and first[tuple(w[s : s + 50])] != (i, s) for p in range(s, s + 50)}
        wanted[i] = [x for p, x in enumerate(w) if p not in gone]
    assert {i: WORD.findall(r["text"]) for i, r in tables[4].items()} == wanted
    assert all(r["n_chars"] == len(r["text"]) for r in tables[4].values())

    packed = frames[-1].collect()
    ids = dict(zip(tables[4], reference_ids([r["text"] for r in tables[4].values()]), strict=True))
    assert sum(r["length"] for r in packed) == sum(map(len, ids.values()))
    assert all(zlib.crc32(np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for r in packed)
    assert check_packing(packed, 4096) <= -(-sum(map(len, ids.values())) // 4096) + 1


def test_odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    empty = spark.createDataFrame([], schema)
    text = " ".join(f"word{i}" for i in range(60))
    odd = spark.createDataFrame([(1, text, None, None, None), (1, text, None, None, None), (2, None, None, None, None), (None, text, "en", "s", 1), (3, "plain words of a short text", "en", "s", 27)], schema)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
        assert stage(spark, odd, SF).count() >= 0
    kept = pipeline.near_duplicates_removed(spark, odd, SF).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept) == [(False, 1), (False, 2), (False, 3), (True, None)]


def test_clashing_columns_and_long_texts(spark):
    """Further columns pass through all stages whatever their names; a text of 10 MB is one document like others."""
    base = spark.read.parquet(f"{SF}/documents.parquet")
    names = ["score", "lang_pred", "_text", "spans", "rest", "quality_score", "quality_keep", "row", "component_id", "key", "a b.c"]
    more = base.select("*", *(F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names))
    long = more.where("lang = 'en'").orderBy(F.desc("n_chars")).limit(1).select(*[
        F.lit(10**6).cast("long").alias(c) if c == "doc_id" else F.expr("concat_ws(' ', transform(sequence(1, cast(ceil(10485760 / n_chars) as int)), i -> concat(i, ' ', text)))").alias(c) if c == "text" else F.col(f"`{c}`") for c in more.columns
    ])
    docs, plain = more.unionByName(long.select(*(F.col(f"`{c}`") for c in more.columns))), None
    for name, stage in pipeline.STAGES[:-1]:
        before = docs.columns
        docs = pipeline.scratch(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == before
    rows = docs.collect()
    assert all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names if r["doc_id"] < 10**6)
    assert 10**6 in {r["doc_id"] for r in rows}
    pieces = pipeline.STAGES[-1][1](spark, docs, SF).where("doc_id = 1000000").collect()
    text = next(r["text"] for r in rows if r["doc_id"] == 10**6)
    assert sum(r["length"] for r in pieces) == len(reference_ids([text])[0])


def test_foreign_and_random_texts_go(spark):
    """Texts in a language or alphabet that was not learned, and random letters, are rejected; clean ones stay."""
    rng = random.Random(1)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    gibberish = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10))) for _ in range(60))
    odd = ["Это предложение написано на русском языке и не похоже на другие тексты. " * 3, "这是一个用中文写的句子，与其他文本没有任何相似之处。" * 3, gibberish, "d41d8cd98f00b204e9800998ecf8427e " * 9]
    rows = spark.createDataFrame([(10**6 + i, t, None, "x", len(t)) for i, t in enumerate(odd)], docs.schema)
    kept = {r["doc_id"] for r in pipeline.known_language(spark, docs.unionByName(rows), SF).collect()}
    gold = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert not kept & set(range(10**6, 10**6 + 4)) and gold <= kept
