"""Fertility rules, hard negatives and whitening against brute force, and on odd rows."""

import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import fertility, hard_negatives, whitening
from quillspark.llm._tokens import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = "vec_id long, embedding array<double>, label int, score long, rank string, chunk int"


# Fertility


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    prose = "the river ran past old stone houses and people of the town came down to watch boats drift under bridges while evening fell".split()
    texts = [" ".join(rng.choice(prose) for _ in range(n)) + "." for n in (9, 10, 60, 300)]
    texts += ["\n".join(["same line here"] * 4 + ["", " ", "other", "same line here\r"]), "a b c d e a b c d e", "a b c d e f " * 20, "# * $ % & | < > # x y z", None, "", " \n\t", "one"]
    texts += ["Это обычный русский текст о реке и старом городе на берегу реки где жили люди", "これは 普通の 日本語の 文章 です 川の そばに 古い 町が あり 人々が 住んで いた", "𐎠𐎡𐎢 𐎣𐎤 𐎥𐎦 𐎧𐎨 𐎩𐎪 𐎫𐎬 𐎭𐎮 𐎯𐎰 𐎱𐎲 𐎳𐎴 𐎵"]
    texts += ["😀😁😂 " * 12, "x" * 5000, "zq" * 40 + " " + "a" * 3000 + " é ▁ \x0b\x0c\r\n ok", "word " * 70_000, "\x00 \x1f   nb sp"]
    return texts


def slow_rules(text, sp):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    runs = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if runs[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    ids = Counter()
    for w, n in Counter(words).items():
        for i in sp.encode(w):
            ids[i] += n
    total = sum(ids.values())
    bits = -sum(v / total * math.log2(v / total) for v in ids.values()) if total else None
    bytes_ = sum(v for i, v in ids.items() if sp.is_byte(i))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed, total, bits, bytes_


def test_fertility_equals_brute_force(spark, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary(fertility.VOCABULARY))
    docs = spark.createDataFrame([(i, t, "x", 0.1) for i, t in enumerate(texts)], "doc_id long, text string, script string, entropy double").repartition(3)
    found = {r["doc_id"]: r for r in fertility.fertility_rules(docs).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        n, chars, symbols, dup, repeated, failed, tokens, bits, bytes_ = slow_rules(text, sp)
        r = found[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["n_tokens"]) == (n, chars, symbols, dup, repeated, failed, tokens), i
        if not tokens:
            assert (r["chars_per_token"], r["byte_share"], r["entropy"], r["kept"], r["script"]) == (None, None, None, False, "none")
            continue
        assert r["chars_per_token"] == pytest.approx(chars / tokens) and r["byte_share"] == pytest.approx(bytes_ / tokens) and r["entropy"] == pytest.approx(bits, abs=1e-9)
        band = fertility.BANDS[r["script"]]
        inside = band.least_chars <= chars / tokens <= band.most_chars and bytes_ / tokens <= band.most_bytes and bits >= band.least_entropy * math.log2(min(tokens, fertility.ORDINARY))
        assert r["kept"] == (not failed and inside)


def test_fertility_scripts_and_bands(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    script = {r["doc_id"]: r["script"] for r in fertility.fertility_rules(docs).collect()}
    assert script[3] == "latin" and script[12] == "cyrillic" and script[13] == "kana_han" and script[14] == "other" and script[15] == "none"
    clean = [2, 3, 12, 13]
    kept = {r["doc_id"] for r in fertility.fertility_rules(docs).where("kept").collect()}
    assert kept >= set(clean) - {i for i in clean if slow_fails(texts[i])}
    # Letters that nobody writes that way: long runs of rare marks fall back to bytes.
    rare = spark.createDataFrame([(1, " ".join(chr(0x1D400 + k) * (1 + k % 4) + "a" for k in range(40)))], "doc_id long, text string")
    bands = fertility.BANDS | {"latin": fertility.Band(1.15, 8.0, 0.10, 0.25), "other": fertility.Band(1.15, 8.0, 0.10, 0.25)}
    assert not fertility.fertility_rules(rare, bands=bands).first()["kept"]


def slow_fails(text):
    import sentencepiece

    return slow_rules(text, sentencepiece.SentencePieceProcessor(model_file=vocabulary(fertility.VOCABULARY)))[5]


def test_fertility_of_nothing(spark):
    assert fertility.fertility_rules(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_pieces_forget_without_other_results():
    words = [f"w{k}" for k in range(40)] * 2
    few, many = fertility.Pieces(vocabulary(fertility.VOCABULARY), most=7), fertility.Pieces(vocabulary(fertility.VOCABULARY))
    for k in range(0, 80, 5):
        assert [x.tolist() for x in few.encode(words[k : k + 5])] == [x.tolist() for x in many.encode(words[k : k + 5])]


# Hard negatives


def slow_negatives(rows, positives=5, negatives=3):
    rows = sorted(rows)
    out = []
    for a, la, xa in rows:
        if a % 50:
            continue
        scored = sorted((-sum(p * q for p, q in zip(xa, x)), i, la == label) for i, label, x in rows if i != a)
        for s, positive, _ in [x for x in scored if x[2]][:positives]:
            fit = [(i, -t) for t, i, alike in scored if not alike and 50 * -s <= 100 * -t <= 95 * -s][:negatives]
            out += [(a, positive, k + 1, i, -s, t) for k, (i, t) in enumerate(fit)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, x array<long>")


@pytest.mark.parametrize("kind", ["random", "clustered", "copies", "lengths"])
@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 8 * 6 * 64, "leaves": 8}])
def test_mined_equals_brute_force(spark, kind, sizes):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(len(kind))
    n = 900
    if kind == "random":
        x = rng.integers(-20, 60, (n, 6))
    elif kind == "clustered":
        x = (rng.integers(-300, 300, (9, 6))[rng.integers(0, 9, n)] + rng.integers(-9, 10, (n, 6)))
    elif kind == "copies":  # a third of all rows are one vector, and ties are everywhere
        x = rng.integers(-1, 3, (n, 6))
        x[::3] = [2, 1, 0, 1, 2, 1]
    else:
        x = rng.integers(-9, 10, (n, 6)) * rng.integers(1, 200, (n, 1))
    rows = [(i, int(rng.integers(0, 4)), v.tolist()) for i, v in enumerate(x)]
    found = hard_negatives.mined(table(spark, rows).repartition(3), F.col("vec_id") % 50 == 0, **sizes)
    assert sorted(map(tuple, found.collect())) == slow_negatives(rows)


def test_chunks_go_to_shelves_not_to_blocks(spark, monkeypatch):
    """However many blocks there are, a chunk of anchors is shuffled once for each shelf at most, with all windows of an anchor."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(hard_negatives, "SHELVES", 3)
    rng = np.random.default_rng(8)
    rows = [(i, i % 4, v) for i, v in enumerate(rng.integers(-20, 60, (900, 6)).tolist())]
    to = hard_negatives.index(table(spark, rows), 8, 8 * 6 * 64)
    assert int(to.number.sum()) > 6 and to.shelf > 1
    windows = [{"slot": k, "low": -1e9, "high": 1e9, "floor": -np.inf, "done": -1} for k in range(5)]
    chunk = [{"anchor_id": i, "label": label, "x": x, "windows": windows} for i, label, x in rows[:40]]
    kind = pa.schema([("queries", pa.list_(pa.struct([("anchor_id", pa.int64()), ("label", pa.int32()), ("x", pa.list_(pa.int32())), ("windows", pa.list_(pa.struct([("slot", pa.int64()), ("low", pa.float64()), ("high", pa.float64()), ("floor", pa.float64()), ("done", pa.int32())])))])))])
    route = hard_negatives._route(to.tree, to.near, to.far, to.first, to.number, to.dims, to.whole, to.shelf)
    found = list(route(iter([pa.RecordBatch.from_pylist([{"queries": chunk}], schema=kind)])))
    places = [b.column("place")[0].as_py() for b in found]
    assert len(places) == len(set(places)) <= 3
    assert all(len(q["windows"]) == 5 for b in found for q in b.column("queries")[0].as_py())
    mined = hard_negatives.mined(table(spark, rows), F.col("vec_id") % 50 == 0, block_bytes=8 * 6 * 64, leaves=8)
    assert sorted(map(tuple, mined.collect())) == slow_negatives(rows)


def test_sent_anchors_are_not_broadcast(spark, monkeypatch):
    """A chunk becomes a row for each shelf, which Spark's estimate of a small input does not tell: these rows are shuffled."""
    from pyspark.sql import functions as F

    plans, write = [], hard_negatives.scratch

    def looked_at(df, label):
        if label in ("vp-first", "vp-found"):
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(hard_negatives, "scratch", looked_at)
    rng = np.random.default_rng(9)
    rows = [(i, i % 4, v) for i, v in enumerate(rng.integers(-20, 60, (900, 6)).tolist())]
    mined = hard_negatives.mined(table(spark, rows), F.col("vec_id") % 50 == 0, block_bytes=8 * 6 * 64, leaves=8)
    assert sorted(map(tuple, mined.collect())) == slow_negatives(rows)
    assert len(plans) == 4 and all("SortMergeJoin [place#" in p and "BroadcastHashJoin [place#" not in p for p in plans)


def test_search_skips_what_lies_outside():
    """Buckets whose bounds miss the annulus are not read, and nothing inside it is missed."""
    rng = np.random.default_rng(3)
    x = (rng.integers(-300, 300, (16, 8))[rng.integers(0, 16, 1024)] + rng.integers(-4, 5, (1024, 8))).astype(float)
    whole = float((x * x).sum(1).max())
    tree, order = hard_negatives.grow(x, 4, whole)
    assert sorted(order.tolist()) == list(range(1024))
    y, cuts, path = x[order], hard_negatives.leaf_bounds(1024, 4), tree.path(np.arange(16))
    h = hard_negatives._heights(y, whole)
    ends = [hard_negatives._apart(y[cuts[b] : cuts[b + 1]], h[cuts[b] : cuts[b + 1]], tree.points[path[b]], tree.heights[path[b]], whole, whole) for b in range(16)]
    near, far = np.array([d.min(0) for d in ends]), np.array([d.max(0) for d in ends])
    q = x[:50]
    square = (q * q).sum(1)
    low, high = hard_negatives.reach(tree, near, far, q, square, whole)
    d = square[:, None] + whole - 2 * q @ y.T
    for b in range(16):
        assert (d[:, cuts[b] : cuts[b + 1]].min(1) >= low[:, b]).all() and (d[:, cuts[b] : cuts[b + 1]].max(1) <= high[:, b]).all()
    best = np.sort(d, axis=1)[:, 4]
    assert (low > best[:, None]).mean() > 0.2


def test_hard_negatives_of_odd_rows(spark):
    rows = [(0, [1.0, 0.0], 1, 1, "a", 1), (1, [0.9, 0.1], 1, 1, "a", 1), (2, [0.7, 0.2], 2, 1, "a", 1), (3, [0.7, 0.2], 3, 1, "a", 1), (4, None, 2, 1, "a", 1), (5, [float("nan"), 1.0], 2, 1, "a", 1)]
    rows += [(6, [None, 1.0], 2, 1, "a", 1), (8, [0.7, 0.2], None, 1, "a", 1), (None, [0.7, 0.2], 2, 1, "a", 1), (9, [float("inf"), 0.1], 2, 1, "a", 1), (10, [], 2, 1, "a", 1), (11, [0.6], 5, 1, "a", 1), (2, [0.7, 0.2], 2, 1, "a", 1)]
    frame = spark.createDataFrame(rows, ODD)
    found = [tuple(r) for r in hard_negatives.mined(hard_negatives.vectors(frame), frame["vec_id"] == 0).collect()]
    scores = {1: 230 * 256, 2: 179 * 256, 3: 179 * 256, 11: 153 * 256}
    assert sorted(found) == [(0, 1, k, i, scores[1], scores[i]) for k, i in ((1, 2), (2, 3), (3, 11))]
    assert hard_negatives.hard_negatives(spark.createDataFrame([], ODD)).collect() == []
    with pytest.raises(ValueError, match="too long"):
        hard_negatives.index(table(spark, [(1, 1, [1 << 30])]))


# Whitening


def slow_whitening(x):
    """Deviations and covariance in exact fractions."""
    n, dims = len(x), len(x[0])
    sums = [sum(r[k] for r in x) for k in range(dims)]
    d = [[n * r[k] - sums[k] for k in range(dims)] for r in x]
    v = [[Fraction(sum(r[i] * r[j] for r in d), n**3) for j in range(dims)] for i in range(dims)]
    return d, np.array([[float(c) for c in row] for row in v])


def vectors(spark, values):
    return spark.createDataFrame([(i, v, i % 3, 1, "a", 2) for i, v in enumerate(values)], ODD)


@pytest.mark.parametrize("spread", [0.2, 3e6])
def test_whitening_equals_exact_fractions(spark, spread):
    rng = np.random.default_rng(8)
    values = rng.normal(0, spread, (300, 11)) @ np.diag(1.3 ** np.arange(11)) @ np.linalg.qr(rng.normal(size=(11, 11)))[0]
    frame = vectors(spark, values.tolist()).repartition(4)
    found = sorted(whitening.whitened_components(frame).collect(), key=lambda r: (r["vec_id"], r["component"]))
    assert len(found) == 300 * 8
    x = [[math.floor(1024 * c) + 100000 for c in v] for v in values.tolist()]
    d, v = slow_whitening(x)
    e, axes = np.linalg.eigh(v)
    for r in found:
        i, c = r["vec_id"], r["component"]
        axis, value = axes[:, -c], e[-c]
        square = sum(k * k for k in d[i])
        assert r["n"] == 300 and r["deviation"] == (square if square < 1 << 63 else None) and r["identity_error"] < 1e-9
        assert abs(r["whitened"]) == pytest.approx(abs(np.array(d[i], float) @ axis) / 300 / math.sqrt(value), abs=1e-8)
        assert r["explained"] == pytest.approx(value / np.trace(v), rel=1e-9)
    w = np.array([r["whitened"] for r in found]).reshape(300, 8)
    assert np.abs(np.cov(w.T, bias=True) - np.eye(8)).max() < 1e-9
    wide = whitening.whitened(frame).collect()
    assert len(wide) == 300 and all(int(r["deviation"]) == sum(k * k for k in d[r["vec_id"]]) for r in wide)


def test_products_are_exact_beyond_doubles(spark):
    rng = random.Random(2)
    x = [[rng.randrange(-(1 << 50), 1 << 50) for _ in range(4)] for _ in range(40)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "vec_id long, x array<long>").repartition(3)
    fit = whitening._fit(rows, 0)
    d, _ = slow_whitening(x)
    assert fit.rows == 40 and fit.sums.tolist() == [sum(r[k] for r in x) for k in range(4)]
    assert whitening.products(rows, fit, 0).tolist() == [[sum(r[i] * r[j] for r in d) for j in range(4)] for i in range(4)]
    big = whitening.Fit(1 << 40, fit.sums, 2 << 90)
    assert big.wide and whitening.together(whitening.digits(big.deviations(np.array(x)), big.number), whitening.DIGIT).tolist() == [[(v << 40) - s for v, s in zip(r, fit.sums)] for r in x]


def test_digits_come_together():
    x = np.array([0, 1, -1, (1 << 61) - 7, -(1 << 61) + 3])
    assert whitening.together(whitening.digits(x, 4), whitening.DIGIT).tolist() == x.tolist()
    assert all((p >= 0).all() for p in whitening.digits(x, 4)[:-1])


def test_whitening_of_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    bad = [None, [nan, 1.0], [inf, 1.0], [None, 1.0]]
    good = [[1.0, 2.0], [3.0, 1.0], [0.5, 0.25], [1.0, 2.0], [2.0]]
    found = whitening.whitened_components(vectors(spark, bad + good)).collect()
    d, v = slow_whitening([[math.floor(1024 * c) + 100000 for c in [*g, 0.0][:2]] for g in good])
    assert {r["vec_id"] for r in found} == {4, 5, 6, 7, 8} and len(found) == 10 and {r["n"] for r in found} == {5}
    assert {r["vec_id"]: r["deviation"] for r in found} == {4 + i: sum(k * k for k in r) for i, r in enumerate(d)}
    assert all(r["identity_error"] < 1e-9 for r in found)
    for empty in ([], [None], [[]]):
        frame = vectors(spark, empty) if empty else spark.createDataFrame([], ODD)
        assert whitening.whitened_components(frame).collect() == []
    alike = whitening.whitened_components(vectors(spark, [[1.0, 2.0]] * 3)).collect()
    assert len(alike) == 6 and {(r["whitened"], r["explained"], r["deviation"], r["identity_error"]) for r in alike} == {(0.0, 0.0, 0, 0.0)}
    flat = whitening.whitened_components(vectors(spark, [[1.0, 2.0], [2.0, 2.0]])).collect()
    assert sorted((r["component"], r["whitened"]) for r in flat) == [(1, -1.0), (1, 1.0), (2, 0.0), (2, 0.0)]


def test_short_vectors_in_one_task_only(spark):
    rows = spark.createDataFrame([(0, [1]), (1, [2])], "vec_id long, x array<long>").coalesce(1).unionByName(spark.createDataFrame([(2, [3, 4, 5])], "vec_id long, x array<long>").coalesce(1))
    assert whitening._fit(rows, 10).sums.tolist() == [6, 24, 25]
