"""Each operator against a brute-force version or an exact round trip, and on odd rows."""

import hashlib
import math
import random
import re
import tarfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import _lattice, jaccard_join, language_id, media, packing, quality, sentencepiece_sampling, simhash, substring_dedup, suffix_dedup, token_files
from quillspark.llm._spark import connected_components
from quillspark.llm._text import hash_strings, hashed_words, long_grams, minimisers, split_words
from quillspark.llm._tokens import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id long, score double, quality_keep string"


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}x" for _ in range(n))


def corpus(seed=0):
    """Random texts, copies, near copies, shared passages, odd rows."""
    rng = random.Random(seed)
    texts = [words(rng, rng.choice([3, 5, 30, 120, 400])) for _ in range(40)]
    passage = words(rng, 60)
    texts += [texts[3], texts[3].upper(), texts[10] + " tail", passage + " " + words(rng, 40), words(rng, 30) + "\n" + passage, passage[: len(passage) // 2]]
    near = words(rng, 150).split()
    for k in range(6):
        copy = list(near)
        for _ in range(k):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(99)}"
        texts.append(" ".join(copy))
    texts += ["", None, " \n ", "one", "one two", "one two", "x" * 5000, "a " * 300, "é ▁ \x0b日本 😀\r\n<|endoftext|> it's", "In. " * 120]
    return texts


def frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en" if i is None or i % 2 else "fr", f"src{k % 3}", None, 7, 0.5, "no") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return frame(spark, texts).repartition(3).cache()


def odd(spark):
    """Repeated rows, a null id, null everywhere else."""
    t = corpus(1)
    rows = [(1, t[20], None, None, None, None, None, None)] * 2 + [(None, t[20], "en", None, 1, 1, 1.0, ""), (2, None, "en", "s", 1, 1, 1.0, ""), (3, t[20], "en", "s", 1, 1, 1.0, "")]
    return spark.createDataFrame(rows, SCHEMA)


# 5


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def components(sets):
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return [top(i) for i in range(len(sets))]


@pytest.mark.parametrize("seed", [0, 5])
def test_jaccard(spark, seed):
    texts = corpus(seed)
    rng = random.Random(seed)
    for k in range(30):  # chains of texts on both sides of the threshold
        base = words(rng, 40 + k).split()
        for _ in range(4):
            base[rng.randrange(len(base))] = "z"
            texts.append(" ".join(base))
    sets = [shingles(t) for t in texts]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(frame(spark, texts).repartition(3)).collect()}
    assert got == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, components(sets), strict=True))}


def near_misses(rng, number, size, changed):
    """Texts that are alike, every two below 0.8."""
    base = fresh(rng, size)
    return [" ".join(f"v{rng.randrange(10**9)}" if rng.random() < changed else w for w in base) for _ in range(number)]


def test_jaccard_forms_few_pairs_of_near_misses(spark, monkeypatch):
    """Of texts that are alike but not enough, of any length, a few pairs each are verified, not all pairs."""
    made, verified = [], jaccard_join._verified

    def counted(pairs, *rest):
        made.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(jaccard_join, "_verified", counted)
    rng = random.Random(31)
    for number, size in ((40, 6000), (80, 6000), (500, 400)):
        made.clear()
        texts = near_misses(rng, number, size, 0.026 if size > 1000 else 0.03)
        got = jaccard_join.jaccard_components(frame(spark, texts)).collect()
        assert all(r["component_id"] == r["doc_id"] for r in got if size > 1000), size
        assert sum(made[:-1]) <= jaccard_join.STARS * jaccard_join.PIVOTS * number and made[-1] <= 2 * number, (number, size, made)


def test_jaccard_parts_of_long_texts(spark):
    """Links of texts of many parts, on both sides of the threshold and of the bands."""
    rng, texts = random.Random(32), []
    for size in (250, 300, 1000, 1060, 4080, 4600):
        base = fresh(rng, size)
        for share in (0.0, 0.01, 0.018, 0.0215, 0.0225, 0.024, 0.03):
            texts.append(" ".join(f"v{rng.randrange(10**9)}" if rng.random() < share else w for w in base))
        texts += [" ".join(base + fresh(rng, size // 5)), " ".join(base + fresh(rng, size * 6 // 25)), " ".join(base + fresh(rng, size * 13 // 50))]
    sets = [shingles(t) for t in texts]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(frame(spark, texts)).collect()}
    assert got == dict(enumerate(components(sets)))


def test_jaccard_counts_all_documents(spark, monkeypatch):
    """Grams that only documents outside any small sample hold are counted; which are frequent changes no result."""
    docs = [(i, "the same line of all these texts " + " ".join(f"w{i}x{k}" for k in range(12))) for i in range(60)]
    docs += [(100 + i, docs[i][1]) for i in range(5)] + [(200, None), (201, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    line = jaccard_join.gram_sets(pa.array(["the same line of all these texts"]))[1]
    frequent = jaccard_join.frequent_grams(frame)
    assert jaccard_join.frequent_among(line, frequent).all()
    own = jaccard_join.gram_sets(pa.array([" ".join(f"w3x{k}" for k in range(12))]))[1]
    assert jaccard_join.frequent_among(own, frequent).mean() < 0.2
    seen = []
    counted = jaccard_join._counted(5)(iter([pa.RecordBatch.from_pydict({"text": [t for _, t in docs]})]))
    for batch in counted:
        seen += batch.to_pylist()
    assert sum(r["seen"] for r in seen if r["counter"] >= 0) == sum(len(jaccard_join.gram_sets(pa.array([t], pa.string()))[1]) for _, t in docs)
    assert [r["seen"] for r in seen if r["counter"] < 0] == [len(docs)]
    found = sorted(map(tuple, jaccard_join.jaccard_components(frame).collect()))
    monkeypatch.setattr(jaccard_join, "frequent_grams", lambda docs, words: np.zeros(0, np.uint64))
    assert found == sorted(map(tuple, jaccard_join.jaccard_components(frame).collect()))


def test_jaccard_counts_come_in_few_rows():
    """A task's counts of a million counters are rows of many counters each, and the same counts."""
    batch = pa.RecordBatch.from_pydict({"text": pa.array([*corpus(2)[:200], None, ""], pa.string())})
    wanted = {r["counter"]: r["seen"] for b in jaccard_join._counted(5)(iter([batch])) for r in b.to_pylist()}
    rows = [r for b in jaccard_join._shelved(5)(iter([batch])) for r in b.to_pylist()]
    assert len(rows) <= (1 << jaccard_join.COUNTERS) // jaccard_join.SHELF + 1
    found = {r["shelf"] * jaccard_join.SHELF + i: n for r in rows if r["shelf"] >= 0 for i, n in enumerate(r["seen"]) if n}
    assert found | {-1: next(r["seen"] for r in rows if r["shelf"] < 0)[0]} == wanted
    summed = jaccard_join._summed(pa.Table.from_pylist([rows[0]] * 3, pa.schema([("shelf", pa.int32()), ("seen", pa.list_(pa.int32()))])))
    assert summed.column("seen")[0].as_py() == [3 * n for n in rows[0]["seen"]] and summed.column("total")[0].as_py() == 3 * sum(rows[0]["seen"])


def test_hashed_words_are_the_words():
    """Words hashed straight from the bytes have the hashes of split words, in texts of any odd kind and in slices."""
    rng = random.Random(41)
    pieces = ["a", "B", "b", " ", "\t", "\n", "\x0b", "\r", "\x1c", "\x00", "é", "İ", "日", "😀", "\x85", "\u00a0", "x" * 9, "y" * 8, "q" * 31, "Q" * 200]
    for _ in range(300):
        rows = pa.array([None if rng.random() < 0.1 else "".join(rng.choice(pieces) for _ in range(rng.randrange(30))) for _ in range(rng.randrange(8))], pa.string())
        for texts in (rows, rows.slice(1, 2), rows.slice(2)):
            w, (hashes, starts) = split_words(texts, lower=True), hashed_words(texts)
            assert starts.tolist() == w.starts.tolist()
            assert hashes.tolist() == hash_strings([w.vocab[c] for c in w.codes]).tolist()


def test_jaccard_frequent_grams(spark, monkeypatch):
    """With most grams taken for frequent the result is the same."""
    monkeypatch.setattr(jaccard_join, "frequent_grams", lambda docs, words: np.unique(np.concatenate([jaccard_join.gram_sets(pa.array(corpus(2)[:50]))[1][::2]])))
    texts = corpus(2)
    sets = [shingles(t) for t in texts]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(frame(spark, texts)).collect()}
    assert got == dict(enumerate(components(sets)))


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 130)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in links:
        if a != b:
            near[a].add(b), near[b].add(a)
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            for n in near[todo.pop()] - seen:
                seen.add(n), todo.append(n)
        assert got[start] == min(seen)
    assert set(got) == set(near)


# 2 and 4


def test_suffixes(spark, texts, docs):
    w = [WORD.findall(t or "") for t in texts]
    runs = defaultdict(list)
    for d, x in enumerate(w):
        for s in range(len(x) - 49):
            runs[tuple(x[s : s + 50])].append((d, s))
    wanted = {(d, s, *min(v)) for v in runs.values() if len({d for d, _ in v}) > 1 for d, s in v}
    got = {tuple(r) for r in suffix_dedup.repeated_runs(docs).collect()}
    assert got == wanted and wanted
    spans = suffix_dedup.repeated_spans(docs).collect()
    covered = {(r["doc_id"], r["is_first"], p) for r in spans for p in range(r["start_word"], r["start_word"] + r["n_words"])}
    assert covered == {(d, (d, s) == (fd, fs), p) for d, s, fd, fs in wanted for p in range(s, s + 50)}
    cut = {r["doc_id"]: r["text"] for r in suffix_dedup.without_repeats(docs).collect()}
    touched = {d for d, s, fd, fs in wanted if (d, s) != (fd, fs)}
    assert len(cut) == len(texts) and all(cut[i] == t for i, t in enumerate(texts) if i not in touched)
    for d in touched:
        gone = {p for e, s, fd, fs in wanted if e == d and (e, s) != (fd, fs) for p in range(s, s + 50)}
        assert WORD.findall(cut[d]) == [x for p, x in enumerate(w[d]) if p not in gone]


def test_minimisers():
    rng = np.random.default_rng(0)
    values, owner = rng.integers(1, 50, 300).astype(np.uint64), np.repeat([0, 1, 2], [10, 190, 100])
    wanted = np.zeros(300, bool)
    for i in range(300 - 6):
        if owner[i] == owner[i + 6]:
            wanted[i : i + 7] |= values[i : i + 7] == values[i : i + 7].min()
    assert (minimisers(values, 7, owner) == wanted).all()
    for n in range(1, 40):
        h = long_grams(np.arange(60, dtype=np.uint64) % np.uint64(11), n)
        assert len(h) == 61 - n and (h[:-11] == h[11:]).all() and len(set(h.tolist())) == min(11, 61 - n)


def slow_chains(matches):
    """The same chains by comparing each match with all before it."""
    m = sorted(set(matches))
    score, before = [0.0] * len(m), [-1] * len(m)
    for j, (d, a) in enumerate(m):
        best = max(((score[i] + 0.1 * (m[i][0] + m[i][1]), i) for i in range(j) if m[i][0] < d and m[i][1] < a), default=(-1e18, -1))
        gain = best[0] - 0.1 * (d + a)
        score[j], before[j] = (10 + gain, best[1]) if gain > 0 else (10.0, -1)
    return score


def test_chaining():
    rng = random.Random(1)
    for _ in range(30):
        matches = [(rng.randrange(60), rng.randrange(60)) for _ in range(rng.randrange(1, 40))]
        chains = substring_dedup.chains(matches)
        used = [x for c in chains for x in c]
        assert len(used) == len(set(used)) and all(a[0] < b[0] and a[1] < b[1] for c in chains for a, b in zip(c, c[1:], strict=False))
        best = max(slow_chains(matches))
        if chains and best >= 15:
            c = chains[0]
            gaps = sum((b[0] - a[0]) + (b[1] - a[1]) for a, b in zip(c, c[1:], strict=False))
            assert math.isclose(10 * len(c) - 0.1 * gaps, best, abs_tol=1e-6)
    def slow_equal(x, y):
        row = [(j, 0) for j in range(len(y) + 1)]  # (distance, -equal)
        for i, a in enumerate(x, 1):
            last, row[0] = row[0], (i, 0)
            for j, b in enumerate(y, 1):
                step = (last[0], last[1] - 1) if a == b else (last[0] + 1, last[1])
                last, row[j] = row[j], min(step, (row[j][0] + 1, row[j][1]), (row[j - 1][0] + 1, row[j - 1][1]))
        return -row[-1][1]

    for _ in range(500):
        x, y = ([rng.randrange(5) for _ in range(rng.randrange(9))] for _ in range(2))
        assert substring_dedup.equal_words(x, y) == slow_equal(x, y)
    assert substring_dedup.equal_words([1, 2, 3, 4], [1, 9, 3]) == 2 and substring_dedup.equal_words([], [1]) == 0
    assert substring_dedup.extend(np.array([1, 2, 9, 4, 5, 6]), np.array([1, 2, 3, 4, 5, 6])) == (6, 6, 5)


def test_passages(spark):
    rng = random.Random(4)
    texts = [words(rng, 300, 10**6) for _ in range(20)]
    passage = words(rng, 80, 10**6).split()
    fuzzy = list(passage)
    for p in (20, 41, 62):
        fuzzy[p] = "changed"
    del fuzzy[50]
    texts[5] += " " + " ".join(passage)
    texts[9] = " ".join(passage) + " " + texts[9]
    texts[12] = texts[12] + " " + " ".join(fuzzy) + " " + texts[13][:0] + words(rng, 50, 10**6)
    texts += ["", None, "a " * 300, "a " * 200]
    got = {(r["doc_id"], r["other_doc_id"]): r for r in substring_dedup.shared_passages(frame(spark, texts)).collect()}
    assert set(got) >= {(9, 5), (12, 5)} and {x for pair in got for x in pair} <= {5, 9, 12, 22, 23}
    assert (got[9, 5]["start_word"], got[9, 5]["n_words"], got[9, 5]["other_start_word"], got[9, 5]["share"]) == (0, 80, 300, 1.0)
    assert got[12, 5]["n_words"] == 79 and got[12, 5]["other_n_words"] == 80 and got[12, 5]["equal_words"] == 76


def fresh(rng, n):
    return [f"u{rng.randrange(10**9)}" for _ in range(n)]


def test_no_anchor_hides_a_pair(spark):
    """A passage of two documents is found although other, earlier documents hold its parts."""
    rng = random.Random(11)
    passage = fresh(rng, 135)
    docs = [fresh(rng, 60) + passage[k : k + 45] + fresh(rng, 60) for k in (0, 30, 60, 90)] + [passage + fresh(rng, 50), fresh(rng, 50) + passage]
    b, c = fresh(rng, 80), fresh(rng, 30)
    docs += [c + b[:40], b[35:] + c[:5], b + fresh(rng, 20), fresh(rng, 20) + b]
    got = {(r["doc_id"], r["other_doc_id"]): r for r in substring_dedup.shared_passages(frame(spark, [" ".join(d) for d in docs])).collect()}
    assert set(got) == {(5, 4), (9, 8)} and (got[5, 4]["n_words"], got[5, 4]["share"], got[9, 8]["n_words"]) == (135, 1.0, 80)


def test_many_holders_of_parts_hide_no_pair(spark):
    """Two documents share a passage; each piece of it stands in eight more documents."""
    rng = random.Random(21)
    passage = fresh(rng, 135)
    docs = [fresh(rng, 30) + passage + fresh(rng, 30) for _ in range(2)]
    docs += [fresh(rng, 9) + passage[a : a + 12] + fresh(rng, 9) for a in range(0, 124, 6) for _ in range(8)]
    rows = substring_dedup.shared_passages(frame(spark, [" ".join(d) for d in docs]), few=4).collect()
    assert [(r["doc_id"], r["other_doc_id"], r["n_words"], r["class_id"]) for r in rows] == [(1, 0, 135, 0)]


def test_recall_among_repeated_pieces(spark):
    """Edited passages of two or three documents whose pieces of four to twenty words many other documents repeat."""
    rng = random.Random(22)
    docs = []
    for k in range(12):
        passage = fresh(rng, rng.randrange(70, 120))
        for _ in range(2 + k % 2):
            copy = list(passage)
            for p in range(rng.randrange(9), len(copy), 14):
                copy[p] = f"x{rng.randrange(10**9)}"
            docs.append(fresh(rng, 20) + copy + fresh(rng, 20))
        for _ in range(60):
            a, n = rng.randrange(len(passage) - 20), rng.randrange(4, 20)
            docs.append(fresh(rng, 5) + passage[a : a + n] + fresh(rng, 5))
    words_of = [set(d) for d in docs]
    wanted = [(j, i) for i in range(len(docs)) for j in range(i) if len(words_of[i] & words_of[j]) >= 40 and alike(docs[i], docs[j])]
    rows = substring_dedup.shared_passages(frame(spark, [" ".join(d) for d in docs]), few=6).collect()
    direct, classes = {(r["other_doc_id"], r["doc_id"]) for r in rows}, {r[c]: r["class_id"] for r in rows for c in ("doc_id", "other_doc_id")}
    found = [p for p in wanted if p in direct or (p[0] in classes and classes[p[0]] == classes.get(p[1]))]
    assert len(wanted) >= 15 and len(found) >= 0.9 * len(wanted), (len(found), len(wanted))


@pytest.mark.parametrize("seed", [31, 32])
def test_common_seeds_leave_nothing_out(spark, seed):
    """Edited passages of which every piece stands in many documents: whatever joining all documents of a seed finds lies in one class."""
    rng = random.Random(seed)
    docs = []
    for k in range(10):
        passage = fresh(rng, rng.randrange(60, 90))
        for _ in range(2):
            copy = list(passage)
            for p in reversed(range(rng.randrange(6), len(copy), rng.choice((6, 7, 8)))):
                copy[p : p + 1] = rng.choice(([f"x{rng.randrange(10**9)}"], [], [copy[p], f"y{rng.randrange(10**9)}"]))
            docs.append(fresh(rng, 9) + copy + fresh(rng, 9))
            for _ in range(30):  # others hold pieces of it, up to 30 words long, with its edits
                a, n = rng.randrange(len(copy) - 30), rng.randrange(4, 30)
                docs.append(fresh(rng, 5) + copy[a : a + n] + fresh(rng, 5))
    rng.shuffle(docs)
    texts = frame(spark, [" ".join(d) for d in docs])
    whole = {(r["doc_id"], r["other_doc_id"]) for r in substring_dedup.shared_passages(texts, few=10**6).collect()}
    rows = substring_dedup.shared_passages(texts, few=2).collect()
    classes = {r[c]: r["class_id"] for r in rows for c in ("doc_id", "other_doc_id")}
    assert len(whole) >= 4 and [p for p in whole if p[0] not in classes or classes[p[0]] != classes.get(p[1])] == []
    assert all((r["doc_id"], r["other_doc_id"]) in whole for r in rows)


def test_classes_are_components(spark):
    rng = random.Random(23)
    a, b = fresh(rng, 60), fresh(rng, 60)
    docs = [a, a + fresh(rng, 9), b + fresh(rng, 5), a + b, fresh(rng, 90), b + fresh(rng, 7)]
    rows = substring_dedup.shared_passages(frame(spark, [" ".join(d) for d in docs])).collect()
    assert {r["class_id"] for r in rows} == {0} and {r[c] for r in rows for c in ("doc_id", "other_doc_id")} == {0, 1, 2, 3, 5}


def reached(pairs, n):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    return [top(i) for i in range(n)]


def alike(x, y, least=50, share=0.8):
    """Whether two texts share a passage: the best local alignment of words, over all places of both."""
    code = {w: i for i, w in enumerate(dict.fromkeys(x + y))}
    a, b = (np.array([code[w] for w in t]) for t in (x, y))
    score, best, at = np.zeros(len(b) + 1), 0, None
    rows = [score]
    for w in a:  # 1 for an equal word, -2 for an edit: a share above about 0.75 grows
        new = np.maximum(0, np.maximum(np.concatenate([[0], score[:-1] + np.where(b == w, 1, -2)]), score - 2))
        for j in range(1, len(new)):
            new[j] = max(new[j], new[j - 1] - 2)
        score = new
        rows.append(score)
        if score.max() > best:
            best, at = score.max(), (len(rows) - 1, int(score.argmax()))
    if at is None:
        return False
    (i, j), same = at, 0
    stop = at
    while i and j and rows[i][j] > 0:
        if rows[i][j] == rows[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -2):
            same += a[i - 1] == b[j - 1]
            i, j = i - 1, j - 1
        elif rows[i][j] == rows[i - 1][j] - 2:
            i -= 1
        else:
            j -= 1
    n, m = stop[0] - i, stop[1] - j
    return min(n, m) >= least and same >= share * max(n, m)


def test_recall_of_passages(spark):
    """Against brute force over all pairs: passages with 5 to 12 % of edits, evenly spread or at random, in two to twelve documents."""
    rng = random.Random(12)
    docs = []
    for k in range(60):
        passage, share = fresh(rng, rng.randrange(60, 120)), rng.choice([0.05, 0.08, 0.1, 0.12])
        for _ in range(rng.choice([2, 2, 3, 12])):
            copy = list(passage)
            places = range(k % 5, len(copy), int(1 / share)) if k % 2 else rng.sample(range(len(copy)), int(share * len(copy)))
            for p in places:
                copy[p] = rng.choice(["", f"x{rng.randrange(10**9)}", copy[p] + f" y{rng.randrange(10**9)}"])
            docs.append((" ".join(fresh(rng, rng.randrange(60)) + copy + fresh(rng, rng.randrange(60)))).split())
    docs += [fresh(rng, 100) for _ in range(20)]
    words_of = [set(d) for d in docs]
    wanted = [(j, i) for i in range(len(docs)) for j in range(i) if len(words_of[i] & words_of[j]) >= 40 and alike(docs[i], docs[j])]
    rows = substring_dedup.shared_passages(frame(spark, [" ".join(d) for d in docs])).collect()
    pairs = {(r["other_doc_id"], r["doc_id"]) for r in rows}
    group = reached(pairs, len(docs))
    found = sum(group[a] == group[b] for a, b in wanted) / len(wanted)
    direct = sum(p in pairs for p in wanted if all(x < 10**9 for x in p)) / len(wanted)
    print(f"recall {found:.3f}, direct {direct:.3f} of {len(wanted)}")
    assert found >= 0.9
    assert all(len(words_of[a] & words_of[b]) >= 35 for a, b in pairs)


def test_hot_seeds_in_lanes(spark, monkeypatch):
    """A passage of many documents links them all, in one order or in lanes; copies lead to their first text."""
    rng = random.Random(13)
    passage = fresh(rng, 70)
    docs = [" ".join(fresh(rng, 20) + passage) for _ in range(40)] + [" ".join(passage)] * 5
    for most in (4096, 10):
        monkeypatch.setattr(substring_dedup, "MANY", most)
        rows = substring_dedup.shared_passages(frame(spark, docs)).collect()
        pairs = [(r["doc_id"], r["other_doc_id"]) for r in rows]
        assert len(set(reached(pairs, len(docs)))) == 1 and len(rows) == len(set(pairs)) < 80
        assert {p for p in pairs if p[0] > 40} == {(41, 40), (42, 40), (43, 40), (44, 40)}


def test_alignment_goes_on_beyond_the_margin(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "MARGIN", 1)
    monkeypatch.setattr(substring_dedup, "STRETCH", 2)
    monkeypatch.setattr(substring_dedup, "SAMPLED", 16)
    rng = random.Random(14)
    passage = fresh(rng, 400)
    docs = [" ".join(fresh(rng, 30) + passage + fresh(rng, 30)) for _ in range(2)]
    rows = substring_dedup.shared_passages(frame(spark, docs)).collect()
    assert [(r["start_word"], r["n_words"], r["other_n_words"], r["share"]) for r in rows] == [(30, 400, 400, 1.0)]


# 1


def test_sampling(spark, texts, docs):
    voc = _lattice.vocabulary(vocabulary("piece_bpe_32k.model"))
    encoded = sentencepiece_sampling.encode(docs)
    back = {r["doc_id"]: r["text"] for r in sentencepiece_sampling.decode(encoded).collect()}
    assert back == dict(enumerate(texts))
    ids = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    again = {r["doc_id"]: r["ids"] for r in sentencepiece_sampling.encode(docs.repartition(5)).collect()}
    other = {r["doc_id"]: r["ids"] for r in sentencepiece_sampling.encode(docs, seed=1).collect()}
    assert ids == again and ids != other and ids[texts.index(None)] is None
    rows = sentencepiece_sampling.sampled_digests(docs).collect()
    assert all(r["lossless"] for r in rows) and all(r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest() for r in rows)
    assert all(r["ids_crc32"] == zlib.crc32(np.array(ids[r["doc_id"]] or [], "<u4").tobytes()) for r in rows)
    # Frequencies of sampled segmentations follow their exact posterior.
    known, weight = {p: i for p, i in voc.pieces}, voc.rank_weight
    number = {i: p for p, i in voc.pieces}

    def all_of(s):
        if not s:
            yield (), 1.0
        for n in range(1, len(s) + 1):
            if s[:n] in known:
                for rest, p in all_of(s[n:]):
                    yield (s[:n], *rest), weight[known[s[:n]]] * p

    wanted = dict(all_of("▁there"))
    total = sum(wanted.values())
    sampler = _lattice.Sampler(voc, sentencepiece_sampling.piece_weights(voc))
    flat, counts = sentencepiece_sampling.sample_ids(sampler, pa.array([" there"] * 20_000), pa.array(range(20_000)))
    at = np.concatenate([[0], np.cumsum(counts)])
    seen = Counter(tuple(number[i] for i in flat[a:b].tolist()) for a, b in zip(at, at[1:], strict=False))
    for pieces, p in wanted.items():
        assert abs(seen[pieces] / 20_000 - p / total) < 0.015
    # The last pieces of a run of rare characters follow the same posterior as those of a short one, however long it is.
    for run, tail in (("日", "一个数据获取"), ("ж", "которые"), ("😀", "there")):
        ends = []
        for n in (3, 2000):
            rows = 400
            flat, counts = sentencepiece_sampling.sample_ids(sampler, pa.array([" " + run * n + tail] * rows), pa.array(range(rows)))
            at = np.cumsum(counts)
            ends.append(Counter(tuple(flat[b - 2 : b].tolist()) for b in at.tolist()))
        assert sum((ends[0] - ends[1]).values()) < 0.15 * rows


def test_posterior_of_scripts_without_spaces():
    """Sampled frequencies equal an enumeration of all segmentations where words are not told apart by spaces."""
    voc = _lattice.vocabulary(vocabulary("piece_bpe_32k.model"))
    sampler = _lattice.Sampler(voc, sentencepiece_sampling.piece_weights(voc))
    known, weight = {p: i for p, i in voc.pieces}, sampler.weight[:, 0]

    def all_of(s):
        if not s:
            yield (), 1.0
        for n in range(1, min(16, len(s)) + 1):
            i = known.get(s[:n], voc.unknown if n == 1 else None)
            if i is not None:
                for rest, p in all_of(s[n:]):
                    yield (i, *rest), weight[i] * p

    for text in ("一个数据", "获取数据一个", "которые", "日曜日数据", "======"):
        wanted = dict(all_of(text))
        found = next(_lattice.segments(*_lattice.code_points(pa.array([text] * 8000))))
        rng = np.random.default_rng(0)
        ids, counts = sampler.sample(found, lambda live, step: rng.random(len(live)))
        at = np.concatenate([[0], np.cumsum(counts)])
        seen = Counter(tuple(ids[a:b].tolist()) for a, b in zip(at, at[1:], strict=False))
        assert set(seen) <= set(wanted)
        for ids_, p in sorted(wanted.items(), key=lambda x: -x[1])[:20]:
            assert abs(seen[ids_] / 8000 - p / sum(wanted.values())) < 0.03


@pytest.mark.parametrize("text", ["日" * 10_000, "的" * 10_000, "ж" * 10_000, "😀" * 3000, "ก" * 10_000, "=" * 10_000, "あ한" * 5000, "abcdefg" * 30_000])
def test_long_runs_neither_vanish_nor_are_cut(text):
    voc = _lattice.vocabulary(vocabulary("piece_bpe_32k.model"))
    weight = np.maximum(np.stack([voc.rank_weight, voc.rank_weight[::-1]], 1), _lattice.LEAST_WEIGHT)
    logs = []
    for n in (len(text), len(text) // 2):
        found = next(_lattice.segments(*_lattice.code_points(pa.array([text[:n]]))))
        assert len(found.points) == n
        logs.append(_lattice.Lattice(voc, found.points, found.starts).forward(weight)[0][0])
    assert np.isfinite(logs).all() and (logs[0] < logs[1]).all() and np.allclose(logs[0], 2 * logs[1], rtol=0.01)
    ids, counts = sentencepiece_sampling.sample_ids(_lattice.Sampler(voc, weight[:, 0]), pa.array([text]), pa.array([1]))
    assert sentencepiece_sampling.decode_ids(voc, ids) == text and counts[0] == len(ids)


def test_blocks_and_memory_change_nothing():
    voc = _lattice.vocabulary(vocabulary("piece_bpe_32k.model"))
    rng = random.Random(8)
    texts = pa.array([" ".join("".join(rng.choice("abcdeé日 \n") for _ in range(rng.randrange(1, 9))) for _ in range(300)) for _ in range(20)] + ["", None])
    whole = sentencepiece_sampling.sample_ids(_lattice.Sampler(voc, sentencepiece_sampling.piece_weights(voc)), texts, pa.array(range(22)))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(_lattice.segments, "__defaults__", (50,))
        for most in (0, 500, 10**6):
            again = sentencepiece_sampling.sample_ids(_lattice.Sampler(voc, sentencepiece_sampling.piece_weights(voc), most), texts, pa.array(range(22)))
            assert (again[0] == whole[0]).all() and (again[1] == whole[1]).all()


def slow_log(voc, text, weight):
    """The log of the summed weight of all segmentations, place by place, with exact fractions of logs."""
    known = {p: i for p, i in voc.pieces}
    sums = [np.zeros(weight.shape[1])]
    for e in range(1, len(text) + 1):
        parts = []
        for s in range(max(0, e - 16), e):
            i = known.get(text[s:e], voc.unknown if e - s == 1 else None)
            if i is not None:
                parts.append(sums[s] + np.log(weight[i]))
        sums.append(np.logaddexp.reduce(parts))
    return sums[-1]


def test_lattice_sums():
    voc = _lattice.vocabulary(vocabulary("piece_bpe_32k.model"))
    found = next(_lattice.segments(*_lattice.code_points(pa.array([" there is", "日x", "", "あ" * 50 + "https://a.b/c?d=" * 9]))))
    lattice = _lattice.Lattice(voc, found.points, found.starts)
    weight = np.maximum(np.stack([voc.rank_weight, voc.rank_weight[::-1]], 1), _lattice.LEAST_WEIGHT)
    logs, _ = lattice.forward(weight)
    for k, (a, b) in enumerate(zip(found.starts, found.starts[1:], strict=False)):
        assert np.allclose(logs[k], slow_log(voc, "".join(map(chr, found.points[a:b])), weight))
    used = lattice.expected(weight, np.ones((len(found.starts) - 1, 2)))
    length = np.array([1.0] * (voc.size + 1))
    for p, i in voc.pieces:
        length[i] = len(p)
    assert np.allclose((used * length[:, None]).sum(0), len(found.points))


# 3 and 10


def test_language(spark):
    rng = random.Random(0)
    make = {"en": ["the", "and", "that", "thing", "with"], "de": ["der", "und", "nicht", "schön", "über"], "fr": ["le", "que", "été", "où", "avec"]}
    rows = [(i, " ".join(rng.choice(v) for _ in range(30)), k) for i, (k, v) in enumerate(list(make.items()) * 40)]
    rows += [(1000, None, "en"), (1001, "123 …", None), (1002, "Schön und nicht über der", None), (1003, "x" * 3000, "en")]
    out = language_id.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    got = {r["doc_id"]: r for r in out}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[:120]) and any(r["held_out"] for r in out)
    assert got[1000]["lang_pred"] == got[1001]["lang_pred"] == "und" and got[1000]["score"] == 0 and got[1002]["lang_pred"] == "de"
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) == got[i]["held_out"] for i, _, _ in rows)
    unknown = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert language_id.identified(unknown).first()["lang_pred"] == "und"


def test_rare_language_is_learned(spark):
    """Every count of every language is learned from: 70,000 words of a common one don't push out those of a rare one."""
    rng = random.Random(5)
    rare = ["der", "und", "nicht", "schön", "über"]
    rows = [(i, " ".join(f"the{i}x{j} the{i}x{j}" for j in range(2000)), "en") for i in range(50)]
    rows += [(i, " ".join(rng.sample(rare, 5)), "xx") for i in range(50, 53)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs.where("doc_id < 52"))
    assert model.langs == ["en", "xx"] and np.allclose(model.weight.sum(0), 1, atol=1e-3)
    told = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs.select("doc_id", "text"), model).collect()}
    assert told[52] == "xx" and told[0] == "en"


def test_query_scores_equal_a_slow_scorer(spark):
    """Every text of the query's table, word by word, by sums over all segmentations."""
    rng = random.Random(3)
    make = {"en": ["the", "and", "that's", "thing"], "zh": ["数据获取一个", "日本語の文", "一个"], "ru": ["которые", "не", "слово"]}
    rows = [(i, " ".join(rng.choice(v) for _ in range(rng.randrange(1, 12))) + rng.choice(["", " x" * 3, "\n\tend"]), k) for i, (k, v) in enumerate(list(make.items()) * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs.where(~language_id.held_out()))
    voc = _lattice.vocabulary(vocabulary("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in language_id.identified(docs).collect()}
    for i, text, _ in rows:
        text = re.sub(r"[ \t-\r]+", "▁", " " + text.lower())
        sums = sum(slow_log(voc, part, model.weight) for part in re.findall(r"[▁\t-\r]*[^▁\t-\r]+|[▁\t-\r]+$", text))
        best = int(sums.argmax())
        assert got[i]["lang_pred"] == model.langs[best] and math.isclose(got[i]["score"], 1 / np.exp(sums - sums.max()).sum(), rel_tol=1e-6)


def test_a_language_of_thirty_documents_is_learned(spark):
    rng = random.Random(6)
    en, es = ["the", "and", "that", "thing", "with", "house"], ["el", "que", "niño", "también", "casa", "año"]
    rows = [(i, " ".join(rng.choice(en) for _ in range(8)), "en") for i in range(4000)] + [(i, " ".join(rng.choice(es) for _ in range(8)), "es") for i in range(4000, 4030)]
    got = language_id.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("doc_id >= 3950").collect()
    assert all(r["lang_pred"] == ("en" if r["doc_id"] < 4000 else "es") for r in got)


def test_language_sample_is_spread():
    assert language_id.every({"en": 1_000_000, "de": 50_000, "xx": 3}, 8_000) == {"en": 250, "de": 12, "xx": 1}
    assert language_id.every({"en": 5, "de": 7}, 8_000) == {"en": 1, "de": 1} and language_id.every({}, 8_000) == {}


def test_quality_on_gold_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r["quality_keep"] for r in quality.classified(docs).collect()}
    gold = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    right = [got[i] == bool(q) for i, q in gold.items()]
    assert sum(right) / len(right) > 0.97 and all(got[i] for i, q in gold.items() if q)


def slow_shares(text):
    """The shares that labellers look at, word by word."""
    w = WORD.findall(text or "")
    n, letters = len(w), sum(c.isalpha() for x in w for c in x)
    mark = lambda c: not (c.isalpha() or c.isdigit())
    part = lambda a, b: a / b if b else 0.0
    return {
        "words": n, "symbols": part(sum(mark(c) for x in w for c in x), sum(map(len, w))), "capitals": part(sum(c.isupper() for x in w for c in x), letters),
        "bars": part(sum(all(map(mark, x)) for x in w), n), "same": part(sum(a == b for a, b in zip(w, w[1:], strict=False)), n),
        "tailed": part(sum(len(x) > 2 and mark(x[-1]) and mark(x[-2]) for x in w), n), "distinct": part(len(set(w)), n),
        "ended": part(sum(len(x) > 1 and x[-1] in quality.SENTENCE_ENDS for x in w), n), "single": part(sum(len(x) == 1 for x in w), n),
    }


def slow_votes(f):
    three = lambda x, b: 0 if x >= b[0] else 1 if x < b[1] else -1
    v = [three(f[k], b) if f["words"] >= 5 else -1 for k, b in (("symbols", quality.MARKED), ("capitals", quality.CAPITAL), ("bars", quality.LISTED), ("same", quality.SAME), ("tailed", quality.TAILED))]
    d, e = f["distinct"], f["ended"]
    v.append((0 if d < 0.25 else 1 if d >= 0.5 else -1) if 20 <= f["words"] < 2000 else -1)
    v.append((1 if 1 / 60 <= e <= 1 / 4 else 0 if e < 1 / 240 or e > 1 / 2 else -1) if f["words"] >= 20 else -1)
    return [*v, three(f["single"], quality.SINGLE) if f["words"] >= 5 else -1]


def test_quality_against_brute_force(spark, texts):
    """Votes, estimated accuracies and scores of the whole query, document by document."""
    texts = [*texts, "AB CD " * 30, "a | b | c " * 20, "odd### word$$$ " * 15, "Plain words end here. And there, too. " * 5, "same same same same same same " * 9]
    docs = frame(spark, texts)
    got = {r["doc_id"]: r for r in quality.classified(docs).collect()}
    model = quality.train(docs)
    shares = [slow_shares(t) for t in texts]
    v = [slow_votes(f) for f in shares]
    assert quality.votes(quality.features(pa.array([t or "" for t in texts]))).tolist() == v
    good, says = 0.9, None
    post = [(1 - max(0.6, (x.count(0) + 0.5) / (sum(y >= 0 for y in x) + 2)) if 0 in x else 0.9) for x in v]
    for _ in range(quality.EM_ROUNDS):
        good = min(0.99, max(0.01, sum(post) / len(post)))
        says = [[min(0.999, max(0.001, (sum(q for q, x in zip(p, v, strict=True) if x[k] == 1) + 1) / (sum(q for q, x in zip(p, v, strict=True) if x[k] >= 0) + 2))) for k in range(len(v[0]))] for p in (post, [1 - q for q in post])]
        like = [[math.prod(s if y == 1 else 1 - s for y, s in zip(x, row, strict=True) if y >= 0) for row in says] for x in v]
        post = [good * a / (good * a + (1 - good) * b) for a, b in like]
    assert math.isclose(model.labels.good, good, rel_tol=1e-6) and np.allclose(model.labels.says_good, says)
    for i, (text, f) in enumerate(zip(texts, shares, strict=True)):
        w = WORD.findall(text or "")
        dense = [min(2, f[k] / b[0]) for k, b in (("symbols", quality.MARKED), ("capitals", quality.CAPITAL), ("bars", quality.LISTED), ("same", quality.SAME), ("tailed", quality.TAILED), ("single", quality.SINGLE))]
        z = float(np.dot(model.scorer.dense, [*dense, f["ended"] < 1 / 240, f["ended"] > 1 / 2, f["distinct"], 1]))
        for word, n in Counter(w).items():
            z += n / math.sqrt(len(w)) * model.scorer.words[int(quality.mix(quality.hash_strings([word.lower()]))[0]) % quality.BUCKETS]
        assert math.isclose(got[i]["quality_score"], 1 / (1 + math.exp(-z)) if w else 0.0, rel_tol=1e-6) and got[i]["quality_keep"] == (got[i]["quality_score"] >= 0.5)
        assert math.isclose(got[i]["weak_posterior"], post[i] if w else 0.0, rel_tol=1e-4, abs_tol=1e-9)


def test_weak_labels():
    """Accuracies of labellers that err independently are found without gold labels."""
    rng = np.random.default_rng(0)
    truth, right = rng.random(20_000) < 0.8, np.array([0.95, 0.85, 0.7, 0.9])
    v = np.where(rng.random((20_000, 4)) < right, truth[:, None], ~truth[:, None]).astype(int)
    v[rng.random(v.shape) < 0.2] = quality.ABSTAIN
    labels = quality.estimate(v, np.ones(len(v)), 200)
    assert abs(labels.good - 0.8) < 0.05 and np.allclose(labels.says_good[0], right, atol=0.05) and np.allclose(labels.says_good[1], 1 - right, atol=0.08)
    assert ((labels.posterior(v) > 0.5) == truth).mean() > 0.93
    assert (quality.unpack(quality.pattern(v[:50]), 4) == v[:50]).all()


# 6 and 9


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def test_words_equal_whole_texts():
    """Ids of words in a row equal those of whole texts, for letters that change under folding and composition too."""
    from tokenizers import Tokenizer

    from quillspark.llm._tokens import WordTokenizer

    library, own = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), WordTokenizer(vocabulary("word_bpe_49k.json"), most=3000)
    rng = random.Random(9)
    letters = "aZéİıßΣσςǅŉÅ한ᄒㅏ日ж\u0301\u0307\u0338न्ªⁿ²Ⅷ𝔸😀'’.,!?$#<>|[]()-_`~^%&*@/\\\"«»…\u200d\u00ad\u1e9e\u0130"
    texts = ["İ. x", "SİZİN, AΣ. AΣ, ΑΣ.Α it's. he'll!! x'. '..", "e\u0301. e\u0301!!", "<|endoftext|> A<|startoftext|>. x"]
    texts += [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) + rng.choice(["", ".", ",", "...", "$$$", "'s."]) for _ in range(6)) for _ in range(6000)]
    texts += ["".join(chr(c) for c in (rng.randrange(33, 0x3000), rng.randrange(0x41, 0x600), 46, 44)) for _ in range(6000)]
    for k in range(0, len(texts), 500):
        some = texts[k : k + 500]
        ids, counts = own.encode(pa.array(some))
        at = np.cumsum(counts)
        for text, a, b in zip(some, at - counts, at, strict=True):
            assert ids[a:b].tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_token_files(spark, texts, docs):
    wanted, start = {}, 0
    for i, ids in enumerate(reference_ids(texts)):
        wanted[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.token_digests(docs).collect()}
    assert got == wanted


def test_token_file_layout(spark, texts, docs, tmp_path):
    manifest = token_files.write_token_files(docs, f"file://{tmp_path}/t", vocabulary("word_bpe_49k.json"), length=16).collect()
    stream = [i for ids in reference_ids(texts) for i in ids]
    found = []
    for r in sorted(manifest):
        file = pa.ipc.open_file(pa.memory_map(r["path"].removeprefix("file://")))
        table = file.read_all()
        assert table.schema.field("input_ids").type.list_size == 16
        before = pa.total_allocated_bytes()
        ids = file.get_batch(0).column("input_ids")[1].values.to_numpy(zero_copy_only=True)
        assert len(ids) == 16 and pa.total_allocated_bytes() - before < 4096  # a view of the mapped file
        mask = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table.column("attention_mask").chunks])
        flat = np.concatenate([c.flatten().to_numpy() for c in table.column("input_ids").chunks])
        assert mask.sum() == r["n_ids"] and not mask[r["n_ids"] :].any()
        found += flat[mask].tolist()
    assert found == stream


def check_packing(rows, capacity):
    total = defaultdict(list)
    for r in rows:
        total[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in total.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(total)


def test_packing(spark, texts, docs):
    wanted = {i: ids for i, ids in enumerate(reference_ids(texts))}
    rows = packing.packed_documents(docs, capacity=256).collect()
    for r in rows:
        ids = wanted[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == 256 * r["piece"] and len(ids) == r["length"] and zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"]
    assert sum(r["length"] for r in rows) == sum(map(len, wanted.values()))
    least = -(-sum(map(len, wanted.values())) // 256)
    assert least <= check_packing(rows, 256) <= least + 1


def test_packing_levels(spark):
    """Many small shards: what they leave over is pooled, so the number of bins stays near the bound."""
    rng = random.Random(0)
    sizes = [rng.randrange(1, 101) for _ in range(2000)]
    pieces = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(sizes)], packing.PIECE)
    rows = packing.pack(pieces, 100, shard=100).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(2000)) and len({(r["sequence_id"], r["offset"]) for r in rows}) == 2000
    plain = packing._best_fit([], sorted(range(2000), key=lambda i: -sizes[i]), sizes, 100)
    assert check_packing(rows, 100) <= 1.03 * len(plain)  # plain: best fit over all pieces at once


def test_genetic_steps():
    rng = random.Random(2)
    for _ in range(20):
        sizes = [rng.randrange(1, 60) for _ in range(40)]
        one = packing._best_fit([], list(range(40)), sizes, 100)
        two = packing._best_fit([], sorted(range(40), key=lambda i: -sizes[i]), sizes, 100)
        child = packing._crossover(one, two, sizes, 100, rng)
        assert sorted(i for b in child for i in b) == list(range(40)) and all(sum(sizes[i] for i in b) <= 100 for b in child)
        best = packing.evolve(sizes, 100, 0)[0]
        assert len(best) <= len(two) and packing._bins(packing._bin_numbers(best, 40)) == [sorted(b) for b in best] or len(best) <= len(two)


# 7 and 8


def test_simhash(spark, texts, docs):
    rows = {r["doc_id"]: r for r in simhash.edited_fingerprints(docs).collect()}
    order = sorted(range(len(texts)), reverse=True)
    for k, i in enumerate(order):
        own, after = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        n = len(own)
        edited = own[: n - n // 2] + after[: n // 2]
        assert (rows[i]["n_chars"], rows[i]["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = (bytes.fromhex(f) for f in (rows[i]["fingerprint"], rows[i]["edited_fingerprint"], rows[order[(k + 1) % len(order)]]["fingerprint"]))
        for other, near in ((b, rows[i]["near_edited"]), (c, rows[i]["near_next"])):
            apart = sum((x ^ y).bit_count() for x, y in zip(a, other, strict=True))
            assert math.isclose(near, 1 if not apart else min(1, max(0, math.cos(math.pi * apart / 128))), abs_tol=1e-12)
    assert rows[3]["fingerprint"] == rows[40]["fingerprint"] == rows[41]["fingerprint"]
    number = {i: int(r["fingerprint"], 16) for i, r in rows.items()}
    for i, r in rows.items():
        others = {number[j] for j in rows if 0 < (number[i] ^ number[j]).bit_count() <= simhash.RADIUS}
        assert (r["near_prints"], r["near_docs"]) == ((len(others), sum(n in others for n in number.values())) if i % 20 == 0 else (None, None))


def test_near_fingerprints_are_counted(spark):
    """Near copies of query documents are found by the block tables of the whole query."""
    rng = random.Random(21)
    base = fresh(rng, 900)
    texts = [" ".join(base)] + [" ".join(base[:k] + ["other"] + base[k + 1 :]) for k in range(1, 30)] + [" ".join(fresh(rng, 300)) for _ in range(20)]
    rows = {r["doc_id"]: r for r in simhash.edited_fingerprints(frame(spark, texts)).collect()}
    number = {i: int(r["fingerprint"], 16) for i, r in rows.items()}
    wanted = {i: len({number[j] for j in rows if 0 < (number[i] ^ number[j]).bit_count() <= 3}) for i in (0, 20, 40)}
    assert {i: rows[i]["near_prints"] for i in wanted} == wanted and wanted[0] > 0


def test_next_of_null_text(spark):
    """A null text is an empty one, in the order of equal ids too."""
    rows = simhash.edited_fingerprints(spark.createDataFrame([(2, "t"), (1, None), (1, "u")], "doc_id long, text string")).collect()
    assert next(r["near_next"] for r in rows if r["doc_id"] == 2) == simhash.likeness(*simhash.fingerprints(pa.array(["t", ""]))[:, None])[0]


def test_fingerprint_votes():
    text = "a b c d a b c"
    terms = Counter(tuple(text.split()[i : i + 3]) for i in range(5))
    w = split_words(pa.array([text]))
    h = simhash.grams(simhash.hash_strings(w.vocab)[w.codes], 3)
    assert len(h) == sum(terms.values()) and len(set(h.tolist())) == len(terms)
    bits = []
    for word in range(2):
        lanes = np.ascontiguousarray(simhash.mix(h + np.uint64(word * 0xA24BAED4963EE407 & (1 << 64) - 1)))
        bits += [sum(1 if int(x) >> b & 1 else -1 for x in lanes) > 0 for b in range(64)]
    assert (np.unpackbits(simhash.fingerprints(pa.array([text]))[0]).astype(bool) == np.array(bits)).all()


def test_near_pairs(spark):
    rng = random.Random(0)
    base = [rng.getrandbits(128) for _ in range(60)]
    values = base + [b ^ sum(1 << k for k in rng.sample(range(128), rng.randrange(6))) for b in base for _ in range(3)]
    found = {(r["a"], r["b"], r["distance"]) for r in simhash.near_pairs(spark.createDataFrame([(f"{v:032x}",) for v in values] + [(None,)], "fingerprint string")).collect()}
    whole = sorted({f"{v:032x}" for v in values})
    apart = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    assert found == {(a, b, apart(a, b)) for i, a in enumerate(whole) for b in whole[i + 1 :] if apart(a, b) <= 3}


def test_media(spark, texts, docs, tmp_path):
    rows = media.text_media(docs, str(tmp_path / "m")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r["media_sha256"] == hashlib.sha256(media.encode_png(payload)).hexdigest() and r["feature"] == media.feature(payload)
    names = [m.name for f in (tmp_path / "m").glob("*.tar") for m in tarfile.open(f).getmembers()]
    assert {n.removesuffix(".png") for n in names} == {r["media_sha256"] for r in rows}
    stored = media.store_payloads(media.text_payloads(docs), str(tmp_path / "m2"))
    meta = media.with_metadata(stored).collect()
    assert all((m["width"], m["bit_depth"], m["colour_type"]) == (192, 8, 0) and m["height"] == max(1, -(-m["n_bytes"] // 192)) for m in meta)
    assert stored.select("media_sha256", "shard", "offset").distinct().count() == len({m["media_sha256"] for m in meta})
    with pytest.raises(ValueError):
        media.decode_png(media.encode_png(b" " * 192)[:-20] + b"broken" * 4)


# Odd tables

RUNS = {
    1: sentencepiece_sampling.sampled_digests, 2: suffix_dedup.repeated_spans, 3: language_id.identified, 4: substring_dedup.shared_passages, 5: jaccard_join.jaccard_components,
    6: packing.packed_documents, 7: simhash.edited_fingerprints, 8: media.text_media, 9: token_files.token_digests, 10: quality.classified,
}
PER_ROW = (1, 3, 5, 7, 8, 9, 10)


@pytest.mark.parametrize("op", sorted(RUNS))
def test_empty_table(spark, op):
    assert RUNS[op](spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("op", sorted(RUNS))
def test_odd_rows(spark, op):
    rows = RUNS[op](odd(spark)).collect()
    if op in PER_ROW:
        assert Counter(r["doc_id"] for r in rows) == {1: 2, None: 1, 2: 1, 3: 1}
    if op == 5:
        assert {(r["doc_id"], r["component_id"]) for r in rows} == {(1, 1), (3, 1), (2, 2), (None, None)}
