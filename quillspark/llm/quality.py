"""A quality classifier from weak labels.

Overlapping heuristic labellers each vote good (1), bad (0) or abstain (-1) on a document. A document's votes are one
pattern; patterns are counted over all documents, and expectation maximisation on the counts (there are at most
``3 ** labellers`` of them) estimates the accuracy of each labeller and how many documents are bad, without any gold
label. The posterior of a pattern is the soft label of its documents. A linear scorer over hashed words and character
classes is then trained on soft labels, for a bounded sample of about ``TRAIN_DOCS`` documents, so that documents on
which all labellers abstain are judged as well. Every document is scored on its whole text and voted on once.

A document is rejected when its score, the probability of good quality, is below ``THRESHOLD``.

Defined results: a null text or one without words has score 0 and is rejected; repeated rows give repeated rows; an
empty table gives no rows; equal texts have equal scores; other columns pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._spark import schema_with
from quillspark.llm._text import U64, Words, hash_strings, mix, slices, split_words

TRAIN_DOCS, THRESHOLD = 8_000, 0.5
EM_ROUNDS, BUCKETS, EPOCHS, RATE, DECAY = 60, 1 << 14, 120, 0.5, 1e-4
ABSTAIN = -1
SENTENCE_ENDS = ".!?…。！？"
#: Shares of words or characters at which a labeller votes bad, and below which it votes good.
MARKED, CAPITAL, LISTED, SAME, TAILED, SINGLE = (0.25, 0.05), (0.4, 0.15), (0.15, 0.03), (0.2, 0.05), (0.3, 0.08), (0.25, 0.12)
#: Prose ends a sentence every four to sixty words, and half of its words or more are new; much less is a vote against it.
ENDED, DISTINCT = (1 / 60, 1 / 4), (0.25, 0.5)


def _per_word(vocab: list[str]) -> np.ndarray:
    """For each distinct word: symbols, upper-case letters, letters, digits, characters, is a bar, ends in a mark run, ends a sentence, is one character."""
    out = np.zeros((len(vocab), 9))
    if not vocab:
        return out
    points, where = np.unique(np.frombuffer("".join(vocab).encode("utf-32-le", "surrogatepass"), "<u4"), return_inverse=True)
    chars = [chr(p) for p in points.tolist()]
    kinds = np.array([[c.isalpha(), c.isdigit(), c.isupper()] for c in chars], bool)[where]
    letter, digit, upper = kinds.T
    size = np.fromiter(map(len, vocab), np.int64, len(vocab))
    end = np.cumsum(size)
    first, mark = end - size, ~(letter | digit)
    total = lambda x: np.add.reduceat(x, first, dtype=np.int64)
    out[:, 0], out[:, 1], out[:, 2], out[:, 3], out[:, 4] = total(mark), total(upper), total(letter), total(digit), size
    out[:, 5] = out[:, 0] == size
    out[:, 6] = (size > 2) & mark[end - 1] & mark[np.maximum(end - 2, 0)]
    out[:, 7] = np.isin(points[where[end - 1]], np.frombuffer(SENTENCE_ENDS.encode("utf-32-le"), "<u4")) & (size > 1)
    out[:, 8] = size == 1
    return out


class Features(NamedTuple):
    """Shares for each text, and its hashed words as (text, bucket, share) triples."""

    words: np.ndarray
    symbols: np.ndarray
    capitals: np.ndarray
    bars: np.ndarray
    same: np.ndarray
    tailed: np.ndarray
    distinct: np.ndarray
    ended: np.ndarray
    single: np.ndarray
    #: None unless asked for.
    triples: tuple[np.ndarray, np.ndarray, np.ndarray] | None


def _sums(owner: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(owner, values, rows)


def features(texts: pa.Array, hashed: bool = True) -> Features:
    w: Words = split_words(texts)
    rows, owner, n = len(texts), w.owner(), w.counts.astype(float)
    table = _per_word(w.vocab)
    each = lambda k: _sums(owner, table[w.codes, k], rows)
    with np.errstate(divide="ignore", invalid="ignore"):
        share = lambda a, b: np.nan_to_num(a / b, posinf=0.0)
        symbols, capitals = share(each(0), each(4)), share(each(1), each(2))
        bars, tailed, ended, single = (share(each(k), n) for k in (5, 6, 7, 8))
        again = np.zeros(len(w.codes), bool)
        again[1:] = (w.codes[1:] == w.codes[:-1]) & (owner[1:] == owner[:-1])
        same = share(_sums(owner, again, rows), n)
        folded = owner * len(w.vocab) + w.codes
        pair, count = np.unique(folded, return_counts=True)
        distinct, triples = share(np.bincount(pair // max(1, len(w.vocab)), minlength=rows).astype(float), n), None
    if hashed:
        bucket = (mix(hash_strings([x.lower() for x in w.vocab])) % U64(BUCKETS)).astype(np.int64)
        text = pair // max(1, len(w.vocab))
        triples = text, bucket[pair % max(1, len(w.vocab))] if len(pair) else pair, count / np.sqrt(np.maximum(n[text], 1))
    return Features(n, symbols, capitals, bars, same, tailed, distinct, ended, single, triples)


def _three(x: np.ndarray, bounds: tuple[float, float], enough: np.ndarray) -> np.ndarray:
    """Bad from the first bound on, good below the second, no vote between or where there is too little to tell."""
    vote = np.where(x >= bounds[0], 0, np.where(x < bounds[1], 1, ABSTAIN))
    return np.where(enough, vote, ABSTAIN)


def votes(f: Features) -> np.ndarray:
    """One column for each labeller."""
    some, many = f.words >= 5, f.words >= 20
    return np.stack(
        [
            _three(f.symbols, MARKED, some),
            _three(f.capitals, CAPITAL, some),
            _three(f.bars, LISTED, some),
            _three(f.same, SAME, some),
            _three(f.tailed, TAILED, some),
            np.where(many & (f.words < 2000), np.where(f.distinct < DISTINCT[0], 0, np.where(f.distinct >= DISTINCT[1], 1, ABSTAIN)), ABSTAIN),
            np.where(many, np.where((f.ended >= ENDED[0]) & (f.ended <= ENDED[1]), 1, np.where((f.ended < ENDED[0] / 4) | (f.ended > 2 * ENDED[1]), 0, ABSTAIN)), ABSTAIN),
            _three(f.single, SINGLE, some),
        ],
        axis=1,
    ).astype(np.int8)


LABELLERS = ("symbols", "capitals", "bars", "same", "tailed", "distinct", "ended", "single")


def dense(f: Features) -> np.ndarray:
    """The part of the scorer's input that is not hashed words; the last column is the bias."""
    cut = lambda x, b: np.clip(x / b[0], 0, 2)
    return np.stack([cut(f.symbols, MARKED), cut(f.capitals, CAPITAL), cut(f.bars, LISTED), cut(f.same, SAME), cut(f.tailed, TAILED), cut(f.single, SINGLE), f.ended < ENDED[0] / 4, f.ended > 2 * ENDED[1], f.distinct, np.ones(len(f.words))], axis=1)


def pattern(v: np.ndarray) -> np.ndarray:
    """Votes as one number in base 3."""
    return ((v.astype(np.int64) + 1) * 3 ** np.arange(v.shape[1])).sum(1)


def unpack(numbers: np.ndarray, labellers: int = len(LABELLERS)) -> np.ndarray:
    return (numbers[:, None] // 3 ** np.arange(labellers)) % 3 - 1


class Labels(NamedTuple):
    good: float
    #: Of each labeller: the chance that its vote is good, for good and for bad documents.
    says_good: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        voted, up = v != ABSTAIN, v == 1
        logs = [np.log(p) + (voted * np.log(np.where(up, q, 1 - q))).sum(1) for p, q in ((self.good, self.says_good[0]), (1 - self.good, self.says_good[1]))]
        return 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -50, 50)))


def estimate(v: np.ndarray, count: np.ndarray, rounds: int = EM_ROUNDS) -> Labels:
    """Expectation maximisation over vote patterns; labellers are taken to err independently and better than chance."""
    voted, up = v != ABSTAIN, v == 1
    bad = ((v == 0).sum(1) + 0.5) / (voted.sum(1) + 2.0)
    post = np.where((v == 0).any(1), 1 - np.maximum(bad, 0.6), 0.9)
    labels = Labels(0.9, np.full((2, v.shape[1]), 0.5))
    for _ in range(rounds):
        good, says = np.clip((post * count).sum() / max(count.sum(), 1), 0.01, 0.99), []
        for p in (post, 1 - post):
            w = (p * count)[:, None] * voted
            says.append(((w * up).sum(0) + 1) / (w.sum(0) + 2))
        labels = Labels(float(good), np.clip(np.stack(says), 0.001, 0.999))
        post = labels.posterior(v)
    return labels


class Scorer(NamedTuple):
    words: np.ndarray
    dense: np.ndarray

    def score(self, f: Features) -> np.ndarray:
        text, bucket, share = f.triples
        z = dense(f) @ self.dense + np.bincount(text, self.words[bucket] * share, len(f.words))
        return np.where(f.words > 0, 1 / (1 + np.exp(-np.clip(z, -50, 50))), 0.0)


def fit(x: np.ndarray, triples: tuple[np.ndarray, np.ndarray, np.ndarray], target: np.ndarray) -> Scorer:
    """Logistic regression on soft labels by full gradient steps; classes weigh alike."""
    text, bucket, share = triples
    n, words, rest = len(target), np.zeros(BUCKETS), np.zeros(x.shape[1])
    if not n:
        return Scorer(words, rest)
    weight = 0.5 * (target / max(target.sum(), 1) + (1 - target) / max((1 - target).sum(), 1))
    g2, r2 = np.full(BUCKETS, 1e-6), np.full(x.shape[1], 1e-6)
    for _ in range(EPOCHS):
        z = x @ rest + np.bincount(text, words[bucket] * share, n)
        error = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target)
        g, r = np.bincount(bucket, error[text] * share, BUCKETS) + DECAY * words, x.T @ error
        g2, r2 = g2 + g * g, r2 + r * r
        words, rest = words - 0.05 * RATE * g / np.sqrt(g2), rest - RATE * r / np.sqrt(r2)
    return Scorer(words, rest)


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        found, n = np.unique(pattern(votes(features(part.column("text"), hashed=False))), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["pattern", "n"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        f = features(part.column("text"))
        text, bucket, share = f.triples
        cuts = np.cumsum(np.bincount(text, minlength=part.num_rows))[:-1]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(pattern(votes(f))), pa.array(list(dense(f)), pa.list_(pa.float64())),
                pa.array(np.split(bucket, cuts), pa.list_(pa.int64())), pa.array(np.split(share, cuts), pa.list_(pa.float64())),
            ],
            names=["pattern", "dense", "buckets", "shares"],
        )


class Model(NamedTuple):
    labels: Labels
    scorer: Scorer


def train(docs: DataFrame, most_docs: int = TRAIN_DOCS) -> Model:
    """Accuracies from the votes on all of ``docs(doc_id, text)``; the scorer from a sample of about ``most_docs``."""
    text = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    counts = text.select("text").mapInArrow(_patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    numbers, n = (np.array([r[c] for r in counts], np.int64) for c in ("pattern", "n"))
    labels = estimate(unpack(numbers), n.astype(float))
    of = max(1, int(n.sum()) // most_docs)
    sample = text.where(F.pmod(F.xxhash64("doc_id"), F.lit(of)) == 0) if of > 1 else text
    rows = sample.select("text").mapInArrow(_sampled, "pattern long, dense array<double>, buckets array<long>, shares array<double>").toArrow()
    if not rows.num_rows:
        return Model(labels, fit(np.zeros((0, 10)), (np.zeros(0, np.int64),) * 3, np.zeros(0)))
    lists = rows.column("buckets").combine_chunks()
    triples = np.repeat(np.arange(rows.num_rows), pc.list_value_length(lists).to_numpy()), lists.flatten().to_numpy(), rows.column("shares").combine_chunks().flatten().to_numpy()
    x = rows.column("dense").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
    target = labels.posterior(unpack(rows.column("pattern").to_numpy()))
    return Model(labels, fit(x, triples, target))


def _judge(model: Model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            f = features(part.column("text"))
            score = model.scorer.score(f)
            extra = [pa.array(score), pa.array(score >= threshold), pa.array(np.where(f.words > 0, model.labels.posterior(votes(f)), 0.0))]
            yield pa.RecordBatch.from_arrays([*part.columns, *extra], names=[*part.schema.names, "quality_score", "quality_keep", "weak_posterior"])

    return run


def judged(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``quality_score``, ``quality_keep`` and ``weak_posterior`` (columns of these names are replaced)."""
    docs = docs.drop("quality_score", "quality_keep", "weak_posterior").withColumn("text", F.col("text").cast("string"))
    return docs.mapInArrow(_judge(model, threshold), schema_with(docs.schema, "quality_score double, quality_keep boolean, weak_posterior double"))


def classified(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Train on ``docs`` and judge them: ``(doc_id, quality_score, quality_keep, weak_posterior)``."""
    model = train(docs)
    out = judged(docs.select(F.col("doc_id").cast("long"), "text"), model, threshold)
    return out.select("doc_id", "quality_score", "quality_keep", "weak_posterior")
