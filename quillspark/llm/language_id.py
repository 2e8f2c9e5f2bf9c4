"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has a probability for every piece of the vocabulary. The probability of a word is the sum over all its
segmentations, by a forward pass over its lattice; a text is scored by its words. Probabilities are learned by
expectation maximisation: words are counted for each language in a bounded sample of the labelled training documents
(``TRAIN_DOCS`` to twice as many, spread over the languages; rare ones are taken whole), the backward pass gives the
expected use of each piece, and rare pieces are smoothed towards all languages together. All counts are used: each round
is an aggregate over them, of which one number for each piece and language at most reaches the driver.

Words, runs without white space of any length, are scored once where they are distinct; a worker keeps the scores of up to
``KEPT_WORDS`` of them, which changes time, not results. Texts are read whole.

Beside the posterior, which is near one for any long text, stands how well the language fits at all: ``fit`` is the
language's usual log-likelihood of a character (that of its training words) over the text's, 1 for a usual text and less
for one in a language or an alphabet that was not learned, or of random letters.

Defined results: a null text or one without letters is ``und`` with score and fit 0; so is every text if nothing could be
learned; rows whose ``lang`` is null are predicted but not learned from; equal scores go to the language that sorts
first; repeated rows give repeated rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._lattice import LEAST_WEIGHT, Lattice, Vocabulary, code_points, segments, vocabulary
from quillspark.llm._spark import discard, partitions, schema_with, scratch
from quillspark.llm._text import U64, slices
from quillspark.llm._tokens import vocabulary as tokenizer_path

TRAIN_DOCS, ROUNDS = 8_000, 3
#: Bytes of distinct words of one step of a round.
ROUND_BYTES = 1 << 18
#: Weight of the pooled distribution in each language's, in pieces, and the least probability of a piece.
SMOOTH, FLOOR = 200.0, 10 * LEAST_WEIGHT
KEPT_WORDS = 300_000
UNKNOWN = "und"


class Model(NamedTuple):
    langs: list[str]
    #: A row for each piece (the last for characters without one), a column for each language.
    weight: np.ndarray
    #: Of each language: the log-likelihood of a character of its training words.
    usual: np.ndarray | None = None


def _folded(texts: pa.Array) -> pa.Array:
    """Lower case, with one space for any white space and one in front, so that all words are alike wherever they stand."""
    return pc.replace_substring_regex(pc.binary_join_element_wise(pa.scalar(" "), pc.utf8_lower(pc.fill_null(texts, "")), ""), r"\s+", " ")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        words = pc.split_pattern_regex(_folded(part.column("text")), r"\s+")
        lang = part.column("lang").take(pc.list_parent_indices(words))
        table = pa.table([lang, words.flatten()], names=["lang", "word"]).group_by(["lang", "word"]).aggregate([([], "count_all")])
        yield from table.select(["lang", "word", "count_all"]).rename_columns(["lang", "word", "n"]).to_batches()


def every(sizes: dict[str, int], most_docs: int) -> dict[str, int]:
    """Of how many documents of each language one is sampled: languages share ``most_docs`` evenly, and what small ones leave."""
    out, left = {}, most_docs
    for k, (lang, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        part = max(1, left // (len(sizes) - k))
        out[lang] = max(1, n // part)
        left = max(0, left - min(n, part))
    return out


def _expected(path: str, langs: list[str], weight: np.ndarray | None):
    """Expected use of pieces by language, for word counts; ``None`` stands for the weights of the vocabulary's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, column = vocabulary(path), pa.array(langs, pa.string())
        now = np.repeat(np.maximum(voc.rank_weight, FLOOR)[:, None], len(langs), 1) if weight is None else weight
        for part in slices(batches, "word", ROUND_BYTES):
            lang = pc.index_in(part.column("lang"), column).to_numpy()
            for found in segments(*code_points(pc.binary_join_element_wise(pa.scalar(" "), part.column("word"), ""))):
                times = np.zeros((len(found.starts) - 1, len(langs)))
                np.add.at(times, (found.which, lang[found.owner]), part.column("n").to_numpy()[found.owner])
                used = Lattice(voc, found.points, found.starts).expected(now, times)
                piece, k = np.nonzero(used)
                yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(k, pa.int32()), pa.array(used[piece, k])], names=["piece", "k", "used"])

    return run


def _likelihood(path: str, model: Model):
    """For word counts: characters and log-likelihood by language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, column = vocabulary(path), pa.array(model.langs, pa.string())
        for part in slices(batches, "word", ROUND_BYTES):
            words = pc.binary_join_element_wise(pa.scalar(" "), part.column("word"), "")
            lang, n = pc.index_in(part.column("lang"), column).to_numpy(), part.column("n").to_numpy()
            for found in segments(*code_points(words)):
                logs, k = Lattice(voc, found.points, found.starts).forward(model.weight)[0], lang[found.owner]
                size = np.diff(found.starts)[found.which] * n[found.owner]
                sums = np.bincount(k, logs[found.which, k] * n[found.owner], len(model.langs))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(model.langs)), pa.int32()), pa.array(np.bincount(k, size, len(model.langs))), pa.array(sums)], names=["k", "chars", "log"])

    return run


def train(docs: DataFrame, path: str | None = None, most_docs: int = TRAIN_DOCS) -> Model:
    """Learn from ``docs(doc_id, text, lang)``; give it training documents only."""
    spark, path = docs.sparkSession, path or tokenizer_path("piece_bpe_32k.model")
    docs = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    of = every({r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}, most_docs)
    voc = vocabulary(path)
    if not of:
        return Model([], np.zeros((voc.size + 1, 0)))
    of_lang = F.broadcast(spark.createDataFrame(sorted(of.items()), "lang string, of long"))
    sample = docs.join(of_lang, "lang").where(F.pmod(F.xxhash64("doc_id"), "of") == 0)
    counts = sample.select("text", "lang").mapInArrow(_count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).where("word <> ''")
    counts = scratch(counts.repartition(partitions(spark), "word").sortWithinPartitions("word", "lang"), "language-words")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not langs:
        discard(counts)
        return Model([], np.zeros((voc.size + 1, 0)))
    weight = None
    for _ in range(ROUNDS):
        used = np.full((voc.size + 1, len(langs)), FLOOR)
        # Decimal sums don't depend on the order of rows.
        sums = counts.mapInArrow(_expected(path, langs, weight), "piece int, k int, used double").groupBy("piece", "k").agg(F.sum(F.col("used").cast("decimal(28,12)")).cast("double").alias("used")).toArrow()
        used[sums.column("piece").to_numpy(), sums.column("k").to_numpy()] += sums.column("used").to_numpy()
        pooled = used.sum(1, keepdims=True) / used.sum()
        weight = np.maximum((used + SMOOTH * pooled) / (used.sum(0) + SMOOTH), FLOOR)
        weight[voc.unknown] = FLOOR
    model, usual = Model(langs, weight), np.zeros(len(langs))
    sums = counts.mapInArrow(_likelihood(path, model), "k int, chars double, log double").groupBy("k").agg(*(F.sum(F.col(c).cast("decimal(28,6)")).cast("double").alias(c) for c in ("chars", "log"))).toArrow()
    usual[sums.column("k").to_numpy()] = sums.column("log").to_numpy() / np.maximum(sums.column("chars").to_numpy(), 1)
    discard(counts)
    return model._replace(usual=usual)


class Scorer:
    """Log-likelihoods of words under each language."""

    def __init__(self, voc: Vocabulary, model: Model, most: int = KEPT_WORDS):
        self.voc, self.model, self.most = voc, model, most
        self.names, self.logs = np.zeros(0, U64), np.zeros((0, len(model.langs)))

    def _words(self, found) -> np.ndarray:
        names, logs = self.names, self.logs
        place = np.minimum(np.searchsorted(names, found.name), max(0, len(names) - 1))
        new = np.flatnonzero(names[place] != found.name) if len(names) else np.arange(len(found.name))
        if len(new):
            fresh, _ = Lattice(self.voc, *found.only(new)).forward(self.model.weight)
            order = np.argsort(both := np.concatenate([names, found.name[new]]), kind="stable")
            names, logs = both[order], np.concatenate([logs, fresh])[order]
            if len(names) <= self.most:
                self.names, self.logs = names, logs
        return logs[np.searchsorted(names, found.name)]

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """A row for each text, a column for each language; and how many characters each text was scored by."""
        sums = np.zeros((len(texts), len(self.model.langs)))
        points, counts = code_points(_folded(texts))
        for found in segments(points, counts):
            logs = self._words(found)
            for k in range(sums.shape[1]):
                sums[:, k] += np.bincount(found.owner, logs[found.which, k], len(texts))
        return sums, counts


def _score(path: str, model: Model, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(vocabulary(path), model)
        for part in slices(batches):
            text = pc.fill_null(part.column("text"), "")
            has = pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False)
            sums, chars = scorer.texts(text)
            best = sums.argmax(1)
            share = np.exp(sums - sums.max(1, keepdims=True))
            score = np.where(has, 1 / share.sum(1), 0.0)
            fit = np.where(has, model.usual[best] * chars / np.minimum(sums.max(1), -1e-9), 0.0)
            names = pa.array(model.langs, pa.string()).take(pa.array(best))
            lang = pc.if_else(pa.array(has), names, pa.scalar(UNKNOWN))
            rest = [c for c in part.schema.names if keep_text or c != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), lang, pa.array(score), pa.array(fit)], names=[*rest, "lang_pred", "score", "fit"])

    return run


def predict(docs: DataFrame, model: Model, path: str | None = None, keep_text: bool = False) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (the posterior of the language, all equally likely before) and ``fit``.

    ``text`` goes unless ``keep_text``; other columns of these three names are replaced.
    """
    docs = docs.drop("lang_pred", "score", "fit").withColumn("text", F.col("text").cast("string"))
    schema = schema_with([f for f in docs.schema if keep_text or f.name != "text"], "lang_pred string, score double, fit double")
    if not model.langs:
        return (docs if keep_text else docs.drop("text")).withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "fit": F.lit(0.0)})
    return docs.mapInArrow(_score(path or tokenizer_path("piece_bpe_32k.model"), model, keep_text), schema)


def held_out(doc_id: str = "doc_id"):
    """A quarter of all documents, by checksum of the id; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def identified(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Learn from the documents that are not held out and predict all: ``(doc_id, held_out, lang_pred, score, fit)``."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    model = train(docs.where(~held_out()), path)
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model, path)
