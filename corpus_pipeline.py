"""The corpus pipeline: from raw documents to packed training sequences.

Each stage works on all that the stage before it kept, which is written as Parquet and read again in between. The first
four return the columns of ``documents`` (and any others that the table has, whatever their names); the last returns one
row for each piece of a packed sequence. Every stage reads texts whole, of any length, and gives an empty table for an
empty one; columns that a stage does not read may be null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import jaccard_join, language_id, packing, quality, suffix_dedup
from quillspark.llm._spark import bounded, carried, discard, restored, scratch

#: The least posterior of its language that a document needs.
LEAST_LANGUAGE_SCORE = 0.5
#: How well its language must fit a text: log-likelihoods up to so many times the usual are those of the language.
LEAST_FIT = 1 / 3


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on weak labels of these documents, does not reject.

    A null text or one without words is rejected; repeated rows share their fate.
    """
    bounded(spark)
    kept = quality.judged(carried(docs), quality.train(docs)).where("quality_keep")
    return restored(kept, docs.columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose text is clearly in one of the languages learned from them, and not unlike it.

    A null text or one without letters goes; so do all if no ``lang`` is known. Repeated rows share their fate.
    """
    bounded(spark)
    model = language_id.train(docs.where(~language_id.held_out()))
    told = language_id.predict(carried(docs), model, keep_text=True)
    kept = told.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE) & (F.col("fit") >= LEAST_FIT))
    return restored(kept, docs.columns)


def near_duplicates_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 5-word shingles with a similarity of 0.8 or more, the document with the least id.

    Of rows with one ``doc_id`` one stays; rows without ``doc_id`` stay, and so do null and wordless texts.
    """
    bounded(spark)
    groups = jaccard_join.jaccard_components(docs)
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id IS NULL")).select(*(F.col(f"`{c}`") for c in docs.columns))


def repeats_cut(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the later occurrences of passages of 50 words or more that several of them hold.

    Null texts stay null; rows without ``doc_id`` are left alone.
    """
    bounded(spark)
    return suffix_dedup.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents and their places in sequences of 4096; a null text is its end id alone."""
    bounded(spark)
    return packing.packed_documents(docs)


STAGES = [
    ("quality_classifier", good_quality),
    ("language_id", known_language),
    ("ngram_jaccard_join", near_duplicates_removed),
    ("suffix_array_dedup", repeats_cut),
    ("best_fit_packing", packed),
]

#: Expectation maximisation, sampled training and a genetic algorithm have no SQL form; tests hold ``run`` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
