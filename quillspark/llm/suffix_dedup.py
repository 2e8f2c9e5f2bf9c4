"""Passages that repeat across documents, by a sparse suffix array.

Words are runs of anything but ASCII white space, compared exactly. Of all word suffixes only those at minimiser
positions are retained: the positions whose hash of the next ``SELECT_WORDS`` words is the least in a window, which any
text that holds the same words selects as well. A retained suffix is represented by the hash of its first
``PREFIX_WORDS`` words. The suffixes of all documents are range-sorted and compared with their neighbours: those with an
equal prefix in another document are seeds. The window is so wide that a repeated passage of ``MIN_WORDS`` words has a
seed whose prefix lies inside it. Seeds are then extended left and right: every run of ``MIN_WORDS`` words whose least
retained suffix is a seed is held against the equal runs of other documents, and neighbouring runs join into maximal
spans. So exactly the words in a run of ``MIN_WORDS`` words that another document
has too are found.

A run's first occurrence is the one with the least ``(doc_id, place)``. ``repeated_spans`` tells spans of first
occurrences from spans of later ones; ``without_repeats`` cuts the later ones out of the texts.

Skew: suffixes are sorted by prefix and document, so the suffixes of a common passage spread over several partitions;
only their edges are compared afterwards. Equal runs meet in a pre-aggregated minimum and a join that adaptive execution
can split, never in one task. What a document holds is gathered per document only.

Defined results: null or short texts have no spans; repeats within one document alone, or between rows of the same
``doc_id``, do not count; rows without ``doc_id`` are left alone; an empty table gives no spans; other columns pass
through ``without_repeats`` unchanged (``n_chars`` is set anew where present), and a text that was repeated whole
becomes empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm._spark import carried, discard, partitions, restored, scratch
from quillspark.llm._text import U64, grams, hash_strings, long_grams, minimisers, mix, run_min, signed, slices, split_words

MIN_WORDS, PREFIX_WORDS, SELECT_WORDS = 50, 25, 8
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _suffixes(texts: pa.Array, least: int, prefix: int):
    """Word hashes, owners and the places of whole prefixes; of those, the hashes and which are retained."""
    words = split_words(texts)
    hashes, owner = hash_strings(words.vocab)[words.codes] if len(words.codes) else np.zeros(0, U64), words.owner()
    whole = long_grams(hashes, prefix)
    at = np.flatnonzero((owner[: len(whole)] == owner[prefix - 1 :]) & (words.counts[owner[: len(whole)]] >= least)) if len(whole) else np.zeros(0, np.int64)
    order = grams(hashes, min(SELECT_WORDS, prefix))[at] | U64(1)
    kept = minimisers(order, least - prefix + 1, owner[at])
    return words, hashes, owner, at, whole[at], order, kept


def _seeds(least: int, prefix: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            _, _, owner, at, prefixes, _, kept = _suffixes(part.column("text"), least, prefix)
            rows, first = owner[at][kept], prefixes[kept]
            order = np.lexsort((first, rows))
            rows, first = rows[order], first[order]
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:] != rows[:-1]) | (first[1:] != first[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(signed(first[new])), part.column("doc_id").take(pa.array(rows[new]))], names=["prefix", "doc_id"])

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted suffixes -> those with an equal prefix next to them in another document, and the edges of the partition."""
    part, held, first = TaskContext.get().partitionId(), None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        prefix, doc = (batch.column(c).to_numpy() for c in ("prefix", "doc_id"))
        if held is not None:
            prefix, doc = np.concatenate([held[0], prefix]), np.concatenate([held[1], doc])
        n = len(prefix)
        same = (prefix[1:] == prefix[:-1]) & (doc[1:] != doc[:-1])
        hit = np.zeros(n, bool)
        hit[1:] |= same
        hit[:-1] |= same
        if held is not None:
            hit[0] |= held[2]
        edge = np.zeros(n, bool)
        edge[0] = first
        out = np.flatnonzero((hit | edge)[:-1])
        if len(out):
            yield _row(prefix[out], doc[out], hit[out], edge[out], part)
        held, first = (prefix[-1:], doc[-1:], bool(hit[-1]), first and n == 1), first and n == 1
    if held is not None:
        yield _row(held[0], held[1], np.array([held[2]]), np.array([True]), part)


def _row(prefix, doc, hit, edge, part) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(prefix), pa.array(doc), pa.array(hit), pa.array(edge), pa.array(np.full(len(prefix), part))], names=["prefix", "doc_id", "hit", "edge", "part"])


def _runs(least: int, prefix: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words, hashes, owner, at, prefixes, order, kept = _suffixes(part.column("text"), least, prefix)
            lists = part.column("seeds")
            mine = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
            own = mix(lists.flatten().to_numpy().view(U64) + mix(mine.astype(U64)))
            seed = kept.copy()
            seed[kept] = np.isin(mix(prefixes[kept] + mix(owner[at][kept].astype(U64))), own)
            # The least suffix inside a run is retained wherever the run occurs, so it must be a seed.
            reach = least - prefix + 1
            low = run_min(order, reach)
            n = len(low)
            fit = (run_min(np.where(seed, order, ~U64(0)), reach) == low) & (owner[at[:n]] == owner[at[reach - 1 :]]) if n else np.zeros(0, bool)
            start, whole = at[:n][fit], long_grams(hashes, least)
            place = start - words.starts[owner[start]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(whole[start])), part.column("doc_id").take(pa.array(owner[start])), pa.array(place, pa.int32())], names=["run", "doc_id", "place"]
            )

    return run


def repeated_runs(docs: DataFrame, least: int = MIN_WORDS, prefix: int | None = None) -> DataFrame:
    """``(doc_id, place, first_doc_id, first_place)`` for every run of ``least`` words that several documents have."""
    prefix = prefix or (least + 1) // 2
    spark = docs.sparkSession
    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    suffixes = scratch(text.mapInArrow(_seeds(least, prefix), "prefix long, doc_id long"), "suffixes")
    array = suffixes.repartitionByRange(partitions(spark), "prefix", "doc_id").sortWithinPartitions("prefix", "doc_id")
    compared = scratch(array.mapInArrow(_compare, "prefix long, doc_id long, hit boolean, edge boolean, part long"), "suffix-neighbours")
    edges = compared.where("edge")
    across = edges.groupBy("prefix").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("prefix")
    late = edges.where("NOT hit").join(across, "prefix").select("prefix", "doc_id")
    discard(suffixes)
    seeds = compared.where("hit").select("prefix", "doc_id").unionByName(late).groupBy("doc_id").agg(F.collect_set("prefix").alias("seeds"))
    runs = scratch(text.join(seeds, "doc_id").mapInArrow(_runs(least, prefix), "run long, doc_id long, place int"), "suffix-runs")
    first = runs.groupBy("run").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.max("doc_id").alias("last")).where("first.doc_id < last")
    first = scratch(first, "suffix-firsts")  # a table of its own, so that a join partition with a hot run can be split
    return runs.join(first, "run").select("doc_id", "place", F.col("first.doc_id").alias("first_doc_id"), F.col("first.place").alias("first_place"))


def repeated_spans(docs: DataFrame, least: int = MIN_WORDS, prefix: int | None = None) -> DataFrame:
    """``(doc_id, start_word, n_words, is_first, first_doc_id)``: the spans of runs that other documents have too.

    ``is_first`` spans join first occurrences, the others join later ones; ``first_doc_id`` is the least document that
    has one of a span's runs first.
    """
    runs = repeated_runs(docs, least, prefix)
    runs = runs.withColumn("is_first", (F.col("doc_id") == F.col("first_doc_id")) & (F.col("place") == F.col("first_place")))
    along = Window.partitionBy("doc_id", "is_first").orderBy("place")
    runs = runs.withColumn("new", (F.col("place") - F.coalesce(F.lag("place").over(along), F.lit(-1 - least)) > least).cast("int"))
    runs = runs.withColumn("span", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = runs.groupBy("doc_id", "is_first", "span").agg(F.min("place").alias("start"), F.max("place").alias("stop"), F.min("first_doc_id").alias("first_doc_id"))
    return spans.select("doc_id", F.col("start").cast("long").alias("start_word"), (F.col("stop") - F.col("start") + least).cast("long").alias("n_words"), "is_first", "first_doc_id")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans ``(first word, number)`` and the white space after each of them."""
    places = [m.start() for m in WORD.finditer(text)] + [len(text)]
    out, at = [], 0
    for start, number in sorted(spans):
        out.append(text[at : max(at, places[start])])
        at = max(at, places[min(start + number, len(places) - 1)])
    return "".join([*out, text[at:]])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        texts = part.column("text").to_pylist()
        for i, spans in enumerate(part.column("spans").to_pylist()):
            if spans and texts[i] is not None:
                texts[i] = cut_words(texts[i], [(s["start_word"], s["n_words"]) for s in spans])
        at = part.schema.get_field_index("text")
        yield part.set_column(at, "text", pa.array(texts, pa.string())).drop_columns(["spans"])


def without_repeats(docs: DataFrame, least: int = MIN_WORDS, prefix: int | None = None) -> DataFrame:
    """``docs`` with every later occurrence of a repeated run cut out of ``text``; all rows and columns stay."""
    spans = repeated_spans(docs, least, prefix).where("NOT is_first").groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "n_words")).alias("spans"))
    rows = carried(docs).join(spans, "doc_id", "left")
    out = restored(rows.mapInArrow(_cut, rows.drop("spans").schema), docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
