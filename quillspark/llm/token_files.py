"""Token ids as Arrow files of equal-length sequences.

Documents are range-partitioned by ``doc_id`` and each partition streams its ids, in ascending order, into one Arrow IPC
file: record batches of fixed-size lists, so sequence i of a batch is a slice of one buffer and a memory-mapped file is
read at any place without copying. ``attention_mask`` tells ids from the padding of a file's last sequence, ``ends``
marks the last id of each document and ``doc_ids`` names the documents that end in a sequence. Files are numbered in
document order; a file's place in the whole stream is the sum of the ids before it, which the manifest gives.

Defined results: a null or empty text is its end id alone; null ``doc_id``s come first; rows of one ``doc_id`` are in the order of
their texts, each a document of its own; an empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import _files
from quillspark.llm._spark import partitions, scratch, scratch_path
from quillspark.llm._text import slices
from quillspark.llm._tokens import vocabulary, with_end, word_tokenizer

SEQUENCE, BATCH_SEQUENCES, END = 2048, 256, 1


def _schema(kind: pa.DataType, length: int) -> pa.Schema:
    fixed = lambda t: pa.list_(t, length)
    return pa.schema([("input_ids", fixed(kind)), ("attention_mask", fixed(pa.bool_())), ("ends", fixed(pa.bool_())), ("doc_ids", pa.list_(pa.int64()))])


class _Sequences:
    """Cuts a stream of documents into sequences and writes whole batches of them."""

    def __init__(self, sink, kind: np.dtype, length: int):
        self.kind, self.length, self.schema = kind, length, _schema(pa.from_numpy_dtype(kind), length)
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.ids, self.ends, self.docs, self.held, self.total = [], [], [], 0, 0

    def add(self, ids: np.ndarray, starts: np.ndarray, docs: list) -> None:
        end = np.zeros(len(ids), bool)
        end[starts[1:] - 1] = True
        self.ids.append(ids)
        self.ends.append(end)
        self.docs += docs
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= self.length * BATCH_SEQUENCES:
            self.flush(self.held // self.length)

    def flush(self, sequences: int) -> None:
        ids, ends = np.concatenate(self.ids), np.concatenate(self.ends)
        for at in range(0, sequences, BATCH_SEQUENCES):
            n = min(BATCH_SEQUENCES, sequences - at)
            a, b = at * self.length, min((at + n) * self.length, len(ids))
            pad = n * self.length - (b - a)
            mask = np.ones(n * self.length, bool)
            mask[b - a :] = False
            some, last = np.pad(ids[a:b], (0, pad)), np.pad(ends[a:b], (0, pad))
            each = last.reshape(n, self.length).sum(1)
            names, self.docs = self.docs[: int(each.sum())], self.docs[int(each.sum()) :]
            offsets = pa.array(np.concatenate([[0], np.cumsum(each)]).astype(np.int32))
            fixed = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x), self.length)
            self.writer.write_batch(pa.record_batch([fixed(some), fixed(mask), fixed(last), pa.ListArray.from_arrays(offsets, pa.array(names, pa.int64()))], schema=self.schema))
        done = min(sequences * self.length, len(ids))
        self.ids, self.ends, self.held = [ids[done:]], [ends[done:]], len(ids) - done

    def close(self) -> None:
        if self.held:
            self.flush(-(-self.held // self.length))
        self.writer.close()


def _write(folder: str, path: str, length: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part = word_tokenizer(path), TaskContext.get().partitionId()
        parts = slices(batches)
        first = next(parts, None)
        if first is None:
            return
        uri, docs = f"{folder}/part-{part:06d}.arrow", 0
        with _files.Whole(uri) as sink:
            out = _Sequences(sink, tokenizer.kind, length)
            for rows in (x for xs in ([first], parts) for x in xs):
                ids, starts = with_end(*tokenizer.encode(rows.column("text")), end)
                out.add(ids, starts, rows.column("doc_id").to_pylist())
                docs += rows.num_rows
            out.close()
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [uri], "n_docs": [docs], "n_ids": [out.total]})

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, length: int = SEQUENCE, end: int = END) -> DataFrame:
    """Write ``docs(doc_id, text)`` and return the manifest ``(part, path, n_docs, n_ids)``, one row for each file."""
    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = ordered.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return scratch(ordered.mapInArrow(_write(_files.normal(folder), tokenizer, length, end), "part long, path string, n_docs long, n_ids long"), "token-manifest")


def read_documents(path: str) -> Iterator[tuple[int | None, int, int]]:
    """(doc_id, number of ids, crc32 of the ids as little-endian 32-bit integers) of each document of a file."""
    with _files.reader(path) as source:
        file = pa.ipc.open_file(source)
        count = crc = 0
        for k in range(file.num_record_batches):
            batch = file.get_batch(k)
            mask = batch.column("attention_mask").flatten().to_numpy(zero_copy_only=False)
            data = memoryview(batch.column("input_ids").flatten().to_numpy().astype("<u4")).cast("B")
            stops = np.flatnonzero(batch.column("ends").flatten().to_numpy(zero_copy_only=False)) + 1
            at = 0
            for doc, stop in zip(batch.column("doc_ids").flatten().to_pylist(), stops.tolist(), strict=True):
                crc = zlib.crc32(data[4 * at : 4 * stop], crc)
                yield doc, count + stop - at, crc
                at, count, crc = stop, 0, 0
            rest = int(mask.sum()) - at
            crc, count = zlib.crc32(data[4 * at : 4 * (at + rest)], crc), count + rest


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
            rows = list(read_documents(path))
            sizes = np.array([r[1] for r in rows], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array(start + np.cumsum(sizes) - sizes), pa.array(sizes), pa.array([r[2] for r in rows], pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_token_files(manifest: DataFrame) -> DataFrame:
    """The documents of the files: ``(doc_id, start, n_tokens, ids_crc32)``. The manifest has a row for each file only."""
    start, files = 0, []
    for r in sorted(manifest.collect()):
        files.append((r["path"], start))
        start += r["n_ids"]
    spark = manifest.sparkSession
    listed = spark.createDataFrame(files, "path string, start long").repartition(max(1, min(len(files), partitions(spark))))
    return listed.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write, read back, digest."""
    folder = scratch_path(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, folder, tokenizer or vocabulary("word_bpe_49k.json")))
