"""SentencePiece encoding with sampled segmentations, and lossless decoding.

A text is segmented by forward filtering and backward sampling over the lattice of all vocabulary pieces: forward sums
give the weight of all segmentations up to each place, and pieces are drawn from the end backwards in proportion to
them, so whole segmentations come from their exact posterior. Piece weights follow a power law of the rank in the
vocabulary, raised to ``alpha`` (a smaller ``alpha`` samples more evenly). The numbers drawn are a hash of seed, row key,
place and step: equal rows give equal pieces wherever and how often they are computed.

Pieces never go on over the end of a word, so lattices are built for distinct words, and those of common words are kept
by a worker. A word is a run without white space of any length. Characters without a piece, and the piece mark itself,
become byte pieces. Decoding joins the bytes of the pieces and gives back every text exactly.

Defined results: a null text stays null when encoded and decoded; an empty text has no pieces; a null key counts as a
key of its own; repeated rows get equal pieces; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._lattice import LEAST_WEIGHT, LITERAL_MARK, MARK, SPACE, Sampler, Vocabulary, code_points, segments, vocabulary
from quillspark.llm._text import U64, list_array, mix, ranks_within, slices
from quillspark.llm._tokens import vocabulary as tokenizer_path

SEED, ALPHA = 0, 1.0


def piece_weights(voc: Vocabulary, alpha: float = ALPHA) -> np.ndarray:
    """The last is that of a character that is spelled in bytes."""
    weight = voc.rank_weight**alpha
    weight /= weight.sum()
    weight[voc.unknown] = LEAST_WEIGHT
    return np.maximum(weight, LEAST_WEIGHT)


def sample_ids(sampler: Sampler, texts: pa.Array, keys: pa.Array, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, how many each text has)."""
    voc = sampler.vocabulary
    points, counts = code_points(texts)
    key = mix(pc.fill_null(keys, -1).to_numpy(zero_copy_only=False).astype(np.int64).view(U64) + U64(seed * 0xD1342543DE82EF95 & (1 << 64) - 1))
    done, last = [(np.zeros(0, np.int32), np.zeros(0, np.int64))], (-1, 0)
    for found in segments(points, counts):
        place = ranks_within(found.owner) + np.where(found.owner == last[0], last[1], 0)  # a text may go on from the step before
        last = (found.owner[-1], int(place[-1]) + 1)
        base = mix(key[found.owner] + place.astype(U64) * U64(0x9E3779B97F4A7C15))

        def uniform(occurrences: np.ndarray, step: int, base=base) -> np.ndarray:
            return (mix(base[occurrences] + U64((step + 1) * 0xA24BAED4963EE407 & (1 << 64) - 1)) >> U64(11)) * 2.0**-53

        ids, number = sampler.sample(found, uniform)
        done.append((ids, np.repeat(found.owner, number)))
    ids, of = (np.concatenate(x) for x in zip(*done, strict=True))
    lone = np.flatnonzero(ids == voc.unknown)
    if len(lone):  # each such piece is one character: spell it
        ids, of = _spelled(voc, points, counts, ids, of, lone)
    return ids, np.bincount(of, minlength=len(counts))


def _spelled(voc: Vocabulary, points: np.ndarray, counts: np.ndarray, ids: np.ndarray, of: np.ndarray, lone: np.ndarray):
    length = np.ones(voc.size + 1, np.int64)
    for piece, i in voc.pieces:
        length[i] = len(piece)
    at = np.cumsum(length[ids]) - length[ids]  # pieces follow the texts without gaps
    chars = points[at[lone]]
    spelling = {c: np.frombuffer(_character(c).encode("utf-8", "surrogatepass"), np.uint8) for c in np.unique(chars).tolist()}
    size = np.ones(len(ids), np.int64)
    size[lone] = [len(spelling[c]) for c in chars.tolist()]
    out = np.repeat(ids, size)
    out[np.repeat(ids == voc.unknown, size)] = voc.bytes[np.concatenate([spelling[c] for c in chars.tolist()])]
    return out, np.repeat(of, size)


def _character(point: int) -> str:
    return chr({LITERAL_MARK: MARK, MARK: SPACE}.get(point, point))


def decode_ids(voc: Vocabulary, ids: np.ndarray) -> str:
    return b"".join(map(voc.decoded.__getitem__, ids.tolist())).decode()


def _encode(path: str, seed: int, alpha: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        sampler = Sampler(voc, piece_weights(voc, alpha))
        for part in slices(batches):
            text = part.column("text")
            ids, counts = sample_ids(sampler, text, part.column("doc_id"), seed)
            lists = list_array(ids, counts, pa.int32())
            lists = pc.if_else(pc.is_null(text), pa.scalar(None, lists.type), lists)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], names=["doc_id", "ids"])

    return run


def encode(docs: DataFrame, path: str | None = None, seed: int = SEED, alpha: float = ALPHA) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, ids)``."""
    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return text.mapInArrow(_encode(path or tokenizer_path("piece_bpe_32k.model"), seed, alpha), "doc_id long, ids array<int>")


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for batch in batches:
            texts = [None if x is None else b"".join(map(voc.decoded.__getitem__, x)).decode() for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded(doc_id, ids)`` -> ``(doc_id, text)``."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path or tokenizer_path("piece_bpe_32k.model")), "doc_id long, text string")


def _digest(path: str, seed: int, alpha: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        sampler = Sampler(voc, piece_weights(voc, alpha))
        for part in slices(batches):
            ids, counts = sample_ids(sampler, part.column("text"), part.column("doc_id"), seed)
            starts, rows = np.concatenate([[0], np.cumsum(counts)]), []
            data = memoryview(ids.astype("<u4")).cast("B")
            for text, a, b in zip(part.column("text").to_pylist(), starts, starts[1:], strict=False):
                back = decode_ids(voc, ids[a:b])
                rows.append((zlib.crc32(data[4 * a : 4 * b]), hashlib.sha256(back.encode()).hexdigest(), back == (text or "")))
            crc, sha, same = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha), pa.array(same)],
                names=["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "lossless"],
            )

    return run


def sampled_digests(docs: DataFrame, path: str | None = None, seed: int = SEED, alpha: float = ALPHA) -> DataFrame:
    """Encode and decode every text: ``(doc_id, n_pieces, ids_crc32, decoded_sha256, lossless)``; a null text counts as empty."""
    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return text.mapInArrow(_digest(path or tokenizer_path("piece_bpe_32k.model"), seed, alpha), "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, lossless boolean")
