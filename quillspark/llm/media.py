"""Media columns: content-addressed payloads in tar shards.

A payload is stored losslessly as an 8-bit greyscale PNG of ``WIDTH`` pixels a row (filter 0, deflated), under its own
SHA-256, in a tar shard. Each writing task keeps one shard and one copy of each digest; where several tasks stored the
same digest, every row points to the first shard that has it. Shards get their names when they are complete, so rows are
used only after the storing job has ended, which ``store_payloads`` waits for. Rows carry ``media_sha256``, ``shard``, ``offset`` and
``length``: a member is read by one range read, without the tar index. ``with_metadata`` fills width, height, bit depth
and colour type from the first ``HEADER`` bytes alone.

``text_media`` uses a document's UTF-8 bytes, padded with spaces to a positive multiple of ``WIDTH``, as the payload.

Defined results: a null text is empty (one row of spaces); equal payloads share one stored object and all values;
repeated rows give repeated rows; an empty table writes no shard and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import _files
from quillspark.llm._spark import partitions, schema_with, scratch, scratch_path
from quillspark.llm._text import slices

WIDTH, LEVEL = 192, 3
#: Signature, then the IHDR chunk: all that metadata need.
HEADER = 33
_HEAD = ("width", "height", "bit_depth", "colour_type")
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, width: int = WIDTH) -> bytes:
    """``payload``, a positive multiple of ``width`` bytes, as an 8-bit greyscale image."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def png_header(data: bytes) -> dict[str, int]:
    """Width, height, bit depth and colour type from the first ``HEADER`` bytes."""
    if data[:8] != _SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a PNG file")
    width, height, depth, colour = struct.unpack(">IIBB", data[16:26])
    return {"width": width, "height": height, "bit_depth": depth, "colour_type": colour}


def decode_png(data: bytes) -> bytes:
    """The samples of an image that ``encode_png`` made; checksums are verified."""
    head, at, packed = png_header(data), 8, b""
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged PNG chunk")
        packed += body if kind == b"IDAT" else b""
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(head["height"], head["width"] + 1)
    if lines[:, 0].any():
        raise ValueError("only filter 0 is written here")
    return lines[:, 1:].tobytes()


def _store(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = slices(batches, "payload")
        first = next(parts, None)
        if first is None:
            return
        shard = f"{folder}/shard-{TaskContext.get().partitionId():06d}.tar"
        with _files.Whole(shard) as sink:
            at, own = 0, {}
            for part in (x for xs in ([first], parts) for x in xs):
                digests, offsets, lengths = [], [], []
                for payload in part.column("payload").to_pylist():
                    data = encode_png(payload)
                    digest = hashlib.sha256(data).digest()
                    if digest not in own:
                        info = tarfile.TarInfo(f"{digest.hex()}.png")
                        info.size = len(data)
                        block = info.tobuf(tarfile.GNU_FORMAT)
                        sink.write(block + data + bytes(-len(data) % 512))
                        own[digest] = (at + len(block), len(data))
                        at += len(block) + len(data) + -len(data) % 512
                    digests.append(digest.hex())
                    offsets.append(own[digest][0])
                    lengths.append(own[digest][1])
                rest = [c for c in part.schema.names if c != "payload"]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in rest), pa.array(digests), pa.array([shard] * part.num_rows), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                    names=[*rest, "media_sha256", "shard", "offset", "length"],
                )
            sink.write(bytes(1024))

    return run


def store_payloads(rows: DataFrame, folder: str) -> DataFrame:
    """``rows`` with a binary ``payload`` -> the other columns with ``media_sha256``, ``shard``, ``offset`` and ``length``."""
    schema = schema_with([f for f in rows.schema if f.name != "payload"], "media_sha256 string, shard string, offset long, length long")
    stored = rows.mapInArrow(_store(_files.normal(folder)), schema)
    stored = scratch(stored, "media-rows")
    # One place for each digest.
    place = stored.groupBy("media_sha256").agg(F.min(F.struct("shard", "offset", "length")).alias("at"))
    place = scratch(place, "media-places")  # a table of its own, so that a join partition with a hot digest can be split
    return stored.drop("shard", "offset", "length").join(place, "media_sha256").select(*(f.name for f in rows.schema if f.name != "payload"), "media_sha256", "at.*")


def _ranges(batch: pa.RecordBatch, most: int | None) -> Iterator[bytes]:
    path = source = None
    for shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
        if shard != path:
            if source is not None:
                source.close()
            path, source = shard, _files.reader(shard)
        yield source.read_at(length if most is None else min(most, length), offset)


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        heads = [png_header(data) for data in _ranges(batch, HEADER)]
        extra = [pa.array([h[c] for h in heads], pa.int32()) for c in _HEAD]
        yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *_HEAD])


def with_metadata(media: DataFrame) -> DataFrame:
    """``media`` with the columns that the stored headers tell; the samples are not read."""
    return _near_shards(media).mapInArrow(_headers, schema_with(media.schema, ", ".join(f"{c} int" for c in _HEAD)))


def _near_shards(media: DataFrame) -> DataFrame:
    """Rows of a stretch of a shard together; a shard's rows may be dealt to several tasks."""
    return media.repartitionByRange(2 * partitions(media.sparkSession), "shard", "offset").sortWithinPartitions("shard", "offset")


def feature(payload: bytes) -> str:
    """Mean, deviation and a 16-bin histogram of the samples, in thousandths, as text."""
    x = np.frombuffer(payload, np.uint8)
    bins = np.bincount(x >> 4, minlength=16) * 1000 // len(x)
    return f"{int(x.mean() * 1000)};{int(x.std() * 1000)};" + ",".join(map(str, bins.tolist()))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for a in range(0, whole.num_rows, 512):
            batch, rows, last = whole.slice(a, 512), [], (None, None)
            for place, data in zip(zip(batch.column("shard").to_pylist(), batch.column("offset").to_pylist(), strict=True), _ranges(batch, None), strict=True):
                if place != last[0]:  # copies come one after the other
                    payload = decode_png(data)
                    last = place, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), hashlib.sha256(data).hexdigest(), feature(payload))
                rows.append(last[1])
            size, sha, tail, media, text = zip(*rows, strict=True)
            if pc.any(pc.not_equal(pa.array(media), batch.column("media_sha256"))).as_py():
                raise ValueError("a stored object does not match its digest")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(size, pa.int64()), pa.array(sha), pa.array(tail, pa.int64()), batch.column("length"), pa.array(media), pa.array(text), *(batch.column(c) for c in _HEAD)],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *_HEAD],
            )


def text_payloads(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_bytes, payload)``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.octet_length(text)
    pad = F.when(size == 0, width).otherwise(F.pmod(-size, F.lit(width)))
    return docs.select(F.col("doc_id").cast("long"), size.cast("long").alias("n_bytes"), F.encode(F.concat(text, F.repeat(F.lit(" "), pad)), "UTF-8").alias("payload"))


def text_media(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Store the payloads of ``docs``, fill metadata columns from headers, then read objects back and compute features from them."""
    media = store_payloads(text_payloads(docs), folder or scratch_path(docs.sparkSession, "media"))
    return with_metadata(media).mapInArrow(
        _features,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
        + ", ".join(f"{c} int" for c in _HEAD),
    )
