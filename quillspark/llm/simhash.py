"""SimHash fingerprints of documents, and the search for all fingerprints within a Hamming radius.

Terms are word 3-grams of the lower-cased text (a shorter text: all its words as one). Each occurrence of a term hashes
to ``BITS`` signed votes, so a term weighs as often as it occurs; the sign of each bit's sum is the fingerprint. The
likeness of two fingerprints is the cosine that their Hamming distance estimates, ``cos(pi * distance / BITS)``, and 0
beyond a right angle; a pair of equal fingerprints has 1.

``near`` finds all fingerprints within a radius of those asked for: the bits are cut into ``radius + 1`` blocks, and two
fingerprints that close agree in one block at least, so one equi-join of permuted block tables with the exact distance as
its condition finds all of them, each in the first block that they share. Equal fingerprints are one entry. The query asks
for the fingerprints of every document whose id is divisible by 20.

``neighbours`` gives each document the text of the next one in descending ``doc_id`` order without a global sort in one
task: ids are cut into ranges, each range is sorted where it is, and the first document of each range also goes to the
range before it.

Defined results: a null text is empty; a text without words has the fingerprint of no votes (all zero) and likeness 1 to
another such; repeated ids are put in order by text; the next document of a single document is itself; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._spark import discard, partitions, scratch
from quillspark.llm._text import U64, grams, hash_strings, mix, slices, split_words

BITS, TERM_WORDS, RADIUS = 128, 3, 3


def _votes(terms: np.ndarray, owner: np.ndarray, rows: int, bits: int) -> np.ndarray:
    """Signed sums of the votes of each owner's terms, one column for each bit; ``owner`` ascends."""
    sums = np.zeros((rows, bits), np.int32)
    if not len(terms):
        return sums
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    number = np.diff(np.concatenate([first, [len(terms)]]))
    for word in range(bits // 64):
        lanes = np.ascontiguousarray(mix(terms + U64(word * 0xA24BAED4963EE407 & (1 << 64) - 1)))
        # Bit k of every byte is summed at once: eight bytes of a hash are eight independent counters.
        view = lanes.view(np.uint8).reshape(-1, 8)
        for k in range(8):
            ones = np.add.reduceat((view >> k) & 1, first, axis=0, dtype=np.int32)
            sums[owner[first], word * 64 + k : word * 64 + 64 : 8] = 2 * ones - number[:, None]
    return sums


def fingerprints(texts: pa.Array, bits: int = BITS) -> np.ndarray:
    """One row of ``bits // 8`` bytes for each text."""
    words = split_words(texts, lower=True)
    rows = len(texts)
    if not len(words.codes):
        return np.zeros((rows, bits // 8), np.uint8)
    hashes, owner, counts = hash_strings(words.vocab)[words.codes], words.owner(), words.counts
    terms = grams(np.concatenate([hashes, np.zeros(TERM_WORDS - 1, U64)]), TERM_WORDS)
    whole = np.arange(len(hashes)) - words.starts[:-1][owner] <= (counts[owner] - TERM_WORDS)
    short = counts < TERM_WORDS
    use = whole | (short[owner] & (np.arange(len(hashes)) == words.starts[:-1][owner]))
    for i in np.flatnonzero(short & (counts > 0)):
        a, b = words.starts[i], words.starts[i + 1]
        terms[a] = mix(grams(hashes[a:b], b - a) + U64(b - a))[0]
    return np.packbits(_votes(terms[use], owner[use], rows, bits) > 0, axis=1)


_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    apart = _ONES[a ^ b].sum(1)
    return np.where(apart == 0, 1.0, np.clip(np.cos(np.pi * apart / (8 * a.shape[1])), 0, 1))


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        own, after = pc.fill_null(part.column("text"), ""), pc.fill_null(part.column("next_text"), "")
        chars = [len(t) for t in own.to_pylist()]
        mixed = [t[: n - n // 2] + u[: n // 2] for t, u, n in zip(own.to_pylist(), after.to_pylist(), chars, strict=True)]
        a, b, c = fingerprints(own), fingerprints(pa.array(mixed, pa.string())), fingerprints(after)
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"), pa.array(chars, pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in mixed]),
                pa.array([x.tobytes().hex() for x in a]), pa.array([x.tobytes().hex() for x in b]), pa.array(likeness(a, b)), pa.array(likeness(a, c)),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )


def _next_in_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range and place: each that is no guest, with the text of the row after it."""
    held = None
    for part in slices(batches):
        rows = pa.Table.from_batches([part]) if held is None else pa.concat_tables([held, pa.Table.from_batches([part])])
        rows = rows.combine_chunks()
        if rows.num_rows > 1:
            one = rows.slice(0, rows.num_rows - 1)
            text = rows.column("text").slice(1)
            out = pa.table([one.column("doc_id"), one.column("text"), text, one.column("guest")], names=["doc_id", "text", "next_text", "guest"])
            yield from out.filter(pc.invert(out.column("guest"))).drop_columns(["guest"]).to_batches()
        held = rows.slice(rows.num_rows - 1)


def neighbours(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, next_text)``: the text of the next document in descending ``doc_id`` order; after the last, the first's."""
    spark = docs.sparkSession
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    number = max(1, 2 * partitions(spark))
    cuts = sorted(set(ids.where("doc_id IS NOT NULL").stat.approxQuantile("doc_id", [k / number for k in range(1, number)], 0.2 / number)), reverse=True)
    # Range 0 holds the largest ids; nulls come last.
    place = F.lit(0)
    if cuts:
        place = F.aggregate(F.array(*(F.lit(int(c)) for c in cuts)), F.lit(0), lambda a, c: a + (F.coalesce(F.col("doc_id"), F.lit(-(2**63))) < c).cast("int"))
    heads = [tuple(r) for r in ids.select("doc_id", place.alias("range")).groupBy("range").agg(F.max("doc_id").alias("head")).orderBy("range").collect()]
    # The head of each range is also the guest at the end of the range before it; the first range's, of the last.
    guests = {heads[k][1]: heads[k - 1][0] for k in range(len(heads))}
    # Among equal ids the first text in order is the head, so one row of it alone must travel.
    text = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("range", place)
    own = text.withColumn("guest", F.lit(False))
    lent = text.where(F.col("doc_id").isin([h for h in guests if h is not None])) if guests else text.limit(0)
    if None in guests:
        lent = lent.unionByName(text.where("doc_id IS NULL"))
    table = F.create_map(*(F.lit(x) for kv in guests.items() if kv[0] is not None for x in kv)) if [h for h in guests if h is not None] else None
    to = F.lit(guests.get(None)) if table is None else F.coalesce(F.try_element_at(table, "doc_id"), F.lit(guests.get(None)))
    lent = lent.groupBy("doc_id").agg(F.min("text").alias("text")).withColumn("range", to.cast("int")).withColumn("guest", F.lit(True))
    dealt = own.unionByName(lent).repartitionByRange(len(heads) or 1, "range")
    ordered = dealt.sortWithinPartitions("range", "guest", F.desc_nulls_last("doc_id"), "text")
    return ordered.mapInArrow(_next_in_range, "doc_id long, text string, next_text string")


def edited_fingerprints(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The fingerprints of ``docs(doc_id, text)``, of their edited texts and of the next documents, with their likeness.

    ``near_prints`` and ``near_docs`` count the other fingerprints within ``radius`` and their documents, for documents
    whose id is divisible by 20; they are null for others.
    """
    rows = neighbours(docs).mapInArrow(
        _edited, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
    rows = scratch(rows, "simhash-rows")
    asked = F.coalesce(F.col("doc_id") % 20 == 0, F.lit(False))
    prints = scratch(rows.groupBy("fingerprint").agg(F.count("*").alias("n"), F.max(asked).alias("asked")), "simhash-prints")
    found = near(prints.where("asked"), prints, radius).join(prints.select(F.col("fingerprint").alias("b"), "n"), "b")
    found = scratch(found.groupBy(F.col("a").alias("fingerprint")).agg(F.count("*").alias("near_prints"), F.sum("n").alias("near_docs")), "simhash-near")
    discard(prints)
    counts = (F.when(asked, F.coalesce(c, F.lit(0).cast("long"))).alias(c) for c in ("near_prints", "near_docs"))
    return rows.join(found, "fingerprint", "left").select(*rows.columns, *counts)


def _tables(prints: DataFrame, name: str, radius: int, bits: int) -> DataFrame:
    """Each distinct fingerprint once for each block: ``(name, key)``, the key being which block and its bits."""
    cuts = _cuts(radius, bits)
    blocks = F.array(*(F.struct(F.lit(k).alias("table"), F.substring("fingerprint", a + 1, b - a).alias("block")) for k, (a, b) in enumerate(cuts)))
    return prints.select("fingerprint").where("fingerprint IS NOT NULL").distinct().select(F.col("fingerprint").alias(name), F.explode(blocks).alias("key"))


def _cuts(radius: int, bits: int) -> list[tuple[int, int]]:
    digits = bits // 4
    bounds = [digits * k // (radius + 1) for k in range(radius + 2)]
    return list(zip(bounds, bounds[1:], strict=False))


def near(asked: DataFrame, prints: DataFrame, radius: int = RADIUS, bits: int = BITS) -> DataFrame:
    """``(a, b, distance)``: for every fingerprint of ``asked`` all others of ``prints`` at most ``radius`` bits away."""
    digits, cuts = bits // 4, _cuts(radius, bits)
    parts = [(k + 1, min(16, digits - k)) for k in range(0, digits, 16)]
    apart = sum((_hex_distance(F.substring("a", k, n), F.substring("b", k, n)) for k, n in parts), F.lit(0))
    x, y = _tables(asked, "a", radius, bits), _tables(prints, "b", radius, bits)
    once = F.lit(True)  # no block before this one is the same
    for k, (a, b) in enumerate(cuts):
        once = once & ((x["key.table"] <= k) | (F.substring("a", a + 1, b - a) != F.substring("b", a + 1, b - a)))
    found = x.join(y, (x["key"] == y["key"]) & (F.col("a") != F.col("b")) & once & (apart <= radius))
    return found.select("a", "b", apart.alias("distance"))


def near_pairs(prints: DataFrame, radius: int = RADIUS, bits: int = BITS) -> DataFrame:
    """``prints(fingerprint)`` -> every pair ``(a, b, distance)`` of different fingerprints at most ``radius`` apart, a < b."""
    return near(prints, prints, radius, bits).where("a < b")


def _hex_distance(a, b):
    whole = lambda c: F.conv(c, 16, -10).cast("long")  # noqa: E731  two's complement
    return F.bit_count(whole(a).bitwiseXOR(whole(b)))
