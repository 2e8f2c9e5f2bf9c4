"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands.

Documents become pieces of at most ``capacity`` ids. Pieces are dealt at random to shards of about ``SHARD`` pieces; on
each shard several islands evolve packings. An individual is a grouping of the pieces into bins. Crossover injects the
fuller bins of one parent whole into the other, drops the bins that then hold a piece twice, and best-fits the pieces
that lost their bin, largest first. After an epoch the islands of a shard send each other their elites; after the last
one the shard keeps its best packing. The bins that are not well filled are then taken apart and their pieces pooled
from many shards into new ones, level by level, until one shard holds what is left, so that the number of bins above
the total length over the capacity does not grow with the number of shards.

Everything moves between Spark jobs as rows of one shard each (bounded by ``SHARD``), spread evenly by a hash.

Defined results: a null or empty text is its end id alone; repeated rows are documents of their own; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._spark import discard, partitions, scratch
from quillspark.llm._text import slices
from quillspark.llm._tokens import vocabulary, with_end, word_tokenizer

CAPACITY, END = 4096, 1
SHARD, ISLANDS, EPOCHS, GENERATIONS, POPULATION, ELITES = 4096, 2, 2, 4, 5, 2
#: A bin at least this full is kept at the end of a level.
WELL_FILLED = 0.995

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path)
        for part in slices(batches):
            ids, starts = with_end(*tokenizer.encode(part.column("text")), end)
            data = memoryview(ids.astype("<u4")).cast("B")
            sizes = np.diff(starts)
            number = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), number)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
            start = piece * capacity
            length = np.minimum(capacity, sizes[row] - start)
            at = starts[row] + start
            crc = [zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            docs = part.column("doc_id").take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [docs, pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """``docs(doc_id, text)`` -> one row for each piece: ``(doc_id, piece, start, length, ids_crc32)``."""
    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return text.mapInArrow(_pieces(tokenizer, capacity, end), PIECE)


# One island. A packing is a list of bins, a bin a list of piece numbers.


def _best_fit(bins: list[list[int]], items: list[int], sizes: list[int], capacity: int) -> list[list[int]]:
    """Each item into the fullest bin that has room, else a new one. ``room`` has a bit for each residual in use."""
    by_room: dict[int, list[int]] = {}
    room = 0
    for k, b in enumerate(bins):
        left = capacity - sum(sizes[i] for i in b)
        by_room.setdefault(left, []).append(k)
        room |= 1 << left
    for i in items:
        fits = room >> sizes[i]
        if fits:
            left = (fits & -fits).bit_length() - 1 + sizes[i]
            k = by_room[left].pop()
            if not by_room[left]:
                room ^= 1 << left
            bins[k].append(i)
        else:
            left, k = capacity, len(bins)
            bins.append([i])
        left -= sizes[i]
        at = by_room.setdefault(left, [])
        if not at:
            room |= 1 << left
        at.append(k)
    return bins


def _fitness(bins: list[list[int]], sizes: list[int], capacity: int) -> float:
    """Fewer bins first; among as many, the more unevenly filled ones, which leave room together."""
    fill = [sum(sizes[i] for i in b) / capacity for b in bins]
    return -len(bins) + sum(f * f for f in fill) / (len(bins) + 1)


def _crossover(one: list[list[int]], two: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    full = sorted(two, key=lambda b: -sum(sizes[i] for i in b))
    taken = [list(b) for b in full[: max(1, int(len(full) * rng.uniform(0.2, 0.8)))]]
    inside = {i for b in taken for i in b}
    kept, homeless = [], []
    for b in one:
        if inside.isdisjoint(b):
            kept.append(list(b))
        else:
            homeless += [i for i in b if i not in inside]
    homeless.sort(key=lambda i: -sizes[i])
    return _best_fit(taken + kept, homeless, sizes, capacity)


def evolve(sizes: list[int], capacity: int, seed: int, guests: list[list[list[int]]] = (), generations: int = GENERATIONS) -> list[list[list[int]]]:
    """The elites of an island after some generations, best first. ``guests`` are packings that other islands sent."""
    rng = random.Random(seed)
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    least = -(-sum(sizes) // capacity)
    people = [[list(b) for b in g] for g in guests] or [_best_fit([], order, sizes, capacity)]
    score = lambda p: _fitness(p, sizes, capacity)
    best = max(people, key=score)
    if len(best) > least:
        while len(people) < POPULATION:
            noisy = sorted(range(len(sizes)), key=lambda i: -sizes[i] * rng.uniform(0.7, 1))
            people.append(_best_fit([], noisy, sizes, capacity))
        for _ in range(generations):
            people.sort(key=score, reverse=True)
            if len(people[0]) <= least:
                break
            child = [_crossover(people[rng.randrange(2)], people[rng.randrange(1, len(people))], sizes, capacity, rng) for _ in range(2)]
            people = people[: POPULATION - len(child)] + child
    return sorted(people, key=score, reverse=True)[:ELITES]


def _bin_numbers(packing: list[list[int]], n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(packing):
        for i in b:
            out[i] = k
    return out


def _bins(numbers: list[int]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(max(numbers, default=-1) + 1)]
    for i, k in enumerate(numbers):
        out[k].append(i)
    return out


def _island(capacity: int, epoch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                guests = [_bins(e) for e in row["elites"] or []]
                found = evolve(row["sizes"], capacity, hash((row["shard"], row["island"], epoch)), guests)
                numbers = [_bin_numbers(p, len(row["sizes"])) for p in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]], pa.int64()), pa.array([row["island"]], pa.int32()), pa.array([_fitness(found[0], row["sizes"], capacity)]), pa.array([numbers], pa.list_(pa.list_(pa.int32())))],
                    names=["shard", "island", "fitness", "elites"],
                )

    return run


_ELITES = "shard long, island int, fitness double, elites array<array<int>>"


def _pack_shards(shards: DataFrame, capacity: int) -> tuple[DataFrame, DataFrame]:
    """``shards(shard, pieces)`` -> the same with ``bins``, the bin number of each piece in the best packing found; and the scratch table it reads."""
    spark = shards.sparkSession
    sizes = shards.select("shard", F.col("pieces.length").alias("sizes"))
    islands = sizes.withColumn("island", F.explode(F.array(*(F.lit(i) for i in range(ISLANDS)))))
    none = F.lit(None).cast("array<array<int>>")
    state = islands.withColumn("elites", none)
    for epoch in range(EPOCHS):
        spread = state.repartition(4 * partitions(spark), "shard", "island")
        grown = scratch(spread.mapInArrow(_island(capacity, epoch), _ELITES), "packing-elites")
        if epoch:
            discard(last)
        last = grown
        if epoch + 1 < EPOCHS:  # every island gets the elites of all islands of its shard
            sent = grown.groupBy("shard").agg(F.flatten(F.collect_list("elites")).alias("elites"))
            state = islands.join(sent, "shard")
    best = grown.groupBy("shard").agg(F.max_by(F.col("elites")[0], F.struct("fitness", "island")).alias("bins"))
    return shards.join(best, "shard"), grown


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: sequences are gapless from 0 and hold at most ``capacity`` ids."""
    columns = [f.strip().split()[0] for f in PIECE.split(",")]
    todo, done, level = scratch(pieces.select(*columns), "packing-pieces"), [], 0
    dealt_from = [todo]
    while True:
        number = max(1, -(-todo.count() // shard))
        # A random deal by content and place in the written table, so that equal rows are spread as others are.
        dealt = todo.withColumn("shard", F.pmod(F.xxhash64(F.lit(level), *columns, F.monotonically_increasing_id()), F.lit(number)))
        shards = dealt.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("pieces"))
        shards = scratch(shards, "packing-shards")
        packed, grown = _pack_shards(shards, capacity)
        each = packed.select("shard", F.inline(F.arrays_zip("pieces", "bins"))).select("shard", "bins", "pieces.*")
        each = each.groupBy("shard", "bins").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("pieces"))
        fill = F.aggregate("pieces.length", F.lit(0).cast("long"), lambda a, x: a + x)
        each = scratch(each.withColumn("fill", fill), "packing-bins")
        discard(shards, grown, *dealt_from)
        dealt_from = []
        kept = each if number == 1 else each.where(F.col("fill") >= int(WELL_FILLED * capacity))
        done.append(kept.select((F.lit(level).cast("long") * (1 << 56) + F.col("shard") * (1 << 20) + F.col("bins")).alias("sequence_id"), "pieces"))
        if number == 1:
            break
        todo, level = each.where(F.col("fill") < int(WELL_FILLED * capacity)).select(F.inline("pieces")), level + 1
        if level == 1:
            before = number
        elif number >= before:  # the rest does not shrink: it is packed as it is
            done[-1] = each.select((F.lit(level - 1).cast("long") * (1 << 56) + F.col("shard") * (1 << 20) + F.col("bins")).alias("sequence_id"), "pieces")
            break
        before = number
    all_bins = done[0]
    for d in done[1:]:
        all_bins = all_bins.unionByName(d)
    ends = F.expr("transform(pieces, (p, i) -> aggregate(slice(pieces, 1, i), 0L, (a, x) -> a + x.length))")
    rows = all_bins.select("sequence_id", F.inline(F.arrays_zip(F.col("pieces").alias("pieces"), ends.alias("offset"))))
    return rows.select(*(F.col(f"pieces.{c}").alias(c) for c in columns), "sequence_id", "offset")


def packed_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``."""
    return pack(token_pieces(docs, tokenizer or vocabulary("word_bpe_49k.json"), capacity), capacity)
