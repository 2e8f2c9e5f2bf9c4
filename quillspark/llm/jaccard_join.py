"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct word 5-grams. Two documents link when ``100 * |A & B| >= 80 * |A | B|``, so their
sets differ in at most ``(|A| + |B|) / 9`` grams. Sets of a size band are cut by a hash into parts of about ``PART`` grams
at most; were the parts of two linked sets all less alike than that, so would the sets be, hence in one part at least the
same bound holds for the grams of that part. The grams of a part are thrown into blocks, and each block is the XOR of the
64-bit hashes of its grams; one differing gram changes one block at most. So two such parts differ in at most
``t = |part| // 4`` blocks, and by the pigeonhole principle the first ``t + 1`` occupied blocks of both, in one global order,
have a block in common. Those blocks are the join keys. Candidates also pass the size bound and the Hamming distance of
parity sketches (a lower bound of the symmetric difference) before their whole sets are intersected.

Skew. Equal sets are one from the start: the smallest id stands for its copies. All grams of all documents are counted, in
hashed counters; grams of counters that stand out form blocks of their own that come last in the global order: boilerplate
then yields no keys for documents that have enough other text. Any fixed set of frequent grams gives exact results, so
grams that share a counter with a frequent one do no harm. What is known of a key (its
pivot, its number of members) is aggregated with map-side combination and written as a table, so that adaptive execution
can split the rows of a hot key where they are joined with it.

Not all pairs of a key are formed. In rounds of stars each key has a pivot: first the member that shares most keys, which
in a group of near copies is one in its middle, then others in a shuffled order; each set is compared with up to ``PIVOTS``
of the pivots of its keys, those that it has most keys in common with, so a round verifies that many pairs for each set at
most. Components merge between the rounds. What is left are the members outside the main component of their key; they are
held against the members of other components by the parity sketches of the part that the key belongs to, within the join,
and only pairs that these let through are formed. A part has at most about ``PART`` grams however large the set is, so
``BRIEF`` words of sketch tell what is too far apart in sets of every size. Pairs that a round has joined never are formed,
and a pair that was verified is not verified again.

Defined results: null or wordless text has no grams and links with nothing (component: itself); fewer than five words
make one gram of the whole sequence; repeated rows give repeated result rows; an empty table gives an empty result;
columns other than ``doc_id`` and ``text`` are ignored. A null ``doc_id`` links with nothing and has a null component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm._spark import connected_components, discard, scratch
from quillspark.llm._text import U64, grams, hashed_words, list_array, mix, ranks_within, signed, slices

WORDS = 5
#: Counters of grams, in bits, and the share of all documents, beyond a counter's mean, that makes its grams frequent.
COUNTERS, FREQUENT = 20, 0.001
#: Counters that go in one row.
SHELF = 4096
#: Each size band spans sizes from b to BAND * b; grams of a part of the band's largest set, blocks for each of them, and the fewest blocks.
BAND, PART, LOAD, LEAST_BLOCKS = 4, 256, 0.5, 64
#: A sketch has ``SKETCH`` bits for each gram at least, in a power of two of words, and ``BRIEF`` words for each part.
SKETCH, BRIEF = 3, 8
#: Rounds of stars before what is left is paired, and pivots that a set is compared with in each.
STARS, PIVOTS = 2, 3
#: A key's slot is its band and its part: ``band << SLOT | part``.
SLOT = 20


def gram_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(owner, gram) pairs without repeats, sorted by owner and gram."""
    hashes, starts = hashed_words(texts)
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    counts = np.diff(starts)
    sizes = np.where(counts < words, counts > 0, counts - words + 1)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(counts)), sizes)
    at = np.arange(len(owner)) + np.repeat(starts[:-1] - ends + sizes, sizes)
    value = np.append(grams(hashes, words), np.zeros(min(words - 1, len(hashes)), U64))[at]
    for k in range(1, words):  # texts of k words: the sequence as one gram
        short = np.flatnonzero(counts == k)
        if len(short):
            value[ends[short] - 1] = mix(grams(hashes, k)[starts[short]] + U64(k))
    for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
        value[a:b].sort()
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[new], value[new]


def _bands(sizes: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(sizes, 1) + 0.5) / np.log(BAND)).astype(np.int64)


def _parts(band: np.ndarray) -> np.ndarray:
    """Parts of a set of this band: a power of two."""
    return np.maximum(1, float(BAND) ** (band + 1) / PART).astype(np.int64)


def _bits(value: np.ndarray) -> np.ndarray:
    """Of each gram, where its bit stands in an endless sketch: the low six bits in a word, the others which word (its low bits: the part)."""
    return mix(value ^ U64(0xD6E8FEB86659FD93))


def _keys(owner: np.ndarray, value: np.ndarray, frequent: np.ndarray, band: np.ndarray):
    """``(owner, key, slot, size)`` for the first ``size // 4 + 1`` occupied blocks of each part of each set, in ``band``."""
    b, parts = band[owner], _parts(band)
    blocks = np.maximum(LEAST_BLOCKS, LOAD * float(BAND) ** (band + 1) / parts).astype(U64)[owner]
    part = (_bits(value) >> U64(6)).astype(np.int64) & (parts[owner] - 1)
    common = frequent_among(value, frequent)
    block = (mix(value ^ U64(0x5851F42D4C957F2D)) % blocks).astype(np.int64) * 2 + common
    wide, deep = int(block.max()).bit_length(), int(part.max()).bit_length()
    order = np.argsort((owner << (wide + deep)) | (part << wide) | block)
    owner, part, block, value, b = owner[order], part[order], block[order], value[order], b[order]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])])
    size = np.diff(np.append(np.flatnonzero(new), len(owner)))  # grams of each part
    group = np.cumsum(new) - 1
    first = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (block[1:] != block[:-1])]))
    parity = np.bitwise_xor.reduceat(value, first)
    owner, part, block, b, group = owner[first], part[first], block[first], b[first], group[first]
    slot = (b << SLOT) | part
    key = mix(mix(parity + block.astype(U64)) + slot.astype(U64) * U64(0x9E3779B97F4A7C15))
    # By group, frequent ones last, by key: of that as many bits as there is room for, unless those are equal somewhere.
    room = 63 - int(group[-1]).bit_length()
    coarse = (group.astype(U64) << U64(room + 1)) | ((block & 1).astype(U64) << U64(room)) | (key >> U64(64 - room))
    order = np.argsort(coarse)
    if (np.diff(coarse[order]) == 0).any():
        order = np.lexsort((key, block & 1, group))
    owner, key, slot, size, group = owner[order], key[order], slot[order], size[group[order]], group[order]
    keep = ranks_within(group) <= size // 4
    return owner[keep], key[keep], slot[keep], size[keep]


def _sign(frequent: np.ndarray, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = part.num_rows
            owner, value = gram_sets(part.column("text"), words)
            sizes = np.bincount(owner, minlength=rows)
            prints = np.zeros((rows, 2), U64)
            band = _bands(sizes)
            above = _bands(np.floor(sizes * 1.25).astype(np.int64))  # a partner may be in the next band
            lanes = 1 << np.ceil(np.log2(np.maximum(SKETCH * sizes / 64, BRIEF * _parts(above)))).astype(np.int64)
            base = np.concatenate([[0], np.cumsum(lanes)])
            sketch = np.zeros(base[-1], U64)
            found, number = [np.zeros(0, np.int64)] * 3, np.zeros(rows, np.int64)
            if len(owner):
                some = np.flatnonzero(sizes)
                first = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
                prints[some, 0] = np.bitwise_xor.reduceat(value, first)
                prints[some, 1] = np.add.reduceat(mix(value), first)
                bit = _bits(value)
                lane, one = (bit >> U64(6)).astype(np.int64) & (lanes[owner] - 1), U64(1) << (bit & U64(63))
                np.bitwise_xor.at(sketch, base[owner] + lane, one)
                some = [_keys(owner, value, frequent, band)]
                also = (above > band)[owner]
                if also.any():
                    some.append(_keys(owner[also], value[also], frequent, band + 1))
                at, *found = (np.concatenate(x) for x in zip(*some, strict=True))
                order = np.argsort(at, kind="stable")
                found, number = [x[order] for x in found], np.bincount(at, minlength=rows)
            keys = pa.StructArray.from_arrays([pa.array(signed(found[0])), pa.array(found[1], pa.int32()), pa.array(found[2], pa.int32())], names=["key", "slot", "size"])
            keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(number)]), pa.int32()), keys)
            columns = [part.column("doc_id"), pa.array(sizes, pa.int64())]
            columns += [pa.array(signed(np.ascontiguousarray(prints[:, k]))) for k in range(2)]
            columns += [list_array(signed(sketch), lanes, pa.int64()), keys]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "fa", "fb", "sketch", "keys"])

    return run


_SIGNED = "doc_id long, n long, fa long, fb long, sketch array<long>, keys array<struct<key: long, slot: int, size: int>>"


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            owner, value = gram_sets(part.column("text"), words)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), list_array(signed(value), np.bincount(owner, minlength=part.num_rows), pa.int64())], names=["id", "grams"]
            )

    return run


def _counter(value: np.ndarray) -> np.ndarray:
    return (mix(value ^ U64(0xA24BAED4963EE407)) >> U64(64 - COUNTERS)).astype(np.int64)


def frequent_among(value: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Which grams are frequent: by their counters if ``frequent`` tells of each counter, else as grams themselves."""
    if frequent.dtype == bool:
        return frequent[_counter(value)]
    return np.isin(value, frequent) if len(frequent) else np.zeros(len(value), bool)


def _counted(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, docs = np.zeros(1 << COUNTERS, np.int64), 0
        for part in slices(batches):
            docs += part.num_rows
            seen += np.bincount(_counter(gram_sets(part.column("text"), words)[1]), minlength=len(seen))
        some = np.flatnonzero(seen)
        # Counter -1: documents.
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(seen[some], docs), pa.int64())], names=["counter", "seen"])

    return run


def _shelved(words: int):
    """What ``_counted`` gives, each ``SHELF`` counters in one row; those of shelf -1: documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _counted(words)(batches):
            counter, seen = (part.column(c).to_numpy() for c in ("counter", "seen"))
            own = counter >= 0
            shelf = np.unique(counter[own] // SHELF)
            flat = np.zeros((1 << COUNTERS), np.int32)
            flat[counter[own]] = seen[own]
            rows = [*flat.reshape(-1, SHELF)[shelf], seen[~own].astype(np.int32)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(shelf, -1), pa.int32()), list_array(np.concatenate(rows), np.array([len(r) for r in rows]), pa.int32())], names=["shelf", "seen"]
            )

    return run


def _summed(table: pa.Table) -> pa.Table:
    """The rows of one shelf, added."""
    seen = table.column("seen").combine_chunks()
    counts = seen.flatten().to_numpy().reshape(len(seen), -1).sum(axis=0, dtype=np.int64)
    return pa.table([pa.array([table.column("shelf")[0].as_py()], pa.int32()), pa.array([int(counts.sum())], pa.int64()), pa.array([counts.tolist()], pa.list_(pa.int64()))], names=["shelf", "total", "seen"])


def frequent_grams(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """Of each counter, whether its grams are frequent: more than a mean counter, and ``FREQUENT`` of all documents (10 at least), have."""
    seen = docs.select("text").mapInArrow(_shelved(words), "shelf int, seen array<int>")
    seen = scratch(seen.groupBy("shelf").applyInArrow(_summed, "shelf int, total long, seen array<long>"), "jaccard-counts")
    own = F.col("shelf") >= 0
    total, grams_of_all = seen.agg(F.sum(F.when(~own, F.col("total"))), F.sum(F.when(own, F.col("total")))).first()
    least = (grams_of_all or 0) / (1 << COUNTERS) + max(10, FREQUENT * (total or 0))
    hot = seen.where(own).select("shelf", F.posexplode("seen").alias("at", "n")).where(F.col("n") >= least)
    hot = hot.select((F.col("shelf") * SHELF + F.col("at")).alias("counter")).toArrow().column("counter").to_numpy()
    discard(seen)
    frequent = np.zeros(1 << COUNTERS, bool)
    frequent[hot] = True
    return frequent


def _half(sketch: Column, words: Column) -> Column:
    """A parity sketch of half the bits is the XOR of the halves."""
    half = (words / 2).cast("int")
    return F.zip_with(F.slice(sketch, 1, half), F.slice(sketch, half + 1, half), lambda p, q: p.bitwiseXOR(q))


def _brief(sketch: Column, slot: Column) -> list[Column]:
    """The sketch of a part, ``BRIEF`` words, from a whole sketch; its words stand ``parts`` apart."""
    band, part = F.shiftright(slot, SLOT), slot.bitwiseAND((1 << SLOT) - 1)
    parts = F.greatest(F.lit(1), F.floor(F.pow(F.lit(float(BAND)), band + 1) / PART)).cast("int")
    again = F.sequence(F.lit(0), (F.size(sketch) / (parts * BRIEF)).cast("int") - 1)
    word = lambda k: F.aggregate(again, F.lit(0).cast("long"), lambda x, i: x.bitwiseXOR(F.element_at(sketch, (part + parts * (k + BRIEF * i) + 1).cast("int"))))
    return [word(k).alias(f"w{k}") for k in range(BRIEF)]


def _part_allowed() -> Column:
    """Sizes and sketches of a part, ``x`` and ``y``, allow that 0.8 or more of its grams are common."""
    n, m = F.col("x.size").cast("long"), F.col("y.size").cast("long")
    apart = sum((F.bit_count(F.col(f"x.w{k}").bitwiseXOR(F.col(f"y.w{k}"))) for k in range(BRIEF)), F.lit(0))
    return (n * 5 >= m * 4) & (m * 5 >= n * 4) & (apart * 9 <= n + m)


def _allowed(a: str, b: str) -> Column:
    """Sizes and sketches ``(n, sketch)`` of equal lengths allow a link of the two sides."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = F.aggregate(F.zip_with(f"{a}.sketch", f"{b}.sketch", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, c: s + c)
    return (n * 5 >= m * 4) & (m * 5 >= n * 4) & (apart * 9 <= n + m)


def _verified(pairs: DataFrame, whole: DataFrame, text: DataFrame, words: int) -> DataFrame:
    """Of the pairs ``(a, b)`` of representatives those whose whole sketches and then whole gram sets are alike enough."""
    one, other = (whole.select(F.col("rep").alias(c), F.struct("n", "sketch").alias(f"of_{c}")) for c in "ab")
    near = pairs.join(one, "a").join(other, "b")
    x, y = F.size("of_a.sketch"), F.size("of_b.sketch")
    level = lambda c, mine, theirs: F.struct(F.col(f"of_{c}.n").alias("n"), F.when(mine > theirs, _half(F.col(f"of_{c}.sketch"), mine)).otherwise(F.col(f"of_{c}.sketch")).alias("sketch")).alias(c)
    near = near.select("a", "b", level("a", x, y).alias("x"), level("b", y, x).alias("y")).where(_allowed("x", "y"))
    near = scratch(near.select("a", "b").distinct(), "jaccard-pairs")
    ids = near.select(F.col("a").alias("doc_id")).union(near.select("b")).distinct()
    sets = scratch(text.join(ids, "doc_id").mapInArrow(_sets(words), "id long, grams array<long>"), "jaccard-sets")
    left, right = sets.select(F.col("id").alias("a"), F.col("grams").alias("ga")), sets.select(F.col("id").alias("b"), F.col("grams").alias("gb"))
    both = F.size(F.array_intersect("ga", "gb")).cast("long")
    found = near.join(left, "a").join(right, "b").select("a", "b", both.alias("both"), (F.size("ga") + F.size("gb") - both).alias("either"))
    links = scratch(found.where("100 * both >= 80 * either").select("a", "b"), "jaccard-links")
    discard(near, sets)
    return links


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def jaccard_components(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_shingles, component_id)``, one row for each row of ``docs``."""
    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signs = scratch(text.mapInArrow(_sign(frequent_grams(text, words), words), _SIGNED), "jaccard-signs")
    named = signs.where("doc_id IS NOT NULL AND n > 0")

    # Equal sets are one: the smallest id stands for them.
    first = scratch(named.groupBy("fa", "fb").agg(F.min("doc_id").alias("rep")), "jaccard-first")
    member = scratch(signs.select("doc_id", "n", "fa", "fb").join(first, ["fa", "fb"], "left").select("doc_id", "n", "rep"), "jaccard-members")
    own = named.join(first.withColumnRenamed("rep", "doc_id"), ["fa", "fb", "doc_id"]).dropDuplicates(["fa", "fb", "doc_id"])
    own = scratch(own.select(F.col("doc_id").alias("rep"), "n", "sketch", "keys"), "jaccard-sets-of-one")
    discard(signs, first)
    whole = own.select("rep", "n", "sketch")

    # Representatives by the keys that several of them have.
    entries = own.select("rep", F.explode("keys").alias("k")).select("rep", "k.*")
    several = scratch(entries.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("key"), "jaccard-several")
    shared = scratch(entries.join(several, "key").distinct(), "jaccard-shared")
    discard(several)

    # Stars: each member of a key against its pivot, unless one component holds both.
    component, links = None, []
    for k in range(STARS):
        if component is None:
            middle = shared.groupBy("rep").agg(F.count("*").alias("order"))
            rows = shared.join(middle, "rep").withColumn("comp", F.col("rep"))
        else:
            rows = _placed(shared, component).withColumn("order", F.xxhash64("rep", F.lit(k)))
        pivot = rows.groupBy("key").agg(F.max(F.struct("order", "rep", "comp")).alias("pivot"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        pivot = scratch(pivot.where("lo < hi").select("key", F.col("pivot.rep").alias("other"), F.col("pivot.comp").alias("apart")), "jaccard-pivots")
        common = rows.join(pivot, "key").where("comp <> apart").groupBy("rep", "other").agg(F.count("*").alias("common"))
        best = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("common"), "other"))
        pairs = common.withColumn("best", best).where(F.col("best") <= PIVOTS).select(*_pair("rep", "other")).distinct()
        found = _verified(pairs, whole, text, words)
        discard(pivot)
        links.append(found)
        if not found.isEmpty():
            component = _merged(component, links)

    # What is left: members outside the main component of their key against those of other components.
    rows = _placed(shared, component) if component is not None else shared.withColumn("comp", F.col("rep"))
    sizes = rows.groupBy("key", "comp").count().groupBy("key").agg(F.max(F.struct("count", "comp")).alias("main"), F.count("*").alias("parts"))
    sizes = scratch(sizes.where("parts > 1").select("key", F.col("main.comp").alias("main")), "jaccard-mains")
    left = scratch(rows.join(sizes, "key"), "jaccard-left")
    brief = left.select("rep", "slot", "size").distinct().join(whole, "rep").select("rep", "slot", F.struct("size", *_brief(F.col("sketch"), F.col("slot"))).alias("brief"))
    open_ = scratch(left.drop("size").join(brief, ["rep", "slot"]), "jaccard-open")
    discard(shared, sizes, left)
    x = open_.where("comp <> main").select("key", F.col("rep").alias("xr"), F.col("comp").alias("xc"), F.col("brief").alias("x"))
    y = open_.select("key", F.col("rep").alias("yr"), F.col("comp").alias("yc"), "main", F.col("brief").alias("y"))
    # Of two members outside the main component the lower one stands left.
    once = (F.col("xc") != F.col("yc")) & ((F.col("yc") == F.col("main")) | (F.col("xr") < F.col("yr")))
    pairs = x.join(y, (x["key"] == y["key"]) & once & _part_allowed()).select(*_pair("xr", "yr")).distinct()
    late = _verified(pairs, whole, text, words)
    discard(open_)
    if not late.isEmpty():
        component = _merged(component, [*links, late])
    discard(own, late, *links)

    out = member.withColumn("rep", F.coalesce("rep", "doc_id"))
    if component is not None:
        out = out.join(component.withColumnRenamed("id", "rep"), "rep", "left").withColumn("rep", F.coalesce("component", "rep"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("component_id"))


def _placed(shared: DataFrame, component: DataFrame) -> DataFrame:
    """``shared`` with the component of each representative."""
    placed = shared.join(component.withColumnRenamed("id", "rep"), "rep", "left")
    return placed.select(*shared.columns, F.coalesce("component", "rep").alias("comp"))


def _merged(before: DataFrame | None, links: list[DataFrame]) -> DataFrame:
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    after = connected_components(every)
    if before is not None:
        discard(before)
    return after
