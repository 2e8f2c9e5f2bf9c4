"""Vectorised text helpers that run inside Arrow tasks: bounded slices, words, hashes, rolling hashes, minima."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that one vectorised step holds; a single longer text is a step of its own.
SLICE_BYTES = 3 << 20
U64 = np.uint64


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, in pieces of about ``most`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        step = np.cumsum(size) // most
        cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


class Words(NamedTuple):
    """All words of some texts: ``vocab[codes]``, those of text i at ``starts[i]:starts[i + 1]``."""

    codes: np.ndarray
    starts: np.ndarray
    vocab: list[str]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), self.counts)


def split_words(texts: pa.Array, lower: bool = False) -> Words:
    """Words are runs of anything but space, tab, LF, VT, FF and CR. A null text has none. ``lower`` folds A-Z only."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    codes, vocab = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
    empty = pc.index(coded.dictionary, "").as_py() if vocab else -1
    if empty >= 0:
        keep = codes != empty
        owner = np.repeat(np.arange(len(counts)), counts)[keep]
        codes, counts = codes[keep], np.bincount(owner, minlength=len(counts))
        vocab[empty] = " "  # no word has its number
    return Words(codes, np.concatenate([[0], np.cumsum(counts)]), vocab)


def hash_strings(strings: list[str], seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in strings), U64, len(strings))


_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
#: Words of so many bytes or more are hashed one by one.
LONG_WORD = 32
#: The public constants of XXH64.
_P1, _P2, _P3, _P4, _P5 = (U64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << U64(bits)) | (x >> U64(64 - bits))


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of ``split_words``, with A-Z folded, as ``hash_strings`` hashes them; those of text i at ``starts[i]:starts[i + 1]``."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw, base = texts.buffers()[2], offsets[0]
    size = int(offsets[-1] - base)
    if not size:
        return np.zeros(0, U64), np.zeros(len(texts) + 1, np.int64)
    data = np.zeros(size + 8, np.uint8)
    data[:size] = _LOWER[np.frombuffer(raw, np.uint8)[base : base + size]]
    word = ~_SPACE[data[:size]]
    starts, stops = word.copy(), word.copy()  # first and last bytes of words; a word ends with its text
    starts[1:] &= ~word[:-1]
    stops[:-1] &= ~word[1:]
    bounds = offsets - base
    inner = bounds[(bounds > 0) & (bounds < size)]
    starts[inner], stops[inner - 1] = word[inner], word[inner - 1]
    first = np.flatnonzero(starts)
    left = np.flatnonzero(stops) + 1 - first
    # XXH64 of short words, all at once: eight bytes at a time, then four, then single ones.
    eights, fours = (np.ndarray((size + 8 - n + 1,), f"<u{n}", data.data, strides=(1,)) for n in (8, 4))
    out = left.astype(U64) + _P5
    short = left < LONG_WORD
    for k in range(LONG_WORD // 8 - 1):
        i = np.flatnonzero(short & (left >= 8 * k + 8))
        lane = _turned(eights[first[i] + 8 * k] * _P2, 31) * _P1
        out[i] = _turned(out[i] ^ lane, 27) * _P1 + _P4
    i = np.flatnonzero(short & (left & 4 > 0))
    out[i] = _turned(out[i] ^ fours[first[i] + (left[i] & ~7)].astype(U64) * _P1, 23) * _P2 + _P3
    for k in range(3):
        i = np.flatnonzero(short & (left & 3 > k))
        out[i] = _turned(out[i] ^ data[first[i] + (left[i] & ~3) + k].astype(U64) * _P5, 11) * _P1
    out ^= out >> U64(33)
    out *= _P2
    out ^= out >> U64(29)
    out *= _P3
    out ^= out >> U64(32)
    for i in np.flatnonzero(~short):
        out[i] = xxhash.xxh64_intdigest(data[first[i] : first[i] + left[i]].tobytes())
    return out, np.searchsorted(first, bounds)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser (public constants)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_FOLD = U64(0x9E3779B97F4A7C15)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of ``n`` neighbouring hashes (runs across texts included: mask those by position)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = hashes[:m].copy()
    for k in range(1, n):
        out *= _FOLD
        out += hashes[k : k + m]
    return mix(out)


def long_grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """As ``grams``, in a time that does not depend on ``n``: by doubling the runs that are folded together."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    have, run, size, left, at = None, hashes, 1, n, 0
    while True:
        if left & 1:
            part = run[at : at + m]
            have = part.copy() if have is None else have * _FOLD + part
            at += size
        left >>= 1
        if not left:
            return mix(have)
        run = mix(run[: len(run) - size] * _FOLD + run[size:])
        size *= 2


def run_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each window of ``w`` values."""
    m = len(x) - w + 1
    if m <= 0:
        return x[:0]
    out, size = x, 1
    while size * 2 <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[:m], out[w - size : w - size + m])


def minimisers(values: np.ndarray, w: int, owner: np.ndarray) -> np.ndarray:
    """True where a value is the least of some window of ``w`` values of one owner. Every such window has one; ties all count.

    ``values`` are above 0 and those of an owner stand together.
    """
    low = run_min(values, w)
    if not len(low):
        return np.zeros(len(values), bool)
    low = np.where(owner[: len(low)] == owner[w - 1 :], low, 0).astype(values.dtype)
    pad = np.zeros(w - 1, values.dtype)
    return values == ~run_min(~np.concatenate([pad, low, pad]), w)  # the largest of the minima of the windows around a value


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(U64, copy=False).view(np.int64)


def ranks_within(groups: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... along each run of equal neighbours."""
    n = len(groups)
    if not n:
        return np.zeros(0, np.int64)
    first = np.concatenate([[True], groups[1:] != groups[:-1]])
    at = np.arange(n)
    return at - np.maximum.accumulate(np.where(first, at, 0))


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
