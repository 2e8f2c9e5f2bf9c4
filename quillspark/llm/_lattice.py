"""Lattices of vocabulary pieces over many short strings at once, as arrays.

Texts become code points and are cut before runs of white space, which no piece goes on over; a lattice is built for each
distinct segment only. Its edges, the pieces that fit somewhere, are kept as one list in the order in which a forward pass
needs them. Forward sums are rescaled by powers of two on the way, so that they neither vanish nor overflow however long
a segment is. Each edge then has the chance that a segmentation that ends where it ends uses it; sampling and expected
counts need nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillspark.llm._text import U64, mix

SPACE, MARK, LITERAL_MARK = 0x20, 0x2581, 0x7FFFFFFF
#: Characters of one step; a longer segment is a step of its own.
BLOCK = 1 << 19
#: Characters between two looks at the scale of the sums, and the power of two below which they are rescaled.
EVERY, SMALL = 16, -200
#: The least weight of a piece: sums can't vanish between two looks.
LEAST_WEIGHT = 1e-9
_BASE = U64(0x9E3779B97F4A7C15)
_TABLE_BITS = 22


class Vocabulary:
    """The ordinary pieces of a SentencePiece model, and its byte pieces."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.bytes = np.zeros(256, np.int32)
        pieces: list[tuple[str, int]] = []
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces.append((piece, i))
        self.pieces = pieces
        #: Pieces in the order of the vocabulary follow a power law of their rank.
        self.rank_weight = np.zeros(self.size + 1)
        for rank, (_, i) in enumerate(pieces):
            self.rank_weight[i] = 1 / (rank + 2.7)
        self.rank_weight /= self.rank_weight.sum()
        self.longest = max(len(p) for p, _ in pieces)
        #: Whether a piece may begin with the characters of a hash.
        self.begins = np.zeros(1 << _TABLE_BITS, bool)
        self.hashes, self.ids = [np.zeros(0, U64)], [np.zeros(0, np.int32)]
        for l in range(1, self.longest + 1):
            some = [(p, i) for p, i in pieces if len(p) == l]
            points = np.frombuffer("".join(p for p, _ in some).encode("utf-32-le"), "<u4").reshape(len(some), l)
            h = np.zeros(len(some), U64)
            for k in range(l):
                h = _step(h, points[:, k])
                self.begins[(h >> U64(64 - _TABLE_BITS)).astype(np.int64)] = True
            order = np.argsort(h)
            self.hashes.append(h[order])
            self.ids.append(np.array([i for _, i in some], np.int32)[order])
        #: The bytes that each piece stands for when decoded.
        self.decoded = [b""] * self.size
        for piece, i in pieces:
            self.decoded[i] = piece.replace("▁", " ").encode()
        for b, i in enumerate(self.bytes.tolist()):
            self.decoded[i] = bytes([b])

    @property
    def unknown(self) -> int:
        """The number that stands for a character that is no piece."""
        return self.size

    def fitting(self, points: np.ndarray, stop: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """``(length, where it begins, piece)`` of all pieces in ``points`` that end at ``stop`` of their begin at the latest."""
        out, at, h = [], np.arange(len(points)), np.zeros(len(points), U64)
        for l in range(1, self.longest + 1):
            room = at + l <= stop[at]
            if not room.all():
                at, h = at[room], h[room]
            h = _step(h, points[at + (l - 1)])
            goes_on = self.begins[(h >> U64(64 - _TABLE_BITS)).astype(np.int64)]
            found = np.flatnonzero(goes_on)
            if len(self.hashes[l]) and len(found):
                k = np.minimum(np.searchsorted(self.hashes[l], h[found]), len(self.hashes[l]) - 1)
                hit = self.hashes[l][k] == h[found]
                where, piece = at[found[hit]], self.ids[l][k[hit]]
            else:
                where, piece = np.zeros(0, np.int64), np.zeros(0, np.int32)
            if l == 1:  # each character is a way on
                whole = np.full(len(points), self.unknown, np.int32)
                whole[where] = piece
                where, piece = np.arange(len(points)), whole
            out.append((l, where, piece))
            at, h = at[found], h[found]
            if not len(at):
                break
        return out


def _step(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(h * _BASE + c.astype(U64) + U64(1))


class Segments(NamedTuple):
    """Distinct segments in a row (``points``, from ``starts``) and their hashes; of each occurrence which one, in which text."""

    points: np.ndarray
    starts: np.ndarray
    name: np.ndarray
    which: np.ndarray
    owner: np.ndarray

    def only(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The points and starts of some distinct segments alone."""
        size = (self.starts[1:] - self.starts[:-1])[some]
        starts = np.concatenate([[0], np.cumsum(size)])
        return self.points[np.arange(starts[-1]) + np.repeat(self.starts[:-1][some] - starts[:-1], size)], starts


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as code points in a row, with ``MARK`` for spaces, and how many each text has."""
    texts = pc.fill_null(texts, "")
    counts = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int32)
    points[points == MARK] = LITERAL_MARK
    points[points == SPACE] = MARK
    return points, counts


def segments(points: np.ndarray, counts: np.ndarray, block: int = BLOCK) -> Iterator[Segments]:
    """Cuts texts before each run of white space and takes equal segments together, about ``block`` characters at a time."""
    n = len(points)
    if not n:
        return
    blank = (points == MARK) | ((points >= 9) & (points <= 13))
    cut = np.zeros(n, bool)
    cut[1:] = blank[1:] & ~blank[:-1]
    begin = np.cumsum(counts) - counts
    cut[begin[counts > 0]] = True
    at = np.flatnonzero(cut)
    del blank, cut
    doc = np.searchsorted(begin, at, "right") - 1
    size = np.diff(np.append(at, n))
    step = (at + size - 1) // block
    bounds = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(at)]
    for a, b in zip(bounds, bounds[1:], strict=False):
        start, stop = at[a], at[b - 1] + size[b - 1]
        yield _distinct(points[start:stop], at[a:b] - start, size[a:b], doc[a:b])


def _distinct(points: np.ndarray, at: np.ndarray, size: np.ndarray, doc: np.ndarray) -> Segments:
    n = len(points)
    with np.errstate(over="ignore"):
        sums = np.full(n, _BASE)
        sums[0] = 1
        sums = mix(points) * np.cumprod(sums)
        sums = np.concatenate([[U64(0)], np.cumsum(sums)])
        back = np.full(n, U64(pow(int(_BASE), -1, 1 << 64)))
        back[0] = 1
        name = mix((sums[at + size] - sums[at]) * np.cumprod(back)[at] + size.astype(U64))
    del sums, back
    name, first, which = np.unique(name, return_index=True, return_inverse=True)
    length = size[first]
    starts = np.concatenate([[0], np.cumsum(length)])
    where = np.arange(starts[-1]) + np.repeat(at[first] - starts[:-1], length)
    return Segments(points[where], starts, name, which, doc)


class Lattice:
    """All pieces that fit anywhere in some segments (``points``, from ``starts``).

    A segment of n characters has n + 1 states. Edges are in the order of the place they end at within their segment;
    those into one state stand together, long pieces first.
    """

    def __init__(self, vocabulary: Vocabulary, points: np.ndarray, starts: np.ndarray):
        self.size, self.longest = np.diff(starts), vocabulary.longest
        self.first = starts[:-1] + np.arange(len(self.size))
        self.states = len(points) + len(self.size)
        segment = np.repeat(np.arange(len(self.size)), self.size)
        fitting = vocabulary.fitting(points, np.repeat(starts[1:], self.size))[::-1]
        at = np.concatenate([w for _, w, _ in fitting]) if fitting else np.zeros(0, np.int64)
        piece = np.concatenate([p for _, _, p in fitting]) if fitting else np.zeros(0, np.int32)
        length = np.repeat(np.array([l for l, _, _ in fitting], np.uint8), [len(w) for _, w, _ in fitting])
        to = at + segment[at] + length
        inside = to - self.first[segment[at]]
        order = np.argsort(to, kind="stable")
        inside = inside[order]
        order = order[np.argsort(inside.astype(np.uint16) if len(inside) and inside.max() < 1 << 16 else inside, kind="stable")]
        self.to, self.length, self.piece = to[order], length[order], piece[order]
        self.last = self.first + self.size
        self.segment = np.repeat(np.arange(len(self.size)), self.size + 1)
        #: Edges into states that are j characters inside stand from ``bounds[j - 1]`` to ``bounds[j]``.
        self.bounds = np.cumsum(np.bincount(inside, minlength=1)) if len(inside) else np.zeros(1, np.int64)
        new = np.ones(len(order), bool)
        new[1:] = self.to[1:] != self.to[:-1]
        #: The first edge into each state, in the order of the edges.
        self.heads = np.flatnonzero(new)

    def forward(self, weight: np.ndarray, shares: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """(log of the summed weight of all segmentations of each segment, share of each edge in its state's sum).

        ``weight`` has a row for each piece, the unknown one included, of ``LEAST_WEIGHT`` at least and with a sum of
        about one for each of its columns, which are kept apart.
        """
        total = np.zeros((self.states, weight.shape[1]))
        total[self.first] = 1
        lost = np.zeros((len(self.size), weight.shape[1]), np.int64)
        share = np.empty((len(self.to), weight.shape[1])) if shares else None
        head = np.searchsorted(self.heads, self.bounds)
        for j in range(1, len(self.bounds)):
            a, b = self.bounds[j - 1], self.bounds[j]
            to, first = self.to[a:b], self.heads[head[j - 1] : head[j]] - a
            part = total[to - self.length[a:b]] * weight[self.piece[a:b]]
            sums, at = np.add.reduceat(part, first), to[first]
            total[at] = sums
            if shares:
                share[a:b] = part / np.repeat(sums, np.diff(np.append(first, b - a)), axis=0)
            if j % EVERY == 0:
                power = np.frexp(sums)[1]
                small = (power < SMALL).any(1)
                if small.any():
                    at, power = at[small], power[small]
                    for k in range(min(j, self.longest)):  # what later sums still read
                        total[at - k] = np.ldexp(total[at - k], -power)
                    lost[self.segment[at]] += power
        return np.log(total[self.last]) + lost * np.log(2), share

    def expected(self, weight: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Expected number of each piece under the segmentation posterior, segment s counted ``times[s]`` times (columns apart)."""
        _, share = self.forward(weight, shares=True)
        visits = np.zeros((self.states, weight.shape[1]))
        visits[self.last] = times
        flat, columns = visits.reshape(-1), np.arange(weight.shape[1])
        for j in range(len(self.bounds) - 1, 0, -1):
            a, b = self.bounds[j - 1], self.bounds[j]
            share[a:b] *= visits[self.to[a:b]]
            of = (self.to[a:b] - self.length[a:b])[:, None] * weight.shape[1] + columns
            np.add.at(flat, of.ravel(), share[a:b].ravel())
        return np.stack([np.bincount(self.piece, share[:, k], len(weight)) for k in range(weight.shape[1])], 1)


class Sampler:
    """Draws segmentations from their posterior by backward sampling; lattices of up to ``most`` states are remembered."""

    def __init__(self, vocabulary: Vocabulary, weight: np.ndarray, most: int = 1_000_000):
        self.vocabulary, self.weight, self.most = vocabulary, np.maximum(weight, LEAST_WEIGHT)[:, None], most
        none = np.zeros(0, np.int64)
        #: Hashes in order and the segment of each; of segments: first state and size; of states: first edge; of edges: length, piece, cumulated share.
        self.held = (np.zeros(0, U64), none, none, none, none, np.zeros(0, np.uint8), np.zeros(0, np.int32), np.zeros(0))

    def _with(self, found: Segments) -> tuple[np.ndarray, ...]:
        held = self.held
        place = np.minimum(np.searchsorted(held[0], found.name), max(0, len(held[0]) - 1))
        new = np.flatnonzero(held[0][place] != found.name) if len(held[0]) else np.arange(len(found.name))
        if not len(new):
            return held
        lattice = Lattice(self.vocabulary, *found.only(new))
        share = lattice.forward(self.weight, shares=True)[1][:, 0]
        number = np.diff(np.append(lattice.heads, len(share)))
        edge = np.zeros(lattice.states, np.int64)
        edge[lattice.to[lattice.heads]] = lattice.heads
        for k in range(1, number.max(initial=0)):  # one after the other, so that the sums don't depend on what else is here
            at = lattice.heads[number > k] + k
            share[at] += share[at - 1]
        share[lattice.heads + number - 1] = np.inf
        edges, states = len(held[5]), len(held[4])
        name = np.concatenate([held[0], found.name[new]])
        order = np.argsort(name, kind="stable")
        both = (
            name[order], np.concatenate([held[1], len(held[2]) + np.arange(len(new))])[order],
            np.concatenate([held[2], lattice.first + states]), np.concatenate([held[3], lattice.size]), np.concatenate([held[4], edge + edges]),
            np.concatenate([held[5], lattice.length]), np.concatenate([held[6], lattice.piece]), np.concatenate([held[7], share]),
        )
        if states + lattice.states <= self.most:
            self.held = both
        return both

    def sample(self, found: Segments, uniform) -> tuple[np.ndarray, np.ndarray]:
        """One segmentation for each occurrence: (pieces in order, pieces of each occurrence).

        ``uniform(occurrences, step)`` gives numbers from 0 to 1.
        """
        name, number, first, size, edge, length, piece, upto = self._with(found)
        own = number[np.searchsorted(name, found.name)]
        begin, state = first[own][found.which], (first + size)[own][found.which]
        live, step, drawn = np.arange(len(state)), 0, []
        count = np.zeros(len(state), np.int64)
        while len(live):
            at, goal = state[live], uniform(live, step)
            e = edge[at]
            more = np.flatnonzero(upto[e] <= goal)
            while len(more):
                e[more] += 1
                more = more[upto[e[more]] <= goal[more]]
            drawn.append((live, piece[e]))
            count[live] += 1
            at = at - length[e]
            state[live] = at
            live, step = live[at > begin[live]], step + 1
        starts = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(starts[-1], np.int32)
        for k, (live, pieces) in enumerate(drawn):
            out[starts[live + 1] - 1 - k] = pieces
        return out, count


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One for each process."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]
