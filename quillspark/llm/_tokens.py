"""Token ids through the tokenizers library, each distinct word of a task encoded once."""

from __future__ import annotations

import os
import string
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillspark.llm._text import U64, hash_strings, split_words


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: ASCII marks but the apostrophe.
_MARKS = np.isin(np.arange(256), np.frombuffer(string.punctuation.replace("'", "").encode(), np.uint8))
#: Words of letters that the library is given at once.
_TOGETHER = 32


class WordTokenizer:
    """For BPE with word ends that drops white space: a text's ids are those of its words in a row.

    Marks at the end of a word are words of their own where the letter before them is told apart from them by the library
    (one that lower-cases to a letter and a combining mark is not). ``most`` bounds the words that are remembered; beyond
    it the memory is emptied, which changes time, not results.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.most = most
        self.letters: dict[str, bool] = {}
        closing = [(i, t.endswith("</w>")) for t, i in self.library.get_vocab().items()]
        self.closing = np.zeros(max(i for i, _ in closing) + 1, bool)
        self.closing[[i for i, c in closing if c]] = True
        self._forget()

    def _forget(self) -> None:
        self.known, self.at, self.size, self.flat = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.kind)

    def _ids(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def _stands_alone(self, letter: str) -> bool:
        """Whether marks after this letter are tokens of their own."""
        if letter not in self.letters:
            one, other, mark, both, two = self._ids([letter, "a" + letter, ".", letter + ".", "a" + letter + "."])
            self.letters[letter] = both == one + mark and two == other + mark
        return self.letters[letter]

    def _has(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(hashes), bool)
        return self.known[np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)] == hashes

    def _letters_only(self, word: str) -> bool:
        return word.isalpha() and (word.isascii() or all(c < "\x80" or self._stands_alone(c) for c in word))

    def _learn(self, words: list[str], hashes: np.ndarray) -> None:
        plain = np.fromiter(map(self._letters_only, words), bool, len(words))
        one, other = [words[i] for i in np.flatnonzero(plain)], [words[i] for i in np.flatnonzero(~plain)]
        # A word of letters alone has one closing token, so many such words can be encoded as one text.
        joined = self._ids([" ".join(one[k : k + _TOGETHER]) for k in range(0, len(one), _TOGETHER)])
        flat = np.fromiter(chain.from_iterable(joined), self.kind)
        size = np.diff(np.flatnonzero(self.closing[flat]) + 1, prepend=0)
        if len(size) != len(one):
            raise ValueError("a word of letters has not one closing token: this tokenizer is of another kind")
        rest = self._ids(other)
        size = np.concatenate([size, np.fromiter(map(len, rest), np.int64, len(rest))])
        flat = np.concatenate([flat, np.fromiter(chain.from_iterable(rest), self.kind)])
        at = len(self.flat) + np.cumsum(size) - size
        known = np.concatenate([self.known, hashes[plain], hashes[~plain]])
        order = np.argsort(known, kind="stable")
        self.known, self.at, self.size = known[order], np.concatenate([self.at, at])[order], np.concatenate([self.size, size])[order]
        self.flat = np.concatenate([self.flat, flat])

    def _parts(self, vocab: list[str]) -> tuple[list[str], np.ndarray, list[str]]:
        """Each word without the marks at its end, as far as they are words of their own; which have such marks, and the marks."""
        data = pa.array(vocab, pa.large_string())
        offsets, body = (np.frombuffer(b, kind) for b, kind in zip(data.buffers()[1:], (np.int64, np.uint8), strict=True))
        start, stop = offsets[: len(vocab)], offsets[1 : len(vocab) + 1].copy()
        live = np.arange(len(vocab))
        while len(live := live[(stop[live] > start[live]) & _MARKS[body[np.maximum(stop[live], 1) - 1]]]):
            stop[live] -= 1
        number = offsets[1 : len(vocab) + 1] - stop
        words, tails, has = list(vocab), [], []
        for i in np.flatnonzero((number > 0) & (stop > start)).tolist():
            base, tail = vocab[i][: -number[i]], vocab[i][-number[i] :]
            if base[-1].isalpha() and (base[-1] < "\x80" or self._stands_alone(base[-1])):
                words[i] = base
                has.append(i)
                tails.append(tail)
        return words, np.array(has, np.int64), tails

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, how many each text has); a null text counts as empty."""
        texts = pc.fill_null(texts, "")
        marked = pc.any(pc.match_substring(texts, "<|")).as_py()  # special tokens are told apart before case is folded
        words = split_words(texts, lower=not marked)
        if not len(words.codes):
            return np.zeros(0, self.kind), np.zeros(len(texts), np.int64)
        base, has, tails = (words.vocab, np.zeros(0, np.int64), []) if marked else self._parts(words.vocab)
        number, parts = len(base), [*base, *tails]
        hashes = hash_strings(parts)
        new = np.flatnonzero(~self._has(hashes))
        if len(new):
            if len(self.known) + len(new) > self.most:
                self._forget()
                new = np.arange(len(hashes))
            values, first = np.unique(hashes[new], return_index=True)
            self._learn([parts[i] for i in new[first]], values)
        # From parts to distinct words, two parts each, and to all words.
        where = np.searchsorted(self.known, hashes)
        at, size = np.zeros((number, 2), np.int64), np.zeros((number, 2), np.int64)
        for column, rows, some in ((0, slice(None), where[:number]), (1, has, where[number:])):
            at[rows, column], size[rows, column] = self.at[some], self.size[some]
        at, size, whole = at.ravel(), size.ravel(), size.sum(1)
        stop = np.cumsum(size)
        table = self.flat[np.arange(stop[-1]) - np.repeat(stop - size - at, size)]
        every = whole[words.codes]
        bounds = np.concatenate([[0], np.cumsum(every)])
        ids = table[np.arange(bounds[-1]) - np.repeat(bounds[:-1] - (np.cumsum(whole) - whole)[words.codes], every)]
        return ids, np.diff(bounds[words.starts])


_LOADED: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One for each worker process."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end`` after each document's, and where each document starts (one more than there are documents)."""
    starts = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.empty(starts[-1], ids.dtype)
    last = np.zeros(starts[-1], bool)
    last[starts[1:] - 1] = True
    out[last] = end
    out[~last] = ids
    return out, starts
