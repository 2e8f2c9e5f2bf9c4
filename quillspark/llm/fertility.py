"""Quality rules by tokeniser fertility.

A public vocabulary with byte fallback tells how ordinary a text is: how many characters a token covers on the average,
which share of the tokens are bytes that no piece of the vocabulary covers, and how many bits of entropy the tokens have.
Each word is encoded with the space before it, each distinct word of a task once (pieces do not cross words, so a text's
tokens are those of its words). The script with most of a text's letters tells which rejection bands apply; they are
parameters of the operator and the same for every table, so a text's verdict depends on nothing but the text.

Base rules count words, repeated lines and the words in repeated 5-word windows; a document that fails them is not kept.

Defined results: a null text, an empty one or one without words has no words and fails; its measures are null and its script
is ``none``. A text without letters has the script ``none`` as well. Texts are read whole, whatever their length: a single
text is a step of its own beyond ``SLICE_BYTES``, and takes memory in proportion. Repeated rows give repeated rows, equal
texts equal verdicts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._text import U64, Words, grams, hash_strings, slices, split_words
from quillspark.llm._tokens import vocabulary

VOCABULARY = "piece_bpe_32k.model"
SYMBOLS = "[#*$%&|<>]"
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20


class Band(NamedTuple):
    """What is kept: characters per token from and to, the greatest share of bytes, and of what ``n`` tokens could have
    (``log2(min(n, ORDINARY))`` bits) the least share of entropy."""

    least_chars: float
    most_chars: float
    most_bytes: float
    least_entropy: float


#: Tokens beyond this number add no entropy to an ordinary text.
ORDINARY = 4096
#: First and last code points of scripts, as ranges of the Unicode standard.
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF)),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)),
    "indic": ((0x900, 0xDFF),),
    "thai": ((0xE00, 0xE7F),),
    "hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)),
    "kana_han": ((0x3041, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F)),
}
OTHER, NONE = "other", "none"
#: Latin and Cyrillic text has pieces of several letters; the vocabulary knows other scripts by letters or bytes.
BANDS = {
    "latin": Band(1.15, 8.0, 0.10, 0.25),
    "cyrillic": Band(1.10, 6.0, 0.10, 0.25),
    "greek": Band(0.45, 4.0, 0.60, 0.25),
    "hebrew": Band(0.45, 4.0, 0.60, 0.25),
    "arabic": Band(0.45, 4.0, 0.60, 0.25),
    "indic": Band(0.25, 3.0, 0.95, 0.20),
    "thai": Band(0.25, 3.0, 0.95, 0.20),
    "hangul": Band(0.25, 3.0, 0.95, 0.20),
    "kana_han": Band(0.25, 3.0, 0.95, 0.20),
    OTHER: Band(0.20, 8.0, 1.0, 0.20),
    NONE: Band(0.80, 8.0, 0.50, 0.25),
}
NAMES = [*SCRIPTS, OTHER]


class Pieces:
    """Token ids of words, each distinct word encoded once; beyond ``most`` words the memory is emptied (time, not results)."""

    def __init__(self, path: str, most: int = 500_000):
        import sentencepiece

        self.library, self.most, self.known = sentencepiece.SentencePieceProcessor(model_file=path), most, {}
        self.byte = np.fromiter((self.library.is_byte(i) for i in range(self.library.vocab_size())), bool)

    def encode(self, words: list[str]) -> list[np.ndarray]:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.most:
            self.known, new = {}, words
        ids = self.library.encode(new, num_threads=1) if new else []
        self.known.update((w, np.array(i, np.int32)) for w, i in zip(new, ids, strict=True))
        return [self.known[w] for w in words]


_LOADED: dict[str, Pieces] = {}


def _pieces(path: str) -> Pieces:
    """One for each worker process."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def _edges() -> tuple[np.ndarray, np.ndarray]:
    """Sorted starts of code point ranges and the number of the script of each (-1: none of them)."""
    cuts = sorted((a, b + 1, k) for k, ranges in enumerate(SCRIPTS.values()) for a, b in ranges)
    starts, kinds = [0], [-1]
    for a, b, k in cuts:
        starts += [a, b]
        kinds += [k, -1]
    return np.array(starts), np.array(kinds)


def word_scripts(vocab: list[str]) -> np.ndarray:
    """Letters of each script (columns as ``NAMES``) in each word."""
    out = np.zeros((len(vocab), len(NAMES)), np.int64)
    if not vocab:
        return out
    points, where = np.unique(np.frombuffer("".join(vocab).encode("utf-32-le", "surrogatepass"), "<u4"), return_inverse=True)
    starts, kinds = _edges()
    kind = kinds[np.searchsorted(starts, points, side="right") - 1]
    letter = np.fromiter((chr(p).isalpha() for p in points.tolist()), bool, len(points))
    kind = np.where(~letter, len(NAMES), np.where(kind < 0, len(NAMES) - 1, kind))
    owner = np.repeat(np.arange(len(vocab)), np.fromiter(map(len, vocab), np.int64, len(vocab)))
    return np.bincount(owner * (len(NAMES) + 1) + kind[where], minlength=len(vocab) * (len(NAMES) + 1)).reshape(len(vocab), -1)[:, :-1]


def repeat_words(words: Words, window: int = WINDOW) -> np.ndarray:
    """Of each text, the words in windows that it has twice or more."""
    n, rows = len(words.codes), len(words.counts)
    if n < window:
        return np.zeros(rows, np.int64)
    owner = words.owner()
    whole = owner[: n - window + 1] == owner[window - 1 :]
    at = np.flatnonzero(whole)
    runs = grams(hash_strings(words.vocab)[words.codes], window)[at] ^ (owner[at].astype(U64) * U64(0xD6E8FEB86659FD93))
    _, which, count = np.unique(runs, return_inverse=True, return_counts=True)
    again = at[count[which] > 1]
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, again, 1)
    np.add.at(step, again + window, -1)
    return np.bincount(owner[np.cumsum(step[:-1]) > 0], minlength=rows)


def duplicate_lines(texts: pa.Array) -> np.ndarray:
    """Of each text, the lines with a word that equal an earlier line."""
    lists = pc.split_pattern(texts, "\n")
    lines, owner = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    keep = pc.match_substring_regex(lines, "[^\\x20\\x09-\\x0D]").to_numpy(zero_copy_only=False)
    coded = lines.filter(pa.array(keep)).dictionary_encode()
    owner = owner[keep]
    pairs = np.unique(owner * max(1, len(coded.dictionary)) + coded.indices.to_numpy())
    have, distinct = np.bincount(owner, minlength=len(texts)), np.bincount(pairs // max(1, len(coded.dictionary)), minlength=len(texts))
    return have - distinct


def _entropy(words: Words, first: np.ndarray, size: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Bits of entropy of each text's tokens; the tokens of word w are ``flat[first[w]:first[w] + size[w]]``."""
    rows, out = len(words.counts), np.zeros(len(words.counts))
    pair, count = np.unique(words.owner() * max(1, len(words.vocab)) + words.codes, return_counts=True)
    text, word = pair // max(1, len(words.vocab)), pair % max(1, len(words.vocab))
    n = size[word]
    stop = np.cumsum(n)
    if not len(stop) or not stop[-1]:
        return out
    ids = flat[np.arange(stop[-1]) - np.repeat(stop - n - first[word], n)].astype(np.int64)
    wide = int(flat.max()) + 1
    keys, where = np.unique(np.repeat(text, n) * wide + ids, return_inverse=True)
    times = np.bincount(where, np.repeat(count, n))
    total = np.bincount(keys // wide, times, rows)
    share = times / total[keys // wide]
    return -np.bincount(keys // wide, share * np.log2(share), rows)


COLUMNS = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "script string, n_tokens long, chars_per_token double, byte_share double, entropy double"
)


def measured(texts: pa.Array, pieces: Pieces, bands: dict[str, Band] = BANDS) -> dict[str, np.ndarray | pa.Array]:
    """All columns but the id, for texts without nulls."""
    w = split_words(texts)
    rows, owner, n = len(texts), w.owner(), w.counts.astype(np.int64)
    each = lambda values: np.bincount(owner, values[w.codes], rows)
    chars = np.fromiter(map(len, w.vocab), np.int64, len(w.vocab))
    used = np.zeros(len(w.vocab), bool)
    used[w.codes] = True  # the vocabulary may have an entry that no word is
    ids = pieces.encode([v if u else "" for v, u in zip(w.vocab, used, strict=True)])
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.concatenate([*ids, np.zeros(0, np.int32)])
    bytes_ = np.zeros(len(ids), np.int64) if not len(flat) else np.bincount(np.repeat(np.arange(len(ids)), size), pieces.byte[flat], len(ids))
    word_chars, tokens = each(chars).astype(np.int64), each(size).astype(np.int64)
    letters, table = np.zeros((rows, len(NAMES))), word_scripts(w.vocab)
    for k in np.flatnonzero(table.any(0)):
        letters[:, k] = each(table[:, k])
    script = np.where(letters.sum(1) > 0, letters.argmax(1), len(NAMES))
    repeated, some = repeat_words(w), tokens > 0
    failed = (n < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n)
    per = np.maximum(tokens, 1)
    rate, share, bits = word_chars / per, each(bytes_) / per, _entropy(w, np.cumsum(size) - size, size, flat)
    limits = np.array([bands[name] for name in [*NAMES, NONE]])[script]
    inside = (rate >= limits[:, 0]) & (rate <= limits[:, 1]) & (share <= limits[:, 2]) & (bits >= limits[:, 3] * np.log2(np.clip(per, 1, ORDINARY)))
    optional = lambda v: pa.array(v, mask=~some)
    return {
        "n_words": n, "word_chars": word_chars, "n_symbols": pc.count_substring_regex(texts, SYMBOLS).cast(pa.int64()), "n_dup_lines": duplicate_lines(texts), "n_repeat_words": repeated,
        "base_failed": failed, "kept": ~failed & inside, "script": pa.array(np.array([*NAMES, NONE])[script]), "n_tokens": tokens, "chars_per_token": optional(rate), "byte_share": optional(share), "entropy": optional(bits),
    }


def _rules(path: str, bands: dict[str, Band]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        for part in slices(batches):
            found = measured(pc.fill_null(part.column("text"), ""), pieces, bands)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(v) if isinstance(v, np.ndarray) else v for v in found.values())], names=["doc_id", *found])

    return run


def fertility_rules(docs: DataFrame, path: str | None = None, bands: dict[str, Band] = BANDS) -> DataFrame:
    """The base counts, the measures and the verdict for each row of ``docs(doc_id, text)``; see ``COLUMNS``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_rules(path or vocabulary(VOCABULARY), bands), COLUMNS)
