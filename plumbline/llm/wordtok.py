"""Ids of a lower-casing word BPE (word_bpe_49k.json), the same as the tokenizers library gives, but once per distinct word.

White space never lies inside a token of this vocabulary, so a text's ids are its words' ids in turn. Distinct words
of Latin letters are merged by rank in whole batches with NumPy; any other word is left to the library itself.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import numpy as np

_LONGEST = 40  # bytes of a word merged here
_NONE = np.int32(2**31 - 1)
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())  # a run of these at a word's end is a piece of its own
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class PairRanks:
    """Rank of a pair of ids by two probes; what collides in the first table lies in the second."""

    def __init__(self, left: np.ndarray, right: np.ndarray) -> None:
        keys, ranks = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64), np.arange(len(left), dtype=np.int32)
        self.tables = []
        for bits in (19, 20):
            for seed in range(1, 200):
                factor = np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) % 2**64)
                slot = (keys * factor) >> np.uint64(64 - bits)
                _, first = np.unique(slot, return_index=True)
                if bits == 19 or len(first) == len(keys):
                    break
            at, rank = np.full(1 << bits, np.uint64(2**64 - 1)), np.full(1 << bits, _NONE)
            at[slot[first]], rank[slot[first]] = keys[first], ranks[first]
            self.tables.append((factor, np.uint64(64 - bits), at, rank))
            left_over = np.ones(len(keys), bool)
            left_over[first] = False
            keys, ranks = keys[left_over], ranks[left_over]
        if len(keys):
            raise ValueError("pairs can't be placed in two tables")

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        found = np.full(key.shape, _NONE)
        for factor, shift, at, rank in self.tables:
            slot = (key * factor) >> shift
            hit = at[slot] == key
            found[hit] = rank[slot[hit]]
        return found


class WordTokenizer:
    def __init__(self, path: str, most_words: int = 700_000) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        vocabulary = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        letters, end = _byte_letters(), spec["model"]["end_of_word_suffix"]
        self.inner = np.array([vocabulary[c] for c in letters], np.int32)
        self.last = np.array([vocabulary[c + end] for c in letters], np.int32)
        self.rank = PairRanks(np.array([vocabulary[a] for a, _ in merges]), np.array([vocabulary[b] for _, b in merges]))
        self.merged = np.array([vocabulary[a + b] for a, b in merges], np.int32)
        self.vocabulary_size = self.library.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.vocabulary_size <= 65536 else "<u4")
        self.most_words = most_words
        self.known: dict[bytes, bytes] = {}

    def _plain(self, word: bytes) -> bytes | None:
        """The word as its merges see it if it is one piece of Latin letters, else None."""
        if word.isalpha():  # ASCII only
            return word.lower() if len(word) <= _LONGEST else None
        if word.isascii() or len(word) > _LONGEST:
            return None
        text = unicodedata.normalize("NFC", word.decode())
        return text.lower().encode() if _LATIN.fullmatch(text) else None

    def _merge(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids as bytes: in every round each word's pair of lowest rank is merged, the leftmost first."""
        out: list[bytes] = [b""] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for at in range(0, len(order), 16384):
            part = order[at : at + 16384]
            sizes = np.array([len(words[i]) for i in part])
            width = int(sizes[-1])
            raw = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in part), np.uint8).reshape(len(part), width)
            ids = self.inner[raw]
            ids[np.arange(len(part)), sizes - 1] = self.last[raw[np.arange(len(part)), sizes - 1]]
            column = np.arange(width)
            rank = np.full((len(part), width), _NONE)
            if width > 1:
                rank[:, :-1] = self.rank(ids[:, :-1], ids[:, 1:])
            rank[column[None, :] >= sizes[:, None] - 1] = _NONE
            left = np.array(part)
            while True:
                j = rank.argmin(1)
                rows = np.arange(len(left))
                best = rank[rows, j]
                over = best == _NONE
                if over.any():
                    for i, row, n in zip(left[over], ids[over].astype(self.dtype), sizes[over]):
                        out[i] = row[:n].tobytes()
                    keep = ~over
                    left, ids, rank, sizes, j, best = left[keep], ids[keep], rank[keep], sizes[keep], j[keep], best[keep]
                    if not len(left):
                        break
                    rows = np.arange(len(left))
                width = ids.shape[1]
                column = np.arange(width)
                source = np.minimum(column[None, :] + (column[None, :] > j[:, None]), width - 1)
                ids = np.take_along_axis(ids, source, 1)
                rank = np.take_along_axis(rank, source, 1)
                ids[rows, j] = self.merged[best]
                sizes = sizes - 1
                has = j + 1 < sizes
                rank[rows, j] = _NONE
                rank[rows[has], j[has]] = self.rank(ids[rows[has], j[has]], ids[rows[has], j[has] + 1])
                has = j > 0
                rank[rows[has], j[has] - 1] = self.rank(ids[rows[has], j[has] - 1], ids[rows[has], j[has]])
                rank[:, -1] = _NONE
        return out

    def _library(self, word: bytes) -> bytes:
        return np.array(self.library.encode(word.decode(), add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn(self, words: set[bytes]) -> None:
        known, stems, joined = self.known, {}, []
        for word in words:
            stem = word.rstrip(_PUNCTUATION)
            plain = self._plain(stem) if stem else None
            if plain is None:
                known[word] = self._library(word)
                continue
            tail = word[len(stem) :]
            if tail and tail not in known:
                known[tail] = self._library(tail)
            stems[plain] = None
            joined.append((word, plain, tail))
        new = [s for s in stems if s not in known]
        known.update(zip(new, self._merge(new)))
        for word, plain, tail in joined:
            known[word] = known[plain] + known[tail] if tail else known[plain]

    def encode(self, documents: list[bytes]) -> list[bytes]:
        """Ids of UTF-8 documents, little-endian, of self.dtype."""
        if len(self.known) > self.most_words:
            self.known = {}
        split = [d.split() for d in documents]
        fresh: set[bytes] = set().union(*split) if split else set()
        fresh -= self.known.keys()
        if fresh:
            self._learn(fresh)
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]


@functools.lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
