"""Elias-Fano levels of an n-gram trie: compact, written to files, read from the mapped bits.

A sequence of rising numbers is kept as packed low bits and unary high bits. The high bits have a
directory, the number of ones before each 64-bit word; a place is found by a search in it and six
halvings inside one word, so nothing is unpacked when a level is opened. Level 1 holds the words (their
hashes) and running totals of their counts. Level 2 holds the contexts, pointers to their successors,
the successors relative to their context, and one quantised probability each.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow.fs as pafs

#: log10 probabilities are kept in codes 1 to 255, from ``LOWEST`` up to 0; code 0 stands for absent.
LOWEST = -12.0
_STEP = -LOWEST / 254
_PACKED_AT_ONCE = 1 << 16


def quantise(log10: np.ndarray) -> np.ndarray:
    return (1 + np.rint((np.clip(log10, LOWEST, 0) - LOWEST) / _STEP)).astype(np.uint8)


def restored(codes: np.ndarray) -> np.ndarray:
    """The probabilities of codes; 0 for absent ones."""
    return np.where(codes > 0, 10 ** (LOWEST + (codes.astype(float) - 1) * _STEP), 0.0)


# Files of named arrays.


def write_arrays(path: str, arrays: dict[str, np.ndarray], facts: dict) -> None:
    """Write a file that :func:`open_arrays` maps; it appears under its name only once it is whole."""
    at, places = 0, {}
    for name, array in arrays.items():
        places[name] = (at, array.dtype.str, len(array))
        at += -(-array.nbytes // 8) * 8
    head = json.dumps({"arrays": places, "facts": facts}).encode()
    head += b" " * (-len(head) % 8)
    system, name = pafs.FileSystem.from_uri(path)
    part = f"{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(part, compression=None) as out:
        out.write(len(head).to_bytes(8, "little") + head)
        for array in arrays.values():
            out.write(array.tobytes() + bytes(-array.nbytes % 8))
    system.move(part, name)


def open_arrays(path: str) -> tuple[dict[str, np.ndarray], dict] | None:
    """The arrays of a file, mapped where it is a local path; None if there is no such file."""
    system, name = pafs.FileSystem.from_uri(path)
    if system.get_file_info(name).type == pafs.FileType.NotFound:
        return None
    if isinstance(system, pafs.LocalFileSystem):
        raw = np.memmap(name, np.uint8, "r")
    else:
        with system.open_input_file(name) as file:
            raw = np.frombuffer(file.read(), np.uint8)
    size = int(raw[:8].view(np.int64)[0])
    head = json.loads(raw[8 : 8 + size].tobytes())
    start, found = 8 + size, {}
    for key, (at, kind, n) in head["arrays"].items():
        found[key] = raw[start + at : start + at + n * np.dtype(kind).itemsize].view(kind)
    return found, head["facts"]


# Bits.


def _nth_one(words: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """The place of the nth (from 0) set bit of each word."""
    place = np.zeros(len(words), np.uint64)
    left = nth.astype(np.uint64)
    for step in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count(words >> place & np.uint64((1 << step) - 1)).astype(np.uint64)
        further = low <= left
        left -= np.where(further, low, np.uint64(0))
        place += np.where(further, np.uint64(step), np.uint64(0))
    return place.astype(np.int64)


class EliasFano:
    """Numbers that never fall, below 2^64."""

    def __init__(self, size: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.size, self.low_bits, self.low, self.high, self.ones = size, low_bits, low, high, ones
        self.zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones
        self.buckets = len(high) * 64 - size

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        parts = values.astype(np.uint64)
        largest = int(parts[-1]) if n else 0
        low_bits = max(0, (largest // max(n, 1)).bit_length() - 1)
        places = np.arange(low_bits, dtype=np.uint64)
        packed = [
            np.packbits(
                (parts[a : a + _PACKED_AT_ONCE, None] >> places & np.uint64(1)).astype(np.uint8).ravel(),
                bitorder="little",
            )
            for a in range(0, n, _PACKED_AT_ONCE)
        ]
        low = np.concatenate([*packed, np.zeros(9, np.uint8)])
        # One zero ends each bucket, and at least one more follows the last value.
        at = (parts >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        words = ((largest >> low_bits) + n + 1) // 64 + 1
        high = np.zeros(words, np.uint64)
        np.bitwise_or.at(high, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        counts = np.bitwise_count(high).astype(np.int64)
        return cls(n, low_bits, low, high, np.cumsum(counts) - counts)

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.ones": self.ones}

    @classmethod
    def open(cls, name: str, arrays: dict, facts: dict) -> EliasFano:
        return cls(*facts[name], *[arrays[f"{name}.{x}"] for x in ("low", "high", "ones")])

    def facts(self) -> tuple[int, int]:
        return self.size, self.low_bits

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), np.uint64)
        bit = at * self.low_bits
        byte, shift = bit >> 3, (bit & 7).astype(np.uint64)
        word = np.zeros(len(at), np.uint64)
        for k in range(8):
            word |= self.low[byte + k].astype(np.uint64) << np.uint64(8 * k)
        word >>= shift
        if self.low_bits > 56:
            over = self.low[byte + 8].astype(np.uint64)
            word |= np.where(shift > 0, over << (np.uint64(64) - shift) % np.uint64(64), np.uint64(0))
        return word & np.uint64((1 << self.low_bits) - 1)

    def at(self, places: np.ndarray) -> np.ndarray:
        """The numbers at the given places."""
        word = np.searchsorted(self.ones, places, "right") - 1
        bit = (word << 6) + _nth_one(self.high[word], places - self.ones[word])
        return (bit - places).astype(np.uint64) << np.uint64(self.low_bits) | self._low(places)

    def _starts(self, bucket: np.ndarray) -> np.ndarray:
        """How many numbers have a high part below ``bucket``."""
        nth = np.maximum(bucket - 1, 0)
        word = np.searchsorted(self.zeros, nth, "right") - 1
        bit = (word << 6) + _nth_one(~self.high[word], nth - self.zeros[word])
        return np.where(bucket > 0, bit - nth, 0)

    def find(self, values: np.ndarray, first=None, end=None) -> np.ndarray:
        """The place of each value between the places ``first`` and ``end``, -1 where it is absent.

        A successor search: the high part gives a run of places, the low parts in it are halved.
        """
        values = values.astype(np.uint64)
        high = values >> np.uint64(self.low_bits)
        low = values & np.uint64((1 << self.low_bits) - 1)
        inside = high < np.uint64(self.buckets)
        bucket = np.where(inside, high, 0).astype(np.int64)
        left = self._starts(bucket)
        right = np.where(inside, np.minimum(self._starts(np.minimum(bucket + 1, self.buckets)), self.size), 0)
        if first is not None:
            left, right = np.maximum(left, first), np.minimum(right, end)
        stop = right.copy()
        while True:
            open_ = np.flatnonzero(left < right)
            if not len(open_):
                break
            middle = (left[open_] + right[open_]) >> 1
            smaller = self._low(middle) < low[open_]
            left[open_] = np.where(smaller, middle + 1, left[open_])
            right[open_] = np.where(smaller, right[open_], middle)
        found = np.flatnonzero(left < stop)
        found = found[self._low(left[found]) == low[found]]
        place = np.full(len(values), -1)
        place[found] = left[found]
        return place


# Levels.


class Unigrams:
    """The words of a shard and their exact counts."""

    def __init__(self, words: EliasFano, totals: EliasFano):
        self.words, self.totals = words, totals

    @staticmethod
    def write(path: str, words: np.ndarray, counts: np.ndarray) -> None:
        """Sorted words (64-bit hashes) and their counts."""
        levels = {
            "words": EliasFano.of(words),
            "totals": EliasFano.of(np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])),
        }
        write_arrays(
            path,
            {k: v for name, level in levels.items() for k, v in level.arrays(name).items()},
            {name: level.facts() for name, level in levels.items()},
        )

    @classmethod
    def open(cls, path: str) -> Unigrams:
        found = open_arrays(path)
        if found is None:
            return cls(*[EliasFano.of(np.zeros(n, np.uint64)) for n in (0, 1)])
        return cls(*[EliasFano.open(name, *found) for name in ("words", "totals")])

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each word in the shard (-1: not there) and its count."""
        rank = self.words.find(words)
        counts = np.zeros(len(words), np.int64)
        there = np.flatnonzero(rank >= 0)
        ends = self.totals.at(rank[there] + 1) - self.totals.at(rank[there])
        counts[there] = ends.astype(np.int64)
        return rank, counts


class Bigrams:
    """Contexts, pointers to their successors, successors relative to their context, and codes."""

    LEVELS = ("contexts", "pointers", "successors")

    def __init__(self, levels: list[EliasFano], words: int, codes: np.ndarray):
        (self.contexts, self.pointers, self.successors), self.words, self.codes = levels, words, codes

    @classmethod
    def write(cls, path: str, context: np.ndarray, word: np.ndarray, log10: np.ndarray) -> None:
        """Bigrams sorted by context and word, with the log10 of their probabilities."""
        contexts, rank, count = np.unique(context, return_inverse=True, return_counts=True)
        words = int(word.max()) + 1 if len(word) else 1
        levels = dict(
            zip(
                cls.LEVELS,
                map(
                    EliasFano.of,
                    (contexts, np.concatenate([np.zeros(1, np.int64), np.cumsum(count)]), rank * words + word),
                ),
            )
        )
        arrays = {k: v for name, level in levels.items() for k, v in level.arrays(name).items()}
        facts = {name: level.facts() for name, level in levels.items()}
        write_arrays(path, arrays | {"codes": quantise(log10)}, facts | {"n_words": words})

    @classmethod
    def open(cls, path: str) -> Bigrams:
        found = open_arrays(path)
        if found is None:
            empty = [EliasFano.of(np.zeros(n, np.uint64)) for n in (0, 1, 0)]
            return cls(empty, 1, np.zeros(0, np.uint8))
        arrays, facts = found
        levels = [EliasFano.open(name, arrays, facts) for name in cls.LEVELS]
        return cls(levels, facts["n_words"], arrays["codes"])

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The code of each bigram, 0 where the trie has none."""
        rank = self.contexts.find(context)
        ok = np.flatnonzero((rank >= 0) & (word >= 0) & (word < self.words))
        rank = rank[ok]
        ends = [self.pointers.at(rank + k).astype(np.int64) for k in (0, 1)]
        place = self.successors.find(rank * self.words + word[ok], *ends)
        codes = np.zeros(len(context), np.uint8)
        there = place >= 0
        codes[ok[there]] = self.codes[place[there]]
        return codes
