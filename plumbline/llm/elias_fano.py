"""Elias-Fano sequences and a level of the n-gram trie made of them, over memory-mapped bytes."""

from __future__ import annotations

import struct

import numpy as np

#: Elements that are decoded at a time while a sorted batch is searched.
CHUNK = 1 << 16


def _bit_packed(values: np.ndarray, width: int) -> bytes:
    if not width or not len(values):
        return b""
    raw = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, : -(-width // 8)]
    return np.packbits(np.unpackbits(raw, axis=1, count=width, bitorder="little").ravel(), bitorder="little").tobytes()


def _bit_unpacked(raw: np.ndarray, n: int, width: int) -> np.ndarray:
    """The ``n`` values that were packed."""
    if width > 56:  # with its offset a value may lie in nine bytes
        padded = np.zeros((n, 64), np.uint8)
        padded[:, :width] = np.unpackbits(raw, bitorder="little", count=n * width).reshape(n, width)
        return np.packbits(padded, axis=1, bitorder="little").view("<u8").ravel()
    at = np.arange(n, dtype=np.int64) * width
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate((raw, np.zeros(8, np.uint8))), 8)
    return eight[at >> 3].view("<u8").ravel() >> (at & 7).astype(np.uint64) & np.uint64((1 << width) - 1)


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary, and a count for each CHUNK of elements."""

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        v = np.asarray(values, np.uint64)
        n, last = len(v), int(v[-1]) if len(v) else 0
        low = max(0, (last // max(1, n)).bit_length() - 1)
        lows = b"".join(
            _bit_packed(v[i : i + CHUNK] & np.uint64((1 << low) - 1), low).ljust(-(-min(CHUNK, n - i) * low // 8), b"\0")
            for i in range(0, n, CHUNK))
        at = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(at[-1]) + 8) // 8 * 8 if n else 0, np.uint8)
        bits[at] = 1
        high = np.packbits(bits, bitorder="little")
        marks = at[::CHUNK].astype("<u8").tobytes()  # where each chunk's unary code begins
        head = struct.pack("<5Q", n, low, len(lows), len(high), len(marks))
        return head + marks + lows + high.tobytes()

    def __init__(self, memory: memoryview, at: int) -> None:
        self.n, self.low, n_low, n_high, n_marks = struct.unpack_from("<5Q", memory, at)
        at += 40
        self.marks = np.frombuffer(memory, "<u8", n_marks // 8, at)
        self.lows = np.frombuffer(memory, np.uint8, n_low, at + n_marks)
        self.high = np.frombuffer(memory, np.uint8, n_high, at + n_marks + n_low)
        self.end = at + n_marks + n_low + n_high

    def chunk(self, k: int) -> np.ndarray:
        """Elements k * CHUNK and on, decoded."""
        size = min(CHUNK, self.n - k * CHUNK)
        first = int(self.marks[k])
        stop = int(self.marks[k + 1]) if k + 1 < len(self.marks) else len(self.high) * 8
        bits = np.unpackbits(self.high[first >> 3 : (stop + 7) >> 3], bitorder="little")
        ones = np.flatnonzero(bits[first & 7 :].view(bool))[:size] + first
        out = (ones - np.arange(size) - k * CHUNK).astype(np.uint64) << np.uint64(self.low)
        if self.low:
            per = CHUNK * self.low // 8
            out |= _bit_unpacked(self.lows[k * per : k * per + -(-size * self.low // 8)], size, self.low)
        return out

    def values(self) -> np.ndarray:
        parts = [self.chunk(k) for k in range(len(self.marks))]
        return np.concatenate(parts) if parts else np.empty(0, np.uint64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """For sorted ``keys``, the place of each if it is there, else -1.

        The successor (least element not below the key) is searched, chunk by chunk of those
        that the keys reach.
        """
        out = np.full(len(keys), -1, np.int64)
        done = 0
        for k in range(len(self.marks)):
            if done == len(keys):
                break
            values = self.chunk(k)
            upto = int(np.searchsorted(keys, values[-1], side="right"))
            if upto > done:
                part = keys[done:upto]
                place = np.searchsorted(values, part)
                out[done:upto] = np.where(values[place] == part, place + k * CHUNK, -1)
                done = upto
        return out


def quantised(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """16-bit codes up to 65534, and the value of code 0 and of a step."""
    lo, hi = (float(x.min()), float(x.max())) if len(x) else (0.0, 0.0)
    step = (hi - lo) / 65534 or 1.0
    return np.round((x - lo) / step).astype("<u2"), lo, step


class Trie:
    """Words, contexts and successors of one shard and level; a context is a word, or a pair with a number of its own.

    words       Elias-Fano, the sorted 64-bit numbers of words and contexts; a word's id is its place
    contexts    Elias-Fano, ids of the words that have successors; quantised back-off weights
    pointers    Elias-Fano, the first successor of each context, and the end
    successors  Elias-Fano, context rank * words + successor id, so that ids are relative to the
                context and the whole is monotone; quantised log10 probabilities
    """

    @staticmethod
    def encode(words: np.ndarray, first: np.ndarray, second: np.ndarray, log_p: np.ndarray, context_ids: np.ndarray, backoff: np.ndarray) -> bytes:
        """From pairs of word ids in order, and the contexts of them in order."""
        rank = np.searchsorted(context_ids, first)
        pointers = np.concatenate(([0], np.cumsum(np.bincount(rank, minlength=len(context_ids)))))
        relative = rank.astype(np.uint64) * np.uint64(max(1, len(words))) + second.astype(np.uint64)
        p, p0, p1 = quantised(log_p)
        b, b0, b1 = quantised(backoff)
        parts = [EliasFano.encode(x) for x in (words, context_ids, pointers, relative)]
        head = struct.pack("<2Q4d", len(context_ids), len(log_p), p0, p1, b0, b1)
        return head + b"".join(parts) + b.tobytes() + p.tobytes()

    def __init__(self, memory: memoryview) -> None:
        n_context, n_pair, *self.scale = struct.unpack_from("<2Q4d", memory, 0)
        at, levels = 48, []
        for _ in range(4):
            levels.append(EliasFano(memory, at))
            at = levels[-1].end
        self.words, self.contexts, self.pointers, self.successors = levels
        self.backoff = np.frombuffer(memory, "<u2", n_context, at)
        self.codes = np.frombuffer(memory, "<u2", n_pair, at + 2 * n_context)

    def _backoffs(self, rank: np.ndarray) -> np.ndarray:
        _, _, b0, b1 = self.scale
        return np.where(rank >= 0, b0 + b1 * self.backoff[np.maximum(rank, 0)] if len(self.backoff) else 0.0, 0.0)

    def places(self, numbers: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs, in order, of places in the sorted distinct ``numbers``: each one's place in ``codes`` and its context's rank, -1 for none.

        Words, contexts and successors are in order too, so each sequence is gone through once.
        """
        ids = self.words.find(numbers)
        ranks = np.full(len(numbers), -1, np.int64)
        ranks[ids >= 0] = self.contexts.find(ids[ids >= 0].astype(np.uint64))
        rank, two = ranks[first], ids[second]
        known = np.flatnonzero((rank >= 0) & (two >= 0))
        at = rank[known]
        found = self.successors.find(at.astype(np.uint64) * np.uint64(max(1, self.words.n)) + two[known].astype(np.uint64))
        ends = self.pointers.values().astype(np.int64)
        out = np.full(len(first), -1, np.int64)
        out[known] = np.where((found >= ends[at]) & (found < ends[at + 1]), found, -1)  # of this context
        return out, rank

    def score(self, first: np.ndarray, second: np.ndarray, log_second: np.ndarray) -> np.ndarray:
        """What is kept of each pair, log10, else the context's weight times the second's own; numbers, and log10 of the own."""
        p0, p1, *_ = self.scale
        numbers, inverse = np.unique(np.concatenate((first, second)), return_inverse=True)
        one, two = inverse[: len(first)], inverse[len(first) :]
        order = np.lexsort((two, one))
        place, rank = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        place[order], rank[order] = self.places(numbers, one[order], two[order])
        out = self._backoffs(rank) + log_second
        out[place >= 0] = p0 + p1 * self.codes[place[place >= 0]]
        return out
