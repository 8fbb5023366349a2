"""Texts cut into units that a byte-level tokenizer treats independently, each distinct one encoded once.

A single space between two characters that aren't white space always starts a new pre-token. So a text falls into units at
those spaces, and the ids of the text are those of its units, one after another. Arrow cuts whole pieces of text and
numbers their distinct units; only these are looked up and, if new, encoded.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Where the C library has it.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)

#: The lists that many keys have: all numbers together, and how many each key has.
Lists = tuple[np.ndarray, np.ndarray]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 2_000_000, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text: long ones are cut, short ones put together. A longer text is alone."""
    wait: list[pa.RecordBatch] = []
    have = count = 0
    for batch in batches:
        ends, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            stop = min(max(at + 1, int(np.searchsorted(ends, done + most - have, side="right"))), at + rows - count, batch.num_rows)
            wait.append(batch.slice(at, stop - at))
            have, count, at = have + int(ends[stop - 1]) - done, count + stop - at, stop
            if have >= most or count >= rows or at < batch.num_rows:
                yield _together(wait)
                wait, have, count = [], 0, 0
    if wait:
        yield _together(wait)
    release()


def release() -> None:
    """Give memory that a task has freed back to the system: the worker waits for its next task with little."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def _together(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


class _Numbers(dict):
    """Numbers its keys as they are first asked for; new: those not learnt yet."""

    def __init__(self, keys: Sequence[str] = ()):
        super().__init__(zip(keys, range(len(keys)), strict=True))
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class Memo:
    """Lists of numbers for strings, each made by `many`.

    Beyond `most` strings or `size` bytes of strings and numbers, only the `left` most used of those that were used more
    than once are kept. So a worker's memory has a bound, whatever the texts.
    """

    def __init__(self, many: Callable[[list[str]], Lists], most: int = 150_000, size: int = 12_000_000, left: int = 60_000):
        self.many, self.most, self.size, self.left = many, most, size, left
        self.at, self.bytes = _Numbers(), 0
        self.ids, self.start, self.n, self.used = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, keys: Sequence[str]) -> np.ndarray:
        """The numbers of keys, each of which counts as used once."""
        got = np.fromiter(map(self.at.__getitem__, keys), np.int64, len(keys))
        if self.at.new:
            self._learn()
        self.used += np.bincount(got, minlength=len(self.used))
        return got

    def _learn(self) -> None:
        flat, n = self.many(self.at.new)
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(n) - n])
        self.n = np.concatenate([self.n, n])
        self.ids = np.concatenate([self.ids, flat.astype(np.int32)])
        self.used = np.concatenate([self.used, np.zeros(len(n), np.int64)])
        self.bytes += 4 * len(flat) + sum(map(len, self.at.new))
        self.at.new = []

    def trim(self, always: bool = False) -> np.ndarray | None:
        """Forget the less used if there are too many (or always, to `left` of them). The numbers of those that stay, if any went."""
        if not always and len(self.at) <= self.most and self.bytes <= self.size or always and len(self.at) <= self.left and self.bytes <= self.size // 2:
            return None
        often = np.flatnonzero(self.used > 1)
        stay = np.sort(often[np.argsort(-self.used[often], kind="stable")[: self.left]])
        keys = list(self.at)
        keys = [keys[i] for i in stay.tolist()]
        cost = np.cumsum(4 * self.n[stay] + np.fromiter(map(len, keys), np.int64, len(keys)))
        stay = stay[: int(np.searchsorted(cost, self.size // 2))]
        self.ids, self.n = gather(stay, self.ids, self.start, self.n)
        self.start, self.used = np.cumsum(self.n) - self.n, self.used[stay] // 2
        self.at, self.bytes = _Numbers(keys[: len(stay)]), int(cost[len(stay) - 1]) if len(stay) else 0
        return stay


def gather(at: np.ndarray, ids: np.ndarray, start: np.ndarray, n: np.ndarray) -> Lists:
    """The lists of numbered keys, one after another, and their lengths."""
    n = n[at]
    ends = np.cumsum(n)
    where = np.repeat(start[at] - (ends - n), n)
    where += np.arange(int(ends[-1]) if len(ends) else 0)
    return ids[where], n


def lists(of: Sequence[Sequence[int]]) -> Lists:
    n = np.fromiter(map(len, of), np.int64, len(of))
    return np.fromiter(chain.from_iterable(of), np.int64, int(n.sum())), n


def bounds(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each string the first and the last byte (0: it is empty), and whether it is empty."""
    at = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1]
    flat = np.frombuffer(strings.buffers()[2] or b"", np.uint8)
    flat = np.append(flat[: at[-1]], np.uint8(0)) if len(at) else np.zeros(1, np.uint8)
    empty = at[1:] == at[:-1]
    return np.where(empty, 0, flat[at[:-1]]), np.where(empty, 0, flat[at[1:] - 1]), empty


def _odd(names: list[str], coded: pa.Array) -> np.ndarray:
    """Which parts between spaces aren't units: empty ones, and those with other white space next to a space."""
    first, last, odd = bounds(coded)
    clear = (first > 32) & (first < 127) & (last > 32) & (last < 127)
    for k in np.flatnonzero(~clear & ~odd).tolist():
        odd[k] = names[k][0].isspace() or names[k][-1].isspace()
    return odd


class UnitEncoder:
    """after_space: the ids of units that each stand after a space and hold none; alone: those of texts as they are."""

    def __init__(self, after_space: Callable[[list[str]], Lists], alone: Callable[[list[str]], Lists], most: int = 150_000, left: int = 60_000):
        self.spaced, self.alone = Memo(after_space, most, 80 * most, left), Memo(alone, 50_000, 8_000_000, 10_000)

    def trim(self, always: bool = False) -> None:
        self.spaced.trim(always)
        self.alone.trim(always)

    def __call__(self, texts: pa.Array) -> Lists:
        """The ids of all texts together, and how many each text has; a null text is empty."""
        self.trim()
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        parts = pc.split_pattern(pc.fill_null(texts, ""), " ")
        first = parts.offsets.to_numpy()
        first, n, flat = first[:-1] - first[0], np.diff(first), parts.flatten()
        coded = flat.dictionary_encode()
        at, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        odd = _odd(names, coded.dictionary)
        number = np.zeros(len(names), np.int64)
        number[~odd] = self.spaced.find(names if not odd.any() else [x for x, o in zip(names, odd, strict=True) if not o])
        units = number[at]
        begins = flat.take(pa.array(first)).to_numpy(zero_copy_only=False).tolist()
        units[first] = ~self.alone.find(begins)  # negative numbers are those of `alone`
        bad = odd[at]
        bad[first] = [not x or x[-1].isspace() for x in begins]
        bad[first[n == 1]] = False  # a text without a space is one unit
        if bad.any():
            cut, last, which = [], 0, np.flatnonzero(np.add.reduceat(bad, first))
            for k, text in zip(which.tolist(), texts.take(pa.array(which)).to_pylist(), strict=True):
                # cut with care: only single spaces between what isn't white space
                own = ~self.alone.find([" " * (i > 0) + x for i, x in enumerate(_CUT.split(text or ""))])
                cut += [units[last : first[k]], own]
                last, n[k] = first[k] + n[k], len(own)
            units = np.concatenate([*cut, units[last:]])
        s, a = self.spaced, self.alone
        units = np.where(units < 0, len(s.n) + ~units, units)
        ids, size = gather(units, np.concatenate([s.ids, a.ids]), np.concatenate([s.start, a.start + len(s.ids)]), np.concatenate([s.n, a.n]))
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum(n)]
        return ids, np.diff(np.concatenate([[0], ends]))


def spell(table: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ids, and how many each has; table: all ids' bytes, where each starts, how long it is."""
    flat, start, size = table
    n = size[ids]
    ends = np.cumsum(n)
    where = np.repeat(start[ids] - (ends - n), n)
    where += np.arange(int(ends[-1]) if len(ends) else 0)
    return flat[where], n


def spelling(words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size
