"""Byte-level BPE encoding and decoding by ranks.

Pre-tokens that are in the vocabulary are resolved by a minimal perfect hash; the others are merged by a heap of pairs
over a linked list of their bytes: the lowest rank first, the leftmost of equal ones.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramo.llm.units import Lists, UnitEncoder, lists, pieces, spell, spelling


class PerfectHash:
    """Gives each of n keys a slot of its own from 0 to n - 1, and -1 to any other string.

    Keys are thrown into buckets; from the largest bucket on, each gets the first displacement that takes its keys to free
    slots. A bucket with one key points to a free slot directly (a negative displacement).
    """

    def __init__(self, keys: Sequence[bytes], per_bucket: int = 2):
        n = self.n = len(keys)
        self.buckets = max(1, n // per_bucket)
        bucket, a, b = self._hashes(keys)
        self.move = np.zeros(self.buckets, np.int64)
        slot_of = np.full(n, -1, np.int64)
        taken = np.zeros(n, bool)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        groups = sorted((order[bounds[k] : bounds[k + 1]] for k in range(self.buckets)), key=lambda g: -len(g))
        for g in groups:
            if len(g) < 2:
                break
            d = 0
            while True:
                tries = self._slots(a[g], b[g], np.arange(d, d + 32)[:, None])
                fits = ~taken[tries].any(axis=1) & (np.diff(np.sort(tries, axis=1), axis=1) > 0).all(axis=1)
                if fits.any():
                    break
                d += 32
            d += int(fits.argmax())
            slots = tries[fits.argmax()]
            taken[slots] = True
            slot_of[g] = slots
            self.move[bucket[g[0]]] = d
        free = iter(np.flatnonzero(~taken).tolist())
        for g in groups:
            if len(g) == 1:
                slot_of[g[0]] = s = next(free)
                self.move[bucket[g[0]]] = -1 - s
        self.key_at: list[bytes] = [b""] * n
        self.value_at = np.empty(n, np.int64)
        for k, s in enumerate(slot_of.tolist()):
            self.key_at[s] = keys[k]
            self.value_at[s] = k

    def _hashes(self, keys: Sequence[bytes]) -> tuple[np.ndarray, ...]:
        h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<u8").reshape(-1, 2)
        return ((h[:, 0] >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64), h[:, 0], h[:, 1] | np.uint64(1)

    def _slots(self, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
        x = a + b * d.astype(np.uint64)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x9E3779B97F4A7C15)
        return ((x >> np.uint64(32)) % np.uint64(self.n)).astype(np.int64)

    def find(self, keys: Sequence[bytes]) -> np.ndarray:
        """For each key its place among the keys given first, or -1."""
        if not len(keys) or not self.n:
            return np.full(len(keys), -1, np.int64)
        bucket, a, b = self._hashes(keys)
        d = self.move[bucket]
        slots = np.where(d < 0, -1 - d, self._slots(a, b, np.maximum(d, 0)))
        return np.fromiter((v if self.key_at[s] == k else -1 for k, s, v in zip(keys, slots.tolist(), self.value_at[slots].tolist(), strict=True)), np.int64, len(keys))


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token that isn't in the vocabulary."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    end = list(range(1, n + 1))  # of the part that starts here
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or (j := end[i]) >= n or end[j] != stop:
            continue  # one of the two parts has changed since
        alive[j] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (k := before[i]) >= 0 and (r := ranks.get(piece[k:stop])) is not None:
            heapq.heappush(heap, (r, k, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Bpe:
    def __init__(self, vocabulary: Sequence[bytes], pattern: str):
        self.vocabulary, self.pattern = list(vocabulary), pattern
        self.hash = PerfectHash(self.vocabulary)
        self._ready = None

    @classmethod
    def from_file(cls, path: str, pattern: str) -> Bpe:
        """path: lines of a base64 token and its rank, the ranks from 0 without gaps."""
        with open(path, "rb") as f:
            ranks = {int(r): base64.b64decode(t) for t, r in map(bytes.split, f)}
        return cls([ranks[k] for k in range(len(ranks))], pattern)

    def __getstate__(self):
        return {"vocabulary": self.vocabulary, "pattern": self.pattern, "hash": self.hash, "_ready": None}

    def _prepare(self):
        if self._ready is None:
            self.ranks = {t: k for k, t in enumerate(self.vocabulary)}
            self.cut = regex.compile(self.pattern)
            self.bytes_of = spelling(self.vocabulary)
            self.digits_of = spelling([b"%d," % k for k in range(len(self.vocabulary))])
            self._ready = UnitEncoder(self.after_space, lambda texts: lists(self.encode_many(texts)))
        return self._ready

    def _ids(self, pre_tokens: list[bytes]) -> list[list[int]]:
        """Two tiers over the distinct pre-tokens."""
        new = list(dict.fromkeys(pre_tokens))
        known = self.hash.find(new).tolist()
        ids = {p: [k] if k >= 0 else merge(p, self.ranks) for p, k in zip(new, known, strict=True)}
        return [ids[p] for p in pre_tokens]

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        self._prepare()
        cut = [[p.encode() for p in self.cut.findall(t)] for t in texts]
        ids = iter(self._ids([p for c in cut for p in c]))
        return [[i for _ in c for i in next(ids)] for c in cut]

    def after_space(self, units: list[str]) -> Lists:
        """Ids of units that each stand after a space and hold none: cut together, since each space starts a pre-token."""
        self._prepare()
        pre = [p.encode() for k in range(0, len(units), 4096) for p in self.cut.findall(" " + " ".join(units[k : k + 4096]))]
        flat, n = lists(self._ids(pre))
        of = np.cumsum(np.fromiter((p[0] == 32 for p in pre), np.int64, len(pre))) - 1
        return flat, np.bincount(of, weights=n, minlength=len(units)).astype(np.int64)

    def encode(self, texts: Sequence[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self._prepare()(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))

    def forget(self) -> None:
        """Keep the most used units only, for the next task of the same worker."""
        self._prepare().trim(True)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, and how many each has."""
        self._prepare()
        return spell(self.bytes_of, ids)


_workers: dict[str, Bpe] = {}


def _own(bpe: Bpe, key: str) -> Bpe:
    """The worker's own copy, which keeps the most used units between tasks."""
    return _workers.setdefault(key, bpe)


def encode(docs: DataFrame, bpe: Bpe, text_col: str = "text") -> DataFrame:
    """docs with token_ids (array<int>) instead of the text; a null text is empty."""
    key = hashlib.md5(b"".join(bpe.vocabulary) + bpe.pattern.encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(bpe)  # the vocabulary: a fixed size
    rest = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _own(shared.value, key)
        for batch in pieces(batches, text_col):
            ids, n = own.encode(batch.column(text_col))
            tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], tokens], names=[*rest, "token_ids"])
        own.forget()

    kept = docs.select(*rest)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema], "token_ids array<int>"])
    return docs.select(*rest, F.col(text_col)).mapInArrow(run, schema)


def round_trip(docs: DataFrame, bpe: Bpe, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode whole texts: id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256."""
    key = hashlib.md5(b"".join(bpe.vocabulary) + bpe.pattern.encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(bpe)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _own(shared.value, key)
        for batch in pieces(batches):
            ids, n = own.encode(batch.column("text"))
            text, text_n = own.decode(ids)
            said, said_n = spell(own.digits_of, ids)
            ends = np.concatenate([[0], np.cumsum(n)])
            text_at, said_at = (np.concatenate([[0], np.cumsum(x)])[ends].tolist() for x in (text_n, said_n))
            text, said = memoryview(np.ascontiguousarray(text)), memoryview(np.ascontiguousarray(said))
            pairs = list(zip(range(len(n)), range(1, len(n) + 1), strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(n, pa.int64()),
                    pa.array([hashlib.sha256(said[said_at[a] : max(said_at[a], said_at[b] - 1)]).hexdigest() for a, b in pairs]),
                    pa.array([hashlib.sha256(text[text_at[a] : text_at[b]]).hexdigest() for a, b in pairs]),
                ],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        own.forget()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
