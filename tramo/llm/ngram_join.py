"""N-gram Jaccard join by parity sketches.

A document's set are its distinct k-word shingles. Two sets link when 100 * intersection >= percent * union, so their
symmetric difference is at most (n1 + n2) * (100 - percent) / (100 + percent). Sets are put into bands of sizes; in the
instance of a band, a set is cut into more segments than that difference can touch, and the XOR of its shingles' hashes in
a segment is the segment's sketch: linked sets have an equal one (pigeonhole). Each set meets its own band's instance and,
if it may link with a larger band's sets, the next one's.

Sets that share a sketch are compared with the first and the last of them; what links is joined to components. Only where
a sketch still has sets of several components are all pairs between these compared, in blocks of bounded size. Each
comparison starts with bit sketches, whose Hamming distance is never more than the symmetric difference; what passes is
verified on the texts. Between components, a block with many pairs has only the nearest ones verified that would join its
components. What that leaves open is compared by whole sets where they lie: keys that share sets are one group, and a block
gives only links that join its components. So no link between components is lost, and no group is written out as pairs.

Pages of one template share most sketches without being linked: a sketch of very many sets says little. Such sets are
replaced by how they differ from what most of them have. That leaves the difference of any two as it is, but makes the sets
small, and what pages have of their own rare: linked ones share one of their rarest members (a prefix of as many as they may
differ in, and one more), or both hardly differ from the common part. These are the keys that they meet by.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramo.llm import staging
from tramo.llm.components import components
from tramo.llm.exact_dedup import sha256, without
from tramo.llm.staging import drop_staged, small, stage
from tramo.llm.units import pieces

#: Sets of one sketch that are compared at once, at most about twice as many.
BLOCK = 512
#: Pairs for each row of a cell under which all of them are verified at once: never more than its rows.
PAIRS = 1
#: Shingles of sets that are compared at once by all of them, at most about twice as many (one set may have more).
WHOLE = 1 << 17
#: Counters of the sketch that finds frequent keys.
COUNTERS = 4096
#: Sets of one sketch beyond which its members are dealt out anew, by what they don't have in common.
HOT = 2048
#: One document in so many, by its id, shows which keys are frequent.
SHOWN = 8
#: Times that a set with too many empty segments is cut anew.
ROUNDS = 4
_U = np.uint64
_SKETCH = _U((1 << 55) - (1 << 16))
_ODD = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) | _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


@dataclass(frozen=True)
class Join:
    k: int = 5
    percent: int = 80
    #: Largest by smallest size in a band.
    width: float = 1.5

    def apart(self, total):
        """The largest symmetric difference of linked sets with so many members together."""
        return total * (100 - self.percent) // (100 + self.percent)

    def bands(self) -> dict[str, np.ndarray]:
        """By band: the first size, segments, empty segments allowed for, bits. Sizes to 2 ** 40.

        A band has one more segment than linked sets can differ in, and as many more as the smallest sets that come here
        will leave empty: so nearly all of them have enough segments with members.
        """
        low, out = 1, {"low": [], "segments": [], "empty": [], "bits": []}
        while low < 1 << 40:
            high = max(low, int(low * self.width))
            t, least = self.apart(2 * high), max(1, low * self.percent // 100)

            def enough(empty: int, t: int = t, least: int = least) -> bool:
                s = t + 1 + empty
                none = math.exp(-least / s)
                return empty >= s * none + 2 * math.sqrt(max(0.0, s * none * (1 - (1 + least / s) * none)))

            empty = 0
            while t and not enough(empty) and empty < t + 1:
                empty += max(1, empty // 16)
            out["low"].append(low)
            out["segments"].append(t + 1 + empty)
            out["empty"].append(empty)
            # unrelated sets differ in twice as many bits as linked ones may
            out["bits"].append(min(8192, max(256, -(-5 * t // 64) * 64)))
            low = high + 1
        return {k: np.array(v, np.int64) for k, v in out.items()}


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHash()


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased; split at ASCII white space (space and \\x09 to \\x0d)."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(text: str | None, k: int) -> set[tuple[bytes, ...]]:
    """The set itself: a text of fewer words is one shingle, one without words is none."""
    w = words(text)
    return {tuple(w)} if 0 < len(w) < k else {*zip(*(w[i:] for i in range(k)), strict=False)}


def hashed(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles' hashes of all texts and the text each belongs to, in order."""
    cut = [words(t) for t in texts]
    n = np.fromiter(map(len, cut), np.int64, len(cut))
    w = np.fromiter(map(_hashes.__getitem__, chain.from_iterable(cut)), np.uint64, int(n.sum()))
    first = np.cumsum(n) - n
    many = np.maximum(n - k + 1, 0)
    doc = np.repeat(np.arange(len(cut)), many)
    at = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        h += w[at + j] * _ODD[j]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        more = [(np.append(w[first[d] : first[d] + n[d]], _U(n[d])) * np.append(_ODD[: n[d]], _ODD[63])).sum(dtype=np.uint64) for d in short]
        h, doc = np.concatenate([h, np.array(more, np.uint64)]), np.concatenate([doc, short])
    h = mix(h)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], doc[keep]


def _xor_by(values: np.ndarray, group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    out, count = np.zeros(n, np.uint64), np.bincount(group, minlength=n)
    if len(values):
        order = np.argsort(group, kind="stable")
        at = np.flatnonzero(count)
        out[at] = np.bitwise_xor.reduceat(values[order], (np.cumsum(count) - count)[at])
    return out, count


def sketch_keys(h: np.ndarray, doc: np.ndarray, instance: np.ndarray, bands: dict[str, np.ndarray], rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The segment sketches of all sets in the given instances (-1: none) as keys, and how many each set has.

    A set with no more empty segments than its band allows for shares a segment that isn't empty with any set it links
    with. Sets with more are cut anew, in another way, and so on: two of them meet there. Only after the last round the
    empty segments of what is left (hardly any set) are keys too.
    """
    keys_of, owner_of, n = [], [], len(instance)
    left = np.flatnonzero(instance >= 0)
    for turn in range(rounds):
        place = np.full(n, -1)
        place[left] = np.arange(len(left))
        mine = place[doc] >= 0
        g, own = h[mine], place[doc[mine]]
        s = bands["segments"][instance[left]]
        base = np.cumsum(s) - s
        seed = _U(turn)
        segment = ((mix(g + seed * _ODD[60]) >> _U(24)) % s[own].astype(np.uint64)).astype(np.int64)
        keys, count = _xor_by(mix(g + seed + _U(1)), base[own] + segment, int(s.sum()))
        at = np.repeat(np.arange(len(left)), s)
        index = np.arange(int(s.sum())) - base[at]
        none = count == 0
        short = np.bincount(at[none], minlength=len(left)) > bands["empty"][instance[left]]
        keep = ~none | (short[at] if turn == rounds - 1 else False)
        where = ((instance[left][at].astype(np.uint64) * _U(rounds) + seed) << _U(40)) + index.astype(np.uint64)
        keys_of.append(mix(keys + mix(where))[keep])
        owner_of.append(left[at[keep]])
        left = left[short]
        if not len(left):
            break
    keys, owner = np.concatenate(keys_of), np.concatenate(owner_of)
    return keys[np.argsort(owner, kind="stable")].view(np.int64), np.bincount(owner, minlength=n)


def bit_sketches(h: np.ndarray, doc: np.ndarray, instance: np.ndarray, bands: dict[str, np.ndarray]) -> list[bytes | None]:
    use = instance >= 0
    b = np.where(use, bands["bits"][instance], 0)
    base = np.cumsum(b) - b
    mine = use[doc]
    at = base[doc[mine]] + (h[mine] % np.maximum(b[doc[mine]], 1).astype(np.uint64)).astype(np.int64)
    odd = np.packbits((np.bincount(at, minlength=int(b.sum())) & 1).astype(np.uint8)).tobytes()
    return [odd[i // 8 : (i + n) // 8] if n else None for i, n in zip(base.tolist(), b.tolist(), strict=True)]


def _instances(n: np.ndarray, bands: dict[str, np.ndarray], join: Join) -> tuple[np.ndarray, np.ndarray]:
    """The bands of sets of these sizes, and the next ones where they may link with a set of those (else -1)."""
    band = np.searchsorted(bands["low"], n, side="right") - 1
    return band, np.where((band >= 0) & (100 * n >= join.percent * bands["low"][band + 1]), band + 1, -1)


def profiles(docs: DataFrame, join: Join, id_col: str, text_col: str) -> DataFrame:
    """id, n (set size), two fingerprints of the set, its band and bit sketches (own and next instance)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = join.bands()
        for batch in pieces(batches, most=1_500_000):
            texts = batch.column("text").to_pylist()
            h, doc = hashed(texts, join.k)
            n = np.bincount(doc, minlength=len(texts))
            band, following = _instances(n, bands, join)
            xor, _ = _xor_by(h, doc, len(texts))
            total = np.zeros(len(texts), np.uint64)
            if len(h):
                has = np.flatnonzero(n)
                total[has] = np.add.reduceat(mix(h ^ _ODD[62]), (np.cumsum(n) - n)[has])
            bits = [pa.array(bit_sketches(h, doc, instance, bands), pa.binary()) for instance in (band, following)]
            columns = [batch.column("id"), pa.array(n, pa.int64()), pa.array(xor.view(np.int64)), pa.array(total.view(np.int64)), pa.array(band, pa.int64()), *bits]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "xor", "total", "band", "bits", "bits_next"])
        _hashes.clear()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n long, xor long, total long, band long, bits binary, bits_next binary")


def keys(docs: DataFrame, join: Join) -> DataFrame:
    """docs: id, text. key, up (it is one of the next band's), node: a row for each sketch of a set.

    They are several times the size of what else is known of a set, so they are made from the texts where they are wanted
    and never written. A key's first 9 bits are its instance, so that those of two never meet, and the last 16 are 0: fewer
    bytes are shuffled. Of a billion keys of an instance one in 500 meets another by chance; pairs are verified anyway.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = join.bands()
        for batch in pieces(batches, most=1_500_000):
            h, doc = hashed(batch.column("text").to_pylist(), join.k)
            node = batch.column("id").to_numpy(zero_copy_only=False)
            for up, instance in enumerate(_instances(np.bincount(doc, minlength=batch.num_rows), bands, join)):
                k, many = sketch_keys(h, doc, instance, bands)
                k = (k.view(np.uint64) & _SKETCH) | (np.repeat(np.maximum(instance, 0), many).astype(np.uint64) << _U(55))
                columns = [pa.array(k.view(np.int64)), pa.array(np.full(len(k), bool(up))), pa.array(np.repeat(node, many), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "up", "node"])
        _hashes.clear()

    return docs.select("id", "text").mapInArrow(run, "key long, up boolean, node long")


_PAIR = "a long, b long"


def _hamming_ok(pairs: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """Pairs that sizes and bit sketches don't rule out."""
    side = lambda x: sets.select(F.col("id").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("n", "band", "bits", "bits_next")])
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {k: batch.column(k).to_pylist() for k in batch.schema.names}
            keep = []
            for i in range(batch.num_rows):
                n, m, x, y = c["a_n"][i], c["b_n"][i], c["a_band"][i], c["b_band"][i]
                p, q = c["a_bits"][i] if x >= y else c["a_bits_next"][i], c["b_bits"][i] if y >= x else c["b_bits_next"][i]
                fits = abs(x - y) < 2 and 100 * min(n, m) >= join.percent * max(n, m) and p is not None and q is not None
                keep.append(fits and (int.from_bytes(p) ^ int.from_bytes(q)).bit_count() <= join.apart(n + m))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, _PAIR)


Stage = Callable[[DataFrame, str], DataFrame]


def verify(pairs: DataFrame, docs: DataFrame, join: Join, stage: Stage = stage) -> DataFrame:
    """The pairs that link, by their texts. docs: id, text. Texts that no pair needs aren't moved if the needed ids are few."""
    ids = stage(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "needed")
    texts = stage(docs.join(small(ids), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")), "texts")
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("a_text")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("b_text")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[int, set] = {}
            keep = []
            a, b, s, t = (batch.column(c).to_pylist() for c in ("a", "b", "a_text", "b_text"))
            for i in range(len(a)):
                x, y = (seen[k] if k in seen else seen.setdefault(k, shingles(v, join.k)) for k, v in ((a[i], s[i]), (b[i], t[i])))
                both = len(x & y)
                keep.append(bool(x) and 100 * both >= join.percent * (len(x) + len(y) - both))
                if len(seen) > 64:
                    seen.clear()
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return stage(both.mapInArrow(run, _PAIR), "verified")


def _near(rows: list[dict], sk: np.ndarray, n: np.ndarray, comp: np.ndarray, join: Join) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a cell's rows, the pairs of different components that sizes and bit sketches allow, and their Hamming distances."""
    part, two = np.array([r["part"] for r in rows], np.int64), rows[0]["parts"] > 0  # of two blocks, only pairs between them
    left, right, far = ([np.zeros(0, np.int64)] for _ in range(3))
    for i in range(len(rows) - 1):
        j = np.flatnonzero((comp[i + 1 :] != comp[i]) & (100 * np.minimum(n[i], n[i + 1 :]) >= join.percent * np.maximum(n[i], n[i + 1 :]))) + i + 1
        if two:
            j = j[part[j] != part[i]]
        if len(j):
            apart = np.bitwise_count(sk[j] ^ sk[i]).sum(axis=1)
            near = apart <= join.apart(n[i] + n[j])
            left.append(np.full(int(near.sum()), i))
            right.append(j[near])
            far.append(apart[near].astype(np.int64))
    return np.concatenate(left), np.concatenate(right), np.concatenate(far)


def _joining(comp: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], linked: Callable[[int, int], bool] | None = None) -> Iterator[tuple[int, int]]:
    """The nearest pairs that join components, so fewer than there are components; only such that are linked, if it is given."""
    root: dict[int, int] = {}

    def find(k: int) -> int:
        while (up := root.get(k, k)) != k:
            root[k] = root.get(up, up)
            k = up
        return k

    a, b, apart = pairs
    for k in np.argsort(apart, kind="stable").tolist():
        i, j = int(a[k]), int(b[k])
        p, q = find(int(comp[i])), find(int(comp[j]))
        if p != q and (linked is None or linked(i, j)):
            root[max(p, q)] = min(p, q)
            yield i, j


def _cells(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[list[dict]]:
    """The rows of each cell, from rows sorted by it. An array h of a row stays in Arrow's buffers."""
    wait: list[dict] = []
    for batch in batches:
        lists = batch.schema.get_field_index("h")
        rows = (batch if lists < 0 else batch.drop_columns(["h"])).to_pylist()
        if lists >= 0 and rows:
            h = batch.column("h")
            offsets = h.offsets.to_numpy()
            values = h.values.to_numpy().view(np.uint64)
            for r, i, j in zip(rows, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                r["h"] = values[i:j]
        for r in rows:
            if wait and any(r[c] != wait[0][c] for c in by):
                yield wait
                wait = []
            wait.append(r)
    if wait:
        yield wait


def _written(found: Iterator[tuple], names: list[str], most: int = 20_000) -> Iterator[pa.RecordBatch]:
    """What was found as batches of rows, repeated ones only once in a batch."""
    seen: dict[tuple, None] = {}
    for x in chain(found, [None]):
        if x is not None:
            seen[x] = None
        if len(seen) >= most or (x is None and seen):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*seen, strict=True)], names=names)
            seen = {}


def _between_components(join: Join):
    """Over rows sorted by cell: pairs of different components in a cell that sizes and bit sketches allow.

    All of them if they are fewer than PAIRS for each of its rows. Else only as many as join the cell's components, nearest
    first, and the cell's key: it is still open.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for rows in _cells(batches, ("key", "cell")):
            if any(r["bits"] is None for r in rows):
                raise ValueError("a set without the sketch of its instance")
            sk = np.frombuffer(b"".join(r["bits"] for r in rows), np.uint64).reshape(len(rows), -1)
            n, comp = (np.array([r[c] for r in rows], np.int64) for c in ("n", "comp"))
            a, b, apart = near = _near(rows, sk, n, comp, join)
            some = len(a) >= max(1, PAIRS * len(rows))
            for i, j in _joining(comp, near) if some else zip(a.tolist(), b.tolist(), strict=True):
                yield *sorted((rows[i]["node"], rows[j]["node"])), None
            if some:
                yield None, None, rows[0]["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _written(found(batches), ["a", "b", "key"])

    return run


def _between_sets(join: Join):
    """Over rows sorted by cell: links that join the cell's components, by all hashes of shingles; after sizes and bit sketches."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        bands = join.bands()
        for rows in _cells(batches, ("g", "key", "cell")):
            h, comp = [r["h"] for r in rows], np.array([r["comp"] for r in rows], np.int64)
            n = np.array([len(x) for x in h], np.int64)
            band = np.searchsorted(bands["low"], n.max(), side="right") - 1  # the largest set's for all of them
            bits = bit_sketches(np.concatenate(h), np.repeat(np.arange(len(rows)), n), np.full(len(rows), band), bands)
            sk = np.frombuffer(b"".join(bits), np.uint64).reshape(len(rows), -1)

            def linked(i: int, j: int, h: list[np.ndarray] = h, n: np.ndarray = n) -> bool:
                both = len(np.intersect1d(h[i], h[j], assume_unique=True))
                return 100 * both >= join.percent * (n[i] + n[j] - both)

            for i, j in _joining(comp, _near(rows, sk, n, comp, join), linked):
                yield tuple(sorted((rows[i]["node"], rows[j]["node"])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _written(found(batches), ["a", "b"])

    return run


def _dealt(rows: DataFrame, by: list[str], columns: list) -> DataFrame:
    """rows: node and blocks (of its group). A row for each two blocks that its own is one of, in the cell of these; sorted by cell, cells whole."""
    rows = rows.withColumn("parts", F.col("blocks") - 1).withColumn("part", F.expr("pmod(xxhash64(node), parts + 1)"))
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts")), lambda j: F.least(j, F.col("part")) * F.lit(1 << 31) + F.greatest(j, F.col("part")))
    rows = rows.select(*by, F.explode(cells).alias("cell"), "node", "comp", "part", "parts", *columns)
    rows = rows.withColumn("parts", F.when(F.col("cell").bitwiseAND(F.lit((1 << 31) - 1)) == F.shiftright("cell", 31), 0).otherwise(F.col("parts")))
    return rows.repartition(*by, "cell").sortWithinPartitions(*by, "cell")


def _mixed(shared: DataFrame, comp: DataFrame, stage: Stage) -> DataFrame:
    """The rows of keys that sets of several components share, with the component (comp) of each; shared: key, node and more."""
    named = shared.join(comp, "node", "left").select(*shared.columns, F.coalesce("component", "node").alias("comp"))
    named = stage(named, "named")
    return named.join(named.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("key"), "key")


def _open_pairs(shared: DataFrame, comp: DataFrame, sets: DataFrame, join: Join, stage: Stage) -> DataFrame:
    """Pairs between the components that share a key, and keys that are still open (a, b, key); shared: key, node, up, m (the key's rows)."""
    rows = _mixed(shared, comp, stage).withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("long"))
    bits = F.when(F.col("up"), F.col("bits_next")).otherwise(F.col("bits")).alias("bits")  # those of the key's instance
    rows = rows.join(sets.withColumnRenamed("id", "node"), "node")
    return _dealt(rows, ["key"], ["n", bits]).mapInArrow(_between_components(join), _PAIR + ", key long")


def _open_links(shared: DataFrame, comp: DataFrame, docs: DataFrame, join: Join, stage: Stage) -> DataFrame:
    """Links that join the components which share a key (a, b), by whole sets; shared: key, node.

    Keys that share sets are one group: sets that meet by many keys are compared once. Where a chain of keys would make a
    group of more pairs than its keys have, each key is compared by itself.
    """
    rows = stage(_mixed(shared.select("key", "node"), comp, stage), "mixedrows")
    ends = stage(rows.groupBy("key").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("m")), "mixedkeys")
    groups = components(rows.join(ends, "key").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct())
    groups = stage(groups.select("node", F.col("component").alias("g")), "groups")
    pairs = ends.join(groups, F.col("first") == F.col("node")).groupBy("g").agg(F.sum(F.col("m") * F.col("m")).alias("pairs"))
    one = groups.groupBy("g").agg(F.count(F.lit(1)).alias("many")).join(pairs, "g").select("g", F.expr("many * many <= pairs").alias("one"))
    rows = rows.join(groups, "node").join(small(stage(one, "asone")), "g").select("g", F.when(F.col("one"), 0).otherwise(F.col("key")).alias("key"), "node", "comp").distinct()
    sets = _sets(groups, docs, join, stage).select("node", "h")
    rows = stage(rows.join(sets.select("node", F.size("h").alias("n")), "node"), "grouped")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / WHOLE)).cast("long").alias("blocks")
    # a group's rows stay where they are
    rows = rows.join(small(stage(rows.groupBy("g", "key").agg(blocks), "blocks")), ["g", "key"]).join(sets, "node")
    return _dealt(rows, ["g", "key"], ["h"]).mapInArrow(_between_sets(join), _PAIR)


def _shared_keys(docs: DataFrame, join: Join, stage: Stage) -> DataFrame:
    """docs: id, text. Keys that several sets have, a row for each of them: key, up, node, the key's first and last set, and m.

    Keys that hold more than one COUNTERS-th of all rows are found by a sketch of frequent items over one document in SHOWN,
    summed up apart with partial sums and broadcast. No other key has more than a small part of the rows.
    """
    keyed = keys(docs, join)
    shown = keys(docs.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(SHOWN)) == 0), join)
    with staging.small_batches(docs.sparkSession):
        seen = shown.agg(F.expr(f"approx_top_k(key, {COUNTERS}, {COUNTERS})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    heavy = [x["item"] for x in seen["top"] or [] if x["count"] > max(BLOCK / SHOWN, seen["n"] / COUNTERS)]
    ends = [F.min("node").alias("first"), F.max("node").alias("last"), F.count(F.lit(1)).alias("m")]
    w = Window.partitionBy("key")
    light = keyed.where(~F.col("key").isin(heavy)) if heavy else keyed
    out = light.withColumns({"first": F.min("node").over(w), "last": F.max("node").over(w), "m": F.count(F.lit(1)).over(w)}).where("first < last")
    if heavy:
        hot = keyed.where(F.col("key").isin(heavy))
        hot = hot.join(F.broadcast(stage(hot.groupBy("key").agg(*ends), "hotkeys")), "key")  # COUNTERS rows at most
        out = out.unionByName(hot.where("first < last").select(*out.columns))
    return stage(out, "shared")


def _shingle_sets(texts: DataFrame, join: Join) -> DataFrame:
    """texts: node, g, text. node, g and the hashes of its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=1_500_000):
            h, doc = hashed(batch.column("text").to_pylist(), join.k)
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=batch.num_rows))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("g"), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))], names=["node", "g", "h"])
        _hashes.clear()

    return texts.select("node", "g", "text").mapInArrow(run, "node long, g long, h array<long>")


def _sets(groups: DataFrame, docs: DataFrame, join: Join, stage: Stage) -> DataFrame:
    """groups: node, g. node, g and the hashes of its shingles, in order."""
    texts = docs.join(small(groups.withColumnRenamed("node", "id")), "id").groupBy("id", "g").agg(F.min("text").alias("text"))
    return stage(_shingle_sets(texts.withColumnRenamed("id", "node"), join), "wholesets")


def _refined(hot: DataFrame, light: DataFrame, docs: DataFrame, join: Join, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """For the sets of hot keys, keys that tell them apart (key, node, up, m), and pairs with the one nearest to what they have in common.

    Keys that share sets are one group. A set's residue is its symmetric difference from the shingles that more than half
    of the group have. Linked sets differ in t members at most, t for the group's largest set; so their residues share one
    of the t + 1 rarest members of each, or have no more than t members together.
    """
    groups = components(hot.select(F.col("node").alias("a"), F.col("first").alias("b")).where("a <> b").distinct())
    groups = stage(groups.select("node", F.col("component").alias("g")), "groups")
    sets = _sets(groups, docs, join, stage)
    sizes = sets.groupBy("g").agg(F.count(F.lit(1)).alias("many"), F.expr(f"max(2 * size(h)) * {100 - join.percent} div {100 + join.percent}").cast("int").alias("t"))
    sizes = stage(sizes, "groupsizes")
    counts = sets.select("g", F.explode("h").alias("x")).groupBy("g", "x").agg(F.count(F.lit(1)).alias("c"))
    # no more than twice as many as a set of the group has on average
    core = counts.join(small(sizes), "g").where("2 * c > many").groupBy("g").agg(F.collect_list("x").alias("core"))
    both = sets.join(small(sizes), "g").join(small(stage(core, "core"), 10_000), "g", "left").withColumn("core", F.coalesce("core", F.expr("cast(array() as array<bigint>)")))
    signed = lambda c, sign: F.transform(c, lambda x: F.struct(x.alias("x"), F.lit(sign).alias("gone")))
    residue = F.concat(signed(F.array_except("h", "core"), False), signed(F.array_except("core", "h"), True))
    left = stage(both.select("g", "node", "t", residue.alias("residue")), "residues")
    every = left.select("g", "node", "t", F.explode("residue").alias("e")).select("g", "node", "t", "e.*")
    often = every.groupBy("g", "x", "gone").agg(F.count(F.lit(1)).alias("f"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("f", "x", "gone"))
    # members that one set alone has count for the prefix, and meet no one
    first = every.join(often, ["g", "x", "gone"]).withColumn("rank", rank).where("rank <= t + 1 and f > 1")
    first = first.select("node", F.xxhash64("g", "x", "gone").alias("key"))
    near = left.withColumn("r", F.size("residue")).groupBy("g").agg(F.min(F.struct("r", "node")).alias("least"))
    tiny = left.withColumn("r", F.size("residue")).join(small(stage(near, "nearest")), "g").where("2 * least.r <= t and r + least.r <= t")
    tiny = stage(tiny.select("node", F.xxhash64("g").alias("key"), F.col("least.node").alias("hub")), "tiny")
    keyed = first.unionByName(tiny.select("node", "key")).join(light.select(F.col("id").alias("node"), "band", "bits_next"), "node")
    up = lambda on: keyed.where("bits_next is not null" if on else "true").select("node", F.xxhash64("key", F.col("band") + int(on)).alias("key"), F.lit(on).alias("up"))
    keyed = stage(up(False).unionByName(up(True)), "prefixes")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    pairs = tiny.where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    return keyed.join(shared, "key").select("key", "node", "up", "m"), pairs


def classes(docs: DataFrame, join: Join, id_col: str = "doc_id", text_col: str = "text", left: list[DataFrame] | None = None) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (the smallest id reachable by links, itself included).

    Null and empty texts, and those of white space only, have empty sets and link with nothing. Rows that repeat an id
    count as one document, compared by the least of its texts. A row with a null id links with nothing. An empty table gives an empty result.
    Tables that the work wrote are deleted, but for the two that the result reads: these are put into `left`.
    """
    made: list[DataFrame] = []

    def stage(df: DataFrame, name: str) -> DataFrame:
        made.append(staging.stage(df, name))
        return made[-1]

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    prof = staging.stage(profiles(docs, join, id_col, text_col), "profiles")
    # equal sets first: one of them stands for all
    full = prof.where("n > 0 and id is not null")
    same = full.groupBy("xor", "total", "n").agg(F.min("id").alias("rep"))
    members = stage(full.select("id", "xor", "total", "n").join(same, ["xor", "total", "n"]).select("id", "rep"), "members")
    others = members.where("id <> rep").select("id").distinct()
    others = small(stage(others, "others"))
    shared = _shared_keys(rows.where("id is not null").join(others, "id", "left_anti"), join, stage)
    light = stage(full.join(others, "id", "left_anti").select("id", "n", "band", "bits", "bits_next"), "sets")
    stars = shared.select("node", F.explode(F.array("first", "last")).alias("hub")).where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    links = verify(stage(_hamming_ok(stars, light, join), "stars"), rows, join, stage)
    comp = components(links)
    rest = shared.select("key", "node", "up", "m")
    hot = shared.where(F.col("m") > HOT)
    named = hot.join(comp, "node", "left").groupBy("key").agg(F.min(F.coalesce("component", "node")).alias("x"), F.max(F.coalesce("component", "node")).alias("y"))
    mixed = stage(named.where("x < y").select("key"), "mixed")
    if mixed.limit(1).count():
        keys, pairs = _refined(stage(hot.join(small(mixed), "key", "left_semi"), "hot"), light, rows, join, stage)
        links = links.union(verify(stage(_hamming_ok(pairs, light, join), "nearpairs"), rows, join, stage))
        comp = components(links)
        rest = stage(rest.where(F.col("m") <= HOT).unionByName(keys), "refined")
    # where one key still has several components: what joins them most nearly, or all that is left between them; then whole sets
    found = stage(_open_pairs(rest, comp, light, join, stage), "between")
    links = links.union(verify(found.where("a is not null").select("a", "b").distinct(), rows, join, stage))
    comp = components(links)
    still = stage(found.where("key is not null").select("key").distinct(), "open")
    if still.limit(1).count():
        left_open = stage(_open_links(rest.join(small(still), "key", "left_semi"), comp, rows, join, stage), "openlinks")
        links = links.union(verify(left_open.distinct(), rows, join, stage))
        comp = components(links)
    comp = stage(comp, "components")
    named = members.join(small(comp.withColumnRenamed("node", "rep")), "rep", "left").select("id", F.coalesce("component", "rep").alias("component"))
    moved = staging.stage(named.where("id <> component").distinct(), "moved")
    for table in made:
        drop_staged(table)
    if left is not None:
        left += [prof, moved]
    out = prof.select("id", "n").join(small(moved), "id", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def keep_one(docs: DataFrame, join: Join, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with the smallest id of their class, with all their columns; null ids stay.

    An id with several texts is as many documents, each kept or dropped for its own text.
    """
    named, text = F.col(id_col).isNotNull(), sha256(F.coalesce(F.col(text_col), F.lit("")))
    nodes = docs.where(named).select(F.col(id_col).cast("long").alias("id"), text.alias("digest")).distinct()
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    if not nodes.groupBy("id").count().where("count > 1").limit(1).count():
        left: list[DataFrame] = []
        found = classes(docs.select(id_col, text_col), join, id_col, text_col, left)
        gone = stage(found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct(), "dropped")
        for table in left:
            drop_staged(table)
        return docs.join(small(gone), id_col, "left_anti")
    one = docs.where(named).select(F.col(id_col).cast("long").alias("id"), text.alias("digest"), F.col(text_col).alias("text")).join(nodes, ["id", "digest"])
    found = classes(stage(one.select("node", "text").dropDuplicates(["node"]), "texts"), join, "node", "text")
    found = stage(found.select("node", "component_id").join(nodes, "node"), "classes")
    least = found.groupBy("component_id").agg(F.min("id").alias("least"))
    gone = found.join(least, "component_id").where("id > least").select("id", "digest")
    return without(docs, stage(gone, "dropped"), id_col, text)
