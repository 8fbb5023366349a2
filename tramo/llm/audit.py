"""How far the sources of a language differ in the words they use.

Terms are cut from whole batches of texts at once: a lookup table turns the bytes of all texts into lower-cased term bytes
or boundaries; slices are grouped by their xxhash, and each is compared byte by byte with its group's first one. Counts by
source and term are summed up by Spark. Terms are dealt out in blocks; a block's counts are a sparse matrix of sources by
terms, over which the divergence of two sources is summed wherever one of them has the term. Where neither has it, its share
is the same for all terms, and is added at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramo.llm.buffers import joined, owners, runs
from tramo.llm.staging import small, stage
from tramo.llm.units import pieces
from tramo.tables import cleaned

#: By byte: 0 at boundaries, else the term's byte, A-Z lower-cased.
TERM = np.zeros(256, np.uint8)
TERM[0x61:0x7B] = TERM[0x41:0x5B] = np.arange(0x61, 0x7B)
TERM[0x80:] = np.arange(0x80, 0x100)
#: Counts of a task: put together beyond so many, given out beyond so many (or so many bytes of terms).
TOGETHER, GIVEN, BYTES = 400_000, 300_000, 16_000_000


@dataclass(frozen=True)
class Audit:
    #: Documents of a language that a term is in at least.
    least: int = 10
    #: Added to each count; what shares are multiplied by before they are cut to whole numbers.
    prior: int = 2
    scale: int = 1_000_000_000
    #: Terms of a source that are reported.
    top: int = 10
    #: Rows of a block (more where a language has many sources), and sources of a tile of its matrix.
    block: int = 1 << 15
    tile: int = 256


def slices(texts: pa.Array, hash_of: Callable[[bytes], int] = xxhash.xxh3_64_intdigest) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct terms of all texts; of each occurrence its term's number and its text."""
    flat, at = joined(texts)
    low = TERM[flat]
    starts, ends = runs(low > 0, at)
    if not len(starts):
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = low.tobytes()
    h = np.fromiter((hash_of(raw[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    _, first, term = np.unique(h, return_index=True, return_inverse=True)
    same = _equal(low, starts, ends, first[term])
    names = [raw[starts[k] : ends[k]] for k in first.tolist()]
    if not same.all():
        # slices that share a hash with another one are told apart by their bytes
        more: dict[bytes, int] = {}
        for k in np.flatnonzero(~same).tolist():
            term[k] = more.setdefault(raw[starts[k] : ends[k]], len(names) + len(more))
        names += more
    return names, term, owners(starts, at)


def _equal(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each slice has the bytes of the slice that other names."""
    n = ends - starts
    same = n == n[other]
    mine = np.flatnonzero(same & (other != np.arange(len(n))))
    if len(mine):
        size = n[mine]
        begin = np.cumsum(size) - size
        step = np.arange(int(size.sum())) - np.repeat(begin, size)
        odd = low[np.repeat(starts[mine], size) + step] != low[np.repeat(starts[other[mine]], size) + step]
        same[mine] = ~np.logical_or.reduceat(odd, begin)
    return same


class _Counts:
    """Occurrences and documents by group and term, kept small."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.terms: dict[bytes, int] = {}
        self.size, self.have, self.parts = 0, 0, []

    def add(self, groups: list[tuple[str, str]], names: list[bytes], term: np.ndarray, doc: np.ndarray) -> None:
        group = np.fromiter((self.groups.setdefault(g, len(self.groups)) for g in groups), np.int64, len(groups))
        known = len(self.terms)
        number = np.fromiter((self.terms.setdefault(x, len(self.terms)) for x in names), np.int64, len(names))
        if len(self.terms) > known:
            self.size += sum(map(len, names))
        if not len(term):
            return
        pairs, n = np.unique(doc * len(names) + term, return_counts=True)  # a document's term, once
        self._put((group[pairs // len(names)] << 32) + number[pairs % len(names)], n, np.ones(len(n), np.int64))

    def _put(self, key: np.ndarray, n: np.ndarray, docs: np.ndarray) -> None:
        self.parts.append((key, n, docs))
        self.have += len(key)
        if self.have > TOGETHER:
            self._merge()

    def _merge(self) -> None:
        key, n, docs = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(key, kind="stable")
        key = key[order]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        self.parts = [(key[begin], np.add.reduceat(n[order], begin), np.add.reduceat(docs[order], begin))]
        self.have = len(begin)

    def full(self) -> bool:
        return self.have > GIVEN or self.size > BYTES

    def give(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self._merge()
            key, n, docs = self.parts[0]
            lang, source = (pa.array([g[k] for g in self.groups], pa.string()) for k in (0, 1))
            group, term = pa.array(key >> 32), pa.array([*self.terms], pa.binary()).cast(pa.string())
            columns = [lang.take(group), source.take(group), term.take(pa.array(key & 0xFFFFFFFF)), pa.array(n), pa.array(docs)]
            whole = pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
            for k in range(0, whole.num_rows, 50_000):
                yield whole.slice(k, 50_000)
        self.clear()


def count_terms(docs: DataFrame) -> DataFrame:
    """docs: text, lang, source, without nulls. lang, source, term, n (occurrences) and docs (rows that have it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for batch in pieces(batches):
            names, term, doc = slices(batch.column("text"))
            counts.add(list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)), names, term, doc)
            if counts.full():
                yield from counts.give()
        yield from counts.give()

    some = docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return some.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(n: np.ndarray, total: np.ndarray | int, scale: int) -> np.ndarray:
    """1 + floor(scale * n / total) for n <= total, in whole numbers; scale: a power of 1,000. total under 9e15."""
    left, out = np.asarray(n, np.int64), 0
    while scale > 1:
        left = left * 1000
        out = out * 1000 + left // total
        left, scale = left % total, scale // 1000
    return out + 1


def far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _tables(rows: pa.RecordBatch, audit: Audit) -> Iterator[tuple]:
    """One cell: rows without a term tell its sources, the others are counts. part, source, other, term, value."""
    head = rows.filter(pc.is_null(rows.column("term")))
    body = rows.filter(pc.is_valid(rows.column("term")))
    if not body.num_rows:
        return
    number = lambda batch, c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
    src = number(head, "src")
    order = np.argsort(src)
    src, size = src[order], number(head, "size")[order]
    v, n_lang = int(head.column("v")[0].as_py()), int(head.column("n_lang")[0].as_py())
    total = size + audit.prior * v
    term = body.column("term").dictionary_encode()  # rows are sorted by term: numbers are in its order
    names, code = term.dictionary, term.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row, n, lang_n = np.searchsorted(src, number(body, "src")), number(body, "n"), number(body, "total")
    order = np.lexsort((code, row))
    row, code, n, lang_n = row[order], code[order], n[order], lang_n[order]
    # sources by terms
    starts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(src)))])
    p, p0 = shares(n + audit.prior, total[row], audit.scale), shares(np.full(len(src), audit.prior), total, audit.scale)
    a, b = int(head.column("a")[0].as_py()), int(head.column("b")[0].as_py())
    if a == b:
        q = shares(lang_n + audit.prior, n_lang + audit.prior * v, audit.scale)
        f = far(p, q)
        more = np.flatnonzero(p > q)
        more = more[np.lexsort((code[more], -f[more], row[more]))]
        begin = np.concatenate([[0], np.flatnonzero(np.diff(row[more])) + 1]) if len(more) else np.zeros(0, np.int64)
        place = np.arange(len(more)) - np.repeat(begin, np.diff(np.append(begin, len(more))))
        for k in more[place < audit.top].tolist():
            yield 1, int(src[row[k]]), None, names[int(code[k])].as_py(), int(f[k])
    has, tile = np.flatnonzero(np.diff(starts)), src // audit.tile
    sums = lambda x: _by_row(x, starts, has, len(src))
    # by source j, what the terms of each source i add where j has none of them: lone[j, i]
    lone = np.stack([sums(far(p, np.full(len(p), p0[j])) - far(p0[row], np.full(len(p), p0[j]))) for j in range(len(src))])
    dense, mine = np.empty(len(names), np.int64), np.zeros(len(names), bool)
    for i in np.flatnonzero(tile == a).tolist():
        own = slice(starts[i], starts[i + 1])
        dense[:], mine[:] = p0[i], False
        dense[code[own]], mine[code[own]] = p[own], True
        none = far(np.full(len(src), p0[i]), p0)
        here, both = dense[code], mine[code]
        # terms of j, whether i has them or not; then those of i that j hasn't
        d = sums(far(here, p) - none[row]) + lone[:, i] - sums(np.where(both, far(here, p0[row]) - none[row], 0))
        for j in np.flatnonzero((tile == b) & (src > src[i])).tolist():
            yield 0, int(src[i]), int(src[j]), None, int(d[j])


def _by_row(x: np.ndarray, starts: np.ndarray, has: np.ndarray, rows: int) -> np.ndarray:
    out = np.zeros(rows, np.int64)
    if len(has):
        out[has] = np.add.reduceat(x, starts[has])
    return out


_FOUND = pa.schema([("lang", pa.string()), ("part", pa.int32()), ("src", pa.int64()), ("other", pa.int64()), ("term", pa.string()), ("value", pa.int64())])


def _compare(audit: Audit):
    """Over rows sorted by cell, those without a term first, then by term."""

    def found(wait: list[pa.RecordBatch], lang: str) -> Iterator[pa.RecordBatch]:
        rows = [(lang, *x) for x in _tables(pa.concat_batches(wait), audit)] if wait else []
        for j in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[j : j + 50_000], strict=True), _FOUND.types, strict=True)], schema=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: list[pa.RecordBatch] = []
        cell: tuple = ("",)
        for batch in batches:
            since = 0
            for k, key in enumerate(zip(*(batch.column(c).to_pylist() for c in ("lang", "block", "a", "b")), strict=True)):
                if key != cell:
                    if k > since:
                        wait.append(batch.slice(since, k - since))
                    yield from found(wait, cell[0])
                    wait, since, cell = [], k, key
            wait.append(batch.slice(since))
        yield from found(wait, cell[0])

    return run


def sources(docs: DataFrame, audit: Audit = Audit(), text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: how far each source of a language is from each other one,
    and the terms by which it is most above its language.

    Null texts, languages and sources are empty ones. A source without terms, or a language of which no term is kept, has
    pairs of value 0; equal values are in order of their items' bytes. Repeated rows count as documents. Other columns
    aren't read. An empty table gives an empty result.
    """
    with cleaned(docs.sparkSession) as made:
        base = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
        counts = stage(count_terms(base), "counts")
        every = Window.partitionBy("lang", "term")
        rows = counts.withColumns({"total": F.sum("n").over(every), "in_docs": F.sum("docs").over(every), "first": F.min("source").over(every)})
        rows = stage(rows.where(F.col("in_docs") >= audit.least).select("lang", "source", "term", "n", "total", (F.col("first") == F.col("source")).alias("lead")), "kept")
        langs = rows.groupBy("lang").agg(F.sum(F.col("lead").cast("long")).alias("v"), F.sum("n").alias("n_lang"), F.count(F.lit(1)).alias("rows"))
        sizes = rows.groupBy("lang", "source").agg(F.sum("n").alias("size"))
        named = base.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["size", "v", "n_lang", "rows"])
        own = Window.partitionBy("lang")
        named = named.withColumns({"src": (F.row_number().over(own.orderBy("source")) - 1).cast("long"), "many": F.count(F.lit(1)).over(own)})
        named = named.withColumns({"blocks": F.ceil(F.col("rows") / F.greatest(F.lit(audit.block), 64 * F.col("many"))).cast("long"), "tiles": F.ceil(F.col("many") / audit.tile).cast("long")})
        named = stage(named.withColumn("mine", F.expr(f"src div {audit.tile}")), "sources")
        found = stage(_cells(rows, named, audit).mapInArrow(_compare(audit), "lang string, part int, src long, other long, term string, value long"), "found")
        out = stage(_pairs(named, found, audit).unionByName(_terms(named, found, audit)), "divergences")
        return made.keep(out)


def _cells(rows: DataFrame, named: DataFrame, audit: Audit) -> DataFrame:
    tiles = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda t: F.struct(F.least(t, F.col("mine")).alias("a"), F.greatest(t, F.col("mine")).alias("b")))
    body = rows.join(small(named.select("lang", "source", "src", "mine", "blocks", "tiles")), ["lang", "source"])
    body = body.withColumns({"block": F.expr("pmod(xxhash64(term), blocks)"), "cell": F.explode(tiles)})
    none = F.lit(None).cast("long")
    body = body.select("lang", "block", "cell.*", "term", "src", "n", "total", none.alias("size"), none.alias("v"), none.alias("n_lang"))
    head = named.where("blocks > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("cell", F.explode(tiles))
    head = head.select("lang", "block", "cell.*", F.lit(None).cast("string").alias("term"), "src", none.alias("n"), none.alias("total"), "size", "v", "n_lang")
    return body.unionByName(head).repartition("lang", "block", "a", "b").sortWithinPartitions("lang", "block", "a", "b", F.col("term").asc_nulls_first())


def _ranked(df: DataFrame, *keys: str) -> Column:
    return F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))


def _pairs(named: DataFrame, found: DataFrame, audit: Audit) -> DataFrame:
    # of terms that neither source has, each adds the same
    p0 = F.expr(f"case when v > 0 then 1 + {audit.prior * audit.scale}L div (size + {audit.prior} * v) else 1L end")
    one = named.withColumn("p0", p0)
    other = small(one.select("lang", F.col("source").alias("item"), F.col("src").alias("other"), F.col("p0").alias("q0")))
    pairs = one.select("lang", "source", "src", "v", "p0").join(other, "lang").where("src <> other")
    sums = found.where("part = 0").groupBy("lang", F.col("src").alias("x"), F.col("other").alias("y")).agg(F.sum("value").alias("delta"))
    pairs = pairs.withColumns({"x": F.least("src", "other"), "y": F.greatest("src", "other")}).join(sums, ["lang", "x", "y"], "left")
    value = F.expr("v * (((p0 - q0) * (p0 - q0)) div (p0 + q0))") + F.coalesce("delta", F.lit(0))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    return pairs.withColumn("rank", _ranked(pairs).cast("int"))


def _terms(named: DataFrame, found: DataFrame, audit: Audit) -> DataFrame:
    terms = found.where("part = 1").select("lang", "src", F.col("term").alias("item"), "value").join(small(named.select("lang", "source", "src")), ["lang", "src"])
    terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", "value")
    return terms.withColumn("rank", _ranked(terms).cast("int")).where(F.col("rank") <= audit.top)
