"""Near-duplicate vectors by a pivot-permutation index.

Each vector is described by its nearest reference points (pivots), in order of nearness. Inverted lists hold, by label and
pivot, the vectors that have the pivot among those. Within a list the pivots that two vectors share are counted; those that
share enough are candidates, and only these are verified by their cosine in double precision. A pair is counted in the list
of the smallest pivot it shares. Equal vectors are one, counted with its copies. Long lists are compared in blocks of
bounded size. The number of pivots grows with that of the vectors, so that lists stay short.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramo.llm import staging
from tramo.llm.components import components
from tramo.llm.staging import drop_staged, small


@dataclass(frozen=True)
class Index:
    #: Reference points: one for so many vectors, between these two numbers. They are chosen from a sample of some vectors each.
    vectors_a_pivot: int = 256
    pivots: tuple[int, int] = (256, 16_384)
    sample: int = 16
    #: The nearest pivots that a vector is described by, and how many of them candidates share.
    prefix: int = 8
    shared: int = 2
    cosine: float = 0.98
    #: No pivot is as near to another as this: near vectors would be told apart by which of them they are nearest to.
    #: It holds for vectors of every direction; in a cone, where all are nearer to each other, it comes nearer to 1 as they do.
    apart: float = 0.8
    #: Pivots that one task chooses.
    a_task: int = 1024
    #: Vectors of a list that are compared at once, at most about twice as many.
    block: int = 1024


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of doubles (zeros where they can't be used), and which can."""
    lists = column.to_pylist()
    width = max((len(v) for v in lists if v), default=1)
    out, ok = np.zeros((len(lists), width)), np.zeros(len(lists), bool)
    for i, v in enumerate(lists):
        if v and None not in v:
            row = np.array(v, np.float64)
            if np.isfinite(row).all() and row.any():
                out[i, : len(v)], ok[i] = row, True
    return out, ok


def _unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(big > 0, big, 1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _limit(x: np.ndarray, apart: float) -> float:
    """apart, for the spread of the unit vectors x: their mean cosine takes the place of 0."""
    mean = x.mean(axis=0)
    return 1 - (1 - apart) * (1 - min(1.0, float(mean @ mean)))


def _farthest(x: np.ndarray, wanted: int, limit: float) -> np.ndarray:
    """Each next one is the vector that is farthest from those before, as long as it isn't as near as limit to one of them."""
    at = [0]
    near = x @ x[0]
    while len(at) < min(wanted, len(x)) and near.min() < limit:
        at.append(int(near.argmin()))
        near = np.maximum(near, x @ x[at[-1]])
    return x[at]


def _thinned(x: np.ndarray, limit: float, block: int = 512) -> np.ndarray:
    """The vectors that aren't as near as limit to one that stays before them."""
    kept = x[:0]
    for a in range(0, len(x), block):
        part = x[a : a + block]
        if len(kept):
            part = part[(part @ kept.T).max(axis=1) < limit]
        near, stay = part @ part.T, []
        for i in range(len(part)):
            if not stay or near[i, stay].max() < limit:
                stay.append(i)
        kept = np.concatenate([kept, part[stay]])
    return kept


def choose_pivots(vectors: DataFrame, index: Index) -> np.ndarray:
    """Farthest-first from a sample of `sample` vectors for each pivot: 262,144 of them at most, given the most pivots.

    The sample is dealt out by a hash: a task chooses about `a_task` pivots from its part, and the driver, which gets no
    other vectors, leaves out those that are too near to a pivot of another task.
    """
    n = vectors.count()
    wanted = min(index.pivots[1], max(index.pivots[0], n // index.vectors_a_pivot))
    most, tasks = index.sample * wanted, -(-wanted // index.a_task)
    part = vectors if n <= most else vectors.where(F.pmod(F.xxhash64("vec", F.lit(9)), F.lit(1_000_000_000)) < int(1_000_000_000 * most / n))
    each = -(-wanted // tasks)

    def choose(rows: pa.Table) -> pa.Table:
        x, ok = _matrix(rows.column("vec").combine_chunks())
        x = np.unique(_unit(x[ok]), axis=0)
        if not len(x):
            return pa.table({"vec": pa.array([], pa.list_(pa.float64())), "limit": pa.array([], pa.float64())})
        limit = _limit(x, index.apart)
        chosen = _farthest(x, each, limit)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(chosen) + 1, dtype=np.int32) * x.shape[1]), pa.array(chosen.ravel()))
        return pa.table({"vec": flat, "limit": pa.array(np.full(len(chosen), limit))})

    dealt = part.select(F.pmod(F.xxhash64("vec", F.lit(11)), F.lit(tasks)).alias("task"), "vec")
    found = dealt.groupBy("task").applyInArrow(choose, "vec array<double>, limit double").toArrow()
    if not found.num_rows:
        return np.zeros((0, 1))
    x, _ = _matrix(found.column("vec").combine_chunks())
    if tasks == 1:
        return x
    x = x[np.lexsort(x.T[::-1])]
    return _thinned(x, min(found.column("limit").to_pylist()))[:wanted]


def _postings(vectors: DataFrame, shared: Broadcast, index: Index) -> DataFrame:
    """A row for each vector and pivot of its prefix; shared: the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _ = _matrix(batch.column("vec"))
            p = shared.value
            width = max(x.shape[1], p.shape[1])
            x, p = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (_unit(x), p))
            order = np.argsort(-(x @ p.T), axis=1, kind="stable")[:, : index.prefix].astype(np.int32)  # nearest first
            near = pa.array(order.tolist(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, near], names=[*batch.schema.names, "near"])

    return vectors.mapInArrow(run, "node long, label int, n long, vec array<double>, near array<int>").withColumn("pivot", F.explode("near"))


def _compare(index: Index):
    """Over rows sorted by label, pivot and cell: links counted by node, and a link of each class found in a cell."""

    def cell(rows: list[dict]) -> tuple[list, list, list, list]:
        node, n, part = (np.array([r[c] for r in rows], np.int64) for c in ("node", "n", "part"))
        width = max(len(r["vec"]) for r in rows)
        x = _unit(np.array([r["vec"] + [0.0] * (width - len(r["vec"])) for r in rows], np.float64))
        near = np.full((len(rows), index.prefix), -1, np.int64)
        for i, r in enumerate(rows):
            near[i, : len(r["near"])] = r["near"]
        pivot, two = rows[0]["pivot"], rows[0]["parts"] > 0
        # how many pivots two vectors share, and whether any of these comes before this list's
        names, at = np.unique(near[near >= 0], return_inverse=True)
        used = np.zeros((len(rows), len(names)), np.float32)
        used[np.nonzero(near >= 0)[0], at] = 1
        before = used[:, names < pivot]
        fits = np.triu((used @ used.T >= min(index.shared, int((near >= 0).sum(axis=1).min()))) & (before @ before.T == 0), 1)
        if two:
            fits &= part[:, None] != part[None, :]
        i, j = np.nonzero(fits)
        close = np.zeros(len(i), bool)
        for a in range(0, len(i), 16_384):
            close[a : a + 16_384] = np.einsum("ij,ij->i", x[i[a : a + 16_384]], x[j[a : a + 16_384]]) >= index.cosine
        i, j = i[close], j[close]
        if not len(i):
            return [], [], [], []
        links = np.bincount(i, weights=n[j], minlength=len(rows)) + np.bincount(j, weights=n[i], minlength=len(rows))
        root = np.arange(len(rows))

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        tree = []
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            p, q = find(a), find(b)
            if p != q:
                root[max(p, q)] = min(p, q)
                tree.append((int(node[a]), int(node[b])))
        some = np.flatnonzero(links)
        return node[some].tolist(), links[some].astype(np.int64).tolist(), [a for a, _ in tree], [b for _, b in tree]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: list[dict] = []
        name = lambda r: (r["label"], r["pivot"], r["cell"])
        for batch in chain(batches, [None]):
            out: list[list] = [[], [], [], []]
            for r in [None] if batch is None else batch.to_pylist():
                if wait and (r is None or name(r) != name(wait[0])):
                    for o, f in zip(out, cell(wait), strict=True):
                        o += f
                    wait = []
                if r is not None:
                    wait.append(r)
            counts, trees = len(out[0]), len(out[2])
            if counts or trees:
                pad = lambda k, v: pa.array(v, pa.int64()) if k else pa.nulls(0, pa.int64())
                yield pa.RecordBatch.from_arrays([pad(1, out[0] + out[2]), pa.array(out[1] + [None] * trees, pa.int64()), pa.array([None] * counts + out[3], pa.int64())], names=["a", "links", "b"])

    return run


def near_duplicates(rows: DataFrame, index: Index = Index(), id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row: id, n_links, component_id, kept.

    Vectors are compared when labels are equal and not null. A vector that is null, empty, zero, or holds a null or a
    non-finite component links with nothing, and so does a row with a null id. Missing last components count as zeros.
    Copies of a vector link with each other. Ties and repeated rows are links like others.
    """
    made: list[DataFrame] = []

    def stage(df: DataFrame, name: str) -> DataFrame:
        made.append(staging.stage(df, name))
        return made[-1]

    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0)
    fine &= ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0)
    base = base.withColumn("fine", F.coalesce(fine, F.lit(False)))
    mark = F.sha2(F.to_json(F.struct(F.transform("vec", lambda x: F.when(x == 0, 0.0).otherwise(x)).alias("v"))), 256)
    good = stage(base.where("fine").select("id", "label", "vec", mark.alias("mark")), "vectors")
    same = good.groupBy("label", "mark").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n"))
    members = stage(good.select("id", "label", "mark").join(same, ["label", "mark"]).select("id", "node", "n"), "copies")
    # vectors of the groups' first ids, once each
    nodes = stage(good.join(members.where("id = node").select("id", "n").distinct(), "id").dropDuplicates(["id"]).select(F.col("id").alias("node"), "label", "n", "vec"), "nodes")
    pivots = choose_pivots(nodes, index)
    if not len(pivots):
        links = rows.sparkSession.createDataFrame([], "a long, links long, b long")
    else:
        shared = rows.sparkSession.sparkContext.broadcast(pivots)
        lists = stage(_postings(nodes, shared, index), "postings")
        shared.unpersist()
        sizes = lists.groupBy("label", "pivot").agg(F.ceil(F.count(F.lit(1)) / index.block).alias("k")).select("label", "pivot", (F.col("k") - 1).cast("long").alias("parts"))
        cut = lists.join(small(stage(sizes, "sizes")), ["label", "pivot"]).withColumn("part", F.expr("pmod(xxhash64(node), parts + 1)"))
        cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts")), lambda j: F.least(j, F.col("part")) * F.lit(1 << 31) + F.greatest(j, F.col("part")))
        cut = cut.withColumn("cell", F.explode(cells)).withColumn("parts", F.when(F.col("cell").bitwiseAND(F.lit((1 << 31) - 1)) == F.shiftright("cell", 31), 0).otherwise(F.col("parts")))
        cut = cut.repartition("label", "pivot", "cell").sortWithinPartitions("label", "pivot", "cell")
        links = stage(cut.mapInArrow(_compare(index), "a long, links long, b long"), "near")
    comp = components(links.where("b is not null").select("a", "b"))
    counts = links.where("links is not null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    named = counts.join(comp, "node", "full").select("node", "links", "component")
    found = members.join(small(stage(named, "classes")), "node", "left")
    found = found.select("id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    found = staging.stage(found.dropDuplicates(["id"]), "found")
    for table in [*made, comp]:
        drop_staged(table)
    out = base.select("id", "fine").join(small(found), "id", "left")
    alone = ~F.col("fine") | F.col("component").isNull()
    out = out.select(F.col("id").alias(id_col), F.when(alone, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"), F.when(alone, F.col("id")).otherwise(F.col("component")).alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
