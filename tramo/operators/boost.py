"""Boosted trees for a quantile, grown over a table of binned features.

Features are bytes (numbers, by bins) and numbered levels (categories). A tree is grown level by level on the signs of the
residuals, by sums over all rows; then each leaf gets the exact quantile of its rows' residuals, narrowed down by counts.

Each of these steps needs what the one before found, and would be a job of its own. So the driver guesses: from a bounded
sample of rows it grows the next trees, with their leaves, and one job sums up all of them at once, over all rows. What the
sums show to be right stays; from the first wrong split or leaf on it is guessed anew, with what is known by then. So only
the number of jobs depends on the guesses: a tree takes one job for each of its levels at most, and a few for its leaves,
and many trees share one job where the sample has most rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramo.tables import cleaned, stage

#: Rows that bins are cut from; rows that the driver guesses from, and of a table that one task grows all trees of.
SAMPLE, GUESS = 200_000, 1_000_000
BINS = 256
#: Rows of a task that are summed up at once; levels of a category in one piece of the sums.
ROWS, PIECE = 65_536, 4_096
#: Codes that features are counted by together, at most.
JOINT = 1_024
#: Trees guessed at once, at most; trees after which predictions are written.
AHEAD, WRITE = 32, 32
#: Intervals that a leaf's quantile is looked for in.
INTERVALS = 64
LEAF = 1_000_000
SUMS = "tree int, node int, feature int, piece int, rows long, above long, codes binary, n binary, p binary"


@dataclass
class Tree:
    """Nodes by number: those under k are 2 k + 1 and 2 k + 2. feature: -1 where a node isn't split; value: of leaves."""

    feature: np.ndarray
    code: np.ndarray
    value: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        inner = 2**depth - 1
        return Tree(np.full(inner, -1, np.int64), np.full(inner, -1, np.int64), np.zeros(2 * inner + 1))

    def leaves(self) -> list[int]:
        """The nodes that rows can end in."""
        out, there = [], {0}
        for k in range(len(self.value)):
            if k in there:
                if k < len(self.feature) and self.feature[k] >= 0:
                    there |= {2 * k + 1, 2 * k + 2}
                else:
                    out.append(k)
        return out


@dataclass
class Rule:
    depth: int
    min_rows: int
    quantile: float = 0.5
    rate: float = 0.1


@dataclass
class Rows:
    """y, the estimate so far, numbers by bin (a row for each feature), and levels (likewise; -1: none that counts)."""

    y: np.ndarray
    pred: np.ndarray
    num: np.ndarray
    cat: np.ndarray
    _joint: dict[int, list] = field(default_factory=dict, repr=False)

    def right(self, feature: int, code: int, at: np.ndarray | slice) -> np.ndarray:
        """Which rows go right: those over the bin, those of the level."""
        return self.num[feature][at] > code if feature < len(self.num) else self.cat[feature - len(self.num)][at] == code

    def pieces(self) -> Iterator[slice]:
        """ROWS of the rows at once, which stay in the processor's cache."""
        for i in range(0, len(self.y), ROWS):
            yield slice(i, i + ROWS)

    def move(self, tree: Tree, node: np.ndarray, first: int, last: int) -> None:
        """Sends the rows that are in a node from first to last, which is split, to the nodes under it."""
        split = [k for k in range(first, last + 1) if tree.feature[k] >= 0]
        for piece in self.pieces() if split else ():
            own = node[piece]
            for k in split:
                here = own == k
                step = here.astype(own.dtype)
                step *= k + 1
                step += here & self.right(int(tree.feature[k]), int(tree.code[k]), piece)
                own += step

    def leaf(self, tree: Tree) -> np.ndarray:
        node = self.root(len(tree.feature))
        self.move(tree, node, 0, len(tree.feature) - 1)
        return node

    def root(self, inner: int) -> np.ndarray:
        """The first node for all rows; inner: nodes that may be split."""
        return np.zeros(len(self.y), np.int8 if 2 * inner < 127 else np.int64)

    def joint(self, slots: int) -> list[tuple[list[int], list[int], np.ndarray]]:
        """Features, how many codes each has, and slots times their common codes: those of few codes are counted by together. A level's code is one more than its number."""
        if slots in self._joint or not len(self.y):
            return self._joint.get(slots, [])
        wide = [int(x.max()) + 1 for x in self.num] + [int(x.max()) + 2 for x in self.cat]
        groups, many = [], JOINT + 1
        for f in sorted((f for f in range(len(wide)) if wide[f] <= JOINT), key=lambda f: wide[f]):
            many *= wide[f]
            if many > JOINT:
                groups, many = [*groups, []], wide[f]
            groups[-1].append(f)
        out = self._joint[slots] = []
        for own in groups:
            codes = np.zeros(len(self.y), np.int64)
            for f in own:
                codes *= wide[f]
                codes += self.num[f] if f < len(self.num) else self.cat[f - len(self.num)] + 1
            codes *= slots
            out.append((own, [wide[f] for f in own], codes))
        return out


def gains(n: np.ndarray, p: np.ndarray, rows, above, min_rows: int) -> np.ndarray:
    """n, p: rows on one side, and those of them above the estimate. By how much a split tells the two apart; -1: a side has too few rows."""
    m, q = rows - n, above - p
    s, t = 2 * p - n, 2 * q - m
    d = m.astype(float) * s - n.astype(float) * t
    return np.where((n >= min_rows) & (m >= min_rows), d * d / np.maximum(n.astype(float) * m, 1), -1.0)


def split_of(kind: str, codes: np.ndarray, n: np.ndarray, p: np.ndarray, rows: int, above: int, min_rows: int) -> tuple[float, int]:
    """The best gain over a feature's codes, and the (first) code that has it; codes are in order."""
    if above in (0, rows) or rows < 2 * min_rows or not len(codes):
        return -1.0, -1
    g = gains(*((np.cumsum(n), np.cumsum(p)) if kind == "num" else (n, p)), rows, above, min_rows)
    k = int(g.argmax())
    return float(g[k]), int(codes[k]) if g[k] >= 0 else -1


def _sums(rows: Rows, own: np.ndarray, up: np.ndarray, nodes: int, depth: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """Rows of each node and those above; by feature, in order, keys (node and code), rows, rows above, only of keys that have rows.

    own: each row's node, `nodes` where it is in none of them.
    """
    slots, out, every = 2 * (2 ** (depth - 1) + 1), [], None
    base = own.astype(np.int64)
    base *= 2
    base += up
    for features, wide, codes in rows.joint(slots):
        n = np.zeros(slots * int(np.prod(wide)), np.int64)
        for piece in rows.pieces():
            n += np.bincount(codes[piece] + base[piece], minlength=len(n))
        n = n.reshape(*wide, slots // 2, 2)[..., :nodes, :]
        for k, f in enumerate(features):
            one = n.sum(axis=tuple(j for j in range(len(wide)) if j != k))
            every = one.sum(0) if every is None else every
            # of a category the first code is of rows that have none
            one = (one[1:] if f >= len(rows.num) else one).transpose(1, 0, 2)
            both = one.sum(2)
            node, code = np.nonzero(both)
            out.append((f, node * LEAF * LEAF + code, both[node, code], one[node, code, 1]))
    if every is None:
        every = np.bincount(base, minlength=slots)[:slots].reshape(-1, 2)[:nodes]
    counted, at = {x[0] for x in out}, None
    for f in range(len(rows.num) + len(rows.cat)):
        if f in counted or not len(own):
            continue
        at = np.flatnonzero(own < nodes) if at is None else at
        code = (rows.num[f] if f < len(rows.num) else rows.cat[f - len(rows.num)])[at].astype(np.int64)
        there = code >= 0
        key = own[at][there].astype(np.int64) * LEAF * LEAF + code[there]
        some, back = np.unique(key, return_inverse=True)
        out.append((f, some, np.bincount(back, minlength=len(some)), np.bincount(back, weights=up[at][there].astype(float), minlength=len(some)).astype(np.int64)))
    return every.sum(1), every[:, 1], sorted(out, key=lambda x: x[0])


def _level(node: np.ndarray, d: int, without: Iterable[int] = ()) -> np.ndarray:
    """Which of the nodes of level d each row is in; 2**d: in none, or in one of those left out."""
    first, nodes = 2**d - 1, 2**d
    place = np.full(first + nodes, nodes, node.dtype)
    place[first:] = np.arange(nodes)
    place[[k for k in without if k < len(place)]] = nodes
    return place[node]


def _ranks(n: int, quantile: float) -> tuple[int, int, float]:
    x = (n - 1) * quantile
    low = int(np.floor(x))
    return low, min(low + 1, n - 1), x - low


def _between(a: float, b: float, part: float) -> float:
    return a if a == b else (1 - part) * a + part * b


def guess(rows: Rows, pred: np.ndarray, rule: Rule, known: dict[int, tuple[int, int]]) -> Tree:
    """A tree over the sample; known: nodes whose split is settled (feature -1: none)."""
    tree, node, up = Tree.empty(rule.depth), rows.root(2**rule.depth - 1), rows.y >= pred
    for d in range(rule.depth):
        nodes, first = 2**d, 2**d - 1
        own = _level(node, d, known)
        best = {k: (-1.0, -1, -1) for k in range(nodes)}
        if any(first + k not in known for k in range(nodes)):
            total, above, sums = _sums(rows, own, up, nodes, rule.depth)
            for f, key, n, p in sums:
                part = key // (LEAF * LEAF)
                cuts = np.searchsorted(part, np.arange(nodes + 1))
                for k in range(nodes):
                    own_keys = slice(cuts[k], cuts[k + 1])
                    g, code = split_of("num" if f < len(rows.num) else "cat", key[own_keys] % (LEAF * LEAF), n[own_keys], p[own_keys], int(total[k]), int(above[k]), rule.min_rows)
                    if g > best[k][0]:
                        best[k] = (g, f, code)
        for k in range(nodes):
            f, code = known.get(first + k, best[k][1:])
            if f >= 0 and (d == 0 or tree.feature[(first + k - 1) // 2] >= 0):
                tree.feature[first + k], tree.code[first + k] = f, code
        rows.move(tree, node, first, first + nodes - 1)
    return tree


@dataclass
class Try:
    """A guessed tree, what of it is settled, and where its leaves' quantiles are looked for."""

    tree: Tree
    known: dict[int, tuple[int, int]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)
    edges: dict[int, np.ndarray] = field(default_factory=dict)
    #: Whether all splits are settled.
    shape: bool = False


def _look(rows: Rows, pred: np.ndarray, rule: Rule, t: Try) -> np.ndarray:
    """Leaf values by the sample, and edges near them; the estimate with the tree."""
    node, r = rows.leaf(t.tree), rows.y - pred
    for k in t.tree.leaves():
        if k in t.values:
            t.tree.value[k] = t.values[k]
            continue
        own = r[node == k]
        if len(own):
            low, high, part = _ranks(len(own), rule.quantile)
            step = max(1, int(len(own) ** 0.5) // 8) if len(own) > 2 * INTERVALS else 1
            near = low + step * np.arange(-INTERVALS // 2, INTERVALS // 2 + 1)
            # only the rows whose ranks are looked at are put in order
            of, to = max(int(near[0]), 0), min(max(int(near[-1]), high), len(own) - 1)
            own.partition([of, to])
            own[of : to + 1].sort()
            t.tree.value[k] = _between(own[low], own[high], part)
            if k not in t.edges:
                # where the sample has all rows, these two values alone are in an interval each
                two = own[[low, high]]
                t.edges[k] = np.unique(np.concatenate([own[np.clip(near, 0, len(own) - 1)], two, np.nextafter(two, np.inf)]))
        else:
            t.tree.value[k] = 0.0
        t.edges.setdefault(k, np.zeros(0))
    return pred + rule.rate * t.tree.value[node]


def _narrow(t: Try, leaf: int, n: np.ndarray, low: np.ndarray, high: np.ndarray, quantile: float) -> bool:
    """Whether the counts by interval, with least and largest values, settle a leaf's quantile; else its edges are set closer."""
    total = int(n.sum())
    if not total:
        t.values[leaf] = 0.0
        return True
    ends = np.cumsum(n)
    got, wide = [], []
    a, b, part = _ranks(total, quantile)
    for rank in (a, b):
        i = int(np.searchsorted(ends, rank, side="right"))
        if low[i] == high[i] or rank == ends[i] - n[i]:
            got.append(low[i])
        elif rank == ends[i] - 1:
            got.append(high[i])
        else:
            wide.append(i)
    if not wide:
        t.values[leaf] = float(_between(got[0], got[1], part))
        return True
    t.edges[leaf] = np.unique(np.concatenate([np.linspace(low[i], high[i], INTERVALS + 1)[:-1] for i in {*wide}] + [[high[i] for i in {*wide}]]))
    return False


def made(wait: list[pa.RecordBatch]) -> Rows:
    x = pa.concat_batches(wait)

    def packed(name: str, kind: type) -> np.ndarray:
        at = np.frombuffer(x.column(name).buffers()[1], np.int32)[: x.num_rows + 1]
        flat = (x.column(name).buffers()[2] or pa.py_buffer(b""))[int(at[0]) : int(at[-1])].to_pybytes()
        return np.frombuffer(flat, kind).reshape(x.num_rows, -1).T.copy()

    return Rows(x.column("y").to_numpy(), x.column("pred").to_numpy().copy(), packed("num", np.uint8), packed("cat", np.int32))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
    """The rows of a task, ROWS at once."""
    wait, have = [], 0
    for batch in batches:
        wait.append(batch)
        have += batch.num_rows
        if have >= ROWS:
            yield made(wait)
            wait, have = [], 0
    if have:
        yield made(wait)


def sampled(table: DataFrame, n: int, seed: int) -> Rows:
    """About GUESS rows of a table of n, or all of them."""
    if n > GUESS:
        lot = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.lit(1_000_000_000))
        table = table.where(lot < int(1_000_000_000 * GUESS / n))
    return made(table.select("y", "pred", "num", "cat").toArrow().combine_chunks().to_batches())


class _Gathered:
    """Sums of a task by tree, node, feature and piece; levels: how many each category has."""

    def __init__(self, n_num: int, levels: Sequence[int], depth: int = 1) -> None:
        self.n_num, self.levels, self.depth = n_num, levels, depth
        self.parts: dict[tuple[int, int, int, int], list] = {}
        self.totals: dict[tuple[int, int], np.ndarray] = {}
        self.leaves: dict[tuple[int, int], list[np.ndarray]] = {}

    def level(self, tree: int, rows: Rows, node: np.ndarray, up: np.ndarray, d: int, known: Iterable[int] = ()) -> None:
        """known: nodes that needn't be summed up."""
        nodes, first = 2**d, 2**d - 1
        own = _level(node, d, known)
        if all(first + k in {*known} for k in range(nodes)):
            return
        total, above, sums = _sums(rows, own, up, nodes, self.depth)
        for k in np.flatnonzero(total).tolist():
            self.totals[tree, first + k] = self.totals.get((tree, first + k), 0) + np.array([total[k], above[k]])
        for f, key, n, p in (x for x in sums if len(x[1])):
            node_of, code = key // (LEAF * LEAF), key % (LEAF * LEAF)
            mark = node_of * LEAF + code // PIECE
            cut = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1]]))
            for i, j in zip(cut, [*cut[1:], len(mark)], strict=True):
                self._add((tree, first + int(node_of[i]), f, int(code[i]) // PIECE), code[i:j], n[i:j], p[i:j])

    def _add(self, key: tuple[int, int, int, int], code: np.ndarray, n: np.ndarray, p: np.ndarray) -> None:
        part = self.parts.setdefault(key, [])
        part.append((code, n, p))
        if len(part) > 8:
            self.parts[key] = [merged(part)]

    def leaf(self, tree: int, leaf: int, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        if (was := self.leaves.get((tree, leaf))) is not None:
            n, low, high = was[0] + n, np.minimum(was[1], low), np.maximum(was[2], high)
        self.leaves[tree, leaf] = [n, low, high]

    def rows(self) -> Iterator[tuple]:
        none = (np.zeros(0, np.int64),) * 3
        for tree, node in self.totals:
            for f, many in enumerate(self.levels, self.n_num):
                for piece in range(-(-many // PIECE)):
                    # a node's rows count for all its pieces, also for those of which none is here
                    self.parts.setdefault((tree, node, f, piece), [none])
        for (tree, node, f, piece), part in self.parts.items():
            yield tree, node, f, piece, *self.totals[tree, node].tolist(), *(np.ascontiguousarray(x, np.int64).tobytes() for x in merged(part))
        for (tree, leaf), (n, low, high) in self.leaves.items():
            yield tree, LEAF + leaf, -1, 0, int(n.sum()), 0, high.tobytes(), n.astype(np.int64).tobytes(), low.tobytes()


def merged(part: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if len(part) == 1:
        return part[0]
    code, n, p = (np.concatenate(x) for x in zip(*part, strict=True))
    order = np.argsort(code, kind="stable")
    code = code[order]
    cut = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return code[cut], np.add.reduceat(n[order], cut), np.add.reduceat(p[order], cut)


_SUMS = pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("piece", pa.int32()), ("rows", pa.int64()), ("above", pa.int64()), ("codes", pa.binary()), ("n", pa.binary()), ("p", pa.binary())])
_TREE = pa.schema([("tree", pa.int32()), ("feature", pa.list_(pa.int64())), ("code", pa.list_(pa.int64())), ("value", pa.list_(pa.float64()))])
_BEST = pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("code", pa.int64()), ("gain", pa.float64()), ("high", pa.binary()), ("n", pa.binary()), ("low", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _summed(done: list[Tree], tries: list[Try], rule: Rule, n_num: int, levels: Sequence[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Gathered(n_num, levels, rule.depth)
        for rows in _read(batches):
            pred = rows.pred
            for tree in done:
                pred = pred + rule.rate * tree.value[rows.leaf(tree)]
            for number, t in enumerate(tries):
                up, node, r = rows.y >= pred, rows.root(2**rule.depth - 1), rows.y - pred
                for d in range(rule.depth):
                    if not t.shape:
                        out.level(number, rows, node, up, d, t.known)
                    rows.move(t.tree, node, 2**d - 1, 2 ** (d + 1) - 2)
                for k, edges in t.edges.items():
                    if k in t.values:
                        continue
                    own = np.sort(r[node == k])
                    n = np.diff(np.concatenate([[0], np.searchsorted(own, edges, side="left"), [len(own)]]))
                    some, to, low, high = n > 0, np.cumsum(n), np.full(len(n), np.inf), np.full(len(n), -np.inf)
                    low[some], high[some] = own[(to - n)[some]], own[to[some] - 1]
                    out.leaf(number, k, n, low, high)
                pred = pred + rule.rate * t.tree.value[node]
        wait = []
        for row in out.rows():
            wait.append(row)
            if len(wait) >= 500:
                yield _batch(wait, _SUMS)
                wait = []
        if wait:
            yield _batch(wait, _SUMS)

    return run


def _best(n_num: int, rule: Rule) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over sums sorted by tree, node, feature and piece, the best split of each of them; leaves' counts put together."""

    def found(key: tuple, wait: list[tuple]) -> tuple:
        tree, node, f, _ = key
        ints = lambda b: np.frombuffer(b, np.int64)
        if f < 0:
            n = sum(ints(w[3]) for w in wait)
            low = np.minimum.reduce([np.frombuffer(w[4]) for w in wait])
            high = np.maximum.reduce([np.frombuffer(w[2]) for w in wait])
            return tree, node, f, -1, -1.0, high.tobytes(), n.tobytes(), low.tobytes()
        codes, n, p = merged([(ints(w[2]), ints(w[3]), ints(w[4])) for w in wait])
        gain, code = split_of("num" if f < n_num else "cat", codes, n, p, sum(w[0] for w in wait), sum(w[1] for w in wait), rule.min_rows)
        return tree, node, f, code, gain, None, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, wait, out = None, [], []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in batch.schema.names]
            for row in zip(*columns, strict=True):
                if row[:4] != key:
                    if wait:
                        out.append(found(key, wait))
                    key, wait = row[:4], []
                wait.append(row[4:])
            if len(out) >= 1000:
                yield _batch(out, _BEST)
                out = []
        if wait:
            out.append(found(key, wait))
        if out:
            yield _batch(out, _BEST)

    return run


@dataclass
class Boosted:
    start: float
    trees: list[Tree]
    #: How many jobs the trees took, and how many trees were guessed.
    jobs: int = 0
    guesses: int = 0


def grown(table: DataFrame, start: float, trees: int, rule: Rule) -> Boosted:
    """As boost, of a table of few rows (GUESS at most): one task has all of them, so it guesses right and nothing is asked."""
    inner, out = 2**rule.depth - 1, Boosted(start, [], jobs=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = made([*batches])
        pred = rows.pred
        for number in range(trees):
            tree = guess(rows, pred, rule, {})
            node, r = rows.leaf(tree), rows.y - pred
            for k in tree.leaves():
                own = r[node == k]
                if len(own):
                    low, high, part = _ranks(len(own), rule.quantile)
                    own.partition([low, high])
                    tree.value[k] = _between(own[low], own[high], part)
            pred = pred + rule.rate * tree.value[node]
            yield _batch([(number, tree.feature.tolist(), tree.code.tolist(), tree.value.tolist())], _TREE)

    for r in table.select("y", "pred", "num", "cat").repartition(1).mapInArrow(run, "tree int, feature array<long>, code array<long>, value array<double>").collect():
        out.trees.append(Tree(np.array(r["feature"], np.int64).reshape(inner), np.array(r["code"], np.int64).reshape(inner), np.array(r["value"])))
    return out


def boost(table: DataFrame, sample: Rows, start: float, trees: int, rule: Rule, levels: Sequence[int], ahead: int = AHEAD) -> Boosted:
    """table: y, pred (all of them start), num (bytes) and cat (int32s) of each row, staged; sample: of its rows; levels: of each category.

    ahead: trees to guess at once at most; it changes the number of jobs, and nothing else.
    """
    out, spark = Boosted(start, []), table.sparkSession
    written, at_once, pred = 0, min(4, ahead), np.full(len(sample.y), start)
    first: Try | None = None  # what is known of the next tree
    ready: tuple[list[Try], np.ndarray] | None = None

    def guessed(pred: np.ndarray, many: int, first: Try | None = None) -> tuple[list[Try], np.ndarray]:
        tries = []
        for k in range(many):
            t = first if k == 0 and first else Try(guess(sample, pred, rule, {}))
            pred = _look(sample, pred, rule, t)
            tries.append(t)
        return tries, pred

    with cleaned(spark), ThreadPoolExecutor(1) as other:
        while len(out.trees) < trees:
            if len(out.trees) - written >= max(WRITE, 2 * at_once):
                table = stage(_moved(table, out.trees[written:], rule), "boosted")
                written = len(out.trees)
            tries, then = ready or guessed(pred, min(at_once, trees - len(out.trees)), first)
            asked = other.submit(_ask, table, out.trees[written:], tries, rule, len(sample.num), levels)
            # while that job runs, and if guesses have been right, the trees after these
            after = min(ahead, 2 * at_once, trees - len(out.trees) - len(tries)) if out.jobs and not first else 0
            ready = guessed(then, after) if after > 0 else None
            splits, leaves = asked.result()
            out.jobs, out.guesses, first, right = out.jobs + 1, out.guesses + len(tries), None, 0
            for number, t in enumerate(tries):
                if not _settled(t, number, splits, leaves, rule):
                    first = t if t.shape else Try(guess(sample, pred, rule, t.known), t.known)
                    break
                # settled, maybe with other values than those that later trees were guessed on
                was = t.tree.value.copy()
                for leaf, v in t.values.items():
                    t.tree.value[leaf] = v
                out.trees.append(t.tree)
                pred = pred + rule.rate * t.tree.value[sample.leaf(t.tree)]
                right += 1
                if not np.array_equal(was, t.tree.value):
                    break
            else:
                at_once = min(ahead, 2 * at_once)
                continue
            at_once, ready = max(1, right), None
    return out


def _moved(table: DataFrame, trees: list[Tree], rule: Rule) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _read(iter([batch])):
                for tree in trees:
                    rows.pred = rows.pred + rule.rate * tree.value[rows.leaf(tree)]
                yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(rows.pred), batch.column("num"), batch.column("cat")], names=["y", "pred", "num", "cat"])

    return table.select("y", "pred", "num", "cat").mapInArrow(run, "y double, pred double, num binary, cat binary")


def _ask(table: DataFrame, done: list[Tree], tries: list[Try], rule: Rule, n_num: int, levels: Sequence[int]) -> tuple[dict, dict]:
    """Over all rows: by tree and node the best split, by tree and leaf the counts. A row for each node and leaf reaches the driver."""
    sums = table.select("y", "pred", "num", "cat").mapInArrow(_summed(done, tries, rule, n_num, levels), SUMS)
    own = sums.repartition("tree", "node", "feature", "piece").sortWithinPartitions("tree", "node", "feature", "piece")
    best = own.mapInArrow(_best(n_num, rule), "tree int, node int, feature int, code long, gain double, high binary, n binary, low binary")
    one = best.groupBy("tree", "node").agg(F.max(F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("code")).alias("c"))).alias("x"), *[F.first(c, ignorenulls=True).alias(c) for c in ("n", "low", "high")])
    splits, leaves = {}, {}
    for r in one.collect():
        if r["node"] >= LEAF:
            leaves[r["tree"], r["node"] - LEAF] = (np.frombuffer(r["n"], np.int64), np.frombuffer(r["low"]), np.frombuffer(r["high"]))
        else:
            gain, f, c = r["x"]
            splits[r["tree"], r["node"]] = (-f, -c) if gain >= 0 else (-1, -1)
    return splits, leaves


def _settled(t: Try, number: int, splits: dict, leaves: dict, rule: Rule) -> bool:
    """Takes what the sums say about a tree into it; whether all of it is settled. All trees before it are."""
    if not t.shape:
        inner = len(t.tree.feature)
        there, right = {0}, True
        for k in range(inner):
            if k not in there:
                continue
            if k not in t.known:
                t.known[k] = splits.get((number, k), (-1, -1))
            if t.known[k] != (int(t.tree.feature[k]), int(t.tree.code[k])):
                right = False  # what is below was summed up for other rows
            elif t.known[k][0] >= 0:
                there |= {2 * k + 1, 2 * k + 2}
        t.shape = right
        if not right:
            return False
    return all([leaf in t.values or _narrow(t, leaf, *leaves[number, leaf], rule.quantile) for leaf in t.tree.leaves()])
