"""Quality by pairwise ranking (Bradley-Terry).

A document is described by its surface: shares of kinds of characters and words, repeats, lengths. Of two labelled documents
the better one is preferred with a probability that is the logistic function of the difference of their scores; scores are
linear in the features, learnt from pairs by logistic loss on the differences of features. A quantile of the learnt scores
is the threshold, and scores are shifted so that it lies where the caller wants it.

Every labelled document is learnt from. They are dealt into blocks that have both classes, pairs are drawn inside a block,
and each step of Newton's method sums loss, gradient and second derivatives over the pairs of all blocks. The threshold is
found among the distinct scores of all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramo.llm.buffers import joined, owners, runs
from tramo.llm.staging import drop_staged, small, small_batches, stage, unused
from tramo.llm.units import pieces
from tramo.operators.ranking import numbered, running_sums
from tramo.tables import cleaned

#: Labelled documents of the larger class in a block.
BLOCK = 2048
#: Documents of the smaller class that a block has, about, at least (all if they are fewer): in several blocks if need be.
OTHERS = 64
#: Pairs that each labelled document is in at least.
PAIRS = 8
PULL = 1e-3

UPPER, LOWER, DIGIT, SPACE, LINE, STOP, BANG, PIPE, OTHER, HIGH = range(10)
KINDS = 10
KIND = np.full(256, OTHER, np.uint8)
KIND[0x41:0x5B], KIND[0x61:0x7B], KIND[0x30:0x3A], KIND[0x80:] = UPPER, LOWER, DIGIT, HIGH
KIND[[0x20, 0x09, 0x0B, 0x0C]], KIND[[0x0A, 0x0D]] = SPACE, LINE
KIND[[ord(c) for c in ".,;:'\"-?()"]], KIND[ord("!")], KIND[ord("|")] = STOP, BANG, PIPE
_ODD = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_TURN = np.random.default_rng(6).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
FEATURES = 24


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES numbers for each text; an empty one has zeros."""
    flat, at = joined(texts)
    n = len(at) - 1
    size = np.diff(at)
    kind = KIND[flat]
    kinds = np.bincount(np.repeat(np.arange(n) * KINDS, size) + kind, minlength=n * KINDS).reshape(n, KINDS).astype(float)
    starts, ends = runs((kind != SPACE) & (kind != LINE), at)
    doc = owners(starts, at)
    words = np.bincount(doc, minlength=n).astype(float)
    of = lambda x: np.bincount(doc[x], minlength=n).astype(float)
    if len(starts):
        long = ends - starts
        span = np.arange(int(long.sum())) - np.repeat(np.cumsum(long) - long, long)
        where = np.repeat(starts, long) + span
        inside = kind[where]
        begin = np.cumsum(long) - long
        count = lambda k: np.add.reduceat((inside == k).astype(np.int64), begin)
        upper, lower, high = count(UPPER), count(LOWER), count(HIGH)
        letters = upper + lower + high
        # equal words have equal marks; one more or less by chance doesn't matter
        mark = np.add.reduceat(_ODD[flat[where]] * _TURN[span % 64], begin)
        mark ^= mark >> np.uint64(29)
        again = np.concatenate([[False], (mark[1:] == mark[:-1]) & (doc[1:] == doc[:-1])])
        order = np.lexsort((mark, doc))
        m, d = mark[order], doc[order]
        new = np.concatenate([[True], (m[1:] != m[:-1]) | (d[1:] != d[:-1])])
        types = np.bincount(d[new], minlength=n).astype(float)
        last, last2 = kind[ends - 1], kind[np.maximum(ends - 2, starts)]
        shout = (upper > 1) & (lower == 0)
        tail = (last == OTHER) & (letters > 0)
        tail2 = tail & (last2 == OTHER)
        bare = letters == 0
        alone = (long == 1) & bare
        bang2 = (last == BANG) & (last2 == BANG)
        pipe = (last == PIPE) & (long == 1)
        lengths = np.bincount(doc, weights=np.minimum(long, 64), minlength=n)
        wide = long > 24
    else:
        types = lengths = np.zeros(n)
        again = shout = tail = tail2 = bare = alone = bang2 = pipe = wide = np.zeros(0, bool)
    chars = size.astype(float)
    letters_all = kinds[:, UPPER] + kinds[:, LOWER] + kinds[:, HIGH]
    root = np.sqrt
    out = np.stack(
        [
            np.log1p(words), np.log1p(types), root(_share(types, words)), np.log1p(_share(words, types)),
            root(_share(of(again), words)), root(_share(of(shout), words)), root(_share(of(tail), words)), root(_share(of(tail2), words)),
            root(_share(of(bare), words)), root(_share(of(alone), words)), root(_share(of(bang2), words)), root(_share(of(pipe), words)),
            root(_share(of(wide), words)), _share(lengths, words) / 10, root(_share(kinds[:, UPPER], letters_all)), root(_share(kinds[:, DIGIT], chars)),
            root(_share(kinds[:, STOP], chars)), root(_share(kinds[:, BANG], chars)), root(_share(kinds[:, PIPE], chars)), root(_share(kinds[:, OTHER], chars)),
            root(_share(kinds[:, LINE], words)), root(_share(kinds[:, HIGH], chars)), root(_share(kinds[:, SPACE], chars)), np.log1p(_share(words, kinds[:, LINE])) / 4,
        ], axis=1,
    )
    return np.where(words[:, None] > 0, out, 0.0)


@dataclass
class Model:
    weight: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    cut: float
    at: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (((x - self.mean) / self.spread) * self.weight).sum(axis=1)  # a row's sum doesn't depend on the rows beside it

    def score(self, x: np.ndarray) -> np.ndarray:
        """at where the raw score is the threshold; the difference of two scores' log-odds is what a pair's probability has."""
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.cut + np.log(self.at / (1 - self.at)), -30, 30)))


def pair_sums(d: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Over differences d of features: their number, the sums of the loss, its gradient and its second derivatives at w."""
    m = d @ w
    p = 1 / (1 + np.exp(np.clip(m, -30, 30)))
    return np.concatenate([[len(d), np.logaddexp(0, -m).sum()], -(d * p[:, None]).sum(0), ((d * (p * (1 - p))[:, None]).T @ d).ravel()])


def newton(sums: Callable[[np.ndarray], np.ndarray], k: int, pull: float = PULL, steps: int = 60) -> np.ndarray:
    """The k weights with the least mean loss, drawn to 0 by pull; sums: pair_sums of all pairs at given weights.

    Weights are rounded to a millionth, so that they don't depend on the order in which sums were added up.
    """

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        s = sums(w)
        s = s[1:] / s[0]
        return s[0] + pull / 2 * w @ w, s[1 : k + 1] + pull * w, s[k + 1 :].reshape(k, k) + pull * np.eye(k)

    w = np.zeros(k)
    now, grad, hess = at(w)
    for _ in range(steps):
        step, size = np.linalg.solve(hess, grad), 1.0
        if np.abs(step).max() < 1e-7:
            w = w - step
            break
        then = at(w - step)
        while then[0] > now + 1e-12 and size > 1e-6:
            size /= 2
            then = at(w - size * step)
        w, (now, grad, hess) = w - size * step, then
    return np.round(w, 6)


def bradley_terry(better: np.ndarray, worse: np.ndarray, pull: float = PULL, steps: int = 60) -> np.ndarray:
    """The weights that minimise the mean of log(1 + exp(-w (x - y))) over the rows x of better and y of worse, drawn to 0 by pull."""
    d = better - worse
    return newton(lambda w: pair_sums(d, w), d.shape[1], pull, steps)


def pairs(n_better: int, n_worse: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of which each one is in PAIRS at least (all pairs if they are fewer), drawn by seed."""
    if n_better * n_worse <= PAIRS * max(n_better, n_worse):
        return np.repeat(np.arange(n_better), n_worse), np.tile(np.arange(n_worse), n_better)
    rng, m = np.random.default_rng(seed), PAIRS * max(n_better, n_worse)
    deal = lambda n: np.concatenate([rng.permutation(n) for _ in range(-(-m // n))])[:m]
    return deal(n_better), deal(n_worse)


def middle_cut(value: np.ndarray, following: np.ndarray, low: np.ndarray, high: np.ndarray, n_low: float, n_high: float) -> float:
    """Between a value and the following one, where the two classes' mean share of right answers is largest; in the middle of all such.

    low, high: rows of the classes up to the value, of n_low and n_high.
    """
    right = (low / max(n_low, 1e-300) + 1 - high / max(n_high, 1e-300)) / 2
    best = np.flatnonzero(right >= right.max() - 1e-12)
    k = best[len(best) // 2]
    return float((value[k] + following[k]) / 2)


def threshold(raw: np.ndarray, label: np.ndarray, weight: np.ndarray) -> float:
    """The cut at one of 1,000 quantiles of raw scores, or under the highest one, at which the most is right (middle_cut)."""
    s, group = np.unique(raw, return_inverse=True)
    if len(s) == 1:
        return float(s[0]) - 1e-9
    low, high = (np.cumsum(np.bincount(group, weights=weight * (label == k), minlength=len(s))) for k in (0, 1))
    rank = np.floor(1000 * (low + high) / (low[-1] + high[-1]))
    at = np.flatnonzero(np.diff(rank[:-1], prepend=0) > 0)
    at = np.union1d(at, len(s) - 2)
    return middle_cut(s[at], s[at + 1], low[at], high[at], low[-1], high[-1])


def _scale(mean: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rounded, so that they don't depend on the order of sums."""
    return np.round(mean, 9), np.maximum(np.round(spread, 9), 1e-6)


def _level(mean: np.ndarray, spread: np.ndarray, at: float) -> Model:
    """Every score is `at` and a hair more."""
    return Model(np.zeros(FEATURES), mean, spread, -1e-9, at)


def learn(x: np.ndarray, label: np.ndarray, weight: np.ndarray, at: float = 0.3) -> Model:
    """What fit learns from the rows of one block, by plain code. x: features; label: 1 or 0; weight: rows that each stands for.

    Without both classes every score is `at` and a hair more.
    """
    mean, spread = _scale(x.mean(0), x.std(0)) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    if len(x) < 3 or label.min() == label.max():
        return _level(mean, spread, at)
    z = (x - mean) / spread
    good, bad = z[label == 1], z[label == 0]
    i, j = pairs(len(good), len(bad))
    model = Model(bradley_terry(good[i], bad[j]), mean, spread, 0.0, at)
    model.cut = threshold(model.raw(x), label, weight)
    return model


def described(docs: DataFrame, text_col: str = "text", name: str = "features") -> DataFrame:
    """docs with the features of the text instead of it."""
    names = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            x = features(batch.column(text_col))
            column = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, FEATURES, dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], column], names=[*names, name])

    fields = [f for f in docs.schema.fields if f.name != text_col]
    return docs.select(*names, text_col).mapInArrow(run, T.StructType([*fields, T.StructField(name, T.ArrayType(T.DoubleType()))]))


def weighed(rows: DataFrame, value: Callable[[np.ndarray], np.ndarray], column: str = "features", name: str = "score") -> DataFrame:
    """rows with a number for their features instead of them."""
    names = [c for c in rows.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(value(x), pa.float64())], names=[*names, name])

    fields = [f for f in rows.schema.fields if f.name != column]
    return rows.select(*names, column).mapInArrow(run, T.StructType([*fields, T.StructField(name, T.DoubleType())]))


def blocks(rows: DataFrame, n: dict[int, int]) -> DataFrame:
    """rows: id, label, features; n: rows of each label. block and its rows, by id: each row of the larger class is in one
    block, each of the smaller in as many as it takes that all blocks have OTHERS of it (or all of it)."""
    most, least = max(n.values()), min(n.values())
    many = max(1, -(-most // BLOCK))
    copies = min(many, max(1, -(-OTHERS * many // least)))
    times = F.when(F.col("label") == (0 if n[0] <= n[1] else 1), copies).otherwise(1)
    rows = numbered(rows.withColumn("lot", F.xxhash64("id", F.lit(12))), ["label", "lot", "id"])
    at = F.when(F.col("label") == 1, F.col("at") - n[0]).otherwise(F.col("at"))
    turn = F.explode(F.transform(F.sequence(F.lit(0), times - 1), lambda t: F.pmod(at + F.floor(t * F.lit(many) / times).cast("long"), F.lit(many))))
    dealt = rows.select(turn.alias("block"), F.struct("id", "label", "features").alias("row"))
    return dealt.groupBy("block").agg(F.sort_array(F.collect_list("row")).alias("rows"))


def _sums(dealt: DataFrame, mean: np.ndarray, spread: np.ndarray, w: np.ndarray) -> np.ndarray:
    """pair_sums at w over the pairs of all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + FEATURES + FEATURES**2)
        for batch in batches:
            for rows in batch.column("rows"):
                x = rows.values.field("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
                label, z = rows.values.field("label").to_numpy(zero_copy_only=False), (x - mean) / spread
                good, bad = z[label == 1], z[label == 0]
                i, j = pairs(len(good), len(bad))
                total += pair_sums(good[i] - bad[j], w)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

    parts = dealt.select("rows").mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("k", "x"))
    return np.array([r["x"] for r in parts.groupBy("k").agg(F.sum("x").alias("x")).orderBy("k").collect()])


def _cut(raw: DataFrame) -> float:
    """The threshold of raw (raw, label), as `threshold` has it; at most 1,000 distinct scores reach the driver."""
    one = lambda k: F.sum((F.col("label") == k).cast("long"))
    values = stage(raw.groupBy("raw").agg(one(0).alias("low"), one(1).alias("high")), "values")
    n = values.agg(F.count(F.lit(1)).alias("rows"), F.sum("low").alias("low"), F.sum("high").alias("high"), F.max("raw").alias("top")).first()
    if n["rows"] == 1:
        return n["top"] - 1e-9
    line = numbered(values, ["raw"])
    upto = running_sums(line, "at", n["rows"], {"lows": "low", "highs": "high"})
    seen, own, total = F.col("lows") + F.col("highs"), F.col("low") + F.col("high"), F.lit(n["low"] + n["high"])
    rank = lambda c: F.floor(1000 * c / total)
    picked = upto.where((F.col("at") < n["rows"] - 1) & ((rank(seen) > rank(seen - own)) | (F.col("at") == n["rows"] - 2)))
    picked = stage(picked.select("at", "raw", "lows", "highs"), "picked")  # 1,000 rows at most
    following = line.select((F.col("at") - 1).alias("at"), F.col("raw").alias("following"))
    got = following.join(F.broadcast(picked), "at").orderBy("at").select("raw", "following", "lows", "highs").collect()
    return middle_cut(*np.array(got, float).T, n["low"], n["high"])


def fit_described(rows: DataFrame, labels: DataFrame, at: float = 0.3) -> Model:
    """rows: id, features (written, read more than once); labels: id, label. Of labels with the same id the largest counts;
    null ones and null ids don't. Sums of a fixed size and 1,000 scores at most reach the driver."""
    spark = rows.sparkSession
    with cleaned(spark), small_batches(spark):
        known = labels.where("label in (0, 1) and id is not null").groupBy("id").agg(F.max("label").alias("label"))
        known = stage(known, "labels")
        # of documents with one id, one counts
        taught = rows.join(small(known), "id").groupBy("id", "label").agg(F.min("features").alias("features"))
        taught = stage(taught, "taught")
        n = {0: 0, 1: 0} | {r["label"]: r["n"] for r in taught.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not sum(n.values()):
            return _level(np.zeros(FEATURES), np.ones(FEATURES), at)
        column = [F.col("features")[k] for k in range(FEATURES)]
        got = taught.agg(*[F.avg(c) for c in column], *[F.stddev_pop(c) for c in column]).first()
        mean, spread = _scale(np.array(got[:FEATURES]), np.array(got[FEATURES:]))
        if sum(n.values()) < 3 or not min(n.values()):
            return _level(mean, spread, at)
        dealt = stage(blocks(taught, n), "blocks")
        model = Model(newton(lambda w: _sums(dealt, mean, spread, w), FEATURES), mean, spread, 0.0, at)
        model.cut = _cut(weighed(taught.select("label", "features"), model.raw, name="raw"))
        return model


def _named(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    return labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", at: float = 0.3) -> Model:
    """labels: id and 0 or 1 of what to learn from; all of them are."""
    with cleaned(docs.sparkSession):
        rows = stage(described(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))), "described")
        return fit_described(rows, _named(labels, id_col, label_col), at)


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with its score from 0 to 1 instead of the text; null and empty texts have the features of an empty one."""
    column = unused(docs, "features")
    return weighed(described(docs, text_col, column), model.score, column, name)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, at: float = 0.3) -> DataFrame:
    """id, held_out, score, predicted (1: the score is `at` or more) of every row of docs. Labels of the held-out fold aren't learnt from.

    A null id isn't held out. Rows that repeat an id are scored each. Columns other than id and text are not read.
    """
    out = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))
    # every text is read once: its features are what is learnt from and what is scored
    rows = stage(described(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))), "described")
    model = fit_described(rows, _named(labels.where(~out), id_col, label_col), at)
    scored = stage(weighed(rows, model.score).withColumnRenamed("id", id_col), "scored")
    drop_staged(rows)
    return scored.select(id_col, out.alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"))
