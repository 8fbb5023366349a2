"""Toxicity with noisy-channel deobfuscation.

A character language model is counted over all documents. Writing that may hide a word (digits and signs for letters,
letters spaced out or repeated) becomes a lattice of the characters it may stand for; the Viterbi path under the language
model and the costs of each disguise is the restored text. Restored words and their beginnings are the features of a
log-odds model learnt from labelled documents; a logistic curve over a document's evidence gives the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramo.llm.exact_dedup import sha256, without
from tramo.llm.staging import quoted, small_batches, stage
from tramo.llm.units import Lists, Memo, gather, lists, pieces

#: Bounds of the samples of labelled rows: those that features are counted on, and those that the curve is fitted on.
MAX_LABELLED, MAX_CURVE = 200_000, 40_000
FEATURES = 1 << 18
#: Signs and digits without a letter between them that may be a word.
LONGEST = 16
#: Rows of prior evidence for a feature, and the log-odds from which a feature counts.
PRIOR, LEAST = 10.0, 1.2
#: Costs (nats): a sign for a letter, a dropped sign or one as a boundary (digits twice that), a run cut short, a gap left open between spaced letters.
SIGN, DROP, RUN, GAP = 1.0, 5.0, 0.5, 1.0

# Letters of the model's alphabet, and what signs may stand for.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøœßùúûüÿ"
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}

A = len(LETTERS) + 2  # 0: boundary; the last: any other letter
_CODE = {c: i + 1 for i, c in enumerate(LETTERS)}
_TABLE = np.array([_CODE.get(chr(i), A - 1 if chr(i).isalpha() else 0) for i in range(0x250)], np.int64)
_EDGES = ".,;:!?\"'`´()[]{}<>«»“”‘’…*#%&~^=/\\_-–—"
_RUN = re.compile(r"([^\W\d_])\1\1")
_WORD = re.compile(r"[^\W\d_]+")


def letters(text: str) -> np.ndarray:
    """Codes of the model's alphabet; what lies between words is one boundary, also before and after all."""
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(code < 0x250, _TABLE[np.minimum(code, 0x24F)], A - 1)
    return code[np.concatenate([[True], (code[1:] != 0) | (code[:-1] != 0)])]


def count_letters(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Trigrams of all documents. The driver gets a row for each trigram that occurs, A ** 3 at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(A**3, np.int64)
        for batch in pieces(batches):
            code = letters(" ".join(t or "" for t in batch.column("text").to_pylist()))
            total += np.bincount((code[:-2] * A + code[1:-1]) * A + code[2:], minlength=A**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"gram": at, "n": total[at]})

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    out = np.zeros(A**3)
    with small_batches(docs.sparkSession):
        for r in rows.collect():
            out[r["gram"]] = r["n"]
    return out.reshape(A, A, A)


def costs(grams: np.ndarray) -> np.ndarray:
    """-log P(c | a, b) at [a, b, c], smoothed by the bigram's and the letter's."""
    one = (grams.sum((0, 1)) + 1) / (grams.sum() + A)
    pairs = grams.sum(0)
    two = (pairs + 5 * one) / (pairs.sum(1, keepdims=True) + 5)
    return -np.log((grams + 5 * two) / (grams.sum(2, keepdims=True) + 5)).astype(np.float32)


class Channel:
    def __init__(self, cost: np.ndarray):
        self.cost = cost.tolist()

    def decode(self, cells: Sequence[str]) -> str:
        """The likeliest text behind cells: characters, and '' for the gap between spaced ones."""
        best: list[dict[tuple[int, int], tuple[float, str]]] = [{} for _ in range(len(cells) + 1)]
        best[0][0, 0] = (0.0, "")
        for i, c in enumerate(cells):
            for stop, said, extra in self._arcs(cells, i, c):
                for (a, b), (cost, text) in best[i].items():
                    x, y, total, out = a, b, cost + extra, text
                    for s in said:
                        code = 0 if s == " " else _CODE.get(s, A - 1)
                        if code or y:
                            total += self.cost[x][y][code]
                            x, y = y, code
                            out += s
                    if (x, y) not in best[stop] or total < best[stop][x, y][0]:
                        best[stop][x, y] = (total, out)
            best[i] = {}
        ends = [(cost + (self.cost[a][b][0] if b else 0), text) for (a, b), (cost, text) in best[-1].items()]
        return min(ends)[1].strip() if ends else ""

    @staticmethod
    def _arcs(cells: Sequence[str], i: int, c: str) -> Iterator[tuple[int, str, float]]:
        if c == "":
            yield i + 1, " ", GAP
            yield i + 1, "", 0.0
        elif c.isalpha():
            yield i + 1, c, 0.0
            stop = i + 1
            while stop < len(cells) and cells[stop] == c:
                stop += 1
            if stop - i > 2 and (not i or cells[i - 1] != c):
                yield stop, c, RUN
                yield stop, c + c, RUN
        else:
            for s in SIGNS.get(c, ""):
                yield i + 1, s, SIGN
            drop = 2 * DROP if c.isdigit() else DROP if c in SIGNS else SIGN
            yield i + 1, "", drop
            yield i + 1, " ", drop if c in SIGNS else 0.0

    def restore(self, unit: str) -> str:
        """A unit without white space, restored; most have one path only and need no lattice."""
        low = unit.lower()
        core = low.rstrip(_EDGES).lstrip(_EDGES)
        # a bracket that isn't closed may be a letter
        if core.isalpha() and not _RUN.search(core) and not (low[0] == "(" and ")" not in low):
            return core
        core = low.strip(".,;:?\"'`´*#%&~^=/\\_-–—[]{}<>«»“”‘’…")
        if any(c.isalpha() for c in core):
            return self.decode(core.rstrip("!()"))
        # signs and digits only: a word if each may stand for a letter
        core = core.rstrip("!)").lstrip("(")
        return self.decode(core) if 2 < len(core) <= LONGEST and all(c in SIGNS for c in core) else ""

    def restore_spaced(self, units: Sequence[str]) -> str:
        return self.decode([c for u in units for c in (u.lower()[0], "")][:-1])


def _is_single(unit: str) -> bool:
    """A letter or sign by itself, maybe with a mark after it."""
    return len(unit.rstrip(_EDGES)) == 1 and (unit[0].isalpha() or unit[0] in SIGNS)


def features(text: str) -> list[int]:
    """Hashed words and beginnings of words."""
    out = []
    for w in _WORD.findall(text):
        out += [xxhash.xxh32_intdigest(x) % FEATURES for x in (w, *(f"^{w[:k]}" for k in (4, 5, 6) if len(w) >= k))]
    return out


class Reader:
    """Feature lists of texts; keep: features that are wanted (None: all)."""

    def __init__(self, cost: np.ndarray, keep: np.ndarray | None):
        self.channel, self.keep = Channel(cost), keep
        self.memo = Memo(self._many, 100_000)
        self.single = np.zeros(0, bool)

    def _wanted(self, found: list[int]) -> list[int]:
        return found if self.keep is None else [x for x in found if self.keep[x]]

    def _many(self, units: list[str]) -> Lists:
        self.single = np.concatenate([self.single, np.fromiter(map(_is_single, units), bool, len(units))])
        return lists([self._wanted(features(self.channel.restore(u))) for u in units])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' features and the text each belongs to, with repeats. Null texts are empty."""
        if (stay := self.memo.trim()) is not None:
            self.single = self.single[stay]
        parts = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
        first = parts.offsets.to_numpy()
        flat, n, first = parts.flatten(), np.diff(first), first[:-1] - first[0]
        coded = flat.dictionary_encode()
        units = self.memo.find(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy(zero_copy_only=False)]
        m = self.memo
        ids, size = gather(units, m.ids, m.start, m.n)
        doc = np.repeat(np.arange(len(texts)), n)
        more, owner = self._spaced(flat, units, doc, first + n)
        return np.concatenate([ids, np.array(more, np.int32)]), np.concatenate([np.repeat(doc, size), np.array(owner, np.int64)])

    def _spaced(self, flat: pa.Array, units: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[int]]:
        """Features of words whose letters stand apart: three or more single signs one after another."""
        alone = self.single[units]
        three = np.flatnonzero(alone[:-2] & alone[1:-1] & alone[2:] & (doc[:-2] == doc[2:])) if len(units) > 2 else []
        more, owner, done = [], [], -1
        for k in map(int, three):
            if k < done:
                continue
            d = int(doc[k])
            done = k
            while done < ends[d] and alone[done]:
                done += 1
            found = self._wanted(features(self.channel.restore_spaced(flat.slice(k, done - k).to_pylist())))
            more += found
            owner += [d] * len(found)
        return more, owner


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    rate = (n_toxic + 0.5) / (n_toxic + n_clean + 1)
    p = (toxic + PRIOR * rate) / (toxic + clean + PRIOR)
    return np.log(p / rate) - np.log((1 - p) / (1 - rate))


def evidence(ids: np.ndarray, doc: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """By text, the sum of its distinct features' weights where they are LEAST or more."""
    w = weight[ids]
    use = w >= LEAST
    if not use.any():
        return np.zeros(n)
    pairs = np.unique(doc[use] * FEATURES + ids[use])
    return np.bincount(pairs // FEATURES, weights=weight[pairs % FEATURES], minlength=n)


@dataclass
class Model:
    cost: np.ndarray
    weight: np.ndarray
    slope: float
    shift: float

    def score(self, ids: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log1p(evidence(ids, doc, self.weight, n)) + self.shift, -30, 30)))


def _held_out(id_col: str, folds: int, fold: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold


def _sample(labels: DataFrame, most: int, n: int) -> DataFrame:
    """About most of n rows, by a hash of their ids."""
    return labels if n <= most else labels.where(F.pmod(F.xxhash64("id", F.lit(4)), F.lit(1_000_000)) < int(1_000_000 * most / n))


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic") -> Model:
    """docs: all documents, for the language model; labels: id and 0 or 1 of those to learn from.

    Of labels with the same id the largest counts, null labels and ids don't. Labels are sampled beyond MAX_LABELLED rows
    (and MAX_CURVE for the curve), so what is broadcast and what the driver gets is bounded.
    """
    spark = docs.sparkSession
    cost = costs(count_letters(docs, text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and id is not null")
    known = stage(known.groupBy("id").agg(F.max("label").alias("label")), "labels")
    n = known.count()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, total = Reader(shared.value, None), np.zeros((2, FEATURES + 1), np.int64)
        for batch in pieces(batches):
            label = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
            ids, doc = read(batch.column("text"))
            pairs = np.unique(doc * FEATURES + ids)
            for k in (0, 1):
                total[k, :FEATURES] += np.bincount(pairs[label[pairs // FEATURES] == k] % FEATURES, minlength=FEATURES)
                total[k, FEATURES] += int((label == k).sum())
        at = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_pydict({"feature": at, "clean": total[0, at], "toxic": total[1, at]})

    shared = spark.sparkContext.broadcast(cost)
    # at most about MAX_LABELLED rows are broadcast
    learnt = rows.join(F.broadcast(_sample(known, MAX_LABELLED, n)), "id").select("text", "label")
    sums = learnt.mapInArrow(counted, "feature long, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    clean, toxic = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1)
    with small_batches(spark):
        for r in sums.collect():  # FEATURES + 1 rows at most
            clean[r["feature"]], toxic[r["feature"]] = r["clean"], r["toxic"]
    shared.unpersist()
    n_clean, n_toxic = clean[FEATURES], toxic[FEATURES]
    clean, toxic = clean[:FEATURES], toxic[:FEATURES]
    weight = log_odds(toxic, clean, n_toxic, n_clean)
    weight[weight < LEAST] = 0
    if not n_clean or not n_toxic:
        return Model(cost, np.zeros(FEATURES), 0.0, -3.0)
    # a document's own label doesn't count for its evidence here
    own = [log_odds(toxic, np.maximum(clean - 1, 0), n_toxic, n_clean), log_odds(np.maximum(toxic - 1, 0), clean, n_toxic, n_clean)]
    given = spark.sparkContext.broadcast((cost, own))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, own = given.value
        read, found = Reader(cost, np.maximum(*own) >= LEAST), np.zeros((2, 400), np.int64)
        for batch in pieces(batches):
            label = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
            ids, doc = read(batch.column("text"))
            for k in (0, 1):
                e = np.log1p(evidence(ids, doc, own[k], len(label)))[label == k]
                found[k] += np.bincount(np.minimum((e * 50).round().astype(np.int64), 399), minlength=400)
        k, at = np.nonzero(found)
        yield pa.RecordBatch.from_pydict({"label": k, "bin": at, "n": found[k, at]})

    curve = rows.join(F.broadcast(_sample(known, MAX_CURVE, n)), "id").select("text", "label")
    bins = curve.mapInArrow(placed, "label long, bin long, n long").groupBy("label", "bin").agg(F.sum("n").alias("n"))
    with small_batches(spark):
        bins = bins.collect()  # 800 rows at most
    given.unpersist()
    slope, shift = logistic(np.array([[r["bin"] / 50, r["label"], r["n"]] for r in bins], float).reshape(-1, 3))
    return Model(cost, weight, slope, shift)


def logistic(points: np.ndarray, pull: float = 1.0) -> tuple[float, float]:
    """Slope (not negative) and shift by Newton's method over (x, label, weight)."""
    if not len(points):
        return 0.0, -3.0
    x, y, n = points.T
    both = np.stack([x, np.ones_like(x)], 1)
    w = np.array([1.0, -3.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(both @ w, -30, 30)))
        grad = both.T @ (n * (p - y)) + np.array([pull * w[0], 0.01 * w[1]])
        hess = (both * (n * p * (1 - p))[:, None]).T @ both + np.diag([pull, 0.01])
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, float(w[0])), float(w[1])


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 for each row; null and empty texts have no evidence, and its score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        read = Reader(model.cost, model.weight >= LEAST)
        for batch in pieces(batches, f"c{at}"):
            ids, doc = read(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(ids, doc, batch.num_rows), pa.float64())], names=[*names, name])

    names, at = docs.columns, docs.columns.index(text_col)
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])  # whatever the columns are called
    return plain.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """id, held_out, score, predicted of every row of docs; labels of the held-out fold aren't learnt from. A null id isn't held out."""
    out = F.coalesce(_held_out(id_col, folds, 0), F.lit(False))
    model = fit(docs, labels.where(~out), text_col, id_col)
    scored = score(docs.select(id_col, text_col), model, text_col)
    return scored.select(id_col, out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with a score under 0.5, with all their columns.

    Only ids and text digests of the others are written; a row goes for its own text, and null ids are told apart by it.
    """
    model = fit(docs, labels, text_col, id_col)
    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    digest = sha256(F.coalesce(F.col("text"), F.lit("")))
    gone = score(rows, model, "text").where("score >= 0.5").select("id", digest.alias("digest")).distinct()
    return without(docs, stage(gone, "toxic"), id_col, sha256(F.coalesce(quoted(text_col), F.lit(""))))
