"""Language identification by nearest centroids.

Texts become normalised TF-IDF vectors of hashed character n-grams. Each language has several centroids, clustered from a
bounded sample of its documents; a text has the language of the centroid with the largest cosine, and is rejected when
even that is too far off.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramo.llm.staging import small, small_batches, stage
from tramo.llm.units import pieces

#: Hashed n-grams of 1 to 3 characters; distinct texts sampled for a language; centroids for each; smallest cosine that isn't rejected.
DIMS, SAMPLE, CENTROIDS, NEAREST = 4096, 300, 4, 0.1
UNKNOWN = "und"
_MAYBE_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a character of it is a letter; number signs such as fractions aren't."""
    return any(m[0].isalpha() for m in _MAYBE_LETTER.finditer(text))


def grams(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts: text * DIMS + n-gram, and how often. Case is folded, what isn't a letter is one boundary."""
    low = [t.lower() for t in texts]
    n = np.fromiter((len(t) + 2 for t in low), np.int64, len(texts))
    code = np.frombuffer("".join(f" {t} " for t in low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    doc = np.repeat(np.arange(len(texts)), n)
    # ASCII and Latin-1 signs are boundaries; letters elsewhere are as they are
    sign = (code < 65) | ((code > 90) & (code < 97)) | ((code > 122) & (code < 0xC0)) | (code == 0xD7) | (code == 0xF7)
    code = np.where(sign, np.uint64(32), code)
    keep = np.ones(len(code), bool)
    keep[1:] = ~sign[1:] | ~sign[:-1] | (doc[1:] != doc[:-1])
    code, doc = code[keep], doc[keep]
    out, letter = [], code != 32
    for k in (1, 2, 3):
        if len(code) < k:
            continue
        h = np.full(len(code) - k + 1, k, np.uint64)
        for j in range(k):
            h = (h ^ code[j : len(code) - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        same = doc[k - 1 :] == doc[: len(h)]
        if k == 1:
            same &= letter
        out.append(doc[: len(h)][same] * DIMS + (h[same] % np.uint64(DIMS)).astype(np.int64))
    return np.unique(np.concatenate(out), return_counts=True) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def vectors(texts: Sequence[str], idf: np.ndarray) -> np.ndarray:
    """Rows of length 1 (0 for texts without letters)."""
    key, n = grams(texts)
    out = np.zeros((len(texts), DIMS), np.float32)
    out[key // DIMS, key % DIMS] = (1 + np.log(n)) * idf[key % DIMS]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def cluster(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """k centroids at most, of length 1, by spherical k-means from farthest-first starts."""
    rng = np.random.default_rng(seed)
    at = [int(rng.integers(len(x)))]
    near = x @ x[at[0]]
    while len(at) < min(k, len(x)):
        at.append(int(near.argmin()))
        near = np.maximum(near, x @ x[at[-1]])
    c = x[at]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = np.stack([x[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]

    def nearest(self, texts: Sequence[str]) -> tuple[list[str], np.ndarray]:
        """The nearest centroid's language and the cosine, 0 to 1; UNKNOWN and 0 for texts without letters."""
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        cosine = vectors(texts, self.idf) @ self.centroids.T
        best = cosine.argmax(1)
        has = [has_letter(t) for t in texts]
        return [self.langs[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)], np.where(has, np.clip(cosine.max(1), 0, 1), 0.0)


def _key(text: str) -> Column:
    return F.xxhash64(text, F.lit(3))


def choose(rows: DataFrame, sample: int) -> DataFrame:
    """rows: lang and key, the text's hash. The `sample` smallest keys of each language, copies counted once; all if there are no more."""
    keys = stage(rows.select("lang", "key").distinct(), "keys")
    sizes = F.broadcast(keys.groupBy("lang").agg(F.count(F.lit(1)).alias("size")))  # a row for each language
    # hashes are even: a few times as many as wanted lie below the limit, and only those are ranked
    share = F.lit(4.0 * sample + 100) / F.col("size")
    low = keys.join(sizes, "lang").where((share >= 1) | (F.col("key").cast("double") < F.lit(-(2.0**63)) + share * F.lit(2.0**64)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    return stage(low.withColumn("rank", rank).where(F.col("rank") <= sample).select("lang", "key"), "chosen")


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """docs: those to learn from; null texts and languages are left out.

    Document frequencies count all of them. Centroids come from `sample` distinct texts of each language, once each however
    many copies there are (all texts if they are no more): that bounds what the driver gets, given the number of languages.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMS + 1, np.int64)
        for batch in pieces(batches, most=1_000_000):
            key, _ = grams(batch.column("text").to_pylist())
            total[:DIMS] += np.bincount(key % DIMS, minlength=DIMS)
            total[DIMS] += batch.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"gram": at, "n": total[at]})

    df = np.zeros(DIMS + 1)
    with small_batches(docs.sparkSession):
        for r in rows.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
            df[r["gram"]] = r["n"]
    idf = np.log((df[DIMS] + 1) / (df[:DIMS] + 1)) + 0.1
    rows = rows.withColumn("key", _key("text"))
    chosen = rows.join(small(choose(rows.select("lang", "key"), sample)), ["lang", "key"])

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()
        for batch in pieces(batches, most=1_000_000):
            names = list(zip(batch.column("lang").to_pylist(), batch.column("key").to_pylist(), strict=True))
            new = [i for i, name in enumerate(names) if name not in seen and not seen.add(name)]
            batch = batch.take(pa.array(new, pa.int64()))
            key, n = grams(texts := batch.column("text").to_pylist())
            cut = np.searchsorted(key, np.arange(len(texts) + 1) * DIMS).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x.astype(np.int32))) for x in (key % DIMS, n)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("key"), *lists], names=["lang", "key", "at", "n"])

    # each task gives a text once; of those of all tasks one is left
    once = chosen.select("lang", "key", "text").mapInArrow(sparse, "lang string, key long, at array<int>, n array<int>").dropDuplicates(["lang", "key"])
    by: dict[str, list[np.ndarray]] = {}
    for r in once.orderBy("lang", "key").toLocalIterator():
        v = np.zeros(DIMS, np.float32)
        v[r["at"]] = (1 + np.log(r["n"])) * idf[r["at"]] if r["at"] else 0
        if norm := np.linalg.norm(v):
            by.setdefault(r["lang"], []).append(v / norm)
    found = [(lang, c) for lang in sorted(by) for c in cluster(np.stack(by[lang]), centroids)]
    return Model(idf, np.stack([c for _, c in found]) if found else np.zeros((0, DIMS), np.float32), [lang for lang, _ in found])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", nearest: float = NEAREST) -> DataFrame:
    """One row per row of docs: id, lang_pred, score (the cosine), rejected (under `nearest`, or no letter). Null texts are UNKNOWN with score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages * CENTROIDS * DIMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=1_000_000, rows=256):
            lang, cosine = shared.value.nearest([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lang), pa.array(cosine.astype(np.float64)), pa.array(cosine < nearest)], names=[id_col, "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, fold: int = 2) -> DataFrame:
    """id, held_out, lang_pred, score, rejected of every row; the held-out fold isn't learnt from. A null id isn't held out."""
    out = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))
    scored = predict(docs, fit(docs.where(~out), text_col, lang_col), id_col, text_col)
    return scored.select(id_col, out.alias("held_out"), "lang_pred", "score", "rejected")
