"""Gradient-boosted medians over mixed features."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramo.functions.wstats import quantiles
from tramo.operators import boost
from tramo.operators.ranking import numbered
from tramo.tables import cleaned, stage

RARE = "_rare"
TREES = "tree int, node int, feature int, limit double, level int, value double"
# The models' features.
T1_CAT = ("sub_vertical_name", "zone_name_en", "business_branch_name", "shop_id", "mbo_chain_id")
T1_NUM = ("stacking_order_count", "accepted_courier_count", "rejected_courier_count", "pickup_lat", "pickup_lon", "dropoff_lat", "dropoff_lon", "order_hr_ksa", "dow")
T2B_CAT = ("zone_name_en", "sub_vertical_name", "business_branch_name", "shop_id", "mbo_chain_id")
T2B_NUM = ("pickup_hr_ksa", "dow", "is_peak", "stack_bkt", "stacking_order_count", "accepted_courier_count", "rejected_courier_count", "t2_osrm_distance_km", "t2_osrm_duration_min", "t2a_ratio_p50", "T2a_P50")
LEAKY = ("t2a_actual_min",)
T2_LEGACY_CAT = ("zone_name_en", "sub_vertical_name", "business_branch_name", "shop_id", "mbo_chain_id")
T2_LEGACY_NUM = (
    "pickup_hr_ksa", "is_peak", "dow", "stacking_order_count", "accepted_courier_count", "rejected_courier_count", "t2_osrm_distance_km", "t2_osrm_duration_min",
    "prep_shop_mean", "prep_vert_mean", "prep_shop_p50", "prep_shop_iqr", "prep_shop_cnt",
)


@dataclass(frozen=True)
class Spec:
    cat: Sequence[str]
    num: Sequence[str]
    label: str
    max_iter: int = 600
    max_depth: int = 4
    min_rows: int = 20
    #: Levels of a category with fewer rows are pooled; 1 pools none.
    min_frequency: int = 1
    seed: int = 42


def level_counts(df: DataFrame, cat: Sequence[str]) -> DataFrame:
    """name, v, n: how many rows have each level of each category; missing ones aren't counted."""
    slots = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("v")) for c in cat])
    return df.select(F.explode(slots).alias("x")).select("x.*").where("v is not null").groupBy("name", "v").agg(F.count(F.lit(1)).alias("n"))


def most_frequent(counts: DataFrame) -> dict[str, str]:
    """By category its most frequent level, the first in order of equal ones: a row for each category."""
    best = counts.groupBy("name").agg(F.min(F.struct((-F.col("n")).alias("n"), "v")).alias("x"))
    return {r["name"]: r["x"]["v"] for r in best.collect()}


@dataclass
class Ensemble:
    """Boosted trees: by tree and node the feature (-1: none), the number that goes left at most, or the level that goes right; leaves' values."""

    start: float
    rate: float
    feature: np.ndarray
    limit: np.ndarray
    level: np.ndarray
    value: np.ndarray
    #: Of each category the levels that splits name.
    names: list[list[str]]

    def values(self, numbers: Sequence[np.ndarray], categories: Sequence[pa.Array]) -> np.ndarray:
        coded = [pc.fill_null(pc.index_in(c, value_set=pa.array(names, pa.string())), -1).to_numpy(zero_copy_only=False) for c, names in zip(categories, self.names, strict=True)]
        n = len([*numbers, *coded][0])
        out = np.full(n, self.start)
        for t in range(len(self.feature)):
            node = np.zeros(n, np.int64)
            for k in np.flatnonzero(self.feature[t] >= 0).tolist():
                at, f = np.flatnonzero(node == k), int(self.feature[t, k])
                right = numbers[f][at] > self.limit[t, k] if f < len(numbers) else coded[f - len(numbers)][at] == self.level[t, k]
                node[at] = 2 * k + 1 + right
            out += self.rate * self.value[t][node]
        return out

    def table(self) -> list[tuple]:
        """tree, node, feature, limit, level, value."""
        wide = self.value.shape[1]
        pad = lambda x, none: np.concatenate([x, np.full((len(x), wide - x.shape[1]), none)], axis=1)
        f, limit, level = pad(self.feature, -1), pad(self.limit, 0.0), pad(self.level, -1)
        return [(t, k, int(f[t, k]), float(limit[t, k]), int(level[t, k]), float(self.value[t, k])) for t in range(len(f)) for k in range(wide)]

    @staticmethod
    def of(rows: list[tuple], start: float, rate: float, names: list[list[str]], trees: int) -> Ensemble:
        wide = len(rows) // max(trees, 1)
        x = np.array(sorted(rows), float).reshape(trees, wide, 6)
        inner = wide // 2
        return Ensemble(start, rate, x[:, :inner, 2].astype(np.int64), x[:, :inner, 3], x[:, :inner, 4].astype(np.int64), x[:, :, 5], names)


@dataclass
class Fitted:
    spec: Spec
    model: Ensemble | None
    #: name, v: levels that training pools. A table, since they may be many.
    rare: DataFrame | None
    #: Categories that have such levels.
    pooled: Sequence[str]
    modes: dict[str, str]
    constant: float = 5.0
    medians: dict[str, float] = field(default_factory=dict)

    def prepared(self, df: DataFrame) -> DataFrame:
        """Absent columns are missing values; a missing category is its mode, a missing number its median; a rare level is pooled, an unseen one stays as it is."""
        missing = F.lit(None)
        new: dict[str, Column] = {f"_c_{c}": F.coalesce(F.col(c).cast("string") if c in df.columns else missing.cast("string"), F.lit(self.modes.get(c, ""))) for c in self.spec.cat}
        new |= {f"_n_{c}": F.coalesce(F.col(c).cast("double") if c in df.columns else missing.cast("double"), F.lit(self.medians.get(c, 0.0))) for c in self.spec.num}
        df = df.withColumns(new)
        for c in self.pooled:
            rare = self.rare.where(F.col("name") == c).select(F.col("v").alias("_rare_v"))
            df = df.join(small(rare), F.col(f"_c_{c}") == F.col("_rare_v"), "left")
            df = df.withColumn(f"_c_{c}", F.when(F.col("_rare_v").isNotNull(), RARE).otherwise(F.col(f"_c_{c}"))).drop("_rare_v")
        return df

    def predict(self, df: DataFrame, out: str) -> DataFrame:
        if self.model is None:
            return df.withColumn(out, F.lit(self.constant))
        shared, n_num, cols = df.sparkSession.sparkContext.broadcast(self.model), len(self.spec.num), df.columns  # some numbers for each tree

        @F.arrow_udf("double")
        def value(*columns: pa.Array) -> pa.Array:
            return pa.array(shared.value.values([c.to_numpy(zero_copy_only=False) for c in columns[:n_num]], columns[n_num:]))

        names = [*[f"_n_{c}" for c in self.spec.num], *[f"_c_{c}" for c in self.spec.cat]]
        return self.prepared(df).withColumn(out, value(*names)).select(*cols, out)

    def save(self, path: str, spark: SparkSession) -> None:
        """Everything that load needs, in three folders under path; what is there is replaced."""
        about = {"spec": asdict(self.spec), "modes": self.modes, "pooled": list(self.pooled), "constant": self.constant, "medians": self.medians, "fitted": self.model is not None}
        if self.model is not None:
            about |= {"start": self.model.start, "rate": self.model.rate, "names": self.model.names, "trees": len(self.model.feature)}
            spark.createDataFrame(self.model.table(), TREES).coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
        spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
        if self.pooled:
            self.rare.write.mode("overwrite").parquet(f"{path}/rare")


def load(path: str, spark: SparkSession) -> Fitted:
    about = json.loads(spark.read.parquet(f"{path}/about").first()["about"])
    model = None
    if about["fitted"]:
        model = Ensemble.of([tuple(r) for r in spark.read.parquet(f"{path}/model").collect()], about["start"], about["rate"], about["names"], about["trees"])
    rare = spark.read.parquet(f"{path}/rare") if about["pooled"] else None
    return Fitted(Spec(**about["spec"]), model, rare, about["pooled"], about["modes"], about["constant"], about["medians"])


def small(df: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """df with a broadcast hint if it has at most limit rows; df should be cheap to count (staged)."""
    return F.broadcast(df) if df.count() <= limit else df


def constant(df: DataFrame, label: str, spec: Spec | None = None) -> Fitted:
    """The training median for every row; 5 if there is no row to train on."""
    got = quantiles(df, [], {"m": (label, 0.5)}).first()["m"]
    return Fitted(spec or Spec((), (), label), None, None, (), {}, 5.0 if got is None else got)


def level_index(counts: DataFrame, min_frequency: int, min_rows: int) -> DataFrame:
    """name, v, code: levels numbered from 0 within their category, in order, all rare ones by the number after the last.

    counts: as level_counts gives them. Levels with fewer than min_rows rows, which no split can part from the others, have
    no number (unless they are pooled). Nothing is listed on the driver: levels are numbered where they are.
    """
    kept = numbered(counts.where((F.col("n") >= min_frequency) & (F.col("n") >= min_rows)).select("name", "v"), ["name", "v"], "at")
    ends = kept.groupBy("name").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("many"))  # a row for each category
    kept = kept.join(F.broadcast(ends), "name").select("name", "v", (F.col("at") - F.col("first")).cast("int").alias("code"))
    rare = counts.where(F.col("n") < min_frequency).join(F.broadcast(ends), "name", "left").select("name", "v", F.coalesce("many", F.lit(0)).cast("int").alias("code"))
    return kept.unionByName(rare)


def _edges(x: np.ndarray) -> np.ndarray:
    """What ends a bin, itself in it: all values but the largest, or, of more than BINS, those at equal ranks."""
    own = np.unique(x)
    if len(own) > boost.BINS:
        own = np.unique(np.append(np.sort(x)[np.arange(1, boost.BINS) * len(x) // boost.BINS], own[-1]))
    return own[:-1]


def _coded(df: DataFrame, fitted: Fitted, label: str, index: DataFrame | None) -> DataFrame:
    """y, nums (array) and cats (array of level numbers, -1: none) of every row."""
    for k, c in enumerate(fitted.spec.cat):
        own = index.where(F.col("name") == c).select(F.col("v").alias(f"_v{k}"), F.col("code").alias(f"_k{k}"))
        value = F.coalesce(F.col(c).cast("string"), F.lit(fitted.modes[c]))
        df = df.join(small(own), value == F.col(f"_v{k}"), "left")
    nums = [F.coalesce(F.col(c).cast("double"), F.lit(fitted.medians[c])) for c in fitted.spec.num]
    cats = [F.coalesce(f"_k{k}", F.lit(-1)) for k in range(len(fitted.spec.cat))]
    array = lambda of, kind: F.array(*of) if of else F.array().cast(f"array<{kind}>")
    return df.select(F.col(label).cast("double").alias("y"), array(nums, "double").alias("nums"), array(cats, "int").alias("cats"))


def _packed(edges: list[np.ndarray], start: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cats = as_rows(batch, edges, start)

            def packed(x: np.ndarray) -> pa.Array:
                wide = np.ascontiguousarray(x.T)
                ends = (np.arange(len(wide) + 1) * wide.itemsize * wide.shape[1]).astype(np.int32)
                return pa.Array.from_buffers(pa.binary(), len(wide), [None, pa.py_buffer(ends), pa.py_buffer(wide)])

            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(rows.pred), packed(rows.num), packed(cats)], names=["y", "pred", "num", "cat"])

    return run


def _flat(lists: pa.ListArray | pa.ChunkedArray, kind: type) -> np.ndarray:
    """A row for each place in lists of one length."""
    flat = lists.combine_chunks().flatten() if isinstance(lists, pa.ChunkedArray) else lists.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(kind).reshape(len(lists), -1).T


def as_rows(batch: pa.RecordBatch | pa.Table, edges: list[np.ndarray], start: float) -> tuple[boost.Rows, np.ndarray]:
    n = batch.num_rows
    nums, cats = _flat(batch.column("nums"), float), _flat(batch.column("cats"), np.int32)
    num = np.array([np.searchsorted(e, x, side="left") for e, x in zip(edges, nums, strict=True)], np.uint8).reshape(len(edges), n)
    return boost.Rows(batch.column("y").to_numpy().astype(float), np.full(n, start), num, cats), cats


def fit(df: DataFrame, spec: Spec, least_rows: int = 0) -> Fitted:
    """Boosted trees for the median: signs of residuals choose the splits, each leaf is the median of its rows' residuals.

    With fewer rows than asked for, the training median (5 without rows). Numbers are cut to 256 bins at ranks of at most
    boost.SAMPLE rows, where they have more values.
    """
    df = df.where(F.col(spec.label).isNotNull())
    cat, num = [c for c in spec.cat if c in df.columns], [c for c in spec.num if c in df.columns]
    if df.limit(max(1, least_rows)).count() < max(1, least_rows):
        return constant(df, spec.label, spec)
    spark = df.sparkSession
    with cleaned(spark) as made:
        df = stage(df.select(*dict.fromkeys([*cat, *num, spec.label])), "train")
        modes, rare, pooled, index, levels = {}, None, [], None, []
        if cat:
            counts = stage(level_counts(df, cat), "levels")
            modes = most_frequent(counts)
            cat = [c for c in cat if c in modes]  # one that is missing everywhere tells nothing
            rare = made.keep(stage(counts.where(F.col("n") < spec.min_frequency).select("name", "v"), "rare"))
            pooled = sorted(r["name"] for r in rare.select("name").distinct().collect())  # names of columns
            index = stage(level_index(counts, spec.min_frequency, spec.min_rows), "index")
            most = {r["name"]: r["most"] + 1 for r in index.groupBy("name").agg(F.max("code").alias("most")).collect()}
            levels = [most.get(c, 0) for c in cat]
        # a number that is missing everywhere has no median
        some = df.agg(*[F.count(c).alias(c) for c in num]).first() if num else {}
        num = [c for c in num if some[c]]
        wanted = {f"m{k}": (c, 0.5) for k, c in enumerate(num)} | {"start": (spec.label, 0.5)}
        middle = quantiles(df, [], wanted).first()
        out = Fitted(replace(spec, cat=cat, num=num), None, rare, pooled, modes, middle["start"], {c: middle[f"m{k}"] for k, c in enumerate(num)})
        if not cat and not num:
            return out
        coded = stage(_coded(df, out, spec.label, index), "coded")
        n = coded.count()
        lot = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(spec.seed)), F.lit(1_000_000_000))
        part = coded if n <= boost.SAMPLE else coded.where(lot < int(1_000_000_000 * boost.SAMPLE / n))
        seen = part.select("nums").toArrow()  # about SAMPLE rows
        edges, start = [_edges(x) for x in _flat(seen.column("nums"), float)], middle["start"]
        table = stage(coded.coalesce(max(1, -(-n // boost.ROWS))).mapInArrow(_packed(edges, start), "y double, pred double, num binary, cat binary"), "binned")
        rule = boost.Rule(spec.max_depth, spec.min_rows)
        if n <= boost.GUESS:
            got = boost.grown(table, start, spec.max_iter, rule)
        else:
            got = boost.boost(table, boost.sampled(table, n, spec.seed), start, spec.max_iter, rule, levels)
        out.model = _ensemble(got, rule, cat, edges, index, levels, pooled)
    return out


def _ensemble(got: boost.Boosted, rule: boost.Rule, cat: Sequence[str], edges: list[np.ndarray], index: DataFrame | None, levels: Sequence[int], pooled: Sequence[str]) -> Ensemble:
    feature, code, value = (np.array([getattr(t, x) for t in got.trees]) for x in ("feature", "code", "value"))
    limit, level = np.zeros(feature.shape), np.full(feature.shape, -1)
    used = {(int(f) - len(edges), int(c)) for f, c in zip(feature.ravel(), code.ravel(), strict=True) if f >= len(edges)}
    names: list[list[str]] = [[] for _ in cat]
    if used:
        spark = index.sparkSession
        wanted = F.broadcast(spark.createDataFrame([(cat[k], c) for k, c in sorted(used)], "name string, code int"))  # some for each tree
        found = index.join(wanted, ["name", "code"]).groupBy("name", "code").agg(F.min("v").alias("v")).collect()
        place = {}
        for r in found:
            k = cat.index(r["name"])
            place[k, r["code"]] = len(names[k])
            # pooled levels share the last number
            names[k].append(RARE if r["name"] in pooled and r["code"] == levels[k] - 1 else r["v"])
        for t, node in zip(*np.nonzero(feature >= len(edges)), strict=True):
            level[t, node] = place[int(feature[t, node]) - len(edges), int(code[t, node])]
    for t, node in zip(*np.nonzero((feature >= 0) & (feature < len(edges))), strict=True):
        limit[t, node] = edges[feature[t, node]][code[t, node]]
    return Ensemble(got.start, rule.rate, feature, limit, level, value, names)


def t1_spec(max_iter: int = 600) -> Spec:
    return Spec(T1_CAT, T1_NUM, "t1_actual_min", max_iter, min_frequency=10)


def t2b_spec(leaky: bool = False, max_iter: int = 500) -> Spec:
    return Spec(T2B_CAT, T2B_NUM + (LEAKY if leaky else ()), "t2b_resid", max_iter, min_rows=25, min_frequency=15)


def t2_legacy_spec(max_iter: int = 600) -> Spec:
    return Spec(T2_LEGACY_CAT, T2_LEGACY_NUM, "t2_resid", max_iter, min_rows=25, min_frequency=20)
