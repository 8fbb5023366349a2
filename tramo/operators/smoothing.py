"""Cells drawn to the first usable one of their parents."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramo.functions import exprs as X
from tramo.functions.wstats import Part, join_keys, many_medians
from tramo.tables import stage


@dataclass(frozen=True)
class Level:
    label: str
    keys: tuple[str, ...]


def _pick(cells: DataFrame, levels: Sequence[Level], out: str) -> DataFrame:
    # the last level is what remains, whatever its size
    usable = [F.col(f"_v{k}").isNotNull() & (F.col(f"_n{k}") > 0) for k in range(len(levels) - 1)] + [F.lit(True)]
    pick = lambda of: F.coalesce(*[F.when(u, of(k)) for k, u in enumerate(usable)])
    new = {out: pick(lambda k: F.col(f"_v{k}")), "parent_n": pick(lambda k: F.col(f"_n{k}")), "parent_level": pick(lambda k: F.lit(levels[k].label))}
    return cells.withColumns(new).drop(*[f"_{c}{k}" for c in "vn" for k in range(len(levels))])


def _attach(cells: DataFrame, found: Sequence[DataFrame], levels: Sequence[Level], size: str, out: str) -> DataFrame:
    for k, (level, own) in enumerate(zip(levels, found, strict=True)):
        one = own.select(*level.keys, F.col("v").alias(f"_v{k}"), F.col(size).cast("long").alias(f"_n{k}"))
        # a level without keys has one row, or none if there are no rows
        one = one if level.keys else cells.sparkSession.range(1).join(one, F.lit(True), "left").drop("id")
        cells = join_keys(cells, one, level.keys)
    return _pick(cells, levels, out)


def keys_of(levels: Sequence[Level]) -> list[tuple[str, ...]]:
    return [level.keys for level in levels]


def with_parents(cells: DataFrame, found: Sequence[DataFrame], levels: Sequence[Level], out: str = "parent_value") -> DataFrame:
    """cells with the value, size and label of the first of the levels that has one; found: medians of rows, for each level."""
    return _attach(cells, found, levels, "n", out)


def with_cell_parents(cells: DataFrame, levels: Sequence[Level], value: str, n: str, out: str = "parent_value", found: Sequence[DataFrame] | None = None) -> DataFrame:
    """As with_parents, but levels are medians of the cells themselves, weighted by their sizes (found, if they are known)."""
    found = found or many_medians([Part(cells, keys_of(levels), value, n)], stage)[0]
    return _attach(cells, found, levels, "t", out)


RATIO_LEVELS = (
    Level("ratio_hd", ("pickup_hr_ksa", "dist_bin")),
    Level("ratio_ipd", ("is_peak", "dist_bin")),
    Level("ratio_h", ("pickup_hr_ksa",)),
    Level("ratio_ip", ("is_peak",)),
    Level("ratio_g", ()),
)
PRIOR_ALIASES = {"ratio": "ratio_p50", "n_cell": "n", "pickup_hr": "pickup_hr_ksa"}


def ratio_cells(cells: DataFrame) -> DataFrame:
    """Cells with all keys of their levels."""
    X.require(cells, ["zone_name_en", "pickup_hr_ksa", "dist_bin", "ratio_p50", "n"])
    hour, n = F.col("pickup_hr_ksa").cast("int"), F.coalesce(F.col("n").cast("long"), F.lit(0))
    return cells.withColumns({"pickup_hr_ksa": hour, "n": n}).withColumn("is_peak", X.is_peak(F.col("pickup_hr_ksa")))


def ratio_parents(cells: DataFrame) -> Part:
    return Part(ratio_cells(cells), keys_of(RATIO_LEVELS), "ratio_p50", "n")


def smooth_ratios(cells: DataFrame, n0: int, prior: DataFrame | None = None, n0_prior: int = 0, prior_mode: str = "balanced", found: Sequence[DataFrame] | None = None) -> DataFrame:
    """cells: zone_name_en, pickup_hr_ksa, dist_bin, ratio_p50, n. prior: the same, by these names or their aliases. found: medians of ratio_parents, if known."""
    m = with_cell_parents(ratio_cells(cells), RATIO_LEVELS, "ratio_p50", "n", "parent_ratio", found)
    keys = ["zone_name_en", "pickup_hr_ksa", "dist_bin"]
    if prior is not None:
        p = X.rename_aliases(prior, PRIOR_ALIASES)
        for c, kind in (("zone_name_en", "string"), ("pickup_hr_ksa", "int"), ("dist_bin", "string"), ("ratio_p50", "double"), ("n", "long")):
            p = p.withColumn(c, F.col(c).try_cast(kind)) if c in p.columns else p.withColumn(c, F.lit(None).cast(kind))
        m = join_keys(m, p.select(*keys, F.col("ratio_p50").alias("ratio_prior"), F.coalesce("n", F.lit(0)).alias("n_prior")), keys)
    else:
        m = m.withColumns({"ratio_prior": F.lit(None).cast("double"), "n_prior": F.lit(0).cast("long")})
    has = F.col("ratio_prior").isNotNull()
    given = F.lit(float(n0_prior)) * F.coalesce("ratio_prior", "parent_ratio")
    num = F.col("n") * F.coalesce("ratio_p50", "parent_ratio") + F.lit(float(n0)) * F.col("parent_ratio") + (given if prior_mode == "reference" else F.when(has, given).otherwise(0.0))
    den = F.col("n") + n0 + F.lit(n0_prior) * has.cast("int")
    names = ["is_peak", F.col("ratio_p50").alias("ratio_cell"), F.col("n").alias("n_cell"), "parent_ratio", "parent_n", "parent_level", "ratio_prior", "n_prior"]
    return m.select(*keys, *names, (num / den).alias("ratio_smoothed"))


BASELINE_LEVELS = (Level("val_h", ("pickup_hr_ksa",)), Level("val_ip", ("is_peak",)), Level("val_g", ()))


BASELINE_KEYS = (("zone_name_en", "pickup_hr_ksa", "is_peak"), *keys_of(BASELINE_LEVELS))


def t3_baseline(found: Sequence[DataFrame], n0: int) -> DataFrame:
    """found: weighted medians of the third leg's minutes by BASELINE_KEYS. Minutes by zone and hour, without routes."""
    cells, *parents = found
    m = with_parents(cells.select(*BASELINE_KEYS[0], F.col("v").alias("value_cell"), F.col("n").alias("n_cell")), parents, BASELINE_LEVELS)
    return m.withColumn("value_smoothed", X.shrink(F.col("n_cell"), F.col("value_cell"), n0, F.col("parent_value")))


DWELL_KEYS = (("zone_name_en", "pickup_hr_ksa"), ("pickup_hr_ksa",), ())


def dwell(rows: DataFrame, n0: int, keep: Callable[[DataFrame, str], DataFrame] = stage) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows: zone_name_en, pickup_hr_ksa, dwell_min. Smoothed minutes by zone and hour; by hour; overall (one row)."""
    return dwell_of(many_medians([Part(rows, DWELL_KEYS, "dwell_min")], keep)[0], n0)


def dwell_of(found: Sequence[DataFrame], n0: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """found: medians by DWELL_KEYS."""
    cells, hours, overall = found
    hours = hours.where("pickup_hr_ksa is not null").select("pickup_hr_ksa", F.col("v").alias("dwell_h"), F.col("n").alias("n_h"))
    cells = cells.where("pickup_hr_ksa is not null and zone_name_en is not null").select("zone_name_en", "pickup_hr_ksa", F.col("v").alias("dwell_cell"), F.col("n").alias("n_cell"))
    m = cells.join(hours.select("pickup_hr_ksa", F.col("dwell_h").alias("dwell_parent"), F.col("n_h").alias("n_parent")), "pickup_hr_ksa")
    m = m.withColumn("dwell_smoothed", X.shrink(F.col("n_cell"), F.col("dwell_cell"), n0, F.col("dwell_parent")))
    one = overall.sparkSession.range(1).join(overall, F.lit(True), "left")
    return m, hours, one.select(F.coalesce("v", F.lit(0.0)).alias("dwell_g"))


VALUE_LEVELS = (Level("val_svh", ("sub_vertical_name", "pickup_hr_ksa", "dow")), Level("val_hd", ("pickup_hr_ksa", "dow")), Level("val_g", ()))


def value_parents(cells: DataFrame) -> Part:
    return Part(cells, keys_of(VALUE_LEVELS), "value_p50", "n")


def smooth_values(cells: DataFrame, n0: int, found: Sequence[DataFrame] | None = None) -> DataFrame:
    """cells: shop_id, sub_vertical_name, pickup_hr_ksa, dow, value_p50, n. found: medians of value_parents, if known."""
    X.require(cells, ["shop_id", "sub_vertical_name", "pickup_hr_ksa", "dow", "value_p50", "n"])
    m = with_cell_parents(cells, VALUE_LEVELS, "value_p50", "n", found=found)
    m = m.withColumnRenamed("value_p50", "value_cell").withColumnRenamed("n", "n_cell")
    return m.withColumn("value_smoothed", X.shrink(F.col("n_cell"), F.coalesce("value_cell", "parent_value"), n0, F.col("parent_value")))


BIAS_LEVELS = (Level("bias_zh", ("zone_name_en", "pickup_hr_ksa")), Level("bias_hb", ("pickup_hr_ksa", "stack_bkt")), Level("bias_h", ("pickup_hr_ksa",)), Level("bias_g", ()))


BIAS_KEYS = (("zone_name_en", "pickup_hr_ksa", "stack_bkt"), *keys_of(BIAS_LEVELS))


def bias_map(rows: DataFrame, n0: int, keep: Callable[[DataFrame, str], DataFrame] = stage) -> DataFrame:
    """rows: zone_name_en, pickup_hr_ksa, stack_bkt, t2_resid and w."""
    cells, *parents = many_medians([Part(rows, BIAS_KEYS, "t2_resid", "w")], keep)[0]
    m = with_parents(cells.select(*BIAS_KEYS[0], F.col("v").alias("bias_cell"), F.col("n").alias("n_cell")), parents, BIAS_LEVELS, "parent_bias")
    return m.withColumn("bias_smoothed", X.shrink(F.col("n_cell"), F.col("bias_cell"), n0, F.col("parent_bias")))
