"""Column functions: times, distances, coordinate checks and limits. Missing is always NULL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramo.params import DIST_EDGES, DIST_LABELS, LAT_RANGE, LON_RANGE, PEAK_HOURS

_OFFSET = r"(Z|UTC|[+-]\d{2}(:?\d{2})?)$"


def no_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def to_number(c: Column) -> Column:
    """As a double; NULL if it isn't one."""
    return no_nan(c.cast("string").try_cast("double"))


def parse_ksa(c: Column, zone: str = "Asia/Riyadh") -> Column:
    """A string as an instant; one without an offset is in the zone; NULL if it can't be read."""
    c = F.trim(c)
    return F.when(c.rlike(_OFFSET), c).otherwise(F.concat(c, F.lit(f" {zone}"))).try_cast("timestamp")


def as_time(c: Column) -> Column:
    """A string as a time without a zone: one with an offset is moved to UTC first."""
    c = F.trim(c)
    aware = F.convert_timezone(F.current_timezone(), F.lit("UTC"), c.try_cast("timestamp").cast("timestamp_ntz"))
    return F.when(c.rlike(_OFFSET), aware).otherwise(c.try_cast("timestamp_ntz"))


def first_of(df: DataFrame, names: Sequence[str]) -> Column:
    """The first that isn't NULL among the columns that exist."""
    have = [F.col(c) for c in names if c in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("timestamp")


def minutes_between(end: Column, start: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(6e7)


def hour_in(ts: Column, zone: str) -> Column:
    return F.hour(F.from_utc_timestamp(ts, zone))


def weekday_in(ts: Column, zone: str) -> Column:
    """Monday is 0."""
    return F.weekday(F.from_utc_timestamp(ts, zone))


def is_peak(hour: Column) -> Column:
    return F.coalesce(hour.between(*PEAK_HOURS).cast("int"), F.lit(0))


def dist_cut(km: Column) -> Column:
    """The label of a distance, bins closed below; NULL outside of all bins."""
    out = F.lit(None).cast("string")
    for lo, hi, name in reversed(list(zip(DIST_EDGES[:-1], DIST_EDGES[1:], DIST_LABELS, strict=True))):
        out = F.when((km >= lo) & (km < hi), name).otherwise(out)
    return out


def dist_label(km: Column) -> Column:
    """As dist_cut, but what is outside of all bins has the last label."""
    return F.when(km.isNotNull(), F.coalesce(dist_cut(km), F.lit(DIST_LABELS[-1])))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p, q = F.radians(lat1), F.radians(lat2)
    dlat, dlon = q - p, F.radians(lon2) - F.radians(lon1)
    a = F.sin(dlat / 2) * F.sin(dlat / 2) + F.cos(p) * F.cos(q) * F.sin(dlon / 2) * F.sin(dlon / 2)
    return F.lit(6371.0) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def in_bbox(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(*LAT_RANGE) & lon.between(*LON_RANGE), F.lit(False))


def is_zero_pair(lat: Column, lon: Column) -> Column:
    return F.coalesce((lat == 0) & (lon == 0), F.lit(False))


def coord_reason(plat: Column, plon: Column, dlat: Column, dlon: Column, routed_km: Column, straight_km: Column) -> Column:
    """Why the ends of a route can't be trusted, '' if they can: the first rule that applies."""
    ratio = straight_km / F.greatest(routed_km, F.lit(1e-6))
    far = F.greatest(straight_km, routed_km) >= 2.0
    known = straight_km.isNotNull()
    return (
        F.when(is_zero_pair(plat, plon) | is_zero_pair(dlat, dlon), "zero_coords")
        .when(~(in_bbox(plat, plon) & in_bbox(dlat, dlon)), "out_of_bbox")
        .when(routed_km.isNull() | (routed_km < 0), "osrm_dist_missing")
        .when(known & (routed_km < 0.1) & (straight_km >= 1.0), "osrm_zero_vs_haversine")
        .when(known & far & (ratio >= 3.0), "hav/osrm_too_high")
        .when(known & far & (ratio <= 0.33), "hav/osrm_too_low")
        .otherwise("")
    )


def swapped(lat: Column, lon: Column) -> Column:
    return F.coalesce((F.abs(lat) > 40) & (F.abs(lon) < 40), F.lit(False))


def repair_swaps(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Latitudes and longitudes that were written the wrong way round; pairs: names of both."""
    new = {}
    for lat, lon in pairs:
        turn = swapped(F.col(lat), F.col(lon))
        new |= {lat: F.when(turn, F.col(lon)).otherwise(F.col(lat)), lon: F.when(turn, F.col(lat)).otherwise(F.col(lon))}
    return df.withColumns(new)


def pair_key(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """The name of a route between two places, to five decimals (rounded half to even); NULL if a part is missing."""
    ends = [F.bround(c, 5) for c in (lat1, lon1, lat2, lon2)]
    key = F.format_string("%.5f,%.5f→%.5f,%.5f", *ends)
    return F.when(F.greatest(*[c.isNull().cast("int") for c in ends]) == 0, key)


def ratio(actual: Column, routed: Column, keep_infinite: bool = False) -> Column:
    """actual / routed; over 0 NULL, or signed infinity as in floating point (NULL for 0 over 0)."""
    out = F.try_divide(actual, routed)
    return F.when((routed == 0) & (actual != 0), F.signum(actual) * F.lit(float("inf"))).otherwise(out) if keep_infinite else out


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def stacking_bucket(c: Column) -> Column:
    return F.coalesce((to_number(c) >= 1).cast("int"), F.lit(0))


def gate_resid(c: Column) -> Column:
    return F.coalesce(clip(no_nan(c), -6.0, 10.0), F.lit(0.0))


def peak_guard(zone: Column, peak: Column, guard_mean: Column, worst_zones: Sequence[str], share: float = 0.7) -> Column:
    on = zone.isin(list(worst_zones)) & (peak == 1) & (guard_mean > 0)
    return F.when(F.coalesce(on, F.lit(False)), F.lit(share) * guard_mean).otherwise(0.0)


def shrink(n: Column, value: Column, n0: float, parent: Column) -> Column:
    """A cell's value drawn to its parent's by n0 rows."""
    return (n * value + F.lit(float(n0)) * parent) / (n + F.lit(float(n0)))


def in_range_or_null(c: Column, lo: float, hi: float) -> Column:
    return c.isNull() | c.between(lo, hi)


def require(df: DataFrame, names: Sequence[str]) -> DataFrame:
    if missing := [c for c in names if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df


def with_default(df: DataFrame, name: str, value: object) -> DataFrame:
    return df if name in df.columns else df.withColumn(name, F.lit(value))


def rename_aliases(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Columns by their other names, where the proper one is absent; names are stripped first."""
    df = df.toDF(*[c.strip() for c in df.columns])
    for old, new in aliases.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df
