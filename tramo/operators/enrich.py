"""Raw orders: legs, repaired coordinates, routes; and the calibration tables of what was observed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramo.functions import exprs as X
from tramo.functions.wstats import Part, many_medians, with_quantiles
from tramo.params import ENRICH_RANGES
from tramo.sources.routes import RouteProvider

COORDS = [("courier_latitude_at_assignment", "courier_longitude_at_assignment"), ("pickup_lat", "pickup_lon"), ("dropoff_lat", "dropoff_lon")]
ENDS = {"t2": (COORDS[0], COORDS[1]), "t3": (COORDS[1], COORDS[2])}


def legs(df: DataFrame) -> DataFrame:
    """Start, end and minutes of the three observed legs; rows with a leg that is there but out of range are dropped."""
    ts = {
        "t1_start_ts": F.col("order_created_ksa"), "t1_end_ts": X.first_of(df, ["courier_assignment_accepted_timestamp", "last_accepted_ksa"]),
        "t2_start_ts": X.first_of(df, ["courier_assignment_accepted_timestamp", "last_accepted_ksa"]), "t2_end_ts": F.col("pickup_arrived_ksa"),
        "t3_start_ts": X.first_of(df, ["pickup_departure_ksa", "pickup_btn_clicked_ksa"]), "t3_end_ts": X.first_of(df, ["dropoff_arrived_ksa", "order_delivered_ksa", "dropoff_btn_clicked_ksa"]),
    }
    df = df.withColumns(ts).withColumns({f"{k}_actual_min": X.minutes_between(F.col(f"{k}_end_ts"), F.col(f"{k}_start_ts")) for k in ENRICH_RANGES})
    for k, (lo, hi) in ENRICH_RANGES.items():
        df = df.where(X.in_range_or_null(F.col(f"{k}_actual_min"), lo, hi))
    return df


def keyed(df: DataFrame) -> DataFrame:
    """Repaired coordinates and the names of both routes."""
    X.require(df, [c for pair in COORDS for c in pair])
    df = X.repair_swaps(df, COORDS)
    return df.withColumns({f"{leg}_pair_key": X.pair_key(*[F.col(c) for end in ends for c in end]) for leg, ends in ENDS.items()})


def distinct_pairs(df: DataFrame) -> DataFrame:
    """The routes that are needed, once each, with rounded ends."""
    one = lambda leg: df.select(F.col(f"{leg}_pair_key").alias("pair_key"), *[F.bround(F.col(c), 5).alias(n) for c, n in zip([c for e in ENDS[leg] for c in e], ("lat1", "lon1", "lat2", "lon2"), strict=True)])
    return one("t2").unionByName(one("t3")).where("pair_key is not null").dropDuplicates(["pair_key"])


def attach_routes(df: DataFrame, provider: RouteProvider, keep_infinite: bool = False) -> DataFrame:
    """Routed minutes and kilometres of both legs, and observed by routed minutes."""
    routes = provider.routes(distinct_pairs(df))
    for leg in ENDS:
        r = routes.select(F.col("pair_key").alias(f"{leg}_pair_key"), (F.col("sec") / 60).alias(f"{leg}_osrm_duration_min"), (F.col("meters") / 1000).alias(f"{leg}_osrm_distance_km"))
        df = df.drop(f"{leg}_osrm_duration_min", f"{leg}_osrm_distance_km").join(r, f"{leg}_pair_key", "left")
        df = df.withColumn(f"ratio_actual_over_osrm_{leg}", X.ratio(F.col(f"{leg}_actual_min"), F.col(f"{leg}_osrm_duration_min"), keep_infinite))
    return df


def enrich(df: DataFrame, provider: RouteProvider) -> DataFrame:
    return attach_routes(keyed(legs(df)), provider)


def calibrate_t1(df: DataFrame, zone: str = "Asia/Riyadh") -> DataFrame:
    d = df.select(X.hour_in(F.col("order_created_ksa"), zone).alias("pickup_hr_ksa"), "zone_name_en", "t1_actual_min").dropna()
    return with_quantiles(d, ["pickup_hr_ksa", "zone_name_en"], {"t1_p50": ("t1_actual_min", 0.5), "t1_p85": ("t1_actual_min", 0.85)}, F.count(F.lit(1)).alias("n"))


CELL = ("pickup_hr_ksa", "zone_name_en", "dist_bin")


def ratio_rows(df: DataFrame, leg: str, zone: str = "Asia/Riyadh") -> DataFrame:
    """leg: t2 or t3; the hour is always that of the third leg's start. Rows that count, with the keys of their cells."""
    return df.select(
        X.hour_in(F.col("t3_start_ts"), zone).alias("pickup_hr_ksa"), "zone_name_en", X.dist_cut(F.col(f"{leg}_osrm_distance_km")).alias("dist_bin"),
        F.col(f"{leg}_osrm_distance_km").alias("km"), F.col(f"{leg}_actual_min").alias("actual"), F.col(f"ratio_actual_over_osrm_{leg}").alias("ratio"),
    ).where("pickup_hr_ksa is not null and zone_name_en is not null and dist_bin is not null and ratio is not null")


def calibrate_ratios(df: DataFrame, leg: str, zone: str = "Asia/Riyadh") -> DataFrame:
    d = ratio_rows(df, leg, zone)
    wanted = {"ratio_p50": ("ratio", 0.5), "ratio_p85": ("ratio", 0.85), "osrm_km_p50": ("km", 0.5), "actual_min_p50": ("actual", 0.5)}
    return with_quantiles(d, CELL, wanted, F.count(F.lit(1)).alias("n"))


def ratio_medians(df: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Of both legs' cells only the medians and sizes that calibrate_ratios gives, from the same passes; df is made once."""
    columns = ["zone_name_en", "t3_start_ts", *[c for leg in ENDS for c in (f"{leg}_osrm_distance_km", f"{leg}_actual_min", f"ratio_actual_over_osrm_{leg}")]]
    df = keep(df.select(*columns), "routed")
    found = many_medians([Part(ratio_rows(df, leg), [CELL], "ratio") for leg in ENDS], keep)
    t2, t3 = (own.select(*CELL, F.col("v").alias("ratio_p50"), "n") for own, in found)
    return t2, t3
