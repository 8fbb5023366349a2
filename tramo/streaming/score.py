"""Orders scored as they come in, against calibration tables that stand still."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramo.functions import exprs as X
from tramo.operators import lookup
from tramo.params import DEFAULT, LIMITS, Params
from tramo.plans.delivery import with_legs


def score_t3(orders: DataFrame, t3_smoothed: DataFrame, t3_baseline: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The third leg of each order of a stream or table: stateless joins, so no watermark is needed."""
    d = with_legs(orders, p)
    d = lookup.ratio_lookup(d, t3_smoothed, "t3_dist_bin", "ratio", "ratio_source", "n_cell_hit")
    d = lookup.baseline_lookup(d, t3_baseline, "base", "base_source")
    bad = F.col("t3_coord_flag") == 1
    routed = F.col("t3_osrm_duration_min") * F.col("ratio")
    return d.select("order_id", X.clip(F.when(bad, F.col("base")).otherwise(routed), *LIMITS["T3"]).alias("T3_base_P50"), F.when(bad, F.col("base_source")).otherwise(F.col("ratio_source")).alias("source"))
