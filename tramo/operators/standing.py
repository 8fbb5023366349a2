"""Tables of recency-weighted medians that stand: a new day is merged into them, without the days before it.

A weight falls by the same factor for all rows as time goes on, so that sums of weights, kept with the time they are of,
are only scaled when a later day comes. By key and bin of values a table keeps these sums, and medians come from them: they
differ from those of the rows by less than the width of a bin, and are the same whatever the days were merged in.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramo.functions.wstats import join_keys, weighted_median
from tramo.sources import outputs

SUMS = ("w", "wv", "free", "free_v")


@dataclass(frozen=True)
class Standing:
    keys: Sequence[str]
    value: str
    ts: str
    half_life: float
    width: float = 1 / 1024

    def _decay(self, micros: Column) -> Column:
        return F.exp(F.lit(-math.log(2) / (self.half_life * 86400e6)) * micros)

    def bins(self, rows: DataFrame) -> DataFrame:
        """keys, bin, ref (microseconds of the latest row), w and wv (weights and weighted values at that time), free and free_v (of rows without a time), n."""
        d = rows.select(*self.keys, F.col(self.value).cast("double").alias("_v"), F.unix_micros(self.ts).alias("_t")).where("_v is not null")
        d = d.crossJoin(F.broadcast(d.agg(F.max("_t").alias("ref"))))  # one row
        w, free = F.when(F.col("_t").isNull(), 0.0).otherwise(self._decay(F.col("ref") - F.col("_t"))), F.when(F.col("_t").isNull(), 1.0).otherwise(0.0)
        d = d.select(*self.keys, F.floor(F.col("_v") / self.width).alias("bin"), "ref", w.alias("w"), (w * F.col("_v")).alias("wv"), free.alias("free"), (free * F.col("_v")).alias("free_v"), F.lit(1).cast("long").alias("n"))
        return self._summed(d)

    def _summed(self, d: DataFrame) -> DataFrame:
        return d.groupBy(*self.keys, "bin").agg(F.max("ref").alias("ref"), *[F.sum(c).alias(c) for c in (*SUMS, "n")])

    def merged(self, states: Sequence[DataFrame]) -> DataFrame:
        """The state of the rows of all states together."""
        d = reduce(DataFrame.unionByName, states)
        d = d.crossJoin(F.broadcast(d.agg(F.max("ref").alias("_now"))))  # one row
        scale = F.when(F.col("ref").isNull(), 1.0).otherwise(self._decay(F.col("_now") - F.col("ref")))
        d = d.withColumns({"w": F.col("w") * scale, "wv": F.col("wv") * scale, "ref": F.col("_now")}).drop("_now")
        return self._summed(d)

    def medians(self, state: DataFrame) -> DataFrame:
        """keys, v, n and t: weighted medians, rows, all weight. Rows without a time weigh nothing, but all the same where there is no time at all."""
        timed = F.col("ref").isNotNull()
        w, wv = F.when(timed, F.col("w")).otherwise(F.col("free")), F.when(timed, F.col("wv")).otherwise(F.col("free_v"))
        d = state.select(*self.keys, w.alias("_w"), (wv / F.when(w > 0, w)).alias("_v"))
        found = weighted_median(d.where("_w > 0"), self.keys, "_v", "_w", "v", "_bins", total="t").drop("_bins")
        return join_keys(state.groupBy(*self.keys).agg(F.sum("n").alias("n")), found, list(self.keys)).select(*self.keys, "v", "n", "t")

    def read(self, spark: SparkSession, folder: str) -> tuple[DataFrame, int] | None:
        """The state that was published last, and the batch that it was the last to take in."""
        try:
            at = outputs.published(spark, folder)
        except FileNotFoundError:
            return None
        return spark.read.parquet(f"{at}/state"), spark.read.parquet(f"{at}/batch").first()["batch"]

    def update(self, rows: DataFrame, folder: str, batch: int) -> bool:
        """Merges rows into the state in folder, as batch number so-and-so; one that it has is not taken in again. Whether it was new."""
        spark = rows.sparkSession
        was = self.read(spark, folder)
        if was is not None and was[1] >= batch:
            return False
        new = self.bins(rows)
        state = new if was is None else self.merged([was[0], new])

        def write(to: str) -> None:
            state.write.parquet(f"{to}/state")
            spark.createDataFrame([(batch,)], "batch long").coalesce(1).write.parquet(f"{to}/batch")

        outputs.publish(spark, folder, write)
        outputs.prune(spark, folder)
        return True
