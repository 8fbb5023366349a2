"""Sharding by sampled splitters.

Rows are keyed by a hash of their text, so that equal texts stand together. A size-weighted sample of keys gives quantile
boundaries of a fixed number of ranges; ranges that turn out overfull are sampled again and subdivided. Within a range,
rows are divided further by plain parts of its keys, as many as it has rows for: that needs no boundaries, so what the
driver and the broadcasts hold doesn't grow with the rows. Shards are runs of parts with near equal bytes. Groups of equal
texts too large for that are placed as they are; one too large for a shard is split.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramo.llm.staging import quoted, small, stage

#: A group of equal texts over this share of a shard's bytes or rows is placed by itself: so there are at most 2 * shards / WHOLE of them.
WHOLE = 0.002
#: Ranges for each shard; keys sampled for each range; ranges over OVERFULL times their share are sampled again; rows aimed at in a part.
RANGES, SAMPLES, OVERFULL, PART_ROWS = 32, 16, 1.5, 50_000


def _in_sample(expected: Column, seed: int) -> Column:
    return (F.xxhash64("id", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))) < expected


def _ranges(cuts: list[int]):
    at = np.array(cuts, dtype=np.int64)

    @F.pandas_udf("long")
    def find(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(at, key.to_numpy(), side="right"))

    return find


def _quantiles(sample: list[tuple[int, float]], n: int) -> list[int]:
    """n - 1 boundaries at most, from (key, weight)."""
    sample = sorted(sample)
    acc, total = np.cumsum([w for _, w in sample]) if sample else np.array([]), sum(w for _, w in sample)
    return sorted({sample[int(np.searchsorted(acc, total * k / n))][0] for k in range(1, n)}) if sample else []


def _sums(rows: DataFrame, cuts: list[int]) -> dict[int, tuple[int, int, int, int]]:
    """By range its bytes, rows, least and largest key."""
    by = rows.groupBy(_ranges(cuts)("key").alias("range"))
    got = by.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    return {r["range"]: (r["bytes"], r["n"], r["lo"], r["hi"]) for r in got.toLocalIterator()}


def splitters(rows: DataFrame, total: int, n: int) -> tuple[list[int], dict[int, tuple[int, int, int, int]]]:
    """Boundaries of about n ranges of near equal bytes, and _sums of each. What the driver gets is bounded by n."""
    if not total:
        return [], {}
    odds = F.least(F.lit(1.0), F.col("size") * F.lit(n * SAMPLES / total))
    sample = [(r["key"], r["size"] / r["p"]) for r in rows.withColumn("p", odds).where(_in_sample(F.col("p"), 1)).select("key", "size", "p").toLocalIterator()]
    cuts = _quantiles(sample, n)
    for again in range(2, 7):
        got = _sums(rows, cuts)
        over = [k for k, x in got.items() if x[0] > OVERFULL * total / n]
        if not over:
            return cuts, got
        part = rows.withColumn("range", _ranges(cuts)("key")).where(F.col("range").isin(over))
        odds = F.least(F.lit(1.0), F.col("size") * F.lit(n * SAMPLES * 2.0**again / total))
        more: dict[int, list[tuple[int, float]]] = {}
        for r in part.withColumn("p", odds).where(_in_sample(F.col("p"), again)).select("range", "key", "size", "p").toLocalIterator():
            more.setdefault(r["range"], []).append((r["key"], r["size"] / r["p"]))
        new = sorted({*cuts, *(c for k, s in more.items() for c in _quantiles(s, 1 + int(got[k][0] * n / total) * 2))})
        if new == cuts:
            return cuts, got
        cuts = new
    return cuts, _sums(rows, cuts)


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, size (UTF-8 bytes plus 1), text_crc32, shard and slot, by the law that shards have near equal bytes.

    A null text has no bytes and counts as equal to an empty one. Equal texts are in one shard unless they are larger than
    a shard has room. Slots count from 0 in each shard without gaps, in the order of ranges and keys; repeated rows have
    slots of their own. An empty table gives an empty result.
    """
    text = F.coalesce(quoted(text_col), F.lit(""))
    base = stage(docs.select(quoted(id_col).alias("id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("key")), "sized")
    seen = base.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    total, n = seen["bytes"] or 0, seen["n"]
    target, share = total / shards, n / shards
    # at most 2 * shards / WHOLE groups
    big = base.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).where((F.col("bytes") > target * WHOLE) | (F.col("n") > max(share * WHOLE, PART_ROWS))).toLocalIterator()
    free, placed, split = [target] * shards, {}, {}
    for r in sorted(big, key=lambda r: (-r["bytes"], r["key"])):
        k = max(range(shards), key=lambda i: (free[i], -i))
        if r["bytes"] <= free[k]:
            free[k] -= r["bytes"]
            placed[r["key"]] = (k, len(placed), 1 + r["n"] // PART_ROWS)
        else:
            split[r["key"]] = 1 + max(int(r["bytes"] / (target * WHOLE)), r["n"] // PART_ROWS)
    spark = docs.sparkSession
    marks = [(k, h, i, p) for k, (h, i, p) in placed.items()] + [(k, None, None, p) for k, p in split.items()]
    base = base.join(F.broadcast(spark.createDataFrame(marks, "key long, home int, nr long, parts long")), "key", "left")
    own = base.where("home is not null")
    light = base.where("home is null").withColumn("key", F.when(F.col("parts").isNotNull(), F.xxhash64("key", F.expr("pmod(xxhash64(id), parts)"))).otherwise(F.col("key")))
    cuts, got = splitters(light.select("id", "key", "size"), int(total - sum(target - x for x in free)), RANGES * shards)
    # each range starts where the bytes of those before it end; it is divided into parts of its keys
    about, at = [], 0
    for k in sorted(got):
        size, rows, lo, hi = got[k]
        about.append((k, at, float(lo), float(hi) - float(lo) + 1.0, 1 + rows // PART_ROWS))
        at += size
    about = F.broadcast(spark.createDataFrame(about, "range long, start long, lo double, span double, parts long"))
    light = light.drop("parts").withColumn("range", _ranges(cuts)("key")).join(about, "range")
    within = F.floor((F.col("key").cast("double") - F.col("lo")) / F.col("span") * F.col("parts"))
    light = light.withColumn("sub", F.least(F.col("parts") - 1, F.greatest(F.lit(0).cast("long"), within))).select("id", "size", "crc", "key", "range", "sub", "start")
    ends = np.cumsum(free).tolist()
    home = _homes(ends)
    sums = light.groupBy("range", "start", "sub").agg(F.sum("size").alias("bytes"))  # a row for some PART_ROWS rows
    sums = sums.withColumn("at", F.col("start") + F.sum("bytes").over(Window.partitionBy("range").orderBy("sub")) - F.col("bytes"))
    sums = stage(sums.select("range", "sub", "at", home("at").alias("shard"), home(F.col("at") + F.col("bytes")).alias("last")), "parts")
    light = light.drop("start").join(small(sums), ["range", "sub"])
    # the few parts in which a shard ends: by group, as its middle lies
    edge = light.where("shard <> last").drop("shard")
    groups = edge.groupBy("range", "sub", "at", "key").agg(F.sum("size").alias("bytes"))
    middle = F.col("at") + F.sum("bytes").over(Window.partitionBy("range", "sub").orderBy("key")) - F.floor(F.col("bytes") / 2)
    edge = edge.join(groups.select("range", "sub", "key", home(middle).alias("shard")), ["range", "sub", "key"])
    own = own.withColumns({"shard": F.col("home"), "range": F.lit(len(cuts) + 1) + F.col("nr"), "sub": F.expr("pmod(xxhash64(id), parts)")})
    columns = ["id", "size", "crc", "key", "shard", "range", "sub"]
    rows = stage(light.where("shard = last").select(*columns).unionByName(edge.select(*columns)).unionByName(own.select(*columns)), "sharded")
    cell = ["shard", "range", "sub"]
    cells = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    cells = cells.select(*cell, (F.sum("n").over(Window.partitionBy("shard").orderBy("range", "sub")) - F.col("n")).alias("first"))
    numbered = rows.withColumn("nr", F.row_number().over(Window.partitionBy(*cell).orderBy("key", "id")) - 1).join(small(stage(cells, "cells")), cell)
    return numbered.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("first") + F.col("nr")).cast("long").alias("slot"))


def _homes(ends: list[float]):
    """The shard whose room a byte lies in, shards ending at `ends` in order."""
    at = np.array(ends)

    @F.pandas_udf("int")
    def find(place: pd.Series) -> pd.Series:
        return pd.Series(np.minimum(len(at) - 1, np.searchsorted(at, place.to_numpy(), side="right")).astype(np.int32))

    return find
