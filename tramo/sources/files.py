"""Input and output files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramo.functions import exprs as X
from tramo.sources import records

ORDER_ALIASES = {"osrm_duration_min": "t3_osrm_duration_min", "osrm_distance_km": "t3_osrm_distance_km"}
#: Columns that end in _ksa but hold a number.
NUMBERS = ("pickup_hr_ksa", "order_hr_ksa", "order_dow_ksa")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV with a header, by the rules of records; schema: names and types of its columns (values that don't fit are missing), else all are strings."""
    df = records.read(spark, path).rows
    if schema is None:
        return df
    kinds = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in kinds.fields])


def read_required(spark: SparkSession, path: str, names: Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """A CSV that must be there and have these columns."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        raise FileNotFoundError(path)
    return X.require(read_csv(spark, path, schema), names)


def read_optional(spark: SparkSession, path: str | None, schema: T.StructType) -> DataFrame:
    """A table that may be left out (None): then without rows."""
    return spark.createDataFrame([], schema) if path is None else read_csv(spark, path, schema)


def normalise_orders(df: DataFrame) -> DataFrame:
    """Raw text columns as times and numbers; other names and defaults filled in."""
    df = X.rename_aliases(df, ORDER_ALIASES)
    stamps = [c for c, kind in df.dtypes if c.endswith("_ksa") and c not in NUMBERS and kind == "string"]
    df = df.withColumns({c: X.parse_ksa(F.col(c)) for c in stamps})
    routed = [c for c in ("t2_osrm_duration_min", "t2_osrm_distance_km", "t3_osrm_duration_min", "t3_osrm_distance_km") if c in df.columns]
    df = df.withColumns({c: X.to_number(F.col(c)) for c in routed})
    return X.with_default(X.with_default(X.with_default(df, "zone_name_en", "UNKNOWN"), "shop_id", -1), "sub_vertical_name", "UNKNOWN")


def write_table(df: DataFrame, path: str, order: list | None = None, kind: str = "parquet") -> None:
    """order: only a sink sorts."""
    writer = (df.orderBy(*order) if order else df).write.format(kind).mode("overwrite")
    (writer.option("header", True) if kind == "csv" else writer).save(path)
