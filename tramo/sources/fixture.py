"""Delivery orders derived from the test tables by whole-number arithmetic, so that every engine gets the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs unchanged in Spark and in other engines; times are epoch seconds.
DELIVERIES_SQL = """
select o_orderkey as order_id,
 case when o_orderkey % 101 = 0 then null else concat('Z', cast(c_nationkey % 8 as varchar(3))) end as zone_name_en,
 cast(o_orderkey % 41 as int) as shop_id,
 cast((o_orderkey % 41) % 13 as int) as mbo_chain_id,
 concat('V', cast(o_orderkey % 5 as varchar(3))) as sub_vertical_name,
 concat('B', cast(o_orderkey % 17 as varchar(3))) as business_branch_name,
 cast(o_orderkey % 4 as double) as stacking_order_count,
 cast(o_orderkey % 3 as double) as accepted_courier_count,
 cast(o_orderkey % 2 as double) as rejected_courier_count,
 created_s,
 case when o_orderkey % 103 = 0 then null else created_s + d1_s end as accepted_s,
 case when o_orderkey % 107 = 0 then null else created_s + d1_s + d2a_s end as arrived_s,
 case when o_orderkey % 109 = 0 then null else created_s + d1_s + d2a_s + d2b_s end as departed_s,
 case when o_orderkey % 11 = 0 then null else created_s + d1_s + d2a_s + d2b_s + d3_s end as at_customer_s,
 case when o_orderkey % 113 = 0 then null else created_s + d1_s + d2a_s + d2b_s + d3_s + d4_s end as delivered_s,
 case when o_orderkey % 97 = 0 then 0e0 when o_orderkey % 89 = 0 then plon else plat end as pickup_lat,
 case when o_orderkey % 97 = 0 then 0e0 when o_orderkey % 89 = 0 then plat else plon end as pickup_lon,
 case when o_orderkey % 83 = 0 then 51.5e0 else 24.5e0 + ((o_orderkey*43) % 1000)/2500e0 end as dropoff_lat,
 46.5e0 + ((o_orderkey*47) % 1000)/2500e0 as dropoff_lon,
 case when o_orderkey % 79 = 0 then null else 24.5e0 + ((o_orderkey*59) % 1000)/2500e0 end as courier_latitude_at_assignment,
 46.5e0 + ((o_orderkey*61) % 1000)/2500e0 as courier_longitude_at_assignment,
 case when o_orderkey % 53 = 0 then null else 0.2e0 + ((o_orderkey*17) % 1800)/100e0 end as t2_osrm_distance_km,
 case when o_orderkey % 53 = 0 then null else 1e0 + ((o_orderkey*19) % 4000)/100e0 end as t2_osrm_duration_min,
 case when o_orderkey % 59 = 0 then null when o_orderkey % 61 = 0 then 0.05e0 else 0.3e0 + ((o_orderkey*29) % 2600)/100e0 end as t3_osrm_distance_km,
 case when o_orderkey % 59 = 0 then null else 1.5e0 + ((o_orderkey*23) % 5000)/100e0 end as t3_osrm_duration_min
from (select *,
  1704067200 + (o_orderkey % 60)*86400 + (o_orderkey*7919) % 86400 as created_s,
  6 + (o_orderkey*31) % 900 as d1_s, 30 + (o_orderkey*53) % 2400 as d2a_s, (o_orderkey*67) % 3000 as d2b_s,
  60 + (o_orderkey*71) % 3600 as d3_s, (o_orderkey*13) % 420 as d4_s,
  24.5e0 + ((o_orderkey*37) % 1000)/2500e0 as plat, 46.5e0 + ((o_orderkey*41) % 1000)/2500e0 as plon
  from {orders} join {customer} on o_custkey = c_custkey) x
"""

#: Preparation times by order, by shop (any hour and weekday) and by vertical (any hour, a weekday).
PREP_ORDER_SQL = """
select order_id, shop_id, sub_vertical_name, accepted_s, departed_s, ((order_id*37) % 2400)/60e0 as prep_time_min
from {deliveries} where order_id % 3 = 0 and shop_id % 4 <> 1 and accepted_s is not null and departed_s is not null
"""
PREP_SHOP_SQL = """
select distinct shop_id, ((shop_id*97) % 1500) * 1e0 as prep_time_sec from {deliveries} where shop_id % 4 = 1 and shop_id % 3 <> 0
"""
PREP_VERTICAL_SQL = """
select distinct sub_vertical_name, cast(d as int) as dow, (d*3 + 4) * 1e0 as prep_time_min
from {deliveries} cross join (select order_id % 7 as d from {deliveries} where order_id < 5) w
"""


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enriched orders with timestamps."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    d = spark.sql(DELIVERIES_SQL, orders=read("orders"), customer=read("customer"))
    stamps = {
        "order_created_ksa": "created_s", "last_accepted_ksa": "accepted_s", "pickup_arrived_ksa": "arrived_s", "pickup_departure_ksa": "departed_s",
        "dropoff_arrived_ksa": "at_customer_s", "order_delivered_ksa": "delivered_s",
    }
    return d.withColumns({name: F.timestamp_seconds(s) for name, s in stamps.items()})


def prep_tables(spark: SparkSession, d: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    stamps = {"accepted_at": F.timestamp_seconds("accepted_s"), "picked_up_at": F.timestamp_seconds("departed_s")}
    return spark.sql(PREP_ORDER_SQL, deliveries=d).withColumns(stamps), spark.sql(PREP_SHOP_SQL, deliveries=d), spark.sql(PREP_VERTICAL_SQL, deliveries=d)
