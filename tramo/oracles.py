"""SQL for the rows of the queries: named common table expressions, put together as far as a query needs them."""

from __future__ import annotations

import re

from tramo.sources.fixture import DELIVERIES_SQL, PREP_ORDER_SQL, PREP_SHOP_SQL, PREP_VERTICAL_SQL

CTES: dict[str, str] = {}
# Fixed values, written here once more: the other side of a comparison must not take them from the library.
BINS = ((0, 1, "<1"), (1, 2, "1-2"), (2, 4, "2-4"), (4, 6, "4-6"), (6, 8, "6-8"), (8, 12, "8-12"), (12, 20, "12-20"), (20, 1_000_000_000, "20+"))
CLIPS = {"T2a": (0, 120), "T2b": (0, 90), "T2": (0.5, 240), "T3": (0.5, 180), "T4": (0, 60)}
MASKS = {"T1": (0, 60), "T2": (0.5, 240), "T3": (0.5, 180), "ETA": (10, 300)}


def query(body: str) -> str:
    """body with the expressions it names, and those that they name, before it."""
    need: list[str] = []

    def visit(sql: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bc_\w+", sql)):
            if name in CTES and name not in need:
                visit(CTES[name])
                if name not in need:
                    need.append(name)

    visit(body)
    return "with " + ",\n".join(f"{n} as ({CTES[n]})" for n in need) + "\n" + body if need else body


def dist(km: str, rest: str = "null") -> str:
    whens = " ".join(f"when {km} >= {lo}e0 and {km} < {hi}e0 then '{name}'" for lo, hi, name in BINS)
    return f"case when {km} is null then null {whens} else {rest} end"


def clip(x: str, leg: str) -> str:
    lo, hi = CLIPS[leg]
    return f"case when {x} is null then null else greatest({lo!r}e0, least({hi!r}e0, {x})) end"


def weighted_median(name: str, source: str, keys: list[str], value: str, weight: str, out: str, n: str) -> None:
    part = f"partition by {', '.join(keys)}" if keys else ""
    CTES[f"{name}_w"] = f"""select *, sum({weight}) over ({part} order by {value}, {weight} rows between unbounded preceding and current row) as cw_,
 sum({weight}) over ({part}) as tw_ from {source} where {value} is not null and {weight} is not null"""
    k = "".join(f"{x}, " for x in keys)
    CTES[name] = f"select {k}min(case when cw_ >= tw_ / 2 - tw_ * 1e-12 then {value} end) as {out}, count(*) as {n}, sum({weight}) as s_{n} from {name}_w {f'group by {", ".join(keys)}' if keys else ''}"


def recency(ts: str, source: str, half_life: float) -> str:
    return f"select *, exp(-ln(2e0) / {half_life!r}e0 * greatest((max({ts}) over () - {ts}) / 86400e0, 0e0)) as w from {source}"


def parents(name: str, cells: str, levels: list[tuple[str, str, list[str]]], value: str, n: str, out: str) -> None:
    """levels: (label, its expression, keys); value and n: the columns of each."""
    joins, vs, ls, ns = "", [], [], []
    for k, (label, cte, keys) in enumerate(levels):
        on = " and ".join(f"c.{x} is not distinct from p{k}.{x}" for x in keys) or "true"
        joins += f" left join {cte} p{k} on {on}"
        ok = f"p{k}.{value} is not null and p{k}.{n} > 0" if k < len(levels) - 1 else "true"
        vs.append(f"when {ok} then p{k}.{value}")
        ns.append(f"when {ok} then p{k}.{n}")
        ls.append(f"when {ok} then '{label}'")
    CTES[name] = f"select c.*, case {' '.join(vs)} end as {out}, cast(case {' '.join(ns)} end as bigint) as parent_n, case {' '.join(ls)} end as parent_level from {cells} c {joins}"


CTES["c_d"] = DELIVERIES_SQL.replace("{orders}", "orders").replace("{customer}", "customer").strip()
CTES["c_l0"] = """select *, cast(((created_s + 10800) // 3600) % 24 as int) as order_hr_ksa, cast(((created_s + 10800) // 86400 + 3) % 7 as int) as dow,
 cast(((departed_s + 10800) // 3600) % 24 as int) as pickup_hr_ksa, (accepted_s - created_s) / 60e0 as t1_actual_min, (departed_s - accepted_s) / 60e0 as t2_actual_min,
 (coalesce(at_customer_s, delivered_s) - departed_s) / 60e0 as t3_actual_min, (coalesce(at_customer_s, delivered_s) - created_s) / 60e0 as ETA_actual_min,
 (arrived_s - accepted_s) / 60e0 as t2a_actual_min, (departed_s - arrived_s) / 60e0 as t2b_actual_min, case when stacking_order_count >= 1 then 1 else 0 end as stack_bkt,
 pow(sin(radians(dropoff_lat - pickup_lat) / 2), 2) + cos(radians(pickup_lat)) * cos(radians(dropoff_lat)) * pow(sin(radians(dropoff_lon - pickup_lon) / 2), 2) as hav_a from c_d"""
CTES["c_l1"] = f"""select *, 6371e0 * 2 * atan2(sqrt(hav_a), sqrt(1 - hav_a)) as t3_dist_haversine_km, case when pickup_hr_ksa between 14 and 22 then 1 else 0 end as is_peak,
 {dist("t2_osrm_distance_km", "'20+'")} as t2_dist_bin, {dist("t3_osrm_distance_km", "'20+'")} as t3_dist_bin from c_l0"""
CTES["c_l2"] = """select *, t3_dist_haversine_km / greatest(t3_osrm_distance_km, 1e-6) as hr_, greatest(t3_dist_haversine_km, t3_osrm_distance_km) >= 2 as far_ from c_l1"""
CTES["c_legs"] = """select *, case when reason_ = '' then 0 else 1 end as t3_coord_flag, reason_ as t3_coord_reason from (select *,
 case when (pickup_lat = 0 and pickup_lon = 0) or (dropoff_lat = 0 and dropoff_lon = 0) then 'zero_coords'
  when not (pickup_lat between 16 and 33.5 and pickup_lon between 34 and 57 and dropoff_lat between 16 and 33.5 and dropoff_lon between 34 and 57) then 'out_of_bbox'
  when t3_osrm_distance_km is null or t3_osrm_distance_km < 0 then 'osrm_dist_missing'
  when t3_osrm_distance_km < 0.1 and t3_dist_haversine_km >= 1 then 'osrm_zero_vs_haversine'
  when far_ and hr_ >= 3 then 'hav/osrm_too_high' when far_ and hr_ <= 0.33 then 'hav/osrm_too_low' else '' end as reason_ from c_l2) x"""

# ratios
for leg, half, low, high, extra, ts in (
    ("t2a", 21.0, "t2a_actual_min between 0.2 and 120", "t2_osrm_duration_min between 0.2 and 90", "true", "coalesce(accepted_s, created_s)"),
    ("t3", 21.0, "t3_actual_min between 0.5 and 180", "t3_osrm_duration_min between 0.2 and 150", "t3_coord_flag = 0", "coalesce(departed_s, created_s)"),
):
    r = leg[:2]
    CTES[f"c_{leg}_rows"] = f"""select zone_name_en, pickup_hr_ksa, is_peak, {r}_dist_bin as dist_bin, {leg}_actual_min / {r}_osrm_duration_min as ratio, {leg}_actual_min, {ts} as ts_
 from c_legs where {low} and {high} and {extra} and {r}_osrm_distance_km is not null and pickup_hr_ksa is not null and zone_name_en is not null"""
    CTES[f"c_{leg}_wrows"] = recency("ts_", f"c_{leg}_rows", half)
    weighted_median(f"c_{leg}_cells0", f"c_{leg}_wrows", ["zone_name_en", "pickup_hr_ksa", "dist_bin"], "ratio", "w", "ratio_p50", "n")
    CTES[f"c_{leg}_cells"] = f"select zone_name_en, pickup_hr_ksa, dist_bin, ratio_p50, n, case when pickup_hr_ksa between 14 and 22 then 1 else 0 end as is_peak from c_{leg}_cells0"
    levels = [("ratio_hd", ["pickup_hr_ksa", "dist_bin"]), ("ratio_ipd", ["is_peak", "dist_bin"]), ("ratio_h", ["pickup_hr_ksa"]), ("ratio_ip", ["is_peak"]), ("ratio_g", [])]
    for label, keys in levels:
        weighted_median(f"c_{leg}_{label}", f"c_{leg}_cells", keys, "ratio_p50", "n", "v_", "m_")
    parents(f"c_{leg}_par", f"c_{leg}_cells", [(label, f"c_{leg}_{label}", keys) for label, keys in levels], "v_", "s_m_", "parent_ratio")

#: An external table of ratios by zone, hour and distance, for a part of the cells.
CTES["c_t3_ext"] = "select zone_name_en, pickup_hr_ksa, dist_bin, 0.5e0 + pickup_hr_ksa / 10e0 as ratio_p50, cast(40 as bigint) as n from c_t3_cells where pickup_hr_ksa % 3 = 0"
_KEYS = "zone_name_en, pickup_hr_ksa, dist_bin, is_peak, ratio_p50 as ratio_cell, n as n_cell, parent_ratio, parent_n, parent_level"
CTES["c_t2a_smoothed"] = f"select {_KEYS}, cast(null as double) as ratio_prior, cast(0 as bigint) as n_prior, (n * ratio_p50 + 60e0 * parent_ratio) / (n + 60) as ratio_smoothed from c_t2a_par"
CTES["c_t3_smoothed"] = f"select {_KEYS}, cast(null as double) as ratio_prior, cast(0 as bigint) as n_prior, (n * ratio_p50 + 30e0 * parent_ratio) / (n + 30) as ratio_smoothed from c_t3_par"
_PRIOR = "(select c.*, e.ratio_p50 as ratio_prior, e.n as n_prior from c_t3_par c left join c_t3_ext e using (zone_name_en, pickup_hr_ksa, dist_bin)) x"
CTES["c_t3_balanced"] = f"""select {_KEYS}, ratio_prior, n_prior, (n * ratio_p50 + 30e0 * parent_ratio + case when ratio_prior is null then 0 else 80e0 * ratio_prior end)
 / (n + 30 + case when ratio_prior is null then 0 else 80 end) as ratio_smoothed from {_PRIOR}"""
CTES["c_t3_reference"] = f"""select {_KEYS}, ratio_prior, n_prior, (n * ratio_p50 + 30e0 * parent_ratio + 80e0 * coalesce(ratio_prior, parent_ratio))
 / (n + 30 + case when ratio_prior is null then 0 else 80 end) as ratio_smoothed from {_PRIOR}"""


def ratio_lookup(name: str, facts: str, table: str, bin_: str, out: str, source: str, n: str) -> None:
    CTES[f"{name}_pb"] = f"select is_peak, dist_bin, median(ratio_smoothed) as m from {table} group by all"
    CTES[f"{name}_h"] = f"select pickup_hr_ksa, median(ratio_smoothed) as m from {table} group by all"
    CTES[f"{name}_g"] = f"select median(ratio_smoothed) as m from {table}"
    CTES[name] = f"""select f.*, case when t.n_cell is not null then t.ratio_smoothed when pb.is_peak is not null then pb.m when h.pickup_hr_ksa is not null then h.m else g.m end as {out},
 case when t.n_cell is not null then 'zone_hour_dist_smoothed' when pb.is_peak is not null then 'fallback:is_peak_dist' when h.pickup_hr_ksa is not null then 'fallback:hour' else 'fallback:global' end as {source},
 coalesce(t.n_cell, 0) as {n} from {facts} f left join {table} t on t.zone_name_en = f.zone_name_en and t.pickup_hr_ksa = f.pickup_hr_ksa and t.dist_bin = f.{bin_}
 left join {name}_pb pb on pb.is_peak = f.is_peak and pb.dist_bin = f.{bin_} left join {name}_h h on h.pickup_hr_ksa = f.pickup_hr_ksa cross join {name}_g g"""


ratio_lookup("c_t2a_hit", "c_legs", "c_t2a_smoothed", "t2_dist_bin", "t2a_ratio_p50", "t2a_ratio_src", "t2a_n_cell")
CTES["c_t2a"] = f"select *, coalesce({clip('t2_osrm_duration_min * t2a_ratio_p50', 'T2a')}, 0e0) as T2a_P50 from c_t2a_hit"

# third leg without routes
CTES["c_base_rows"] = "select * from c_t3_wrows"
weighted_median("c_base_cells", "c_base_rows", ["zone_name_en", "pickup_hr_ksa", "is_peak"], "t3_actual_min", "w", "value_cell", "n_cell")
for label, keys in (("val_h", ["pickup_hr_ksa"]), ("val_ip", ["is_peak"]), ("val_g", [])):
    weighted_median(f"c_base_{label}", "c_base_rows", keys, "t3_actual_min", "w", "v_", "m_")
parents("c_base_par", "c_base_cells", [("val_h", "c_base_val_h", ["pickup_hr_ksa"]), ("val_ip", "c_base_val_ip", ["is_peak"]), ("val_g", "c_base_val_g", [])], "v_", "m_", "parent_value")
CTES["c_baseline"] = "select zone_name_en, pickup_hr_ksa, is_peak, value_cell, n_cell, parent_value, parent_n, parent_level, (n_cell * value_cell + 30e0 * parent_value) / (n_cell + 30) as value_smoothed from c_base_par"
CTES["c_bl_h"] = "select pickup_hr_ksa, median(value_smoothed) as m from c_baseline group by all"
CTES["c_bl_p"] = "select is_peak, median(value_smoothed) as m from c_baseline group by all"
CTES["c_bl_g"] = "select median(value_smoothed) as m from c_baseline"

# dwell
CTES["c_dw"] = "select zone_name_en, pickup_hr_ksa, greatest(0e0, least(60e0, (delivered_s - at_customer_s) / 60e0)) as dwell_min from c_legs where at_customer_s is not null and delivered_s is not null"
CTES["c_dw_h"] = "select pickup_hr_ksa, median(dwell_min) as dwell_h, count(*) as n_h from c_dw where pickup_hr_ksa is not null group by all"
CTES["c_dwell"] = """select zone_name_en, pickup_hr_ksa, dwell_cell, n_cell, dwell_h as dwell_parent, n_h as n_parent, (n_cell * dwell_cell + 80e0 * dwell_h) / (n_cell + 80) as dwell_smoothed
 from (select zone_name_en, pickup_hr_ksa, median(dwell_min) as dwell_cell, count(*) as n_cell from c_dw where zone_name_en is not null and pickup_hr_ksa is not null group by all) x join c_dw_h using (pickup_hr_ksa)"""

# waiting
CTES["c_t2b_cells"] = "select shop_id, sub_vertical_name, pickup_hr_ksa, dow, median(t2b_actual_min) as value_p50, count(*) as n from c_legs where t2b_actual_min between 0 and 90 and pickup_hr_ksa is not null group by all"
for label, keys in (("val_svh", ["sub_vertical_name", "pickup_hr_ksa", "dow"]), ("val_hd", ["pickup_hr_ksa", "dow"]), ("val_g", [])):
    weighted_median(f"c_t2b_{label}", "c_t2b_cells", keys, "value_p50", "n", "v_", "m_")
parents("c_t2b_par", "c_t2b_cells", [("val_svh", "c_t2b_val_svh", ["sub_vertical_name", "pickup_hr_ksa", "dow"]), ("val_hd", "c_t2b_val_hd", ["pickup_hr_ksa", "dow"]), ("val_g", "c_t2b_val_g", [])], "v_", "s_m_", "parent_value")
CTES["c_t2b_smoothed"] = "select shop_id, sub_vertical_name, pickup_hr_ksa, dow, value_p50 as value_cell, n as n_cell, parent_value, parent_n, parent_level, (n * value_p50 + 80e0 * parent_value) / (n + 80) as value_smoothed from c_t2b_par"
CTES["c_po0"] = f"select *, cast(((accepted_s + 10800) // 3600) % 24 as int) as pickup_hr_ksa, cast(((accepted_s + 10800) // 86400 + 3) % 7 as int) as dow from ({PREP_ORDER_SQL.replace('{deliveries}', 'c_d')}) x"
CTES["c_po1"] = recency("departed_s", "c_po0", 28.0)
weighted_median("c_prior_order", "c_po1", ["shop_id", "sub_vertical_name", "pickup_hr_ksa", "dow"], "prep_time_min", "w", "prior_p50", "n_prior")
CTES["c_prior_shop"] = f"select shop_id, -1 as pickup_hr_ksa, -1 as dow, prep_time_sec / 60 as prior_p50, cast(1 as bigint) as n_prior from ({PREP_SHOP_SQL.replace('{deliveries}', 'c_d')}) x"
CTES["c_prior_vertical"] = f"select sub_vertical_name, -1 as pickup_hr_ksa, dow, prep_time_min as prior_p50, cast(1 as bigint) as n_prior from ({PREP_VERTICAL_SQL.replace('{deliveries}', 'c_d')}) x"


def _blend(relax: str) -> str:
    shop = "left join c_prior_shop s on s.shop_id = b.shop_id" if relax == "both" else "left join (select * from c_prior_shop where false) s on s.shop_id = b.shop_id"
    return f"""select b.shop_id, b.sub_vertical_name, b.pickup_hr_ksa, b.dow, value_cell, n_cell, parent_value, parent_n, parent_level,
 coalesce(o.prior_p50, s.prior_p50, v.prior_p50, parent_value) as prior_p50, coalesce(o.n_prior, s.n_prior, v.n_prior, 0) as n_prior,
 (n_cell * value_cell + 80e0 * parent_value + 120e0 * coalesce(o.prior_p50, s.prior_p50, v.prior_p50, parent_value)) / (n_cell + 200) as value_smoothed
 from c_t2b_smoothed b left join c_prior_order o on o.shop_id = b.shop_id and o.sub_vertical_name = b.sub_vertical_name and o.pickup_hr_ksa = b.pickup_hr_ksa and o.dow = b.dow
 {shop} left join c_prior_vertical v on v.sub_vertical_name = b.sub_vertical_name and v.dow = b.dow"""


CTES["c_blend"] = _blend("both")
CTES["c_blend_reference"] = _blend("reference")
CTES["c_vl_x"] = "select shop_id, pickup_hr_ksa, dow, arg_min(value_smoothed, sub_vertical_name) as v, arg_min(n_cell, sub_vertical_name) as n from c_blend group by all"
CTES["c_vl_sv"] = "select sub_vertical_name, pickup_hr_ksa, dow, median(value_smoothed) as m from c_blend group by all"
CTES["c_vl_hd"] = "select pickup_hr_ksa, dow, median(value_smoothed) as m from c_blend group by all"
CTES["c_vl_g"] = "select median(value_smoothed) as m from c_blend"
CTES["c_t2b_hit"] = """select f.*, coalesce(x.v, sv.m, hd.m, g.m) as t2b_value_p50, coalesce(x.n, 0) as t2b_n_cell,
 case when x.v is not null then 'shop_hour_dow' when sv.m is not null then 'fallback:subvertical_hour_dow' when hd.m is not null then 'fallback:hour_dow' else 'fallback:global' end as t2b_value_src
 from c_t2a f left join c_vl_x x on x.shop_id = f.shop_id and x.pickup_hr_ksa = f.pickup_hr_ksa and x.dow = f.dow
 left join c_vl_sv sv on sv.sub_vertical_name = f.sub_vertical_name and sv.pickup_hr_ksa = f.pickup_hr_ksa and sv.dow = f.dow
 left join c_vl_hd hd on hd.pickup_hr_ksa = f.pickup_hr_ksa and hd.dow = f.dow cross join c_vl_g g"""
CTES["c_t2"] = f"select *, {clip('T2a_P50 + T2b_P50', 'T2')} as T2_P50 from (select *, {clip('t2b_value_p50', 'T2b')} as T2b_base_P50, {clip('t2b_value_p50', 'T2b')} as T2b_P50 from c_t2b_hit) x"

# bias
CTES["c_split"] = "select *, row_number() over (order by created_s, order_id) <= floor(count(*) over () * 0.8e0) as is_train from c_t2"
CTES["c_bias0"] = "select zone_name_en, pickup_hr_ksa, stack_bkt, created_s, t2_actual_min - (T2a_P50 + T2b_P50) as t2_resid from c_split where is_train and t2_actual_min is not null and pickup_hr_ksa is not null and zone_name_en is not null"
CTES["c_bias1"] = recency("created_s", "c_bias0", 10.0)
weighted_median("c_bias_cells", "c_bias1", ["zone_name_en", "pickup_hr_ksa", "stack_bkt"], "t2_resid", "w", "bias_cell", "n_cell")
_B = [("bias_zh", ["zone_name_en", "pickup_hr_ksa"]), ("bias_hb", ["pickup_hr_ksa", "stack_bkt"]), ("bias_h", ["pickup_hr_ksa"]), ("bias_g", [])]
for label, keys in _B:
    weighted_median(f"c_{label}", "c_bias1", keys, "t2_resid", "w", "v_", "m_")
parents("c_bias_par", "c_bias_cells", [(label, f"c_{label}", keys) for label, keys in _B], "v_", "m_", "parent_bias")
CTES["c_bias"] = "select zone_name_en, pickup_hr_ksa, stack_bkt, bias_cell, n_cell, parent_bias, parent_level, (n_cell * bias_cell + 250e0 * parent_bias) / (n_cell + 250) as bias_smoothed from c_bias_par"
CTES["c_corr"] = f"""select *, {clip("T2_P50 + T2_bias_corr", "T2")} as T2_P50_CORR from (select f.*, case when b.n_cell >= 12 and abs(b.bias_smoothed) >= 0.5 then greatest(-5e0, least(5e0, b.bias_smoothed)) else 0e0 end as T2_bias_corr
 from c_t2 f left join c_bias b on b.zone_name_en = f.zone_name_en and b.pickup_hr_ksa = f.pickup_hr_ksa and b.stack_bkt = f.stack_bkt) x"""

# the whole
ratio_lookup("c_t3_hit", "c_corr", "c_t3_smoothed", "t3_dist_bin", "t3_ratio_p50", "t3_ratio_source", "t3_n_cell")
ratio_lookup("c_t3_only", "c_legs", "c_t3_smoothed", "t3_dist_bin", "t3_ratio_p50", "t3_ratio_source", "t3_n_cell")


def third(name: str, facts: str) -> None:
    CTES[f"{name}_r"] = f"select *, {clip('t3_osrm_duration_min * t3_ratio_p50', 'T3')} as T3_osrmratio_P50 from {facts}"
    CTES[f"{name}_b"] = f"""select f.*, coalesce(t.value_smoothed, h.m, p.m, g.m) as b_, case when t.n_cell is not null then 'zone_hour_smoothed' when h.pickup_hr_ksa is not null then 'fallback:hour' when p.is_peak is not null then 'fallback:is_peak' else 'fallback:global' end as bs_
 from {name}_r f left join c_baseline t on t.zone_name_en = f.zone_name_en and t.pickup_hr_ksa = f.pickup_hr_ksa left join c_bl_h h on h.pickup_hr_ksa = f.pickup_hr_ksa
 left join c_bl_p p on p.is_peak = f.is_peak cross join c_bl_g g"""
    CTES[name] = f"""select *, case when t3_coord_flag = 1 then 'zone_hour_fallback' else 'osrm_ratio' end as t3_pred_mode, case when t3_coord_flag = 1 then {clip("b_", "T3")} else T3_osrmratio_P50 end as T3_base_P50,
 case when t3_coord_flag = 1 then bs_ else 'osrm_ratio' end as t3_ratio_source_fallback from {name}_b"""


third("c_t3_base", "c_t3_hit")
third("c_t3_alone", "c_t3_only")


def fourth(name: str, facts: str) -> None:
    need = "f.at_customer_s is null and f.delivered_s is not null"
    CTES[name] = f"""select f.*, case when {need} then greatest(0e0, least(60e0, coalesce(c.dwell_smoothed, h.dwell_h, g.m))) else 0e0 end as T4_dwell_P50,
 case when not ({need}) then 'none' when c.dwell_smoothed is not null then 'zone_hour_dwell' when h.dwell_h is not null then 'hour_dwell' else 'global_dwell' end as dwell_source
 from {facts} f left join c_dwell c on c.zone_name_en = f.zone_name_en and c.pickup_hr_ksa = f.pickup_hr_ksa left join c_dw_h h on h.pickup_hr_ksa = f.pickup_hr_ksa cross join (select coalesce(median(dwell_min), 0e0) as m from c_dw) g"""


fourth("c_t4", "c_t3_base")
fourth("c_t4_only", "c_legs")
CTES["c_late"] = "select * from c_eta where order_id not in (select order_id from c_split where is_train)"
CTES["c_eta"] = """select *, T1_P50 + T2_P50 + T3_P50 as ETA_P50, T1_P50 + T2_P50_CORR + T3_P50 as ETA_P50_CORR from (select f.*, T3_base_P50 + T4_dwell_P50 as T3_P50, t1.m as T1_P50,
 0e0 as T2b_resid_P50, 0e0 as T2b_resid_gated from c_t4 f cross join (select median(t1_actual_min) as m from c_legs where t1_actual_min between 0 and 60) t1) x"""

# enrichment
CTES["c_e0"] = """select *, case when departed_s is null then null else cast(((departed_s + 10800) // 3600) % 24 as int) end as hr_, (accepted_s - created_s) / 60e0 as t1, (arrived_s - accepted_s) / 60e0 as t2,
 (coalesce(at_customer_s, delivered_s) - departed_s) / 60e0 as t3, abs(pickup_lat) > 40 and abs(pickup_lon) < 40 as ps, abs(dropoff_lat) > 40 and abs(dropoff_lon) < 40 as ds from c_d"""
CTES["c_e1"] = """select * exclude (pickup_lat, pickup_lon, dropoff_lat, dropoff_lon), case when ps then pickup_lon else pickup_lat end as pickup_lat, case when ps then pickup_lat else pickup_lon end as pickup_lon,
 case when ds then dropoff_lon else dropoff_lat end as dropoff_lat, case when ds then dropoff_lat else dropoff_lon end as dropoff_lon
 from c_e0 where (t1 is null or t1 between 0.1 and 60) and (t2 is null or t2 between 0.2 and 60) and (t3 is null or t3 between 0.5 and 150)"""


def _hav(a: str, b: str, c: str, d: str) -> str:
    x = f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    return f"6371e0 * 2 * atan2(sqrt({x}), sqrt(1 - {x}))"


_E = {"t2": ("courier_latitude_at_assignment", "courier_longitude_at_assignment", "pickup_lat", "pickup_lon"), "t3": ("pickup_lat", "pickup_lon", "dropoff_lat", "dropoff_lon")}
CTES["c_e2"] = "select *, " + ", ".join(f"case when {a} is null then null else printf('%.5f,%.5f→%.5f,%.5f', {a}, {b}, {c}, {d}) end as {leg}_pair_key, {_hav(a, b, c, d)} * 1.3e0 as {leg}_km" for leg, (a, b, c, d) in _E.items()) + " from c_e1"
CTES["c_e3"] = "select *, " + ", ".join(f"{leg}_km / 30e0 * 60 as {leg}_dur, case when {leg}_km = 0 then null else {leg} / ({leg}_km / 30e0 * 60) end as {leg}_ratio" for leg in _E) + " from c_e2"

# earlier model
CTES["c_resid"] = """select *, greatest(-15e0, least(45e0, t2_actual_min - t2_osrm_duration_min * t2a_ratio_p50)) as t2_resid from c_t2a_hit
 where t2_actual_min between 0.5 and 240 and t2_osrm_duration_min is not null and t2a_ratio_p50 is not null"""
CTES["c_guard"] = "select zone_name_en, is_peak, stack_bkt, avg(t2_resid) as guard_mean from c_resid where zone_name_en is not null group by all"

# the earlier model's own plan: ratios from the calibration tables of the enriched orders
for leg, n0 in (("t2", 50), ("t3", 30)):
    CTES[f"c_v_{leg}_cells"] = f"""select zone_name_en, hr_ as pickup_hr_ksa, {dist(f"{leg}_km")} as dist_bin, median({leg}_ratio) as ratio_p50, count(*) as n, case when hr_ between 14 and 22 then 1 else 0 end as is_peak
 from c_e3 where hr_ is not null and zone_name_en is not null and {leg}_km < 1e9 and {leg}_ratio is not null group by all"""
    for label, keys in (("hd", ["pickup_hr_ksa", "dist_bin"]), ("ipd", ["is_peak", "dist_bin"]), ("h", ["pickup_hr_ksa"]), ("ip", ["is_peak"]), ("g", [])):
        weighted_median(f"c_v_{leg}_of_{label}", f"c_v_{leg}_cells", keys, "ratio_p50", "n", "v_", "m_")
    parents(f"c_v_{leg}_par", f"c_v_{leg}_cells", [(f"ratio_{x}", f"c_v_{leg}_of_{x}", k) for x, k in (("hd", ["pickup_hr_ksa", "dist_bin"]), ("ipd", ["is_peak", "dist_bin"]), ("h", ["pickup_hr_ksa"]), ("ip", ["is_peak"]), ("g", []))], "v_", "s_m_", "parent_ratio")
    CTES[f"c_v_{leg}_smoothed"] = f"select zone_name_en, pickup_hr_ksa, dist_bin, is_peak, n as n_cell, parent_level, (n * ratio_p50 + {n0}e0 * parent_ratio) / (n + {n0}) as ratio_smoothed from c_v_{leg}_par"
ratio_lookup("c_v_hit", "c_legs", "c_v_t2_smoothed", "t2_dist_bin", "t2_ratio_p50", "t2_ratio_source", "t2_n_cell")
CTES["c_v_stats"] = """select cast(mbo_chain_id as varchar) as chain_, median(prep_time_min) as prep_shop_p50, quantile_cont(prep_time_min, 0.75) - quantile_cont(prep_time_min, 0.25) as prep_shop_iqr, count(*) as prep_shop_cnt
 from c_po0 join (select order_id, mbo_chain_id from c_d) o using (order_id) group by 1"""
CTES["c_v_shop"] = "select mbo_chain_id, sum(prep_time_min) / count(*) as prep_shop_mean from c_po0 join (select order_id, mbo_chain_id from c_d) o using (order_id) where mbo_chain_id % 3 <> 0 group by 1"
CTES["c_v_vert"] = "select sub_vertical_name, sum(prep_time_min) / count(*) as prep_vert_mean from c_po0 where sub_vertical_name <> 'V4' group by 1"
CTES["c_v_prep"] = """select f.*, t2_osrm_duration_min * t2_ratio_p50 as T2_osrm_ratio_pred, prep_shop_mean, prep_vert_mean, prep_shop_p50, prep_shop_iqr, prep_shop_cnt from c_v_hit f
 left join c_v_shop using (mbo_chain_id) left join c_v_vert using (sub_vertical_name) left join c_v_stats s on s.chain_ = cast(f.mbo_chain_id as varchar)"""
CTES["c_v_train"] = "select *, greatest(-15e0, least(45e0, t2_actual_min - T2_osrm_ratio_pred)) as t2_resid from c_v_prep where t2_actual_min between 0.5 and 240 and T2_osrm_ratio_pred is not null"
CTES["c_v_guard"] = "select zone_name_en, is_peak, stack_bkt, avg(t2_resid) as g_ from c_v_train where zone_name_en is not null group by all"
CTES["c_v_t2"] = f"""select *, 0e0 as T2_resid_P50, {clip("T2_osrm_ratio_pred + guard_adj", "T2")} as T2_P50 from (select f.*, case when f.zone_name_en in ('Z0', 'Z1', 'Z2', 'Z3', 'Z4', 'Z5') and f.is_peak = 1 and g.g_ > 0 then 0.7e0 * g.g_ else 0e0 end as guard_adj
 from c_v_prep f left join c_v_guard g on g.zone_name_en = f.zone_name_en and g.is_peak = f.is_peak and g.stack_bkt = f.stack_bkt) x"""
ratio_lookup("c_v_t3", "c_v_t2", "c_v_t3_smoothed", "t3_dist_bin", "t3_ratio_p50", "t3_ratio_source", "t3_n_cell")
fourth("c_v_t4", "c_v_t3")
CTES["c_v_eta"] = f"""select *, T3_base_P50 + T4_dwell_P50 as T3_P50, T1_P50 + T2_P50 + T3_base_P50 + T4_dwell_P50 as ETA_P50 from (select f.*, {clip("t3_osrm_duration_min * t3_ratio_p50", "T3")} as T3_base_P50, m as T1_P50
 from c_v_t4 f cross join (select median(t1_actual_min) as m from c_legs where t1_actual_min between 0 and 60) y) x"""

# what the boosted models are given
CTES["c_t1_train"] = "select * from c_legs where t1_actual_min between 0 and 60"
CTES["c_t1_levels"] = " union all ".join(f"select '{c}' as name, cast({c} as varchar) as v, count(*) as n from c_t1_train where {c} is not null group by 2" for c in ("sub_vertical_name", "zone_name_en", "business_branch_name", "shop_id", "mbo_chain_id"))
CTES["c_t2b_train0"] = "select *, greatest(-10e0, least(30e0, t2b_actual_min - T2b_base_P50)) as t2b_resid from c_t2 where t2b_actual_min is not null and T2b_base_P50 is not null"

# the first tree of the first leg's model. Fixed values, apart from those of the library: features in order, the least rows of a side and of a level that isn't pooled, the bins of a number.
_NUMS = ("stacking_order_count", "accepted_courier_count", "rejected_courier_count", "pickup_lat", "pickup_lon", "dropoff_lat", "dropoff_lon", "order_hr_ksa", "dow")
_CATS = ("sub_vertical_name", "zone_name_en", "business_branch_name", "shop_id", "mbo_chain_id")
CTES["c_f_rows"] = "select order_id as rid, t1_actual_min as y, t1_actual_min >= median(t1_actual_min) over () as up, t1_actual_min - median(t1_actual_min) over () as r, * from c_t1_train"
CTES["c_f_x"] = " union all ".join(f"select rid, {k} as f, coalesce(cast({c} as double), median(cast({c} as double)) over ()) as x from c_f_rows" for k, c in enumerate(_NUMS))
CTES["c_f_sorted"] = "select f, x, row_number() over (partition by f order by x) - 1 as at_, count(*) over (partition by f) as n, max(x) over (partition by f) as top, (select count(distinct z.x) from c_f_x z where z.f = c_f_x.f) as many from c_f_x"
CTES["c_f_edges"] = "select *, row_number() over (partition by f order by x) - 1 as code from (select distinct f, x from c_f_sorted where x < top and (many <= 256 or at_ in (select k * n // 256 from range(1, 256) t(k)))) e"
CTES["c_f_codes"] = "select f, x, (select count(*) from c_f_edges e where e.f = v.f and e.x < v.x) as code from (select distinct f, x from c_f_x) v"
CTES["c_f_mode"] = "select name, arg_min(v, (-n, v)) as mode from c_t1_levels group by name"
CTES["c_f_levels"] = """select name, v, case when n < 10 then '_rare' when n >= 20 then v end as level, dense_rank() over (partition by name order by case when n < 10 then 1 else 0 end, case when n < 10 then '' else v end) as code
 from c_t1_levels where n < 10 or n >= 20"""
CTES["c_f_all"] = "select rid, f, code from c_f_x join c_f_codes using (f, x) union all " + " union all ".join(
    f"select rid, {len(_NUMS) + k} as f, code from (select rid, coalesce(cast({c} as varchar), (select mode from c_f_mode where name = '{c}')) as v from c_f_rows) s join (select v, code from c_f_levels where name = '{c}') l using (v)" for k, c in enumerate(_CATS)
)
CTES["c_f_node0"] = "select rid, up, 0 as node from c_f_rows"
for _d in range(4):
    _first, _last = 2**_d - 1, 2 ** (_d + 1) - 2
    CTES[f"c_f_sum{_d}"] = f"select node, f, code, count(*) as n, sum(up::int) as p from c_f_node{_d} join c_f_all using (rid) where node between {_first} and {_last} group by all"
    CTES[f"c_f_all{_d}"] = f"select node, count(*) as t, sum(up::int) as a from c_f_node{_d} group by node"
    CTES[f"c_f_side{_d}"] = f"""select node, f, code, t, a, case when f < {len(_NUMS)} then sum(n) over w else n end as n, case when f < {len(_NUMS)} then sum(p) over w else p end as p
 from c_f_sum{_d} join c_f_all{_d} using (node) window w as (partition by node, f order by code rows between unbounded preceding and current row)"""
    CTES[f"c_f_gain{_d}"] = f"""select *, (1e0 * m * (2 * p - n) - 1e0 * n * (2 * q - m)) * (1e0 * m * (2 * p - n) - 1e0 * n * (2 * q - m)) / (1e0 * n * m) as g
 from (select *, t - n as m, a - p as q from c_f_side{_d}) x where n >= 20 and m >= 20 and t >= 40 and a > 0 and a < t"""
    CTES[f"c_f_best{_d}"] = f"select node, f, code from c_f_gain{_d} qualify row_number() over (partition by node order by g desc, f, code) = 1"
    CTES[f"c_f_node{_d + 1}"] = f"""select n.rid, n.up, case when b.f is null then n.node else 2 * n.node + 1 + coalesce(case when b.f < {len(_NUMS)} then x.code > b.code else x.code = b.code end, false)::int end as node
 from c_f_node{_d} n left join c_f_best{_d} b on b.node = n.node left join c_f_all x on x.rid = n.rid and x.f = b.f"""
CTES["c_f_tree"] = f"""select node, ({list(_NUMS + _CATS)!r})[f + 1] as feature, (select x from c_f_edges e where e.f = b.f and e.code = b.code) as at_most,
 case when f >= {len(_NUMS)} then (select any_value(level) from c_f_levels l where l.name = ({list(_NUMS + _CATS)!r})[f + 1] and l.code = b.code) end as level, cast(null as double) as value
 from ({' union all '.join(f'select * from c_f_best{d}' for d in range(4))}) b
 union all select node, null as feature, null as at_most, null as level, median(r) as value from c_f_node4 join (select rid, r from c_f_rows) r using (rid) group by node"""

# the later fifth of the orders, by tables that only the earlier ones taught. Every expression of the estimate is there once
# more: taught (c_a_...) over the earlier orders, and looked up (c_u_...) from the later ones in those tables.
CTES["c_a_d"] = "select * exclude (rank_) from (select *, row_number() over (order by created_s, order_id) <= floor(count(*) over () * 0.8e0) as rank_ from c_d) x where rank_"
CTES["c_u_d"] = "select * exclude (rank_) from (select *, row_number() over (order by created_s, order_id) <= floor(count(*) over () * 0.8e0) as rank_ from c_d) x where not rank_"
#: What is looked up, or reads the looked-up orders; all else is taught.
_LOOKED_UP = ("l0", "l1", "l2", "legs", "t2a_hit", "t2a", "t2b_hit", "t2", "corr", "t3_hit", "t3_base_r", "t3_base_b", "t3_base", "t4", "eta")
for _name in [*CTES]:
    if _name not in ("c_d", "c_a_d", "c_u_d") and not _name.startswith(("c_f_", "c_v_")):
        CTES["c_a_" + _name[2:]] = re.sub(r"\bc_(?!a_|u_)", "c_a_", CTES[_name])
for _name in _LOOKED_UP:
    CTES[f"c_u_{_name}"] = re.sub(r"\bc_(?!a_|u_)(\w+)", lambda m: ("c_u_" if m[1] in (*_LOOKED_UP, "d") else "c_a_") + m[1], CTES[f"c_{_name}"])
# tables that are given, and so are the same
CTES["c_a_prior_shop"], CTES["c_a_prior_vertical"] = CTES["c_prior_shop"], CTES["c_prior_vertical"]
# the first leg's median is taught too
CTES["c_u_eta"] = CTES["c_u_eta"].replace("from c_u_legs where t1_actual_min between", "from c_a_legs where t1_actual_min between")
