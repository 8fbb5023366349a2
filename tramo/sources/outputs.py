"""The whole set of output tables under one folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramo.operators import diagnostics, enrich
from tramo.plans import delivery, legacy
from tramo.sources.files import write_table
from tramo.tables import drop_folder


def publish(spark: SparkSession, folder: str, write: Callable[[str], None]) -> str:
    """Runs write with a new folder under folder, and then names it the one that counts. The new folder.

    Until the last step, a file that appears whole under a name of its own, readers see the set before: a run that ends
    half-way changes nothing for them. Older sets stay until prune.
    """
    fs, top = _fs(spark, folder)
    path = spark._jvm.org.apache.hadoop.fs.Path
    name = f"{max([number for number, _ in _manifests(spark, folder)], default=0) + 1:08d}-{uuid.uuid4().hex[:8]}"
    write(f"{folder}/sets/{name}")
    fs.mkdirs(path(f"{folder}/published"))
    draft = path(f"{folder}/published/_{name}")
    fs.create(draft, True).close()
    if not fs.rename(draft, path(f"{folder}/published/{name}")):
        raise OSError(f"{folder}: {name} could not be published")
    return f"{folder}/sets/{name}"


def _fs(spark: SparkSession, folder: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _manifests(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """Number and name of each published set, in order."""
    fs, p = _fs(spark, f"{folder}/published")
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return sorted((int(n.partition("-")[0]), n) for n in names if not n.startswith(("_", ".")))


def published(spark: SparkSession, folder: str) -> str:
    """The folder of the set that was published last."""
    found = _manifests(spark, folder)
    if not found:
        raise FileNotFoundError(f"{folder}: nothing has been published")
    return f"{folder}/sets/{found[-1][1]}"


def prune(spark: SparkSession, folder: str, keep: int = 2) -> None:
    """Deletes all sets but the last ones that were published, and what runs left that ended half-way."""
    fs, p = _fs(spark, f"{folder}/sets")
    stay = {name for _, name in _manifests(spark, folder)[-keep:]}
    for name in [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []:
        if name not in stay:
            drop_folder(spark, f"{folder}/published/{name}")
            drop_folder(spark, f"{folder}/sets/{name}")


def write_enriched(df: DataFrame, folder: str, kind: str = "parquet") -> None:
    """df: enriched orders, all their columns; and the three calibration tables, sorted by their keys."""
    write_table(df, f"{folder}/orders_enriched", kind=kind)
    write_table(enrich.calibrate_t1(df), f"{folder}/t1_calibration", ["pickup_hr_ksa", "zone_name_en"], kind)
    for leg in ("t2", "t3"):
        write_table(enrich.calibrate_ratios(df, leg), f"{folder}/{leg}_calibration", ["pickup_hr_ksa", "zone_name_en", "dist_bin"], kind)


def _reports(predictions: DataFrame, folder: str, legs, zone_hours: dict[str, str], kind: str) -> None:
    for name, part in legs.items():
        write_table(diagnostics.by_leg(predictions, part), f"{folder}/{name}", kind=kind)
    for name, column in zone_hours.items():
        write_table(diagnostics.by_zone_hour(predictions, column), f"{folder}/{name}", [F.desc("MAE"), "zone_name_en", "pickup_hr_ksa"], kind)


def write_delivery(plan: delivery.Delivery, folder: str, kind: str = "parquet") -> None:
    """Calibration tables, diagnostics of all and of held-out orders, coverage, sources, predictions, and the models if there are any."""
    tables = {"t2a_ratio_smoothed": plan.t2a_smoothed, "t3_ratio_smoothed": plan.t3_smoothed, "t3_baseline": plan.t3_baseline, "dwell": plan.dwell[0], "t2b_smoothed": plan.t2b_blend}
    tables |= {"t2b_prior_blend_summary": delivery.blend_summary(plan.t2b_blend), "t2_bias_map": plan.bias_map}
    for name, table in tables.items():
        write_table(table, f"{folder}/{name}", kind=kind)
    raw = [x for x in diagnostics.LEGS if x[0] in ("T1", "T2_raw", "T3", "ETA_raw")]
    corrected = [x for x in diagnostics.LEGS if x[0] in ("T2_corrected", "ETA_corrected")]
    for suffix, rows in (("", plan.predictions), ("_holdout", plan.held_out)):
        legs = {f"eta_leg_diagnostics{suffix}": raw, f"eta_leg_diagnostics_corrected{suffix}": corrected}
        _reports(rows, folder, legs, {f"zone_hour_diagnostics{suffix}": "ETA_P50", f"zone_hour_diagnostics_corrected{suffix}": "ETA_P50_CORR"}, kind)
    text = diagnostics.coverage_text(diagnostics.coverage(plan.predictions, plan.p).first(), plan.p)
    spark = plan.predictions.sparkSession
    write_table(spark.createDataFrame([(text.rstrip("\n"),)], "value string").coalesce(1), f"{folder}/coverage_report", kind="text")
    write_table(delivery.ratio_sources(plan.predictions), f"{folder}/ratio_sources", kind=kind)
    write_table(delivery.order_predictions(plan.predictions), f"{folder}/order_level_predictions", kind=kind)
    for name, model in (("t1_p50", plan.t1_model), ("t2b_resid_p50", plan.t2b_model)):
        if model is not None:
            model.save(f"{folder}/{name}", spark)


def write_earlier(plan: legacy.Earlier, folder: str, kind: str = "parquet") -> None:
    """The earlier model's tables, diagnostics, sources and predictions, and its models if there are any."""
    d = plan.predictions
    write_table(plan.t2_smoothed, f"{folder}/t2_ratio_smoothed", kind=kind)
    write_table(plan.t3_smoothed, f"{folder}/t3_ratio_smoothed", kind=kind)
    _reports(d, folder, {"eta_leg_diagnostics": legacy.LEGS}, {"zone_hour_diagnostics": "ETA_P50"}, kind)
    write_table(d.select("order_id", "t2_ratio_source", "t3_ratio_source", "dwell_source"), f"{folder}/ratio_sources", kind=kind)
    write_table(d.select(*legacy.PREDICTION_COLUMNS), f"{folder}/order_level_predictions", kind=kind)
    for name, model in (("t1_p50", plan.t1_model), ("t2_resid_p50", plan.t2_model)):
        if model is not None:
            model.save(f"{folder}/{name}", d.sparkSession)
