"""Constants of the delivery-time model, and the switches where its published behaviour leaves a choice."""

from __future__ import annotations

from dataclasses import dataclass

# The model's constants.
PEAK_HOURS = (14, 22)
DIST_EDGES = (0.0, 1.0, 2.0, 4.0, 6.0, 8.0, 12.0, 20.0, 1e9)
DIST_LABELS = ("<1", "1-2", "2-4", "4-6", "6-8", "8-12", "12-20", "20+")
LAT_RANGE, LON_RANGE = (16.0, 33.5), (34.0, 57.0)
LIMITS = {"T2a": (0.0, 120.0), "T2b": (0.0, 90.0), "T2": (0.5, 240.0), "T3": (0.5, 180.0), "T4": (0.0, 60.0)}
METRIC_RANGES = {"T1": (0.0, 60.0), "T2": (0.5, 240.0), "T3": (0.5, 180.0), "ETA": (10.0, 300.0)}
ENRICH_RANGES = {"t1": (0.1, 60.0), "t2": (0.2, 60.0), "t3": (0.5, 150.0)}


@dataclass(frozen=True)
class Params:
    n0_t2a: int = 60
    n0_t3: int = 30
    n0_t3_prior: int = 80
    n0_t2b: int = 80
    n0_prep: int = 120
    n0_bias: int = 250
    n0_dwell: int = 80
    half_life_t2a: float = 21.0
    half_life_t3: float = 21.0
    half_life_prep: float = 28.0
    half_life_bias: float = 10.0
    bias_cap: float = 5.0
    bias_min_abs: float = 0.5
    bias_min_n: int = 12
    coverage_min_n: int = 25
    train_share: float = 0.8
    min_train_t1: int = 200
    min_train_resid: int = 1000
    hour_zone: str = "Asia/Riyadh"
    #: 'balanced' counts the prior's weight only where there is a prior; 'reference' adds it to the numerator always.
    prior_mode: str = "balanced"
    #: 'both' lets prep-time rows for any hour and any weekday match; 'reference' relaxes one of the two only.
    prior_relax: str = "both"
    #: Whether the residual model may see the outcome of the leg before.
    leaky_features: bool = False


DEFAULT = Params()
