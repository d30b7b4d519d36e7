"""Thresholds of every operator, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # They must be these for results to agree.
    window_dates: int = 21
    min_per_unit: int = 3
    min_brands: int = 3
    cond_window_dates: int = 28
    min_cond_per_brand: int = 2
    min_cond_brands: int = 2
    availability_days: int = 60
    baseline_rows: int = 30
    baseline_min: int = 3
    unit_ref_min: int = 8
    unit_model_min: int = 3
    outlier_low: float = 0.2
    outlier_high: float = 5.0
    tolerance_pct: float = 10.0
    weight_days: int = 180
    price_low: int = 500
    price_high: int = 500_000
    epoch: str = "2025-01-01"
    recent_days: int = 90
    card_full: int = 20
    card_limited: int = 10
    card_month_min: int = 3
    card_year_min: int = 3
    card_sales_min: int = 3
    card_reposts_min: int = 5
    wide_spread_pct: float = 60.0
    max_hops: int = 6
    max_sell_days: int = 365
    brand_sales_min: int = 8
    attention_min: int = 10
    link_age_days: int = 2
    link_cap: int = 300
    expiry_days: int = 14
    swing_alert_pct: float = 8.0
    stale_alert_days: int = 3
    recheck_pages: int = 3
    incremental_pages: int = 25
    full_pages: int = 100


DEFAULT = Config()
