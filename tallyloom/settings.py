"""Every threshold of the library, in one frozen record that can be replaced per call."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    # Fixed values of the valuation model.
    horizon: int = 10
    terminal_growth: float = 0.025
    terminal_growth_bounds: tuple[float, float] = (0.01, 0.04)
    margin_bounds: tuple[float, float] = (0.05, 0.90)
    max_year_one_growth: float = 0.75
    min_year_one_growth: float = -0.30
    wacc_bounds: tuple[float, float] = (0.05, 0.20)
    beta_bounds: tuple[float, float] = (0.30, 3.00)
    blume: tuple[float, float] = (0.67, 0.33)
    beta_horizon_weight: float = 0.75
    credit_spread: float = 0.015
    risk_free: float = 0.043
    erp: float = 0.055
    erp_by_country: dict[str, float] = field(default_factory=lambda: {"INDIA": 0.078})
    tax: float = 0.21
    tax_by_country: dict[str, float] = field(default_factory=lambda: {"INDIA": 0.2517})
    size_tiers: tuple[tuple[float, float], ...] = ((1e10, 0.0), (2e9, 0.01), (0.0, 0.025))
    growth_spread_bounds: tuple[float, float] = (0.05, 0.20)
    margin_spread_bounds: tuple[float, float] = (0.02, 0.12)
    scenario_wacc_shift: float = 0.015
    scenario_growth_shift: float = 0.005
    scenario_probability: tuple[float, float, float] = (0.25, 0.50, 0.25)
    wacc_growth_gap: float = 0.005
    grid_steps: tuple[float, ...] = (-0.02, -0.01, 0.0, 0.01, 0.02)
    grid_growth_steps: tuple[float, ...] = (-0.01, -0.005, 0.0, 0.005, 0.01)
    competition_haircuts: tuple[float, ...] = (0.02, 0.05, 0.10)
    outlier_band: tuple[float, float] = (0.40, 2.50)
    segment_growth_bounds: tuple[float, float] = (-0.30, 0.75)
    segment_decay: float = 0.70
    segment_max_gap: float = 0.35
    segment_close_gap: float = 0.15
    buy_at: float = 0.15
    hold_at: float = -0.10
    # Fixed values of retrieval.
    rrf_k: int = 60
    candidates: int = 25
    shortlist: int = 20
    top_k: int = 8
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    min_filtered: int = 5
    table_boost: float = 1.25
    latest_boost: float = 1.35
    previous_boost: float = 1.10
    chunk_tokens: int = 600
    overlap_tokens: int = 100
    min_chunk_tokens: int = 50


DEFAULTS = Settings()
