"""Thresholds of the telemetry jobs, with their defaults; pass a changed copy (``dataclasses.replace``) to alter them."""

from __future__ import annotations

from dataclasses import dataclass


# Defaults that results depend on.
@dataclass(frozen=True)
class Params:
    # segments and vertical rate
    min_dt_s: float = 0.5
    max_speed_mps: float = 200.0
    max_vrate_mps: float = 90.0
    rate_window_s: int = 25
    rate_min_points: int = 3
    rate_min_span_s: float = 4.0
    # profile
    bin_m: float = 150.0
    gap_m: float = 600.0
    refresh_cap: int = 8
    blend_km: float = 60.0
    blend_age_s: float = 5400.0
    blend_min_agl_m: float = 3000.0
    # flight states
    burst_drop_m: float = 300.0
    burst_frames: int = 3
    airborne_agl_m: float = 1000.0
    ascent_gain_m: float = 500.0
    revert_climb_m: float = 500.0
    float_rate_mps: float = 1.0
    float_min_alt_m: float = 12_000.0
    float_window_s: float = 300.0
    landed_agl_m: float = 300.0
    timeout_low_agl_m: float = 2000.0
    landed_silence_s: float = 180.0
    descent_silence_s: float = 600.0
    ascent_silence_s: float = 5400.0
    stale_s: float = 21_600.0
    launch_agl_m: float = 1500.0
    reascent_m: float = 500.0
    redescent_m: float = 150.0
    sustained_frames: int = 3
    glitch_horizontal_mps: float = 250.0
    glitch_vertical_mps: float = 150.0
    glitch_accept_after: int = 5
    track_move_m: float = 250.0
    track_alt_m: float = 200.0
    track_interval_s: float = 30.0
    refine_move_m: float = 50.0
    refine_alt_m: float = 30.0
    truth_min_fall_m: float = 1000.0
    suspect_truth_s: float = 900.0
    # descent fit
    transient_s: float = 45.0
    transient_m: float = 1000.0
    b_min: float = 2.0
    b_max: float = 30.0
    half_life_s: float = 120.0
    min_fit_points: int = 4
    regime_points: int = 12
    regime_rel: float = 0.25
    prior_strength: float = 6.0
    default_b: float = 5.5
    # members and radius
    members: int = 100
    members_preburst: int = 60
    sigma_measured_mps: float = 1.2
    sigma_extrapolated_mps: float = 3.0
    bias_sigma_mps: float = 1.5
    corr_len_m: float = 1500.0
    b_sigma_fit: float = 0.05
    b_sigma_shortcut: float = 0.18
    b_sigma_preburst: float = 0.30
    burst_sigma_m: float = 1500.0
    ascent_sigma_rel: float = 0.10
    quantile: float = 0.68
    base_radius_km: float = 0.3
    per_hour_measured_km: float = 1.5
    per_hour_extrapolated_km: float = 6.0
    residual_km_per_mps: float = 0.15
    preburst_min_cover: float = 0.7
    cadence_s: float = 10.0
    # winds
    latency_h: float = 4.0
    # alerts and capture
    roi_margin_km: float = 300.0
    update_move_km: float = 5.0
    update_throttle_s: float = 600.0
    # priors
    prior_newest: int = 60
    prior_least: int = 3
    site_half_deg: float = 0.5
    # history
    backfill_silent_s: float = 300.0
    backfill_hold_s: float = 1800.0
    # streams
    dedup_s: float = 60.0
    reorder_hold_s: float = 3.0


DEFAULTS = Params()
