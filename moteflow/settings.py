"""Analysis settings. Values are fixed: results depend on them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # detection
    dog_small: float = 1.2
    dog_large: float = 12.0
    peak_window: int = 5
    seed_sigma_frames: float = 1.0
    threshold_sigma: float = 6.0
    weak_fraction: float = 0.55
    threshold: float = 0.0
    tile_px: int = 32
    tile_ratio: float = 2.0
    # pairing
    min_separation: float = 9.0
    max_separation: float = 27.0
    seed_max_ratio: float = 8.0
    max_ratio: float = 4.0
    sep_sd_px: float = 1.0
    sep_gate_px: float = 3.5
    sep_sd_mode: str = "fixed"
    sep_sd_floor_px: float = 0.15
    prune_slack_px: float = 3.0
    ratio_log_sd: float = 0.5
    sigma_sd: float = 0.6
    pair_gate_cost: float = 25.0
    # fitting
    center_bound: float = 3.0
    min_sigma: float = 0.8
    max_sigma: float = 5.0
    fit_padding: int = 9
    max_group_gaussians: int = 24
    max_iterations: int = 200
    min_snr: float = 4.0
    min_pair_snr: float = 0.0
    lobe_floor_snr: float = 1.0
    roi_radius_px: float = 5.0
    ring_shadow_ratio: float = 0.2
    ring_shadow_px: float = 10.0
    shared_excess: float = 0.4
    shared_min_snr: float = 15.0
    split_sigma_ratio: float = 1.35
    split_min_gain: float = 1.0
    split_max_tries: int = 6
    split_reach_sigmas: float = 3.0
    pixel_size_um: float = 0.325
    # tracking
    link_distance_px: float = 8.0
    gap_distance_px: float = 12.0
    max_frame_gap: int = 6
    angle_cost_deg: float = 15.0
    link_z_um: float = 8.0
    link_z_sigma: float = 4.0
    link_z_rate_um: float = 1.0
    kalman_process_noise: float = 0.5
    kalman_measurement_noise: float = 0.3
    kalman_initial_velocity: float = 2.0
    # cleaning
    ghost_lobe_px: float = 8.0
    ghost_fraction: float = 0.6
    ghost_dim_ratio: float = 0.5
    ghost_z_um: float = 15.0
    ghost_window: int = 8
    local_px: float = 150.0
    recover_rounds: int = 6
    recover_reach_frames: int = 8
    recover_min_snr: float = 3.0
    recover_center_bound: float = 4.0
    recover_amplitude_fraction: float = 0.35
    recover_max_turn_deg: float = 15.0
    recover_min_track: int = 3
    jump_window: int = 5
    jump_px: float = 3.0
    jump_angle_deg: float = 20.0
    jump_z_um: float = 2.5
    jump_z_sigma: float = 4.0
    state_z_um: float = 5.0
    twin_px: float = 3.0
    min_track_length: int = 3
    reject_track_snr: float = 15.0
    reject_track_snr_fraction: float = 0.25
    reject_track_template: float = 0.6
    satellite_distance_px: float = 10.0
    satellite_brightness_ratio: float = 3.0
    satellite_max_turn_deg: float = 20.0
    satellite_fraction: float = 0.8
    drift_z_smooth_frames: float = 3.0
    axial_scale: float = 1.0
    # calibration
    z_step_um: float = 1.0
    z_range_um: float | None = None
    sensor_size_px: int = 2048
    calibration_min_planes: int = 30
    calibration_min_beads_per_plane: int = 5
    calibration_max_residual_deg: float = 8.0


DEFAULTS = Settings()
# Overrides for dim movies, and the signal level below which they apply.
DIM_OVERRIDES = {"min_snr": 2.0, "recover_min_snr": 1.5, "min_pair_snr": 10.0, "sep_sd_mode": "precision"}
DIM_SNR = 6.0
MIN_CALIBRATION_BEADS = 20
OBJECTIVE_PIXEL_UM = {10: 0.63, 20: 0.325}
OBJECTIVE_Z_RANGE_UM = {10: 75.0}
