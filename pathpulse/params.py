"""Fixed numbers of the track pipeline, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class TrackParams:
    """Cleaning and normalisation settings; the defaults are the production values."""

    segment_len: int = 900
    interp_limit: int = 6
    long_gap: int = 7
    max_speed: float = 10.0
    xy_min: float = 0.0
    xy_max: float = 749.0
    angle_max: float = 180.0


# Columns that describe a row and are never features.
METADATA_COLUMNS = frozenset(
    """
    label filename file original_file relative_path entity seg segment_index segment_number
    death_index death_segment fold max_segment total_segments lifespan_percentage
    lifespan_bin life_stage error segments_from_end death_close
    """.split()
)

# The 29 features used by the close-to-death predictor, in their published order.
AGING_FEATURES = """
    high_activity_fraction mixed_activity_fraction low_activity_fraction
    mean_speed std_speed max_speed speed_entropy
    mean_roaming_score std_roaming_score fraction_roaming
    movement_efficiency fraction_efficient_movement
    time_paused fraction_paused
    mean_jerk max_jerk kinetic_energy_proxy
    mean_meandering_ratio std_meandering_ratio
    wavelet_speed_level0 wavelet_speed_level1 wavelet_speed_level2 wavelet_speed_level3
    mean_frenetic_score std_frenetic_score
    speed_persistence activity_level speed_skewness speed_kurtosis
""".split()

# The ten features of the published weighted vote, in their published order.
VOTING_FEATURES = """
    median_meandering_ratio mean_meandering_ratio min_meandering_ratio wavelet_turning_level0
    std_turning_angle turning_entropy wavelet_turning_level1 wavelet_turning_level2
    speed_fractal_dim wavelet_turning_level3
""".split()
