"""Raw frames to the cleaned segment table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pathpulse.operators.gaps import repair_gaps
from pathpulse.operators.geometry import normalize, turning_angles
from pathpulse.operators.segments import assign_segments, trim_at_death
from pathpulse.params import TrackParams


def clean_tracks(
    frames: DataFrame, p: TrackParams, lifespans: DataFrame | None = None
) -> DataFrame:
    """Cap, cut into segments, trim at death, repair gaps, add turning angles, normalise.

    All scans run inside ``(entity, seg)``, so after the numbering there is one exchange on that
    key however long an entity is.
    """
    cut = assign_segments(frames, p)
    if lifespans is not None:
        cut = trim_at_death(cut, lifespans, p)
    return normalize(turning_angles(repair_gaps(cut, p)), p)
