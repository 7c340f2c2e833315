"""Shared pieces of the query catalogue: inputs, rounding and SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathpulse.params import TrackParams
from pathpulse.plans.preprocess import clean_tracks
from pathpulse.sources.event_tracks import event_lifespans, event_tracks

# Event tracks hold 49-86 frames, so segments are short and gap limits small.
SHORT = TrackParams(segment_len=10, interp_limit=1, long_gap=2)
LONG = TrackParams(segment_len=32, interp_limit=1, long_gap=2)

DIGITS = 6
# Keeps values that end exactly between two rounded numbers from falling either way.
NUDGE = 3.3e-11


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double so that two engines agree on the printed value."""
    return df.select(
        *[
            F.round(F.col(f.name) + NUDGE, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else f.name
            for f in df.schema
        ]
    )


def r(expression: str, digits: int = DIGITS) -> str:
    """The same rounding in SQL, without negative zero."""
    value = f"round(CAST({expression} AS DOUBLE) + {NUDGE}, {digits})"
    return f"CASE WHEN {value} = 0 THEN 0.0 ELSE {value} END"


def cleaned(spark: SparkSession, folder: str, p: TrackParams, trim: bool = False) -> DataFrame:
    lifespans = event_lifespans(spark, folder, p.segment_len) if trim else None
    return clean_tracks(event_tracks(spark, folder), p, lifespans)


EV = """ev AS (
  SELECT user_id AS entity, CAST(user_id % 2 AS INTEGER) AS label,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame,
         value / 20 AS raw_speed,
         CASE WHEN event_type <> 'error' THEN value END AS x,
         CASE WHEN event_type <> 'error'
              THEN CAST(7.49 AS DOUBLE) * CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS y
  FROM events)"""


def cut_sql(p: TrackParams, trim: bool = False) -> str:
    """CTEs up to ``cut``: capped speeds with segment numbers, optionally trimmed at death."""
    where = "WHERE entity % 17 <> 0 AND (frame - 1) // {0} < 4 + entity % 3" if trim else ""
    return f"""{EV}, cut AS (
  SELECT entity, label, frame, (frame - 1) // {p.segment_len} AS seg,
         CASE WHEN raw_speed > {p.max_speed} THEN {p.max_speed} ELSE raw_speed END AS speed, x, y
  FROM ev {where.format(p.segment_len)})"""


def gaps_sql(p: TrackParams, trim: bool = False) -> str:
    """CTEs up to ``gaps``: every frame with the gap it lies in and the known points around it."""
    return f"""{cut_sql(p, trim)}, flags AS (
  SELECT *, CASE WHEN x IS NULL AND (lag(frame) OVER w IS NULL OR lag(x) OVER w IS NOT NULL)
                 THEN 1 ELSE 0 END AS opens
  FROM cut WINDOW w AS (PARTITION BY entity, seg ORDER BY frame)), islands AS (
  SELECT *, sum(opens) OVER (PARTITION BY entity, seg ORDER BY frame ROWS UNBOUNDED PRECEDING) AS island
  FROM flags), gaps AS (
  SELECT entity, label, frame, seg, speed, x, y,
         CASE WHEN x IS NULL THEN
           min(CASE WHEN x IS NULL THEN frame END) OVER (PARTITION BY entity, seg, island) END AS gap_start,
         CASE WHEN x IS NULL THEN
           max(CASE WHEN x IS NULL THEN frame END) OVER (PARTITION BY entity, seg, island) END AS gap_end
  FROM islands)"""


def repaired_sql(p: TrackParams, trim: bool = False) -> str:
    """CTEs up to ``kept``: short gaps filled, long ones dropped."""
    def fill(c: str) -> str:
        return f"""CASE WHEN g.x IS NULL AND g.gap_end - g.gap_start + 1 <= {p.interp_limit}
              THEN CASE WHEN a.{c} IS NOT NULL AND b.{c} IS NOT NULL
                        THEN a.{c} + (b.{c} - a.{c}) * (g.frame - a.frame) / (b.frame - a.frame)
                        ELSE a.{c} END
              ELSE g.{c} END AS {c}"""

    return f"""{gaps_sql(p, trim)}, kept AS (
  SELECT g.entity, g.label, g.frame, g.seg, g.speed, {fill("x")}, {fill("y")}
  FROM gaps g
  LEFT JOIN cut a ON a.entity = g.entity AND a.seg = g.seg AND a.frame = g.gap_start - 1
  LEFT JOIN cut b ON b.entity = g.entity AND b.seg = g.seg AND b.frame = g.gap_end + 1
  WHERE g.gap_start IS NULL OR g.gap_end - g.gap_start + 1 < {p.long_gap})"""


def turned_sql(p: TrackParams, trim: bool = False) -> str:
    """CTEs up to ``turned``: turning angle in degrees, [-180, 180)."""
    return f"""{repaired_sql(p, trim)}, headings AS (
  SELECT *, lag(frame) OVER w IS NULL OR lead(frame) OVER w IS NULL AS edge,
         atan2(lead(y) OVER w - y, lead(x) OVER w - x)
           - atan2(y - lag(y) OVER w, x - lag(x) OVER w) + pi() AS d
  FROM kept WINDOW w AS (PARTITION BY entity, seg ORDER BY frame)), turned AS (
  SELECT entity, label, frame, seg, speed, x, y,
         CASE WHEN edge THEN 0.0
              ELSE degrees(d - 2 * pi() * floor(d / (2 * pi())) - pi()) END AS turning_angle
  FROM headings)"""


def clean_sql(p: TrackParams, trim: bool = False) -> str:
    """CTEs up to ``clean``: the normalised segment table."""
    return f"""{turned_sql(p, trim)}, clean AS (
  SELECT entity, label, frame, seg, speed, x / {p.xy_max} AS x, y / {p.xy_max} AS y,
         turning_angle / {p.angle_max} AS turning_angle FROM turned)"""


def t_p_sql(t: str, df: str) -> str:
    """Two-sided Student probability by Simpson's rule over the angle atan(t / sqrt(df))."""
    lo = f"atan(abs({t}) / sqrt({df}))"
    hi = f"least(pi() / 2, {lo} + 12 / sqrt({df}))"
    return f"""(SELECT 2 * exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt(pi()) * ({hi} - {lo}) / 1200
      * sum(CASE WHEN s IN (0, 400) THEN 1 WHEN s % 2 = 1 THEN 4 ELSE 2 END
            * power(greatest(cos({lo} + ({hi} - {lo}) * s / 400), 0), {df} - 1)) FROM range(401) q(s))"""


def f_p_sql(f: str, d1: str, d2: str) -> str:
    """Upper F probability by Simpson's rule over the angle asin(sqrt(x))."""
    lo = f"asin(sqrt({d1} * {f} / ({d1} * {f} + {d2})))"
    hi = f"least(pi() / 2, {lo} + 12 / sqrt({d2}))"
    return f"""(SELECT 2 * exp(lgamma(({d1} + {d2}) / 2) - lgamma({d1} / 2) - lgamma({d2} / 2)) * ({hi} - {lo}) / 6000
      * sum(CASE WHEN s IN (0, 2000) THEN 1 WHEN s % 2 = 1 THEN 4 ELSE 2 END
            * power(sin({lo} + ({hi} - {lo}) * s / 2000), {d1} - 1)
            * power(greatest(cos({lo} + ({hi} - {lo}) * s / 2000), 0), {d2} - 1)) FROM range(2001) q(s))"""


def z_p_sql(z: str) -> str:
    """Two-sided normal probability by Simpson's rule."""
    return f"""(SELECT 2 / sqrt(2 * pi()) * 12 / 1200
      * sum(CASE WHEN s IN (0, 400) THEN 1 WHEN s % 2 = 1 THEN 4 ELSE 2 END
            * exp(-power(abs({z}) + 12 * s / CAST(400 AS DOUBLE), 2) / 2)) FROM range(401) q(s))"""
