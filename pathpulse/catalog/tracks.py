"""Scans, cleaning and bounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathpulse.catalog.common import (
    EV, SHORT, clean_sql, cleaned, cut_sql, gaps_sql, r, repaired_sql, rounded, turned_sql,
)
from pathpulse.functions import filenames
from pathpulse.operators import segments
from pathpulse.operators.gaps import mark_gaps, repair_gaps
from pathpulse.operators.geometry import normalize, turning_angles
from pathpulse.sources.event_tracks import event_lifespans, event_tracks
from pathpulse.sources.tables import read_table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


@query(f"""WITH {EV} SELECT entity, label, frame, {r("raw_speed")} AS speed, {r("x")} AS x,
  {r("y")} AS y FROM ev""")
def track_scan(spark, sf):
    return rounded(event_tracks(spark, sf))


FILE_SQL = """files AS (
  SELECT event_id, user_id, 'data/' || CASE WHEN user_id % 2 = 1 THEN 'drug+' ELSE 'control' END
    || '/coordinates_' || CASE WHEN event_type = 'view' THEN 'slow_' ELSE 'highestspeed_' END
    || strftime(ts, '%Y%m%d') || '_' || CAST(user_id AS VARCHAR) || '_'
    || CAST(event_id % 3 AS VARCHAR) || '.csv' AS path
  FROM events)"""


def _file_paths(spark, sf):
    events = read_table(spark, sf, "events")
    path = F.concat(
        F.lit("data/"),
        F.when(F.col("user_id") % 2 == 1, "drug+").otherwise("control"),
        F.lit("/coordinates_"),
        F.when(F.col("event_type") == "view", "slow_").otherwise("highestspeed_"),
        F.date_format("ts", "yyyyMMdd"),
        F.lit("_"),
        F.col("user_id").cast("string"),
        F.lit("_"),
        (F.col("event_id") % 3).cast("string"),
        F.lit(".csv"),
    )
    return events.select("event_id", "user_id", path.alias("path"))


@query(f"""WITH {FILE_SQL} SELECT event_id,
  CASE WHEN regexp_matches(path, 'coordinates_highestspeed_[0-9]{{8}}_') THEN
    '/' || regexp_extract(path, '_([0-9]{{8}})_', 1) || '_piworm'
    || CASE WHEN user_id < 10 THEN '0' ELSE '' END || CAST(user_id AS VARCHAR)
    || '_' || CAST(event_id % 3 AS VARCHAR) END AS lookup_key FROM files""")
def lookup_key(spark, sf):
    return _file_paths(spark, sf).select(
        "event_id", filenames.lookup_key(F.col("path")).alias("lookup_key")
    )


@query("""SELECT event_id, CAST(user_id % 2 AS INTEGER) AS label FROM events""")
def path_label(spark, sf):
    return _file_paths(spark, sf).select(
        "event_id", filenames.path_label(filenames.directory(F.col("path"))).alias("label")
    )


@query("""SELECT event_id, 'worm' || CAST(user_id AS VARCHAR) AS entity,
  CAST(CASE WHEN event_type = 'view' THEN 0 ELSE event_id % 7 END AS INTEGER) AS seg FROM events""")
def entity_and_segment(spark, sf):
    name = F.concat(
        F.lit("worm"),
        F.col("user_id").cast("string"),
        F.when(F.col("event_type") == "view", "").otherwise(
            F.concat(F.lit("-segment"), (F.col("event_id") % 7).cast("string"), F.lit(".0"))
        ),
        F.lit("-preprocessed.csv"),
    )
    return read_table(spark, sf, "events").select(
        "event_id",
        filenames.entity_of(name).alias("entity"),
        filenames.segment_of(name).alias("seg"),
    )


@query(f"""WITH {turned_sql(SHORT)}, per_file AS (
  SELECT entity, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(turning_angle) AS a0,
         max(turning_angle) AS a1, min(speed) AS s0, max(speed) AS s1 FROM turned GROUP BY entity)
  SELECT {r("min(x0)")} AS x_min, {r("max(x1)")} AS x_max, {r("min(y0)")} AS y_min,
    {r("max(y1)")} AS y_max, {r("min(a0)")} AS turning_angle_min, {r("max(a1)")} AS turning_angle_max,
    {r("min(s0)")} AS speed_min, {r("max(s1)")} AS speed_max, count(*) AS files,
    count(x0) AS files_with_xy, count(a0) AS files_with_angle, count(s0) AS files_with_speed
  FROM per_file""")
def coordinate_bounds(spark, sf):
    frames = segments.assign_segments(event_tracks(spark, sf), SHORT)
    return rounded(segments.coordinate_bounds(turning_angles(repair_gaps(frames, SHORT))))


@query(f"""WITH {cut_sql(SHORT)} SELECT entity, frame, {r("speed")} AS speed FROM cut""")
def speed_cap(spark, sf):
    frames = segments.assign_segments(event_tracks(spark, sf), SHORT)
    return rounded(frames.select("entity", "frame", "speed"))


@query(f"""WITH {cut_sql(SHORT)} SELECT entity, seg, count(*) AS n_frames, min(frame) AS first_frame
  FROM cut GROUP BY entity, seg""")
def segment_assign(spark, sf):
    frames = segments.assign_segments(event_tracks(spark, sf), SHORT)
    return frames.groupBy("entity", "seg").agg(
        F.count(F.lit(1)).alias("n_frames"), F.min("frame").alias("first_frame")
    )


def _trimmed(spark, sf):
    frames = segments.assign_segments(event_tracks(spark, sf), SHORT)
    return segments.trim_at_death(frames, event_lifespans(spark, sf, SHORT.segment_len), SHORT)


@query(f"""WITH {cut_sql(SHORT, trim=True)} SELECT entity, frame, seg,
  4 + entity % 3 AS death_segment FROM cut""")
def death_trim(spark, sf):
    return _trimmed(spark, sf).select("entity", "frame", "seg", "death_segment")


@query(f"""WITH {cut_sql(SHORT, trim=True)} SELECT entity, seg, 4 + entity % 3 AS death_segment,
  min(label) AS label, count(*) AS n_frames FROM cut GROUP BY entity, seg""")
def segment_metadata(spark, sf):
    return segments.segment_metadata(_trimmed(spark, sf))


@query(f"""WITH {cut_sql(SHORT, trim=True)}, per_seg AS (SELECT entity, seg, min(label) AS label
  FROM cut GROUP BY entity, seg) SELECT label, count(*) AS n FROM per_seg GROUP BY label""")
def label_counts(spark, sf):
    return (
        segments.segment_metadata(_trimmed(spark, sf))
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(f"""WITH {gaps_sql(SHORT)} SELECT entity, seg, gap_start, gap_end,
  gap_end - gap_start + 1 AS gap_len, count(*) AS n FROM gaps WHERE x IS NULL GROUP BY ALL""")
def gap_islands(spark, sf):
    frames = segments.assign_segments(event_tracks(spark, sf), SHORT)
    return (
        mark_gaps(frames)
        .where("x is null")
        .groupBy("entity", "seg", "gap_start", "gap_end", "gap_len")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(f"""WITH {repaired_sql(SHORT)} SELECT entity, frame, seg, {r("speed")} AS speed, {r("x")} AS x,
  {r("y")} AS y FROM kept""")
def gap_interpolate(spark, sf):
    frames = segments.assign_segments(event_tracks(spark, sf), SHORT)
    return rounded(
        repair_gaps(frames, SHORT).select("entity", "frame", "seg", "speed", "x", "y")
    )


@query(f"""WITH {repaired_sql(SHORT)} SELECT c.entity, c.seg, count(*) AS n_before,
  count(k.frame) AS n_after FROM cut c LEFT JOIN kept k USING (entity, seg, frame)
  GROUP BY c.entity, c.seg""")
def gap_drop(spark, sf):
    frames = segments.assign_segments(event_tracks(spark, sf), SHORT)
    marked = mark_gaps(frames)
    stays = F.col("gap_len").isNull() | (F.col("gap_len") < SHORT.long_gap)
    return marked.groupBy("entity", "seg").agg(
        F.count(F.lit(1)).alias("n_before"), F.count_if(stays).alias("n_after")
    )


@query(f"""WITH {turned_sql(SHORT)} SELECT entity, frame, {r("turning_angle")} AS turning_angle
  FROM turned""")
def turning_angle(spark, sf):
    frames = segments.assign_segments(event_tracks(spark, sf), SHORT)
    return rounded(
        turning_angles(repair_gaps(frames, SHORT)).select("entity", "frame", "turning_angle")
    )


@query(f"""WITH {clean_sql(SHORT)} SELECT entity, frame, {r("x")} AS x, {r("y")} AS y,
  {r("turning_angle")} AS turning_angle FROM clean""")
def normalize_track(spark, sf):
    frames = segments.assign_segments(event_tracks(spark, sf), SHORT)
    turned = turning_angles(repair_gaps(frames, SHORT))
    return rounded(normalize(turned, SHORT).select("entity", "frame", "x", "y", "turning_angle"))


@query(f"""WITH {clean_sql(SHORT, trim=True)} SELECT entity, label, seg, frame, {r("speed")} AS speed,
  {r("x")} AS x, {r("y")} AS y, {r("turning_angle")} AS turning_angle FROM clean""")
def clean_track(spark, sf):
    return rounded(
        cleaned(spark, sf, SHORT, trim=True).select(
            "entity", "label", "seg", "frame", "speed", "x", "y", "turning_angle"
        )
    )


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN CAST(event_id % 5 AS DOUBLE)
    WHEN event_type = 'view' THEN NULL ELSE event_id % 7 + 0.5 END AS segment FROM events""")
def segment_from_name(spark, sf):
    """Segment of a feature row: the stored index, else the number in the file name."""
    name = F.concat(
        F.lit("worm-"),
        F.when(F.col("event_type") == "view", "whole").otherwise(F.concat(F.lit("segment"), (F.col("event_id") % 7).cast("string"), F.lit(".5"))),
        F.lit("-preprocessed.csv"),
    )
    stored = F.when(F.col("event_type") == "error", F.col("event_id") % 5)
    return read_table(spark, sf, "events").select("event_id", filenames.segment_or_extracted(stored, name).alias("segment"))
