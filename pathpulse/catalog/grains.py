"""Whole tracks, file identity, absent segments and segments that fail."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathpulse.catalog.common import SHORT, clean_sql, cleaned, cut_sql, r, repaired_sql, rounded
from pathpulse.catalog.life import FEAT_SQL, FEATURES
from pathpulse.operators import segments
from pathpulse.operators.resample import CHANNELS, resampled_tracks
from pathpulse.operators.segments import KEYS
from pathpulse.plans.extract import extract_checked
from pathpulse.sources import stores, track_files
from pathpulse.sources.event_tracks import event_lifespans, event_tracks
from pathpulse.sources.tables import read_table

QUERIES, ORACLES = {}, {}
CHUNK = 16
POINTS = 12


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


PLACED_SQL = f"""WITH {clean_sql(SHORT)}, placed AS (
  SELECT entity, label, row_number() OVER (PARTITION BY entity ORDER BY frame) - 1 AS pos,
         count(*) OVER (PARTITION BY entity) AS n, {", ".join(f"coalesce({c}, 0.0) AS {c}" for c in CHANNELS)} FROM clean)"""


@query(f"""{PLACED_SQL} SELECT entity, label, pos // {CHUNK} AS chunk, min(pos) AS start, n AS n_frames, count(*) AS length,
  {", ".join(f"{r(f'{f}({c}, pos)')} AS {name}_{c}" for c in CHANNELS for name, f in (("first", "min_by"), ("last", "max_by")))},
  {", ".join(f"{r(f'sum({c})')} AS sum_{c}" for c in CHANNELS)} FROM placed GROUP BY ALL""")
def full_sequences(spark, sf):
    """Whole tracks in ordered chunks: length, ends and sum of every channel of a chunk."""
    frames = cleaned(spark, sf, SHORT)
    chunks, _ = stores.load_full_sequences(frames, frames.select("entity"), CHUNK)
    seq = F.col("seq")
    columns = [F.size(seq).cast("long").alias("length")]
    for c in CHANNELS:
        values = seq[c]
        columns += [
            F.get(values, 0).alias(f"first_{c}"), F.element_at(values, -1).alias(f"last_{c}"),
            F.aggregate(values, F.lit(0.0), lambda a, v: a + v).alias(f"sum_{c}"),
        ]
    return rounded(chunks.select("entity", "label", "chunk", "start", "n_frames", *columns))


@query(f"""{PLACED_SQL}, spots AS (SELECT unnest(range({POINTS})) AS i), wanted AS (
  SELECT DISTINCT entity, label, n, i, CASE WHEN n < {POINTS} THEN i WHEN i = {POINTS - 1} THEN n - 1
    ELSE CAST(floor(i * ((n - 1) / CAST({POINTS - 1} AS DOUBLE))) AS BIGINT) END AS pos FROM placed, spots)
  SELECT w.entity, w.label, CAST(i AS INTEGER) AS point, w.n AS n_frames, {", ".join(f"{r(f'coalesce(p.{c}, 0.0)')} AS {c}" for c in CHANNELS)}
  FROM wanted w LEFT JOIN placed p ON p.entity = w.entity AND p.pos = w.pos""")
def full_resampled(spark, sf):
    """Whole tracks at evenly spaced points."""
    made = resampled_tracks(cleaned(spark, sf, SHORT), POINTS)
    points = made.select("entity", "label", "n_frames", F.posexplode("seq").alias("point", "p"))
    return rounded(points.select("entity", "label", "point", "n_frames", *[f"p.{c}" for c in CHANNELS]))


@query(f"""WITH {repaired_sql(SHORT)} SELECT DISTINCT entity, seg FROM cut
  EXCEPT SELECT entity, seg FROM kept WHERE entity % 17 <> 0 AND seg < 4 + entity % 3""")
def absent_segments(spark, sf):
    """Segments that a list made of the raw tracks names and the cleaned, trimmed table lacks."""
    listed = segments.assign_segments(event_tracks(spark, sf), SHORT).select(*KEYS).distinct()
    return stores.load_sequences(cleaned(spark, sf, SHORT, trim=True), listed)[1]


def _file_table(spark, sf):
    """Files of the event tracks: condition folder, day of the first event and user in the name."""
    users = read_table(spark, sf, "events").groupBy(F.col("user_id").alias("entity")).agg(F.min("ts").alias("ts"))
    name = F.concat(
        F.when(F.col("entity") % 2 == 1, "drug+").otherwise("control"), F.lit("/coordinates_highestspeed_"),
        F.date_format("ts", "yyyyMMdd"), F.lit("_"), F.col("entity").cast("string"), F.lit("_1.csv"),
    )
    return track_files.file_dimension(users.select("entity", name.alias("relative_path")))


_FILES_SQL = """files AS (SELECT user_id AS entity, CASE WHEN user_id % 2 = 1 THEN 'drug+' ELSE 'control' END AS relative_path,
  'coordinates_highestspeed_' || strftime(min(ts), '%Y%m%d') || '_' || CAST(user_id AS VARCHAR) || '_1' AS base
  FROM events GROUP BY user_id)"""


@query(f"""WITH {cut_sql(SHORT, trim=True)}, {_FILES_SQL} SELECT entity, seg, 4 + entity % 3 AS death_segment,
  min(label) AS label, count(*) AS n_frames, base || '-segment' || CAST(seg AS VARCHAR) || '-preprocessed.csv' AS file,
  base || '.csv' AS original_file, relative_path FROM cut JOIN files USING (entity) GROUP BY ALL""")
def segment_files(spark, sf):
    """Segment metadata with the names of its files."""
    frames = segments.assign_segments(event_tracks(spark, sf), SHORT)
    trimmed = segments.trim_at_death(frames, event_lifespans(spark, sf, SHORT.segment_len), SHORT)
    return track_files.with_file_identity(segments.segment_metadata(trimmed), _file_table(spark, sf)).drop("file_id")


@query(f"""WITH {cut_sql(SHORT, trim=True)}, {_FILES_SQL} SELECT entity, 4 + entity % 3 AS death_segment,
  min(label) AS label, count(*) AS n_frames, base || '-preprocessed.csv' AS file,
  base || '.csv' AS original_file, relative_path FROM cut JOIN files USING (entity) GROUP BY ALL""")
def full_files(spark, sf):
    """Whole-track metadata with the names of its files."""
    frames = segments.assign_segments(event_tracks(spark, sf), SHORT)
    trimmed = segments.trim_at_death(frames, event_lifespans(spark, sf, SHORT.segment_len), SHORT)
    return track_files.with_file_identity(segments.track_metadata(trimmed), _file_table(spark, sf)).drop("file_id")


_ERROR_SQL = """CASE WHEN entity % 11 = 3 AND seg = 1 THEN 'speed is not finite'
  WHEN entity % 13 = 5 AND seg = 0 THEN 'x is not finite' END"""


@query(f"""{FEAT_SQL}, e AS (SELECT *, {_ERROR_SQL} AS error FROM feat)
  SELECT entity, seg, label, error, {", ".join(f"CASE WHEN error IS NULL THEN {r(f'coalesce({f}, 0.0)')} END AS {f}" for f in FEATURES)}
  FROM e UNION ALL SELECT entity, seg, NULL, 'no frames', {", ".join("NULL" for _ in FEATURES)} FROM (
    SELECT DISTINCT entity, seg FROM cut EXCEPT SELECT entity, seg FROM clean)""")
def feature_errors(spark, sf):
    """Features with infinite values planted in some segments: these get a message, the others their features."""
    frames = cleaned(spark, sf, SHORT)
    wild = float("inf")
    planted = frames.withColumns(
        {
            "speed": F.when((F.col("entity") % 11 == 3) & (F.col("seg") == 1), F.lit(wild)).otherwise(F.col("speed")),
            "x": F.when((F.col("entity") % 13 == 5) & (F.col("seg") == 0), F.lit(-wild)).otherwise(F.col("x")),
        }
    )
    listed = segments.assign_segments(event_tracks(spark, sf), SHORT).select(*KEYS).distinct()
    return rounded(extract_checked(planted, listed).select(*KEYS, "label", "error", *FEATURES))
