"""Segment features, one query per family."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from pathpulse.catalog.common import LONG, SHORT, clean_sql, cleaned, r, rounded
from pathpulse.functions.signal import DB4_HIGH, DB4_LOW
from pathpulse.operators import features_native as native
from pathpulse.operators import features_signal as signal
from pathpulse.operators.resample import resampled_sequences
from pathpulse.operators.segments import KEYS
from pathpulse.params import TrackParams
from pathpulse.plans.extract import FEATURES, extract_features
from pathpulse.plans.full_extract import extract_full_features
from pathpulse.session import cut_lineage

QUERIES, ORACLES = {}, {}

# The angles are scaled to [-1, 1]; thresholds that the defaults never reach are set to be reached here.
PEAK_HEIGHT = 0.5
TURN_THRESHOLD = 0.25
# No event track is longer, so a whole track is one segment.
ONE = TrackParams(segment_len=128, interp_limit=1, long_gap=2)


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


def _even_angles(frames):
    return frames.withColumn("turning_angle", F.round("turning_angle", 9))


def _segments(frames):
    return frames.select(*KEYS).distinct()


def steps_sql(p) -> str:
    return f"""{clean_sql(p, True)}, steps AS (
  SELECT *, speed - lag(speed) OVER w AS accel, row_number() OVER w - 1 AS pos,
    sqrt(power(x - last_value(x IGNORE NULLS) OVER b, 2)
       + power(y - last_value(y IGNORE NULLS) OVER b, 2)) AS dist
  FROM clean WINDOW w AS (PARTITION BY entity, seg ORDER BY frame),
    b AS (PARTITION BY entity, seg ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


BASIC_OK = "count(speed) > 0 AND count(x) > 0 AND count(y) > 0"
BASIC_SQL = {
    "mean_speed": "avg(speed)",
    "std_speed": "stddev_samp(speed)",
    "max_speed": "max(speed)",
    "min_speed": "min(speed)",
    "total_distance": "sum(dist)",
    "time_paused": "count(CASE WHEN speed < 0.05 THEN 1 END)",
    "fraction_paused": "count(CASE WHEN speed < 0.05 THEN 1 END) * 1.0 / nullif(count(speed), 0)",
}


def basic_select() -> str:
    return ", ".join(
        r(f"CAST(coalesce(CASE WHEN {BASIC_OK} THEN {sql} END, 0) AS DOUBLE)") + f" AS {name}"
        for name, sql in BASIC_SQL.items()
    )


@query(f"WITH {steps_sql(SHORT)} SELECT entity, seg, {basic_select()} FROM steps GROUP BY entity, seg")
def feat_basic(spark, sf):
    frames = cleaned(spark, sf, SHORT, trim=True)
    return rounded(native.scalar_features(frames, native.basic_aggregates()))


@query(f"""WITH {clean_sql(LONG, True)}, base AS (
  SELECT entity, seg, count(turning_angle) > 0 AND count(x) > 0 AS ok, avg(turning_angle) AS m,
    stddev_samp(turning_angle) AS s, max(abs(turning_angle)) AS top, count(turning_angle) AS n
  FROM clean GROUP BY entity, seg), a AS (
  SELECT entity, seg, frame, abs(turning_angle) AS v FROM clean WHERE turning_angle IS NOT NULL), b AS (
  SELECT *, lag(v) OVER (PARTITION BY entity, seg ORDER BY frame) AS p FROM a), c AS (
  SELECT entity, seg, frame, v FROM b WHERE p IS NULL OR p <> v), d AS (
  SELECT *, lag(v) OVER w AS before, lead(v) OVER w AS after FROM c
  WINDOW w AS (PARTITION BY entity, seg ORDER BY frame)), peaks AS (
  SELECT entity, seg, count(*) AS k FROM d WHERE v > before AND v > after AND v >= {PEAK_HEIGHT}
  GROUP BY entity, seg)
  SELECT entity, seg, {r("CASE WHEN ok THEN coalesce(m, 0.0) ELSE 0.0 END")} AS mean_turning_angle,
    {r("CASE WHEN ok THEN coalesce(s, 0.0) ELSE 0.0 END")} AS std_turning_angle,
    {r("CASE WHEN ok THEN coalesce(top, 0.0) ELSE 0.0 END")} AS max_turning_angle,
    {r("coalesce(k, 0) * 1.0 / n")} AS turning_frequency
  FROM base LEFT JOIN peaks USING (entity, seg)""")
def feat_turning(spark, sf):
    frames = cleaned(spark, sf, LONG, trim=True)
    base = native.scalar_features(frames, native.turning_aggregates())
    peaks = native.turning_frequency(frames, PEAK_HEIGHT)
    return rounded(native.with_zero_default(base, peaks, ["turning_frequency"]))


@query(f"""WITH {clean_sql(LONG)}, k AS (
  SELECT entity, seg, x, y, row_number() OVER (PARTITION BY entity, seg ORDER BY frame) - 1 AS pos
  FROM clean WHERE x IS NOT NULL AND y IS NOT NULL), s AS (
  SELECT *, pos // 10 AS win, CASE WHEN pos % 10 > 0 THEN sqrt(power(x - lag(x) OVER w, 2)
    + power(y - lag(y) OVER w, 2)) END AS dist
  FROM k WINDOW w AS (PARTITION BY entity, seg ORDER BY pos)), wins AS (
  SELECT entity, seg, win, sqrt(power(max_by(x, pos) - min_by(x, pos), 2)
    + power(max_by(y, pos) - min_by(y, pos), 2)) / sum(dist) AS ratio
  FROM s GROUP BY entity, seg, win HAVING count(*) = 10 AND sum(dist) > 0), sums AS (
  SELECT entity, seg, avg(ratio) AS a, stddev_pop(ratio) AS b, min(ratio) AS c, max(ratio) AS d,
    median(ratio) AS e, avg(CASE WHEN ratio > 0.5 THEN 1.0 ELSE 0.0 END) AS f
  FROM wins GROUP BY entity, seg)
  SELECT entity, seg, {r("coalesce(a, 0.0)")} AS mean_meandering_ratio,
    {r("coalesce(b, 0.0)")} AS std_meandering_ratio, {r("coalesce(c, 0.0)")} AS min_meandering_ratio,
    {r("coalesce(d, 0.0)")} AS max_meandering_ratio, {r("coalesce(e, 0.0)")} AS median_meandering_ratio,
    {r("coalesce(f, 0.0)")} AS fraction_efficient_movement
  FROM (SELECT DISTINCT entity, seg FROM clean) LEFT JOIN sums USING (entity, seg)""")
def feat_meandering(spark, sf):
    frames = cleaned(spark, sf, LONG)
    part = native.meandering_features(frames, window_size=10)
    return rounded(native.with_zero_default(_segments(frames), part, native.MEANDERING))


CHANNELS_SQL = """chan AS (
  SELECT entity, seg, 'speed' AS ch, frame, speed AS v FROM clean WHERE speed IS NOT NULL
  UNION ALL SELECT entity, seg, 'turning', frame, turning_angle FROM clean
  WHERE turning_angle IS NOT NULL), sig AS (
  SELECT entity, seg, ch, v, row_number() OVER (PARTITION BY entity, seg, ch ORDER BY frame) - 1 AS i,
    count(*) OVER (PARTITION BY entity, seg, ch) AS n FROM chan)"""

ROUNDED_CHANNELS_SQL = CHANNELS_SQL.replace("turning_angle FROM", "round(turning_angle, 9) FROM")


@query(f"""WITH {clean_sql(LONG)}, {ROUNDED_CHANNELS_SQL}, ext AS (
  SELECT entity, seg, ch, v, n, min(v) OVER w AS lo, max(v) OVER w AS hi FROM sig
  WINDOW w AS (PARTITION BY entity, seg, ch)), e2 AS (
  SELECT *, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS l,
    CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS h FROM ext), edged AS (
  SELECT entity, seg, ch, n, (SELECT max(b) FROM range(20) t(b) WHERE b = 0 OR v >= l + b * ((h - l) / 20))
    AS bin FROM e2), cnt AS (
  SELECT entity, seg, ch, n, bin, count(*) AS c FROM edged GROUP BY ALL), ent AS (
  SELECT entity, seg, ch, -sum(c * 1.0 / n * ln(c * 1.0 / n)) AS e FROM cnt GROUP BY ALL)
  SELECT entity, seg, {r("coalesce(max(CASE WHEN ch = 'speed' THEN e END), 0.0)")} AS speed_entropy,
    {r("coalesce(max(CASE WHEN ch = 'turning' THEN e END), 0.0)")} AS turning_entropy
  FROM ent GROUP BY entity, seg""")
def feat_entropy(spark, sf):
    frames = cleaned(spark, sf, LONG)
    # straight lines turn by exactly 0 or by one rounding error, which an equal-width bin would tell apart
    return rounded(
        native.entropy_features(frames.withColumn("turning_angle", F.round("turning_angle", 9)))
    )


@query(f"""WITH {clean_sql(LONG)}, k AS (
  SELECT entity, seg, speed, turning_angle,
    row_number() OVER (PARTITION BY entity, seg ORDER BY frame) - 1 AS pos
  FROM clean WHERE speed IS NOT NULL AND turning_angle IS NOT NULL), starts AS (
  SELECT DISTINCT entity, seg, pos AS s FROM k WHERE pos % 5 = 0), inw AS (
  SELECT k.entity, k.seg, st.s, k.pos - st.s AS j, speed - lag(speed) OVER w AS a,
    abs(turning_angle - lag(turning_angle) OVER w) AS t,
    abs(speed - 2 * lag(speed) OVER w + lag(speed, 2) OVER w) AS jk
  FROM k JOIN starts st ON k.entity = st.entity AND k.seg = st.seg AND k.pos BETWEEN st.s AND st.s + 9
  WINDOW w AS (PARTITION BY k.entity, k.seg, st.s ORDER BY k.pos)), wins AS (
  SELECT entity, seg, s, avg(jk) AS jerk, stddev_pop(a) AS sa, stddev_pop(t) AS st
  FROM inw GROUP BY entity, seg, s HAVING count(*) = 10), scored AS (
  SELECT *, CASE WHEN sa > 0 AND st > 0 THEN sa * st END AS score FROM wins), lim AS (
  SELECT entity, seg, quantile_cont(score, 0.75) AS p75 FROM scored GROUP BY entity, seg), sums AS (
  SELECT entity, seg, avg(score) AS a, max(score) AS b, stddev_pop(score) AS c,
    CASE WHEN count(score) >= 4 THEN count(CASE WHEN score > p75 THEN 1 END) * 1.0 / count(score) END AS d,
    avg(jerk) AS e, max(jerk) AS f
  FROM scored JOIN lim USING (entity, seg) GROUP BY entity, seg)
  SELECT entity, seg, {r("coalesce(a, 0.0)")} AS mean_frenetic_score,
    {r("coalesce(b, 0.0)")} AS max_frenetic_score, {r("coalesce(c, 0.0)")} AS std_frenetic_score,
    {r("coalesce(d, 0.0)")} AS pct_high_frenetic, {r("coalesce(e, 0.0)")} AS mean_jerk,
    {r("coalesce(f, 0.0)")} AS max_jerk
  FROM (SELECT DISTINCT entity, seg FROM clean) LEFT JOIN sums USING (entity, seg)""")
def feat_frenetic(spark, sf):
    frames = cleaned(spark, sf, LONG)
    part = native.frenetic_features(frames)
    return rounded(native.with_zero_default(_segments(frames), part, native.FRENETIC))


@query(f"""WITH {clean_sql(SHORT, True)}, base AS (
  SELECT entity, seg, avg(speed * speed / 2) AS k, sum(speed) / (max(speed) * count(speed) + 1e-6) AS e,
    CASE WHEN stddev_samp(speed) <> 0 THEN avg(speed) / (stddev_samp(speed) + 1e-6) END AS p,
    count(CASE WHEN abs(turning_angle) > {TURN_THRESHOLD} THEN 1 END) * 1.0
      / nullif(count(turning_angle), 0) / (avg(speed) + 1e-6) AS x
  FROM clean GROUP BY entity, seg)
  SELECT entity, seg, {r("coalesce(k, 0.0)")} AS kinetic_energy_proxy,
    {r("coalesce(e, 0.0)")} AS movement_efficiency, {r("coalesce(p, 0.0)")} AS speed_persistence,
    {r("coalesce(x, 0.0)")} AS exploration_ratio FROM base""")
def feat_physics(spark, sf):
    frames = cleaned(spark, sf, SHORT, trim=True)
    return rounded(native.scalar_features(frames, native.physics_aggregates(TURN_THRESHOLD)))


@query(f"""WITH {clean_sql(SHORT, True)}, c AS (
  SELECT *, avg(speed) OVER (PARTITION BY entity, seg) AS m FROM clean), base AS (
  SELECT entity, seg, count(speed) > 2 AND stddev_samp(speed) <> 0 AS ok,
    avg(power(speed - m, 3)) / power(nullif(avg(power(speed - m, 2)), 0), 1.5) AS sk,
    avg(power(speed - m, 4)) / power(nullif(avg(power(speed - m, 2)), 0), 2) - 3 AS ku,
    quantile_cont(speed, 0.75) - quantile_cont(speed, 0.25) AS iqr,
    CASE WHEN stddev_samp(speed) <> 0 THEN stddev_samp(speed) / (avg(speed) + 1e-6) END AS cv
  FROM c GROUP BY entity, seg)
  SELECT entity, seg, {r("CASE WHEN ok THEN sk ELSE 0.0 END")} AS speed_skewness,
    {r("CASE WHEN ok THEN ku ELSE 0.0 END")} AS speed_kurtosis, {r("coalesce(iqr, 0.0)")} AS speed_iqr,
    {r("coalesce(cv, 0.0)")} AS speed_cv FROM base""")
def feat_statistical(spark, sf):
    frames = cleaned(spark, sf, SHORT, trim=True)
    return rounded(native.scalar_features(frames, native.statistical_aggregates()))


@query(f"""WITH {steps_sql(SHORT)}, base AS (
  SELECT entity, seg, count(speed) >= 3 AS ok, regr_slope(speed, pos) AS t, avg(accel) AS a,
    stddev_pop(accel) AS s FROM steps GROUP BY entity, seg)
  SELECT entity, seg, {r("CASE WHEN ok THEN t ELSE 0.0 END")} AS speed_trend,
    {r("CASE WHEN ok THEN a ELSE 0.0 END")} AS speed_acceleration_mean,
    {r("CASE WHEN ok THEN s ELSE 0.0 END")} AS speed_acceleration_std FROM base""")
def feat_temporal(spark, sf):
    frames = cleaned(spark, sf, SHORT, trim=True)
    return rounded(native.scalar_features(frames, native.temporal_aggregates()))


@query(f"""WITH {clean_sql(SHORT, True)}, sc AS (
  SELECT entity, seg, 0.7 * speed / (max(speed) OVER w + 1e-6)
    + 0.3 * abs(turning_angle) / (max(abs(turning_angle)) OVER w + 1e-6) AS s
  FROM clean WINDOW w AS (PARTITION BY entity, seg)), cut2 AS (
  SELECT entity, seg, quantile_cont(s, 0.25) AS lo, quantile_cont(s, 0.75) AS hi FROM sc
  WHERE s IS NOT NULL GROUP BY entity, seg)
  SELECT entity, seg, {r("avg(s)")} AS activity_level,
    {r("count(CASE WHEN s > hi THEN 1 END) * 1.0 / count(*)")} AS high_activity_fraction,
    {r("count(CASE WHEN s < lo THEN 1 END) * 1.0 / count(*)")} AS low_activity_fraction,
    {r("count(CASE WHEN s >= lo AND s <= hi THEN 1 END) * 1.0 / count(*)")} AS mixed_activity_fraction
  FROM sc JOIN cut2 USING (entity, seg) WHERE s IS NOT NULL GROUP BY entity, seg""")
def feat_behavior(spark, sf):
    return rounded(native.behavior_features(cleaned(spark, sf, SHORT, trim=True)))


def _per_channel(name: str, expression: str, channel: str) -> str:
    value = f"coalesce(max(CASE WHEN ch = '{channel}' THEN {expression} END), 0.0)"
    return f"{r(value)} AS {name}"


@query(f"""WITH {clean_sql(LONG)}, {CHANNELS_SQL}, ks AS (SELECT unnest(range(1, 11)) AS k), mv AS (
  SELECT a.entity, a.seg, a.ch, a.n, k, a.i % k AS m, abs(b.v - a.v) AS d
  FROM sig a, ks, sig b
  WHERE b.entity = a.entity AND b.seg = a.seg AND b.ch = a.ch AND b.i = a.i + k AND a.n >= 20
    AND a.i // k + 1 <= (a.n - a.i % k) // k - 1), lkm AS (
  SELECT entity, seg, ch, n, k, m, sum(d) * (n - 1) / (((n - m) // k) * k) AS l
  FROM mv GROUP BY entity, seg, ch, n, k, m), lk AS (
  SELECT entity, seg, ch, k, sum(l) AS l FROM lkm GROUP BY entity, seg, ch, k), fd AS (
  SELECT entity, seg, ch, CASE WHEN count(*) = 10 AND min(l) > 0
    THEN regr_slope(ln(pl / k), ln(k)) ELSE 0.0 END AS d
  FROM (SELECT *, CASE WHEN l > 0 THEN l ELSE 1 END AS pl FROM lk) GROUP BY entity, seg, ch)
  SELECT entity, seg, {_per_channel("speed_fractal_dim", "d", "speed")},
    {_per_channel("turning_fractal_dim", "d", "turning")}
  FROM (SELECT DISTINCT entity, seg FROM clean) LEFT JOIN fd USING (entity, seg) GROUP BY entity, seg""")
def feat_higuchi(spark, sf):
    frames = cleaned(spark, sf, LONG)
    part = native.fractal_features(frames)
    return rounded(native.with_zero_default(_segments(frames), part, native.FRACTAL))


@query(f"""WITH {clean_sql(LONG)}, {CHANNELS_SQL}, bins AS (
  SELECT entity, seg, ch, n, k, sqrt(power(sum(v * cos(2 * pi() * k * i / n)), 2)
    + power(sum(v * sin(2 * pi() * k * i / n)), 2)) AS a
  FROM sig, (SELECT unnest(range(1, 16)) AS k) WHERE n >= 8 AND k < n // 2
  GROUP BY entity, seg, ch, n, k), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY entity, seg, ch ORDER BY round(a, 9) DESC, k) AS rn
  FROM bins), spec AS (
  SELECT entity, seg, ch, max(CASE WHEN rn = 1 THEN k - 1.0 END) AS top,
    sum(k * a) / (sum(a) + 1e-6) AS cen FROM ranked GROUP BY entity, seg, ch)
  SELECT entity, seg, {_per_channel("speed_dominant_freq", "top", "speed")},
    {_per_channel("speed_spectral_centroid", "cen", "speed")},
    {_per_channel("turning_dominant_freq", "top", "turning")},
    {_per_channel("turning_spectral_centroid", "cen", "turning")}
  FROM (SELECT DISTINCT entity, seg FROM clean) LEFT JOIN spec USING (entity, seg) GROUP BY entity, seg""")
def feat_spectrum(spark, sf):
    arrays = signal.segment_arrays(cleaned(spark, sf, LONG))
    return rounded(signal.signal_features(arrays, "spectrum"))


@query(f"""WITH {clean_sql(LONG)}, {CHANNELS_SQL}, wt AS (
  SELECT j, exp(-0.5 * power(j / 3.0, 2)) / sum(exp(-0.5 * power(j / 3.0, 2))) OVER () AS w
  FROM (SELECT unnest(range(-12, 13)) AS j)), idx AS (
  SELECT entity, seg, ch, n, i, w, ((i + j) % (2 * n) + 2 * n) % (2 * n) AS q FROM sig, wt), sm AS (
  SELECT x.entity, x.seg, x.ch, x.n, x.i, sum(x.w * s.v) AS v FROM idx x JOIN sig s
    ON s.entity = x.entity AND s.seg = x.seg AND s.ch = x.ch
   AND s.i = CASE WHEN x.q >= x.n THEN 2 * x.n - 1 - x.q ELSE x.q END GROUP BY ALL), wm AS (
  SELECT entity, seg, i // 30 AS win, avg(CASE WHEN ch = 'speed' THEN v END) AS s,
    avg(CASE WHEN ch = 'turning' THEN abs(v) END) AS t,
    count(CASE WHEN ch = 'speed' THEN 1 END) AS ns, count(CASE WHEN ch = 'turning' THEN 1 END) AS nt
  FROM sm GROUP BY ALL), sc AS (
  SELECT entity, seg, (s - t / 180) / 2 AS score FROM wm WHERE ns = 30 AND nt = 30), sums AS (
  SELECT entity, seg, avg(score) AS a, stddev_pop(score) AS b,
    avg(CASE WHEN score > 0 THEN 1.0 ELSE 0.0 END) AS c FROM sc GROUP BY ALL)
  SELECT entity, seg, {r("coalesce(a, 0.0)")} AS mean_roaming_score,
    {r("coalesce(b, 0.0)")} AS std_roaming_score, {r("coalesce(c, 0.0)")} AS fraction_roaming
  FROM (SELECT DISTINCT entity, seg FROM clean) LEFT JOIN sums USING (entity, seg)""")
def feat_roaming(spark, sf):
    arrays = signal.segment_arrays(cleaned(spark, sf, LONG))
    return rounded(signal.signal_features(arrays, "roaming"))


def _wavelet_sql() -> str:
    taps = "taps AS (SELECT * FROM (VALUES " + ", ".join(
        f"({t}, CAST({low!r} AS DOUBLE), CAST({high!r} AS DOUBLE))"
        for t, (low, high) in enumerate(zip(DB4_LOW.tolist(), DB4_HIGH.tolist()))
    ) + ") AS v(t, lo, hi))"
    levels, previous = [], "a0"
    for level in (1, 2, 3):
        levels.append(f"""b{level} AS (
  SELECT entity, seg, ch, lvl, n, j, sum(lo * v) AS a, sum(hi * v) AS d FROM (
    SELECT p.entity, p.seg, p.ch, p.lvl, p.n, p.j, p.lo, p.hi, s.v FROM (
      SELECT g.*, t.lo, t.hi, ((2 * j + 1 - t.t) % (2 * n) + 2 * n) % (2 * n) AS q FROM (
        SELECT entity, seg, ch, lvl, n, unnest(range((n + 7) // 2)) AS j
        FROM (SELECT DISTINCT entity, seg, ch, lvl, n FROM {previous} WHERE lvl >= {level})) g, taps t) p
    JOIN {previous} s ON s.entity = p.entity AND s.seg = p.seg AND s.ch = p.ch
     AND s.i = CASE WHEN p.q >= p.n THEN 2 * p.n - 1 - p.q ELSE p.q END)
  GROUP BY ALL), a{level} AS (
  SELECT entity, seg, ch, lvl, (n + 7) // 2 AS n, j AS i, a AS v FROM b{level})""")
        previous = f"a{level}"
    bands = " UNION ALL ".join(
        f"SELECT entity, seg, ch, lvl - {level} + 1 AS band, stddev_pop(d) AS s FROM b{level} GROUP BY ALL"
        f" UNION ALL SELECT entity, seg, ch, 0, stddev_pop(a) FROM b{level} WHERE lvl = {level} GROUP BY ALL"
        for level in (1, 2, 3)
    )
    columns = ", ".join(
        _per_channel(f"wavelet_{ch}_level{b}", f"CASE WHEN band = {b} THEN s END", ch)
        for ch in ("speed", "turning")
        for b in range(4)
    )
    return f"""WITH {clean_sql(LONG)}, {CHANNELS_SQL}, {taps}, a0 AS (
  SELECT entity, seg, ch, CAST(least(3, floor(log2(n)) - 1) AS BIGINT) AS lvl, n, i, v FROM sig WHERE n >= 4),
  {", ".join(levels)}, bands AS ({bands})
  SELECT entity, seg, {columns}
  FROM (SELECT DISTINCT entity, seg FROM clean) LEFT JOIN bands USING (entity, seg) GROUP BY entity, seg"""


@query(_wavelet_sql())
def feat_wavelet(spark, sf):
    arrays = signal.segment_arrays(cleaned(spark, sf, LONG))
    return rounded(signal.signal_features(arrays, "wavelet"))


FAMILIES = """feat_basic feat_turning feat_meandering feat_entropy feat_frenetic feat_physics feat_statistical
feat_temporal feat_behavior feat_higuchi feat_spectrum feat_roaming feat_wavelet""".split()


# What the families' queries set to be reached on short segments, and the defaults of the full table.
TO_DEFAULTS = (
    (f"v >= {PEAK_HEIGHT}", "v >= 90"), (f"> {TURN_THRESHOLD} THEN", "> 30 THEN"), ("pos // 10", "pos // 30"),
    ("pos % 10 >", "pos % 30 >"), ("HAVING count(*) = 10 AND", "HAVING count(*) = 30 AND"), ("range(1, 16)", "range(1, 64)"),
)


def whole_sql(p: TrackParams, keys: str, label: str) -> str:
    """All families' SQL on the segments of ``p``, joined into one row per segment."""
    # the last digits of an angle decide which bin of the entropy an extreme falls into
    clean = re.sub(r"turning_angle / (\S+) AS turning_angle FROM turned", r"round(turning_angle / \1, 9) AS turning_angle FROM turned", clean_sql(p))
    parts = []
    for name in FAMILIES:
        sql = ORACLES[name]
        for given in (SHORT, LONG):
            for trim in (True, False):
                sql = sql.replace(clean_sql(given, trim), clean)
        for reached, default in TO_DEFAULTS:
            sql = sql.replace(reached, default)
        parts.append(f"LEFT JOIN ({sql}) {name} USING (entity, seg)")
    features = ", ".join(f"coalesce(CAST({f} AS DOUBLE), 0.0) AS {f}" for f in FEATURES)
    return f"""SELECT {keys}, {label}, {features} FROM (
  WITH {clean} SELECT entity, seg, min(label) AS label FROM clean GROUP BY entity, seg) k
  {" ".join(parts)}"""


@query(whole_sql(LONG, "entity, seg", "label"))
def feat_all(spark, sf):
    """The full 57-column table."""
    return rounded(extract_features(cut_lineage(_even_angles(cleaned(spark, sf, LONG)))))


@query(whole_sql(ONE, "entity", "label"))
def feat_full(spark, sf):
    """The 57 features of whole tracks, on tracks that one segment holds."""
    return rounded(extract_full_features(cut_lineage(_even_angles(cleaned(spark, sf, ONE)))))


@query(f"""WITH {clean_sql(SHORT)}, arr AS (
  SELECT entity, seg, count(*) AS n, list(coalesce(speed, 0.0) ORDER BY frame) AS speed,
    list(coalesce(x, 0.0) ORDER BY frame) AS x FROM clean GROUP BY entity, seg), pts AS (
  SELECT entity, seg, n, i, speed, x,
    CASE WHEN i = 7 THEN n - 1 ELSE CAST(floor(i * ((n - 1) / CAST(7 AS DOUBLE))) AS BIGINT) END AS src
  FROM arr, range(8) t(i))
  SELECT entity, seg, CAST(i AS INTEGER) AS i,
    {r("CASE WHEN n >= 8 THEN speed[src + 1] WHEN i < n THEN speed[i + 1] ELSE 0.0 END")} AS speed,
    {r("CASE WHEN n >= 8 THEN x[src + 1] WHEN i < n THEN x[i + 1] ELSE 0.0 END")} AS x FROM pts""")
def resample_fixed(spark, sf):
    sequences = resampled_sequences(cleaned(spark, sf, SHORT), length=8)
    return rounded(
        sequences.select(*KEYS, F.posexplode("seq").alias("i", "s")).select(
            *KEYS, "i", F.col("s.speed").alias("speed"), F.col("s.x").alias("x")
        )
    )
