"""Labels, folds, life bins, trends and first-against-last comparison on segment features."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathpulse.catalog.common import (
    SHORT, clean_sql, cleaned, f_p_sql, r, rounded, t_p_sql, z_p_sql,
)
from pathpulse.operators import compare, describe, folds, labels, trends
from pathpulse.operators import features_native as native
from pathpulse.operators.segments import KEYS
from pathpulse.session import cut_lineage
from pathpulse.sources.tables import read_table

QUERIES, ORACLES = {}, {}
FEATURES = [
    "mean_speed", "std_speed", "total_distance", "kinetic_energy_proxy", "movement_efficiency",
    "speed_trend",
]


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


def segment_features(spark, sf):
    """Scalar features per short segment with the entity's label."""
    frames = cleaned(spark, sf, SHORT)
    scalars = native.scalar_features(
        frames, native.basic_aggregates(), native.physics_aggregates(), native.temporal_aggregates()
    )
    # every operator below reads the feature table more than once
    return cut_lineage(
        scalars.select(*KEYS, (F.col("entity") % 2).cast("int").alias("label"), *FEATURES)
    )


FEAT_SQL = f"""WITH {clean_sql(SHORT)}, steps AS (
  SELECT *, row_number() OVER w - 1 AS pos,
    sqrt(power(x - last_value(x IGNORE NULLS) OVER b, 2)
       + power(y - last_value(y IGNORE NULLS) OVER b, 2)) AS dist
  FROM clean WINDOW w AS (PARTITION BY entity, seg ORDER BY frame),
    b AS (PARTITION BY entity, seg ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), feat AS (
  SELECT entity, seg, CAST(entity % 2 AS INTEGER) AS label,
    CASE WHEN count(x) > 0 THEN avg(speed) ELSE 0.0 END AS mean_speed,
    CASE WHEN count(x) > 0 THEN coalesce(stddev_samp(speed), 0.0) ELSE 0.0 END AS std_speed,
    CASE WHEN count(x) > 0 THEN coalesce(sum(dist), 0.0) ELSE 0.0 END AS total_distance,
    avg(speed * speed / 2) AS kinetic_energy_proxy,
    sum(speed) / (max(speed) * count(speed) + 1e-6) AS movement_efficiency,
    CASE WHEN count(speed) >= 3 THEN coalesce(regr_slope(speed, pos), 0.0) ELSE 0.0 END AS speed_trend
  FROM steps GROUP BY entity, seg), life AS (
  SELECT *, CAST(seg AS DOUBLE) / nullif(max(seg) OVER w, 0) * 100 AS pct, max(seg) OVER w AS max_segment,
    count(*) OVER w AS total_segments,
    row_number() OVER (PARTITION BY entity ORDER BY seg) AS up,
    row_number() OVER (PARTITION BY entity ORDER BY seg DESC) AS down
  FROM feat WINDOW w AS (PARTITION BY entity)), binned AS (
  SELECT *, CASE WHEN pct > 0 AND pct <= 100 THEN ceil(pct / 20) END AS bin,
    CASE WHEN pct > 80 AND pct <= 100 THEN ceil((pct - 80) / 5) END AS eol FROM life)"""


def long_sql(ids: str) -> str:
    """The long view ``lv`` of ``binned`` with the given id columns."""
    return "lv AS (" + " UNION ALL ".join(
        f"SELECT {ids}, '{f}' AS feature, {f} AS value FROM binned" for f in FEATURES
    ) + ")"


@query(f"""{FEAT_SQL} SELECT entity, seg, max_segment, total_segments, {r("pct")} AS lifespan_percentage
  FROM life""")
def life_percentage(spark, sf):
    life = labels.with_life_percentage(segment_features(spark, sf))
    return rounded(
        life.select("entity", "seg", "max_segment", "total_segments", "lifespan_percentage")
    )


@query(f"""{FEAT_SQL} SELECT entity, seg, CAST(seg > max_segment - 3 AS INTEGER) AS death_close FROM life""")
def label_last_n(spark, sf):
    return labels.close_to_death(segment_features(spark, sf), 3).select(*KEYS, "death_close")


@query(f"""{FEAT_SQL} SELECT entity, seg, max_segment - seg AS segments_from_end,
  CAST(max_segment - seg <= 3 AS INTEGER) AS death_close FROM life""")
def label_proximity(spark, sf):
    return labels.close_to_death(segment_features(spark, sf), 3, inclusive=True).select(
        *KEYS, "segments_from_end", "death_close"
    )


@query(f"""{FEAT_SQL}, k AS (SELECT entity, seg, max(seg) OVER (PARTITION BY entity) AS top FROM feat
  WHERE seg < 5) SELECT entity, seg, CAST(seg > top - 2 AS INTEGER) AS label FROM k""")
def first_n_label(spark, sf):
    return labels.first_segments(
        segment_features(spark, sf), 5, "death_proximity", threshold=2
    ).select(*KEYS, "label")


@query(f"""{FEAT_SQL} SELECT entity, seg, 'first' AS part FROM life WHERE total_segments > 4 AND up <= 2
  UNION ALL SELECT entity, seg, 'last' FROM life WHERE total_segments > 4 AND down <= 2""")
def first_last_absolute(spark, sf):
    return labels.first_and_last(segment_features(spark, sf), 2).select(*KEYS, "part")


@query("""WITH e AS (SELECT DISTINCT user_id AS entity, CAST(user_id % 2 AS INTEGER) AS label FROM events)
  SELECT entity, label, CAST((row_number() OVER (PARTITION BY label
    ORDER BY md5(CAST(entity AS VARCHAR) || '|42'), entity) - 1) % 5 AS INTEGER) AS fold FROM e""")
def group_kfold(spark, sf):
    return folds.entity_folds(segment_features(spark, sf))


@query(f"""{FEAT_SQL}, len AS (SELECT entity, seg, count(*) AS k FROM clean GROUP BY entity, seg)
  SELECT count(*) AS samples, CAST({len(FEATURES)} AS BIGINT) AS features, count(DISTINCT entity) AS entities,
    count(CASE WHEN label = 0 THEN 1 END) AS class_0, count(CASE WHEN label = 1 THEN 1 END) AS class_1,
    min(k) AS min_length, max(k) AS max_length, {r("avg(k)")} AS mean_length
  FROM feat JOIN len USING (entity, seg)""")
def data_info(spark, sf):
    lengths = cleaned(spark, sf, SHORT).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_frames"))
    return rounded(describe.data_info(segment_features(spark, sf), lengths))


@query(f"""{FEAT_SQL}, {long_sql("label, bin")} SELECT label, CAST(bin AS INTEGER) AS bin, feature,
  {r("avg(value)")} AS mean, {r("stddev_samp(value) / sqrt(count(value))")} AS sem, count(value) AS n
  FROM lv WHERE bin IS NOT NULL GROUP BY label, bin, feature""")
def life_bins(spark, sf):
    binned = trends.with_life_bins(segment_features(spark, sf))
    return rounded(trends.bin_means(binned, FEATURES, "lifespan_bin", ["label"]))


def _trend_sql(by: str, x: str, min_bins: int, bin_column: str = "bin") -> str:
    """CTE ``tr`` with the fitted line through bin means."""
    keys = f"{by}, " if by else ""
    return f"""{FEAT_SQL}, {long_sql("label, bin, eol")}, bm AS (
  SELECT {keys}feature, {bin_column} AS bin, avg(value) AS mean FROM lv WHERE {bin_column} IS NOT NULL
  GROUP BY {keys}feature, {bin_column}), ft AS (
  SELECT {keys}feature, count(*) AS n_bins, regr_slope(mean, {x}) AS slope,
    CASE WHEN min(mean) = max(mean) THEN 0.0 ELSE regr_r2(mean, {x}) END AS r2,
    min_by(mean, bin) AS early, max_by(mean, bin) AS late
  FROM bm GROUP BY {keys}feature HAVING count(*) >= {min_bins}), tt AS (
  SELECT *, sqrt((n_bins - 2) * r2 / nullif(1 - r2, 0)) AS t, CAST(n_bins - 2 AS DOUBLE) AS df FROM ft), tr AS (
  SELECT *, CASE WHEN r2 >= 1 THEN 0.0 WHEN df = 0 THEN CASE WHEN r2 = 0 THEN 1.0 ELSE 0.0 END
    ELSE {t_p_sql("t", "nullif(df, 0)")} END AS p FROM tt)"""


_TREND_COLUMNS = f"""feature, n_bins, {r("slope")} AS slope, {r("r2")} AS r_squared, {r("early")} AS early_mean,
  {r("late")} AS late_mean, {r("p")} AS p_value, {r("(late - early) / abs(early) * 100", 4)} AS percentage_change,
  CASE WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS trend_direction"""


def _trend_rounded(df):
    change = F.round(F.col("percentage_change") + 3.3e-11, 4)
    return rounded(df.withColumn("percentage_change", change))


@query(f"{_trend_sql('', '(bin - 1) * 20', 3)} SELECT {_TREND_COLUMNS} FROM tr")
def trend_overall(spark, sf):
    binned = trends.with_life_bins(segment_features(spark, sf))
    return _trend_rounded(
        trends.linear_trends(trends.bin_means(binned, FEATURES, "lifespan_bin"))
    )


@query(f"{_trend_sql('label', '(bin - 1) * 20', 3)} SELECT label, {_TREND_COLUMNS} FROM tr")
def trend_by_condition(spark, sf):
    binned = trends.with_life_bins(segment_features(spark, sf))
    means = trends.bin_means(binned, FEATURES, "lifespan_bin", ["label"])
    return _trend_rounded(trends.linear_trends(means, by=["label"]))


@query(f"""{_trend_sql('label', 'bin * 20 - 10', 3)}, sc AS (
  SELECT feature, label, slope * CASE WHEN p < 0.05 THEN 1 ELSE 0.5 END AS s FROM tr)
  SELECT feature, {r("max(CASE WHEN label = 0 THEN s END)")} AS condition_0,
    {r("max(CASE WHEN label = 1 THEN s END)")} AS condition_1 FROM sc GROUP BY feature""")
def trend_score_pivot(spark, sf):
    binned = trends.with_life_bins(segment_features(spark, sf))
    means = trends.bin_means(binned, FEATURES, "lifespan_bin", ["label"])
    return rounded(trends.trend_scores(means, [0, 1]))


@query(f"""{_trend_sql('', 'bin * 20 - 10', 3)} SELECT {_TREND_COLUMNS} FROM tr
  WHERE p < 0.5 AND r2 > 0.1 ORDER BY p, feature LIMIT 6""")
def trend_significant(spark, sf):
    binned = trends.with_life_bins(segment_features(spark, sf))
    fits = trends.linear_trends(
        trends.bin_means(binned, FEATURES, "lifespan_bin"), trends.centre
    )
    # the event tracks have no trend at the 5 % level, so the level is wide here
    return _trend_rounded(trends.significant_trends(fits, alpha=0.5))


@query(f"{_trend_sql('', 'bin * 5 + 77.5', 2, 'eol')} SELECT {_TREND_COLUMNS} FROM tr")
def end_of_life_trend(spark, sf):
    binned = trends.with_life_bins(segment_features(spark, sf))
    means = trends.bin_means(binned, FEATURES, "eol_bin")
    return _trend_rounded(trends.linear_trends(means, trends.end_of_life_centre, min_bins=2))


@query(f"""{FEAT_SQL}, {long_sql("eol")} SELECT feature,
  {", ".join(r(f"avg(CASE WHEN eol = {b} THEN value END)") + f" AS bin_{b}" for b in (1, 2, 3, 4))}
  FROM lv WHERE eol IS NOT NULL GROUP BY feature""")
def end_of_life_means(spark, sf):
    binned = trends.with_life_bins(segment_features(spark, sf))
    means = trends.bin_means(binned, FEATURES, "eol_bin")
    wide = means.groupBy("feature").pivot("bin", [1, 2, 3, 4]).agg(F.first("mean"))
    return rounded(wide.select("feature", *[F.col(str(b)).alias(f"bin_{b}") for b in (1, 2, 3, 4)]))


def _change_sql(part: str) -> str:
    return f"""{FEAT_SQL}, {long_sql(f"{part} AS part")}, m AS (
  SELECT feature, count(CASE WHEN part = 'first' THEN value END) AS n1,
    count(CASE WHEN part = 'last' THEN value END) AS n2, avg(CASE WHEN part = 'first' THEN value END) AS m1,
    avg(CASE WHEN part = 'last' THEN value END) AS m2,
    var_samp(CASE WHEN part = 'first' THEN value END) AS v1,
    var_samp(CASE WHEN part = 'last' THEN value END) AS v2, count(part) AS n_rows
  FROM lv GROUP BY feature), t AS (
  SELECT *, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) AS t,
    CAST(n1 + n2 - 2 AS DOUBLE) AS df FROM m), p AS (SELECT *, {t_p_sql("t", "df")} AS p FROM t)
  SELECT feature, {r("m1")} AS first_mean, {r("m2")} AS last_mean, {r("m2 - m1")} AS absolute_difference,
    {r("(m2 - m1) / abs(m1) * 100", 4)} AS percentage_change, {r("t")} AS t_statistic, {r("p")} AS p_value,
    p < 0.05 AS significant, {r("abs(t) / sqrt(n_rows - 2)")} AS effect_size FROM p"""


@query(_change_sql("CASE WHEN pct <= 50 THEN 'first' WHEN pct > 50 THEN 'last' END"))
def half_life_change(spark, sf):
    halves = labels.halves_by_percentage(segment_features(spark, sf))
    return _trend_rounded(trends.part_changes(halves, FEATURES, "part", "first", "last"))


@query(_change_sql("CASE WHEN pct <= 20 THEN 'first' WHEN pct >= 80 THEN 'last' END"))
def early_late(spark, sf):
    parts = trends.early_and_late(trends.with_life_percentage(segment_features(spark, sf)))
    return _trend_rounded(trends.part_changes(parts, FEATURES, "part", "early", "late"))


@query(f"""WITH lv AS (
    SELECT l_orderkey, l_linenumber, 'l_quantity' AS feature, l_quantity AS value FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, 'l_extendedprice', l_extendedprice FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', l_discount FROM lineitem), c AS (
  SELECT feature, avg(value) AS m, stddev_samp(value) / abs(avg(value)) AS cv FROM lv
  GROUP BY feature, l_orderkey, l_linenumber HAVING count(value) > 1 AND avg(value) <> 0)
  SELECT feature, {r("avg(cv)")} AS mean_cv, {r("stddev_samp(cv)")} AS std_cv, {r("max(cv)")} AS max_cv,
    {r("min(cv)")} AS min_cv, count(*) AS segments_analyzed FROM c GROUP BY feature""")
def replicate_cv(spark, sf):
    items = read_table(spark, sf, "lineitem")
    return rounded(
        trends.replicate_variation(
            items, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice", "l_discount"]
        )
    )


_HALVES = "CASE WHEN pct <= 50 THEN 0 WHEN pct > 50 THEN 1 END AS g"
_ENDS = "CASE WHEN total_segments > 4 AND up <= 2 THEN 0 WHEN total_segments > 4 AND down <= 2 THEN 1 END AS g"


def _compare_sql(parts: str) -> str:
    """CTE ``res`` with all statistics between the parts 0 and 1."""
    return f"""{FEAT_SQL}, {long_sql(parts)}, v AS (
  SELECT * FROM lv WHERE g IS NOT NULL), m AS (
  SELECT feature, count(CASE WHEN g = 0 THEN 1 END) AS n1, count(CASE WHEN g = 1 THEN 1 END) AS n2,
    avg(CASE WHEN g = 0 THEN value END) AS m1, avg(CASE WHEN g = 1 THEN value END) AS m2,
    var_samp(CASE WHEN g = 0 THEN value END) AS v1, var_samp(CASE WHEN g = 1 THEN value END) AS v2,
    median(CASE WHEN g = 0 THEN value END) AS d1, median(CASE WHEN g = 1 THEN value END) AS d2
  FROM v GROUP BY feature), w AS (
  SELECT *, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS d,
    (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t, power(v1 / n1 + v2 / n2, 2)
      / (power(v1 / n1, 2) / (n1 - 1) + power(v2 / n2, 2) / (n2 - 1)) AS df FROM m), wp AS (
  SELECT *, {t_p_sql("t", "df")} AS tp FROM w), rk AS (
  SELECT feature, g, rank() OVER (PARTITION BY feature ORDER BY value)
    + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS rk FROM v), ties AS (
  SELECT feature, sum(power(k, 3) - k) AS ties FROM (SELECT feature, CAST(count(*) AS DOUBLE) AS k
    FROM v GROUP BY feature, value) GROUP BY feature), ur AS (
  SELECT feature, sum(CASE WHEN g = 0 THEN CAST(rk AS DOUBLE) END) AS r1 FROM rk GROUP BY feature), uz AS (
  SELECT feature, r1 - CAST(n1 AS DOUBLE) * (n1 + 1) / 2 AS u, CAST(n1 AS DOUBLE) AS a,
    CAST(n2 AS DOUBLE) AS b, ties FROM ur JOIN m USING (feature) JOIN ties USING (feature)), up AS (
  SELECT *, (greatest(u, a * b - u) - a * b / 2 - 0.5)
    / sqrt(a * b / 12 * (a + b + 1 - ties / ((a + b) * (a + b - 1)))) AS z FROM uz), uq AS (
  SELECT *, least({z_p_sql("z")}, 1) AS u_p FROM up), dv AS (
  SELECT feature, g, abs(value - CASE WHEN g = 0 THEN d1 ELSE d2 END) AS e FROM v JOIN m USING (feature)), dg AS (
  SELECT feature, g, count(*) AS n, avg(e) AS em, var_samp(e) AS ev FROM dv GROUP BY feature, g), de AS (
  SELECT feature, avg(e) AS ge FROM dv GROUP BY feature), lf AS (
  SELECT feature, sum(n * power(em - ge, 2)) / (sum((n - 1) * ev) / (sum(n) - 2)) AS f,
    CAST(sum(n) - 2 AS DOUBLE) AS df2 FROM dg JOIN de USING (feature) GROUP BY feature), lp AS (
  SELECT *, {f_p_sql("f", "CAST(1 AS DOUBLE)", "df2")} AS l_p FROM lf), res AS (
  SELECT * FROM wp JOIN uq USING (feature) JOIN lp USING (feature))"""


_COMPARE_SQL = _compare_sql(_HALVES)
_COMPARE_COLUMNS = f"""feature, {r("m1")} AS first_mean, {r("m2")} AS last_mean,
  {r("sqrt(v1)")} AS first_std, {r("sqrt(v2)")} AS last_std, {r("d1")} AS first_median,
  {r("d2")} AS last_median, {r("m2 - m1")} AS absolute_difference,
  {r("(m2 - m1) / abs(m1) * 100", 4)} AS percentage_change, {r("d")} AS effect_size_cohens_d,
  CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium'
    ELSE 'large' END AS effect_interpretation, {r("t")} AS t_statistic, {r("tp")} AS t_p_value,
  {r("u")} AS mannwhitney_u, {r("u_p")} AS mannwhitney_p_value, {r("f")} AS levene_statistic,
  {r("l_p")} AS levene_p, tp < 0.05 AS t_significant, u_p < 0.05 AS mannwhitney_significant,
  l_p > 0.05 AS variance_equal, n1 AS n_first, n2 AS n_last"""


@query(f"{_COMPARE_SQL} SELECT {_COMPARE_COLUMNS} FROM res")
def first_vs_last(spark, sf):
    return _trend_rounded(compare.first_against_last(segment_features(spark, sf), FEATURES))


@query(f"{_compare_sql(_ENDS)} SELECT {_COMPARE_COLUMNS} FROM res")
def first_vs_last_ends(spark, sf):
    """The first against the last two segments of every entity that has more than four."""
    return _trend_rounded(compare.first_against_last(segment_features(spark, sf), FEATURES, "absolute", 2))


@query(f"""{_COMPARE_SQL}, sc AS (SELECT feature, d, tp, (m2 - m1) / abs(m1) * 100 AS pc,
    abs(d) * -log10(greatest(tp, 1e-10)) AS c FROM res)
  SELECT feature, {r("c", 5)} AS combined_score, row_number() OVER (ORDER BY abs(d) DESC, feature) AS rank_effect_size,
    row_number() OVER (ORDER BY abs(pc) DESC, feature) AS rank_percentage_change,
    row_number() OVER (ORDER BY tp, feature) AS rank_p_value,
    row_number() OVER (ORDER BY c DESC, feature) AS rank_combined FROM sc""")
def feature_ranking(spark, sf):
    halves = labels.halves_by_percentage(segment_features(spark, sf))
    out = compare.ranked(compare.compare_parts(halves, FEATURES))
    return rounded(
        out.select(
            "feature", "combined_score",
            *[F.col(c).cast("long").alias(c) for c in out.columns if c.startswith("rank_")],
        ),
        5,
    )


@query(f"""{_COMPARE_SQL}, sc AS (SELECT abs(d) AS d, tp, u_p, abs((m2 - m1) / m1) * 100 AS pc FROM res)
  SELECT count(*) AS features, count(CASE WHEN tp < 0.05 THEN 1 END) AS t_significant,
    count(CASE WHEN u_p < 0.05 THEN 1 END) AS mannwhitney_significant,
    count(CASE WHEN d >= 0.8 THEN 1 END) AS large_effect,
    count(CASE WHEN d >= 0.5 AND d < 0.8 THEN 1 END) AS medium_effect,
    count(CASE WHEN d >= 0.2 AND d < 0.5 THEN 1 END) AS small_effect,
    count(CASE WHEN d < 0.2 THEN 1 END) AS negligible_effect,
    count(CASE WHEN pc > 100 THEN 1 END) AS change_over_100,
    count(CASE WHEN pc > 50 AND pc <= 100 THEN 1 END) AS change_50_to_100,
    count(CASE WHEN pc > 20 AND pc <= 50 THEN 1 END) AS change_20_to_50 FROM sc""")
def comparison_summary(spark, sf):
    halves = labels.halves_by_percentage(segment_features(spark, sf))
    return compare.summary_counts(compare.compare_parts(halves, FEATURES))


_SUMMARY_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS analysis, count(*) FILTER (p < 0.05 AND {which}) AS significant FROM ({sql})"
    for name, sql, which in (
        ("overall", _trend_sql("", "bin * 20 - 10", 3) + " SELECT p FROM tr", "true"),
        ("per_condition", _trend_sql("label", "bin * 20 - 10", 3) + " SELECT p FROM tr", "true"),
        ("increasing", _trend_sql("", "bin * 20 - 10", 3) + " SELECT p, slope FROM tr", "slope > 0"),
        ("decreasing", _trend_sql("", "bin * 20 - 10", 3) + " SELECT p, slope FROM tr", "slope <= 0"),
        ("end_of_life", _trend_sql("", "bin * 5 + 77.5", 2, "eol") + " SELECT p FROM tr", "true"),
        ("early_late", _change_sql("CASE WHEN pct <= 20 THEN 'first' WHEN pct >= 80 THEN 'last' END").rsplit("SELECT feature", 1)[0] + "SELECT p FROM p", "true"),
        ("first_last_50", _change_sql("CASE WHEN pct <= 50 THEN 'first' WHEN pct > 50 THEN 'last' END").rsplit("SELECT feature", 1)[0] + "SELECT p FROM p", "true"),
    )
)


@query(_SUMMARY_SQL)
def temporal_summary(spark, sf):
    """How many features change significantly in every analysis of age."""
    from pathpulse.plans import temporal

    return temporal.summary(temporal.temporal_analysis(segment_features(spark, sf), FEATURES))
