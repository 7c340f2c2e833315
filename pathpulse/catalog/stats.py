"""Summaries, bins and hypothesis tests over the four numeric line-item columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathpulse.catalog.common import (
    SHORT, clean_sql, cleaned, f_p_sql, r, rounded, t_p_sql, z_p_sql,
)
from pathpulse.functions.pvalues import t_p_value
from pathpulse.operators import bins, describe, hypothesis
from pathpulse.operators.longview import missing_counts as count_missing
from pathpulse.operators.longview import varying_features
from pathpulse.sources.tables import read_table

QUERIES, ORACLES = {}, {}
FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


def _items(spark, sf):
    return read_table(spark, sf, "lineitem").select(
        *FEATURES, F.col("l_returnflag").alias("label")
    )


def _two(spark, sf):
    """Flags A and R as classes 0 and 1."""
    flag = F.col("l_returnflag")
    return (
        read_table(spark, sf, "lineitem")
        .where(flag.isin("A", "R"))
        .select(*FEATURES, (flag == "R").cast("int").alias("label"))
    )


def _graded(spark, sf):
    """All rows with the flag as a number: A, R and N are 0, 1 and 2."""
    flag = F.col("l_returnflag")
    return read_table(spark, sf, "lineitem").select(
        *FEATURES, F.when(flag == "A", 0).when(flag == "R", 1).otherwise(2).alias("label")
    )


LONG_SQL = "lv AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {f} AS value, l_returnflag AS label FROM lineitem" for f in FEATURES
) + ")"
TWO_SQL = "lv AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {f} AS value, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label"
    f" FROM lineitem WHERE l_returnflag IN ('A', 'R')"
    for f in FEATURES
) + ")"
GRADE_SQL = "lv AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {f} AS value, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE 2 END AS label"
    f" FROM lineitem"
    for f in FEATURES
) + ")"
PAIR_SQL = f"""WITH {TWO_SQL}, m AS (
  SELECT feature, count(CASE WHEN label = 0 THEN value END) AS n1,
    count(CASE WHEN label = 1 THEN value END) AS n2,
    avg(CASE WHEN label = 0 THEN value END) AS m1, avg(CASE WHEN label = 1 THEN value END) AS m2,
    var_samp(CASE WHEN label = 0 THEN value END) AS v1, var_samp(CASE WHEN label = 1 THEN value END) AS v2
  FROM lv GROUP BY feature)"""
POOLED = "(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))"


@query(f"""WITH {LONG_SQL} SELECT feature, count(value) AS n, {r("avg(value)", 4)} AS mean,
  {r("stddev_samp(value)", 4)} AS std, {r("min(value)", 4)} AS min,
  {r("quantile_cont(value, 0.25)", 4)} AS q25, {r("quantile_cont(value, 0.5)", 4)} AS q50,
  {r("quantile_cont(value, 0.75)", 4)} AS q75, {r("max(value)", 4)} AS max FROM lv GROUP BY feature""")
def describe_features(spark, sf):
    return rounded(describe.describe(_items(spark, sf), FEATURES), 4)


@query(f"""WITH {clean_sql(SHORT)}, c AS (SELECT count(CASE WHEN x IS NULL THEN 1 END) AS x,
  count(CASE WHEN y IS NULL THEN 1 END) AS y, count(CASE WHEN speed IS NULL THEN 1 END) AS speed,
  count(CASE WHEN turning_angle IS NULL THEN 1 END) AS turning_angle FROM clean)
  SELECT feature, n_missing FROM c UNPIVOT (n_missing FOR feature IN (x, y, speed, turning_angle))
  WHERE n_missing > 0""")
def missing_counts(spark, sf):
    return count_missing(cleaned(spark, sf, SHORT), ["x", "y", "speed", "turning_angle"])


@query(f"""WITH {LONG_SQL}, a AS (SELECT feature, value FROM lv UNION ALL
    SELECT 'constant', 3.0 FROM lineitem)
  SELECT feature, {r("stddev_samp(value)", 4)} AS std,
    count(DISTINCT value) > 1 AND stddev_samp(value) > 1e-8 AS varies FROM a GROUP BY feature""")
def constant_features(spark, sf):
    items = _items(spark, sf).withColumn("constant", F.lit(3.0))
    return rounded(varying_features(items, [*FEATURES, "constant"]), 4)


@query("SELECT l_returnflag AS label, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def class_distribution(spark, sf):
    return describe.class_counts(_items(spark, sf))


@query(f"""WITH {LONG_SQL}, e AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM lv GROUP BY feature),
  b AS (SELECT feature, label, (SELECT min(k) FROM range(1, 6) t(k)
      WHERE k = 5 OR value <= lo + k * ((hi - lo) / 5)) AS bin FROM lv JOIN e USING (feature)), c AS (
  SELECT feature, CAST(bin AS INTEGER) AS bin, label, count(*) AS n FROM b GROUP BY ALL)
  SELECT feature, bin, label, n, {r("n * 1.0 / sum(n) OVER (PARTITION BY feature, bin)")} AS proportion
  FROM c""")
def equal_width_crosstab(spark, sf):
    counts = bins.equal_width_counts(_items(spark, sf), FEATURES, "label")
    return rounded(bins.row_proportions(counts, "label"))


@query(f"""WITH {LONG_SQL}, e AS (SELECT feature, list_sort(list_distinct(
      quantile_cont(value, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS edges FROM lv GROUP BY feature), ex AS (
  SELECT feature, unnest(edges) AS edge FROM e), v AS (
  SELECT feature, value, label, count(*) AS k FROM lv GROUP BY ALL), b AS (
  SELECT v.feature, v.value, v.label, v.k, greatest(count(CASE WHEN edge < value THEN 1 END), 1) AS bin
  FROM v JOIN ex USING (feature) GROUP BY v.feature, v.value, v.label, v.k), c AS (
  SELECT feature, CAST(bin AS INTEGER) AS bin, label, CAST(sum(k) AS BIGINT) AS n FROM b
  GROUP BY feature, bin, label)
  SELECT feature, bin, label, n, {r("n * 1.0 / sum(n) OVER (PARTITION BY feature, bin)")} AS proportion
  FROM c""")
def equal_freq_crosstab(spark, sf):
    counts = bins.equal_frequency_counts(_items(spark, sf), FEATURES, "label")
    return rounded(bins.row_proportions(counts, "label"))


@query(f"""WITH {LONG_SQL}, e AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM lv GROUP BY feature),
  b AS (SELECT feature, label, (SELECT max(k) FROM range(20) t(k)
      WHERE k = 0 OR value >= lo + k * ((hi - lo) / 20)) AS bin FROM lv JOIN e USING (feature))
  SELECT feature, CAST(bin AS INTEGER) AS bin, label, count(*) AS n FROM b GROUP BY ALL""")
def hist_by_label(spark, sf):
    return bins.histogram_by_label(_items(spark, sf), FEATURES, "label")


@query(f"""WITH {LONG_SQL}, q AS (SELECT feature, label, quantile_cont(value, 0.25) AS q25,
    quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75 FROM lv GROUP BY feature, label)
  SELECT feature, label, {r("q25", 4)} AS q25, {r("q50", 4)} AS q50, {r("q75", 4)} AS q75,
    {r("min(CASE WHEN value >= q25 - (q75 - q25) * 1.5 THEN value END)", 4)} AS whisker_low,
    {r("max(CASE WHEN value <= q75 + (q75 - q25) * 1.5 THEN value END)", 4)} AS whisker_high,
    count(CASE WHEN value < q25 - (q75 - q25) * 1.5 OR value > q75 + (q75 - q25) * 1.5 THEN 1 END) AS outliers
  FROM lv JOIN q USING (feature, label) GROUP BY feature, label, q25, q50, q75""")
def boxplot_stats(spark, sf):
    return rounded(describe.box_statistics(_items(spark, sf), FEATURES, "label"), 4)


@query(f"""{PAIR_SQL}, g AS (SELECT feature, avg(value) AS m FROM lv GROUP BY feature)
  SELECT feature, {r("abs(m1 - m2)", 4)} AS absolute_difference,
    {r("abs(m1 - m2) / m")} AS relative_difference, {r(f"abs(m1 - m2) / sqrt{POOLED}")} AS cohens_d
  FROM m JOIN g USING (feature)""")
def effect_ranking(spark, sf):
    return rounded(
        hypothesis.effect_sizes(_two(spark, sf), FEATURES, "label", 0, 1)
        .withColumn("absolute_difference", F.round(F.col("absolute_difference") + 3.3e-11, 4))
    )


@query(f"""{PAIR_SQL}, d AS (SELECT feature, n1, n2, (m1 - m2) / sqrt{POOLED} AS d FROM m)
  SELECT feature, n1, n2, {r("d")} AS cohens_d, CASE WHEN abs(d) < 0.2 THEN 'negligible'
    WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS effect FROM d""")
def cohens_d(spark, sf):
    pair = hypothesis.two_groups(
        hypothesis.group_moments(_two(spark, sf), FEATURES, "label"), "label", 0, 1
    )
    d = hypothesis.cohens_d()
    return rounded(
        pair.select(
            "feature", "n1", "n2", d.alias("cohens_d"), hypothesis.effect_class(d).alias("effect")
        )
    )


@query(f"""{PAIR_SQL}, w AS (SELECT feature, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t,
    power(v1 / n1 + v2 / n2, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v2 / n2, 2) / (n2 - 1)) AS df FROM m)
  SELECT feature, {r("t")} AS t, {r("df", 3)} AS df, {r(t_p_sql("t", "df"))} AS p_value FROM w""")
def welch_t(spark, sf):
    pair = hypothesis.two_groups(
        hypothesis.group_moments(_two(spark, sf), FEATURES, "label"), "label", 0, 1
    )
    t, freedom = hypothesis.welch_t()
    out = pair.select("feature", t.alias("t"), freedom.alias("df")).withColumn(
        "p_value", t_p_value("t", "df")
    )
    return rounded(out.withColumn("df", F.round(F.col("df") + 3.3e-11, 3)))


@query(f"""{PAIR_SQL}, w AS (SELECT feature, (m1 - m2) / sqrt({POOLED} * (1.0 / n1 + 1.0 / n2)) AS t,
    CAST(n1 + n2 - 2 AS DOUBLE) AS df FROM m)
  SELECT feature, {r("t")} AS t, df, {r(t_p_sql("t", "df"))} AS p_value FROM w""")
def pooled_t(spark, sf):
    pair = hypothesis.two_groups(
        hypothesis.group_moments(_two(spark, sf), FEATURES, "label"), "label", 0, 1
    )
    t, freedom = hypothesis.pooled_t()
    return rounded(
        pair.select("feature", t.alias("t"), freedom.alias("df")).withColumn(
            "p_value", t_p_value("t", "df")
        )
    )


def _anova_sql(source: str) -> str:
    """F test over groups of ``source(feature, label, value)``."""
    return f"""gm AS (SELECT feature, label, count(value) AS n, avg(value) AS m, var_samp(value) AS v
    FROM {source} GROUP BY feature, label), ga AS (
    SELECT feature, avg(value) AS g FROM {source} GROUP BY feature), an AS (
  SELECT feature, CAST(count(*) - 1 AS DOUBLE) AS df1, CAST(sum(n) - count(*) AS DOUBLE) AS df2,
    (sum(n * power(m - g, 2)) / (count(*) - 1)) / (sum((n - 1) * v) / (sum(n) - count(*))) AS f
  FROM gm JOIN ga USING (feature) GROUP BY feature)
  SELECT feature, df1, df2, {r("f")} AS f, {r(f_p_sql("f", "df1", "df2"))} AS p_value FROM an"""


@query(f"WITH {LONG_SQL}, {_anova_sql('lv')}")
def anova_f(spark, sf):
    return rounded(
        hypothesis.anova(hypothesis.group_moments(_items(spark, sf), FEATURES, "label"))
    )


@query(f"""WITH {LONG_SQL}, md AS (SELECT feature, label, median(value) AS md FROM lv GROUP BY feature, label),
  dv AS (SELECT feature, label, abs(value - md) AS value FROM lv JOIN md USING (feature, label)),
  {_anova_sql('dv')}""")
def levene_f(spark, sf):
    return rounded(hypothesis.levene(_items(spark, sf), FEATURES, "label"))


@query(f"""WITH {TWO_SQL}, rk AS (SELECT feature, label, value,
    rank() OVER (PARTITION BY feature ORDER BY value)
      + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS rk FROM lv), tie AS (
  SELECT feature, sum(power(k, 3) - k) AS ties FROM (
    SELECT feature, value, CAST(count(*) AS DOUBLE) AS k FROM lv GROUP BY feature, value) GROUP BY feature),
  s AS (SELECT feature, CAST(count(CASE WHEN label = 0 THEN 1 END) AS DOUBLE) AS n1,
    CAST(count(CASE WHEN label = 1 THEN 1 END) AS DOUBLE) AS n2,
    sum(CASE WHEN label = 0 THEN CAST(rk AS DOUBLE) END) AS r1 FROM rk GROUP BY feature), u AS (
  SELECT *, r1 - n1 * (n1 + 1) / 2 AS u FROM s JOIN tie USING (feature)), z AS (
  SELECT *, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5)
    / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM u)
  SELECT feature, n1, n2, {r("u", 1)} AS u, {r("z")} AS z, {r("least(" + z_p_sql("z") + ", 1)")} AS p_value
  FROM z""")
def mann_whitney_u(spark, sf):
    out = hypothesis.mann_whitney(_two(spark, sf), FEATURES, "label", 0, 1).drop("method")
    return rounded(out.withColumn("u", F.round("u", 1)))


NATIONS = 25
# Counts of U = 0 … top for every pair of sample sizes, by the product of (1 - q^(m+i)) / (1 - q^i).
BOX_SQL = """RECURSIVE box(k, m, top, i, c) AS (
  SELECT *, 0, list_transform(range(0, top + 1), lambda j: CASE WHEN j = 0 THEN CAST(1 AS HUGEINT) ELSE 0 END) FROM (
    SELECT DISTINCT CAST(least(n1, n2) AS BIGINT) AS k, CAST(greatest(n1, n2) AS BIGINT) AS m,
      CAST(least(n1, n2) * greatest(n1, n2) // 2 AS BIGINT) AS top FROM u WHERE least(n1, n2) BETWEEN 1 AND 8 AND ties = 0)
  UNION ALL SELECT k, m, top, i + 1, list_transform(range(0, top + 1), lambda j: list_sum(list_transform(
    range(j, -1, -(i + 1)), lambda x: c[x + 1] - CASE WHEN x >= m + i + 1 THEN c[x - m - i] ELSE 0 END)))
  FROM box WHERE i < k), counts AS (SELECT k, m, c FROM box WHERE i = k)"""


@query(f"""WITH RECURSIVE a AS (
  SELECT 's' || s_nationkey AS feature, s_acctbal AS value, s_suppkey % 2 AS label FROM supplier
  UNION ALL SELECT 'c' || c_nationkey, c_acctbal, c_custkey % 2 FROM customer), rk AS (
  SELECT feature, label, rank() OVER (PARTITION BY feature ORDER BY value)
      + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS rk FROM a), tie AS (
  SELECT feature, sum(power(k, 3) - k) AS ties FROM (
    SELECT feature, value, CAST(count(*) AS DOUBLE) AS k FROM a GROUP BY feature, value) GROUP BY feature), s AS (
  SELECT feature, CAST(count(CASE WHEN label = 0 THEN 1 END) AS DOUBLE) AS n1,
    CAST(count(CASE WHEN label = 1 THEN 1 END) AS DOUBLE) AS n2,
    coalesce(sum(CASE WHEN label = 0 THEN CAST(rk AS DOUBLE) END), 0) AS r1 FROM rk GROUP BY feature), u AS (
  SELECT *, r1 - n1 * (n1 + 1) / 2 AS u FROM s JOIN tie USING (feature)), {BOX_SQL.replace('RECURSIVE ', '')}, z AS (
  SELECT *, least(n1, n2) <= 8 AND ties = 0 AS few, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5)
    / nullif(sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / nullif((n1 + n2) * (n1 + n2 - 1), 0))), 0) AS z FROM u
  LEFT JOIN counts ON k = least(n1, n2) AND m = greatest(n1, n2))
  SELECT feature, n1, n2, {r("u", 1)} AS u, CASE WHEN few THEN 'exact' ELSE 'normal' END AS method,
    CASE WHEN least(n1, n2) = 0 THEN NULL WHEN few THEN {r("least(1, 2 * CAST(list_sum(c[1:CAST(least(u, n1 * n2 - u) AS BIGINT) + 1]) AS DOUBLE) / CAST(exp(lgamma(n1 + n2 + 1) - lgamma(n1 + 1) - lgamma(n2 + 1)) AS DOUBLE))")}
      ELSE {r("least(" + z_p_sql("z") + ", 1)")} END AS p_value FROM z""")
def mann_whitney_small(spark, sf):
    """Balances of odd against even keys per nation: few suppliers, tested exactly, and many customers."""
    parts = [
        read_table(spark, sf, table).select(
            (F.col(f"{p}_{key}") % 2).alias("label"),
            *[
                F.when((F.col(f"{p}_nationkey") == k) & F.lit(p == own), F.col(f"{p}_acctbal")).alias(f"{own}{k}")
                for own in "sc" for k in range(NATIONS)
            ],
        )
        for table, p, key in (("supplier", "s", "suppkey"), ("customer", "c", "custkey"))
    ]
    rows = parts[0].unionByName(parts[1])
    out = hypothesis.mann_whitney(rows, [c for c in rows.columns if c != "label"], "label", 0, 1)
    return rounded(out.withColumn("u", F.round("u", 1)).drop("z"))


@query(f"""WITH {GRADE_SQL}, c AS (SELECT feature, count(value) AS n, corr(value, label) AS r FROM lv
    GROUP BY feature), t AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t FROM c)
  SELECT feature, n, {r("r")} AS r, {r("abs(r)")} AS abs_r, {r("t")} AS t,
    {r(t_p_sql("t", "CAST(n - 2 AS DOUBLE)"))} AS p_value FROM t""")
def pearson_label(spark, sf):
    return rounded(hypothesis.pearson(_graded(spark, sf), FEATURES, "label"))


RANKS_SQL = f"""WITH {GRADE_SQL}, rk AS (SELECT feature, value, label,
    rank() OVER (PARTITION BY feature ORDER BY value)
      + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS a,
    rank() OVER (PARTITION BY feature ORDER BY label)
      + (count(*) OVER (PARTITION BY feature, label) - 1) / 2.0 AS b FROM lv), sp AS (
  SELECT feature, corr(CAST(a AS DOUBLE), CAST(b AS DOUBLE)) AS rho FROM rk GROUP BY feature)"""


@query(f"{RANKS_SQL} SELECT feature, {r('rho')} AS rho FROM sp")
def spearman_label(spark, sf):
    return rounded(hypothesis.spearman(_graded(spark, sf), FEATURES, "label"))


@query(f"""{RANKS_SQL}, c AS (SELECT feature, count(value) AS n, corr(value, label) AS r FROM lv
    GROUP BY feature), t AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t FROM c)
  SELECT feature, {r("r")} AS r, {r("abs(r)")} AS abs_r, {r("rho")} AS rho, {r("t")} AS t,
    {r(t_p_sql("t", "CAST(n - 2 AS DOUBLE)"))} AS p_value FROM t JOIN sp USING (feature)""")
def label_correlations(spark, sf):
    return rounded(hypothesis.correlations(_graded(spark, sf), FEATURES, "label"))


_PAIRS = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[:i]]


@query(" UNION ALL ".join(
    f"SELECT '{a}' AS f1, '{b}' AS f2, {r(f'corr({a}, {b})')} AS r FROM lineitem" for a, b in _PAIRS
))
def corr_matrix(spark, sf):
    return rounded(describe.correlation_matrix(_items(spark, sf), FEATURES))


@query(f"""WITH {LONG_SQL}, e AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM lv GROUP BY feature)
  SELECT feature, label, {r("avg((value - lo) / (hi - lo))")} AS mean
  FROM lv JOIN e USING (feature) GROUP BY feature, label""")
def radar_means(spark, sf):
    return rounded(describe.normalized_means(_items(spark, sf), FEATURES, "label"))


@query(f"""WITH {LONG_SQL}, e AS (SELECT feature, unnest(list_distinct(
      quantile_cont(value, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS edge FROM lv GROUP BY feature), v AS (
  SELECT feature, value, label, count(*) AS k FROM lv GROUP BY ALL), b AS (
  SELECT v.feature, v.value, v.label, v.k, greatest(count(CASE WHEN edge < value THEN 1 END), 1) AS bin
  FROM v JOIN e USING (feature) GROUP BY v.feature, v.value, v.label, v.k), c AS (
  SELECT feature, bin, label, sum(k) AS n FROM b GROUP BY feature, bin, label), p AS (
  SELECT feature, n / sum(n) OVER (PARTITION BY feature) AS p,
    sum(n) OVER (PARTITION BY feature, bin) / sum(n) OVER (PARTITION BY feature) AS px,
    sum(n) OVER (PARTITION BY feature, label) / sum(n) OVER (PARTITION BY feature) AS py FROM c)
  SELECT feature, {r("sum(p * ln(p / (px * py)))", 9)} AS mutual_info FROM p GROUP BY feature""")
def binned_mi(spark, sf):
    return rounded(hypothesis.binned_mutual_information(_items(spark, sf), FEATURES, "label"), 9)


@query("""SELECT event_id, user_id, value FROM events
  ORDER BY md5(CAST(event_id AS VARCHAR) || '|42'), event_id LIMIT 500""")
def sample_rows(spark, sf):
    events = read_table(spark, sf, "events").select("event_id", "user_id", "value")
    return describe.random_sample(events, ["event_id"])


@query(f"""WITH {GRADE_SQL}, c AS (SELECT feature, abs(corr(value, label)) AS r FROM lv GROUP BY feature),
  e AS (SELECT feature, unnest(list_distinct(
      quantile_cont(value, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS edge FROM lv GROUP BY feature), vv AS (
  SELECT feature, value, label, count(*) AS k FROM lv GROUP BY ALL), b AS (
  SELECT vv.feature, vv.value, vv.label, vv.k, greatest(count(CASE WHEN edge < value THEN 1 END), 1) AS bin
  FROM vv JOIN e USING (feature) GROUP BY vv.feature, vv.value, vv.label, vv.k), cells AS (
  SELECT feature, bin, label, sum(k) AS n FROM b GROUP BY feature, bin, label), p AS (
  SELECT feature, n / sum(n) OVER (PARTITION BY feature) AS p,
    sum(n) OVER (PARTITION BY feature, bin) / sum(n) OVER (PARTITION BY feature) AS px,
    sum(n) OVER (PARTITION BY feature, label) / sum(n) OVER (PARTITION BY feature) AS py FROM cells), mi AS (
  SELECT feature, sum(p * ln(p / (px * py))) AS mi FROM p GROUP BY feature), f AS (
  SELECT * FROM (WITH {_anova_sql("lv")}))
  SELECT feature, f AS f_score, {r("mi", 9)} AS mutual_info, {r("r", 9)} AS abs_correlation
  FROM f JOIN mi USING (feature) JOIN c USING (feature)""")
def statistical_scores(spark, sf):
    """F score, mutual information and correlation of every column with the flag."""
    from pathpulse.plans.importances import statistical_scores as scores

    out = scores(_graded(spark, sf), FEATURES)
    return rounded(out.withColumn("f_score", F.round(F.col("f_score") + 3.3e-11, 6)), 9)


@query(f"""WITH s AS (SELECT l_linenumber AS n_features, avg(l_discount) AS mean_auc FROM lineitem GROUP BY l_linenumber)
  SELECT arg_max(n_features, mean_auc) AS n_features, {r("max(mean_auc)")} AS mean_auc,
    {r("max(mean_auc) - arg_min(mean_auc, n_features)")} AS gain FROM s""")
def feature_count_choice(spark, sf):
    """The smallest count with the best score, on mean discounts per line number."""
    from pathpulse.operators.importance import best_feature_count

    items = read_table(spark, sf, "lineitem")
    sweep = items.groupBy(F.col("l_linenumber").alias("n_features")).agg(F.avg("l_discount").alias("mean_auc"))
    return rounded(best_feature_count(sweep))
