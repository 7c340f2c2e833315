"""Weighted votes and evaluation on a derived segment score."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathpulse.catalog.common import r, rounded
from pathpulse.catalog.life import FEAT_SQL, segment_features
from pathpulse.operators import evaluation, folds, voting
from pathpulse.operators.segments import KEYS
from pathpulse.session import cut_lineage

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, name: str | None = None):
    def keep(fn):
        QUERIES[name or fn.__name__] = fn
        if sql:
            ORACLES[name or fn.__name__] = sql
        return fn

    return keep


def predictions(spark, sf):
    """Score each segment from its mean speed; rounded so that ties are ties in every engine."""
    p1 = F.round(1 / (1 + F.exp(2.5 - F.col("mean_speed"))) + 3.3e-11, 4)
    scored = segment_features(spark, sf).select(*KEYS, "label", p1.alias("p1"))
    placed = folds.with_folds(scored).select(
        "fold", *KEYS, "label", (1 - F.col("p1")).alias("p0"), "p1",
        (F.col("p1") > 0.5).cast("int").alias("prediction"),
    )
    return cut_lineage(placed)


PRED_SQL = f"""{FEAT_SQL}, fo AS (SELECT entity, CAST((row_number() OVER (PARTITION BY label
    ORDER BY md5(CAST(entity AS VARCHAR) || '|42'), entity) - 1) % 5 AS INTEGER) AS fold
  FROM (SELECT DISTINCT entity, label FROM feat)), sc AS (
  SELECT entity, seg, label, round(1 / (1 + exp(2.5 - mean_speed)) + 3.3e-11, 4) AS p1 FROM feat), pred AS (
  SELECT fold, entity, seg, label, 1 - p1 AS p0, p1, CAST(p1 > 0.5 AS INTEGER) AS prediction,
    row_number() OVER w AS pos, count(*) OVER (PARTITION BY entity) AS n
  FROM sc JOIN fo USING (entity) WINDOW w AS (PARTITION BY entity ORDER BY seg))"""

WEIGHT_SQL = {
    "uniform": "1.0",
    "confidence": "greatest(p0, p1)",
    "late_segments": "CASE WHEN n = 1 THEN 0.5 ELSE 0.5 + (pos - 1.0) / (n - 1) END",
    "early_segments": "CASE WHEN n = 1 THEN 1.5 ELSE 1.5 - (pos - 1.0) / (n - 1) END",
    "last_2_segments": "CASE WHEN pos > n - 2 THEN 1.0 ELSE 0.0 END",
    "last_2_segments_confidence": "CASE WHEN pos > n - 2 THEN greatest(p0, p1) ELSE 0.0 END",
    "late_segments_confidence":
        "CASE WHEN n = 1 THEN 0.5 ELSE 0.5 + (pos - 1.0) / (n - 1) END * greatest(p0, p1)",
}


def vote_sql(strategy: str) -> str:
    """CTE ``ev2`` with one decision per entity."""
    return f"""{PRED_SQL}, wt AS (SELECT *, CAST({WEIGHT_SQL[strategy]} AS DOUBLE) AS w FROM pred), sums AS (
  SELECT fold, entity, label, sum(CASE WHEN prediction = 0 THEN w ELSE 0 END) AS w0,
    sum(CASE WHEN prediction = 1 THEN w ELSE 0 END) AS w1, count(*) AS n_votes, avg(w) AS avg_weight,
    stddev_pop(w) AS weight_std FROM wt GROUP BY fold, entity, label), ev2 AS (
  SELECT fold, entity, label, CAST(round(w1, 9) > round(w0, 9) AS INTEGER) AS predicted, n_votes, avg_weight,
    weight_std, CASE WHEN w0 + w1 > 0 THEN greatest(w0, w1) / (w0 + w1) ELSE 0.5 END AS confidence FROM sums)"""


def _vote(strategy: str):
    @query(
        f"""{vote_sql(strategy)} SELECT fold, entity, label, predicted, n_votes, {r("avg_weight")} AS avg_weight,
  {r("weight_std")} AS weight_std, {r("confidence")} AS confidence, predicted = label AS correct FROM ev2""",
        name=f"vote_{strategy}",
    )
    def run(spark, sf):
        return rounded(voting.entity_votes(predictions(spark, sf), strategy))


for _strategy in voting.STRATEGIES:
    _vote(_strategy)


@query(" UNION ALL ".join(
    f"""(SELECT * FROM ({vote_sql(s)} SELECT '{s}' AS strategy,
      {r("avg(CASE WHEN predicted = label THEN 1.0 ELSE 0.0 END)")} AS accuracy,
      {r('''coalesce(2.0 * count(CASE WHEN predicted = 1 AND label = 1 THEN 1 END)
        / nullif(count(CASE WHEN predicted = 1 THEN 1 END) + count(CASE WHEN label = 1 THEN 1 END), 0), 0)''')} AS f1,
      {r("avg(confidence)")} AS avg_confidence FROM ev2))"""
    for s in voting.STRATEGIES
))
def strategy_compare(spark, sf):
    return rounded(voting.compare_strategies(predictions(spark, sf)))


GROUP_SQL = f"""{vote_sql("confidence")}, pl AS (
  SELECT *, (row_number() OVER (PARTITION BY fold, label ORDER BY entity) - 1) // 5 AS chunk FROM ev2), gr AS (
  SELECT fold, label, chunk, sum(CASE WHEN predicted = 0 THEN confidence ELSE 0 END) AS w0,
    sum(CASE WHEN predicted = 1 THEN confidence ELSE 0 END) AS w1, list(predicted ORDER BY entity) AS members
  FROM pl GROUP BY fold, label, chunk HAVING count(*) = 5), gv AS (
  SELECT fold, label, chunk, CAST(w1 > w0 AS INTEGER) AS predicted_class,
    greatest(w0, w1) / (w0 + w1) AS group_confidence, members FROM gr)"""


@query(f"""{GROUP_SQL} SELECT fold, label, chunk, predicted_class, {r("group_confidence")} AS group_confidence,
  CAST(members[1] AS VARCHAR) || CAST(members[2] AS VARCHAR) || CAST(members[3] AS VARCHAR)
    || CAST(members[4] AS VARCHAR) || CAST(members[5] AS VARCHAR) AS individual_preds FROM gv""")
def group_vote(spark, sf):
    groups = voting.group_votes(predictions(spark, sf))
    members = F.array_join(F.col("individual_preds").cast("array<string>"), "")
    return rounded(groups.withColumn("individual_preds", members))


@query(f"""{GROUP_SQL} SELECT count(*) AS groups,
  {r("coalesce(avg(CASE WHEN predicted_class = label THEN 1.0 ELSE 0.0 END), 0)")} AS accuracy,
  {r("coalesce(avg(CASE WHEN label = 0 THEN CASE WHEN predicted_class = 0 THEN 1.0 ELSE 0.0 END END), 0)")}
    AS control_accuracy,
  {r("coalesce(avg(CASE WHEN label = 1 THEN CASE WHEN predicted_class = 1 THEN 1.0 ELSE 0.0 END END), 0)")}
    AS treatment_accuracy, {r("avg(group_confidence)")} AS avg_confidence FROM gv""")
def group_vote_accuracy(spark, sf):
    return rounded(voting.group_vote_summary(voting.group_votes(predictions(spark, sf))))


@query(f"""{PRED_SQL}, c AS (SELECT count(CASE WHEN label = 1 AND prediction = 1 THEN 1 END) AS tp,
    count(CASE WHEN label = 0 AND prediction = 1 THEN 1 END) AS fp,
    count(CASE WHEN label = 1 AND prediction = 0 THEN 1 END) AS fn,
    count(CASE WHEN label = 0 AND prediction = 0 THEN 1 END) AS tn FROM pred)
  SELECT tp, fp, fn, tn, {r("(tp + tn) * 1.0 / (tp + fp + fn + tn)")} AS accuracy,
    {r("tp * 1.0 / (tp + fp)")} AS precision, {r("tp * 1.0 / (tp + fn)")} AS recall,
    {r("2.0 * tp / (2 * tp + fp + fn)")} AS f1 FROM c""")
def confusion_metrics(spark, sf):
    counts = evaluation.outcome_counts(predictions(spark, sf), [], "label", "prediction")
    return rounded(counts.select("tp", "fp", "fn", "tn", *evaluation.metric_columns()))


@query(f"""{PRED_SQL}, k AS (SELECT unnest([0, 1]) AS c), per AS (
  SELECT c, count(CASE WHEN label = c AND prediction = c THEN 1 END) AS hit,
    count(CASE WHEN prediction = c THEN 1 END) AS p, count(CASE WHEN label = c THEN 1 END) AS s
  FROM pred, k GROUP BY c), m AS (
  SELECT CAST(c AS VARCHAR) AS class, hit * 1.0 / p AS pr, hit * 1.0 / s AS rc, 2.0 * hit / (p + s) AS f, s
  FROM per), u AS (SELECT * FROM m UNION ALL
  SELECT 'macro avg', avg(pr), avg(rc), avg(f), CAST(sum(s) AS BIGINT) FROM m UNION ALL
  SELECT 'weighted avg', sum(pr * s) / sum(s), sum(rc * s) / sum(s), sum(f * s) / sum(s),
    CAST(sum(s) AS BIGINT) FROM m)
  SELECT class, {r("pr")} AS precision, {r("rc")} AS recall, {r("f")} AS f1, s AS support FROM u""")
def classification_report(spark, sf):
    return rounded(
        evaluation.classification_report(predictions(spark, sf), "label", "prediction")
    )


@query(f"""{PRED_SQL}, rk AS (SELECT label, rank() OVER (ORDER BY p1)
    + (count(*) OVER (PARTITION BY p1) - 1) / 2 AS rk FROM pred), s AS (
  SELECT sum(CASE WHEN label = 1 THEN CAST(rk AS DOUBLE) END) AS r1,
    CAST(count(CASE WHEN label = 1 THEN 1 END) AS DOUBLE) AS n1,
    CAST(count(CASE WHEN label = 0 THEN 1 END) AS DOUBLE) AS n0 FROM rk)
  SELECT n1, n0, {r("(r1 - n1 * (n1 + 1) / 2) / (n1 * n0)")} AS auc FROM s""")
def roc_auc_exact(spark, sf):
    return rounded(evaluation.roc_auc(predictions(spark, sf), "p1", "label"))


CURVE_SQL = f"""{PRED_SQL}, g AS (SELECT p1, count(*) AS n, count(CASE WHEN label = 1 THEN 1 END) AS pos
  FROM pred GROUP BY p1), cu AS (
  SELECT p1, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(n - pos) OVER w AS BIGINT) AS fp,
    sum(pos) OVER () AS np, sum(n - pos) OVER () AS nn FROM g WINDOW w AS (ORDER BY p1 DESC))"""


@query(f"""{CURVE_SQL} SELECT p1 AS threshold, tp, fp, {r("tp * 1.0 / np")} AS tpr, {r("fp * 1.0 / nn")} AS fpr
  FROM cu""")
def roc_curve(spark, sf):
    points = evaluation.curve_points(predictions(spark, sf), "p1", "label")
    return rounded(points.select("threshold", "tp", "fp", "tpr", "fpr"))


@query(f"""{CURVE_SQL} SELECT p1 AS threshold, {r("tp * 1.0 / (tp + fp)")} AS precision,
  {r("tp * 1.0 / np")} AS recall FROM cu""")
def pr_curve(spark, sf):
    points = evaluation.curve_points(predictions(spark, sf), "p1", "label")
    return rounded(points.select("threshold", "precision", F.col("tpr").alias("recall")))


@query(f"""{PRED_SQL}, f AS (SELECT fold, avg(CASE WHEN prediction = label THEN 1.0 ELSE 0.0 END) AS a
  FROM pred GROUP BY fold) SELECT {r("avg(a)")} AS mean, {r("stddev_pop(a)")} AS std, count(a) AS folds FROM f""")
def fold_accuracy(spark, sf):
    counts = evaluation.outcome_counts(predictions(spark, sf), ["fold"], "label", "prediction")
    scores = counts.select("fold", *evaluation.metric_columns("accuracy"))
    return rounded(evaluation.fold_summary(scores, "accuracy"))
