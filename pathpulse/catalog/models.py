"""Imputation, balancing, classifiers and importance."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathpulse.catalog.common import LONG, SHORT, clean_sql, cleaned, r, rounded
from pathpulse.catalog.life import FEAT_SQL, segment_features
from pathpulse.catalog.stats import LONG_SQL
from pathpulse.catalog.votes import PRED_SQL, predictions
from pathpulse.operators import (
    balance,
    classifiers,
    evaluation,
    folds,
    importance,
    impute,
    neighbors,
    projection,
    resample,
    thresholds,
    voting,
)
from pathpulse.operators.numbering import group_extremes
from pathpulse.operators.segments import KEYS
from pathpulse.params import VOTING_FEATURES
from pathpulse.plans.extract import extract_features
from pathpulse.session import cut_lineage
from pathpulse.sources.tables import read_table

QUERIES, ORACLES = {}, {}
WIDTH = 64
NAMES = [f"e{i:02d}" for i in range(WIDTH)]
# As in ``feat_meandering``: a segment of 32 frames holds three windows.
MEANDER_WINDOW = 10


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


def labelled_vectors(spark, sf):
    """Embeddings as feature rows: five vectors make an entity, classes 0-4 are negative."""
    vec = F.transform("embedding", lambda v: v.cast("double"))
    rows = read_table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.floor(F.col("vec_id") / 5).alias("entity"),
        F.pmod("vec_id", F.lit(5)).alias("seg"),
        (F.col("label") >= 5).cast("int").alias("label"),
        vec.alias("vec"),
    )
    # an entity has one class: that of its first vector
    own = rows.groupBy("entity").agg(F.min_by("label", "seg").alias("label"))
    return rows.drop("label").join(own, "entity")


@query(f"""WITH {clean_sql(SHORT)}, md AS (SELECT median(x) AS mx, median(y) AS my,
    median(turning_angle) AS mt FROM clean)
  SELECT entity, frame, {r("coalesce(x, mx)")} AS x, {r("coalesce(y, my)")} AS y,
    {r("coalesce(turning_angle, mt)")} AS turning_angle FROM clean, md""")
def median_impute(spark, sf):
    frames = cleaned(spark, sf, SHORT).select("entity", "frame", "x", "y", "turning_angle")
    return rounded(impute.impute_medians(cut_lineage(frames), ["x", "y", "turning_angle"]))


@query(f"""WITH s AS (SELECT avg(l_quantity) AS a, stddev_pop(l_quantity) AS b, avg(l_extendedprice) AS c,
    stddev_pop(l_extendedprice) AS d FROM lineitem)
  SELECT l_orderkey, l_linenumber, {r("(l_quantity - a) / b")} AS l_quantity,
    {r("(l_extendedprice - c) / d")} AS l_extendedprice FROM lineitem, s""")
def standardize(spark, sf):
    items = read_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"
    )
    return rounded(impute.standardize(items, ["l_quantity", "l_extendedprice"]))


_SCORES = ("rf_importance", "perm_importance", "f_score", "mutual_info", "abs_correlation")
_SCORE_SQL = {
    "rf_importance": "avg(value)",
    "perm_importance": "stddev_samp(value)",
    "f_score": "max(value)",
    "mutual_info": "stddev_samp(value) / avg(value)",
    "abs_correlation": "min(value)",
}


@query(f"""WITH {LONG_SQL}, s AS (SELECT feature, {", ".join(f"{q} AS {n}" for n, q in _SCORE_SQL.items())}
    FROM lv GROUP BY feature), m AS (SELECT feature, {", ".join(
    f"coalesce(({n} - min({n}) OVER ()) / nullif(max({n}) OVER () - min({n}) OVER (), 0), 0) AS {n}"
    for n in _SCORES)} FROM s)
  SELECT feature, {r("0.3 * rf_importance + 0.3 * perm_importance + 0.2 * f_score + 0.1 * mutual_info"
                     " + 0.1 * abs_correlation")} AS combined_score FROM m""")
def combine_importance(spark, sf):
    """The combination rule on five plain statistics standing in for the five scores."""
    from pathpulse.catalog.stats import FEATURES
    from pathpulse.operators.longview import per_feature

    table = per_feature(
        read_table(spark, sf, "lineitem"), [], FEATURES,
        {
            "rf_importance": F.avg, "perm_importance": F.stddev, "f_score": F.max,
            "mutual_info": lambda c: F.stddev(c) / F.avg(c), "abs_correlation": F.min,
        },
    )
    combined = importance.combine_scores(
        table.select("feature", "rf_importance"), table.select("feature", "perm_importance"),
        table.select("feature", "f_score", "mutual_info", "abs_correlation"),
    )
    return rounded(combined.select("feature", "combined_score"))


@query(f"""{FEAT_SQL}, t AS (SELECT unnest([1, 2, 3, 5]) AS threshold)
  SELECT CAST(threshold AS INTEGER) AS threshold, count(CASE WHEN max_segment - seg <= threshold THEN 1 END)
      AS positive_samples, count(CASE WHEN max_segment - seg > threshold THEN 1 END) AS negative_samples,
    {r("avg(CASE WHEN max_segment - seg <= threshold THEN 1.0 ELSE 0.0 END)")} AS positive_rate
  FROM life, t GROUP BY threshold""")
def threshold_counts(spark, sf):
    return rounded(thresholds.threshold_counts(segment_features(spark, sf), [1, 2, 3, 5]))


_RISK_SQL = f"""{PRED_SQL}, lp AS (SELECT p1, CAST(seg AS DOUBLE)
    / nullif(max(seg) OVER (PARTITION BY entity), 0) * 100 AS pct FROM pred)"""


@query(f"""{_RISK_SQL} SELECT CAST(ceil(pct / 20) AS INTEGER) AS life_stage, {r("avg(p1)")} AS mean,
  {r("stddev_samp(p1)")} AS std, count(*) AS n FROM lp WHERE pct > 0 GROUP BY ceil(pct / 20)""")
def life_stage_risk(spark, sf):
    return rounded(thresholds.risk_by_life_stage(predictions(spark, sf)))


@query(f"""{_RISK_SQL} SELECT CAST(floor(pct / 10) * 10 AS INTEGER) AS life_bin, {r("avg(p1)")} AS mean,
  count(*) AS n FROM lp WHERE pct IS NOT NULL GROUP BY floor(pct / 10)""")
def life_decile_risk(spark, sf):
    return rounded(thresholds.risk_by_ten_percent(predictions(spark, sf)))


def _nearest_sql(which: str) -> str:
    """CTE ``k``: the five nearest others of every embedding that meets the condition."""
    return f"""m AS (SELECT vec_id AS id, embedding FROM embeddings WHERE {which}), d AS (
  SELECT a.id, b.id AS other, list_sum(list_transform(range(1, {WIDTH + 1}),
      lambda i: power(CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE), 2))) AS d
  FROM m a JOIN m b ON a.id <> b.id), k AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS rn FROM d QUALIFY rn <= 5)"""


def _vectors(spark, sf):
    return read_table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda v: v.cast("double")).alias("vec")
    )


@query(f"""WITH {_nearest_sql("true")} SELECT id, CAST(rn AS INTEGER) AS place, round(sqrt(d), 6) AS dist FROM k""")
def nearest_minority(spark, sf):
    """Distances to the five nearest vectors, the search behind oversampling."""
    near = neighbors.nearest_neighbors(_vectors(spark, sf).drop("label"), 5)
    return near.select("id", F.posexplode("nn").alias("at", "x")).select(
        "id", (F.col("at") + 1).alias("place"), F.round("x.dist", 6).alias("dist")
    )


def _digest_sql(*parts: str) -> str:
    text = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT)"


@query(f"""WITH {_nearest_sql("label < 2")}, n AS (
  SELECT count(*) FILTER (label < 2) AS few, count(*) FILTER (label >= 2) - count(*) FILTER (label < 2) AS need FROM embeddings), p AS (
  SELECT id, embedding, row_number() OVER (ORDER BY {_digest_sql("id", "42")}, id) AS pos FROM m), w AS (
  SELECT p.id, p.embedding, unnest(range(1, need // few + CASE WHEN pos <= need % few THEN 1 ELSE 0 END + 1)) AS draw FROM p, n), x AS (
  SELECT w.*, {_digest_sql("w.id", "draw", "44")} / power(2.0, 52) AS u, k.other AS partner
  FROM w JOIN k ON k.id = w.id AND k.rn = 1 + CAST(floor({_digest_sql("w.id", "draw", "43")} / power(2.0, 52) * 5) AS BIGINT)), v AS (
  SELECT x.id AS origin, CAST(draw AS INTEGER) AS draw, partner, u, list_transform(range(1, {WIDTH + 1}),
    lambda i: CAST(x.embedding[i] AS DOUBLE) + (CAST(m.embedding[i] AS DOUBLE) - CAST(x.embedding[i] AS DOUBLE)) * u) AS vec
  FROM x JOIN m ON m.id = x.partner)
  SELECT origin, draw, partner, {r("u")} AS position, {r("vec[1]")} AS first, {r(f"vec[{WIDTH}]")} AS last,
    {r("list_sum(vec)")} AS total FROM v""")
def smote_rows(spark, sf):
    """Every made row of the rarer class: the row and neighbour it lies between, where, and its values."""
    rows = _vectors(spark, sf).withColumn("label", (F.col("label") < 2).cast("int"))
    label, need = balance.minority(rows)
    made = balance.synthetic_rows(rows.where(F.col("label") == label).select("id", "vec"), need)
    return rounded(made.select(
        "origin", F.col("draw").cast("int").alias("draw"), "partner", "position", F.get("vec", 0).alias("first"),
        F.element_at("vec", -1).alias("last"), F.aggregate("vec", F.lit(0.0), lambda a, v: a + v).alias("total"),
    ))


@query("""WITH c AS (SELECT count(*) AS n, count(CASE WHEN label < 2 THEN 1 END) AS few FROM embeddings)
  SELECT 1 AS label, few AS given, greatest(n - 2 * few, 0) AS made FROM c
  UNION ALL SELECT 0, n - few, 0 FROM c""")
def smote_balance(spark, sf):
    """Rows per class before and after oversampling to parity."""
    rows = read_table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"),
        (F.col("label") < 2).cast("int").alias("label"),
        F.transform("embedding", lambda v: v.cast("double")).alias("vec"),
    )
    return balance.smote(rows).groupBy("label").agg(
        F.count_if(~F.col("synthetic")).alias("given"), F.count_if("synthetic").alias("made")
    )


@query("""WITH p AS (SELECT vec_id // 5 AS entity, vec_id % 5 AS seg, CAST(label >= 5 AS INTEGER) AS label
  FROM embeddings), e AS (SELECT entity, min_by(label, seg) AS label, count(*) AS k FROM p GROUP BY entity), c AS (
  SELECT label, sum(k) AS n FROM e GROUP BY label)
  SELECT label, CAST(n AS BIGINT) AS n, round(sum(n) OVER () / (2.0 * n) + 3.3e-11, 6) AS weight FROM c""")
def class_weights(spark, sf):
    weighted = balance.with_balanced_weight(labelled_vectors(spark, sf))
    return rounded(weighted.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.first("weight").alias("weight")
    ))


@query()
def pca2(spark, sf):
    rows, shares = projection.principal_components(labelled_vectors(spark, sf))
    return rows.select(
        "id", projection.class_name("label").alias("label_name"), "pc1", "pc2",
        F.lit(shares[0]).alias("explained_1"), F.lit(shares[1]).alias("explained_2"),
    )


@query()
def rf_importance(spark, sf):
    return importance.forest_importance(labelled_vectors(spark, sf), NAMES)


@query()
def permutation_importance(spark, sf):
    return importance.forest_permutation_importance(labelled_vectors(spark, sf), NAMES, repeats=10)


def _folded(spark, sf, k: int = 5):
    return cut_lineage(folds.with_folds(labelled_vectors(spark, sf), k))


@query()
def cv_scores(spark, sf):
    held_out = classifiers.cross_validated(_folded(spark, sf), "RandomForest", range(5))
    return classifiers.fold_metrics(cut_lineage(held_out))


@query()
def cv_logistic(spark, sf):
    held_out = classifiers.cross_validated(
        _folded(spark, sf), "LogisticRegression", range(5)
    )
    return evaluation.fold_summary(classifiers.fold_metrics(cut_lineage(held_out)), "auc")


@query()
def cv_boosted(spark, sf):
    held_out = classifiers.cross_validated(
        _folded(spark, sf), "Gradient Boosting", range(5)
    )
    return classifiers.overall_metrics(cut_lineage(held_out))


@query()
def model_vote(spark, sf):
    """Held-out forest predictions combined per entity."""
    held_out = classifiers.cross_validated(_folded(spark, sf), "Limited Random Forest", range(5))
    return voting.entity_votes(cut_lineage(held_out), "last_2_segments_confidence")


@query()
def subset_sweep(spark, sf):
    """Held-out AUC with the first 1, 3, 5, … features up to all, five folds, forests of 50 full trees."""
    rows = _folded(spark, sf)
    return importance.subset_performance(rows, range(WIDTH), range(5), range(1, WIDTH + 1, 2), numTrees=50)


@query()
def quick_feature_test(spark, sf):
    return importance.quick_feature_test(_folded(spark, sf), NAMES, range(5))


def sequence_rows(spark, sf):
    """Every segment's sequence at the length of a whole segment, so that points are frames and not padding."""
    made = resample.resampled_sequences(cleaned(spark, sf, LONG), LONG.segment_len)
    return made.select(F.xxhash64(*KEYS).alias("id"), *KEYS, "label", resample.flattened().alias("vec"))


@query()
def sequence_mlp(spark, sf):
    """Sequences of a segment's length, flattened, through the named net; scored on held-out entities."""
    rows = folds.with_folds(sequence_rows(spark, sf), 5)
    return classifiers.fold_metrics(cut_lineage(classifiers.cross_validated(rows, "MLP", range(5))))


@query()
def threshold_sweep(spark, sf):
    """Close-to-death prediction at every threshold: class counts, held-out AUC and metrics on the training rows."""
    from pathpulse.plans.predictor import compare_thresholds

    return compare_thresholds(segment_features(spark, sf))


_CHOICE_SQL = f"""{PRED_SQL}, t AS (SELECT unnest([1, 2, 3, 5]) AS threshold), lt AS (
  SELECT threshold, fold, p1, prediction, CAST(max(seg) OVER (PARTITION BY entity, threshold) - seg <= threshold AS INTEGER) AS y
  FROM pred, t), rk AS (
  SELECT *, rank() OVER f + (count(*) OVER (PARTITION BY threshold, fold, p1) - 1) / 2.0 AS fr,
    rank() OVER a + (count(*) OVER (PARTITION BY threshold, p1) - 1) / 2.0 AS ar FROM lt
  WINDOW f AS (PARTITION BY threshold, fold ORDER BY p1), a AS (PARTITION BY threshold ORDER BY p1)), fa AS (
  SELECT threshold, (sum(fr) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * sum(1 - y), 0) AS auc
  FROM rk GROUP BY threshold, fold), cv AS (SELECT threshold, avg(auc) AS cv_auc_mean FROM fa GROUP BY threshold), al AS (
  SELECT threshold, avg(y) AS positive_rate, (sum(ar) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * sum(1 - y), 0) AS test_auc,
    avg(CAST(prediction = y AS INTEGER)) AS test_accuracy, coalesce(2.0 * count(*) FILTER (prediction = 1 AND y = 1)
      / nullif(count(*) FILTER (prediction = 1) + sum(y), 0), 0) AS test_f1 FROM rk GROUP BY threshold), res AS (
  SELECT * FROM al JOIN cv USING (threshold))
  SELECT {{}} FROM res""".format(", ".join(
    f"(SELECT CAST(threshold AS INTEGER) FROM res {where} ORDER BY round({by}, 9) DESC NULLS LAST, threshold LIMIT 1) AS {name}"
    for name, by, where in (
        ("best_cv_auc", "cv_auc_mean", ""), ("best_test_auc", "test_auc", ""), ("best_accuracy", "test_accuracy", ""),
        ("best_f1", "test_f1", ""), ("best_balanced", "cv_auc_mean", "WHERE positive_rate BETWEEN 0.05 AND 0.15"),
    )
)) + " LIMIT 1"


@query(_CHOICE_SQL)
def threshold_choice(spark, sf):
    """The best threshold by every measure, for a score that is the same at all of them."""
    at = [1, 2, 3, 5]
    scored = predictions(spark, sf)
    away = group_extremes(scored, ["entity"], max_segment=F.max("seg"))
    near = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), (F.col("max_segment") - F.col("seg") <= t).cast("int").alias("label")) for t in at]))
    rows = cut_lineage(away.drop("label").select("*", near.alias("x")).select("fold", "p1", "prediction", "x.*"))
    cv = classifiers.fold_metrics(rows, ["threshold", "fold"]).groupBy("threshold").agg(F.avg("auc").alias("cv_auc_mean"))
    seen = classifiers.fold_metrics(rows, ["threshold"]).select(
        "threshold", F.col("auc").alias("test_auc"), F.col("accuracy").alias("test_accuracy"), F.col("f1").alias("test_f1")
    )
    rate = rows.groupBy("threshold").agg(F.avg("label").alias("positive_rate"))
    table = cv.join(seen, "threshold").join(rate, "threshold")
    return thresholds.best_thresholds(table.select("threshold", "positive_rate", *[F.round(c, 9).alias(c) for c in ("cv_auc_mean", "test_auc", "test_accuracy", "test_f1")]))


def published_rows(spark, sf):
    """The ten published features on segments that hold whole meandering windows, long enough for every one of the ten."""
    features = extract_features(cut_lineage(cleaned(spark, sf, LONG)), MEANDER_WINDOW)
    return features.select(
        F.xxhash64(*KEYS).alias("id"), *KEYS, "label", F.array(*VOTING_FEATURES).alias("vec")
    )


def _published(spark, sf):
    """Held-out boosting on the ten published features."""
    folded = folds.with_folds(cut_lineage(published_rows(spark, sf)), 5)
    return cut_lineage(classifiers.cross_validated(folded, "Gradient Boosting", range(5)))


@query()
def published_vote(spark, sf):
    """Entities decided by the last ten segments of boosted trees on ten features, weighted by confidence."""
    return voting.entity_votes(_published(spark, sf), "last_10_segments_confidence")


@query()
def published_group_vote(spark, sf):
    return voting.group_vote_summary(voting.group_votes(_published(spark, sf), "last_10_segments_confidence"))
