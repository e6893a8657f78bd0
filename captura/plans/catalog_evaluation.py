"""Classifier evaluation queries."""

from pyspark.sql import functions as F

from captura.functions.rounding import round_half_even
from captura.operators import evaluation as E
from captura.plans import views as V
from captura.plans.registry import query, r
from captura.plans.verify import run_experiments
from captura.sources.sinks import comparison_rows

_P = V.SQL_PREDICTIONS
_COUNTS = (
    "c AS (SELECT experiment_id, count(*) AS total_samples, count_if(y_true = 1 AND y_pred = 1) AS tp, count_if(y_true = 0 AND y_pred = 1) AS fp, "
    "count_if(y_true = 0 AND y_pred = 0) AS tn, count_if(y_true = 1 AND y_pred = 0) AS fn FROM pred GROUP BY 1), "
    "m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0e0 END AS pa, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0e0 END AS ra, "
    "CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0e0 END AS pr, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0e0 END AS rr FROM c), "
    "f AS (SELECT *, CASE WHEN pa + ra > 0 THEN 2e0 * (pa * ra) / (pa + ra) ELSE 0e0 END AS fa, CASE WHEN pr + rr > 0 THEN 2e0 * (pr * rr) / (pr + rr) ELSE 0e0 END AS fr FROM m)"
)
_AUC = (
    "s AS (SELECT experiment_id, y_score, count_if(y_true = 1) AS pos, count_if(y_true = 0) AS neg FROM pred GROUP BY 1, 2), "
    "k AS (SELECT *, sum(neg) OVER (PARTITION BY experiment_id ORDER BY y_score) AS cn FROM s), "
    f"auc AS (SELECT experiment_id, CASE WHEN sum(pos) * sum(neg) > 0 THEN {r('sum(pos * (cn - neg + 0.5e0 * neg)) / (sum(pos) * sum(neg))')} END AS roc_auc FROM k GROUP BY 1)"
)


def _metric_columns(alias: str = "f") -> str:
    return (
        f"{r('(tp + tn) / total_samples')} AS accuracy, {r('pa')} AS precision, {r('ra')} AS recall, {r('fa')} AS f1_score, "
        f"{r('CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0e0 END')} AS false_positive_rate, {r('CASE WHEN fn + tp > 0 THEN fn / (fn + tp) ELSE 0e0 END')} AS false_negative_rate"
    )


@query(
    "a12_a13_binary_metrics",
    f"WITH {_P}, {_COUNTS}, {_AUC} SELECT f.experiment_id, total_samples, tp, fp, tn, fn, {_metric_columns()}, roc_auc FROM f JOIN auc ON f.experiment_id = auc.experiment_id",
)
def metrics(spark, sf_dir):
    return E.binary_metrics(V.predictions(spark, sf_dir), ["experiment_id"])


@query(
    "a14_class_metrics",
    f"WITH {_P}, {_COUNTS} SELECT experiment_id, total_samples, {r('(tp + tn) / total_samples')} AS accuracy, {r('(pr + pa) / 2e0')} AS macro_precision, "
    f"{r('(rr + ra) / 2e0')} AS macro_recall, {r('(fr + fa) / 2e0')} AS macro_f1, {r('pa')} AS precision_attacked, {r('ra')} AS recall_attacked, {r('fa')} AS f1_attacked, "
    f"{r('pr')} AS precision_real, {r('rr')} AS recall_real, {r('fr')} AS f1_real FROM f",
)
def class_metrics(spark, sf_dir):
    return E.class_metrics(V.predictions(spark, sf_dir), ["experiment_id"])


_SWEEP = (
    "cuts AS (SELECT 0.05e0 + 0.05e0 * i AS t FROM range(0, 19) x(i)), "
    "swept AS (SELECT experiment_id, t, count_if(y_true = 1 AND NOT p_real >= t) AS tp, count_if(y_true = 0 AND NOT p_real >= t) AS fp, "
    "count_if(y_true = 0 AND p_real >= t) AS tn, count_if(y_true = 1 AND p_real >= t) AS fn, count(*) AS total_samples FROM pred, cuts GROUP BY 1, 2), "
    "m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0e0 END AS pa, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0e0 END AS ra, "
    "CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0e0 END AS pr, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0e0 END AS rr FROM swept), "
    "f AS (SELECT *, CASE WHEN pa + ra > 0 THEN 2e0 * (pa * ra) / (pa + ra) ELSE 0e0 END AS fa, CASE WHEN pr + rr > 0 THEN 2e0 * (pr * rr) / (pr + rr) ELSE 0e0 END AS fr FROM m), "
    f"sweep AS (SELECT experiment_id, {r('t', 2)} AS threshold, {r('(tp + tn) / total_samples')} AS accuracy, {r('pr')} AS prec_real, {r('rr')} AS rec_real, {r('fr')} AS f1_real, "
    f"{r('pa')} AS prec_att, {r('ra')} AS rec_att, {r('fa')} AS f1_att, {r('(fr + fa) / 2e0')} AS macro_f1, tn, fp, fn, tp FROM f)"
)


@query("a15_threshold_sweep", f"WITH {_P}, {_SWEEP} SELECT * FROM sweep")
def sweep(spark, sf_dir):
    return E.threshold_sweep(V.predictions(spark, sf_dir), ["experiment_id"])


@query(
    "a16_best_threshold",
    f"WITH {_P}, {_SWEEP} SELECT experiment_id, threshold, macro_f1 FROM sweep QUALIFY row_number() OVER (PARTITION BY experiment_id ORDER BY macro_f1 DESC, threshold) = 1",
)
def best(spark, sf_dir):
    swept = E.threshold_sweep(V.predictions(spark, sf_dir), ["experiment_id"])
    return E.best_threshold(swept, ["experiment_id"]).select("experiment_id", "threshold", "macro_f1")


@query(
    "a17_score_statistics",
    f"WITH {_P} SELECT experiment_id, y_true, count(*) AS n, "
    + ", ".join(
        f"round({e}, 6) AS {a}"
        for a, e in {
            "min": "min(y_score)", "max": "max(y_score)", "mean": "avg(y_score)", "std": "stddev_pop(y_score)", "p10": "quantile_cont(y_score, 0.1)",
            "p25": "quantile_cont(y_score, 0.25)", "median": "quantile_cont(y_score, 0.5)", "p75": "quantile_cont(y_score, 0.75)", "p90": "quantile_cont(y_score, 0.9)",
        }.items()
    )
    + " FROM pred GROUP BY 1, 2",
)
def stats(spark, sf_dir):
    rows = E.score_stats(V.predictions(spark, sf_dir), ["experiment_id", "y_true"])
    numbers = ["min", "max", "mean", "std", "p10", "p25", "median", "p75", "p90"]
    return rows.select("experiment_id", "y_true", "n", *[F.round(c, 6).alias(c) for c in numbers])


@query(
    "a18_score_histogram",
    f"WITH {_P}, span AS (SELECT experiment_id, min(y_score) AS lo, max(y_score) AS hi, count(*) AS total FROM pred GROUP BY 1), "
    "w AS (SELECT experiment_id, CASE WHEN hi = lo THEN lo - 0.5e0 ELSE lo END AS lo, (CASE WHEN hi = lo THEN hi + 0.5e0 ELSE hi END - CASE WHEN hi = lo THEN lo - 0.5e0 ELSE lo END) / 30e0 AS width, total FROM span) "
    "SELECT p.experiment_id, CAST(least(29, floor((y_score - lo) / width)) AS INT) AS bin, count(*) AS n, round(count(*) / (any_value(total) * any_value(width)), 6) AS density "
    "FROM pred p JOIN w ON p.experiment_id = w.experiment_id GROUP BY 1, 2",
)
def histogram(spark, sf_dir):
    rows = E.score_histogram(V.predictions(spark, sf_dir), ["experiment_id"])
    return rows.select("experiment_id", "bin", "n", F.round("density", 6).alias("density"))


@query(
    "w12_roc_curve",
    f"WITH {_P}, s AS (SELECT experiment_id, y_score, count_if(y_true = 1) AS pos, count_if(y_true = 0) AS neg FROM pred GROUP BY 1, 2) "
    "SELECT experiment_id, y_score AS threshold, round(sum(neg) OVER w / nullif(sum(neg) OVER g, 0), 6) AS fpr, round(sum(pos) OVER w / nullif(sum(pos) OVER g, 0), 6) AS tpr FROM s "
    "WINDOW w AS (PARTITION BY experiment_id ORDER BY y_score DESC), g AS (PARTITION BY experiment_id) "
    "UNION ALL SELECT DISTINCT experiment_id, CAST(NULL AS DOUBLE), 0e0, 0e0 FROM pred",
)
def curve(spark, sf_dir):
    rows = E.roc_curve(V.predictions(spark, sf_dir), ["experiment_id"])
    return rows.select("experiment_id", "threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query(
    "s09_comparison_table",
    f"WITH {_P}, {_COUNTS}, {_AUC} SELECT f.experiment_id AS \"Experiment\", 'lang ' || f.experiment_id AS \"Pipeline Configuration\", CAST(total_samples AS VARCHAR) AS \"Samples Evaluated\", "
    f"format('{{:.4f}}', {r('(tp + tn) / total_samples')}) AS \"Accuracy\", format('{{:.4f}}', {r('fa')}) AS \"F1-Score\", coalesce(format('{{:.4f}}', roc_auc), 'N/A') AS \"ROC-AUC\" "
    "FROM f JOIN auc ON f.experiment_id = auc.experiment_id",
)
def comparison(spark, sf_dir):
    rows = E.binary_metrics(V.predictions(spark, sf_dir), ["experiment_id"])
    named = rows.withColumn("experiment_name", F.concat(F.lit("lang "), F.col("experiment_id")))
    table = comparison_rows(named)
    return table.select("Experiment", "Pipeline Configuration", "Samples Evaluated", "Accuracy", "F1-Score", "ROC-AUC")


@query(
    "w11_best_epoch",
    "WITH h AS (SELECT user_id AS run, event_id AS epoch, CAST(floor(value) AS BIGINT) % 7 / 7e0 AS val_f1 FROM events) "
    "SELECT run, epoch, val_f1 FROM h QUALIFY row_number() OVER (PARTITION BY run ORDER BY val_f1 DESC, epoch DESC) = 1",
)
def epoch(spark, sf_dir):
    history = V.table(spark, sf_dir, "events").selectExpr(
        "user_id AS run", "event_id AS epoch", "CAST(floor(value) AS BIGINT) % 7 / 7e0 AS val_f1"
    )
    return E.best_epoch(history, ["run"])


@query(
    "a19_group_sequences",
    f"WITH {V.SQL_SAMPLES} SELECT doc_id, path, row_number() OVER (PARTITION BY doc_id ORDER BY regexp_extract(path, '([^/]+)\\.png$', 1), path) - 1 AS seq_no, "
    "first_value(label) OVER (PARTITION BY doc_id ORDER BY pos) AS label, count(*) OVER (PARTITION BY doc_id) AS frame_count FROM samples",
)
def sequences(spark, sf_dir):
    return E.group_sequences(V.samples(spark, sf_dir)).select("doc_id", "path", "seq_no", "label", "frame_count")


@query(
    "a29_class_weights",
    f"WITH {V.SQL_SAMPLES}, n AS (SELECT count_if(label = 0) AS n_real, count_if(label = 1) AS n_attacked FROM samples) "
    "SELECT n_real, n_attacked, round(CASE WHEN n_real > 0 AND n_attacked > 0 AND n_real <> n_attacked THEN (n_real + n_attacked) / (2e0 * n_real) END, 6) AS weight_real, "
    "round(CASE WHEN n_real > 0 AND n_attacked > 0 AND n_real <> n_attacked THEN (n_real + n_attacked) / (2e0 * n_attacked) END, 6) AS weight_attacked FROM n",
)
def weights(spark, sf_dir):
    rows = E.class_weights(V.samples(spark, sf_dir))
    return rows.select(
        "n_real", "n_attacked", F.round("weight_real", 6).alias("weight_real"), F.round("weight_attacked", 6).alias("weight_attacked")
    )


def experiment_inputs(spark, sf_dir):
    """Frame predictions from samples, and sequence scores per source from the same samples."""
    rows = V.samples(spark, sf_dir)
    integrity = (F.col("n_chars") % 101) / 101.0
    frames = rows.select("doc_id", "label", integrity.alias("integrity_score"))
    units = F.sum(F.col("n_chars") % 101) / (101.0 * F.count(F.lit(1)))
    per_doc = rows.groupBy("doc_id").agg(F.min_by("label", "pos").alias("label"), units.alias("m"), F.count(F.lit(1)).alias("n"))
    name = F.length("doc_id") % 5
    sequences_ = per_doc.select(
        "doc_id",
        "label",
        F.col("m").alias("visual_integrity"),
        F.when(name != 0, (F.col("n") % 13) / 13.0).alias("temporal_consistency"),
        ((F.col("n") % 7) / 7.0).alias("ocr_confidence"),
        ((F.col("n") % 11) / 11.0).alias("text_consistency"),
    )
    return frames, sequences_


_EXPERIMENTS = (
    f"{V.SQL_SAMPLES}, docs AS (SELECT doc_id, arg_min(label, pos) AS label, sum(n_chars % 101) / (101e0 * count(*)) AS v, count(*) AS n FROM samples GROUP BY 1), "
    "seqs AS (SELECT doc_id, label, v, CASE WHEN length(doc_id) % 5 <> 0 THEN (n % 13) / 13e0 ELSE 0e0 END AS t, (n % 7) / 7e0 AS o, (n % 11) / 11e0 AS x FROM docs), "
    f"scored AS (SELECT 'experiment_a' AS experiment_id, label AS y_true, (n_chars % 101) / 101e0 AS s FROM samples UNION ALL "
    "SELECT 'experiment_b', label, (0.4e0 / 0.7e0) * v + (0.3e0 / 0.7e0) * t FROM seqs UNION ALL "
    f"SELECT 'experiment_c', label, {r('0.4e0 * v + 0.3e0 * t + 0.15e0 * o + 0.15e0 * x')} FROM seqs), "
    "pred AS (SELECT experiment_id, y_true, 1e0 - s AS y_score, CASE WHEN 1e0 - s >= 0.5e0 THEN 1 ELSE 0 END AS y_pred FROM scored)"
)


@query(
    "e04_experiments",
    f"WITH {_EXPERIMENTS}, {_COUNTS} SELECT experiment_id, total_samples, tp, fp, tn, fn, {_metric_columns()} FROM f",
)
def experiments(spark, sf_dir):
    frames, sequences_ = experiment_inputs(spark, sf_dir)
    return run_experiments(frames, sequences_).drop("roc_auc")


@query(
    "x14_visual_temporal_score",
    f"WITH {_EXPERIMENTS} SELECT doc_id, {r('(0.4e0 / 0.7e0) * v + (0.3e0 / 0.7e0) * t')} AS combined FROM seqs",
)
def combined(spark, sf_dir):
    from captura.functions.scores import combine_visual_temporal

    _, sequences_ = experiment_inputs(spark, sf_dir)
    temporal = F.coalesce("temporal_consistency", F.lit(0.0))
    score = combine_visual_temporal(F.col("visual_integrity"), temporal)
    return sequences_.select("doc_id", round_half_even(score).alias("combined"))
