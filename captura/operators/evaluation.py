"""Classifier evaluation: counts, curves, sweeps and score statistics per experiment.

Predictions are ``y_true, y_pred, y_score`` with positive class 1 (ATTACKED).
Every operator first reduces to counts per experiment, label and score.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captura.functions.paths import stem
from captura.functions.rounding import ratio_or_zero, round_half_even
from captura.operators.grouping import null_safe, percentiles, positions, running_sum, text_bucket, unit_bucket


def _harmonic(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2.0 * (p * r) / (p + r)).otherwise(F.lit(0.0))


def confusion_counts(pred: DataFrame, by) -> DataFrame:
    hit = lambda t, p: F.count_if((F.col("y_true") == t) & (F.col("y_pred") == p))
    return pred.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_samples"),
        hit(1, 1).alias("tp"),
        hit(0, 1).alias("fp"),
        hit(0, 0).alias("tn"),
        hit(1, 0).alias("fn"),
    )


def binary_metrics(pred: DataFrame, by=(), with_auc: bool = True) -> DataFrame:
    """Accuracy, precision, recall, F1, FPR and FNR; zero denominators give 0, no rows give zeros."""
    by = list(by)
    counts = confusion_counts(pred, by)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    precision, recall = ratio_or_zero(tp, tp + fp), ratio_or_zero(tp, tp + fn)
    out = counts.select(
        *by,
        "total_samples",
        "tp",
        "fp",
        "tn",
        "fn",
        round_half_even((tp + tn) / F.greatest(F.lit(1), F.col("total_samples"))).alias("accuracy"),
        round_half_even(precision).alias("precision"),
        round_half_even(recall).alias("recall"),
        round_half_even(_harmonic(precision, recall)).alias("f1_score"),
        round_half_even(ratio_or_zero(fp, fp + tn)).alias("false_positive_rate"),
        round_half_even(ratio_or_zero(fn, fn + tp)).alias("false_negative_rate"),
    )
    if not with_auc:
        return out
    auc = roc_auc(pred, by)
    if by:
        return null_safe(out, auc, by)
    # One row on both sides: an aggregate without grouping always returns exactly one.
    return out.withColumn("__one", F.lit(1)).join(auc.withColumn("__one", F.lit(1)), "__one", "left").drop("__one")


def _score_counts(pred: DataFrame, by) -> DataFrame:
    return pred.groupBy(*by, "y_score").agg(
        F.count_if(F.col("y_true") == 1).alias("pos"), F.count_if(F.col("y_true") == 0).alias("neg")
    )


def roc_auc(pred: DataFrame, by=(), lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Tie-aware rank statistic over distinct scores; NULL when a class is missing."""
    by = list(by)
    ranked = running_sum(
        _score_counts(pred, by), by, ["y_score"], {"__neg": "neg"}, unit_bucket("y_score", lo=lo, hi=hi)
    )
    below = F.col("__neg") - F.col("neg")
    wins = F.sum(F.col("pos") * (below + 0.5 * F.col("neg")))
    pairs = F.sum("pos") * F.sum("neg")
    return ranked.groupBy(*by).agg(F.when(pairs > 0, round_half_even(wins / pairs)).alias("roc_auc"))


def roc_curve(pred: DataFrame, by=(), lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """False and true positive rate at every distinct score, plus the origin with a NULL threshold."""
    by = list(by)
    counts = _score_counts(pred, by).withColumn("__down", -F.col("y_score"))
    ranked = running_sum(
        counts,
        by,
        ["__down"],
        {"cum_pos": "pos", "cum_neg": "neg"},
        unit_bucket("__down", lo=-hi, hi=-lo),
        {"all_pos": "pos", "all_neg": "neg"},
    )
    rate = lambda c, t: F.when(F.col(t) > 0, F.col(c) / F.col(t))
    points = ranked.select(
        *by, F.col("y_score").alias("threshold"), rate("cum_neg", "all_neg").alias("fpr"), rate("cum_pos", "all_pos").alias("tpr")
    )
    origin = pred.select(*by).distinct() if by else pred.groupBy().count().drop("count")
    start = origin.select(*by, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(start)


def _class_block(tp: Column, fp: Column, fn: Column):
    p, r = ratio_or_zero(tp, tp + fp), ratio_or_zero(tp, tp + fn)
    return p, r, _harmonic(p, r)


def _both_classes():
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return _class_block(tn, fn, fp), _class_block(tp, fp, fn)


def class_metrics(pred: DataFrame, by=()) -> DataFrame:
    """Per-class and macro precision, recall and F1."""
    (pr, rr, fr), (pa, ra, fa) = _both_classes()
    counts = confusion_counts(pred, list(by))
    return counts.select(
        *by,
        "total_samples",
        round_half_even((F.col("tp") + F.col("tn")) / F.col("total_samples")).alias("accuracy"),
        round_half_even((pr + pa) / 2.0).alias("macro_precision"),
        round_half_even((rr + ra) / 2.0).alias("macro_recall"),
        round_half_even((fr + fa) / 2.0).alias("macro_f1"),
        round_half_even(pa).alias("precision_attacked"),
        round_half_even(ra).alias("recall_attacked"),
        round_half_even(fa).alias("f1_attacked"),
        round_half_even(pr).alias("precision_real"),
        round_half_even(rr).alias("recall_real"),
        round_half_even(fr).alias("f1_real"),
    )


def default_thresholds() -> list:
    return [0.05 + 0.05 * i for i in range(19)]


def threshold_sweep(pred: DataFrame, by=(), thresholds=None, p_real: str = "p_real") -> DataFrame:
    """Metrics at every threshold of the rule ``p_real >= t`` means REAL.

    A row contributes once, to the number of thresholds it reaches. The sweep is a
    running sum over those few buckets.
    """
    by = list(by)
    cuts = sorted(thresholds or default_thresholds())
    reached = sum(((F.col(p_real) >= F.lit(t)).cast("int") for t in cuts), F.lit(0))
    counts = (
        pred.withColumn("__reached", reached)
        .groupBy(*by, "__reached")
        .agg(F.count_if(F.col("y_true") == 1).alias("pos"), F.count_if(F.col("y_true") == 0).alias("neg"))
    )
    # At threshold i (1-based) a row is predicted REAL when it reaches at least i cuts.
    per_group = counts.groupBy(*by).agg(
        F.sum("pos").alias("all_pos"),
        F.sum("neg").alias("all_neg"),
        *[F.sum(F.when(F.col("__reached") >= i + 1, F.col("pos")).otherwise(0)).alias(f"__p{i}") for i in range(len(cuts))],
        *[F.sum(F.when(F.col("__reached") >= i + 1, F.col("neg")).otherwise(0)).alias(f"__n{i}") for i in range(len(cuts))],
    )
    rows = F.array(
        *[
            F.struct(F.lit(t).alias("t"), F.col(f"__p{i}").alias("fn"), F.col(f"__n{i}").alias("tn"))
            for i, t in enumerate(cuts)
        ]
    )
    swept = per_group.select(*by, "all_pos", "all_neg", F.explode(rows).alias("r")).select(
        *by,
        round_half_even(F.col("r.t"), 2).alias("threshold"),
        F.col("r.tn").alias("tn"),
        (F.col("all_neg") - F.col("r.tn")).alias("fp"),
        F.col("r.fn").alias("fn"),
        (F.col("all_pos") - F.col("r.fn")).alias("tp"),
    )
    (pr, rr, fr), (pa, ra, fa) = _both_classes()
    total = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    return swept.select(
        *by,
        "threshold",
        round_half_even((F.col("tp") + F.col("tn")) / total).alias("accuracy"),
        round_half_even(pr).alias("prec_real"),
        round_half_even(rr).alias("rec_real"),
        round_half_even(fr).alias("f1_real"),
        round_half_even(pa).alias("prec_att"),
        round_half_even(ra).alias("rec_att"),
        round_half_even(fa).alias("f1_att"),
        round_half_even((fr + fa) / 2.0).alias("macro_f1"),
        "tn",
        "fp",
        "fn",
        "tp",
    )


def best_threshold(sweep: DataFrame, by=()) -> DataFrame:
    """Row with the highest macro F1; the lowest threshold wins ties."""
    others = [c for c in sweep.columns if c not in by]
    best = sweep.groupBy(*by).agg(
        F.min_by(F.struct(*others), F.struct(-F.col("macro_f1"), F.col("threshold"))).alias("r")
    )
    return best.select(*by, "r.*")


def score_stats(pred: DataFrame, by=(), value: str = "y_score", lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Min, max, mean, population deviation and percentiles of a score per group."""
    by = list(by)
    plain = pred.groupBy(*by).agg(
        F.count(value).alias("n"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
    )
    wanted = {"p10": 0.10, "p25": 0.25, "median": 0.50, "p75": 0.75, "p90": 0.90}
    ranks = percentiles(pred, by, value, wanted, lo, hi)
    if by:
        return null_safe(plain, ranks, by)
    return plain.withColumn("__one", F.lit(1)).join(ranks.withColumn("__one", F.lit(1)), "__one").drop("__one")


def score_histogram(pred: DataFrame, by=(), value: str = "y_score", bins: int = 30) -> DataFrame:
    """Counts and density in equal bins between the group's extremes; the last bin is closed.

    Scores are counted per distinct value first, so the second look at the data is small.
    """
    by = list(by)
    counts = pred.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    span = counts.groupBy(*by).agg(
        F.min(value).alias("lo"), F.max(value).alias("hi"), F.sum("n").alias("total")
    )
    joined = counts.join(span, by) if by else counts.withColumn("__k", F.lit(1)).join(span.withColumn("__k", F.lit(1)), "__k").drop("__k")
    # A constant group gets a unit-wide range centred on its value.
    flat = F.col("hi") == F.col("lo")
    lo = F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo"))
    hi = F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi"))
    spread = joined.withColumns({"lo": lo, "width": (hi - lo) / F.lit(float(bins))})
    index = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / F.col("width"))).cast("int")
    return (
        spread.withColumn("bin", index)
        .groupBy(*by, "bin", "lo", "width", "total")
        .agg(F.sum("n").alias("n"))
        .select(
            *by,
            "bin",
            "n",
            (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_start"),
            (F.col("n") / (F.col("total") * F.col("width"))).alias("density"),
        )
    )


def group_sequences(samples: DataFrame) -> DataFrame:
    """Number the frames of every document in frame-name order, with the document's label.

    ``samples`` is ``doc_id, label, class_name, path, pos``, where ``pos`` is the
    input position; the label seen first wins. The result stays in long form, and
    ranking is cut into name ranges, so a document may hold any number of frames.
    """
    named = samples.select("doc_id", stem(F.col("path")).alias("frame_id"), "path", "label", "class_name", "pos")
    heads = named.groupBy("doc_id").agg(
        F.min_by(F.struct("label", "class_name"), "pos").alias("head"),
        F.min("frame_id").alias("__lo"),
        F.max("frame_id").alias("__hi"),
    )
    joined = named.select("doc_id", "frame_id", "path").join(heads, "doc_id")
    ranked = positions(
        joined,
        ["doc_id"],
        ["frame_id", "path"],
        text_bucket(F.col("frame_id"), F.col("__lo"), F.col("__hi")),
        "seq_no",
        "frame_count",
    )
    return ranked.select("doc_id", "seq_no", "frame_id", "path", "head.label", "head.class_name", "frame_count")


def class_weights(samples: DataFrame) -> DataFrame:
    """Balanced weights ``n / (2 n_c)``; NULL unless both classes exist and differ in size."""
    real, attacked = F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)
    n = samples.agg(real.alias("n_real"), attacked.alias("n_attacked"))
    usable = (F.col("n_real") > 0) & (F.col("n_attacked") > 0) & (F.col("n_real") != F.col("n_attacked"))
    total = F.col("n_real") + F.col("n_attacked")
    return n.select(
        "n_real",
        "n_attacked",
        F.when(usable, total / (2.0 * F.col("n_real"))).alias("weight_real"),
        F.when(usable, total / (2.0 * F.col("n_attacked"))).alias("weight_attacked"),
    )


def best_epoch(history: DataFrame, by=()) -> DataFrame:
    """Epoch with the highest validation F1; the last one wins ties."""
    others = [c for c in history.columns if c not in by]
    best = history.groupBy(*by).agg(F.max_by(F.struct(*others), F.struct("val_f1", "epoch")).alias("r"))
    return best.select(*by, "r.*")
