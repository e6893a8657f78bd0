"""Writers with fixed column orders."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------
MANIFEST_COLUMNS = [
    "frame_id", "crop_path", "split", "label", "document_id", "clip_id",
    "attack_type", "frame_filename", "source_frame_path", "localization_method",
    "confidence", "gate_reason", "iou_with_gt", "corner_error_with_gt",
    "latency_ms", "width", "height",
]
FAILURE_COLUMNS = ["frame_id", "source_path", "document_id", "clip_id", "attack_type", "split", "label", "reason"]
PRIORITY_COLUMNS = ["frame_id", "document_id", "clip_id", "attack_type", "label", "split", "crop_path"]
COMPARISON_COLUMNS = {
    "Experiment": "experiment_id",
    "Pipeline Configuration": "experiment_name",
    "Samples Evaluated": "total_samples",
    "Accuracy": "accuracy",
    "Precision": "precision",
    "Recall": "recall",
    "F1-Score": "f1_score",
    "ROC-AUC": "roc_auc",
    "FPR (False Positive Rate)": "false_positive_rate",
    "FNR (False Negative Rate)": "false_negative_rate",
    "TP": "tp",
    "FP": "fp",
    "TN": "tn",
    "FN": "fn",
}
# --------------------------------------------------------------------------

_FOUR_DIGITS = {"accuracy", "precision", "recall", "f1_score", "false_positive_rate", "false_negative_rate"}


def priority_first(df: DataFrame, priority=tuple(PRIORITY_COLUMNS)) -> DataFrame:
    """Priority columns first, the others in their old order."""
    return df.select(*priority, *[c for c in df.columns if c not in priority])


def write_csv(df: DataFrame, path: str, columns: list | None = None, mode: str = "errorifexists") -> None:
    """CSV directory with a header; missing values stay blank."""
    chosen = df.select(*columns) if columns else df
    chosen.write.mode(mode).option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def comparison_rows(metrics: DataFrame) -> DataFrame:
    """Experiment comparison as text: four decimals, ``N/A`` for an undefined ROC-AUC."""
    four = lambda c: F.format_string("%.4f", F.col(c))
    out = []
    for title, source in COMPARISON_COLUMNS.items():
        if source == "roc_auc":
            value = F.when(F.col(source).isNull(), F.lit("N/A")).otherwise(four(source))
        elif source in _FOUR_DIGITS:
            value = four(source)
        else:
            value = F.col(source).cast("string")
        out.append(value.alias(title))
    return metrics.select(*out)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_samples(samples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Sample table partitioned by split and class, so later reads prune to what they need."""
    samples.repartition("split", "label", F.pmod(F.xxhash64(*samples.columns), F.lit(64))).write.mode(mode).partitionBy(
        "split", "label"
    ).parquet(path)
