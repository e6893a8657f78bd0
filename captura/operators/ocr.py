"""Recognized lines to frame text, and frame text to fields."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captura.functions.rounding import mean_fixed, to_fixed
from captura.functions.text import KEY_FIELDS, VALIDATORS, extract_field, strip

MIN_CONFIDENCE = 0.6


def confident_lines(ocr_lines: DataFrame, min_conf: float = MIN_CONFIDENCE) -> DataFrame:
    """Lines at or above the confidence floor, stripped and rounded."""
    kept = ocr_lines.filter(F.col("confidence") >= min_conf)
    return kept.withColumns({"text": strip(F.col("text")), "confidence": F.rint(F.col("confidence") * 10000.0) / 10000.0})


def frame_confidence(ocr_lines: DataFrame, frames: DataFrame, min_conf: float = MIN_CONFIDENCE, keys=("frame_id",)) -> DataFrame:
    """Mean rounded line confidence and line count of every readable frame; 0.0 without lines."""
    lines = confident_lines(ocr_lines, min_conf)
    per_frame = lines.groupBy(*keys).agg(
        mean_fixed(to_fixed(F.col("confidence"))).alias("average_confidence"),
        F.count(F.lit(1)).alias("line_count"),
    )
    return frames.join(per_frame, list(keys), "left").fillna(0.0, ["average_confidence"]).fillna(0, ["line_count"])


def frame_text(ocr_lines: DataFrame, frames: DataFrame, min_conf: float = MIN_CONFIDENCE, keys=("frame_id",)) -> DataFrame:
    """:func:`frame_confidence` plus the text of the frame, lines joined in line order.

    One frame is one image, so the text of a frame is the unit that pattern
    matching needs; only lines of the same image meet in a task.
    """
    lines = confident_lines(ocr_lines, min_conf)
    per_frame = lines.groupBy(*keys).agg(
        mean_fixed(to_fixed(F.col("confidence"))).alias("average_confidence"),
        F.count(F.lit(1)).alias("line_count"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda s: s["text"]), "\n"
        ).alias("full_text"),
    )
    joined = frames.join(per_frame, list(keys), "left")
    return joined.fillna(0.0, ["average_confidence"]).fillna(0, ["line_count"]).fillna("", ["full_text"])


def ocr_run_summary(frame_rows: DataFrame) -> DataFrame:
    """Frames with at least one line, frames without, and the success rate."""
    good = F.count_if(F.col("line_count") > 0)
    return frame_rows.agg(
        F.count(F.lit(1)).alias("frames"),
        good.alias("successful_frames"),
        F.count_if(F.col("line_count") == 0).alias("failed_frames"),
        F.when(F.count(F.lit(1)) > 0, F.rint(good / F.count(F.lit(1)) * 10000.0) / 10000.0)
        .otherwise(F.lit(0.0))
        .alias("success_rate"),
    )


def video_confidence(frame_rows: DataFrame, key: str = "video_id") -> DataFrame:
    """Mean frame confidence of a capture; frames without text count as 0.0."""
    return frame_rows.groupBy(key).agg(mean_fixed(to_fixed(F.col("average_confidence"))).alias("ocr_confidence"))


def parse_fields(df: DataFrame, text: str = "full_text", lines: str | None = None, patterns: dict | None = None) -> DataFrame:
    """Add the four fields with presence and validity structs.

    ``lines`` names a column with the line texts joined by newlines; it is
    searched after ``text``.
    """
    searched = F.coalesce(F.col(text), F.lit(""))
    if lines is not None:
        searched = F.when(
            F.coalesce(F.length(lines), F.lit(0)) > 0, F.concat_ws("\n", searched, F.col(lines))
        ).otherwise(searched)
    extracted = df.withColumn("__text", searched).withColumns(
        {field: extract_field(F.col("__text"), field, patterns) for field in KEY_FIELDS}
    )
    return extracted.withColumns(
        {
            "field_presence": F.struct(*[F.col(f).isNotNull().alias(f) for f in KEY_FIELDS]),
            "format_validity": F.struct(*[VALIDATORS[f](F.col(f)).alias(f) for f in KEY_FIELDS]),
        }
    ).drop("__text")
