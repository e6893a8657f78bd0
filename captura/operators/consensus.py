"""Cross-frame agreement of extracted fields."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captura.functions.rounding import mean_fixed, round_half_even, to_fixed
from captura.functions.text import KEY_FIELDS, strip
from captura.operators.grouping import null_safe
from captura.operators.similarity import mean_ordered_similarity

STABLE = 0.85
PROBLEMATIC = 0.70


def field_values(extractions: DataFrame, fields=KEY_FIELDS, key: str = "video_id", order: str = "frame_idx") -> DataFrame:
    """Long form: one row per frame and field, blank values as NULL."""
    validity = "format_validity" in extractions.columns
    entries = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                F.when(strip(F.col(f)) != "", F.col(f)).alias("value"),
                (F.col(f"format_validity.{f}") if validity else F.lit(False)).alias("valid"),
            )
            for f in fields
        ]
    )
    return extractions.select(key, order, F.explode(entries).alias("e")).select(key, order, "e.field", "e.value", "e.valid")


def consensus_of(long: DataFrame, key: str = "video_id", order: str = "frame_idx") -> DataFrame:
    """Majority value per capture and field; the value seen first wins ties.

    Two levels of counting: the hot part of a skewed capture collapses to its
    distinct values before they meet.
    """
    tallies = long.groupBy(key, "field", "value").agg(
        F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen"), F.bool_or("valid").alias("valid")
    )
    present = F.col("value").isNotNull()
    best = F.min_by("value", F.when(present, F.struct(-F.col("n"), F.col("first_seen"), F.col("value"))))
    return tallies.groupBy(key, "field").agg(
        best.alias("consensus"),
        F.coalesce(F.max(F.when(present, F.col("n"))), F.lit(0)).alias("frequency"),
        F.bool_or(present).alias("present"),
        (F.bool_or("valid") & F.bool_or(present)).alias("valid"),
        F.sum("n").alias("frames_analyzed"),
    )


def field_consensus(
    extractions: DataFrame,
    fields=KEY_FIELDS,
    key: str = "video_id",
    order: str = "frame_idx",
    metric: str = "ratio",
    **tuning,
) -> DataFrame:
    """One row per capture and field: consensus, frequency, presence, validity, consistency."""
    long = field_values(extractions, fields, key, order)
    agreed = consensus_of(long, key, order)
    pairwise = mean_ordered_similarity(long, [key, "field"], order, "value", metric, **tuning)
    joined = null_safe(agreed, pairwise, [key, "field"])
    return joined.select(
        key,
        "field",
        "consensus",
        "frequency",
        "present",
        "valid",
        F.coalesce(round_half_even(F.col("mean_similarity")), F.lit(0.0)).alias("consistency"),
        round_half_even(F.col("frequency") / F.col("frames_analyzed")).alias("presence_rate"),
        "frames_analyzed",
    )


def summarize_fields(per_field: DataFrame, fields=KEY_FIELDS, key: str = "video_id") -> DataFrame:
    """One row per capture with the consensus values, global consistency and field lists."""

    def of(field, column):
        return F.max(F.when(F.col("field") == field, F.col(column)))

    listed = lambda test: F.array_compact(
        F.array(*[F.when(F.coalesce(test(f), F.lit(False)), F.lit(f)) for f in fields])
    )
    stable = lambda f: of(f, "present") & (of(f, "consistency") >= STABLE)
    shaky = lambda f: ~of(f, "present") | (of(f, "consistency") < PROBLEMATIC)
    present_units = F.when(F.col("present"), to_fixed(F.col("consistency")))
    return per_field.groupBy(key).agg(
        *[of(f, "consensus").alias(f) for f in fields],
        *[of(f, "consistency").alias(f"{f}_consistency") for f in fields],
        *[of(f, "presence_rate").alias(f"{f}_presence_rate") for f in fields],
        *[of(f, "valid").alias(f"{f}_valid") for f in fields],
        F.coalesce(mean_fixed(present_units), F.lit(0.0)).alias("text_consistency"),
        listed(stable).alias("stable_fields"),
        listed(shaky).alias("problematic_fields"),
        F.max("frames_analyzed").alias("frames_analyzed"),
    )


def text_consistency(extractions: DataFrame, fields=KEY_FIELDS, key: str = "video_id", **kwargs) -> DataFrame:
    return summarize_fields(field_consensus(extractions, fields, key, **kwargs), fields, key)
