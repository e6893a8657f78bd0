"""Score normalization, decisions and tiers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from captura.functions.rounding import clamp01

# --- fixed values ---------------------------------------------------------
SOURCES = ("visual_integrity", "temporal_consistency", "ocr_confidence", "text_consistency")
DEFAULT_WEIGHTS = {
    "visual_integrity": 0.40,
    "temporal_consistency": 0.30,
    "ocr_confidence": 0.15,
    "text_consistency": 0.15,
}
WEIGHT_ALIASES = {
    "visual_weight": "visual_integrity",
    "visual_integrity": "visual_integrity",
    "visual": "visual_integrity",
    "temporal_weight": "temporal_consistency",
    "temporal_consistency": "temporal_consistency",
    "temporal": "temporal_consistency",
    "ocr_weight": "ocr_confidence",
    "ocr_confidence": "ocr_confidence",
    "ocr": "ocr_confidence",
    "text_consistency_weight": "text_consistency",
    "text_consistency": "text_consistency",
    "text": "text_consistency",
}
LOW_RISK = 0.70
MEDIUM_RISK = 0.40
# --------------------------------------------------------------------------


def resolve_weights(overrides: dict | None = None) -> dict:
    """Defaults plus aliased overrides, scaled to sum to one."""
    weights = dict(DEFAULT_WEIGHTS)
    for key, value in (overrides or {}).items():
        source = WEIGHT_ALIASES.get(key.lower())
        if source is not None and value is not None:
            weights[source] = float(value)
    total = sum(weights.values())
    if total <= 0:
        raise ValueError(f"total weight must be positive, got {total}")
    return {source: weight / total for source, weight in weights.items()}


def normalize_score(raw: Column) -> Column:
    """Any raw score to [0, 1]; NULL for missing, unparsable, NaN or infinite input.

    Values from 5 to 100 are read as percentages. Text is accepted.
    """
    text = F.btrim(raw.cast("string"))
    value = text.try_cast("double")
    usable = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
    scaled = F.when(value.between(5.0, 100.0), value / 100.0).otherwise(value)
    return F.when(usable, clamp01(scaled))


def normalize_double(raw: Column) -> Column:
    """:func:`normalize_score` for columns that are already double."""
    usable = raw.isNotNull() & ~F.isnan(raw) & (F.abs(raw) != F.lit(float("inf")))
    scaled = F.when(raw.between(5.0, 100.0), raw / 100.0).otherwise(raw)
    return F.when(usable, clamp01(scaled))


def risk_level(score: Column, low: float = LOW_RISK, medium: float = MEDIUM_RISK) -> Column:
    if low <= medium:
        raise ValueError(f"the low-risk threshold {low} must exceed the medium-risk threshold {medium}")
    s = clamp01(score)
    return F.when(s >= low, F.lit("LOW")).when(s >= medium, F.lit("MEDIUM")).otherwise(F.lit("HIGH"))


def evidence_status(score: Column) -> Column:
    """PASS / REVIEW / FLAG / MISSING at fixed cut-offs, independent of risk thresholds."""
    return (
        F.when(score.isNull(), F.lit("MISSING"))
        .when(score >= 0.70, F.lit("PASS"))
        .when(score >= 0.40, F.lit("REVIEW"))
        .otherwise(F.lit("FLAG"))
    )


def attack_decision(integrity: Column, threshold: float = 0.5) -> Column:
    return F.when(1.0 - integrity >= threshold, F.lit(1)).otherwise(F.lit(0))


def real_decision(p_real: Column) -> Column:
    return F.when(p_real >= 0.5, F.lit("REAL")).otherwise(F.lit("ATTACKED"))


def combine_visual_temporal(visual: Column, temporal: Column, wv: float = 0.40, wt: float = 0.30) -> Column:
    total = wv + wt
    a, b = (wv / total, wt / total) if total > 0 else (0.5, 0.5)
    return F.lit(a) * visual + F.lit(b) * temporal
