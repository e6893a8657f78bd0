"""Evidence fusion and risk assessment: one projection, no shuffle."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captura.functions.rounding import clamp01, round_half_even
from captura.functions.scores import (
    LOW_RISK,
    MEDIUM_RISK,
    SOURCES,
    normalize_double,
    normalize_score,
    resolve_weights,
    risk_level,
)

# --- fixed values ---------------------------------------------------------
RECOMMENDATIONS = {
    "LOW": "PASS / LOW RISK: Consistent visual and textual evidence. "
    "Suitable for low-risk automated processing.",
    "MEDIUM": "REVIEW / MEDIUM RISK: Minor anomalies or incomplete evidence detected. "
    "Manual secondary inspection recommended.",
    "HIGH": "FLAG / HIGH RISK: Significant visual, temporal, or textual inconsistency detected. "
    "Escalation for fraud review recommended.",
}
# --------------------------------------------------------------------------


def fuse(df: DataFrame, weights: dict | None = None, breakdown: bool = False) -> DataFrame:
    """Weighted average of the available sources, re-weighted over the missing ones.

    Input columns are the four sources, numeric or text, any of them NULL.
    """
    base = resolve_weights(weights)
    numeric = {name for name, kind in df.dtypes if kind == "double"}
    normalized = df.select(
        "*",
        *[
            (normalize_double(F.col(s)) if s in numeric else normalize_score(F.col(s))).alias(f"__{s}")
            for s in SOURCES
        ],
    )
    present = {s: F.col(f"__{s}").isNotNull() for s in SOURCES}
    covered = sum((F.when(present[s], F.lit(base[s])).otherwise(F.lit(0.0)) for s in SOURCES), F.lit(0.0))
    weighed = normalized.withColumn("__covered", covered)
    effective = {
        s: F.when(present[s] & (F.col("__covered") > 0), F.lit(base[s]) / F.col("__covered")).otherwise(F.lit(0.0))
        for s in SOURCES
    }
    contribution = {s: effective[s] * F.coalesce(F.col(f"__{s}"), F.lit(0.0)) for s in SOURCES}
    fused = sum((contribution[s] for s in SOURCES), F.lit(0.0))
    named = [(F.lit(s), present[s]) for s in SOURCES]
    out = weighed.withColumns(
        {
            "fused_integrity_score": round_half_even(clamp01(fused)),
            "evidence_coverage": round_half_even(F.col("__covered") / F.lit(sum(base.values()))),
            "available_sources": F.array_compact(F.array(*[F.when(p, n) for n, p in named])),
            "missing_sources": F.array_compact(F.array(*[F.when(~p, n) for n, p in named])),
            "num_sources_available": sum((p.cast("int") for _, p in named), F.lit(0)),
        }
    )
    if breakdown:
        out = out.withColumn(
            "evidence_breakdown",
            F.array(
                *[
                    F.struct(
                        F.lit(s).alias("source"),
                        round_half_even(F.col(f"__{s}")).alias("normalized_score"),
                        F.lit(round(base[s], 4)).alias("base_weight"),
                        round_half_even(effective[s]).alias("effective_weight"),
                        round_half_even(contribution[s]).alias("weighted_contribution"),
                        F.when(present[s], F.lit("available")).otherwise(F.lit("missing")).alias("status"),
                    )
                    for s in SOURCES
                ]
            ),
        )
    return out.drop("__covered", *[f"__{s}" for s in SOURCES])


def assess(df: DataFrame, low: float = LOW_RISK, medium: float = MEDIUM_RISK) -> DataFrame:
    """Integrity score, tier, recommendation and rounded evidence struct from fused rows."""
    score = clamp01(F.col("fused_integrity_score").cast("double"))
    level = risk_level(score, low, medium)
    advice = F.element_at(F.create_map(*[F.lit(x) for kv in RECOMMENDATIONS.items() for x in kv]), level)
    return df.withColumns(
        {
            "integrity_score": round_half_even(score),
            "risk_level": level,
            "recommendation": advice,
            "evidence": F.struct(*[round_half_even(normalize_score(F.col(s))).alias(s) for s in SOURCES]),
        }
    )
