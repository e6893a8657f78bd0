"""Ambiguity gates: decide per frame whether the cheap localization can be trusted."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captura.functions import geometry as G
from captura.functions.rounding import round_half_even

_GATE_SCHEMA = (
    "name string, kind string, min_static double, max_area double, min_aspect double, min_edge double, "
    "compound_area double, compound_aspect double, pristine boolean, pristine_min_static double, "
    "check_container boolean"
)


def gate(name, kind, min_static, max_area, min_aspect, min_edge=0.0, compound_area=None, compound_aspect=None,
         pristine=False, pristine_min_static=0.60, check_container=True) -> dict:
    return dict(
        name=name, kind=kind, min_static=min_static, max_area=max_area, min_aspect=min_aspect, min_edge=min_edge,
        compound_area=compound_area, compound_aspect=compound_aspect, pristine=pristine,
        pristine_min_static=pristine_min_static, check_container=check_container,
    )


# --- fixed values ---------------------------------------------------------
REASON_MISSING = "opencv_not_detected"
REASON_CONFIDENT = "confident_opencv_candidate"
REASON_CONTAINER = "encloses_inner_quad_container"
REASON_CARRIER = "compound_carrier_signature"
REASON_AREA_REFINED = "carrier_area_exceeded"
REASON_AREA_STANDARD = "area_ratio_carrier_sheet"
REASON_ASPECT = "aspect_ratio_deviation"
REASON_STATIC = "low_static_score"
REASON_EDGE = "poor_edge_quality"
STANDARD_GATES = [
    gate("failure_only", "standard", 0.0, 1.0, 0.0, check_container=False),
    gate("conservative", "standard", 0.55, 0.65, 0.45, check_container=False),
    gate("balanced", "standard", 0.70, 0.48, 0.75),
    gate("aggressive", "standard", 0.78, 0.40, 0.90, min_edge=0.40),
]
REFINED_GATES = [
    gate("baseline_balanced", "refined", 0.70, 0.48, 0.75),
    gate("variant_a_area_035", "refined", 0.70, 0.35, 0.75),
    gate("variant_b_compound_sig", "refined", 0.70, 0.48, 0.75, compound_area=0.32, compound_aspect=1.50),
    gate("variant_c_dual_path", "refined", 0.70, 0.35, 0.75, compound_area=0.30, compound_aspect=1.50, pristine=True),
]
PRISTINE_AREA = (0.06, 0.28)
PRISTINE_ASPECT = (1.53, 1.68)
PRISTINE_RECT = 0.92
# --------------------------------------------------------------------------

DEFAULT_GATE = REFINED_GATES[3]


def gate_literals(gates) -> Column:
    """Gate configurations as one array literal; they are parameters, not a table to join."""
    kinds = [part.strip().split(" ") for part in _GATE_SCHEMA.split(",")]
    return F.array(
        *[F.struct(*[F.lit(g[name]).cast(kind).alias(name) for name, kind in kinds]) for g in gates]
    )


def _optional(df: DataFrame, name: str, default) -> Column:
    return F.col(name) if name in df.columns else F.lit(default)


def gate_signals(detections: DataFrame) -> DataFrame:
    """Measured signals of the best candidate, with fallbacks for missing ones."""
    m = lambda field: F.col(f"__m.{field}")
    frame_area = F.greatest(F.lit(1.0), F.col("frame_w").cast("double") * F.col("frame_h"))
    area = F.coalesce(_optional(detections, "area", None).cast("double"), F.lit(0.0))
    aspect = F.coalesce(_optional(detections, "aspect_ratio", None).cast("double"), F.lit(0.0))
    delta = _optional(detections, "nesting_delta", 0.0)
    encloses = F.coalesce(_optional(detections, "encloses_count", 0), F.lit(0))
    found = F.coalesce(F.col("detected"), F.lit(False)) & F.col("corners").isNotNull()
    shaped = G.measure(detections, "corners", "__m")
    measured = shaped.withColumns(
        {
            "__found": found,
            "__static": F.coalesce(_optional(detections, "static_score", 0.0), F.lit(0.0)),
            "__area": F.when(area <= 0.0, m("area")).otherwise(area) / frame_area,
            "__aspect": F.when(aspect <= 0.0, G.aspect_ratio(m("w"), m("h"))).otherwise(aspect),
            "__edge": F.coalesce(_optional(detections, "edge_quality", 0.5), F.lit(0.5)),
            "__encloses": (encloses > 0) | F.coalesce(delta < 0.0, F.lit(False)),
            "__rect": G.score_rectangularity(F.lit(1.0), m("mean_cos")),
        }
    )
    scored = measured.withColumn("__aspect_score", G.score_aspect_ratio(F.col("__aspect")))
    return scored.drop("__m").withColumn(
        "__pristine",
        F.col("__area").between(*PRISTINE_AREA)
        & F.col("__aspect").between(*PRISTINE_ASPECT)
        & (F.col("__rect") >= PRISTINE_RECT),
    )


def _three(col: Column) -> Column:
    return F.format_string("%.3f", round_half_even(col, 3))


def apply_gates(detections: DataFrame, gates=(DEFAULT_GATE,)) -> DataFrame:
    """One decision per frame and gate; the first rule that fires gives the reason.

    Refined gates test area, carrier signature, container, aspect, static score.
    Standard gates test static score, area, aspect, edge, container.
    """
    measured = gate_signals(detections).withColumn("__gate", F.explode(gate_literals(list(gates))))
    g = lambda name: F.col(f"__gate.{name}")
    area, aspect, score = F.col("__area"), F.col("__aspect"), F.col("__aspect_score")
    static, edge = F.col("__static"), F.col("__edge")
    container = g("check_container") & F.col("__encloses")
    need_static = F.when(g("pristine") & F.col("__pristine"), g("pristine_min_static")).otherwise(g("min_static"))

    def exceeded(prefix, value, limit):
        return F.concat(F.lit(prefix + " ("), _three(value), F.lit(" > "), limit.cast("string"), F.lit(")"))

    def below(prefix, value, limit):
        return F.concat(F.lit(prefix + " ("), _three(value), F.lit(" < "), limit, F.lit(")"))

    carrier = (area > g("compound_area")) & (aspect < g("compound_aspect"))
    carrier_reason = F.concat(
        F.lit(REASON_CARRIER + " (area="), _three(area), F.lit(">"), g("compound_area").cast("string"),
        F.lit(" and aspect="), _three(aspect), F.lit("<"), g("compound_aspect").cast("string"), F.lit(")"),
    )
    aspect_reason = below(REASON_ASPECT, score, g("min_aspect").cast("string"))
    nested = F.lit(REASON_CONTAINER)
    confident = F.lit(REASON_CONFIDENT)
    refined = (
        F.when(area > g("max_area"), exceeded(REASON_AREA_REFINED, area, g("max_area")))
        .when(carrier, carrier_reason)
        .when(container, nested)
        .when(score < g("min_aspect"), aspect_reason)
        .when(static < need_static, below(REASON_STATIC, static, _three(need_static)))
        .otherwise(confident)
    )
    standard = (
        F.when(static < g("min_static"), below(REASON_STATIC, static, g("min_static").cast("string")))
        .when(area > g("max_area"), exceeded(REASON_AREA_STANDARD, area, g("max_area")))
        .when(score < g("min_aspect"), aspect_reason)
        .when(
            (g("min_edge") > 0.0) & (edge < g("min_edge")),
            below(REASON_EDGE, edge, g("min_edge").cast("string")),
        )
        .when(container, nested)
        .otherwise(confident)
    )
    reason = (
        F.when(~F.col("__found"), F.lit(REASON_MISSING))
        .when(g("kind") == "standard", standard)
        .otherwise(refined)
    )
    zero = lambda c: F.when(F.col("__found"), c).otherwise(F.lit(0.0))
    no = lambda c: F.when(F.col("__found"), c).otherwise(F.lit(False))
    decided = measured.withColumn("reason", reason)
    return decided.select(
        *detections.columns,
        g("name").alias("gate"),
        (F.col("reason") != confident).alias("invoke_tier2"),
        "reason",
        F.struct(
            F.col("__found").alias("detected"),
            zero(round_half_even(static)).alias("static_score"),
            zero(round_half_even(aspect, 3)).alias("aspect_ratio"),
            zero(round_half_even(score)).alias("aspect_score"),
            zero(round_half_even(area)).alias("area_ratio"),
            zero(round_half_even(F.col("__rect"))).alias("rect_score"),
            zero(round_half_even(edge)).alias("edge_score"),
            no(container).alias("is_container"),
            no(F.col("__pristine")).alias("is_pristine"),
        ).alias("signals"),
    )


def tier1_detection(scored_best: DataFrame, frames: DataFrame, min_static: float = 0.40, keys=("video_id", "frame_id")) -> DataFrame:
    """Untracked tier-1 result: the best candidate from a static score of 0.40 up."""
    best = scored_best.filter(F.col("static_score") >= min_static).withColumn("detected", F.lit(True))
    extra = [c for c in best.columns if c not in frames.columns or c in keys]
    joined = frames.join(best.select(*extra), list(keys), "left")
    return joined.withColumn("detected", F.coalesce("detected", F.lit(False)))


def tier1_of_best(best: DataFrame, min_static: float = 0.40, keys=("video_id", "frame_id")) -> DataFrame:
    """:func:`tier1_detection` of rows that hold every frame with its best candidate, or NULL; a frame without a key has none."""
    found = F.coalesce(F.col("static_score") >= min_static, F.lit(False))
    for k in keys:
        found = found & F.col(k).isNotNull()
    frame = (*keys, "frame_w", "frame_h")
    shown = [F.col(c) if c in frame else F.when(F.col("__hit"), F.col(c)).alias(c) for c in best.columns]
    return best.withColumn("__hit", found).select(*shown, F.col("__hit").alias("detected"))


def route(decisions: DataFrame, tier2: DataFrame, keys=("video_id", "frame_id")) -> DataFrame:
    """Keep tier 1 where the gate is confident, otherwise take tier 2; a missing tier-2 result is negative.

    ``tier2`` holds ``detected, corners, bbox, confidence`` per frame and may cover
    only the frames that were sent to it.
    """
    keys = list(keys)
    renamed = tier2.select(
        *keys,
        F.col("detected").alias("t2_detected"),
        F.col("corners").alias("t2_corners"),
        F.col("bbox").alias("t2_bbox"),
        F.col("confidence").cast("double").alias("t2_confidence"),
    )
    joined = decisions.join(renamed, keys, "left")
    use2 = F.col("invoke_tier2")
    hit2 = F.coalesce("t2_detected", F.lit(False)) & F.col("t2_corners").isNotNull()

    def pick(first, second):
        return F.when(~use2, first).when(hit2, second)

    return joined.select(
        *keys,
        *[c for c in ("gate",) if c in decisions.columns],
        F.when(use2, hit2).otherwise(F.col("detected")).alias("detected"),
        pick(F.col("corners"), G.order_points(F.col("t2_corners"))).alias("corners"),
        pick(F.col("bbox"), F.col("t2_bbox")).alias("bbox"),
        F.coalesce(pick(F.col("confidence"), F.col("t2_confidence")), F.lit(0.0)).alias("confidence"),
        F.when(use2, F.lit("tier2")).otherwise(F.lit("tier1")).alias("localization_method"),
        F.col("reason").alias("gate_reason"),
        F.when(use2 & ~hit2, F.lit("learned_segmentation_failed")).alias("reason"),
    )
