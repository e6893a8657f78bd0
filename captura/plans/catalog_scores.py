"""Score, fusion, risk and temporal queries."""

from pyspark.sql import functions as F

from captura.functions import scores as S
from captura.functions.rounding import round_half_even
from captura.functions.vector import l2_normalize
from captura.operators.audit import stage_status, stage_times
from captura.operators.fusion import assess, fuse
from captura.operators.sampling import effective_interval, frame_schedule, sample_frames
from captura.operators.temporal import (
    anomalous_transitions,
    consecutive_similarity,
    mean_pairwise_similarity,
    temporal_consistency,
)
from captura.operators.tracking import ema
from captura.plans import views as V
from captura.plans.registry import clamp, query, r

_WEIGHTS = {k: v for k, v in S.DEFAULT_WEIGHTS.items()}


def norm_sql(c: str) -> str:
    return f"CASE WHEN {c} BETWEEN 5e0 AND 100e0 THEN {clamp(c + ' / 100e0')} ELSE {clamp(c)} END"


def fuse_sql(weights: dict, source: str = "evidence") -> str:
    """CTEs ``normed`` and ``fused`` over a table with the four scores."""
    cols = list(weights)
    nul = ", ".join(f"CASE WHEN {c} IS NULL THEN NULL ELSE {norm_sql(c)} END AS n_{c}" for c in cols)
    cov = " + ".join(f"CASE WHEN n_{c} IS NULL THEN 0e0 ELSE {weights[c]!r}e0 END" for c in cols)
    val = " + ".join(f"CASE WHEN n_{c} IS NULL THEN 0e0 ELSE {weights[c]!r}e0 / cov * n_{c} END" for c in cols)
    present = " + ".join(f"CASE WHEN n_{c} IS NULL THEN 0 ELSE 1 END" for c in cols)
    missing = "concat_ws(',', " + ", ".join(f"CASE WHEN n_{c} IS NULL THEN '{c}' END" for c in cols) + ")"
    total = repr(sum(weights.values()))
    return (
        f"normed AS (SELECT *, {nul} FROM {source}), "
        f"covered AS (SELECT *, {cov} AS cov FROM normed), "
        f"fused AS (SELECT *, CASE WHEN cov > 0 THEN {r(clamp(val))} ELSE 0e0 END AS fused_integrity_score, "
        f"{r('cov / ' + total + 'e0')} AS evidence_coverage, {present} AS num_sources_available, {missing} AS missing "
        "FROM covered)"
    )


RISK_SQL = (
    "CASE WHEN fused_integrity_score >= 0.7e0 THEN 'LOW' WHEN fused_integrity_score >= 0.4e0 THEN 'MEDIUM' ELSE 'HIGH' END"
)


@query(
    "x11_fuse_evidence",
    f"WITH {V.SQL_EVIDENCE}, {fuse_sql(_WEIGHTS)} SELECT video_id, fused_integrity_score, evidence_coverage, "
    f"num_sources_available, missing AS missing_sources, {RISK_SQL} AS risk_level FROM fused",
)
def fuse_evidence(spark, sf_dir):
    fused = assess(fuse(V.evidence(spark, sf_dir)))
    return fused.select(
        "video_id",
        "fused_integrity_score",
        "evidence_coverage",
        "num_sources_available",
        F.array_join("missing_sources", ",").alias("missing_sources"),
        "risk_level",
    )


_CUSTOM = S.resolve_weights({"visual": 2.0, "temporal_weight": 1.0, "ocr": 0.5, "text": 0.5})


@query(
    "x10_custom_weights",
    f"WITH {V.SQL_EVIDENCE}, {fuse_sql(_CUSTOM)} SELECT video_id, fused_integrity_score, evidence_coverage FROM fused",
)
def custom_weights(spark, sf_dir):
    weights = {"visual": 2.0, "temporal_weight": 1.0, "ocr": 0.5, "text": 0.5}
    return fuse(V.evidence(spark, sf_dir), weights).select("video_id", "fused_integrity_score", "evidence_coverage")


@query(
    "x11_evidence_breakdown",
    f"WITH {V.SQL_EVIDENCE}, {fuse_sql(_WEIGHTS)} "
    + " UNION ALL ".join(
        f"SELECT video_id, '{c}' AS source, {r('n_' + c)} AS normalized_score, "
        f"CASE WHEN n_{c} IS NULL THEN 0e0 ELSE {r(f'{w!r}e0 / cov')} END AS effective_weight, "
        f"CASE WHEN n_{c} IS NULL THEN 0e0 ELSE {r(f'{w!r}e0 / cov * n_{c}')} END AS weighted_contribution, "
        f"CASE WHEN n_{c} IS NULL THEN 'missing' ELSE 'available' END AS status FROM fused"
        for c, w in _WEIGHTS.items()
    ),
)
def evidence_breakdown(spark, sf_dir):
    fused = fuse(V.evidence(spark, sf_dir), breakdown=True)
    return fused.select("video_id", F.explode("evidence_breakdown").alias("b")).select(
        "video_id", "b.source", "b.normalized_score", "b.effective_weight", "b.weighted_contribution", "b.status"
    )


@query(
    "x09_normalize_score",
    "WITH raw AS (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'invalid' WHEN event_id % 19 = 0 THEN 'nan' "
    "ELSE json_extract_string(props, '$.k') END AS t FROM events), "
    "num AS (SELECT event_id, CASE WHEN t = 'nan' THEN NULL ELSE try_cast(t AS DOUBLE) END AS x FROM raw) "
    f"SELECT event_id, CASE WHEN x IS NULL THEN NULL ELSE {norm_sql('x')} END AS normalized FROM num",
)
def normalize_score(spark, sf_dir):
    events = V.table(spark, sf_dir, "events")
    raw = (
        F.when(F.col("event_id") % 17 == 0, F.lit("invalid"))
        .when(F.col("event_id") % 19 == 0, F.lit("nan"))
        .otherwise(F.get_json_object("props", "$.k"))
    )
    return events.select("event_id", S.normalize_score(raw).alias("normalized"))


@query(
    "p08_p09_p10_risk_status",
    f"WITH {V.SQL_EVIDENCE}, {fuse_sql(_WEIGHTS)}, a AS (SELECT *, {RISK_SQL} AS risk_level FROM fused) "
    "SELECT video_id, risk_level, "
    + ", ".join(
        f"CASE WHEN n_{c} IS NULL THEN 'MISSING' WHEN n_{c} >= 0.7e0 THEN 'PASS' WHEN n_{c} >= 0.4e0 THEN 'REVIEW' "
        f"ELSE 'FLAG' END AS {c}_status"
        for c in _WEIGHTS
    )
    + ", CASE risk_level WHEN 'LOW' THEN 'PASS / LOW RISK' WHEN 'MEDIUM' THEN 'REVIEW / MEDIUM RISK' ELSE 'FLAG / HIGH RISK' END "
    "AS advice FROM a",
)
def risk_status(spark, sf_dir):
    assessed = assess(fuse(V.evidence(spark, sf_dir)))
    return assessed.select(
        "video_id",
        "risk_level",
        *[S.evidence_status(S.normalize_double(F.col(c))).alias(f"{c}_status") for c in S.SOURCES],
        F.substring_index("recommendation", ":", 1).alias("advice"),
    )


@query(
    "a10_p11_visual_score",
    "SELECT conv_id AS video_id, "
    + r("sum((turn * 31 + conv_id) % 101) / (101e0 * count(*))")
    + " AS visual_integrity, CASE WHEN 1e0 - sum((turn * 31 + conv_id) % 101) / (101e0 * count(*)) >= 0.5e0 THEN 1 ELSE 0 END AS predicted "
    "FROM conversations GROUP BY conv_id",
)
def visual_score(spark, sf_dir):
    turns = V.conversation_frames(spark, sf_dir)
    units = (F.col("frame_idx") * 31 + F.col("video_id")) % 101
    mean = F.sum(units) / (F.lit(101.0) * F.count(F.lit(1)))
    per_video = turns.groupBy("video_id").agg(mean.alias("m"))
    return per_video.select(
        "video_id", round_half_even(F.col("m")).alias("visual_integrity"), S.attack_decision(F.col("m")).alias("predicted")
    )


# --- temporal ------------------------------------------------------------------

_CONS_SQL = (
    f"{V.SQL_EMBEDDINGS}, pairs AS (SELECT video_id, lag(frame_idx) OVER w AS frame_a, frame_idx AS frame_b, "
    "lag(vec) OVER w AS pv, vec FROM emb WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx)), "
    f"sims AS (SELECT video_id, frame_a, frame_b, {clamp('list_dot_product(pv, vec)')} AS raw FROM pairs WHERE pv IS NOT NULL)"
)
SUMMARY_SQL = (
    f"{_CONS_SQL}, allp AS (SELECT a.video_id, avg({clamp('list_dot_product(a.vec, b.vec)')}) AS mean_pair FROM emb a JOIN emb b "
    "ON a.video_id = b.video_id AND a.frame_idx < b.frame_idx GROUP BY a.video_id), "
    f"steps AS (SELECT video_id, avg({r('raw')}) AS mc, min({r('raw')}) AS mn, count_if(raw < 0.85e0) AS anomalies "
    "FROM sims GROUP BY video_id), n AS (SELECT video_id, count(*) AS num_frames FROM emb GROUP BY video_id), "
    "temporal AS (SELECT n.video_id, num_frames, anomalies, mc, mn, mean_pair, "
    + r(
        clamp(
            "(0.65e0 * mc + 0.35e0 * mean_pair) * CASE WHEN mn < 0.85e0 THEN pow(mn / 0.85e0, 1.5e0) ELSE 1e0 END"
        )
    )
    + " AS score FROM n LEFT JOIN steps ON n.video_id = steps.video_id LEFT JOIN allp ON n.video_id = allp.video_id)"
)


@query(
    "w01_consecutive_similarity",
    f"WITH {_CONS_SQL} SELECT video_id, frame_a, frame_b, {r('raw')} AS similarity, raw < 0.85e0 AS is_anomaly FROM sims",
)
def consecutive(spark, sf_dir):
    return consecutive_similarity(V.embeddings(spark, sf_dir))


@query(
    "w02_anomalous_transitions",
    f"WITH {_CONS_SQL} SELECT video_id, frame_a, frame_b, {r('raw')} AS similarity, 0.3e0 AS threshold FROM sims WHERE raw < 0.3e0",
)
def anomalies(spark, sf_dir):
    return anomalous_transitions(V.embeddings(spark, sf_dir), threshold=0.3)


@query(
    "j08_mean_pairwise_similarity",
    f"WITH {V.SQL_EMBEDDINGS} SELECT a.video_id, round(avg({clamp('list_dot_product(a.vec, b.vec)')}), 6) AS mean_pairwise "
    "FROM emb a JOIN emb b ON a.video_id = b.video_id AND a.frame_idx < b.frame_idx GROUP BY a.video_id",
)
def pairwise(spark, sf_dir):
    rows = mean_pairwise_similarity(V.embeddings(spark, sf_dir))
    return rows.select("video_id", F.round("mean_pairwise", 6).alias("mean_pairwise"))


@query(
    "a09_temporal_consistency",
    f"WITH {SUMMARY_SQL} SELECT video_id, 'success' AS status, num_frames, score AS temporal_consistency_score, "
    f"{r('mc')} AS mean_consecutive_similarity, mn AS min_consecutive_similarity, {r('mean_pair')} AS mean_pairwise_similarity, "
    "anomalies AS num_anomalies, score >= 0.85e0 AND anomalies = 0 AS is_consistent FROM temporal",
)
def temporal(spark, sf_dir):
    return temporal_consistency(V.embeddings(spark, sf_dir))


@query(
    "r04_provenance_guard",
    "SELECT CAST(floor(vec_id / 25) AS BIGINT) AS sequence_id, "
    "CASE WHEN min(label) <> max(label) THEN 'video_id_mismatch' WHEN count(*) < 2 THEN 'insufficient_frames' ELSE 'success' END AS status "
    "FROM embeddings GROUP BY 1",
)
def provenance(spark, sf_dir):
    rows = V.embeddings(spark, sf_dir).withColumnRenamed("video_id", "source_video")
    sequences = rows.withColumn("video_id", F.floor(F.col("frame_idx") / 25))
    summary = temporal_consistency(sequences, source="source_video")
    return summary.select(F.col("video_id").alias("sequence_id"), "status")


@query(
    "x12_x13_normalize_vectors",
    "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), "
    "s AS (SELECT vec_id, list_transform(v, lambda x: x * (1e0 + vec_id % 7)) AS v FROM e), "
    "n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM s) "
    "SELECT vec_id, round(norm, 6) AS norm, round(v[1] / greatest(norm, 1e-8), 6) AS first, round(v[64] / greatest(norm, 1e-8), 6) AS last FROM n",
)
def normalize_vectors(spark, sf_dir):
    from captura.functions.vector import norm

    e = V.table(spark, sf_dir, "embeddings")
    scaled = e.select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double") * (1.0 + F.col("vec_id") % 7)).alias("v")
    )
    unit = scaled.select("vec_id", norm(F.col("v")).alias("norm"), l2_normalize(F.col("v")).alias("u"))
    return unit.select(
        "vec_id",
        F.round("norm", 6).alias("norm"),
        F.round(F.get("u", F.lit(0)), 6).alias("first"),
        F.round(F.get("u", F.lit(63)), 6).alias("last"),
    )


# --- schedules and sampling ------------------------------------------------------

_SCHEDULE_SQL = (
    "sched AS (SELECT n, CAST(i.i AS BIGINT) AS i, least(n, 10) AS k FROM sizes, range(0, 10) i(i) WHERE i.i < least(n, 10))"
)


@query(
    "w07_frame_schedule",
    "WITH sizes AS (SELECT o_custkey AS video_id, count(*) AS n FROM orders GROUP BY 1), "
    "picks AS (SELECT video_id, n, CASE WHEN least(n, 10) = 1 THEN 0 ELSE CAST(i.i AS BIGINT) * (n - 1) // (least(n, 10) - 1) END AS p "
    "FROM sizes, range(0, 10) i(i) WHERE i.i < least(n, 10)), "
    "d AS (SELECT DISTINCT video_id, n, p FROM picks) "
    "SELECT video_id, string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) AS indices, "
    "CAST(CASE WHEN least(n, 10) = 1 THEN n WHEN count(*) > 1 THEN greatest(1, round_even((n - 1) / (count(*) - 1), 0)) ELSE 1 END AS INT) AS sampling_interval "
    "FROM d GROUP BY video_id, n",
)
def schedule(spark, sf_dir):
    sizes = V.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("video_id")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.select(
        "video_id",
        F.array_join(frame_schedule(F.col("n"), 10), ",").alias("indices"),
        effective_interval(F.col("n"), 10).alias("sampling_interval"),
    )


_RANKED = (
    "ranked AS (SELECT o_custkey AS video_id, o_orderkey AS frame_idx, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS p, "
    "count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)"
)


@query(
    "w09_uniform_sample",
    f"WITH {_RANKED}, picks AS (SELECT DISTINCT video_id, CASE WHEN least(n, 4) = 1 THEN 0 "
    "ELSE CAST(i.i AS BIGINT) * (n - 1) // (least(n, 4) - 1) END AS p FROM ranked, range(0, 4) i(i) WHERE i.i < least(n, 4)) "
    "SELECT r.video_id, r.frame_idx FROM ranked r JOIN picks k ON r.video_id = k.video_id AND r.p = k.p",
)
def uniform_sample(spark, sf_dir):
    frames = V.table(spark, sf_dir, "orders").selectExpr("o_custkey AS video_id", "o_orderkey AS frame_idx")
    return sample_frames(frames, 4)


@query("w08_interval_sample", f"WITH {_RANKED} SELECT video_id, frame_idx FROM ranked WHERE p % 3 = 0 AND p // 3 < 5")
def interval_sample(spark, sf_dir):
    frames = V.table(spark, sf_dir, "orders").selectExpr("o_custkey AS video_id", "o_orderkey AS frame_idx")
    return sample_frames(frames, 5, "interval", step=3)


@query(
    "w10_first_frames",
    "WITH ranked AS (SELECT l_orderkey AS video_id, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_extendedprice) AS p FROM lineitem) "
    "SELECT video_id, count(*) AS kept, max(l_partkey) AS last_kept FROM ranked WHERE p <= 3 GROUP BY video_id",
)
def first_frames(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_extendedprice")
    rows = V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")
    # A row-number limit is applied before the shuffle as well, so a hot clip sends few rows.
    kept = rows.withColumn("p", F.row_number().over(w)).filter("p <= 3")
    return kept.groupBy(F.col("l_orderkey").alias("video_id")).agg(
        F.count(F.lit(1)).alias("kept"), F.max("l_partkey").alias("last_kept")
    )


@query(
    "q06_exponential_smoothing",
    "WITH RECURSIVE o AS (SELECT o_custkey AS video_id, o_orderkey AS frame_idx, sqrt(o_totalprice) AS x, "
    "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders), "
    "s AS (SELECT video_id, frame_idx, p, x AS e FROM o WHERE p = 1 UNION ALL "
    "SELECT o.video_id, o.frame_idx, o.p, 0.7e0 * o.x + 0.3e0 * s.e FROM s JOIN o ON o.video_id = s.video_id AND o.p = s.p + 1) "
    "SELECT video_id, frame_idx, round(e, 4) AS smoothed FROM s",
)
def smoothing(spark, sf_dir):
    frames = V.table(spark, sf_dir, "orders").selectExpr("o_custkey AS video_id", "o_orderkey AS frame_idx", "sqrt(o_totalprice) AS x")
    return ema(frames, "video_id", "frame_idx", "x").select("video_id", "frame_idx", F.round("ema", 4).alias("smoothed"))


# --- stages ----------------------------------------------------------------------


@query(
    "p16_stage_status",
    f"WITH {V.SQL_STAGES} SELECT stage_name, CASE WHEN failed THEN 'FAILED' WHEN items_processed > 0 THEN 'SUCCESS' ELSE 'WARNING' END AS status, "
    "count(*) AS runs FROM stages GROUP BY 1, 2",
)
def stages(spark, sf_dir):
    runs = V.stage_runs(spark, sf_dir)
    status = stage_status(F.col("items_processed"), F.col("failed"))
    return runs.groupBy("stage_name", status.alias("status")).agg(F.count(F.lit(1)).alias("runs"))


@query(
    "a32_stage_times",
    f"WITH {V.SQL_STAGES} SELECT video_id, round(sum(CAST(round(duration_seconds * 100) AS BIGINT)) / 100e0, 3) AS total_processing_time_seconds, "
    "count(*) AS stages, count_if(failed) AS failed_stages FROM stages GROUP BY 1",
)
def times(spark, sf_dir):
    runs = V.stage_runs(spark, sf_dir)
    return stage_times(runs.withColumn("status", stage_status(F.col("items_processed"), F.col("failed"))))


@query(
    "x18_video_duration",
    "SELECT conv_id AS video_id, count(*) AS total_frames, " + r("count(*) / (24e0 + conv_id % 7)", 3) + " AS duration_sec FROM conversations GROUP BY conv_id",
)
def duration(spark, sf_dir):
    turns = V.conversation_frames(spark, sf_dir)
    per = turns.groupBy("video_id").agg(F.count(F.lit(1)).alias("total_frames"))
    fps = 24.0 + F.col("video_id") % 7
    return per.select("video_id", "total_frames", round_half_even(F.col("total_frames") / fps, 3).alias("duration_sec"))
