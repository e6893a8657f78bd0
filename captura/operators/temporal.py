"""Embedding-sequence consistency of each capture."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captura.functions.rounding import clamp01, round_half_even, to_fixed
from captura.functions.vector import cosine, l2_normalize
from captura.operators.grouping import adjacent_pairs, null_safe, tiles
from captura.operators.sampling import sample_frames

# --- fixed values ---------------------------------------------------------
CONSISTENCY_THRESHOLD = 0.85
CONSECUTIVE_SHARE = 0.65
PAIRWISE_SHARE = 0.35
PENALTY_POWER = 1.5
# --------------------------------------------------------------------------

TILE_ROWS = 256


def valid_frames(emb: DataFrame, vec: str = "vec") -> DataFrame:
    return emb.filter(F.col(vec).isNotNull() & (F.size(vec) > 0))


def consecutive_similarity(
    emb: DataFrame, threshold: float = CONSISTENCY_THRESHOLD, key: str = "video_id", width: int = 4096
) -> DataFrame:
    """One row per neighbouring pair of valid frames.

    The reported similarity is rounded; the anomaly test is not.
    """
    pairs = adjacent_pairs(valid_frames(emb).select(key, "frame_idx", "vec"), [key], "frame_idx", ["vec"], width)
    sim = pairs.select(
        key,
        F.col("prev_frame_idx").alias("frame_a"),
        F.col("frame_idx").alias("frame_b"),
        cosine(F.col("prev_vec"), F.col("vec")).alias("raw_similarity"),
    )
    return sim.select(
        key,
        "frame_a",
        "frame_b",
        round_half_even(F.col("raw_similarity")).alias("similarity"),
        (F.col("raw_similarity") < F.lit(threshold)).alias("is_anomaly"),
    )


def anomalous_transitions(emb: DataFrame, threshold: float = CONSISTENCY_THRESHOLD, key: str = "video_id") -> DataFrame:
    return (
        consecutive_similarity(emb, threshold, key)
        .filter("is_anomaly")
        .select(key, "frame_a", "frame_b", "similarity", F.lit(threshold).alias("threshold"))
    )


def _matrix(vectors: pa.Array) -> np.ndarray:
    rows = len(vectors)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(rows, -1) if rows else flat.reshape(0, 0)


def _tile_sums(batches):
    """Clipped dot products of each tile, reduced to a sum and a pair count."""
    for batch in batches:
        left, right = batch.column("__left"), batch.column("__right")
        diagonal = batch.column("__diagonal").to_pylist()
        sums, pairs = [], []
        for i, on_diagonal in enumerate(diagonal):
            a = _matrix(left[i].values)
            if on_diagonal:
                m = np.clip(a @ a.T, 0.0, 1.0)
                sums.append(float(np.triu(m, 1).sum()))
                pairs.append(len(a) * (len(a) - 1) // 2)
            else:
                b = _matrix(right[i].values)
                sums.append(float(np.clip(a @ b.T, 0.0, 1.0).sum()) if len(a) and len(b) else 0.0)
                pairs.append(len(a) * len(b))
        yield pa.RecordBatch.from_arrays(
            [batch.column("__group"), pa.array(sums, pa.float64()), pa.array(pairs, pa.int64())],
            names=["__group", "pair_sum", "pair_count"],
        )


def mean_pairwise_similarity(emb: DataFrame, key: str = "video_id", tile_rows: int = TILE_ROWS) -> DataFrame:
    """Mean clipped cosine over all frame pairs of a capture.

    Clipping acts on each pair, so sums of vectors cannot replace it. Frames are
    tiled; each tile is a bounded matrix product that leaves one partial sum.
    """
    frames = valid_frames(emb).select(key, "frame_idx", "vec")
    tiled = tiles(frames, [key], ["frame_idx"], tile_rows)
    on_diagonal = F.col("__ti") == F.col("__tj")
    packed = (
        tiled.groupBy(key, "__ti", "__tj")
        .agg(
            F.collect_list(F.when(F.col("__block") == F.col("__ti"), F.col("vec"))).alias("__left"),
            F.collect_list(F.when(~on_diagonal & (F.col("__block") == F.col("__tj")), F.col("vec"))).alias("__right"),
        )
        .select(F.col(key).alias("__group"), "__left", "__right", on_diagonal.alias("__diagonal"))
    )
    kind = dict(emb.dtypes)[key]
    partial = packed.mapInArrow(_tile_sums, f"__group {kind}, pair_sum double, pair_count bigint")
    return (
        partial.groupBy(F.col("__group").alias(key))
        .agg(F.sum("pair_sum").alias("s"), F.sum("pair_count").alias("n"))
        .select(key, F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(F.lit(1.0)).alias("mean_pairwise"))
    )


def temporal_consistency(
    emb: DataFrame,
    threshold: float = CONSISTENCY_THRESHOLD,
    key: str = "video_id",
    source: str | None = None,
    max_frames: int | None = None,
    normalize: bool = False,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """Summary per capture with status success, insufficient_frames or video_id_mismatch.

    ``source`` names the column holding the capture each frame really came from;
    a sequence that mixes captures is not scored. ``max_frames`` keeps a uniform
    sample of the valid frames, as the sampling stage of the system does.
    """
    if normalize:
        emb = emb.withColumn("vec", l2_normalize(F.col("vec")))
    if max_frames is not None:
        kept = sample_frames(valid_frames(emb), max_frames, key=key)
        empty = emb.filter(F.col("vec").isNull() | (F.size("vec") <= 0))
        emb = kept.select(*emb.columns).unionByName(empty)
    is_valid = F.col("vec").isNotNull() & (F.size("vec") > 0)
    mixed = (F.min(source) != F.max(source)) if source else F.lit(False)
    base = emb.groupBy(key).agg(
        F.count_if(is_valid).alias("valid"), F.count(F.lit(1)).alias("given"), mixed.alias("mixed")
    )
    cons = consecutive_similarity(emb, threshold, key)
    steps = cons.groupBy(key).agg(
        F.sum(to_fixed(F.col("similarity"))).alias("units"),
        F.count(F.lit(1)).alias("steps"),
        F.min("similarity").alias("min_cons"),
        F.count_if("is_anomaly").alias("anomalies"),
    )
    pairs = mean_pairwise_similarity(emb, key, tile_rows)
    joined = null_safe(null_safe(base, steps, [key]), pairs, [key])
    scored = joined.withColumn("mean_cons", F.col("units") / F.col("steps") / 10000.0)
    blend = CONSECUTIVE_SHARE * F.col("mean_cons") + PAIRWISE_SHARE * F.col("mean_pairwise")
    penalty = F.when(
        F.col("min_cons") < threshold, F.pow(F.col("min_cons") / F.lit(threshold), F.lit(PENALTY_POWER))
    ).otherwise(F.lit(1.0))
    status = (
        F.when(F.col("mixed"), F.lit("video_id_mismatch"))
        .when(F.col("valid") < 2, F.lit("insufficient_frames"))
        .otherwise(F.lit("success"))
    )
    ok = F.col("status") == "success"
    result = scored.withColumn("status", status).withColumn("__score", round_half_even(clamp01(blend * penalty)))
    zero = lambda c: F.when(ok, c).otherwise(F.lit(0.0))
    return result.select(
        key,
        "status",
        F.when(F.col("mixed"), F.col("given")).otherwise(F.col("valid")).alias("num_frames"),
        zero(F.col("__score")).alias("temporal_consistency_score"),
        zero(round_half_even(F.col("mean_cons"))).alias("mean_consecutive_similarity"),
        zero(F.col("min_cons")).alias("min_consecutive_similarity"),
        zero(round_half_even(F.col("mean_pairwise"))).alias("mean_pairwise_similarity"),
        F.when(ok, F.col("anomalies")).otherwise(F.lit(0)).alias("num_anomalies"),
        F.coalesce(ok & (F.col("__score") >= threshold) & (F.col("anomalies") == 0), F.lit(False)).alias(
            "is_consistent"
        ),
    )
