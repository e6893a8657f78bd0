"""Frame schedules and samples of existing rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captura.operators.grouping import order_buckets, positions


def frame_schedule(total: Column, max_frames: int) -> Column:
    """Evenly spaced, de-duplicated indices from 0 to total - 1."""
    n = total.cast("long")
    k = F.least(n, F.lit(max(1, int(max_frames))).cast("long"))
    spaced = F.array_distinct(
        F.transform(
            F.sequence(F.lit(0).cast("long"), F.greatest(k - 1, F.lit(1).cast("long"))),
            lambda i: F.floor(i * (n - 1) / F.greatest(k - 1, F.lit(1).cast("long"))),
        )
    )
    return (
        F.when(n <= 0, F.array().cast("array<bigint>"))
        .when(k == 1, F.array(F.lit(0).cast("long")))
        .otherwise(spaced)
    )


def effective_interval(total: Column, max_frames: int) -> Column:
    picked = F.size(frame_schedule(total, max_frames))
    spacing = F.greatest(F.lit(1), F.rint((total - 1) / F.greatest(F.lit(1), picked - 1)).cast("int"))
    single = F.least(total, F.lit(max(1, int(max_frames)))) == 1
    return (
        F.when(total <= 0, F.lit(0)).when(single, total.cast("int")).when(picked > 1, spacing).otherwise(F.lit(1))
    )


def on_schedule(position: Column, total: Column, max_frames: int) -> Column:
    """Whether a zero-based position belongs to the schedule, without building the array.

    ``floor(i * (n - 1) / (k - 1)) = p`` for some i exactly when the smallest i
    with ``i * (n - 1) >= p * (k - 1)`` also satisfies the upper bound.
    """
    n, p = total.cast("long"), position.cast("long")
    k = F.least(n, F.lit(max(1, int(max_frames))).cast("long"))
    gaps = F.greatest(k - 1, F.lit(1).cast("long"))
    i = F.ceil(p * gaps / F.greatest(n - 1, F.lit(1).cast("long")))
    hit = (i <= gaps) & (F.floor(i * (n - 1) / gaps) == p)
    return F.when(k == 1, p == 0).otherwise(hit)


def sample_frames(
    frames: DataFrame,
    k: int,
    strategy: str = "uniform",
    key: str = "video_id",
    order: str = "frame_idx",
    step: int = 1,
    width: int = 4096,
) -> DataFrame:
    """Keep the scheduled frames of every capture.

    ``uniform`` spreads k frames over the capture, ``interval`` takes every
    ``step``-th frame up to k of them, ``first`` takes the first k.
    """
    cut = order_buckets(frames, [key], order, width)
    placed = positions(cut, [key], [order], F.col("__bucket"), "__pos", "__size").drop("__bucket")
    if strategy == "uniform":
        keep = on_schedule(F.col("__pos"), F.col("__size"), k)
    elif strategy == "interval":
        keep = (F.col("__pos") % max(1, int(step)) == 0) & (F.floor(F.col("__pos") / max(1, int(step))) < k)
    elif strategy == "first":
        keep = F.col("__pos") < k
    else:
        raise ValueError(f"unknown sampling strategy {strategy!r}")
    return placed.filter(keep).drop("__pos", "__size")
