"""Skew-safe building blocks for ordered and pairwise work inside groups.

A group (one capture, one experiment, one class) may hold a large share of all
rows, so none of these helpers sorts or collects a whole group in one task.
Ordered work is cut into buckets along the order column and stitched together
with one row per bucket; pairwise work is cut into tiles of bounded size. Buckets of
a large group end at splitters taken from its own order values (``order_buckets``), so
they hold like numbers of rows however the values are spread.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_KEY = "__key"
_BUCKET = "__bucket"


def _with_key(df: DataFrame, by) -> DataFrame:
    """Struct key: equality on it also matches NULL group values."""
    return df.withColumn(_KEY, F.struct(*by) if by else F.struct(F.lit(0).alias("all")))


_SIDE = 32
_SAMPLES = 16


def order_buckets(df: DataFrame, by, order: str, rows: int = 4096) -> DataFrame:
    """Add ``__bucket``, which does not decrease along ``order``, with about ``rows`` rows in a bucket of a group.

    A group of at most ``rows`` rows is bucket 0. Of a larger one a sample by hash, some 16 rows for each bucket,
    gives the splitters: at most 1024 of them, in two levels so that a row compares with 64. Splitters depend on the values
    alone, so every evaluation of the plan cuts alike, and no job runs while it is built. Equal values share a
    bucket. A NULL order value goes to bucket 0.
    """
    keyed = _with_key(df, list(by))
    buckets = F.least(F.lit(_SIDE * _SIDE), F.ceil(F.col("__n") / F.lit(rows))).cast("long")
    large = (
        group_counts(keyed, [_KEY])
        .filter(F.col("__n") > rows)
        .select(_KEY, buckets.alias("__want"), F.greatest(F.lit(1), F.floor(F.col("__n") / (buckets * _SAMPLES))).alias("__every"))
    )
    drawn = keyed.select(_KEY, order).join(large, _KEY).filter(F.pmod(F.xxhash64(order, F.lit("splitter")), "__every") == 0)
    pooled = drawn.groupBy(_KEY).agg(F.sort_array(F.collect_set(order)).alias("__all"), F.max("__want").alias("__want"))
    step = F.greatest(F.lit(1), F.ceil(F.size("__all") / F.col("__want")))
    thinned = pooled.select(_KEY, F.filter("__all", lambda x, i: i % step == 0).alias("__cuts"))
    pieces = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("__cuts") - 1) / _SIDE).cast("int")),
        lambda k: F.slice("__cuts", k * _SIDE + 1, F.lit(_SIDE)),
    )
    cuts = thinned.filter(F.size("__cuts") > 0).select(_KEY, pieces.alias("__pieces"))
    upto = lambda a: F.size(F.filter(a, lambda x: x <= F.col(order)))
    piece = F.size(F.filter("__pieces", lambda p: F.get(p, F.lit(0)) <= F.col(order)))
    placed = keyed.join(cuts, _KEY, "left").withColumn("__piece", piece)
    inside = upto(F.get("__pieces", F.col("__piece") - 1))
    bucket = F.when(F.col("__piece") > 0, (F.col("__piece") - 1) * _SIDE + inside).otherwise(F.lit(0))
    return placed.withColumn(_BUCKET, F.coalesce(bucket, F.lit(0))).select(*df.columns, _BUCKET)


def unit_bucket(value: str, buckets: int = 1024, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Monotone bucket of a number; values outside [lo, hi] fall into the end buckets."""
    scaled = F.floor((F.col(value) - F.lit(float(lo))) / F.lit(float(hi) - float(lo)) * buckets)
    return F.least(F.lit(buckets - 1), F.greatest(F.lit(0), scaled))


def text_bucket(value: Column, lowest: Column, highest: Column) -> Column:
    """Monotone bucket of a string from the three characters after the group's common prefix."""
    shared = F.size(
        F.filter(
            F.sequence(F.lit(0), F.length(lowest)),
            lambda i: F.substring(lowest, F.lit(1), i) == F.substring(highest, F.lit(1), i),
        )
    )
    code = lambda k: F.least(F.lit(127), F.ascii(F.substring(value, shared + k, F.lit(1))))
    return code(0) * 16384 + code(1) * 128 + code(2)


def running_sum(df: DataFrame, by, order, sums: dict, bucket: Column, totals: dict | None = None) -> DataFrame:
    """Inclusive running sums of columns within groups.

    ``sums`` maps output names to input columns and ``totals`` maps output names
    to input columns whose group total is wanted. ``bucket`` must not decrease
    along ``order``; each bucket is sorted on its own and offset by the buckets
    before it.
    """
    by, order = list(by), list(order)
    totals = totals or {}
    keyed = _with_key(df, by).withColumn(_BUCKET, bucket)
    inputs = sorted(set(sums.values()) | set(totals.values()))
    per_bucket = keyed.groupBy(_KEY, _BUCKET).agg(*[F.sum(c).alias(f"__sum_{c}") for c in inputs])
    before = Window.partitionBy(_KEY).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(_KEY)
    offsets = per_bucket.select(
        _KEY,
        _BUCKET,
        *[F.coalesce(F.sum(f"__sum_{c}").over(before), F.lit(0)).alias(f"__before_{o}") for o, c in sums.items()],
        *[F.sum(f"__sum_{c}").over(everything).alias(o) for o, c in totals.items()],
    )
    inside = Window.partitionBy(_KEY, _BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = keyed.select("*", *[F.sum(c).over(inside).alias(f"__local_{o}") for o, c in sums.items()])
    out = local.join(offsets, [_KEY, _BUCKET])
    return out.select(
        *df.columns,
        *[(F.col(f"__local_{o}") + F.col(f"__before_{o}")).alias(o) for o in sums],
        *totals,
    )


def positions(df: DataFrame, by, order, bucket: Column, name: str = "position", size: str | None = None) -> DataFrame:
    """Zero-based position of each row within its group and, on request, the group size."""
    counted = df.withColumn("__one", F.lit(1).cast("long"))
    out = running_sum(counted, by, order, {name: "__one"}, bucket, {size: "__one"} if size else None)
    return out.withColumn(name, F.col(name) - 1).drop("__one")


def adjacent_pairs(df: DataFrame, by, order: str, payload, width: int = 4096) -> DataFrame:
    """Pair every row with its predecessor: ``prev_*`` columns next to the row's own.

    Pairs inside a bucket of about ``width`` rows come from a window over the bucket. The first and last
    row of each bucket then meet in a second window that sees only those rows, at most some 2000 of a group.
    """
    by, payload = list(by), list(payload)
    carried = [order, *payload]
    base = order_buckets(df.select(*by, *carried), by, order, width)
    inside = Window.partitionBy(*by, _BUCKET).orderBy(order)
    linked = base.select(
        "*",
        F.lag(F.struct(*carried)).over(inside).alias("__prev"),
        F.lead(order).over(inside).isNull().alias("__last"),
    )
    across = Window.partitionBy(*by).orderBy(order)
    seams = (
        linked.filter(F.col("__prev").isNull() | F.col("__last"))
        .withColumn("__other", F.lag(F.struct(_BUCKET, *carried)).over(across))
        .filter(F.col(f"__other.{_BUCKET}") != F.col(_BUCKET))
        .withColumn("__prev", F.struct(*[F.col(f"__other.{c}").alias(c) for c in carried]))
    )
    shape = [*by, *[F.col(f"__prev.{c}").alias(f"prev_{c}") for c in carried], *carried]
    return linked.filter(F.col("__prev").isNotNull()).select(*shape).unionByName(seams.select(*shape))


def percentiles(df: DataFrame, by, value: str, wanted: dict, lo: float = 0.0, hi: float = 1.0, buckets: int = 4096) -> DataFrame:
    """Exact linear-interpolation percentiles per group; ``wanted`` maps names to fractions.

    A histogram per group says which buckets of ``[lo, hi]`` hold the wanted ranks; only values of those are shuffled and
    sorted, equal ones counted before. At most two buckets per group and fraction are sent to the tasks. ``df`` is read twice.
    """
    by = list(by)
    bucket = unit_bucket(value, buckets, lo, hi).alias(_BUCKET)
    rows = _with_key(df.filter(F.col(value).isNotNull()), by).select(_KEY, value, bucket)
    along = Window.partitionBy(_KEY).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, 0)
    filled = group_counts(rows, [_KEY, _BUCKET]).withColumns(
        {"__upto": F.sum("__n").over(along), "__total": F.sum("__n").over(Window.partitionBy(_KEY))}
    )
    place = {name: (F.col("__total") - 1) * F.lit(float(fraction)) for name, fraction in wanted.items()}

    def holds(rank: Column) -> Column:
        return (F.col("__upto") > rank) & (F.col("__upto") - F.col("__n") <= rank)

    needed = F.lit(False)
    for h in place.values():
        needed = needed | holds(F.floor(h)) | holds(F.ceil(h))
    hits = filled.filter(needed).select(_KEY, _BUCKET, "__total", (F.col("__upto") - F.col("__n")).alias("__before"))
    inside = Window.partitionBy(_KEY, _BUCKET).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = group_counts(rows.join(F.broadcast(hits), [_KEY, _BUCKET]), [_KEY, _BUCKET, "__before", "__total", value]).withColumn(
        "__upto", F.col("__before") + F.sum("__n").over(inside)
    )
    out = []
    for name, h in place.items():
        low, high = (F.max(F.when(holds(rank), F.col(value))) for rank in (F.floor(h), F.ceil(h)))
        out.append((low + (high - low) * F.max(h - F.floor(h))).alias(name))
    return ranked.select("*", *[F.col(f"{_KEY}.{c}").alias(c) for c in by]).groupBy(*by).agg(*out)


def group_counts(df: DataFrame, by, name: str = "__n") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def tiles(df: DataFrame, by, item, size: int) -> DataFrame:
    """Spread each group over block pairs of about ``size`` rows per side.

    Adds ``__ti``, ``__tj`` (tile) and ``__block`` (the side a row is on). A group
    of at most ``size`` rows is one tile. A larger group is hashed into blocks and
    every unordered pair of blocks becomes a tile of its own, so all pairs are
    visited without ever holding the group or listing its pairs. Only larger
    groups are joined back, on a struct key that also matches NULL; the plan is
    the same at every size and nothing runs while it is built.
    """
    keyed = _with_key(df, list(by))
    blocks = F.ceil(F.col("__n") / F.lit(size)).cast("int")
    large = group_counts(keyed, [_KEY]).filter(F.col("__n") > size).select(_KEY, blocks.alias("__blocks"))
    spread = keyed.join(large, _KEY, "left").withColumn("__blocks", F.coalesce("__blocks", F.lit(1)))
    spread = spread.withColumn("__block", F.pmod(F.xxhash64(*item), F.col("__blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))
    return (
        spread.withColumn("__other", other)
        .withColumn("__ti", F.least("__block", "__other"))
        .withColumn("__tj", F.greatest("__block", "__other"))
        .drop(_KEY, "__blocks", "__other")
        .repartition(*by, "__ti", "__tj")
    )


def null_safe(left: DataFrame, right: DataFrame, keys, how: str = "left") -> DataFrame:
    """Join on equal keys, where NULL equals NULL; the right side's keys are dropped."""
    keys = list(keys)
    other = right.select(*[F.col(k).alias(f"__r_{k}") if k in keys else F.col(k) for k in right.columns])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(other, same, how).drop(*[f"__r_{k}" for k in keys])
