"""Mean similarity over all ordered frame pairs of a field, without listing the pairs.

Similarity only looks at the canonical form of a value. Distinct values are cut into
tiles and frames into order buckets: pairs within a bucket are one unit of work, pairs across
buckets come from one count per bucket and value. A unit rates each pair of values once.
"""

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from captura.functions.sequences import pair_similarity
from captura.functions.text import alphanumeric, canonical, levenshtein_similarity, strip
from captura.operators.grouping import order_buckets, tiles
from captura.operators.shared import written

TILE_VALUES = 128
BUCKET_ROWS = 4096
SMALL = 64  # rows of a unit whose pairs are enumerated; a larger unit counts pairs of values


def string_similarity(pairs: DataFrame, a: str, b: str, metric: str = "ratio", name: str = "similarity") -> DataFrame:
    """Add the similarity of two text columns.

    Shortcuts are plain expressions. Only the distinct pairs that no shortcut
    settles reach Python (metric ``ratio``); ``levenshtein`` never does.
    """
    left, right = canonical(F.col(a)), canonical(F.col(b))
    prepared = pairs.withColumns({"__a": left, "__b": right})
    plain_a, plain_b = alphanumeric(F.col("__a")), alphanumeric(F.col("__b"))
    shortcut = (
        F.when(F.col(a).isNull() & F.col(b).isNull(), F.lit(1.0))
        .when(F.col(a).isNull() | F.col(b).isNull(), F.lit(0.0))
        .when(F.col("__a") == F.col("__b"), F.lit(1.0))
        .when((plain_a != "") & (plain_a == plain_b), F.lit(1.0))
    )
    if metric == "levenshtein":
        value = F.coalesce(shortcut, levenshtein_similarity(F.col("__a"), F.col("__b")))
        return prepared.withColumn(name, value).drop("__a", "__b")
    settled = prepared.withColumn("__known", shortcut)
    open_pairs = settled.filter(F.col("__known").isNull()).select("__a", "__b").distinct()

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(pair_similarity(x.tolist(), y.tolist()), dtype="float64")

    rated = open_pairs.withColumn("__ratio", ratio("__a", "__b"))
    joined = settled.join(rated, ["__a", "__b"], "left")
    return joined.withColumn(name, F.coalesce("__known", "__ratio")).drop("__a", "__b", "__known", "__ratio")


def _rated(values: list[str], plain: list[str], first: np.ndarray, second: np.ndarray, metric: str) -> np.ndarray:
    """Similarity of pairs of numbered values, each distinct pair rated once."""
    codes, back = np.unique(first * len(values) + second, return_inverse=True)
    a, b = codes // len(values), codes % len(values)
    form = np.unique(np.array(plain, dtype=object).astype(str), return_inverse=True)[1] if plain else np.zeros(0, int)
    filled = np.array([p != "" for p in plain], bool)
    out = np.ones(len(codes))
    open_ = np.flatnonzero((a != b) & ~((form[a] == form[b]) & filled[a]))
    out[open_] = pair_similarity([values[k] for k in a[open_]], [values[k] for k in b[open_]], metric)
    return out[back]


@lru_cache(maxsize=SMALL + 1)
def _triangle(n: int):
    return np.triu_indices(n, 1)


def _unit_pairs(code: np.ndarray, place: np.ndarray, weight: np.ndarray, side: np.ndarray, across: bool):
    """Value pairs (earlier, later) of one unit with their number of frame pairs; rows come in order of ``place``."""
    if len(code) <= SMALL:
        i, j = _triangle(len(code))
        use = place[i] < place[j]
        if across:
            use &= side[i] != side[j]
        i, j = i[use], j[use]
        return code[i], code[j], weight[i] * weight[j]
    values, local = np.unique(code, return_inverse=True)
    sides = np.zeros(len(values), side.dtype)
    sides[local] = side
    number = np.zeros((len(values), len(values)))
    before = np.zeros(len(values))
    starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    step = max(1, (1 << 20) // len(values))
    for lo in range(0, len(starts), step):
        # Running counts of a slice of places; what a place adds counts from the next place on.
        hi = min(lo + step, len(starts))
        a, b = starts[lo], starts[hi] if hi < len(starts) else len(code)
        at = np.searchsorted(starts[lo:hi], np.arange(a, b), side="right") - 1
        added = np.zeros((hi - lo, len(values)))
        np.add.at(added, (at, local[a:b]), weight[a:b])
        upto = np.cumsum(added, axis=0) - added + before
        number += upto.T @ added
        before = before + added.sum(axis=0)
    u, w = np.nonzero(number)
    use = sides[u] != sides[w] if across else np.ones(len(u), bool)
    return values[u[use]], values[w[use]], number[u[use], w[use]]


def _units(batches, keys, metric: str):
    """Similarity sums of the units in sorted rows; a unit may go on in the next batch."""
    def results(table: pa.Table, starts: np.ndarray):
        words = table.column("__c").combine_chunks().dictionary_encode()
        words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
        code, values = np.asarray(words.indices, np.int64), words.dictionary.to_pylist()
        plain_of = dict(zip(code.tolist(), table.column("__p").to_pylist()))
        plain = [plain_of[k] for k in range(len(values))]
        place, weight, side = (np.asarray(table.column(c)) for c in ("__place", "__m", "__block"))
        across = np.asarray(table.column("__ti")) != np.asarray(table.column("__tj"))
        bounds, parts = np.append(starts, table.num_rows), []
        for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            if b - a > 1:
                first, second, number = _unit_pairs(code[a:b], place[a:b], weight[a:b], side[a:b], bool(across[a]))
                parts.append((np.full(len(first), k), first, second, number))
        total = np.zeros(len(starts))
        if parts:
            unit, first, second, number = (np.concatenate(x) for x in zip(*parts))
            np.add.at(total, unit, number * _rated(values, plain, first, second, metric))
        where = pa.array(starts)
        return pa.RecordBatch.from_arrays([*[table.column(k).combine_chunks().take(where) for k in keys], pa.array(total)], [*keys, "total"])

    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if not rows.num_rows:
            continue
        change = np.zeros(rows.num_rows, bool)
        change[0] = True
        for k in [*keys, "__ti", "__tj", "__part"]:
            coded = rows.column(k).combine_chunks().dictionary_encode("encode")
            codes = np.asarray((coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded).indices)
            change[1:] |= codes[1:] != codes[:-1]
        starts = np.flatnonzero(change)
        if len(starts) > 1:
            yield results(rows.slice(0, starts[-1]), starts[:-1])
        held = rows.slice(starts[-1])
    if held is not None and held.num_rows:
        yield results(held, np.zeros(1, np.int64))


def mean_ordered_similarity(
    rows: DataFrame,
    keys,
    order: str,
    value: str,
    metric: str = "ratio",
    tile_values: int = TILE_VALUES,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Mean similarity over all frame pairs of each group, the earlier frame first; blanks are left out.

    Groups with at most one distinct value give 1.0. The values are written once, since their extraction is the
    dearest step. The distinct values of a group are cut into tiles of ``tile_values`` a side and its frames into
    buckets of about ``bucket_rows`` (:func:`order_buckets`). A unit (tile, bucket) sums over the frame pairs within; one
    more unit per tile sums over pairs across buckets from counts per bucket and value. So a group of
    two values and many frames is many units, and no pair of frames or values leaves a task. NULL keys are groups of their own.
    Frames of one group with one order value count in order of their canonical values. A group of at most
    ``tile_values`` values is one unit without buckets, tiles and their joins (:func:`_small_groups`).
    """
    keys = list(keys)
    filled = rows.filter(F.col(value).isNotNull() & (strip(F.col(value)) != ""))
    parsed = filled.select(*keys, F.col(order).alias("__f"), canonical(F.col(value)).alias("__c"))
    counted = written(parsed.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys))), "values")
    few = min(tile_values, bucket_rows)
    large = _large_groups(counted.filter(F.col("__n") > few).drop("__n"), dict(rows.dtypes), keys, metric, tile_values, bucket_rows)
    return _small_groups(counted.filter(F.col("__n") <= few), dict(rows.dtypes), keys, metric).unionByName(large)


def _small_groups(counted: DataFrame, types: dict, keys, metric: str) -> DataFrame:
    """Groups whose rows all meet in one unit, in the order of their frames."""
    ordered = counted.repartition(*keys).sortWithinPartitions(*keys, "__f", "__c")
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", __n long, total double"

    def search(batches):
        def units():
            count = 0
            for batch in batches:
                zeros = np.zeros(batch.num_rows, np.int64)
                added = {k: zeros for k in ("__ti", "__tj", "__block", "__part")} | {"__place": count + np.arange(batch.num_rows), "__m": zeros + 1.0}
                count += batch.num_rows
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(v) for v in added.values()]], [*batch.schema.names, *added])

        return _units(units(), [*keys, "__n"], metric)

    plain = alphanumeric(F.col("__c")).alias("__p")
    sums = ordered.select(*keys, "__n", "__c", plain).mapInArrow(search, schema)
    mean = F.when(F.col("__n") > 1, F.col("total") / (F.col("__n") * (F.col("__n") - 1) / 2)).otherwise(F.lit(1.0))
    return sums.select(*keys, mean.alias("mean_similarity"))


def _large_groups(parsed: DataFrame, types: dict, keys, metric: str, tile_values: int, bucket_rows: int) -> DataFrame:
    seen = order_buckets(parsed, keys, "__f", bucket_rows).withColumn("__g", F.struct(*keys)).drop(*keys)
    cells = seen.groupBy("__g", "__bucket", "__c").agg(F.count(F.lit(1)).alias("__m"))
    counts = parsed.groupBy(F.struct(*keys).alias("__g"), "__c").agg(F.count(F.lit(1)).alias("__m"))
    sizes = counts.groupBy("__g").agg(F.sum("__m").alias("n"), F.count(F.lit(1)).alias("d"))
    several = counts.join(sizes.filter("d > 1").select("__g"), "__g", "left_semi").select("__g", "__c")
    placed = tiles(several, ["__g"], ["__c"], tile_values)
    split = cells.filter("__bucket > 0").select("__g").distinct()
    columns = ["__g", "__ti", "__tj", "__block", "__c", "__part", "__place", "__m"]
    part = F.struct("__f", "__c").alias("__at")
    within = seen.join(placed, ["__g", "__c"]).select(
        "__g", "__ti", "__tj", "__block", "__c", F.col("__bucket").cast("long").alias("__part"), part, F.lit(None).cast("long").alias("__place"), F.lit(1.0).alias("__m")
    )
    between = cells.join(split, "__g", "left_semi").join(placed, ["__g", "__c"])
    between = between.select(
        "__g", "__ti", "__tj", "__block", "__c", F.lit(-1).cast("long").alias("__part"),
        F.struct(F.lit(None).cast(dict(parsed.dtypes)["__f"]).alias("__f"), "__c").alias("__at"), F.col("__bucket").cast("long").alias("__place"), F.col("__m").cast("double").alias("__m"),
    )
    ordered = within.unionByName(between).repartition("__g", "__ti", "__tj", "__part").sortWithinPartitions("__g", "__ti", "__tj", "__part", "__place", "__at")
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", total double"

    def search(batches):
        def numbered():
            # Frames of a bucket take part one by one, buckets as a whole.
            count = 0
            for batch in batches:
                place = np.asarray(pa.compute.fill_null(batch.column("__place"), -1), np.int64)
                single = np.asarray(batch.column("__part")) >= 0
                place = np.where(single, count + np.arange(batch.num_rows), place)
                count += batch.num_rows
                at = batch.schema.get_field_index("__place")
                yield batch.set_column(at, "__place", pa.array(place))

        return _units(numbered(), keys, metric)

    plain = alphanumeric(F.col("__c")).alias("__p")
    sums = ordered.select(*[F.col(f"__g.{k}").alias(k) for k in keys], *columns[1:], plain).mapInArrow(search, schema)
    totals = sums.groupBy(F.struct(*keys).alias("__g")).agg(F.sum("total").alias("total"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    mean = F.when(F.col("total").isNotNull(), F.col("total") / F.greatest(pairs, F.lit(1)))
    joined = sizes.join(totals, "__g", "left")
    return joined.select(*[F.col(f"__g.{k}").alias(k) for k in keys], F.coalesce(mean, F.lit(1.0)).alias("mean_similarity"))
