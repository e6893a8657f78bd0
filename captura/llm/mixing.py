"""Mixing sources to target weights by Pareto order sampling."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captura.llm.common import materialize, word_count
from captura.operators.grouping import running_sum

MOST = 3.0
BINS = 4096


def source_targets(sizes: DataFrame, most: float = MOST, cycle: int = 3) -> DataFrame:
    """Words wanted of each source, from one row per source (``source, source_size``).

    Sources by code point, null last, weigh 1, 2, ..., ``cycle``, repeating. Shares of all words follow the
    weights; a target stops at ``most`` times its source's size and the excess goes to the others by weight.
    That end state is a level: every target is the smaller of its cap and level x weight, so one pass over
    the sources in order of cap / weight finds it. Windows here see one row per source.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", ((F.row_number().over(place) - 1) % cycle + 1).cast("double"))
    capped = ranked.withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    above = order.rowsBetween(0, Window.unboundedFollowing)
    level = (
        F.sum(F.col("source_size").cast("double")).over(everything)
        - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ) / F.sum("weight").over(above)
    free = capped.withColumn("here", level).withColumn(
        "level", F.min(F.when(F.col("ratio") >= F.col("here"), F.struct("ratio", "here"))).over(everything)["here"]
    )
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return free.select("source", "source_size", target.alias("target"))


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the id and the seed only."""
    text = F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def mix(
    docs: DataFrame, most: float = MOST, cycle: int = 3, seed: int = 17, weight: str | None = None, rounds: int = 8
) -> DataFrame:
    """How many words the mix takes of each document: ``doc_id, source, size, source_size, target, taken, copies, text_hash``.

    A document's expected copies are its source's target over the source's size; with a ``weight`` column
    they are in proportion to it, at most ``most``, with the rest of the source raised in ``rounds`` passes.
    The whole part of them is taken for certain. For the fraction p, documents are ranked by Pareto's
    variable, odds of a random number over odds of p, and taken in that order up to the words that their
    source still lacks: a sample of fixed size. The running sum of words is cut into bins of the rank, so
    that no task sorts a whole source. Random numbers come from the ids, so reruns agree. A null text has
    no words and takes none; null is a source of its own; rows with one id are ranked by size, and equal
    rows are interchangeable.
    """
    w = F.lit(1.0) if weight is None else F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))
    sized = materialize(
        docs.select(
            "doc_id", F.col("source").alias("source"), word_count(F.col("text")).alias("size"), w.alias("w"),
            uniform(F.col("doc_id"), seed).alias("u"), F.xxhash64("text").alias("text_hash"),
        ),
        "sizes",
    )
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(totals, most, cycle), "targets")

    def with_source(rows: DataFrame, per_source: DataFrame) -> DataFrame:
        right = per_source.withColumnRenamed("source", "__source")
        return rows.join(right, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")

    rows = with_source(sized, targets)
    if weight is None:
        expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    else:
        levels = targets.select("source", F.lit(0.0).alias("c"))
        for _ in range(rounds):
            held = (F.col("c") * F.col("w") >= most) & (F.col("w") > 0)
            open_ = F.sum(F.when(held, 0.0).otherwise(F.col("w") * F.col("size")))
            fixed = F.sum(F.when(held, most * F.col("size")).otherwise(0.0))
            per = with_source(rows, levels).groupBy("source", "target").agg(open_.alias("o"), fixed.alias("f"), F.max("c").alias("was"))
            levels = materialize(
                per.select("source", F.when(F.col("o") > 0, (F.col("target") - F.col("f")) / F.col("o")).otherwise(F.col("was")).alias("c")),
                "levels",
            )
        rows = with_source(rows, levels)
        expected = F.least(F.lit(most), F.col("c") * F.col("w"))
    rows = rows.withColumn("expected", F.least(F.lit(most), expected)).withColumn("sure", F.floor("expected"))
    p = F.col("expected") - F.col("sure")
    odds = (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))
    drawn = rows.withColumn("q", F.when(p > 0, odds)).withColumn("surely", F.col("sure") * F.col("size"))
    drawn = drawn.withColumn("pool", F.when(F.col("q").isNotNull(), F.col("size")).otherwise(F.lit(0)).cast("long"))
    place = F.when(F.col("q").isNull(), F.lit(BINS)).otherwise(F.floor(F.col("q") / (1 + F.col("q")) * BINS))
    ranked = running_sum(
        drawn, ["source"], ["q", "doc_id", "size"], {"upto": "pool"}, place, {"surely_all": "surely"}
    )
    lacking = F.col("target") - F.col("surely_all")
    extra = F.col("q").isNotNull() & (F.col("upto") - F.col("pool") / 2 <= lacking)
    copies = (F.col("sure") + F.when(extra, 1).otherwise(0)).cast("int")
    return ranked.select(
        "doc_id", "source", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"),
        copies.alias("copies"), "text_hash",
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    (CAST('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT)::DOUBLE + 0.5e0)
      / 4503599627370496e0 AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3e0 * source_size AS cap, (3e0 * source_size) / weight AS ratio FROM (SELECT *,
    CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM s)),
l AS (SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
      / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS here FROM w),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(here, ratio) FROM l AS x WHERE x.ratio >= x.here)
        * weight, cap)) AS target FROM l),
e AS (SELECT d.*, source_size, target,
    least(3e0, CASE WHEN source_size > 0 THEN target / source_size ELSE 0e0 END) AS expected
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, floor(expected) AS sure, CASE WHEN expected - floor(expected) > 0 THEN (u / (1 - u))
    / ((expected - floor(expected)) / (1 - (expected - floor(expected)))) END AS q FROM e),
r AS (SELECT *, CASE WHEN q IS NULL THEN 0 ELSE size END AS pool, sum(CASE WHEN q IS NULL THEN 0 ELSE size END)
    OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto,
    sum(sure * size) OVER (PARTITION BY source) AS surely FROM q)
SELECT doc_id, size, source_size, target,
  CAST((sure + CASE WHEN q IS NOT NULL AND upto - pool / 2e0 <= target - surely THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM r
"""
