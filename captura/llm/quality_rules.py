"""Quality rules by robust multivariate outliers: minimum covariance determinant per language and source."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from captura.llm.common import materialize, portions, small, worker_state
from captura.llm.words import hash_table, hashes_of, window_hashes

SYMBOLS = "#*$%&|<>"
#: Transformed statistics with their least spread: a statistic that is constant in clean text gets this deviation.
#: That of a bounded one is small enough to reject alone: 0.38 of the lines or words where clean text has none.
STATISTICS = {"word_length": 0.05, "symbols": 0.05, "signs": 0.15, "capitals": 0.25, "dup_lines": 0.08, "repeats": 0.08}
UNIT = 1024  # statistics are whole multiples of 1 / UNIT, so that sums are exact in any order
LEAST_ROWS = 50
COVERAGE = 0.75
STEPS = 6
ALPHA = 1e-3  # of the law that has the median of the stratum's own distances
BINS_PER_E = 50


def chi2_cdf(x: float, k: float) -> float:
    """Chi-square distribution by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= z / n
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi2_quantile(p: float, k: float) -> float:
    low, high = 0.0, 1.0
    while chi2_cdf(high, k) < p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


def _classes() -> np.ndarray:
    """Class of each character of the basic plane: 1 small or caseless letter, 2 capital, 3 digit, 4 sign, 0 white."""
    state = worker_state()
    if "classes" not in state:
        kinds = [1 if c.isalpha() else 3 if c.isnumeric() else 0 if c.isspace() else 4 for c in map(chr, range(65536))]
        for i in range(65536):
            if kinds[i] == 1 and chr(i).isupper():
                kinds[i] = 2
        state["classes"] = np.array(kinds, np.uint8)
    return state["classes"]


def text_statistics(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, letters, capitals, signs, lines with a word."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    windows = window_hashes(hashes_of(words, hash_table()), 3)
    repeated = 0
    if len(windows):
        _, code, count = np.unique(windows, return_inverse=True, return_counts=True)
        twice = np.flatnonzero(count[code] > 1)
        mark = np.zeros(n, bool)
        for k in range(3):
            mark[twice + k] = True
        repeated = int(mark.sum())
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kinds = np.bincount(_classes()[np.minimum(codes, 65535)], minlength=5)
    return (
        n, chars, symbols, len(lines) - len(set(lines)), repeated,
        int(kinds[1] + kinds[2]), int(kinds[2]), int(kinds[4]), len(lines),
    )


def document_statistics(docs: DataFrame) -> DataFrame:
    """Counts of every text, the base rule and the transformed statistics in whole units."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "letters", "capitals_n", "signs_n", "lines"]

    def count(batches):
        for batch in batches:
            for part in portions(batch, "text"):
                rows = np.array([text_statistics(t) for t in part.column("text").to_pylist()], np.int64)
                kept = [part.column(c) for c in ("doc_id", "lang", "source", "text_hash")]
                yield pa.RecordBatch.from_arrays(
                    [*kept, *[pa.array(rows[:, k]) for k in range(len(names))]],
                    ["doc_id", "lang", "source", "text_hash", *names],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, lang string, source string, text_hash long, " + ", ".join(f"{n} long" for n in names)
    rows = docs.select("doc_id", "lang", "source", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(count, schema)
    words = F.greatest("n_words", F.lit(1))
    values = {
        "word_length": F.log(F.greatest("word_chars", F.lit(1)) / words),
        "symbols": F.sqrt(F.col("n_symbols") / words),
        "signs": F.log((F.col("signs_n") + 1) / (F.greatest("word_chars", F.lit(1)) + 40)),
        "capitals": F.log((F.col("capitals_n") + 1) / (F.col("letters") + 60)),
        "dup_lines": F.col("n_dup_lines") / F.greatest("lines", F.lit(1)),
        "repeats": F.col("n_repeat_words") / words,
    }
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select(
        "doc_id", "lang", "source", "text_hash", *names[:5], failed.alias("base_failed"),
        *[F.round(values[v] * UNIT).cast("long").alias(v) for v in STATISTICS],
    )


def strata(rows: DataFrame, least: int) -> DataFrame:
    """Stratum of every language and source: their own, else what is left of the language, else of the corpus."""
    counts = rows.filter("NOT base_failed").groupBy("lang", "source").agg(F.count("lang").alias("x"), F.count(F.lit(1)).alias("n"))
    by_lang = Window.partitionBy("lang")
    left = F.sum(F.when(F.col("n") < least, F.col("n")).otherwise(0)).over(by_lang)
    level = F.when(F.col("n") >= least, 0).when(left >= least, 1).otherwise(2)
    return counts.withColumn("level", level).select(
        "lang", "source",
        F.struct(
            "level",
            F.when(F.col("level") < 2, F.col("lang")).alias("lang"),
            F.when(F.col("level") < 1, F.col("source")).alias("source"),
        ).alias("stratum"),
    )


def _distance(prefix: str = "fit") -> "F.Column":
    """Squared Mahalanobis distance from the columns of the statistics and a fit's centre and precision."""
    names, p = list(STATISTICS), len(STATISTICS)
    d = [F.col(n) / float(UNIT) - F.col(f"{prefix}.centre")[i] for i, n in enumerate(names)]
    terms = [
        F.col(f"{prefix}.precision")[i * p + j] * d[i] * d[j] * (1.0 if i == j else 2.0) for i in range(p) for j in range(i, p)
    ]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def _fits(sums: DataFrame) -> DataFrame:
    """Centre and precision of each stratum from the sums of its chosen rows."""
    names, p = list(STATISTICS), len(STATISTICS)
    spread, coverage = np.array(list(STATISTICS.values())), COVERAGE
    quantile = chi2_quantile(coverage, p)
    consistency = coverage / chi2_cdf(quantile, p + 2)

    def fit(batches):
        for batch in batches:
            centres, precisions = [], []
            for row in batch.select(["n", "firsts", "seconds"]).to_pylist():
                n = row["n"]
                mean = np.array(row["firsts"], float) / n
                second = np.zeros((p, p))
                second[np.triu_indices(p)] = np.array(row["seconds"], float) / n
                cov = (second + np.triu(second, 1).T - np.outer(mean, mean)) / UNIT**2 * consistency
                cov += np.diag(np.maximum(0, spread**2 - np.diag(cov)))
                centres.append((mean / UNIT).tolist())
                precisions.append(np.linalg.inv(cov).ravel().tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("stratum"), pa.array(centres, pa.list_(pa.float64())), pa.array(precisions, pa.list_(pa.float64()))],
                ["stratum", "centre", "precision"],
            )

    stratum = sums.schema["stratum"].dataType.simpleString()
    made = sums.mapInArrow(fit, f"stratum {stratum}, centre array<double>, precision array<double>")
    return materialize(made.select("stratum", F.struct("centre", "precision").alias("fit")), "fits")


def _sums(rows: DataFrame) -> DataFrame:
    names = list(STATISTICS)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    return rows.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(n) for n in names]).alias("firsts"),
        F.array(*[F.sum(F.col(a) * F.col(b)) for a, b in pairs]).alias("seconds"),
    )


def _nearest(rows: DataFrame, place) -> DataFrame:
    """The ``COVERAGE`` share of each stratum with the least value of a whole-number place, ties included."""
    placed = rows.withColumn("place", place)
    counts = placed.groupBy("stratum", "place").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("stratum").orderBy("place"))
    total = F.sum("c").over(Window.partitionBy("stratum"))
    cut = counts.withColumn("upto", upto).withColumn("total", total).filter(F.col("upto") >= F.col("total") * COVERAGE)
    cut = materialize(cut.groupBy("stratum").agg(F.min("place").alias("cut"), F.max("total").alias("total")), "cuts")
    return placed.join(small(cut), "stratum").filter("place <= cut").drop("place", "cut", "total")


def _limits(rows: DataFrame, alpha: float) -> DataFrame:
    """Rows of each stratum and its limit: the quantile of 1 - ``alpha``, scaled where all rows' median distance is larger than the law's."""
    p = len(STATISTICS)
    counts = rows.groupBy("stratum", F.floor(F.log(_distance() + 1e-6) * BINS_PER_E).alias("place")).agg(F.count(F.lit(1)).alias("c"))
    over = Window.partitionBy("stratum")
    ranked = counts.withColumn("upto", F.sum("c").over(over.orderBy("place"))).withColumn("members", F.sum("c").over(over))
    middle = F.exp((F.min("place") + 0.5) / BINS_PER_E) / chi2_quantile(0.5, p)
    limit = F.greatest(F.lit(1.0), middle) * chi2_quantile(1 - alpha, p)
    return ranked.filter("2 * upto >= members").groupBy("stratum").agg(F.max("members").alias("members"), limit.alias("limit"))


def _medians(rows: DataFrame) -> DataFrame:
    """Median and spread of every statistic by stratum, from counts of its whole values."""
    out = None
    for name in STATISTICS:
        value = F.col(name)
        counts = rows.groupBy("stratum", value.alias("v")).agg(F.count(F.lit(1)).alias("c"))
        over = Window.partitionBy("stratum")
        ranked = counts.withColumn("upto", F.sum("c").over(over.orderBy("v"))).withColumn("all", F.sum("c").over(over))
        at = lambda q: F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("v")))
        one = ranked.groupBy("stratum").agg(F.struct(at(0.5).alias("m"), (at(0.75) - at(0.25)).alias("s")).alias(f"{name}_q"))
        out = one if out is None else out.join(one, "stratum")
    return materialize(out, "medians")


def quality_verdicts(docs: DataFrame, least: int = LEAST_ROWS, steps: int = STEPS, alpha: float = ALPHA) -> DataFrame:
    """Counts, base rule and verdict of every row.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance,
    text_hash``. Rows that pass the base rule are fitted by language and source; a pair with fewer than
    ``least`` of them joins what is left of its language, then of the corpus, and if that is still too
    small they are kept. The fit starts from medians and quartiles, takes the ``COVERAGE`` share of rows
    nearest to it and concentrates: centre and covariance of those rows, then the nearest rows again, ``steps``
    times. A row is rejected when its squared distance exceeds the chi-square quantile of 1 - ``alpha``, times the
    ratio of the median distance of all the stratum's rows to the law's where that is over 1 (heavy tails).
    Sums are over whole numbers and cuts over counts, so the verdict does not depend on partitions.
    Null texts have no words and fail the base rule; null languages and sources are groups of their own;
    repeated rows count each; further columns are not read.
    """
    rows = materialize(document_statistics(docs), "statistics")
    named = small(materialize(strata(rows, least), "strata"))
    named = named.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), "stratum")
    same = F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source"))
    rows = rows.join(named, same, "left").drop("__lang", "__source")
    judged = rows.filter("NOT base_failed").select("stratum", *STATISTICS)
    start = judged.join(small(_medians(judged)), "stratum")
    far = sum(
        (
            F.pow((F.col(n) - F.col(f"{n}_q.m")) / F.greatest(F.col(f"{n}_q.s") / 1.349, F.lit(UNIT * s)), 2)
            for n, s in STATISTICS.items()
        ),
        F.lit(0.0),
    )
    bins = lambda d: F.floor(F.log(d + 1e-6) * BINS_PER_E)
    fits = _fits(_sums(_nearest(start, bins(far))))
    for _ in range(steps):
        fits = _fits(_sums(_nearest(judged.join(small(fits), "stratum"), bins(_distance()))))
    limits = materialize(_limits(judged.join(small(fits), "stratum"), alpha), "limits")
    final = small(materialize(fits.join(limits, "stratum"), "fits"))
    distance = F.when(~F.col("base_failed") & (F.col("members") >= least), _distance())
    return rows.join(final, "stratum", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(distance <= F.col("limit"), F.lit(True))).alias("kept"),
        distance.alias("distance"), "text_hash",
    )
