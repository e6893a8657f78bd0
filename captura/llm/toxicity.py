"""Toxic passages: maximum-scoring segments of token log-odds, calibrated by extreme values."""

import math
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captura.llm.common import crc_fold, portions, worker_state

WORDS = re.compile(r"[^\W\d_]+")
SHORTEST, LONGEST = 3, 12
PRIOR = 4.0
DRIFT = 0.7
SURE = 1e-6


def units_of(word: str) -> list[str]:
    """A word and its leading parts from short to long; the whole word ends in a mark."""
    return [word[:k] for k in range(SHORTEST, min(len(word), LONGEST) + 1)] + [word + "$"]


def log_odds(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Log-odds of each unit against those of all units, under Dirichlet priors.

    A unit's prior is the estimate for the next shorter part of the word, worth ``PRIOR`` observations, and that
    of the shortest is the share of toxic units overall.
    """
    base = (toxic + 1) / (toxic + clean + 2)
    share = {}
    for unit in sorted(counts, key=lambda u: len(u.rstrip("$")) * 2 + u.endswith("$")):
        stem = unit[:-1][:LONGEST]
        while stem and stem not in share:
            stem = stem[:-1]
        a, b = counts[unit]
        value = (a + PRIOR * share.get(stem, base)) / (a + b + PRIOR)
        share[unit] = min(max(value, SURE), 1 - SURE)
    return {u: math.log(s / (1 - s)) - math.log(base / (1 - base)) for u, s in share.items()}


class Scores(dict):
    """Score of each word: the log-odds of its longest known part, less the drift."""

    def __init__(self, odds: dict[str, float], limit: int = 250_000):
        super().__init__()
        self.odds, self.limit = odds, limit

    def __missing__(self, word: str) -> float:
        if len(self) > self.limit:
            self.clear()
        odds = self.odds.get(word + "$")
        k = min(len(word), LONGEST)
        while odds is None and k >= SHORTEST:
            odds, k = self.odds.get(word[:k]), k - 1
        self[word] = value = (odds or 0.0) - DRIFT
        return value


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score) in linear time (Ruzzo and Tompa, 1999).

    Runs of positive scores enter as one item. A candidate remembers the last one before it with a lower
    running total, so searching back skips what was searched before.
    """
    positive = scores > 0
    if not positive.any():
        return []
    edges = np.flatnonzero(np.diff(np.concatenate([[0], positive.view(np.int8), [0]])))
    total = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[list] = []
    for first, end in edges.reshape(-1, 2).tolist():
        low, high = float(total[first]), float(total[end])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                found.append([first, end, low, high, j])
                break
            first, low = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, high - low) for a, b, low, high, _ in found]


def karlin(values: np.ndarray, shares: np.ndarray) -> float:
    """The positive solution of sum(share x exp(lambda x value)) = 1 for scores that fall on average."""
    values, shares = values[shares > 0], shares[shares > 0]
    if not len(values) or values.max() <= 0 or (values * shares).sum() >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    while (shares * np.exp(np.minimum(high * values, 700))).sum() < 1:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (shares * np.exp(np.minimum(mid * values, 700))).sum() < 1 else (low, mid)
    return (low + high) / 2


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.diag([1e-6] + [1.0] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def evidence(segments: list[tuple[int, int, float]], n: int, lam: float, log_k: float) -> tuple[float, float]:
    """Of a text with n words: the best segment's and all segments' excess over what chance gives, in nats."""
    excess = [max(0.0, lam * s - log_k - math.log(max(n, 1))) for _, _, s in segments]
    return max(excess, default=0.0), sum(excess)


def _training(docs: DataFrame, labels: DataFrame, rows: int, seed: int) -> DataFrame:
    """At most about ``rows`` labelled documents outside the held-out fold, by the hash of their ids."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(crc_fold(F.col("doc_id"), 3) != 1)
    share = min(1.0, rows / max(1, known.count()))
    place = (F.xxhash64("doc_id", F.lit(seed)).cast("double") / 2.0**64) + 0.5
    chosen = known.filter(place < share).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(3)))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def train(
    docs: DataFrame, labels: DataFrame, rows: int = 20_000, units: int = 200_000, least: int = 3, seed: int = 5
) -> dict:
    """Fit the token log-odds and their calibration on a bounded sample of labelled documents.

    ``rows`` bounds the documents (and with them the broadcast of their ids), ``units`` the table of log-odds. Two
    thirds of the sample count in which documents units occur; the last third calibrates on texts that
    the table has not seen: Karlin's lambda from the scores of clean words, K from the medians of
    clean texts, and a logistic curve over each text's evidence.
    """
    spark = docs.sparkSession
    sample = _training(docs, labels, rows, seed)

    def count(batches):
        counts = {}

        def flush():
            table = pa.RecordBatch.from_arrays(
                [pa.array(list(counts)), *[pa.array([c[k] for c in counts.values()], pa.int64()) for k in (0, 1)]],
                ["unit", "toxic", "clean"],
            )
            counts.clear()
            return table

        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                for word in set(WORDS.findall((text or "").lower())):
                    for unit in units_of(word):
                        counts.setdefault(unit, [0, 0])[0 if toxic else 1] += 1
                if len(counts) > 300_000:
                    yield flush()
        if counts:
            yield flush()

    counted = (
        sample.filter("half < 2").select("text", "toxic").mapInArrow(count, "unit string, toxic long, clean long")
        .groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )
    often = counted.filter(F.col("toxic") + F.col("clean") >= least)
    best = often.orderBy(F.desc(F.greatest(F.col("toxic") * 10, "clean")), "unit").limit(units).collect()
    counts = {r["unit"]: (r["toxic"], r["clean"]) for r in best}
    whole = [c for u, c in counts.items() if u.endswith("$")]
    odds = log_odds(counts, sum(a for a, _ in whole), sum(b for _, b in whole))
    shared = spark.sparkContext.broadcast(odds)

    def measure(batches):
        table = Scores(shared.value)
        for batch in batches:
            out = {k: [] for k in ("n", "scores", "segments", "toxic")}
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                words = WORDS.findall((text or "").lower())
                s = np.fromiter(map(table.__getitem__, words), float, len(words))
                out["n"].append(len(s))
                out["scores"].append(np.bincount(np.clip((s + 10) * 4, 0, 99).astype(int), minlength=100) if not toxic else None)
                out["segments"].append([x for _, _, x in maximal_segments(s)])
                out["toxic"].append(int(toxic))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(out["n"], pa.int64()), pa.array(out["scores"], pa.list_(pa.int64())),
                    pa.array(out["segments"], pa.list_(pa.float64())), pa.array(out["toxic"], pa.int64()),
                ],
                list(out),
            )

    schema = "n long, scores array<long>, segments array<double>, toxic long"
    seen = sample.filter("half = 2").select("text", "toxic").mapInArrow(measure, schema)
    rows_ = [r.asDict() for r in seen.selectExpr("n", "scores", "array_sort(filter(segments, x -> x > 0.5)) AS segments", "toxic").collect()]
    y = np.array([r["toxic"] for r in rows_], float)
    if not len(y) or y.min() == y.max():
        return {"odds": shared, "lambda": 1.0, "log_k": 0.0, "curve": None, "prior": float(y.mean()) if len(y) else 0.0}
    clean = [r for r in rows_ if not r["toxic"]]
    shares = np.sum([r["scores"] for r in clean], axis=0).astype(float)
    lam = karlin((np.arange(100) + 0.5) / 4 - 10, shares / max(1.0, shares.sum()))
    tops = [lam * max(r["segments"], default=0.0) - math.log(max(r["n"], 1)) for r in clean]
    log_k = float(np.median(tops)) + math.log(math.log(2))
    x = np.array([evidence([(0, 0, s) for s in r["segments"]], r["n"], lam, log_k) for r in rows_])
    return {"odds": shared, "lambda": lam, "log_k": log_k, "curve": _logistic(np.log1p(x), y), "prior": float(y.mean())}


def toxic_passages(docs: DataFrame, model: dict) -> DataFrame:
    """``doc_id, score, passages``: probability of each text and its significant segments.

    A passage has the number of its first word, the one after its last, its score and its E-value, the number of
    such segments that a clean text of that length has by chance. Null and empty texts have none.
    """
    shared, lam, log_k, curve, prior = (model[k] for k in ("odds", "lambda", "log_k", "curve", "prior"))
    key = uuid.uuid4().hex

    def score(batches):
        state = worker_state()
        if state.get("toxicity", (None,))[0] != key:
            state["toxicity"] = (key, Scores(shared.value))
        table = state["toxicity"][1]
        for batch in batches:
            for part in portions(batch, "text"):
                scores, passages = [], []
                for text in part.column("text").to_pylist():
                    words = WORDS.findall((text or "").lower())
                    s = np.fromiter(map(table.__getitem__, words), float, len(words))
                    segments = [x for x in maximal_segments(s) if x[2] > 0.5]
                    if curve is None:
                        scores.append(prior)
                    else:
                        x = np.log1p(np.array([1.0, *evidence(segments, len(s), lam, log_k)]))
                        x[0] = 1.0
                        scores.append(float(1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))))
                    rows = []
                    for a, b, high in segments:
                        e = math.exp(min(50.0, log_k + math.log(max(len(s), 1)) - lam * high))
                        if e < 0.05:
                            rows.append({"first": a, "end": b, "score": high, "e_value": e})
                    passages.append(rows)
                kind = pa.list_(
                    pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())])
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(scores, pa.float64()), pa.array(passages, kind)],
                    ["doc_id", "score", "passages"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    passage = "array<struct<first: bigint, end: bigint, score: double, e_value: double>>"
    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double, passages {passage}")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, rows: int = 20_000) -> DataFrame:
    """Scores of all rows by a model of the labels outside the held-out fold.

    Returns ``doc_id, held_out, score, predicted, n_passages``. Rows of ``labels`` with a null id or label teach nothing, and
    of repeated ids the greater label counts. Without both labels every score is the share of label 1.
    Repeated documents score alike; a null doc_id is in no held-out fold but 0.
    """
    scored = toxic_passages(docs, train(docs, labels, rows))
    return scored.select(
        "doc_id",
        (crc_fold(F.col("doc_id"), 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )
