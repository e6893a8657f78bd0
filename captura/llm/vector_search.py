"""Exact k nearest vectors by inner product: branch and bound over blocks of dimensions in vertical layout.

Vectors are quantised and written once as chunks that hold one array per block of dimensions. Queries travel as
slabs of bounded size, one broadcast at a time; a task walks the chunks of its partition and keeps for each query
of the slab its best so far. Scores are accumulated block by block, heaviest first. What a
candidate can still gain is at most the product of the lengths of both rests (Cauchy-Schwarz), so candidates whose bound
is below the k-th best score known, or the k-th best score surely reached in this chunk, leave and the arrays of
the others are compacted. Only the best of each task meet in a shuffle.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from captura.llm.common import materialize

BLOCK = 8  # dimensions accumulated between two bounds
CHUNK = 8192  # vectors of one chunk
SLAB = 16384  # queries of one broadcast
TOGETHER = 64  # queries whose first blocks are multiplied at once
EXACT = 2.0**53  # float64 adds whole numbers below without rounding
NARROW = 2.0**20
PACKED = "ids array<long>, wide boolean, dims int, size int, blocks array<binary>"


def quantised(column: pa.ListArray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows that take part, and their components as whole numbers in float64, short vectors filled with zeros.

    Null vectors and vectors with a null or non-finite component, also one that is beyond float64 once scaled, stay out.
    """
    column = column.cast(pa.list_(pa.float64()))
    sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0), np.int64)
    values = np.asarray(pa.compute.fill_null(column.flatten(), float("nan")), np.float64)
    ends = np.cumsum(sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.floor(values * scale)
    good = np.asarray(column.is_valid())
    good[row[~np.isfinite(values)]] = False
    full = np.zeros((len(sizes), int(sizes.max(initial=0))))
    full[row, np.arange(len(row)) - (ends - sizes)[row]] = values
    return np.flatnonzero(good), full[good]


def packed_row(ids: pa.Array, vectors: np.ndarray, wide: bool) -> tuple:
    """One chunk: ids and an array per block of dimensions, dimension by dimension."""
    limit = np.abs(vectors).max(initial=0)
    kind = "<f8" if limit >= 2**31 else "<i4" if limit >= 2**15 else "<i2"
    blocks = [kind.encode() + np.ascontiguousarray(vectors[:, d : d + BLOCK].T, kind).tobytes() for d in range(0, vectors.shape[1], BLOCK)]
    return ids.to_pylist(), wide, vectors.shape[1], len(vectors), blocks


def pack(vectors: DataFrame, id_column: str, vector_column: str, scale: float, whole: bool = False) -> DataFrame:
    """Chunks of quantised vectors; with ``whole`` a partition becomes one chunk of its own number (``slab``)."""

    def chunks(batches):
        def rows(ids, held):
            dims = max(v.shape[1] for v in held)
            table = np.concatenate([np.pad(v, ((0, 0), (0, dims - v.shape[1]))) for v in held])
            ids = pa.concat_arrays(ids)
            wide = np.abs(table).max(axis=1, initial=0) >= NARROW
            out = []
            for flag in (False, True):
                pick = np.flatnonzero(wide == flag)
                if len(pick):
                    out.append(packed_row(ids.take(pa.array(pick)), table[pick], flag))
            fields = [pa.list_(pa.int64()), pa.bool_(), pa.int32(), pa.int32(), pa.list_(pa.binary())]
            columns = [pa.array(c, t) for c, t in zip(zip(*out), fields)]
            slab = pa.array([TaskContext.get().partitionId()] * len(out), pa.int32())
            return pa.RecordBatch.from_arrays([*columns, slab], ["ids", "wide", "dims", "size", "blocks", "slab"])

        ids, held, n = [], [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                good, table = quantised(part.column("v"), scale)
                if len(good):
                    ids.append(part.column("i").take(pa.array(good)).cast(pa.int64()))
                    held.append(table)
                    n += len(good)
                if n >= CHUNK and not whole:
                    yield rows(ids, held)
                    ids, held, n = [], [], 0
        if held:
            yield rows(ids, held)

    slim = vectors.select(F.col(id_column).alias("i"), F.col(vector_column).alias("v"))
    return slim.mapInArrow(chunks, f"{PACKED}, slab int")


def unpacked(blocks: list[bytes], size: int) -> list[np.ndarray]:
    return [np.frombuffer(b[3:], b[:3].decode()).reshape(-1, size).astype(np.float64) for b in blocks]


class Best:
    """The best scores of each query of a slab, ties by the smaller id, null ids last."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = [np.zeros(0, np.int64)] * queries
        self.ids = [np.zeros(0, np.int64)] * queries
        self.null = [np.zeros(0, bool)] * queries

    def least(self, q: int) -> float:
        return float(self.scores[q][-1]) if len(self.scores[q]) == self.k else -np.inf

    def add(self, q: int, scores, ids, null) -> None:
        scores = np.concatenate([self.scores[q], scores])
        ids, null = np.concatenate([self.ids[q], ids]), np.concatenate([self.null[q], null])
        top = np.lexsort((ids, null, -1 - scores))[: self.k]  # -1 - x can't overflow
        self.scores[q], self.ids[q], self.null[q] = scores[top], ids[top], null[top]


def exact_scores(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers of any size, those beyond a long at its ends; vectors are columns."""
    whole = [int(x) for x in query]
    sums = [sum(a * int(b) for a, b in zip(whole, column)) for column in vectors.T]
    return np.array([max(-(2**63) + 1, min(2**63 - 1, s)) for s in sums], np.int64)


def search_chunk(best: Best, numbers, queries: list, blocks: list, ids, null) -> None:
    """Let the candidates of a chunk compete for the queries ``numbers`` of a slab; both come as lists of blocks."""
    mass = np.stack([np.einsum("dn,dn->n", x, x) for x in blocks])
    power = np.stack([np.einsum("dq,dq->q", x, x) for x in queries])
    order = np.argsort(-(power.sum(axis=1) * mass.sum(axis=1)), kind="stable")
    rest = np.cumsum(mass[order][::-1], axis=0)[::-1]  # mass of the candidates from each step on
    left = np.cumsum(power[order][::-1], axis=0)[::-1]
    for first in range(0, len(numbers), TOGETHER):
        some = slice(first, first + TOGETHER)
        head = queries[order[0]][:, some].T @ blocks[order[0]]
        for row, number in enumerate(numbers[some]):
            q, score, alive, lowest = first + row, head[row], None, best.least(number)
            for step in range(1, len(order)):
                gain = np.sqrt((rest[step] if alive is None else rest[step][alive]) * left[step][q])
                gain += 1e-9 * gain + 1e-6  # rounding of the bound only
                if step == 1 and len(score) > best.k:
                    sure = score - gain
                    lowest = max(lowest, np.partition(sure, len(sure) - best.k)[len(sure) - best.k])
                keep = score + gain >= lowest
                if 4 * np.count_nonzero(keep) < 3 * len(keep):
                    alive = np.flatnonzero(keep) if alive is None else alive[keep]
                    score = score[keep]
                block = blocks[order[step]]
                score = score + queries[order[step]][:, q] @ (block if alive is None else block[:, alive])
            good = score >= lowest
            at = np.flatnonzero(good) if alive is None else alive[good]
            if len(at):
                best.add(number, score[good].astype(np.int64), ids[at], null[at])


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    scale: float = 1024.0,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the highest inner product for each row of ``queries``, exactly.

    Components count as ``floor(scale * x)``. ``queries`` are rows of ``vectors`` and never find themselves: of the
    rows with a query's own id and score one is left out; other rows with its id are candidates. Ties go to the smaller
    id, a null id is last. Null and non-finite vectors take no part, missing components of shorter vectors are zeros, an
    empty vector scores 0. Scores are exact in a long; beyond it they stop at its ends and
    tie there. Rows that repeat are each
    candidates and queries; an empty table gives no rows; other columns are ignored.

    The passes over the chunks are as many as there are slabs of ``SLAB`` queries; each broadcasts one slab (16 MB
    at 128 dimensions) and is written before the next.
    """
    spark = vectors.sparkSession
    chunks = materialize(pack(vectors, id_column, vector_column, scale).drop("slab"), "vectors")
    slabs = max(1, -(-queries.count() // SLAB))
    asked = materialize(pack(queries.repartition(slabs), id_column, vector_column, scale, whole=True), "queries")
    keep = k + 1
    schema = "q long, query_id long, own long, vec_id long, score long"
    names = [part.split()[0] for part in schema.split(", ")]
    results = None
    for slab in range(slabs):
        rows = asked.filter(F.col("slab") == slab).collect()
        if not rows:
            continue
        shared = spark.sparkContext.broadcast([(list(r.ids), r.wide, [bytes(b) for b in r.blocks], r.size) for r in rows])

        def search(batches, shared=shared, slab=slab):
            groups, start = [], 0
            for ids, _, blocks, size in shared.value:
                groups.append((start, ids, unpacked(blocks, size)))
                start += size
            best = Best(start, keep)
            tops = [max((np.abs(b).max(initial=0) for b in blocks), default=0) for _, _, blocks in groups]
            for batch in batches:
                for row in range(batch.num_rows):
                    size = batch.column("size")[row].as_py()
                    ids = batch.column("ids")[row].values
                    null = np.asarray(ids.is_null())
                    ids = np.asarray(pa.compute.fill_null(ids, 0), np.int64)
                    blocks = unpacked(batch.column("blocks")[row].as_py(), size)
                    top = max((np.abs(b).max(initial=0) for b in blocks), default=0)
                    for (first, asked_ids, own), most in zip(groups, tops):
                        numbers = range(first, first + len(asked_ids))
                        # Blocks that only one side has count as zeros; the last common one may be narrower on one side.
                        pairs = [(a[: min(len(a), len(b))], b[: min(len(a), len(b))]) for a, b in zip(own, blocks)]
                        if not pairs:
                            for number in numbers:
                                best.add(number, np.zeros(size, np.int64), ids, null)
                        elif most * top * BLOCK * len(pairs) < EXACT:
                            search_chunk(best, numbers, [a for a, _ in pairs], [b for _, b in pairs], ids, null)
                        else:
                            left, right = (np.concatenate(x) for x in zip(*pairs))
                            for q, number in enumerate(numbers):
                                best.add(number, exact_scores(left[:, q], right), ids, null)
            for first, asked_ids, own in groups:
                table = np.concatenate(own) if own else np.zeros((0, len(asked_ids)))
                for q, query_id in enumerate(asked_ids):
                    number = first + q
                    n = len(best.scores[number])
                    if n:
                        self_score = int(exact_scores(table[:, q], table[:, q : q + 1])[0])
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(n, (slab << 32) + number, np.int64)),
                                pa.array([query_id] * n, pa.int64()),
                                pa.array(np.full(n, self_score, np.int64)),
                                pa.array(best.ids[number], mask=best.null[number]),
                                pa.array(best.scores[number]),
                            ],
                            names,
                        )

        ranked = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
        merged = chunks.mapInArrow(search, schema).withColumn("place", F.row_number().over(ranked)).filter(F.col("place") <= keep)
        part = materialize(merged, "nearest")
        shared.destroy()
        results = part if results is None else results.union(part)
    if results is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    own = F.col("vec_id").eqNullSafe(F.col("query_id")) & (F.col("score") == F.col("own"))
    placed = results.withColumn("self", F.min(F.when(own, F.col("place"))).over(Window.partitionBy("q")))
    rank = F.col("place") - F.when(F.col("self") < F.col("place"), 1).otherwise(0)
    others = placed.filter(~F.col("place").eqNullSafe(F.col("self"))).withColumn("rank", rank.cast("int"))
    return others.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same answer by comparing every query with every row.
ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS c FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
numbered AS (SELECT *, row_number() OVER () AS n FROM v),
pairs AS (SELECT q.n AS qn, q.vec_id AS query_id, x.vec_id, list_inner_product(q.c, x.c)::BIGINT AS score
          FROM numbered q JOIN numbered x ON q.n <> x.n WHERE q.vec_id % 100 = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY qn ORDER BY score DESC, vec_id) AS place FROM pairs)
SELECT query_id, place::INTEGER AS rank, vec_id, score FROM placed WHERE place <= 10
"""
