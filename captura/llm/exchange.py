"""Corpus-wide counts of hashed features, answered to the documents that asked for them.

Documents are packed into chunks, rows of a few megabytes in the shared folder. A chunk asks for the counts
of its distinct keys with one compressed array per key range; a range sums what all chunks sent and answers
each with an array in the order of its question. Every chunk sends a key once, so a frequent key makes no
hot partition, and the counts of a hundred million features travel in some thousand rows.
"""

import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captura.llm.common import LARGE_ROWS, materialize, portions

CHUNK_BYTES = 4 << 20
CHUNKS_PER_RANGE = 4


def encode(values: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes."""
    import zstandard

    values = np.ascontiguousarray(values, "<u8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return struct.pack("<IB", len(values), width) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def decode(data: bytes) -> np.ndarray:
    import zstandard

    count, width = struct.unpack_from("<IB", data)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[5:], max_output_size=count * width), np.uint8)
    out = np.zeros((count, 8), np.uint8)
    out[:, :width] = planes.reshape(width, count).T
    return out.reshape(-1).view("<u8")


def encode_sorted(keys: np.ndarray, bits: int) -> bytes:
    """Ascending keys, of which the upper ``bits`` bits count, by their differences."""
    return encode(np.diff(keys >> np.uint64(64 - bits), prepend=np.uint64(0)))


def decode_sorted(data: bytes, bits: int) -> np.ndarray:
    return np.cumsum(decode(data), dtype=np.uint64) << np.uint64(64 - bits)


def distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def packed_texts(texts: list) -> bytes:
    """Texts (UTF-8 bytes or null) as one compressed block, so that a chunk takes little where answers join it."""
    import zstandard

    sizes = encode(np.array([0 if t is None else len(t) + 1 for t in texts], np.uint64))
    body = b"".join(t for t in texts if t)
    return struct.pack("<IQ", len(sizes), len(body)) + sizes + zstandard.ZstdCompressor(level=1).compress(body)


def texts_of(batch: pa.RecordBatch, row: int) -> list:
    """The texts of one row of chunks."""
    import zstandard

    data = batch.column("texts")[row].as_py()
    head = struct.calcsize("<IQ")
    width, size = struct.unpack_from("<IQ", data)
    sizes = decode(data[head : head + width]).astype(np.int64)
    body = zstandard.ZstdDecompressor().decompress(data[head + width :], max_output_size=size)
    ends = np.cumsum(np.maximum(sizes - 1, 0)).tolist()
    return [body[e - n + 1 : e].decode("utf-8", "surrogatepass") if n else None for n, e in zip(sizes.tolist(), ends)]


def pack_chunks(docs: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """Chunks of whole documents: ``chunk, doc_ids, texts`` (see :func:`texts_of`), written to the shared folder."""

    def chunks(batches):
        task, number, held, used = TaskContext.get().partitionId(), 0, [], 0

        def row():
            whole = pa.Table.from_batches(held).combine_chunks()
            ids = pa.ListArray.from_arrays(pa.array([0, whole.num_rows], pa.int32()), whole.column("doc_id").chunk(0))
            body = pa.array([packed_texts(whole.column("text").cast(pa.large_binary()).to_pylist())], pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array([(task << 24) + number], pa.int64()), ids, body], ["chunk", "doc_ids", "texts"]
            )

        for batch in batches:
            for part in portions(batch, "text"):
                held.append(part)
                used += part.nbytes
                if used >= size:
                    yield row()
                    held, used, number = [], 0, number + 1
        if held:
            yield row()

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(chunks, f"chunk long, doc_ids array<{kind}>, texts binary")
    return materialize(rows, "chunks", LARGE_ROWS)


def count_exchange(
    chunks: DataFrame, keys_of: Callable, columns: int = 1, bits: int = 64, tag: str = "counts"
) -> DataFrame:
    """Ask for and answer the summed counts of every chunk's keys: ``chunk, answers``.

    ``keys_of(doc_ids, texts)`` gives a chunk's distinct ascending keys (uint64, only the upper ``bits`` bits
    set) and ``columns`` arrays of counts. The number of key ranges follows the number of chunks, so a range
    holds the keys of about ``CHUNKS_PER_RANGE`` chunks at any size. The answer under chunk -1 has the number
    of distinct keys with a count and the sum of counts, for each column, of each range.
    """
    ranges = max(1, -(-chunks.select("chunk").count() // CHUNKS_PER_RANGE))

    def ask(batches):
        edges = (np.arange(1, ranges, dtype=object) * (1 << 64) // ranges).astype(np.uint64)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                keys, counts = keys_of(row.column("doc_ids")[0].as_py(), texts_of(row, 0))
                cuts = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
                full = np.flatnonzero(np.diff(cuts))
                out = [(int(r), cuts[r], cuts[r + 1]) for r in full]
                chunk = row.column("chunk")[0].as_py()
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([chunk] * len(out), pa.int64()),
                            pa.array([r for r, _, _ in out], pa.int32()),
                            pa.array([encode_sorted(keys[a:b], bits) for _, a, b in out], pa.binary()),
                            pa.array([[encode(c[a:b]) for c in counts] for _, a, b in out], pa.list_(pa.binary())),
                        ],
                        ["chunk", "range", "keys", "counts"],
                    )

    def answer(asked: pa.Table) -> pa.Table:
        parts = [decode_sorted(k.as_py(), bits) for k in asked.column("keys")]
        ends = np.cumsum([len(p) for p in parts])
        keys = np.concatenate(parts)
        order = np.argsort(keys, kind="stable")
        first = np.concatenate([[True], np.diff(keys[order]) != 0])
        group = np.cumsum(first) - 1
        starts = np.flatnonzero(first)
        totals, facts = [], []
        for c in range(columns):
            counts = np.concatenate([decode(x.as_py()[c]) for x in asked.column("counts")])
            sums = np.add.reduceat(counts[order], starts)
            back = np.empty(len(keys), np.uint64)
            back[order] = sums[group]
            totals.append(np.split(back, ends[:-1]))
            facts += [int((sums > 0).sum()), int(sums.sum())]
        chunk = [*asked.column("chunk").to_pylist(), -1]
        answers = [[encode(t[i]) for t in totals] for i in range(len(parts))] + [[encode(np.array(facts, np.uint64))]]
        place = pa.array(asked.column("range").to_pylist()[:1] * len(chunk), pa.int32())
        return pa.Table.from_arrays(
            [pa.array(chunk, pa.int64()), place, pa.array(answers, pa.list_(pa.binary()))], ["chunk", "range", "answer"]
        )

    asked = chunks.mapInArrow(ask, "chunk long, range int, keys binary, counts array<binary>")
    answered = asked.groupBy("range").applyInArrow(answer, "chunk long, range int, answer array<binary>")
    return materialize(answered, tag)


def totals_of(answers: DataFrame, columns: int = 1) -> list[tuple[int, int]]:
    """Distinct keys and sum of counts of each column, over all ranges; two numbers a column reach the driver."""

    def add(batches):
        for batch in batches:
            rows = [decode(x.as_py()[0]).astype(np.int64) for x in batch.column("answer")]
            total = np.sum(rows, axis=0) if rows else np.zeros(2 * columns, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([int(v)], pa.int64()) for v in total], [f"f{i}" for i in range(2 * columns)])

    facts = answers.filter("chunk = -1").select("answer").mapInArrow(add, ", ".join(f"f{i} long" for i in range(2 * columns)))
    row = facts.agg(*[F.coalesce(F.sum(f"f{i}"), F.lit(0)) for i in range(2 * columns)]).first()
    return [(row[2 * c], row[2 * c + 1]) for c in range(columns)]


def with_answers(chunks: DataFrame, *answers: DataFrame) -> DataFrame:
    """Chunks with columns ``answers0``, ``answers1``, ...: what each exchange answered, in order of the key ranges."""
    for k, asked in enumerate(answers):
        per_chunk = asked.filter("chunk >= 0").groupBy("chunk").agg(
            F.sort_array(F.collect_list(F.struct("range", "answer"))).alias(f"answers{k}")
        )
        chunks = chunks.join(per_chunk, "chunk", "left")
    return chunks


def answered(value, columns: int = 1) -> list[np.ndarray]:
    """The counts of one chunk's keys, in the order of the keys."""
    if value is None:
        return [np.zeros(0, np.int64)] * columns
    return [np.concatenate([decode(x["answer"][c]) for x in value]).astype(np.int64) for c in range(columns)]
