"""Token ids of documents in files of fixed-width bit-packed blocks.

A file holds consecutive documents. All numbers are little-endian:

    8 bytes   PKIDS001
    u32 u32   bits per id; ids per block
    u64 u64   place of the file: writing task, number within it
    u64 u64   documents; ids
    i64 [documents]       doc_id (0 where null)
    u8  [documents]       1 where doc_id is null
    u64 [documents + 1]   ids in this file before each document
    u64 [blocks + 1]      bytes before each block, from the start of the blocks
    blocks                ids of ``bits`` bits each, lowest bit first, padded to whole bytes
    1 byte    line feed of the sink

Any range of ids is found from the block offsets alone and unpacked with numpy.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from captura.llm.common import materialize, new_path, portions, worker_state
from captura.llm.tokens import VOCABULARY, Encoder

MAGIC = b"PKIDS001"
HEAD = 48
BLOCK = 4096


def bits_for(size: int) -> int:
    """Bits that hold the ids of a vocabulary."""
    return max(1, int(size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    shifted = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(shifted.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    flags = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: count * bits]
    return (flags.reshape(count, bits).astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(1).astype(np.uint32)


def file_bytes(doc_ids: list, ids: list[np.ndarray], bits: int, place: tuple[int, int], block: int = BLOCK) -> bytes:
    """One file of documents."""
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("<u8")
    step = block if bits in (8, 16, 32) else 64 * block  # whole blocks are packed at once: a block fills bytes exactly
    packed = b"".join(pack(flat[k : k + step], bits) for k in range(0, len(flat), step))
    blocks = -(-len(flat) // block)
    offsets = np.minimum(np.arange(blocks + 1, dtype="<u8") * (block * bits // 8), len(packed)).astype("<u8")
    head = MAGIC + np.array([bits, block], "<u4").tobytes() + np.array([*place, len(doc_ids), len(flat)], "<u8").tobytes()
    known = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    nulls = np.array([d is None for d in doc_ids], np.uint8).tobytes()
    return b"".join([head, known, nulls, starts.tobytes(), offsets.tobytes(), packed])


class PackedFile:
    """Random access to a file's documents and ids."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a file of packed ids")
        self.data = memoryview(data)
        self.bits, self.block = map(int, np.frombuffer(data, "<u4", 2, 8))
        task, number, self.documents, self.n_ids = map(int, np.frombuffer(data, "<u8", 4, 16))
        self.place, at, n = (task, number), HEAD, self.documents
        values = np.frombuffer(data, "<i8", n, at)
        nulls = np.frombuffer(data, np.uint8, n, at + 8 * n)
        self.doc_ids = [None if null else int(v) for v, null in zip(values, nulls)]
        self.starts = np.frombuffer(data, "<u8", n + 1, at + 9 * n).astype(np.int64)
        blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, at + 9 * n + 8 * (n + 1)).astype(np.int64)
        self.base = at + 9 * n + 8 * (n + 1) + 8 * (blocks + 1)

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids of positions ``first`` to ``last`` - 1, from the blocks that hold them."""
        if last <= first:
            return np.zeros(0, np.uint32)
        low, high = first // self.block, (last - 1) // self.block
        held = min((high + 1) * self.block, self.n_ids) - low * self.block
        part = self.data[self.base + self.offsets[low] : self.base + self.offsets[high + 1]]
        return unpack(part, self.bits, held)[first - low * self.block : last - low * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def write_packed(
    docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = 2, file_ids: int = 4_000_000
) -> None:
    """Write the ids of all texts in ascending doc_id order, null ids first, ties by their texts.

    Rows are dealt by ranges of doc_id and encoded in order; a task starts a new file after ``file_ids``
    ids. The sink commits whole tasks, so a lost executor leaves no half-written file. A null text is
    empty: its row is the end id alone. Further columns are not read.
    """

    def packed(batches):
        state = worker_state()
        if ("ids", vocabulary) not in state:
            state["ids", vocabulary] = Encoder(vocabulary)
        encoder, task = state["ids", vocabulary], TaskContext.get().partitionId()
        bits, held_docs, held, size, number = bits_for(max(encoder.size, end_id + 1)), [], [], 0, 0
        end = np.array([end_id], np.uint32)

        def flush():
            data = file_bytes(held_docs, held, bits, (task, number))
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["data"])

        for batch in batches:
            for part in portions(batch, "text"):
                for doc, ids in zip(
                    part.column("doc_id").to_pylist(), encoder.ids([t or "" for t in part.column("text").to_pylist()])
                ):
                    held_docs.append(doc)
                    held.append(np.concatenate([ids, end]))
                    size += len(ids) + 1
                    if size >= file_ids:
                        yield flush()
                        held_docs, held, size, number = [], [], 0, number + 1
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    files = ordered.select("doc_id", "text").mapInArrow(packed, "data binary")
    files.select(F.col("data").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def read_packed(spark, path: str) -> DataFrame:
    """One row per document of the files: ``doc_id, start`` (ids of all documents before it), ``n_tokens, ids_crc32``.

    Files are whole rows of bounded size. Their totals are summed in two levels, a thousand writing tasks
    at a time, so that no task sees more than a summary of the files.
    """

    def documents(batches):
        for batch in batches:
            for data in batch.column("content"):
                file = PackedFile(data.as_py())
                n = file.documents
                rows = [file.document(k) for k in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([file.place[0]] * n, pa.int64()),
                        pa.array([file.place[1]] * n, pa.int64()),
                        pa.array(file.doc_ids, pa.int64()),
                        pa.array(file.starts[:-1], pa.int64()),
                        pa.array([len(x) for x in rows], pa.int64()),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in rows], pa.int64()),
                    ],
                    ["task", "number", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    schema = "task long, number long, doc_id long, local long, n_tokens long, ids_crc32 long"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    rows = materialize(files.select("content").mapInArrow(documents, schema), "packed")
    per_file = rows.groupBy("task", "number").agg(F.sum("n_tokens").alias("n")).withColumn("thousand", F.floor(F.col("task") / 1000))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = per_file.withColumn("inside", before(Window.partitionBy("thousand").orderBy("task", "number")))
    above = per_file.groupBy("thousand").agg(F.sum("n").alias("n")).select(
        "thousand", before(Window.orderBy("thousand")).alias("above")
    )
    offsets = inside.join(above, "thousand").select("task", "number", (F.col("inside") + F.col("above")).alias("offset"))
    return rows.join(offsets, ["task", "number"]).select(
        "doc_id", (F.col("local") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"
    )


def packed_corpus(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = 2) -> DataFrame:
    """Write the packed files to the shared folder and report them from what is read back."""
    path = new_path(docs.sparkSession, "ids")
    write_packed(docs, path, vocabulary, end_id)
    return read_packed(docs.sparkSession, path)
