"""Token counts of whole texts by a two-tier lookup that never shuffles pre-tokens of the corpus."""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captura.llm.common import portions, worker_state
from captura.llm.tokens import VOCABULARY, Encoder


def _encoder(vocabulary: str) -> Encoder:
    state = worker_state()
    if ("lengths", vocabulary) not in state:
        state["lengths", vocabulary] = Encoder(vocabulary)
    return state["lengths", vocabulary]


def frequent_lengths(docs: DataFrame, vocabulary: str = VOCABULARY, size: int = 20_000, per_task: int = 4_000) -> dict:
    """Number of ids of the ``size`` most frequent pre-tokens, for a broadcast of that bounded size.

    Every task counts the pre-tokens of all its texts in a bounded table (rare ones leave it when it is
    full) and passes on its ``per_task`` leaders only; their sums pick the table. What is in the table
    decides how fast a pre-token is found and never how many tokens it has.
    """

    def leaders(batches):
        from collections import Counter

        encoder, counts = _encoder(vocabulary), Counter()
        for batch in batches:
            for part in portions(batch, "text"):
                for text in part.column("text").to_pylist():
                    counts.update(encoder.words(text) or ())
                if len(counts) > 50 * per_task:
                    counts = Counter(dict(counts.most_common(10 * per_task)))
        top = counts.most_common(per_task)
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["word", "n"]
        )

    found = (
        docs.select("text").filter(F.col("text").isNotNull()).mapInArrow(leaders, "word string, n long")
        .groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size).collect()
    )
    words = [r["word"] for r in found]
    return dict(zip(words, Encoder(vocabulary).lengths(words)))


def count_tokens(
    docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = 2048, table_size: int = 20_000
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row, in one pass beside that for the table.

    A pre-token is looked up in a broadcast table of frequent lengths, then in the worker's own cache;
    the rest is encoded once per worker and cached. A null text is empty: no bytes, no tokens. Repeated
    rows and null ids stay as they are; further columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    known = spark.sparkContext.broadcast(frequent_lengths(docs, vocabulary, table_size))

    def count(batches):
        encoder = _encoder(vocabulary)
        for batch in batches:
            for part in portions(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                counts = encoder.lengths(texts, known.value)
                sizes = [len(t.encode()) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
                    ["doc_id", "n_bytes", "n_tokens"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = docs.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
