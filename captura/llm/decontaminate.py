"""Benchmark decontamination with DataFrame functions only.

Every document becomes an array of word hashes once; its windows are rows of a generator whose key is the
hash of a slice, probed against a hash set of the benchmark's windows. A hit is verified word by word in the
join condition, and only hits and one row per document leave the scan.
"""

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captura.llm.common import materialize

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CHUNK = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"


def words_of(text: Column) -> Column:
    """Words of a text after A-Z became lower case; none for null."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, SEPARATORS), "")


def _windows(hashed: DataFrame, lengths: list[int], sentinel: bool, longest: int) -> DataFrame:
    """One row per window (``len``, one-based ``at``) and, on request, one row with ``at`` 0 for each input row."""
    first = F.when(F.col("len") == longest, 0).otherwise(1) if sentinel else F.lit(1)
    last = F.size("hashes") - F.col("len") + 1
    rest = F.when((F.col("len") == longest) & F.lit(sentinel), F.array(F.lit(0))).otherwise(
        F.array().cast("array<int>")
    )
    return (
        hashed.withColumn("len", F.explode(F.array(*[F.lit(n) for n in lengths])))
        .withColumn("at", F.explode(F.when(last >= 1, F.sequence(first, last)).otherwise(rest)))
        .withColumn("key", F.when(F.col("at") > 0, F.xxhash64(F.slice("hashes", F.greatest("at", F.lit(1)), F.col("len")))))
    )


def benchmark_windows(benchmark: DataFrame, longest: int) -> DataFrame:
    """Distinct windows of every item: ``longest`` words, or the whole item where it has fewer."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("item_words")
    ).filter(F.size("item_words") > 0)
    sized = items.withColumn("item_len", F.least(F.size("item_words"), F.lit(longest))).withColumn(
        "item_at", F.explode(F.sequence(F.lit(1), F.size("item_words") - F.col("item_len") + 1))
    )
    return sized.select(
        "item", "item_len", F.slice("item_words", F.col("item_at"), F.col("item_len")).alias("window")
    ).withColumn("item_key", F.xxhash64(F.transform("window", lambda w: F.xxhash64(w)))).distinct()


def contamination(
    docs: DataFrame, benchmark: DataFrame, longest: int = 10, broadcast_windows: int = 1_000_000
) -> DataFrame:
    """What of the benchmark occurs in each document.

    Returns one row per input row: ``doc_id, n_words, n_hit`` (words inside any occurrence of a window),
    ``n_items, items_sha256`` (of the sorted ids of items with an occurring window), ``contaminated``,
    ``text_hash`` and ``spans`` (one-based first word and number of words of every occurrence). The set of
    windows is counted first: up to ``broadcast_windows`` of them are broadcast, more are joined by
    shuffle with the same result. Null and empty texts have no words; rows with the same id stay apart;
    an item with a null id counts under the empty id; an empty benchmark hits nothing. Further columns
    are not read.
    """
    windows = materialize(benchmark_windows(benchmark, longest), "windows")
    facts = windows.agg(F.count(F.lit(1)).alias("n"), F.collect_set("item_len").alias("lengths")).first()
    lengths = sorted({*facts["lengths"], longest})  # at most ``longest`` numbers
    if facts["n"] <= broadcast_windows:
        windows = F.broadcast(windows)
    words = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"))
    hashed = words.select(
        F.monotonically_increasing_id().alias("row"),
        "*",
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    same = (
        (F.col("key") == F.col("item_key"))
        & (F.col("len") == F.col("item_len"))
        & (F.slice("words", F.greatest("at", F.lit(1)), F.col("len")) == F.col("window"))
    )
    found = (
        _windows(hashed, lengths, True, longest)
        .join(windows, same, "left")
        .filter((F.col("at") == 0) | F.col("item").isNotNull())
        .select("row", "doc_id", "text_hash", F.size("words").alias("n_words"), "at", "len", "item")
    )
    hit = F.when(F.col("item").isNotNull(), F.struct(F.col("at"), F.col("len")))
    rows = found.groupBy("row").agg(
        *[F.first(c).alias(c) for c in ("doc_id", "text_hash", "n_words")],
        F.array_sort(F.collect_set(hit)).alias("spans"),
        F.array_sort(F.collect_set("item")).alias("items"),
    )
    covered = F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["len"] - 1)))
    return rows.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size(F.array_distinct(covered)).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "text_hash",
        "spans",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", longest: int = 10) -> DataFrame:
    """The documents without what the benchmark holds, with their own columns.

    ``remove="documents"`` drops every contaminated row; ``remove="spans"`` cuts the hit words, each with
    the separators behind it, out of the text. Clean rows stay as they are.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove must be documents or spans, not {remove}")
    found = contamination(docs, benchmark, longest).filter("contaminated")
    keys = materialize(found.select("doc_id", "text_hash", "spans").dropDuplicates(["doc_id", "text_hash"]), "hits")
    keys = keys.select(*[F.col(c).alias(f"__{c}") for c in keys.columns])
    same = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.xxhash64("text") == F.col("__text_hash"))
    if remove == "documents":
        return docs.join(keys, same, "left_anti")
    chunks = F.regexp_extract_all("text", F.lit(CHUNK), F.lit(0))
    inside = lambda i: F.exists("__spans", lambda s: (i + 1 >= s["at"]) & (i + 1 < s["at"] + s["len"]))
    kept = F.array_join(F.filter(chunks, lambda _, i: ~inside(i)), "")
    text = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(kept)
    return docs.join(keys, same, "left").select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT r, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
p AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM h) GROUP BY r),
t AS (SELECT r, count(DISTINCT item) AS n_items, sha256(array_to_string(list_sort(list(DISTINCT item)), ',')) AS s
      FROM h GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(s, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN t USING (r)
"""
