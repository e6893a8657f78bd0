"""Near-duplicate documents by an exact Jaccard join with adaptive multi-match prefixes.

Shingles are ordered by document frequency, rarest first, then by hash. With sets of n shingles and a
similarity of at least t, linked documents share l of the first n - ceil(t n) + l shingles, for any l. Each
document picks its l by the frequencies in its own prefix: a longer prefix costs more list entries, and asks
for more shared ones before a pair is verified. Documents with l and m meet at min(l, m) shared shingles.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captura.llm.common import materialize
from captura.llm.exchange import answered, count_exchange, distinct, pack_chunks, texts_of, with_answers
from captura.llm.graph import Forest, components
from captura.llm.words import hash_table, hashes_of, shingles, words_of

KEY_BITS = 40
KEY_MASK = np.uint64(((1 << KEY_BITS) - 1) << (64 - KEY_BITS))
LONGEST = 6
PAIR_LIST = 16
SALT_ROWS = 4096
BLOCK_DOCS = 1024


def prefix_size(n: int, percent: int, shared: int) -> int:
    """Leading shingles of which a document shares at least ``shared`` with every document it is linked with."""
    return n - (percent * n + 99) // 100 + shared


def choose_shared(n: int, percent: int, frequency: np.ndarray, rare: int, longest: int = LONGEST) -> int:
    """Number of shared prefix shingles to ask for: the one with the least estimated cost.

    ``frequency`` has the document frequencies beyond the ``rare`` leading shingles that no other document
    has. A prefix costs its list entries; entries / l bounds the candidates with l shared shingles, and
    verifying one costs about as much as reading its share of the lists, n / 16.
    """
    entries = np.concatenate([[0], np.cumsum(frequency, dtype=np.float64)])
    best, least = 1, None
    for shared in range(1, longest + 1):
        size = prefix_size(n, percent, shared) - rare
        if size > len(frequency) or size < shared:
            break
        cost = entries[size] * (1 + n / 16 / shared)
        if least is None or cost < least:
            best, least = shared, cost
    return best


def spark_hash(text: str | None) -> int:
    """What Spark's xxhash64 says of a text."""
    import xxhash

    if text is None:
        return 42
    value = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed=42)
    return value - (1 << 64) if value >> 63 else value


def _sets(texts: list, words: int) -> list[np.ndarray]:
    table = hash_table()
    return [shingles(hashes_of(words_of(t), table), words) for t in texts]


def shingle_sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """One row per document: id, set size, fingerprint of the set and, where others share enough, its shingles.

    ``shared`` holds the shingles that other documents have as well, in prefix order; the rest cannot be in
    any intersection. It is null where they are too few for any link.
    """
    chunks = pack_chunks(docs)

    def keys_of(doc_ids, texts):
        held = [s & KEY_MASK for s in _sets(texts, words)]
        keys, counts = np.unique(np.concatenate([distinct(h) for h in held] or [np.zeros(0, np.uint64)]), return_counts=True)
        return keys, [counts]

    frequencies = count_exchange(chunks, keys_of, bits=KEY_BITS, tag="frequencies")

    def rows(batches):
        import xxhash

        for batch in batches:
            for i in range(batch.num_rows):
                ids, texts = batch.column("doc_ids")[i].as_py(), texts_of(batch, i)
                held = _sets(texts, words)
                keys = distinct(np.concatenate([s & KEY_MASK for s in held] or [np.zeros(0, np.uint64)]))
                (count,) = answered(batch.column("answers0")[i].as_py())
                out = {k: [] for k in ("n", "hi", "lo", "text_hash", "need", "prefix", "shared", "lists")}
                for s, text in zip(held, texts):
                    n, print_ = len(s), xxhash.xxh3_128_intdigest(s.tobytes())
                    df = count[np.searchsorted(keys, s & KEY_MASK)] if n else np.zeros(0, np.int64)
                    many = df > 1
                    common, df = s[many], df[many]
                    need, size = None, None
                    shared = lists = None
                    if n and 100 * len(common) >= percent * n:
                        order = np.lexsort((common, df))
                        common, df = common[order], df[order]
                        need = choose_shared(n, percent, df, n - len(common))
                        size = min(max(0, prefix_size(n, percent, need) - (n - len(common))), len(common))
                        shared, lists = common.view(np.int64), df[:size].astype(np.int32)
                    out["n"].append(n)
                    out["hi"].append((print_ >> 64) - (1 << 63))
                    out["lo"].append((print_ & ((1 << 64) - 1)) - (1 << 63))
                    out["text_hash"].append(spark_hash(text))
                    out["need"].append(need)
                    out["prefix"].append(size)
                    out["shared"].append(shared)
                    out["lists"].append(lists)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, batch.column("doc_ids").type.value_type),
                        *[pa.array(out[k], pa.int64()) for k in ("n", "hi", "lo", "text_hash")],
                        *[pa.array(out[k], pa.int32()) for k in ("need", "prefix")],
                        pa.array(out["shared"], pa.list_(pa.int64())),
                        pa.array(out["lists"], pa.list_(pa.int32())),
                    ],
                    ["doc_id", "n", "hi", "lo", "text_hash", "need", "prefix", "shared", "lists"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n long, hi long, lo long, text_hash long, need int, prefix int, shared array<long>, lists array<int>"
    made = with_answers(chunks, frequencies).mapInArrow(rows, schema)
    return materialize(made.select(F.monotonically_increasing_id().alias("row"), "*"), "sets")


def candidate_edges(sets: DataFrame, percent: int) -> DataFrame:
    """Edges whose components hold every pair that may be linked (``u, v``), from the prefix lists.

    A list of up to ``PAIR_LIST`` documents gives its pairs; a pair counts once its shared prefix shingles
    reach the smaller of both demands and its sizes allow the similarity. A longer list links its
    documents with its first one only, whatever else they share, so it gives no more edges than entries.
    Very frequent shingles are dealt to several tasks, whose first documents are then linked.
    """
    entries = sets.select(
        "row", "n", "need", F.posexplode(F.slice("shared", 1, F.col("prefix"))).alias("at", "token"), "lists"
    ).select("row", "n", "need", "token", F.element_at("lists", F.col("at") + 1).alias("df"))
    salt = F.when(F.col("df") > SALT_ROWS, F.pmod(F.xxhash64("row"), F.ceil(F.col("df") / SALT_ROWS))).otherwise(-1)
    entries = entries.select("token", salt.cast("int").alias("salt"), "row", "n", "need")

    def pairs(batches):
        names = ["u", "v", "shared", "need", "kind"]

        def table(rows):
            cols = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        key, run, size, counts, out = None, [], 0, {}, []

        def close():
            if key is not None and (size > PAIR_LIST or key[1] >= 0):
                out.append((key[0], run[0][0], 0, 0, 1))
            if size <= PAIR_LIST:
                for i, (a, n, need) in enumerate(run):
                    for b, m, other in run[:i]:
                        if 100 * min(n, m) >= percent * max(n, m):
                            shared, least = counts.get((b, a), (0, 0))
                            counts[b, a] = (shared + 1, min(need, other))

        for batch in batches:
            for token, salt, row, n, need in zip(*[c.to_pylist() for c in batch.columns]):
                if (token, salt) != key:
                    close()
                    key, run, size = (token, salt), [], 0
                size += 1
                if salt >= 0 and size > 1:  # part of a dealt list: linked with its first document in any case
                    out.append((run[0][0], row, 0, 0, 2))
                    continue
                if size <= PAIR_LIST:
                    run.append((row, n, need))
                    continue
                if size == PAIR_LIST + 1:
                    out += [(run[0][0], r[0], 0, 0, 2) for r in run[1:]]
                out.append((run[0][0], row, 0, 0, 2))
            if len(counts) + len(out) > 200_000:
                yield table([(a, b, s, m, 0) for (a, b), (s, m) in counts.items()] + out)
                counts, out = {}, []
        close()
        yield table([(a, b, s, m, 0) for (a, b), (s, m) in counts.items()] + out)

    found = materialize(
        entries.repartition("token", "salt").sortWithinPartitions("token", "salt", "row")
        .mapInArrow(pairs, "u long, v long, shared int, need int, kind int"),
        "pairs",
    )
    counted = found.filter("kind = 0").groupBy("u", "v").agg(F.sum("shared").alias("s"), F.min("need").alias("m"))
    stars = found.filter("kind = 2").select("u", "v")
    heads = found.filter("kind = 1").select(F.col("u").alias("token"), F.col("v").alias("head")).distinct()
    first = heads.groupBy("token").agg(F.min("head").alias("first"))
    seams = heads.join(first, "token").filter("head <> first").select(F.col("first").alias("u"), F.col("head").alias("v"))
    return counted.filter("s >= m").select("u", "v").union(stars).union(seams)


def verify(rows: list[int], sizes: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges with the connected components of all linked pairs among some documents.

    Overlaps of one document with all others come from the lists of its shingles. The document with the most
    shared lists goes first; those linked with it are connected, so pairs among them need no test. Every
    other document is tested against all.
    """
    if len(rows) < 2:
        return []
    flat = np.concatenate(sets)
    _, codes = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(codes, kind="stable")
    heads = np.concatenate([[0], np.cumsum(np.bincount(codes))])
    lists, ends = owner[order], np.cumsum([len(s) for s in sets])
    weight = np.add.reduceat(np.diff(heads)[codes], np.concatenate([[0], ends[:-1]]))
    forest, edges, done = Forest(), [], None

    def linked(i):
        own = codes[ends[i] - len(sets[i]) : ends[i]]
        inter = np.bincount(np.concatenate([lists[heads[c] : heads[c + 1]] for c in own]), minlength=len(sets))
        ok = 100 * inter >= percent * (sizes + sizes[i] - inter)
        ok[i] = False
        return np.flatnonzero(ok)

    left = len(rows) - 1
    for i in np.argsort(-weight, kind="stable"):
        if not left:
            break
        if done is not None and done[i]:
            continue
        hits = linked(i)
        if done is None:
            done = np.zeros(len(rows), bool)
            done[hits] = True
        for j in hits:
            if forest.join(rows[i], rows[j]):
                edges.append((rows[i], rows[j]))
                left -= 1
    return edges


def verified_edges(sets: DataFrame, candidates: DataFrame, percent: int) -> DataFrame:
    """Exact links within candidate components, up to connectivity.

    A component of more than ``BLOCK_DOCS`` documents is hashed into blocks, and every two blocks meet in a task of
    their own: bounded memory, and one spanning edge per merge instead of all pairs.
    """
    grouped = sets.join(candidates, F.col("row") == F.col("node"))
    sizes = candidates.groupBy("root").agg(F.ceil(F.count("node") / BLOCK_DOCS).cast("int").alias("blocks"))
    placed = grouped.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(
        F.array_remove(F.sequence(F.lit(0), F.greatest(F.col("blocks") - 1, F.lit(1))), F.col("block"))
    )
    dealt = placed.withColumn("other", F.explode(others)).select(
        "root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "row", "n", "shared"
    )

    def check(group: pa.Table) -> pa.Table:
        shared = group.column("shared").combine_chunks()
        sets = [np.asarray(x.values) for x in shared]
        edges = verify(group.column("row").to_pylist(), np.asarray(group.column("n")), sets, percent)
        u, v = zip(*edges) if edges else ((), ())
        return pa.Table.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return dealt.groupBy("root", "low", "high").applyInArrow(check, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents linked by word shingles: ``doc_id, n_shingles, component_id, text_hash, keep``.

    Two documents are linked when ``100 x shared >= percent x united`` distinct shingles. A component's id is
    its smallest doc_id (nulls last); ``keep`` marks the one row of each component that stays, the first by
    doc_id. Equal sets are one class and meet others once. Null texts and texts without words are empty
    sets: linked with nothing, kept, with their own id. Rows that repeat an id stay rows of their own.
    """
    sets = shingle_sets(docs, words, percent)
    full = sets.filter("n > 0")
    key = ["hi", "lo", "n"]
    classes = materialize(
        full.groupBy(*key).agg(F.min("row").alias("class"), F.min("doc_id").alias("least"), F.count("row").alias("copies")),
        "classes",
    )
    heads = classes.select(F.col("class").alias("row"))
    reps = materialize(full.filter("shared IS NOT NULL").join(heads, "row", "left_semi"), "representatives")
    candidates = components(candidate_edges(reps, percent))
    linked = components(materialize(verified_edges(reps.select("row", "n", "shared"), candidates, percent), "links"))
    named = classes.join(linked, F.col("class") == F.col("node"), "left").select(
        *key, "least", F.coalesce("root", "class").alias("group")
    )
    least = named.groupBy("group").agg(F.min("least").alias("component_id"))
    named = named.join(least, "group").select(*key, "group", "component_id")
    rows = sets.select("row", "doc_id", "text_hash", *key).join(named, key, "left")
    group = F.coalesce("group", "row")
    rows = materialize(rows.withColumn("group", group), "groups")
    first = rows.groupBy("group").agg(F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    first = first.select(F.col("first").alias("row"), F.lit(True).alias("keep"))
    return rows.join(first, "row", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        "text_hash",
        F.coalesce("keep", F.lit(False)).alias("keep"),
    )
