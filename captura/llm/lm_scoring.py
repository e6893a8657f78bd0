"""Language-model scores by deleted interpolation of n-gram estimates."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captura.llm.common import crc_fold, crc_fold_of
from captura.llm.exchange import answered, count_exchange, pack_chunks, texts_of, totals_of, with_answers
from captura.llm.words import hash_table, hashes_of, window_hashes, words_of

FOLDS, TEST_FOLD, TUNE_FOLD = 7, 2, 3
START, END = 0x5851F42D4C957F2D, 0x14057B7EF767814F
KEY_BITS = {1: 64}
HIGHER_BITS = 40
BUCKETS = 32
RATIO_STEP = 8


def _tokens(texts: list, order: int) -> list[np.ndarray]:
    """Hashes of each text's words and its end, after ``order`` - 1 marks of the start."""
    table, pad = hash_table(), np.full(order - 1, START, np.uint64)
    end = np.array([END], np.uint64)
    return [np.concatenate([pad, hashes_of(words_of(t), table), end]) for t in texts]


def _mask(order: int) -> np.uint64:
    bits = KEY_BITS.get(order, HIGHER_BITS)
    return np.uint64(((1 << bits) - 1) << (64 - bits))


def _grams(tokens: list[np.ndarray], order: int, top: int) -> list[np.ndarray]:
    """Keys of the ``order``-gram that ends at each token, for texts with ``top`` - 1 marks of the start."""
    return [window_hashes(t[top - order :], order) & _mask(order) for t in tokens]


def _keys_of(order: int, top: int):
    def keys_of(doc_ids, texts):
        grams = _grams(_tokens(texts, top), order, top)
        folds = np.array([crc_fold_of(d, FOLDS) for d in doc_ids])
        flat = np.concatenate(grams)
        keys, place = np.unique(flat, return_inverse=True)
        fold = np.repeat(folds, [len(g) for g in grams])
        learn = fold != TEST_FOLD
        keep = learn & (fold != TUNE_FOLD)
        return keys, [np.bincount(place[m], minlength=len(keys)) for m in (keep, learn)]

    return keys_of


def context_bucket(count: np.ndarray) -> np.ndarray:
    """Bucket of a context's frequency: 0, 1, 2-3, 4-7, ..."""
    return np.minimum(np.ceil(np.log2(count + 1)).astype(int), BUCKETS - 1)


def estimates(counts: list[np.ndarray], starts: np.ndarray, docs: float, total: float, kinds: float, top: int):
    """Maximum-likelihood estimates of each token by order, with the frequencies of their contexts.

    ``counts[n - 1]`` has the counts of the n-gram that ends at each token of some texts, which begin at
    ``starts``. The context of an n-gram is the (n-1)-gram that ends one token before; marks of the start
    are seen once a text.
    """
    length = len(counts[0])
    parts, contexts = [np.full(length, 1.0 / (kinds + 1)), counts[0] / max(total, 1.0)], []
    for n in range(2, top + 1):
        context = np.empty(length)
        context[1:] = counts[n - 2][:-1]
        context[starts] = docs
        parts.append(np.divide(counts[n - 1], context, out=np.zeros(length), where=context > 0))
        contexts.append(context)
    return parts, contexts


def learn_weights(cells: np.ndarray, counts: np.ndarray, components: int, rounds: int = 100) -> np.ndarray:
    """Mixture weights of each bucket by expectation-maximisation.

    A cell is a bucket with the ratios of the components' estimates to the uniform one, as whole steps of their
    logarithms (a least value stands for zero). A bucket without events takes the weights of the next lower one.
    """
    weights = np.full((BUCKETS, components), 1.0 / components)
    ratios = np.ones((len(cells), components))
    ratios[:, 1:] = np.where(cells[:, 1:] <= -10_000, 0.0, np.exp(np.maximum(cells[:, 1:], -8000) / RATIO_STEP))
    bucket = cells[:, 0]
    for _ in range(rounds):
        joint = weights[bucket] * ratios
        joint *= (counts / joint.sum(1))[:, None]
        sums = np.full((BUCKETS, components), 0.5)
        np.add.at(sums, bucket, joint)
        weights = sums / sums.sum(1, keepdims=True)
    seen = np.bincount(bucket, weights=counts, minlength=BUCKETS) > 0
    for b in range(1, BUCKETS):
        if not seen[b] and seen[:b].any():
            weights[b] = weights[b - 1]
    return weights


def score_texts(docs: DataFrame, order: int = 2) -> DataFrame:
    """Score every row with an n-gram model of the rows whose crc32(doc_id) modulo 7 is not 2.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``. A token is a word or the end of a
    text. The model mixes a uniform estimate over known words and one unknown, and maximum-likelihood
    n-gram estimates up to ``order``; the weights depend on the bucket of the frequency of the longest
    context. They are learned by expectation-maximisation on a tenth fold of the training rows (remainder
    3) that was deleted from the counts; scoring then uses the counts of all training rows. Counts travel
    as arrays between chunks of texts and key ranges, so no n-gram table is broadcast and a frequent n-gram
    makes no hot task; the driver sees totals, a histogram of bounded size and the weights. A null
    text is empty (its end is its one token), a null id counts as empty text, and repeated rows count each.
    """
    fold = crc_fold(F.col("doc_id"), FOLDS)
    texts = docs.select("doc_id", "text")
    tuning = pack_chunks(texts.filter(fold == TUNE_FOLD)).withColumn("chunk", F.col("chunk") + (1 << 60))
    rest = pack_chunks(texts.filter(fold != TUNE_FOLD))
    chunks = rest.union(tuning)
    answers = [
        count_exchange(chunks, _keys_of(n, order), columns=2, bits=KEY_BITS.get(n, HIGHER_BITS), tag=f"grams{n}")
        for n in range(1, order + 1)
    ]
    (kinds_keep, total_keep), (kinds, total) = totals_of(answers[0], 2)
    per_fold = texts.groupBy(fold.alias("fold")).agg(F.count(F.lit(1)).alias("n")).collect()
    n_docs = {r["fold"]: r["n"] for r in per_fold}
    docs_all = sum(n for f, n in n_docs.items() if f != TEST_FOLD)
    docs_keep = docs_all - n_docs.get(TUNE_FOLD, 0)

    def counted(row, i, column):
        """Counts of all texts' n-grams by order, and where the texts begin, from one row of chunks."""
        tokens = _tokens(texts_of(row, i), order)
        lengths = np.array([len(t) - (order - 1) for t in tokens])
        out = []
        for n in range(1, order + 1):
            _, place = np.unique(np.concatenate(_grams(tokens, n, order)), return_inverse=True)
            out.append(answered(row.column(f"answers{n - 1}")[i].as_py(), 2)[column][place].astype(float))
        return out, np.cumsum(lengths) - lengths, lengths

    def events(batches):
        names = ["bucket", *[f"r{k}" for k in range(1, order + 1)]]
        for batch in batches:
            for i in range(batch.num_rows):
                counts, starts, _ = counted(batch, i, 0)
                parts, contexts = estimates(counts, starts, docs_keep, total_keep, kinds_keep, order)
                bucket = context_bucket(contexts[-1]) if contexts else np.zeros(len(parts[0]), int)
                with np.errstate(divide="ignore"):
                    ratio = [np.log(p / parts[0]) * RATIO_STEP for p in parts[1:]]
                cells = np.column_stack([bucket, *[np.where(np.isinf(r), -10_000, np.round(r)) for r in ratio]])
                found, times = np.unique(cells.astype(np.int64), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(np.ascontiguousarray(found[:, k])) for k in range(order + 1)], pa.array(times)], [*names, "n"]
                )

    names = ["bucket", *[f"r{k}" for k in range(1, order + 1)]]
    tuned = with_answers(tuning, *answers).mapInArrow(events, ", ".join(f"{c} long" for c in [*names, "n"]))
    cells = tuned.groupBy(*names).agg(F.sum("n").alias("n")).toPandas()
    weights = learn_weights(cells[names].to_numpy(np.int64), cells["n"].to_numpy(float), order + 1)

    def scored(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column("doc_ids")[i].as_py()
                counts, starts, lengths = counted(batch, i, 1)
                parts, contexts = estimates(counts, starts, docs_all, total, kinds, order)
                bucket = context_bucket(contexts[-1]) if contexts else np.zeros(len(parts[0]), int)
                mixed = sum(weights[:, k][bucket] * p for k, p in enumerate(parts))
                base = np.add.reduceat(np.log10((counts[0] + 1) / (total + kinds + 1)), starts)
                score = np.add.reduceat(np.log10(mixed), starts)
                known = np.add.reduceat((counts[0] > 0).astype(np.int64), starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, batch.column("doc_ids").type.value_type),
                        pa.array([crc_fold_of(d, FOLDS) == TEST_FOLD for d in ids]),
                        pa.array(lengths, pa.int64()), pa.array(known, pa.int64()),
                        pa.array([total] * len(ids), pa.int64()),
                        pa.array(base, pa.float64()), pa.array(score, pa.float64()),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_answers(chunks, *answers).mapInArrow(
        scored,
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
