"""Removal of passages that repeat across documents, by merging Burrows-Wheeler transforms.

Texts are cut where the least hashed ``SEED``-gram of a window of ``LENGTH`` bytes changes, so that all occurrences of a
window lie in pieces that meet in one key range, whatever surrounds them. Pieces whose seed occurs once
in the corpus are dropped by an exchange of counts. A chunk sends equal pieces once, by the one of least rank: those of
a larger rank go whole, those of the same rank share its answer. Pieces of a seed that more than ``HOT`` of them share are
dealt as single windows, spread by the hash of the window, so no seed fills a range; a range gets equal ones once from
each chunk. In a range equal pieces are one; pieces that share a seed but differ go to shards with a transform each, and the shards' transforms are merged by refining their
interleave symbol by symbol until all windows are ordered by ``LENGTH`` bytes. Neighbours that are still in one
block then have a common prefix of that length: a repeated interval.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captura.llm.common import materialize
from captura.llm.exchange import answered, count_exchange, decode, decode_sorted, encode, encode_sorted, pack_chunks, texts_of, with_answers

LENGTH = 50
SEED = 24
SPAN = LENGTH - SEED + 1
WIDEST = SPAN + LENGTH - 1
KEY_BITS = 40
KEY_MASK = np.uint64(((1 << KEY_BITS) - 1) << (64 - KEY_BITS))
SHARD = 1 << 20
HOT = 1 << 14  # pieces of one seed that may meet in a range, equal ones of a chunk counted once
CHUNK = 3 << 19  # bytes of text; the work on a chunk takes some fifty times as much memory


def seed_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``SEED`` bytes that start at each position."""
    n = len(data) - SEED + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    words = np.zeros(len(data) - 7, np.uint64)
    for o in range(8):
        part = data[o : o + (len(data) - o) // 8 * 8].view("<u8")
        words[o::8] = part
    h = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    for at, factor in ((8, 0xBF58476D1CE4E5B9), (16, 0x94D049BB133111EB)):
        h += words[at : at + n]
        h *= np.uint64(factor)
        h ^= h >> np.uint64(32)
    return h


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread hashes evenly again: the least of some is small, and key ranges are of equal width."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def pieces(texts: list) -> tuple[np.ndarray, ...]:
    """Bytes of all texts, the ends of the texts, and the pieces: key, text, first byte in all, number of windows."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(r) for r in raw]).astype(np.int64)
    h = seed_hashes(data)
    count = len(data) - LENGTH + 1
    if count <= 0:
        none = np.zeros(0, np.int64)
        return data, ends, np.zeros(0, np.uint64), none, none, none
    span, least = 1, h
    while span * 2 <= SPAN:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    if SPAN > span:
        least = np.minimum(least[: count], least[SPAN - span : SPAN - span + count])
    level = np.zeros(len(data) + 1, np.int8)  # 1 where too few bytes of the text follow
    starts = ends - [len(r) for r in raw]
    late = np.maximum(starts, ends - LENGTH + 1)
    np.add.at(level, late[late < ends], 1)
    np.add.at(level, ends[late < ends], -1)
    at = np.flatnonzero(np.cumsum(level[:count], dtype=np.int8) == 0)
    key = mixed(least[at]) & KEY_MASK
    del h, least, level
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (np.diff(at) != 1)]) if len(at) else np.zeros(0, bool)
    run = np.flatnonzero(new)
    inside = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
    first = np.flatnonzero(inside % SPAN == 0)  # a text with a short period has no other seed for long
    owner = np.searchsorted(ends, at[first], side="right")
    return data, ends, key[first], owner, at[first], np.diff(np.append(first, len(at)))


def padded(body: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Pieces, of which the bytes follow each other in ``body``, as rows of one width with the length behind them."""
    rows = np.zeros((len(lengths), WIDEST + 4), np.uint8)
    rows[:, :WIDEST][np.arange(WIDEST)[None, :] < lengths[:, None]] = body
    rows[:, -1] = lengths
    return rows


def single_windows(data, at, windows) -> tuple[np.ndarray, np.ndarray]:
    """Key and first byte of every window of some pieces."""
    first = np.repeat(at, windows) + _within(windows)
    h = seed_hashes(data)
    key = mixed(mixed(mixed(h[first]) + h[first + SEED]) + h[first + LENGTH - SEED])
    return key & KEY_MASK, first


def representatives(data, keys, at, windows, ranks) -> np.ndarray:
    """For each piece of a chunk the one that stands for all with its bytes: of these the first with the least rank."""
    out = np.arange(len(keys))
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    shared = np.zeros(len(keys), bool)
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    many = np.flatnonzero(shared)
    if len(many):
        size = windows[many] + LENGTH - 1
        rows = padded(data[np.repeat(at[many], size) + _within(size)], size)
        _, code = np.unique(rows.view(f"S{WIDEST + 4}").ravel(), return_inverse=True)
        by = np.lexsort((ranks[many], code))
        head = np.concatenate([[True], np.diff(code[by]) != 0])
        out[many[by]] = many[by][head][np.cumsum(head) - 1]
    return out


def ranks_of(ids: list) -> np.ndarray:
    return np.array([(1 << 63) - 1 if d is None else d for d in ids], np.int64)


def transform(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform of a shard: preceding symbols by suffix rank, rank of the preceding suffix, rank by position.

    Suffixes are ordered by their first 56 symbols, more than a window; later ties do not matter.
    """
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(64, symbols.dtype)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = (key << np.uint64(9)) | padded[k : k + n]
    for step in (7, 14, 28, 0):
        order = np.argsort(key)
        if not step:
            break
        ordered = key[order]
        rank = np.empty(n + step, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]])).astype(np.uint64) + np.uint64(1)
        rank[n:] = 0
        key = (rank[:n] << np.uint64(32)) | rank[step:]
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return symbols[order - 1], place[order - 1], place


def merge(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Merge shards by interleave refinement: order of all windows, and the block of each place in that order.

    A shard is its transform (preceding symbols, ranks of preceding suffixes) and the rank of the suffix behind each
    window. All start in one block, shard after shard. Each step reads two symbols of every window from the
    transforms, deals the interleave stably by them and moves to the preceding suffixes, so after h steps it
    is ordered by 2h symbols; a block ends where these differ. No suffix is compared with another.
    """
    base = np.cumsum([0, *[len(b) for b, _, _ in shards]])[:-1]
    symbols = np.concatenate([((b[p].astype(np.int64) - 1) << 8) + b - 1 for b, p, _ in shards]).astype(np.uint16)
    before = np.concatenate([p[p] + o for (_, p, _), o in zip(shards, base)])
    at = np.concatenate([w + o for (_, _, w), o in zip(shards, base)])
    order, block = np.arange(len(at)), np.zeros(len(at), np.int64)
    for _ in range(LENGTH // 2):
        symbol = symbols[at]
        deal = np.argsort(symbol, kind="stable")
        symbol, block = symbol[deal], block[deal]
        order, at = order[deal], before[at[deal]]
        block = np.cumsum(np.concatenate([[False], (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])]))
    return order, block


def window_classes(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Class of every window of some pieces (padded bytes), in order of pieces and positions: equal windows, equal class."""
    shards, low = [], 0
    ends = np.cumsum(lengths + 1)
    while low < len(rows):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + SHARD)))
        size = lengths[low:high]
        inside = np.arange(WIDEST + 1)[None, :] <= size[:, None]  # with one mark, 0, behind each piece
        symbols = np.zeros((high - low, WIDEST + 1), np.uint16)
        symbols[:, :WIDEST] = rows[low:high].astype(np.uint16) + 1
        symbols[np.arange(high - low), size] = 0
        bwt, before, place = transform(symbols[inside])
        starts = np.cumsum(size + 1) - (size + 1)
        windows = size - LENGTH + 1
        behind = np.repeat(starts + LENGTH, windows) + _within(windows)
        shards.append((bwt, before, place[behind]))
        low = high
    order, block = merge(shards)
    classes = np.empty(len(order), np.int64)
    classes[order] = block
    return classes


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each of some runs."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def marked_windows(keys, ranks, counts, data) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that occur under a smaller rank: piece, first window in it, number of windows."""
    lengths = counts + LENGTH - 1
    rows = padded(data, lengths)
    _, first, same = np.unique(rows.view(f"S{WIDEST + 4}").ravel(), return_index=True, return_inverse=True)
    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, same, ranks)
    _, place, sharing = np.unique(keys[first], return_inverse=True, return_counts=True)
    several = np.flatnonzero(sharing[place] > 1)
    lone = np.ones(len(first), bool)
    lone[several] = False
    hit = np.flatnonzero(lone[same] & (least[same] < ranks))
    out = [(hit, np.zeros(len(hit), np.int64), counts[hit])]
    if len(several):
        windows = counts[first[several]]
        classes = window_classes(rows[first[several], :WIDEST], lengths[first[several]])
        lowest = np.full(int(classes.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(lowest, classes, np.repeat(least[several], windows))
        head = np.zeros(len(first), np.int64)
        head[several] = np.cumsum(windows) - windows
        open_ = np.flatnonzero(~lone[same])
        n = counts[open_]
        found = lowest[classes[np.repeat(head[same[open_]], n) + _within(n)]] < np.repeat(ranks[open_], n)
        piece, at = np.repeat(open_, n), _within(n)
        start = np.flatnonzero(found & ~(np.concatenate([[False], found[:-1]]) & (at > 0)))
        stop = np.flatnonzero(found & ~(np.concatenate([found[1:], [False]]) & np.append(at[1:] > 0, False)))
        out.append((piece[start], at[start], stop - start + 1))
    return tuple(np.concatenate(x) for x in zip(*out))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """What is left of each text without bytes that repeat a document with a smaller doc_id.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``. A byte goes when a string of ``LENGTH`` bytes of the
    input that covers it also starts in a document with a smaller id. Null texts are empty; a null id is larger
    than all others; rows with one id are one document for each other, so they remove nothing from each other.
    """
    chunks = pack_chunks(docs, CHUNK)
    ranges = max(1, chunks.select("chunk").count() // 2)

    def keys_of(doc_ids, texts):
        data, _, keys, owner, at, windows = pieces(texts)
        stands = representatives(data, keys, at, windows, ranks_of(doc_ids)[owner]) == np.arange(len(keys))
        keys, counts = np.unique(keys[stands], return_counts=True)
        return keys, [counts]

    seen = count_exchange(chunks, keys_of, bits=KEY_BITS, tag="seeds")

    def deal(batches):
        import zstandard

        edges = (np.arange(1, ranges, dtype=object) * (1 << 64) // ranges).astype(np.uint64)
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column("doc_ids")[i].as_py()
                data, _, keys, owner, at, windows = pieces(texts_of(batch, i))
                if not len(keys):
                    continue
                (count,) = answered(batch.column("answers0")[i].as_py())
                count = count[np.searchsorted(np.unique(keys), keys)]
                rank, hot = ranks_of(ids)[owner], count > HOT
                if hot.any():
                    split, first = single_windows(data, at[hot], windows[hot])
                    keys, at = np.append(keys[~hot], split), np.append(at[~hot], first)
                    rank = np.append(rank[~hot], np.repeat(rank[hot], windows[hot]))
                    count = np.append(count[~hot], np.repeat(count[hot], windows[hot]))
                    windows = np.append(windows[~hot], np.ones(len(first), np.int64))
                stands = representatives(data, keys, at, windows, rank)
                others = np.flatnonzero(stands != np.arange(len(keys)))
                whole = others[rank[others] > rank[stands[others]]]
                alike = others[rank[others] == rank[stands[others]]]
                chosen = np.flatnonzero((stands == np.arange(len(keys))) & (count > 1))
                chosen = chosen[np.argsort(keys[chosen], kind="stable")]

                def row(place, held, body):
                    packed = zstandard.ZstdCompressor(level=1).compress(body)
                    return pa.RecordBatch.from_arrays(
                        [
                            pa.array([batch.column("chunk")[i].as_py()], pa.int64()), pa.array([place], pa.int64()),
                            pa.array([[encode(x) if isinstance(x, np.ndarray) else x for x in held]], pa.list_(pa.binary())),
                            pa.array([packed], pa.binary()), pa.array([len(body)], pa.int64()),
                        ],
                        ["chunk", "range", "pieces", "data", "size"],
                    )

                if len(others):  # a range of the chunk's own: these come back as they are
                    local = [at[whole], np.zeros(len(whole), np.int64), windows[whole], at[alike], at[stands[alike]]]
                    yield row(-1 - batch.column("chunk")[i].as_py(), local, b"")
                cuts = np.concatenate([[0], np.searchsorted(keys[chosen], edges), [len(chosen)]])
                for r in np.flatnonzero(np.diff(cuts)).tolist():
                    c = chosen[cuts[r] : cuts[r + 1]]
                    size = windows[c] + LENGTH - 1
                    body = data[np.repeat(at[c], size) + _within(size)].tobytes()
                    ranked = rank[c].view(np.uint64) ^ np.uint64(1 << 63)
                    yield row(r, [encode_sorted(keys[c], KEY_BITS), ranked, at[c], windows[c]], body)

    def mark(group: pa.Table) -> pa.Table:
        import zstandard

        if group.column("range")[0].as_py() < 0:
            chunks, marks = group.column("chunk").to_pylist(), group.column("pieces").to_pylist()
            return pa.Table.from_arrays([pa.array(chunks, pa.int64()), pa.array(marks, pa.list_(pa.binary()))], ["chunk", "marks"])
        parts = [[decode_sorted(x.as_py()[0], KEY_BITS), *map(decode, x.as_py()[1:])] for x in group.column("pieces")]
        keys, ranks, first, windows = (np.concatenate(x) for x in zip(*parts))
        body = b"".join(
            zstandard.ZstdDecompressor().decompress(d.as_py(), max_output_size=n.as_py())
            for d, n in zip(group.column("data"), group.column("size"))
        )
        ranks = (ranks ^ np.uint64(1 << 63)).view(np.int64)
        piece, at, run = marked_windows(keys, ranks, windows.astype(np.int64), np.frombuffer(body, np.uint8))
        ends = np.cumsum([len(p[0]) for p in parts])
        source = np.searchsorted(ends, piece, side="right")
        chunks, marks = [], []
        for k, chunk in enumerate(group.column("chunk").to_pylist()):
            own = np.flatnonzero(source == k)
            if len(own):
                chunks.append(chunk)
                marks.append([encode(first[piece[own]]), encode(at[own]), encode(run[own])])
        return pa.Table.from_arrays(
            [pa.array(chunks, pa.int64()), pa.array(marks, pa.list_(pa.binary()))], ["chunk", "marks"]
        )

    dealt = with_answers(chunks, seen).mapInArrow(
        deal, "chunk long, range long, pieces array<binary>, data binary, size long"
    )
    marks = materialize(dealt.groupBy("range").applyInArrow(mark, "chunk long, marks array<binary>"), "marks")
    per_chunk = marks.groupBy("chunk").agg(F.collect_list("marks").alias("marks"))

    def cut(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column("doc_ids")[i].as_py()
                raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts_of(batch, i)]
                heads = np.cumsum([0, *[len(r) for r in raw]])
                level = np.zeros(heads[-1] + 1, np.int32)
                found = [[decode(x).astype(np.int64) for x in m] for m in batch.column("marks")[i].as_py() or []]
                if found:
                    first, at, run = (np.concatenate(x) for x in zip(*[m[:3] for m in found]))
                    by = np.argsort(first, kind="stable")
                    first, at, run = first[by], at[by], run[by]
                    for alike, stands in [m[3:] for m in found if len(m) > 3]:  # these share an answer
                        low = np.searchsorted(first, stands)
                        n = np.searchsorted(first, stands, side="right") - low
                        shared = np.repeat(low, n) + _within(n)
                        start = np.repeat(alike, n) + at[shared]
                        np.add.at(level, start, 1)
                        np.add.at(level, start + run[shared] + LENGTH - 1, -1)
                    np.add.at(level, first + at, 1)
                    np.add.at(level, first + at + run + LENGTH - 1, -1)
                gone = np.cumsum(level)[:-1] > 0
                rows = []
                for k, text in enumerate(raw):
                    mask = gone[heads[k] : heads[k + 1]]
                    n = int(mask.sum())
                    spans = int((mask[1:] & ~mask[:-1]).sum()) + int(mask[0]) if n else 0
                    kept = np.frombuffer(text, np.uint8)[~mask].tobytes() if n else text
                    rows.append((len(text), n, spans, hashlib.sha256(kept).hexdigest()))
                n_bytes, removed, spans, digest = zip(*rows) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, batch.column("doc_ids").type.value_type),
                        *[pa.array(x, pa.int64()) for x in (n_bytes, removed, spans)],
                        pa.array(digest, pa.string()),
                    ],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return chunks.join(per_chunk, "chunk", "left").mapInArrow(
        cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
