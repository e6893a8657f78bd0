"""Runs of repeated words, found through string synchronising sets at dyadic scales.

The texts of a portion become one array of word numbers with a number of its own between two texts, so no match crosses
texts. Periods below ``DIRECT`` are detected by comparing the array with itself shifted. At scale t, which serves
the periods from 3t to 6t, a position is selected if the least hash of the t-grams that start in the window of t + 1
positions is at one of the window's ends; whether it is depends on the 2t words from there alone, so both copies of a
repetition select alike. t-grams with a period of at most t / 3 take no part: they lie in highly periodic regions, which
are the runs of the smaller periods and known by then, so selected positions with one context are at least t / 3 apart.
Two positions with the same 2t words propose their distance as a period, and words are compared from there on.

A run of period q is three periods long, so its first q and more positions have contexts inside the run that recur
q later; they can't all lie in regions of a period of at most t / 3, or the run would have a smaller period. So every run
is proposed, whatever the hash, and nothing that was proposed is reported unless the words agree.
"""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from captura.llm.checks import crc32_sql
from captura.llm.common import portions

DIRECT = 12  # periods below are detected by shifts; 3 times the first scale
SCALE = 4
PORTION = 4 << 20  # bytes of text handled together
MIX = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xBF58476D1CE4E5B9)
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)

SCHEMA = (
    "doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string, n_words long, n_dropped long"
)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * STEP
    return h ^ (h >> np.uint64(29))


def islands(equal: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the stretches of at least ``least`` true values."""
    breaks = np.concatenate([[-1], np.flatnonzero(~equal), [len(equal)]])
    long = np.flatnonzero(np.diff(breaks) > least)
    return breaks[long] + 1, breaks[long + 1]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each window of ``width + 1`` values, for ``width`` a power of two."""
    span, least = 1, values
    while span < width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    return np.minimum(least[:-1], least[1:])


def agreeing(words: np.ndarray, at: int, period: int, reach: int) -> tuple[int, int]:
    """The longest stretch around ``at`` whose words equal those ``period`` later."""
    end, step = at, max(16, reach)
    while end + period < len(words):
        stop = min(end + step, len(words) - period)
        differ = words[end:stop] != words[end + period : stop + period]
        first = int(differ.argmax())
        if differ[first]:
            end += first
            break
        end, step = stop, step * 2
    begin, step = at, max(16, reach)
    while begin > 0:
        stop = max(0, begin - step)
        differ = (words[stop:begin] != words[stop + period : begin + period])[::-1]
        first = int(differ.argmax())
        if differ[first]:
            begin -= first
            break
        begin, step = stop, step * 2
    return begin, end


def proposals(keys: np.ndarray, context: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and periods that pairs of synchronising positions with equal contexts propose.

    ``keys`` are the hashes of the grams of ``scale`` words, highly periodic ones at the largest value, and
    ``context`` those of twice as many words.
    """
    none = np.zeros(0, np.int64)
    count = len(context)
    if count <= 0:
        return none, none
    least = sliding_min(keys, scale)[:count]
    chosen = np.flatnonzero((least != NEVER) & ((least == keys[:count]) | (least == keys[scale : scale + count])))
    order = np.argsort(context[chosen], kind="stable")
    at, key = chosen[order], context[chosen][order]
    starts, periods = [], []
    for lag in range(1, len(at)):
        gap = at[lag:] - at[:-lag]
        near = (key[lag:] == key[:-lag]) & (gap < 6 * scale)
        if not near.any():
            break
        near &= gap >= 3 * scale
        starts.append(at[:-lag][near])
        periods.append(gap[near])
    if not starts:
        return none, none
    i, q = np.concatenate(starts), np.concatenate(periods)
    # A run of three periods around i also has the words behind i, or those before it, a period later.
    after, before = i + scale, i - 2 * scale
    fits = lambda x: (x >= 0) & (x + q < count) & (context[np.clip(x, 0, count - 1)] == context[np.clip(x + q, 0, count - 1)])
    good = fits(after) | fits(before)
    order = np.lexsort((i[good], q[good]))
    return i[good][order], q[good][order]


def periodic_runs(words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, end, period)`` of every maximal run of at least three of its smallest period.

    ``words`` numbers equal words alike; the text k is ``words[bounds[k] : bounds[k + 1] - 1]``, followed by one
    number that no other place has.
    """
    found: dict[tuple[int, int], int] = {}
    for period in range(1, min(DIRECT, len(words))):
        begin, end = islands(words[period:] == words[:-period], 2 * period)
        for a, b in zip(begin.tolist(), (end + period).tolist()):
            found.setdefault((a, b), period)
    sizes = np.diff(bounds) - 1
    hashes, span = mixed(words.astype(np.uint64) * MIX + MIX), 1
    places = None
    while span < SCALE:
        hashes, span = mixed(hashes[:-span] * MIX + hashes[span:]), span * 2
    longest = int(sizes.max(initial=0))
    scale, live = SCALE, np.arange(len(sizes))
    while 9 * scale <= longest:
        # Texts too short for a period of this scale leave; what is left keeps its unique number behind each text.
        stay = live[sizes[live] >= 9 * scale]
        if len(stay) < len(live):
            old = np.concatenate([[0], np.cumsum(sizes[live] + 1)])
            kept = np.flatnonzero(np.isin(live, stay))
            take = np.concatenate([np.arange(old[k], old[k + 1]) for k in kept])
            pad = take[take < len(hashes)]
            places = take if places is None else places[take]
            hashes = np.concatenate([hashes[pad], mixed(NEVER - take[len(pad) :].astype(np.uint64))])
            live = stay
        context = mixed(hashes[:-scale] * MIX + hashes[scale:])
        keys = hashes.copy()
        small = [(a, b) for (a, b), p in found.items() if 3 * p <= scale <= b - a]
        for a, b in small:
            if places is not None:
                a = int(np.searchsorted(places, a))
                if a >= len(places):
                    continue
                b = min(int(np.searchsorted(places, b)), len(keys))
            keys[a : max(a, b - scale + 1)] = NEVER
        done, upto = 0, -1
        starts, periods = proposals(keys, context, scale)
        for i, q in zip((starts if places is None else places[starts]).tolist(), periods.tolist()):
            if q == done and i < upto:
                continue
            begin, upto = agreeing(words, i, q, 2 * scale)
            done = q
            if upto - begin >= 2 * q:
                found.setdefault((begin, upto + q), q)
        hashes, scale = context, scale * 2
    return sorted(((a, b, p) for (a, b), p in found.items()), key=lambda r: (r[0], r[2]))


def planted(words: list[bytes], doc_id) -> list[bytes]:
    """The words with the repetition that the id's checksum asks for."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def described(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """The fixed columns of one text with runs ``(start, length, period)`` in order."""
    dropped = np.zeros(len(words), bool)
    best = None
    for start, length, period in runs:
        dropped[start + period : start + length] = True
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    kept = [w for w, d in zip(words, dropped.tolist()) if not d] if runs else words
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    digest = lambda data: hashlib.sha256(data).hexdigest()
    return (len(runs), *first, digest(lines.encode()), digest(b" ".join(kept)), len(words), int(dropped.sum()))


def detect_runs(docs: DataFrame, shortest: int = 24, repetition: bool = True) -> DataFrame:
    """Per row of ``doc_id, text``: its runs of words, the strongest run, and the text without repeats.

    A run is a stretch of words with smallest period q, at least ``max(shortest, 3 * q)`` long, that no neighbour
    extends. ``repetition`` first repeats words of the texts whose id asks for it (a tenth of them), which gives
    a corpus known cases. Null and empty texts have no words and no run; a null id counts as an empty one; rows that
    repeat an id or text are answered each on their own; other columns are ignored. Each row is handled where it is
    read, so nothing is shuffled; a task holds ``PORTION`` bytes of text, or one text if that is longer.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = SCHEMA.format(kind=kind)
    names = [part.split()[0] for part in schema.split(", ")]

    def detect(batches):
        for batch in batches:
            for part in portions(batch, "text", PORTION):
                ids = part.column("doc_id").to_pylist()
                texts = [(t or "").encode("utf-8", "surrogatepass").split() for t in part.column("text").to_pylist()]
                if repetition:
                    texts = [planted(w, d) for w, d in zip(texts, ids)]
                bounds = np.concatenate([[0], np.cumsum([len(w) + 1 for w in texts])])
                flat = pa.array([w for t in texts for w in t], pa.large_binary()).dictionary_encode().indices
                words = np.empty(bounds[-1], np.int64)
                ends = bounds[1:] - 1
                inside = np.ones(len(words), bool)
                inside[ends] = False
                words[inside] = flat.to_numpy()
                words[ends] = -1 - np.arange(len(ends))
                runs = [[] for _ in texts]
                for a, b, p in periodic_runs(words, bounds):
                    if b - a >= shortest:
                        k = int(np.searchsorted(bounds, a, "right")) - 1
                        runs[k].append((a - int(bounds[k]), b - a, p))
                rows = zip(*[described(w, r) for w, r in zip(texts, runs)])
                columns = [pa.array(x, pa.string() if n.endswith("sha256") else pa.int64()) for n, x in zip(names[1:], rows)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names)

    return docs.select("doc_id", "text").mapInArrow(detect, schema)


#: The same by comparing words at every distance at which sixteen words in a row recur.
ORACLE = f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
  {crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '')")} AS h FROM documents),
placed AS (SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM texts),
planted AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
  THEN list_transform(range(0, n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END + 1]) ELSE w END AS w FROM placed),
words AS (SELECT r, n, unnest(w) AS word, unnest(range(0, n)) AS i FROM planted),
grams AS (SELECT r, n, i, hash(list(word) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)) AS g FROM words),
distances AS (SELECT DISTINCT x.r, y.i - x.i AS q FROM grams x JOIN grams y ON x.r = y.r AND x.g = y.g AND y.i > x.i AND y.i - x.i <= x.n // 3 WHERE y.i + 16 <= y.n),
agree AS (SELECT d.r, d.q, x.i FROM distances d JOIN words x ON x.r = d.r JOIN words y ON y.r = d.r AND y.i = x.i + d.q AND y.word = x.word),
islands AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM agree) GROUP BY r, q, island),
runs AS (SELECT r, start, length, min(q) AS period FROM islands WHERE length >= greatest(24, 3 * q) GROUP BY r, start, length),
described AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
  arg_min({{'s': start, 'l': length, 'p': period}}, {{'e': -length / CAST(period AS DOUBLE), 's': start, 'p': period}}) AS b FROM runs GROUP BY r),
dropped AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN dropped USING (r, i) GROUP BY r)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.l AS length, b.p AS period, 1000 * b.l // b.p AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM planted t LEFT JOIN described d ON d.r = t.r LEFT JOIN kept k ON k.r = t.r
"""
