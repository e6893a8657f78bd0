"""Small corpora with the awkward cases, and plain versions of what the operators compute."""

import random
import re
import zlib
from collections import Counter, defaultdict

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "row string, n int, key double, len string, at string, u double, w string, size string, chunk string, "
    "keep string, item string, copies string, stratum string, toxic string, target string"
)


def words(rng, n, pool=400):
    return [f"w{int(rng.random() ** 2 * pool)}" for _ in range(n)]


def corpus(seed=1, n=60):
    """(doc_id, text, lang, source): copies, near copies, shared passages, nulls, ties, repeats, a very long text."""
    rng = random.Random(seed)
    rows = [[i, " ".join(words(rng, rng.randint(5, 160))), rng.choice(["en", "de"]), f"s{i % 3}"] for i in range(n)]
    passage = " ".join(words(rng, 40))
    for i in range(0, n, 7):
        rows[i][1] += "\n" + passage
    for i in range(3, n, 9):
        w = rows[i - 1][1].split()
        w[len(w) // 2] = "changed"
        rows[i][1] = " ".join(w)
    for i in range(4, n, 11):
        rows[i][1] = rows[i - 2][1].upper()
    rows += [
        [n, None, "en", "s0"], [n + 1, "", "en", "s0"], [n + 2, " \n\t", None, None], [None, rows[5][1], "en", None],
        [None, None, None, None], list(rows[6]), list(rows[6]), [8, "another text under a known id", "en", "s1"],
        [n + 3, " ".join(words(rng, 20_000, 5000)), "en", "s0"], [n + 4, "a" * 300 + " " + "a" * 120, "en", "s2"],
        [n + 5, "it's 12½ <|endoftext|> x\x1cy É日本 Σ́ 'S", "fr", "s9"], [-5, passage + " tail", "de", "s1"],
    ]
    return [tuple(r) for r in rows]


def frame(spark, rows):
    extra = (None, 1, 0.5) + ("x",) * 2 + (0.1,) + ("x",) * 9
    return spark.createDataFrame([(*r, len(r[1] or ""), *extra) for r in rows], SCHEMA).repartition(3)


def fold(doc_id, n):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def split(text):
    return (text or "").encode().lower().split()


def near_groups(rows, n=5, percent=80):
    """(doc_id, n_shingles, component_id) of every row."""
    sets = []
    for _, text, *_ in rows:
        w = split(text)
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)].append(r[0])
    return [(r[0], len(sets[i]), min(least[find(i)], default=None)) for i, r in enumerate(rows)]


def hits(text, items, longest=10):
    """n_words, n_hit, ids of items with an occurring window."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = cut(text), set(), set()
    for item, body in items:
        b = cut(body)
        size = min(longest, len(b))
        windows = {tuple(b[k : k + size]) for k in range(len(b) - size + 1)} if b else set()
        for k in range(len(w) - size + 1):
            if size and tuple(w[k : k + size]) in windows:
                hit.update(range(k, k + size))
                found.add("" if item is None else str(item))
    return len(w), len(hit), sorted(found)


def repeats(rows, length=50):
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row."""
    place = lambda d: float("inf") if d is None else d
    least = {}
    for d, text, *_ in rows:
        b = (text or "").encode()
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            least[s] = min(least.get(s, float("inf")), place(d))
    out = []
    for d, text, *_ in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if least[b[k : k + length]] < place(d):
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept))
    return out


def counts(rows):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every row."""
    out = []
    for _, text, *_ in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        marked = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        out.append((len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked)))
    return out
