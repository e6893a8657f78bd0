"""Exact vector search, runs of words and spelling variants against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from captura.llm import spelling, vector_search
from captura.llm.periodic_runs import detect_runs, periodic_runs
from tests.llm.cases import corpus, frame

# --- exact search ------------------------------------------------------------------------------


def ranked(rows, k=10, scale=1024):
    """(query_id, rank, vec_id, score) of every query, in Python's whole numbers."""
    part = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            part.append((i, [math.floor(scale * x) for x in v]))
    out = []
    for n, (i, q) in enumerate(part):
        if i is None or i % 100:
            continue
        limit = lambda s: max(-(2**63) + 1, min(2**63 - 1, s))
        scored = [(-limit(sum(a * b for a, b in zip(q, v))), j is None, j or 0, j) for m, (j, v) in enumerate(part) if m != n]
        out += [(i, r + 1, j, -s) for r, (s, _, _, j) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def searched(spark, rows, k=10, kind="double"):
    schema = f"vec_id long, embedding array<{kind}>, score string, q int, rank string, ids string, own double"
    df = spark.createDataFrame([(i, v, "x", 1, None, "y", 0.5) for i, v in rows], schema).repartition(3)
    found = vector_search.nearest(df, df.filter("vec_id % 100 = 0"), k)
    assert dict(found.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    return sorted([tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect()], key=str)


def vectors(seed, n, dims):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dims))
    return [(i, (centres[rng.integers(5)] * 0.2 + rng.normal(size=dims) * 0.05).tolist()) for i in range(n)]


def test_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "CHUNK", 64)
    rows = vectors(1, 700, 20)
    assert searched(spark, rows, 7) == ranked(rows, 7)


def test_search_over_several_slabs(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "SLAB", 2)
    rows = vectors(2, 650, 9)
    assert searched(spark, rows, 3) == ranked(rows, 3)


def test_search_of_awkward_vectors(spark):
    rows = vectors(3, 120, 12)
    rows += [(200, rows[5][1]), (300, [0.0] * 12), (None, rows[7][1]), (400, None), (500, [None] + [1.0] * 11), (600, [float("nan")] * 12)]
    rows += [(700, [float("inf")] * 12), (800, []), (900, [0.5, -0.25]), (100, rows[100][1]), (100, rows[100][1]), (100, rows[3][1])]
    rows += [(-100, [0.01] * 30), (3, rows[4][1]), (3, rows[4][1]), (1100, [-1e-9] * 12)]
    assert searched(spark, rows) == ranked(rows)


def test_search_of_huge_components(spark):
    rows = [(0, [1e12, -3e11, 5.0]), (1, [2e12, 1.0, 1.0]), (2, [-1e12, 0.25, 3.0]), (100, [1e30, 0.0, 1.0]), (3, [1e5, 1e4, 0.5])]
    assert searched(spark, rows) == ranked(rows)
    assert searched(spark, [(0, [1e307] * 3), (1, [1.0] * 3)]) == []


def test_search_of_few_and_no_vectors(spark):
    assert searched(spark, []) == []
    assert searched(spark, [(0, [1.0])]) == []
    assert searched(spark, [(0, [1.0]), (5, [2.0])], kind="float") == [(0, 1, 5, 2048 * 1024)]
    assert searched(spark, [(i, [0.5, 0.5]) for i in range(40)])[:3] == [(0, 1, 1, 524288), (0, 10, 10, 524288), (0, 2, 2, 524288)]


# --- runs of words ------------------------------------------------------------------------------


def plain_runs(w):
    """Every maximal stretch of at least three of its smallest period: (start, end, period)."""
    found = {}
    for q in range(1, len(w) // 3 + 1):
        start = None
        for k, same in enumerate([w[i] == w[i - q] for i in range(q, len(w))] + [False]):
            if same and start is None:
                start = k
            if not same and start is not None:
                if k + q - start >= 3 * q:
                    found.setdefault((start, k + q), q)
                start = None
    return sorted(((a, b, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def repetitive(rng, n):
    kind = rng.randint(0, 5)
    if kind == 0:
        return [rng.randint(0, 1) for _ in range(n)]
    if kind == 1:
        return [0] * n
    if kind == 2:
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    if kind == 3:
        t, a = [rng.randint(0, 9) for _ in range(n)], rng.randrange(max(1, n))
        p = 1 + (n - a) // (3 + rng.randint(0, 7))
        return [t[i] if i < a else t[a + (i - a) % p] for i in range(n)]
    if kind == 4:
        return (([0] * rng.randint(5, 60) + [1]) * 100)[:n]
    out = []
    while len(out) < n:
        block = [rng.randint(0, rng.choice([1, 3, 50])) for _ in range(rng.randint(1, 40))]
        if rng.random() < 0.5:
            block = block[:3] * rng.randint(1, 12) + block
        out += block * rng.randint(1, 6)
        if rng.random() < 0.5:
            out += [rng.randint(0, 100) for _ in range(rng.randint(0, 9))]
    return out[:n]


def test_runs_of_word_numbers():
    rng, seen = random.Random(5), 0
    for _ in range(60):
        texts = [repetitive(rng, rng.choice([0, 1, 2, 23, 24, 80, 200, 400, 900])) for _ in range(rng.randint(1, 6))]
        bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        words = np.concatenate([np.array(t + [-1 - k], np.int64) for k, t in enumerate(texts)])
        want = [(a + int(bounds[k]), b + int(bounds[k]), q) for k, t in enumerate(texts) for a, b, q in plain_runs(t)]
        assert periodic_runs(words, bounds) == sorted(want, key=lambda r: (r[0], r[2]))
        seen += len(want)
    assert seen > 1000


def described(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(w)
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = [(a, b - a, q) for a, b, q in plain_runs(w) if b - a >= 24]
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    fixed = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *fixed, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_of_documents(spark):
    rng = random.Random(8)
    rows = [r for r in corpus(3, 90) if len(r[1] or "") < 50_000]
    rows += [(1000 + k, " ".join(f"v{x}" for x in repetitive(rng, rng.choice([24, 60, 300]))), "en", "s") for k in range(60)]
    rows += [(2000, "ja " * 24, None, None), (2001, "ja " * 23, None, None), (2002, "Ja ja " * 12, "en", "s"), (2003, ("a\x0bb\tc\xa0d " * 9), "en", "s")]
    got = detect_runs(frame(spark, rows)).drop("n_words", "n_dropped").collect()
    assert sorted(map(tuple, got), key=str) == sorted([described(r[0], r[1]) for r in rows], key=str)
    assert sum(r.n_runs > 0 for r in got) > 30


def test_runs_of_a_very_long_text(spark):
    rng = random.Random(9)
    line = [f"x{rng.randint(0, 9999)}" for _ in range(7000)]
    text = " ".join([f"y{k}" for k in range(30_000)] + line * 4 + ["end"] * 50 + [f"z{k}" for k in range(30_000)])
    row = detect_runs(frame(spark, [(1, text, "en", "s")])).first()
    assert (row.n_runs, row.start, row.length, row.period) == (2, 58_000, 50, 1)
    assert row.n_dropped == 3 * 7000 + 49 and row.n_words == 30_000 + 28_000 + 50 + 30_000


def test_runs_of_no_documents(spark):
    assert detect_runs(frame(spark, [(1, "a", "en", "s")]).limit(0)).count() == 0


# --- spelling variants ---------------------------------------------------------------------------


def vocabulary(rows, shortest=7, repetition=2):
    total = Counter()
    for d, text, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 31 == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            total[w] += 1
    return {w: n for w, n in total.items() if len(w) >= shortest and n >= repetition}


def neighbours(words):
    """Near words of every word, through all single deletions."""
    holes, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[w[:i] + w[i + 1 :], i].add(w)
    for (short, _), group in holes.items():
        if short in words:
            for w in group:
                near[w].add(short)
                near[short].add(w)
        for w in group:
            near[w] |= group - {w}
    return near


def variants(total, ratio=10):
    near, form, out = neighbours(total), {}, []
    for w, n in total.items():
        best = min(near[w], key=lambda v: (-total[v], v), default=None)
        if best is not None and total[best] >= ratio * n:
            form[w] = best
    for w, n in total.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), total[form[w]] if w in form else None))
    return sorted(out)


def letters(seed, n, lowest=6, highest=12, symbols="abé"):
    """Words that are close to each other, the first ones frequent."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        w = list(rng.choice(out)) if out and rng.random() < 0.7 else [rng.choice(symbols) for _ in range(rng.randint(lowest, highest))]
        at = rng.randrange(len(w))
        rng.choice([lambda: w.insert(at, rng.choice(symbols)), lambda: w.pop(at), lambda: w.__setitem__(at, rng.choice(symbols))])()
        out.append("".join(w))
    return out


def written(seed, n=400):
    rng, pool = random.Random(seed), letters(seed, n)
    texts = [" ".join(pool[int(rng.random() ** 6 * len(pool))] for _ in range(rng.randint(0, 300))) for _ in range(80)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    rows += [(100, "ABCDEFGH abcdefgh abcdefg× abcdefg×h Übung-über_größere größere GRÖSSERE", "de", None), (None, texts[3], None, "s"), (101, None, None, None)]
    return rows + [(102, "", "en", "s"), (5, texts[5], "en", "s"), (5, texts[6].upper(), "en", "s"), (103, "x" * 3000 + " " + "x" * 3000, "en", "s"), (104, "x" * 2999 + "y " + "x" * 3000 + "y", "en", "s"), (105, "x" * 2999 + "y " + "x" * 3000 + "y", "en", "s")]


@pytest.mark.parametrize("group, longest", [(4096, 64), (8, 4), (40, 64)])
def test_variants_equal_brute_force(spark, group, longest):
    rows = written(4)
    found = spelling.spelling_variants(frame(spark, rows), group=group, longest=longest)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = variants(vocabulary(rows))
    assert sorted(map(tuple, found.collect())) == want
    assert sum(r[1] is not None for r in want) > 20 and any(r[1] != r[2] for r in want if r[1])


def test_near_pairs_meet_once(spark):
    pool = {w: 1 + k % 7 for k, w in enumerate(sorted(set(letters(11, 900, 7, 9, "ab"))))}
    words = spark.createDataFrame(list(pool.items()), "word string, n long")
    for group in (4, 4096):
        parts = spelling.near_words(words, group, 64).groupBy("word").agg(F.sum("n_near").alias("k")).collect()
        assert {r.word: r.k for r in parts} == {w: len(v) for w, v in neighbours(pool).items() if v and w in pool}


def test_chain_of_forms(spark):
    texts = [("alphabet", 2000), ("alphabets", 200), ("alphabetsz", 20), ("alphabetszz", 2), ("zzzzzzzz", 2)]
    rows = [(1, " ".join([w] * n), "en", "s") for w, n in texts]
    found = spelling.spelling_variants(frame(spark, rows), damage=None)
    assert {r.word: r.root for r in found.collect()} == {w: "zzzzzzzz" if w[0] == "z" else "alphabet" for w, _ in texts}


def test_no_words(spark):
    assert spelling.spelling_variants(frame(spark, [(1, None, "en", "s"), (2, "short a b", "en", "s")])).count() == 0
    assert spelling.spelling_variants(frame(spark, [(1, "a", "en", "s")]).limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(frame(spark, [(1, "a", "en", "s")]), ratio=1)
