"""Similarity of strings at once, and its mean over ordered frame pairs, against plain versions."""

import random
import re
from difflib import SequenceMatcher

import pytest

from captura.functions.sequences import pair_similarity
from captura.operators.similarity import mean_ordered_similarity


def strings(seed, n, lengths, alphabets=("ab", "abc ", "abcdefgh 123é")):
    rng, left, right = random.Random(seed), [], []
    for _ in range(n):
        letters = rng.choice(alphabets)
        a = "".join(rng.choice(letters) for _ in range(rng.choice(lengths)))
        b = list(a) if rng.random() < 0.5 else [rng.choice(letters) for _ in range(rng.choice(lengths))]
        for _ in range(rng.randint(0, 5)):
            if b:
                b[rng.randrange(len(b))] = rng.choice(letters)
        left.append(a)
        right.append("".join(b))
    return left, right


@pytest.mark.parametrize("n, lengths", [(1500, (0, 1, 5, 20, 40)), (25, (150, 199, 200, 420))])
def test_ratio_of_matching_blocks(n, lengths):
    left, right = strings(1, n, lengths)
    want = [SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)]
    assert pair_similarity(left, right).tolist() == pytest.approx(want, abs=1e-12)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_levenshtein():
    left, right = strings(2, 400, (0, 1, 7, 30))
    want = [1 - distance(a, b) / max(len(a), len(b), 1) for a, b in zip(left, right)]
    assert pair_similarity(left, right, "levenshtein").tolist() == pytest.approx(want, abs=1e-12)
    assert pair_similarity([], []).tolist() == []
    with pytest.raises(ValueError):
        pair_similarity([], [], "other")


def plain_mean(values, rate):
    """Mean over ordered pairs of the values of one group."""
    clean = [" ".join(v.strip().lower().split()) for v in values]

    def similar(a, b):
        p, q = re.sub(r"\W", "", a), re.sub(r"\W", "", b)
        return 1.0 if a == b or (p and p == q) else rate(a, b)

    rated = {(a, b): similar(a, b) for a in set(clean) for b in set(clean)}
    pairs = [rated[a, b] for i, a in enumerate(clean) for b in clean[i + 1 :]]
    return sum(pairs) / len(pairs) if pairs else 1.0


@pytest.mark.parametrize("tile, bucket", [(128, 4096), (3, 4096), (128, 20), (3, 20)])
def test_mean_over_ordered_pairs(spark, tile, bucket):
    rng = random.Random(7)
    pool = ["ID-4421-8890", "ID 4421 8890", "id 4421-889", "XY-1", "", "  ", "Ann  Lee", "anne lee", "LEE ANN", "abab", "baba"]
    rows = [("many", "f", 977 * i * i, rng.choice(pool)) for i in range(150)]
    rows += [(None, "f", i, rng.choice(pool[:3])) for i in range(70)]
    rows += [("two", "g", i, pool[i % 2 * 3]) for i in range(90)] + [("two", None, i, pool[5 + i % 3]) for i in range(9)]
    rows += [("one", "f", 1, "x"), ("same", "f", 1, "y"), ("same", "f", 2, "Y "), ("none", "f", 1, None)]
    df = spark.createDataFrame(rows, "video_id string, field string, frame_idx long, value string").repartition(3)
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio()
    edits = lambda a, b: 1 - distance(a, b) / max(len(a), len(b), 1)
    for metric, rate in (("ratio", ratio), ("levenshtein", edits)):
        found = mean_ordered_similarity(df, ["video_id", "field"], "frame_idx", "value", metric, tile, bucket)
        got = {(r.video_id, r.field): r.mean_similarity for r in found.collect()}
        want = {}
        for v, f, _, x in sorted(rows, key=lambda r: r[2]):
            if x and x.strip():
                want.setdefault((v, f), []).append(x)
        assert set(got) == set(want)
        for k, values in want.items():
            assert got[k] == pytest.approx(plain_mean(values, rate), abs=1e-9), (metric, k)


def test_small_groups_agree_with_tiles(spark):
    words = ["ada lovelace", "Ada  Lovelace", "ada lovelase", "alan turing", None, " "]
    rows = [(g if g else None, f"f{g % 2}", k // 2, words[(k * 7 + g) % 6]) for g in range(6) for k in range(g * 3)]
    df = spark.createDataFrame(rows + [(77, "one", 0, "x")], "video_id int, field string, frame_idx int, value string")
    for metric in ("ratio", "levenshtein"):
        one, tiled = (
            {(r.video_id, r.field): r.mean_similarity for r in mean_ordered_similarity(df, ["video_id", "field"], "frame_idx", "value", metric, t, b).collect()}
            for t, b in ((128, 4096), (2, 4))
        )
        assert one == pytest.approx(tiled) and one[77, "one"] == 1.0 and len(one) == len({(r[0], r[1]) for r in rows if (r[3] or "").strip()}) + 1


def test_patterns_are_matched_once(spark):
    from captura.plans.verify import verify_text

    lines = spark.createDataFrame([(1, f, 0, t, 0.9) for f, t in enumerate(["NAME: ADA", "NAME: ADA", "NAME: EDA"])], "video_id int, frame_idx int, line_no int, text string, confidence double")
    frames = spark.createDataFrame([(1, f) for f in range(4)], "video_id int, frame_idx int")
    found = verify_text(lines, frames)
    assert "Full Name" not in found._jdf.queryExecution().toString()  # the parsed frames are a table by now
    row = found.first()
    assert (row.name, row.frames_analyzed, row.ocr_confidence) == ("ADA", 4, 0.675)
