import hashlib
import math
import os
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import cases

from captura.llm import (
    decontaminate,
    graph,
    jaccard_join,
    lm_scoring,
    merkle,
    mixing,
    packed_ids,
    quality_rules,
    repeats,
    token_counts,
    tokens,
    toxicity,
)
from captura.llm.words import window_hashes

ROWS = cases.corpus()


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def docs(spark):
    return cases.frame(spark, ROWS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return cases.frame(spark, [])


def library(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(tokens.vocabulary_path()).encode_batch(texts, add_special_tokens=False)]


def test_op1_matches_plain_counts_and_mixture(spark, docs, none):
    got = order(lm_scoring.score_texts(docs).collect())
    learn, keep, texts = Counter(), Counter(), []
    pair, pair_keep = Counter(), Counter()
    for d, t, *_ in ROWS:
        w = [*cases.split(t), None]
        both = list(zip(["start", *w[:-1]], w))
        f = cases.fold(d, 7)
        if f != 2:
            learn.update(w)
            pair.update(both)
            if f != 3:
                keep.update(w)
                pair_keep.update(both)
        texts.append((d, f, w, both))
    docs_all = sum(f != 2 for _, f, _, _ in texts)
    docs_keep = sum(f not in (2, 3) for _, f, _, _ in texts)

    def parts(c, p, n_docs, w, both):
        n, v = sum(c.values()), len(c)
        for x, (a, b) in zip(w, both):
            context = n_docs if a == "start" else c[a]
            yield context, [1 / (v + 1), c[x] / n, p[a, b] / context if context else 0.0]

    cells = Counter()
    for _, f, w, both in texts:
        if f == 3:
            for context, (p0, p1, p2) in parts(keep, pair_keep, docs_keep, w, both):
                r = [round(8 * math.log(p / p0)) if p else -10_000 for p in (p1, p2)]
                cells[(int(lm_scoring.context_bucket(np.array([context]))[0]), *r)] += 1
    weights = lm_scoring.learn_weights(np.array(list(cells)), np.array(list(cells.values()), float), 3)
    n, v = sum(learn.values()), len(learn)
    want = []
    for d, f, w, both in texts:
        base = sum(math.log10((learn[x] + 1) / (n + v + 1)) for x in w)
        score = 0.0
        for context, p in parts(learn, pair, docs_all, w, both):
            score += math.log10(weights[int(lm_scoring.context_bucket(np.array([context]))[0])] @ p)
        want.append((d, f == 2, len(w), sum(learn[x] > 0 for x in w), n, base, score))
    want = order(want)
    assert [tuple(r[:5]) for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want])
    assert lm_scoring.score_texts(none).count() == 0
    three = lm_scoring.score_texts(docs, order=3).agg(F.sum("score")).first()[0]
    assert math.isfinite(three)


def test_op1_weights_raise_the_likelihood_of_held_out_counts():
    cells = np.array([[0, 8, 40], [0, 8, -10_000], [5, 16, 80]])
    n = np.array([30.0, 10.0, 50.0])
    ratio = np.exp(np.where(cells[:, 1:] < -9000, -np.inf, cells[:, 1:] / 8.0))
    value = lambda w: (n * np.log((w[cells[:, 0]] * np.column_stack([np.ones(3), ratio])).sum(1))).sum()
    weights = lm_scoring.learn_weights(cells, n, 3)
    assert np.allclose(weights.sum(1), 1)
    assert value(weights) > value(np.full((32, 3), 1 / 3))


@pytest.mark.parametrize("block, pairs", [(1024, 16), (3, 2)])
def test_op2_groups_match_all_pairs(docs, none, monkeypatch, block, pairs):
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", block)
    monkeypatch.setattr(jaccard_join, "PAIR_LIST", pairs)
    monkeypatch.setattr(jaccard_join, "SALT_ROWS", 2 if pairs == 2 else 4096)
    got = jaccard_join.near_duplicates(docs)
    assert order(got.select("doc_id", "n_shingles", "component_id").collect()) == order(cases.near_groups(ROWS))
    groups = got.filter("n_shingles > 0 AND component_id <> 8").groupBy("component_id").agg(F.sum(F.col("keep").cast("int")).alias("k"))
    assert groups.filter("k <> 1").isEmpty()  # two different texts have the id 8
    assert got.filter("n_shingles = 0 AND NOT keep").isEmpty()
    assert jaccard_join.near_duplicates(none).count() == 0


def test_op2_prefixes_share_what_they_promise():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(5, 60))
        base = rng.choice(500, n, replace=False)
        other = np.unique(np.concatenate([base[int(rng.integers(0, 4)) :], rng.choice(500, int(rng.integers(0, 4)))]))
        base, both = np.sort(base), len(np.intersect1d(base, other))
        if 100 * both >= 80 * (n + len(other) - both):
            for shared in range(1, 6):
                a = base[: jaccard_join.prefix_size(n, 80, shared)]
                b = other[: jaccard_join.prefix_size(len(other), 80, shared)]
                assert len(np.intersect1d(a, b)) >= min(shared, both)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 199)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 199, 199: 199}
    assert got == want


def test_op3_counts_and_verdicts(spark, docs, none):
    got = order(quality_rules.quality_verdicts(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    assert got == order((r[0], *c) for r, c in zip(ROWS, cases.counts(ROWS)))
    assert quality_rules.quality_verdicts(none).count() == 0
    import random

    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))
    rows = [(i, ". ".join(" ".join(word() for _ in range(8)).capitalize() for _ in range(12)), "en", None) for i in range(200)]
    junk = [(1000 + i, " ".join(word() + "$%&" for _ in range(90)), "en", None) for i in range(30)]
    verdicts = quality_rules.quality_verdicts(cases.frame(spark, rows + junk))
    kept = {r.doc_id: r.kept for r in verdicts.collect()}
    assert all(kept[r[0]] for r in rows) and not any(kept[r[0]] for r in junk)
    again = quality_rules.quality_verdicts(cases.frame(spark, rows + junk).repartition(9))
    assert order(again.collect()) == order(verdicts.collect())


def test_op3_duplicate_lines_or_repeats_alone_reject(spark):
    import random

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    line = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    rows = [(i, "\n".join(line(8) for _ in range(12)), "en", "s") for i in range(200)]
    many = [(1000 + i, "\n".join([line(56), *[line(2)] * 22]), "en", "s") for i in range(8)]  # 91% of lines, 44% of words
    spread = [(1100 + i, "\n".join(x for _ in range(12) for x in (line(8), "Share.")), "en", "s") for i in range(8)]
    phrase = line(6)
    inside = [(1200 + i, "\n".join(f"{line(8)} {phrase}" for _ in range(6)), "en", "s") for i in range(8)]  # no line twice
    verdicts = quality_rules.quality_verdicts(cases.frame(spark, rows + many + spread + inside)).collect()
    assert not [r.doc_id for r in verdicts if r.base_failed]
    assert not [r.doc_id for r in verdicts if r.kept != (r.doc_id < 1000)]


def test_op3_heavy_tails_widen_the_limit(spark):
    rng = np.random.default_rng(4)
    p, fit = len(quality_rules.STATISTICS), "struct<centre: array<double>, precision: array<double>>"
    values = np.round(rng.normal(size=(400, p)) * 3 * quality_rules.UNIT).astype(int)
    schema = ", ".join(f"{n} long" for n in quality_rules.STATISTICS) + f", stratum struct<k: string>, fit {fit}"
    rows = spark.createDataFrame([(*map(int, v), ("a",), ([0.0] * p, np.eye(p).ravel().tolist())) for v in values], schema)
    got = quality_rules._limits(rows, 1e-3).first()
    middle = np.median(((values / quality_rules.UNIT) ** 2).sum(1)) / quality_rules.chi2_quantile(0.5, p)
    assert got.members == 400 and got.limit == pytest.approx(middle * quality_rules.chi2_quantile(0.999, p), rel=0.03)


def test_op3_fit_is_the_plain_concentration(spark):
    rng = np.random.default_rng(2)
    p, unit = len(quality_rules.STATISTICS), quality_rules.UNIT
    values = np.round(rng.normal(size=(300, p)) * [900, 300, 500, 400, 300, 200]).astype(int)
    values[:40] += 6000
    rows = spark.createDataFrame([("a", *map(int, v)) for v in values], "stratum string, " + ", ".join(f"{n} long" for n in quality_rules.STATISTICS))
    rows = rows.withColumn("stratum", F.struct("stratum"))
    fit = quality_rules._fits(quality_rules._sums(rows)).first()["fit"]
    x = values / unit
    q = quality_rules.chi2_quantile(0.75, p)
    cov = np.cov(x.T, bias=True) * 0.75 / quality_rules.chi2_cdf(q, p + 2)
    spread = np.array(list(quality_rules.STATISTICS.values()))
    cov += np.diag(np.maximum(0, spread**2 - np.diag(cov)))
    assert np.allclose(fit["centre"], x.mean(0)) and np.allclose(fit["precision"], np.linalg.inv(cov).ravel())
    assert abs(quality_rules.chi2_quantile(0.95, 2) - 5.991464547) < 1e-6
    assert abs(quality_rules.chi2_cdf(3.0, 3) - 0.608374823728911) < 1e-9


def test_op4_learns_and_leaves_clean_texts_alone(spark, docs, none):
    import random

    rng = random.Random(9)
    rows, labels = [], []
    for i in range(900):
        w, bad = cases.words(rng, rng.randint(30, 90)), i % 6 == 0
        if bad:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["vilest", "vilely", "rottenish", "rottenly"])
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, 1, int(bad)))
    labels = spark.createDataFrame(labels + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    frame = cases.frame(spark, rows)
    got = {r.doc_id: r for r in toxicity.toxicity(frame, labels).collect()}
    held = [i for i in range(900) if cases.fold(i, 3) == 1]
    assert all(got[i].held_out == (i in set(held)) for i in range(900))
    assert np.mean([got[i].predicted == (i % 6 == 0) for i in held]) > 0.97
    scores = toxicity.toxicity(docs, labels).collect()
    assert len(scores) == len(ROWS) and all(0 <= r.score <= 1 for r in scores)
    assert toxicity.toxicity(none, labels).count() == 0
    assert toxicity.toxicity(docs, labels.filter("toxic = 0")).filter("predicted = 1").isEmpty()
    model = toxicity.train(frame, labels)
    text = spark.createDataFrame([(1, "w1 w2 w3 vilest rottenly w4 w5 w6 w7"), (2, None)], "doc_id long, text string")
    spans = {r.doc_id: r.passages for r in toxicity.toxic_passages(text, model).collect()}
    assert spans[2] == [] and [(p.first, p.end) for p in spans[1]] == [(3, 5)]


def test_op4_segments_are_the_maximal_ones():
    def plain(s):  # the recursive definition: the best segment, then both sides of it
        def best(lo, hi):
            top = None
            for a in range(lo, hi):
                for b in range(a + 1, hi + 1):
                    v = s[a:b].sum()
                    if v > 1e-12 and (top is None or v > top[2] + 1e-12):
                        top = (a, b, v)
            return [] if top is None else best(lo, top[0]) + [top] + best(top[1], hi)

        return best(0, len(s))

    rng = np.random.default_rng(1)
    for _ in range(60):
        s = rng.normal(-0.3, 1, 25)
        got, want = toxicity.maximal_segments(s), plain(s)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert np.allclose([x[2] for x in got], [x[2] for x in want])


ITEMS = [
    (1, " ".join(ROWS[10][1].split()[3:25])), (2, "w1 w2 w3"), (None, ROWS[20][1]), (4, None), (5, "-- !"), (2, ROWS[30][1].upper()),
]


@pytest.mark.parametrize("limit", [1_000_000, 1])
def test_op5_hits_match_plain_search(spark, docs, none, limit):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    got = decontaminate.contamination(docs, bench, broadcast_windows=limit).drop("text_hash", "spans").collect()
    want = []
    for d, t, *_ in ROWS:
        n, hit, items = cases.hits(t, ITEMS)
        want.append((d, n, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0))
    assert order(got) == order(want)
    assert decontaminate.contamination(none, bench).count() == 0
    empty = decontaminate.contamination(docs, bench.limit(0))
    assert empty.count() == len(ROWS) and empty.filter("contaminated").isEmpty()


def test_op5_removes_documents_or_spans(spark, docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    clean = [r for r in ROWS if not cases.hits(r[1], ITEMS)[1]]
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert order(kept.select("doc_id", "text").collect()) == order(r[:2] for r in clean)
    cut = decontaminate.decontaminate(docs, bench, remove="spans")
    assert cut.count() == len(ROWS)
    assert order(cut.filter("text IS NULL").select("doc_id").collect()) == order([(r[0],) for r in ROWS if r[1] is None])
    for d, text in [(r.doc_id, r.text) for r in cut.select("doc_id", "text").collect()]:
        assert text is None or len(text) <= max(len(r[1] or "") for r in ROWS if r[0] == d)
    with pytest.raises(ValueError):
        decontaminate.decontaminate(docs, bench, remove="lines")


def test_op6_files_round_trip(spark, docs, none, tmp_path):
    got = packed_ids.packed_corpus(docs).collect()
    rows = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    import zlib

    ids = {(r[0], r[1]): np.array([*i, 2], "<u4") for r, i in zip(rows, library([r[1] or "" for r in rows]))}
    want = Counter((k[0], len(v), zlib.crc32(v.tobytes())) for k, v in ((r[:2], ids[r[:2]]) for r in rows))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    placed = sorted(got, key=lambda r: r.start)
    assert [r.start for r in placed] == np.cumsum([0, *[r.n_tokens for r in placed]])[:-1].tolist()
    assert [(r.doc_id is not None, r.doc_id or 0) for r in placed] == sorted((r.doc_id is not None, r.doc_id or 0) for r in placed)
    assert packed_ids.packed_corpus(none).count() == 0
    packed_ids.write_packed(docs, str(tmp_path / "ids"), file_ids=500)
    assert packed_ids.read_packed(spark, str(tmp_path / "ids")).agg(F.sum("n_tokens")).first()[0] == sum(map(len, (ids[r[:2]] for r in rows)))


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 32])
def test_op6_packing_and_random_access(bits):
    rng = np.random.default_rng(bits)
    ids = [rng.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32) for n in (0, 5, 300, 4096, 9000)]
    file = packed_ids.PackedFile(packed_ids.file_bytes([7, None, 9, 9, -1], ids, bits, (3, 1), block=256) + b"\n")
    assert file.place == (3, 1) and file.doc_ids == [7, None, 9, 9, -1]
    for k, want in enumerate(ids):
        assert (file.document(k) == want).all()
    flat = np.concatenate(ids)
    for a, b in ((0, 1), (255, 257), (5000, 9001), (len(flat) - 1, len(flat)), (3, 3)):
        assert (file.ids(a, b) == flat[a:b]).all()
    assert packed_ids.bits_for(49408) == 16 and packed_ids.bits_for(2) == 1


def test_op7_counts_are_the_librarys(docs, none):
    got = order(token_counts.count_tokens(docs, limit=100).collect())
    n = [len(i) for i in library([r[1] or "" for r in ROWS])]
    assert got == order((r[0], len((r[1] or "").encode()), k, k > 100) for r, k in zip(ROWS, n))
    assert token_counts.count_tokens(none).count() == 0
    model = token_counts.count_tokens(docs, vocabulary="piece_bpe_32k.model")
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokens.vocabulary_path("piece_bpe_32k.model"))
    assert order(model.select("doc_id", "n_tokens").collect()) == order((r[0], len(sp.encode(r[1] or ""))) for r in ROWS)


def test_op7_every_character_below_256_and_a_full_cache():
    encoder = tokens.Encoder(cache=5)
    texts = [f"a{chr(c)}b1{chr(c)} {chr(c)} It's {c}" for c in range(256)] * 2
    assert [list(x) for x in encoder.ids(texts)] == library(texts)
    assert encoder.lengths(texts, {"it's": 2}) == [len(x) for x in library(texts)]


def test_op8_audit_finds_what_differs(spark):
    rows = [(a, r, f"record {a} {r}") for a in range(3) for r in range(100)] + [(None, None, "x"), (1, 5, "record 1 5")]
    one = merkle.leaves(spark.createDataFrame(rows, "archive long, record_id long, data string"))
    assert merkle.audit(one, one).isEmpty()
    assert one.filter("archive = 0").agg(F.max(F.col("offset") + F.col("n_bytes"))).first()[0] == sum(len(r[2]) for r in rows if r[0] == 0)
    changed = [(a, r, d.upper() if (a, r) in ((0, 17), (2, 99)) else d) for a, r, d in rows if (a, r) != (1, 99)]
    other = merkle.leaves(spark.createDataFrame(changed, "archive long, record_id long, data string"))
    got = {(r.archive, r.place): r.status for r in merkle.audit(one, other).collect()}
    assert got == {(0, 17): "corrupt", (2, 99): "corrupt", (1, 100): "missing"}
    assert len(merkle.tree(one)) == 3
    gone = merkle.audit(one, other.filter("archive <> 2"))
    assert gone.filter("archive = 2 AND status = 'missing'").count() == 100
    empty = one.limit(0)
    assert merkle.audit(empty, empty).isEmpty()
    pages = spark.createDataFrame([(5, None, None), (None, "u", "abc"), (102, "u", "xaz")], "page_id long, url string, html string")
    assert {r.page_id: r.status for r in merkle.fixity_report(pages).collect()} == {5: "ok", None: "ok", 102: "corrupt"}


def test_op9_takes_near_the_targets(spark, docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and mixing.mix(none).count() == 0
    sizes = Counter()
    for r, c in zip(ROWS, cases.counts(ROWS)):
        sizes[r[3]] += c[0]
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight, cap = {s: i % 3 + 1 for i, s in enumerate(names)}, {s: 3.0 * sizes[s] for s in names}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s], left = cap[s], left - cap[s]
        open_ -= over
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in names)
    again = mixing.mix(cases.frame(spark, ROWS).repartition(7))
    assert order(again.collect()) == order(got)


def test_op9_weights_change_the_odds(spark):
    rows = [(i, "w " * 10, "en", "a") for i in range(400)]
    frame = cases.frame(spark, rows).withColumn("quality", F.when(F.col("doc_id") < 200, 3.0).otherwise(1.0))
    more = spark.createDataFrame([(1000 + i, "w " * 10, "b", 0.5) for i in range(400)], "doc_id long, text string, source string, quality double")
    got = mixing.mix(frame.select("doc_id", "text", "source", "quality").union(more), weight="quality")
    took = {(r.source, r.high): r.n for r in got.groupBy("source", (F.col("doc_id") < 200).alias("high")).agg(F.sum("taken").alias("n")).collect()}
    first = got.filter("source = 'a'").first()
    assert abs(took["a", True] + took["a", False] - first.target) <= 10
    assert took["a", True] > 2 * took["a", False]


def test_op10_matches_plain_search(docs, none, monkeypatch):
    for shard in (1 << 20, 200):
        monkeypatch.setattr(repeats, "SHARD", shard)
        got = repeats.remove_repeats(docs).collect()
        want = [(*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in cases.repeats(ROWS)]
        assert order(got) == order(want)
    assert repeats.remove_repeats(none).count() == 0


def test_op10_a_common_passage_fills_no_group(spark, monkeypatch):
    import random

    rng = random.Random(3)
    passage = " ".join(cases.words(rng, 25))
    rows = [(i if i % 20 else None, " ".join(cases.words(rng, 12, 10**6)) + passage + " ".join(cases.words(rng, 12, 10**6)), "en", "s") for i in range(300)]
    rows += [(i, passage * 3, "en", "s") for i in range(5)]
    plain = repeats.marked_windows

    def limited(keys, *rest):
        most = np.unique(keys, return_counts=True)[1].max()
        assert most <= 20, f"{most} pieces of one seed in one group"
        return plain(keys, *rest)

    monkeypatch.setattr(repeats, "marked_windows", limited)
    monkeypatch.setattr(repeats, "CHUNK", 8000)
    monkeypatch.setattr(repeats, "HOT", 20, raising=False)
    got = repeats.remove_repeats(cases.frame(spark, rows)).collect()
    assert order(got) == order((*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in cases.repeats(rows))


def test_op10_keys_are_even():
    import random

    keys = repeats.pieces([" ".join(cases.words(random.Random(6), 20_000, 10**6))])[2]
    parts = np.bincount((keys >> np.uint64(61)).astype(int), minlength=8)
    assert parts.max() < 1.2 * parts.mean()


def test_op10_merged_order_is_the_sorted_one():
    rng = np.random.default_rng(4)
    rows = np.zeros((40, repeats.WIDEST), np.uint8)
    lengths = rng.integers(50, repeats.WIDEST + 1, 40)
    base = rng.integers(97, 99, 200).astype(np.uint8)
    for k in range(40):
        at = rng.integers(0, 120)
        rows[k, : lengths[k]] = base[at : at + lengths[k]]
    shards = []
    windows = [rows[k, o : o + 50].tobytes() for k in range(40) for o in range(lengths[k] - 49)]
    old, repeats.SHARD = repeats.SHARD, 300
    try:
        classes = repeats.window_classes(rows, lengths)
    finally:
        repeats.SHARD = old
    assert not shards and classes.tolist() == np.unique(windows, return_inverse=True)[1].tolist()


def test_window_hashes_depend_on_order_and_length():
    h = np.array([3, 5, 3, 5, 9], np.uint64)
    two = window_hashes(h, 2)
    assert two[0] == two[2] and two[0] != two[1] and len(window_hashes(h, 6)) == 0
    assert window_hashes(h[:1], 1)[0] != window_hashes(np.array([3, 0], np.uint64), 2)[0]
