import os
import random
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import cases

import corpus_pipeline
from captura.llm import mixing, quality_rules, tokens
from captura.llm.common import materialize


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Input and output of every stage, as rows."""
    rng = random.Random(3)
    rows = [(i, " ".join(cases.words(rng, rng.randint(60, 120), 3000)), "en", f"s{i % 2}") for i in range(90)]
    for i in range(5, 90, 10):  # near copies of the document before
        rows[i] = (i, rows[i - 1][1] + " tail", *rows[i][2:])
    passage = " ".join(cases.words(rng, 12, 3000))
    for i in range(7, 90, 20):
        rows[i] = (i, rows[i][1] + " " + passage, *rows[i][2:])
    rows += [(200 + i, "x$ y% " * 60, "en", "s0") for i in range(4)] + [(300, None, "en", None), (3, rows[3][1], "en", "s1")]
    base = str(tmp_path_factory.mktemp("tables"))
    cases.frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    docs, out = spark.read.parquet(f"{base}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, docs, base), "stage")
        out.append((name, docs, after))
        docs = after
    return base, passage, out


def pairs(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_stages_in_order_keep_the_columns(steps):
    _, _, out = steps
    assert [n for n, _, _ in out] == [n for n, _ in corpus_pipeline.STAGES] and len(out) == 5
    for _, before, after in out[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_keeps_what_the_rule_keeps(steps):
    _, before, after = steps[2][0]
    kept = Counter(r.doc_id for r in quality_rules.quality_verdicts(before).filter("kept").collect())
    assert Counter(r.doc_id for r in after.select("doc_id").collect()) == kept
    assert not any(i >= 200 for i in kept) and len(kept) >= 88


def test_one_document_of_each_group_stays(steps):
    _, before, after = steps[2][1]
    rows = [tuple(r) for r in before.select("doc_id", "text").collect()]
    want = Counter({c: 1 for _, _, c in cases.near_groups(rows)})
    assert Counter(d for d, _ in pairs(after).elements()) == want and after.count() < before.count()


def test_contaminated_documents_go(steps):
    _, passage, out = steps
    _, before, after = out[2]
    clean = Counter({k: n for k, n in pairs(before).items() if not cases.hits(k[1], [(1, passage)])[1]})
    assert pairs(after) == clean and after.count() < before.count()


def test_mixture_repeats_documents_as_sampled(steps):
    _, before, after = steps[2][3]
    copies = Counter({r.doc_id: r.copies for r in mixing.mix(before).collect() if r.copies})
    assert Counter(r.doc_id for r in after.select("doc_id").collect()) == copies


def test_token_files_hold_the_mixture(steps):
    from tokenizers import Tokenizer

    _, before, after = steps[2][4]
    rows = list(pairs(before).elements())
    encoded = Tokenizer.from_file(tokens.vocabulary_path()).encode_batch([t for _, t in rows], add_special_tokens=False)
    want = Counter((d, len(e.ids) + 1, zlib.crc32(np.array([*e.ids, 2], "<u4").tobytes())) for (d, _), e in zip(rows, encoded))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in after.collect()) == want


def test_run_gives_the_last_stage(spark, steps):
    base, _, out = steps
    assert Counter(map(tuple, corpus_pipeline.run(spark, base).collect())) == Counter(map(tuple, out[-1][2].collect()))
