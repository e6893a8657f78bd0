from difflib import SequenceMatcher
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from captura.functions import paths as P
from captura.functions import scores as S
from captura.functions import text as T
from captura.operators.consensus import field_consensus, text_consistency
from captura.operators.fusion import assess, fuse
from captura.operators.ocr import parse_fields
from captura.operators.similarity import mean_ordered_similarity, string_similarity

EVIDENCE = "id int, visual_integrity double, temporal_consistency double, ocr_confidence double, text_consistency double"


def test_fusion_values(spark):
    rows = [
        (0, 0.80, 0.90, 0.70, 1.00),
        (1, 0.80, None, None, 1.00),
        (2, 0.65, None, None, None),
        (3, None, None, None, None),
        (4, 0.90, 0.90, 0.70, 0.0),
        (5, float("nan"), 90.0, -0.2, 1.5),
    ]
    got = {r.id: r for r in assess(fuse(spark.createDataFrame(rows, EVIDENCE), breakdown=True)).collect()}
    assert [got[i].fused_integrity_score for i in range(5)] == [0.845, 0.8545, 0.65, 0.0, 0.735]
    assert [got[i].evidence_coverage for i in range(4)] == [1.0, 0.55, 0.40, 0.0]
    assert got[1].missing_sources == ["temporal_consistency", "ocr_confidence"]
    assert got[0].risk_level == "LOW" and got[3].risk_level == "HIGH"
    assert got[5].available_sources == ["temporal_consistency", "ocr_confidence", "text_consistency"]
    assert got[5].fused_integrity_score == 0.7  # 0.3 * 0.9 + 0.15 * 0 + 0.15 * 1 over 0.6


def test_score_normalization_and_risk_bounds(spark):
    raw = ["0.85", "0.75", "90.0", "-0.2", "1.5", None, "invalid", "NaN", "101", "3"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(raw)], "i int, v string")
    got = [r.n for r in df.select("i", S.normalize_score(F.col("v")).alias("n")).orderBy("i").collect()]
    assert got == [0.85, 0.75, 0.9, 0.0, 1.0, None, None, None, 1.0, 1.0]
    scores = spark.createDataFrame([(v,) for v in (1.0, 0.7, 0.6999, 0.4, 0.3999)], "s double")
    assert [r.r for r in scores.select(S.risk_level(F.col("s")).alias("r")).collect()] == [
        "LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH",
    ]
    with pytest.raises(ValueError):
        S.risk_level(F.lit(0.5), 0.4, 0.4)


def test_field_parsing(spark):
    texts = [
        "MOCK IDENTITY CARD\nNAME: SAMPLE CITIZEN\nDOB: 12/04/1998\nDOC NO: ID-4421-8890\nADDR: 42 ACADEMIC WAY",
        "NAME: ALICE MORGAN\nDOC NO: ID-9988-1122",
        "DOB: 99/99/1998",
        "NAME; TEST USER\nDOB; 01/01/2000\nDOC NO. ID-9988-1122\nADDR - PUNE MAHARASHTRA",
        "DOC NO: ID-44+21-8890",
        "MOCK IDENTITY CARD\nNAME: SAMPLE CITIZEN",
        "",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, full_text string")
    got = {r.i: r for r in parse_fields(df).collect()}
    assert (got[0].name, got[0].dob, got[0].document_number, got[0].address) == (
        "SAMPLE CITIZEN", "12/04/1998", "ID-4421-8890", "42 ACADEMIC WAY",
    )
    assert all(got[0].format_validity) and all(got[3].format_validity)
    assert got[1].dob is None and not got[1].field_presence.address
    assert got[2].field_presence.dob and not got[2].format_validity.dob
    assert got[4].document_number == "ID-4421-8890" and got[4].format_validity.document_number
    assert got[5].document_number is None
    assert not any(got[6].field_presence)


def test_dob_rules(spark):
    values = ["01/01/2000", "15/08/1995", "29/02/2024", "32/01/2000", "15/13/2000", "01/01/1850", "01/01/2099", "2000-01-01", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r.ok for r in df.select(T.valid_dob(F.col("v")).alias("ok")).collect()]
    assert got == [True] * 3 + [False] * 6


def test_string_similarity(spark):
    rows = [(0, "A", "a"), (1, None, "x"), (2, None, None), (3, "ID-4421-8890", "ID 4421 8890"), (4, "abcd", "bcda")]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    got = {r.i: r.similarity for r in string_similarity(df, "a", "b").collect()}
    assert [got[i] for i in range(4)] == [1.0, 0.0, 1.0, 1.0]
    assert got[4] == SequenceMatcher(None, "abcd", "bcda").ratio()


def _brute(values):
    clean = [" ".join(v.strip().lower().split()) for v in values]

    def sim(a, b):
        plain = lambda s: "".join(c for c in s if c.isalnum() or c == "_")
        if a == b or (plain(a) and plain(a) == plain(b)):
            return 1.0
        return SequenceMatcher(None, a, b).ratio()

    pairs = list(combinations(clean, 2))
    return sum(sim(a, b) for a, b in pairs) / len(pairs) if pairs else 1.0


@pytest.mark.parametrize("tile", [2, 10_000])
@pytest.mark.parametrize("frame", [lambda i: i * 7, lambda i: f"f{i:04d}"])
def test_value_tiles_match_brute_force(spark, tile, frame):
    """Tile size, NULL captures, single values and textual frame ids do not change the mean."""
    words = ["tide", "diet", "edit ", "tied", "DIET", "die-t", "tidy", "dit", "xyz", "abcab", "babca", " ", None]
    values = [words[(i * i + 3 * i) % len(words)] for i in range(60)]
    rows = [(v, "name", frame(i), w) for v in ("v", None) for i, w in enumerate(values)] + [("w", "name", frame(0), "one")]
    rows += [("x", "name", frame(i), "One" if i == 3 else None) for i in range(6)]
    kind = "int" if isinstance(frame(0), int) else "string"
    df = spark.createDataFrame(rows, f"video_id string, field string, frame_idx {kind}, value string").repartition(5)
    means = mean_ordered_similarity(df, ["video_id", "field"], "frame_idx", "value", tile_values=tile)
    got = {r.video_id: r.mean_similarity for r in means.collect()}
    want = _brute([v for v in values if v and v.strip()])
    assert got["v"] == pytest.approx(want, abs=1e-12) and got[None] == pytest.approx(want, abs=1e-12)
    assert got["w"] == 1.0 and got["x"] == 1.0 and len(got) == 4


def test_consensus(spark):
    schema = "video_id string, frame_idx int, name string, dob string, document_number string, address string"
    same = [("a", i, "SAMPLE CITIZEN", "12/04/1998", "ID-1", "42 WAY") for i in range(3)]
    mixed = [("b", 0, "SAMPLE CITIZEN", "12/04/1998", "ID-1", None), ("b", 1, "ANOTHER PERSON", "12/04/1998", "ID-1", " ")]
    df = spark.createDataFrame(same + mixed, schema)
    fields = {(r.video_id, r.field): r for r in field_consensus(df).collect()}
    assert fields["b", "name"].consensus == "SAMPLE CITIZEN" and fields["b", "name"].consistency < 0.5
    assert fields["b", "dob"].consistency == 1.0 and not fields["b", "address"].present
    assert fields["b", "name"].presence_rate == 0.5
    summary = {r.video_id: r for r in text_consistency(df).collect()}
    assert summary["a"].text_consistency == 1.0 and summary["b"].text_consistency < 1.0
    assert summary["b"].problematic_fields == ["name", "address"]


def test_document_and_clip_ids(spark):
    cases = {
        "doc_001_f02.png": "doc_001", "doc_045_frame_12.jpg": "doc_045", "video_03_f01.png": "video_03",
        "card_99_frame.png": "card_99", "REAL/doc_100/frame_01.png": "doc_100", "alb_id_00.cc0001_000001.png": "alb_id_00",
        "REAL/sample_f1.png": "sample", "REAL/plain.png": "plain",
    }
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.d for r in df.select("p", P.doc_id(F.col("p")).alias("d")).collect()} == cases
    clips = spark.createDataFrame([("alb_id_00.cc0001",), ("aze_passport_01.or0001",), ("odd",)], "c string")
    got = [tuple(r.m) for r in clips.select(P.clip_metadata(F.col("c")).alias("m")).collect()]
    assert got == [
        ("alb_id_00", "cc", "alb_id_00.cc0001"), ("aze_passport_01", "or", "aze_passport_01.or0001"), ("odd", "unknown", "odd"),
    ]
