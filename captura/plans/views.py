"""Logical capture tables composed from the driver tables.

The driver tables hold no captures, so frames, recognized text, candidates and
scores are derived from their columns, always over whole tables. Expressions are
kept as SQL text that both Spark and the checking engine evaluate the same way;
literals with an exponent are doubles in both.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FRAME_W, FRAME_H = 1600, 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fixed(df: DataFrame, columns: dict, kept=()) -> DataFrame:
    """Rows of derived columns that later steps use by reference, as if read from a table.

    The optimizer copies the definition of a projected column into every filter and
    expression above it. A one-row generator is evaluated once and stays in place.
    """
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def placed(df: DataFrame, columns: dict, kept=()) -> DataFrame:
    """The columns of :func:`fixed` as a projection, which keeps the order of rows."""
    return df.select(*kept, *[c.alias(n) for n, c in columns.items()])


def _select(df: DataFrame, exprs: dict) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {a}" for a, e in exprs.items()])


def sql_select(exprs: dict, source: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {a}" for a, e in exprs.items()) + f" FROM {source}"


# --- recognized text: one frame per order, one capture per customer ---------

_LETTERS = "chr(CAST(65 + v % 26 AS INT)) || chr(CAST(65 + CAST(floor(v / 26) AS BIGINT) % 26 AS INT))"
_P4 = "lpad(CAST(v % 10000 AS STRING), 4, '0')"
_Q4 = "lpad(CAST((v * 7) % 10000 AS STRING), 4, '0')"
_DD = "lpad(CAST(v % 28 + 1 AS STRING), 2, '0')"
_MM = "lpad(CAST(v % 12 + 1 AS STRING), 2, '0')"
_YY = "CAST(1950 + v % 50 AS STRING)"
_WORD = (
    "CASE v % 5 WHEN 0 THEN 'ACADEMIC' WHEN 1 THEN 'STATION' WHEN 2 THEN 'RIVER' WHEN 3 THEN 'MARKET' ELSE 'HILL' END"
)
TEXT_KEYS = {"v": "o_custkey", "f": "o_orderkey", "seg": "c_mktsegment"}
TEXT_LINES = {
    "video_id": "v",
    "frame_idx": "f",
    "full_text": "concat_ws(chr(10), "
    "CASE WHEN f % 11 = 1 THEN 'MOCK IDENTITY CARD' "
    f"WHEN f % 7 = 0 THEN 'NAME; ' || seg || ' Q' || {_LETTERS} "
    f"WHEN f % 7 = 3 THEN 'Holder: ' || lower(seg || ' ' || {_LETTERS}) "
    f"ELSE 'NAME: ' || seg || ' ' || {_LETTERS} END, "
    "CASE WHEN f % 13 = 0 THEN 'DOB: 99/99/1998' "
    f"WHEN f % 13 = 5 THEN 'Birth Date ' || {_YY} || '-' || {_MM} || '-' || {_DD} "
    f"WHEN f % 13 = 7 THEN {_DD} || '/' || {_MM} || '/' || {_YY} "
    "WHEN f % 13 = 9 THEN 'DOB MISSING' "
    f"ELSE 'DOB; ' || {_DD} || '/' || {_MM} || '/' || {_YY} END, "
    f"CASE WHEN f % 7 = 2 THEN 'DOC NO: ID-' || substr({_P4}, 1, 2) || '+' || substr({_P4}, 3, 2) || '-' || {_Q4} "
    f"WHEN f % 7 = 5 THEN 'XY-' || {_P4} || '-' || {_Q4} "
    "WHEN f % 17 = 3 THEN 'DOC NO: PENDING' "
    f"ELSE 'DOC NO. ID-' || {_P4} || '-' || {_Q4} END, "
    "CASE WHEN f % 11 = 4 THEN 'NO ADDRESS' "
    f"WHEN f % 11 = 6 THEN 'ADDR - ' || lower(CAST(v % 90 + 10 AS STRING) || ' ' || {_WORD} || ' WAY') "
    f"ELSE 'ADDR: ' || CAST(v % 90 + 10 AS STRING) || ' ' || {_WORD} || ' WAY' END)",
}
SQL_TEXT = (
    "frame_text AS (" + sql_select(TEXT_LINES, "(" + sql_select(TEXT_KEYS, "orders JOIN customer ON o_custkey = c_custkey") + ")") + ")"
)


def frame_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    orders = orders.select("o_custkey", "o_orderkey")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    return _select(_select(joined, TEXT_KEYS), TEXT_LINES)


# --- OCR lines: the lines of those texts, with a confidence per line ---------

LINE_CONFIDENCE = "0.4e0 + ((frame_idx * 7 + line_no * 13) % 101) / 168e0"
SQL_LINES = (
    "split_lines AS (SELECT video_id, frame_idx, unnest(string_split(full_text, chr(10))) AS text, "
    "unnest(range(0, len(string_split(full_text, chr(10))))) AS line_no FROM frame_text), "
    f"ocr_lines AS (SELECT video_id, frame_idx, line_no, text, {LINE_CONFIDENCE} AS confidence FROM split_lines)"
)


def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = frame_texts(spark, sf_dir)
    lines = texts.select("video_id", "frame_idx", F.posexplode(F.split("full_text", "\n")).alias("line_no", "text"))
    return lines.withColumn("confidence", F.expr(LINE_CONFIDENCE))


# --- OCR line confidences of every order line ---------------------------------

SQL_LINEITEM_LINES = (
    "item_lines AS (SELECT l_orderkey AS frame_id, 1e0 - 5e0 * l_discount - (l_partkey % 7) / 100e0 AS confidence FROM lineitem)"
)


def lineitem_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return items.selectExpr(
        "l_orderkey AS frame_id",
        "1e0 - 5e0 * l_discount - (l_partkey % 7) / 100e0 AS confidence",
        "CAST(l_partkey AS STRING) AS text",
    )


# --- embeddings, conversation frames, predictions, samples --------------------


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr("label AS video_id", "vec_id AS frame_idx", "embedding AS vec")


SQL_EMBEDDINGS = (
    "emb AS (SELECT label AS video_id, vec_id AS frame_idx, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"
)


def conversation_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr("conv_id AS video_id", "turn AS frame_idx", "role")


PREDICTION = {
    "experiment_id": "lang",
    "doc_id": "d.doc_id",
    "y_true": "toxic",
    "y_score": "(n_chars % 101) / 101e0",
    "y_pred": "CASE WHEN (n_chars % 101) / 101e0 >= 0.5e0 THEN 1 ELSE 0 END",
    "p_real": "1e0 - (n_chars % 101) / 101e0",
}
SQL_PREDICTIONS = "pred AS (" + sql_select(PREDICTION, "documents d JOIN labels l ON d.doc_id = l.doc_id") + ")"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").alias("d")
    labels = table(spark, sf_dir, "labels").alias("l")
    return _select(docs.join(labels, F.col("d.doc_id") == F.col("l.doc_id")), PREDICTION)


SAMPLE = {
    "path": "CASE WHEN coalesce(quality, CAST(d.doc_id % 2 AS INT)) = 1 THEN 'REAL' ELSE 'ATTACKED' END || '/' || source || '_f' || lpad(CAST(d.doc_id AS STRING), 8, '0') || '.png'",
    "label": "CASE WHEN coalesce(quality, CAST(d.doc_id % 2 AS INT)) = 1 THEN 0 ELSE 1 END",
    "class_name": "CASE WHEN coalesce(quality, CAST(d.doc_id % 2 AS INT)) = 1 THEN 'REAL' ELSE 'ATTACKED' END",
    "doc_id": "source",
    "pos": "d.doc_id",
    "attack_type": "CASE d.doc_id % 4 WHEN 0 THEN 'photo_tamper' WHEN 1 THEN 'text_alteration' WHEN 2 THEN 'screen_replay' ELSE 'print_scan' END",
    "document_type": "lang",
    "split": "CASE WHEN d.doc_id % 50 = 7 THEN 'val' WHEN length(source) % 3 = 0 THEN 'test' ELSE 'train' END",
    "n_chars": "n_chars",
}
SQL_SAMPLES = "samples AS (" + sql_select(SAMPLE, "documents d LEFT JOIN labels l ON d.doc_id = l.doc_id") + ")"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a frame of its source; unlabelled ones alternate between the classes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").alias("d")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").alias("l")
    return _select(docs.join(labels, F.col("d.doc_id") == F.col("l.doc_id"), "left"), SAMPLE)


# --- candidate quads: one frame per order, one candidate per order line ---------

_ASPECT = (
    "CASE CAST(l_quantity AS BIGINT) % 5 WHEN 0 THEN 1.586e0 WHEN 1 THEN 1.42e0 WHEN 2 THEN 1.3e0 WHEN 3 THEN 1.75e0 ELSE 2.2e0 END"
)
BOX = {
    "l_orderkey": "l_orderkey",
    "cand_id": "cand_id",
    "px": "CAST(40 + (l_partkey * 13 + l_suppkey * 7) % 500 AS DOUBLE)",
    "py": "CAST(40 + (l_suppkey * 11 + l_linenumber * 17) % 300 AS DOUBLE)",
    "pw": "CAST(420 + (l_partkey * 29 + l_linenumber * 31) % 560 AS DOUBLE)",
    "pa": _ASPECT,
    "sk": "CAST(l_partkey % 9 - 4 AS DOUBLE)",
    "edge_quality": "(l_partkey % 41) / 41e0",
}
CORNERS = {
    "video_id": "l_orderkey",
    "frame_id": "l_orderkey",
    "cand_id": "cand_id",
    "x0": "px",
    "y0": "py",
    "x1": "px + pw",
    "y1": "py + sk",
    "x2": "px + pw + sk",
    "y2": "py + pw / pa",
    "x3": "px - sk",
    "y3": "py + pw / pa",
    "edge_quality": "edge_quality",
}
CANDIDATE = ["video_id", "frame_id", "cand_id"]
ORDER_IN_FRAME = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity"]
SQL_CORNERS = (
    "numbered AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY "
    + ", ".join(ORDER_IN_FRAME)
    + ") AS cand_id FROM lineitem), "
    "boxes AS (" + sql_select(BOX, "numbered") + "), "
    "corners AS (" + sql_select(CORNERS, "boxes") + ")"
)


def corner_rows(spark: SparkSession, sf_dir: str, derive=None) -> DataFrame:
    """Corners of every order line, dealt by frame once and in order of ``cand_id`` within it.

    ``derive`` adds columns to kept ones: ``fixed`` if filters on derived columns follow, ``placed`` if none do, which
    leaves rows dealt and sorted for the next step by frame.
    """
    derive = derive or fixed
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("video_id"), F.col("l_orderkey").alias("frame_id"), *ORDER_IN_FRAME)
    order = Window.partitionBy(*CANDIDATE[:2]).orderBy(*ORDER_IN_FRAME)
    numbered = items.withColumn("cand_id", F.row_number().over(order))
    for exprs in (BOX, CORNERS):
        numbered = derive(numbered, {a: F.expr(e) for a, e in exprs.items() if a not in ("l_orderkey", *CANDIDATE)}, CANDIDATE)
    return numbered


def candidates(spark: SparkSession, sf_dir: str, derive=None) -> DataFrame:
    from captura.functions.geometry import coordinates_area, quad

    rows = corner_rows(spark, sf_dir, derive)
    xs, ys = ([F.col(f"{axis}{i}") for i in range(4)] for axis in ("x", "y"))
    return (derive or fixed)(
        rows,
        {
            "corners": quad(*[c for pair in zip(xs, ys) for c in pair]),
            "edge_quality": F.col("edge_quality"),
            "area": coordinates_area(xs, ys),
            "frame_w": F.lit(FRAME_W),
            "frame_h": F.lit(FRAME_H),
        },
        CANDIDATE,
    )


# --- evidence: four nullable scores per customer ----------------------------------

EVIDENCE = {
    "visual_integrity": "CASE WHEN o_custkey % 5 = 1 THEN NULL ELSE sum((o_orderkey * 37) % 101) / (101e0 * count(*)) END",
    "temporal_consistency": "CASE WHEN o_custkey % 7 = 2 THEN NULL ELSE sum((o_orderkey * 53) % 97) / (97e0 * count(*)) END",
    "ocr_confidence": "CASE WHEN o_custkey % 11 = 3 THEN NULL ELSE 100e0 * max((o_orderkey * 17) % 89) / 89e0 END",
    "text_consistency": "CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE min((o_orderkey * 29) % 83) / 83e0 - 0.1e0 END",
}
SQL_EVIDENCE = "evidence AS (" + sql_select({"video_id": "o_custkey", **EVIDENCE}, "orders GROUP BY o_custkey") + ")"


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    scores = orders.groupBy("o_custkey").agg(*[F.expr(e).alias(a) for a, e in EVIDENCE.items()])
    return scores.withColumnRenamed("o_custkey", "video_id")


# --- stage runs: one row per event -----------------------------------------------

STAGE = {
    "video_id": "user_id",
    "stage_name": "event_type",
    "duration_seconds": "value",
    "items_processed": "event_id % 4",
    "failed": "event_id % 29 = 0",
}


def stage_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(table(spark, sf_dir, "events"), STAGE)


SQL_STAGES = "stages AS (" + sql_select(STAGE, "events") + ")"
