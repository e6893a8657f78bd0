"""Recognized text, field extraction and consensus queries."""

from pyspark.sql import functions as F

from captura.functions import text as T
from captura.operators.consensus import consensus_of, field_consensus, field_values, text_consistency
from captura.operators.ocr import confident_lines, frame_confidence, frame_text, ocr_run_summary, parse_fields, video_confidence
from captura.operators.similarity import string_similarity
from captura.plans import views as V
from captura.plans.registry import query, r
from captura.plans.verify import verify_text

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def strip_sql(x: str) -> str:
    return f"trim({x}, {_BLANKS})"


def _found(text: str, pattern: str, flags: str = "") -> str:
    return f"nullif({strip_sql(f'''regexp_extract({text}, '{flags}{pattern}', 1)''')}, '')"


def _parse_sql(source: str, text: str = "full_text") -> str:
    """CTEs ``raw_fields`` and ``parsed`` over a table with a text column."""
    raw = []
    for field in T.KEY_FIELDS:
        value = _found(text, T.LABELLED_PATTERNS[field], "(?i)")
        if field in T.UNLABELLED_PATTERNS:
            value = f"coalesce({value}, {_found(text, T.UNLABELLED_PATTERNS[field])})"
        raw.append(f"{value} AS raw_{field}")
    clean = []
    for field in T.KEY_FIELDS:
        if field == "document_number":
            kept = strip_sql(r"regexp_replace(raw_document_number, '[^\w\- ]', '', 'g')")
            clean.append(f"CASE WHEN regexp_matches({kept}, '\\d') THEN {kept} END AS document_number")
        else:
            edges = f"regexp_replace(raw_{field}, '^[^\\w]+|[^\\w]+$', '', 'g')"
            clean.append(f"{strip_sql(edges)} AS {field}")
    part = lambda i: f"try_cast(regexp_extract(dob, '{T.DATE_PATTERN}', {i}) AS INT)"
    year = f"CASE WHEN {part(3)} >= 100 THEN {part(3)} WHEN {part(3)} > 30 THEN {part(3)} + 1900 ELSE {part(3)} + 2000 END"
    valid = {
        "name": r"length(name) >= 2 AND length(regexp_replace(name, '[^\p{L}\s.\-]', '', 'g')) / length(name) >= 0.85e0",
        "dob": f"{part(1)} BETWEEN 1 AND 31 AND {part(2)} BETWEEN 1 AND 12 AND {year} BETWEEN 1900 AND 2026",
        "document_number": r"length(document_number) >= 5 AND regexp_matches(document_number, '\d') AND "
        r"(regexp_matches(document_number, '\p{L}') OR length(document_number) >= 8)",
        "address": "length(address) >= 6 AND instr(address, ' ') > 0",
    }
    flags = ", ".join(f"coalesce({e}, false) AS {f}_valid" for f, e in valid.items())
    return (
        f"raw_fields AS (SELECT *, {', '.join(raw)} FROM {source}), "
        f"clean_fields AS (SELECT *, {', '.join(clean)} FROM raw_fields), "
        f"parsed AS (SELECT *, {flags} FROM clean_fields)"
    )


_FIELDS = ", ".join(T.KEY_FIELDS)
_VALID = ", ".join(f"{f}_valid" for f in T.KEY_FIELDS)


def _flat(parsed):
    return parsed.select(
        "video_id",
        "frame_idx",
        *T.KEY_FIELDS,
        *[F.col(f"format_validity.{f}").alias(f"{f}_valid") for f in T.KEY_FIELDS],
    )


@query(
    "x03_x07_parse_fields",
    f"WITH {V.SQL_TEXT}, {_parse_sql('frame_text')} SELECT video_id, frame_idx, {_FIELDS}, {_VALID} FROM parsed",
)
def parse(spark, sf_dir):
    return _flat(parse_fields(V.frame_texts(spark, sf_dir)))


@query(
    "u02_custom_pattern",
    f"WITH {V.SQL_TEXT} SELECT video_id, frame_idx, "
    + strip_sql(r"regexp_replace(nullif(" + strip_sql(r"regexp_extract(full_text, '(?i)\bADDR\s*[:\-]\s*(\d+)', 1)") + r", ''), '^[^\w]+|[^\w]+$', '', 'g')")
    + " AS house FROM frame_text",
)
def custom_pattern(spark, sf_dir):
    parsed = parse_fields(V.frame_texts(spark, sf_dir), patterns={"address": r"\bADDR\s*[:\-]\s*(\d+)"})
    return parsed.select("video_id", "frame_idx", F.col("address").alias("house"))


# --- OCR lines -----------------------------------------------------------------


@query(
    "p01_confident_lines",
    f"WITH {V.SQL_TEXT}, {V.SQL_LINES} SELECT video_id, frame_idx, line_no, {strip_sql('text')} AS text, {r('confidence')} AS confidence "
    "FROM ocr_lines WHERE confidence >= 0.6e0",
)
def lines(spark, sf_dir):
    return confident_lines(V.ocr_lines(spark, sf_dir)).select("video_id", "frame_idx", "line_no", "text", "confidence")


_UNITS = "CAST(round_even(confidence * 1e4, 0) AS BIGINT)"
_FRAME_SQL = (
    f"{V.SQL_TEXT}, {V.SQL_LINES}, kept AS (SELECT video_id, frame_idx, line_no, {strip_sql('text')} AS text, {_UNITS} AS units "
    "FROM ocr_lines WHERE confidence >= 0.6e0), "
    "per_frame AS (SELECT video_id, frame_idx, round_even(sum(units) / CAST(count(*) AS DOUBLE), 0) / 1e4 AS average_confidence, count(*) AS line_count, "
    "string_agg(text, chr(10) ORDER BY line_no) AS full_text FROM kept GROUP BY 1, 2), "
    "frame_rows AS (SELECT o_custkey AS video_id, o_orderkey AS frame_idx, coalesce(average_confidence, 0e0) AS average_confidence, "
    "coalesce(line_count, 0) AS line_count, coalesce(full_text, '') AS full_text FROM orders LEFT JOIN per_frame p "
    "ON p.video_id = o_custkey AND p.frame_idx = o_orderkey)"
)
_OCR_SQL = (
    "ocr_conf AS (SELECT video_id, round_even(sum(CAST(round_even(average_confidence * 1e4, 0) AS BIGINT)) / CAST(count(*) AS DOUBLE), 0) / 1e4 "
    "AS ocr_confidence FROM frame_rows GROUP BY 1)"
)


def _frames(spark, sf_dir):
    return V.table(spark, sf_dir, "orders").selectExpr("o_custkey AS video_id", "o_orderkey AS frame_idx")


@query(
    "a01_frame_text",
    f"WITH {_FRAME_SQL} SELECT video_id, frame_idx, average_confidence, line_count, full_text FROM frame_rows",
)
def frame_texts(spark, sf_dir):
    return frame_text(V.ocr_lines(spark, sf_dir), _frames(spark, sf_dir), keys=("video_id", "frame_idx"))


@query(
    "a01_frame_confidence",
    f"WITH {V.SQL_LINEITEM_LINES}, per_frame AS (SELECT frame_id, round_even(sum({_UNITS}) / CAST(count(*) AS DOUBLE), 0) / 1e4 AS average_confidence, "
    "count(*) AS line_count FROM item_lines WHERE confidence >= 0.6e0 GROUP BY 1) "
    "SELECT o_orderkey AS frame_id, coalesce(average_confidence, 0e0) AS average_confidence, coalesce(line_count, 0) AS line_count "
    "FROM orders LEFT JOIN per_frame ON frame_id = o_orderkey",
)
def confidences(spark, sf_dir):
    frames = V.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS frame_id")
    return frame_confidence(V.lineitem_lines(spark, sf_dir), frames)


@query("a02_video_ocr_confidence", f"WITH {_FRAME_SQL}, {_OCR_SQL} SELECT video_id, ocr_confidence FROM ocr_conf")
def video_ocr(spark, sf_dir):
    rows = frame_confidence(V.ocr_lines(spark, sf_dir), _frames(spark, sf_dir), keys=("video_id", "frame_idx"))
    return video_confidence(rows)


@query(
    "a33_ocr_run_summary",
    f"WITH {_FRAME_SQL} SELECT count(*) AS frames, count_if(line_count > 0) AS successful_frames, count_if(line_count = 0) AS failed_frames, "
    + r("count_if(line_count > 0) / count(*)")
    + " AS success_rate FROM frame_rows",
)
def run_summary(spark, sf_dir):
    rows = frame_confidence(V.ocr_lines(spark, sf_dir), _frames(spark, sf_dir), keys=("video_id", "frame_idx"))
    return ocr_run_summary(rows)


# --- consensus -------------------------------------------------------------------

_LONG_SQL = "long_fields AS (" + " UNION ALL ".join(
    f"SELECT video_id, frame_idx, '{f}' AS field, CASE WHEN {strip_sql(f)} <> '' THEN {f} END AS value, {f}_valid AS valid FROM parsed"
    for f in T.KEY_FIELDS
) + ")"
_CONSENSUS_SQL = (
    "tallies AS (SELECT video_id, field, value, count(*) AS n, min(frame_idx) AS first_seen FROM long_fields GROUP BY 1, 2, 3), "
    "best AS (SELECT video_id, field, value AS consensus, n AS frequency FROM tallies WHERE value IS NOT NULL "
    "QUALIFY row_number() OVER (PARTITION BY video_id, field ORDER BY n DESC, first_seen) = 1), "
    "groups AS (SELECT video_id, field, count(*) AS frames_analyzed, count(value) > 0 AS present, bool_or(valid) AND count(value) > 0 AS valid FROM long_fields GROUP BY 1, 2), "
    "agreed AS (SELECT g.video_id, g.field, consensus, coalesce(frequency, 0) AS frequency, present, valid, frames_analyzed "
    "FROM groups g LEFT JOIN best b ON g.video_id = b.video_id AND g.field = b.field)"
)


def _canon_sql(column: str) -> str:
    return strip_sql(rf"regexp_replace(lower({column}), '\s+', ' ', 'g')")


_CLEAN = _canon_sql("value")


def _ratio_sql(pairs: str) -> str:
    """``rated(x, y, sim)`` of distinct unequal pairs: a block is the longest, then first common substring, and both sides go on."""
    longest = (
        "list_max(list_transform(range(1, length(x) + 1), lambda i: {'k': len(list_filter(range(1, length(x) - i + 2), "
        "lambda k: contains(y, substr(x, i, k)))), 'i': -i}))"
    )
    return (
        f"open_pairs AS (SELECT x, y, row_number() OVER () AS id FROM (SELECT DISTINCT x, y FROM ({pairs}))), "
        "blocks AS (SELECT id, {'x': x, 'y': y, 'm': CAST(0 AS BIGINT)} AS u FROM open_pairs UNION ALL "
        "SELECT id, unnest([{'x': substr(x, 1, i - 1), 'y': substr(y, 1, j - 1), 'm': k}, {'x': substr(x, i + k), 'y': substr(y, j + k), 'm': CAST(0 AS BIGINT)}]) AS u "
        "FROM (SELECT *, strpos(y, substr(x, i, k)) AS j FROM (SELECT id, x, y, CAST(b.k AS BIGINT) AS k, CAST(-b.i AS BIGINT) AS i FROM "
        f"(SELECT id, x, y, {longest} AS b FROM (SELECT id, u.x AS x, u.y AS y FROM blocks) WHERE x <> '' AND y <> '')) WHERE k > 0)), "
        "rated AS (SELECT x, y, 2e0 * m / (length(x) + length(y)) AS sim FROM open_pairs p JOIN (SELECT id, sum(u.m) AS m FROM blocks GROUP BY 1) b ON b.id = p.id)"
    )


_SIM_SQL = (
    f"canon AS (SELECT video_id, field, frame_idx, {_CLEAN} AS c FROM long_fields WHERE value IS NOT NULL), "
    "alnum AS (SELECT *, regexp_replace(c, '[^\\w]', '', 'g') AS p FROM canon), "
    "pair_means AS (SELECT a.video_id, a.field, avg(CASE WHEN a.c = b.c THEN 1e0 WHEN a.p <> '' AND a.p = b.p THEN 1e0 "
    "ELSE 1e0 - levenshtein(a.c, b.c) / CAST(greatest(length(a.c), length(b.c)) AS DOUBLE) END) AS m "
    "FROM alnum a JOIN alnum b ON a.video_id = b.video_id AND a.field = b.field AND a.frame_idx < b.frame_idx GROUP BY 1, 2), "
    "per_field AS (SELECT g.*, CASE WHEN NOT present THEN 0e0 ELSE coalesce(" + r("m") + ", 1e0) END AS consistency, "
    + r("frequency / frames_analyzed")
    + " AS presence_rate FROM agreed g LEFT JOIN pair_means p ON g.video_id = p.video_id AND g.field = p.field)"
)
_RATIO_PAIRS = (
    "SELECT a.c AS x, b.c AS y FROM alnum a JOIN alnum b ON a.video_id = b.video_id AND a.field = b.field AND a.frame_idx < b.frame_idx "
    "WHERE a.c <> b.c AND NOT (a.p <> '' AND a.p = b.p)"
)
_EDIT_SIM = "1e0 - levenshtein(a.c, b.c) / CAST(greatest(length(a.c), length(b.c)) AS DOUBLE)"
_MEANS = "pair_means AS (SELECT a.video_id"
#: The same with the ratio of matching blocks for the edit distance.
_RATIO_SIM_SQL = (
    _SIM_SQL.replace(_MEANS, f"{_ratio_sql(_RATIO_PAIRS)}, {_MEANS}")
    .replace(_EDIT_SIM, "r.sim")
    .replace("AND a.frame_idx < b.frame_idx GROUP BY 1, 2)", "AND a.frame_idx < b.frame_idx LEFT JOIN rated r ON r.x = a.c AND r.y = b.c GROUP BY 1, 2)")
)
_PARSED_SQL = f"{V.SQL_TEXT}, {_parse_sql('frame_text')}, {_LONG_SQL}, {_CONSENSUS_SQL}"


@query(
    "a03_a04_field_consensus",
    f"WITH {_PARSED_SQL} SELECT video_id, field, consensus, frequency, present, valid, frames_analyzed FROM agreed",
)
def consensus(spark, sf_dir):
    parsed = parse_fields(V.frame_texts(spark, sf_dir))
    return consensus_of(field_values(parsed))


_PER_FIELD = "video_id, field, consensus, frequency, present, valid, consistency, presence_rate, frames_analyzed"


@query("a05_a07_field_consistency_levenshtein", f"WITH {_PARSED_SQL}, {_SIM_SQL} SELECT {_PER_FIELD} FROM per_field")
def consistency_levenshtein(spark, sf_dir):
    return field_consensus(parse_fields(V.frame_texts(spark, sf_dir)), metric="levenshtein")


@query("a05_a07_field_consistency", f"WITH RECURSIVE {_PARSED_SQL}, {_RATIO_SIM_SQL} SELECT {_PER_FIELD} FROM per_field")
def consistency(spark, sf_dir):
    return field_consensus(parse_fields(V.frame_texts(spark, sf_dir)))


def _summary_sql(per_field: str = "per_field") -> str:
    of = lambda f, c: f"max(CASE WHEN field = '{f}' THEN {c} END)"
    flag = lambda f: f"bool_or(field = '{f}' AND present)"
    cols = [f"{of(f, 'consensus')} AS {f}" for f in T.KEY_FIELDS]
    cols += [f"{of(f, 'consistency')} AS {f}_consistency" for f in T.KEY_FIELDS]
    stable = ", ".join(f"CASE WHEN {flag(f)} AND {of(f, 'consistency')} >= 0.85e0 THEN '{f}' END" for f in T.KEY_FIELDS)
    shaky = ", ".join(f"CASE WHEN NOT {flag(f)} OR {of(f, 'consistency')} < 0.7e0 THEN '{f}' END" for f in T.KEY_FIELDS)
    units = "CASE WHEN present THEN CAST(round_even(consistency * 1e4, 0) AS BIGINT) END"
    return (
        f"summary AS (SELECT video_id, {', '.join(cols)}, "
        f"coalesce(round_even(sum({units}) / CAST(count({units}) AS DOUBLE), 0) / 1e4, 0e0) AS text_consistency, "
        f"concat_ws(',', {stable}) AS stable_fields, concat_ws(',', {shaky}) AS problematic_fields, max(frames_analyzed) AS frames_analyzed "
        f"FROM {per_field} GROUP BY video_id)"
    )


_SUMMARY_COLUMNS = [
    "video_id",
    *T.KEY_FIELDS,
    *[f"{f}_consistency" for f in T.KEY_FIELDS],
    "text_consistency",
    "stable_fields",
    "problematic_fields",
    "frames_analyzed",
]


def _flat_summary(summary):
    listed = {c: F.array_join(c, ",") for c in ("stable_fields", "problematic_fields")}
    return summary.withColumns(listed).select(*[c for c in [*_SUMMARY_COLUMNS, "ocr_confidence"] if c in summary.columns])


@query(
    "a06_a08_text_consistency",
    f"WITH {_PARSED_SQL}, {_SIM_SQL}, {_summary_sql()} SELECT {', '.join(_SUMMARY_COLUMNS)} FROM summary",
)
def text_summary(spark, sf_dir):
    return _flat_summary(text_consistency(parse_fields(V.frame_texts(spark, sf_dir)), metric="levenshtein"))


_E1_SQL = (
    f"{_FRAME_SQL}, searched AS (SELECT video_id, frame_idx, CASE WHEN full_text <> '' THEN full_text || chr(10) || full_text ELSE full_text END AS t FROM frame_rows), "
    f"{_parse_sql('searched', 't')}, {_LONG_SQL}, {_CONSENSUS_SQL}, {_SIM_SQL}, {_summary_sql()}, {_OCR_SQL}"
)


@query(
    "e01_verify_text",
    f"WITH {_E1_SQL} SELECT {', '.join('s.' + c for c in _SUMMARY_COLUMNS)}, ocr_confidence FROM summary s JOIN ocr_conf o ON s.video_id = o.video_id",
)
def e1(spark, sf_dir):
    return _flat_summary(verify_text(V.ocr_lines(spark, sf_dir), _frames(spark, sf_dir), metric="levenshtein"))


E1_RATIO_SQL = _E1_SQL.replace(_SIM_SQL, _RATIO_SIM_SQL)


@query(
    "e01_verify_text_ratio",
    f"WITH RECURSIVE {E1_RATIO_SQL} SELECT {', '.join('s.' + c for c in _SUMMARY_COLUMNS)}, ocr_confidence "
    "FROM summary s JOIN ocr_conf o ON s.video_id = o.video_id",
)
def e1_ratio(spark, sf_dir):
    return _flat_summary(verify_text(V.ocr_lines(spark, sf_dir), _frames(spark, sf_dir)))


@query(
    "u03_custom_fields",
    f"WITH {_PARSED_SQL} SELECT video_id, count(*) FILTER (WHERE present) AS present_fields, sum(frequency) AS total_frequency "
    "FROM agreed WHERE field IN ('name', 'address') GROUP BY 1",
)
def custom_fields(spark, sf_dir):
    agreed = consensus_of(field_values(parse_fields(V.frame_texts(spark, sf_dir)), ("name", "address")))
    return agreed.groupBy("video_id").agg(
        F.count_if("present").alias("present_fields"), F.sum("frequency").alias("total_frequency")
    )


_PAIR_SQL = (
    "pairs AS (SELECT o_orderkey AS id, lower(o_orderpriority) || ' ' || c_name AS a, "
    "CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN upper(o_orderpriority || '  ' || c_name) WHEN 2 THEN replace(o_orderpriority || ' ' || c_name, '#', '-') "
    "ELSE c_mktsegment || ' ' || c_name END AS b FROM orders JOIN customer ON o_custkey = c_custkey)"
)


def _pairs(spark, sf_dir):
    orders, customer = V.table(spark, sf_dir, "orders"), V.table(spark, sf_dir, "customer")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    return joined.selectExpr(
        "o_orderkey AS id",
        "lower(o_orderpriority) || ' ' || c_name AS a",
        "CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN upper(o_orderpriority || '  ' || c_name) "
        "WHEN 2 THEN replace(o_orderpriority || ' ' || c_name, '#', '-') ELSE c_mktsegment || ' ' || c_name END AS b",
    )


@query(
    "x08_levenshtein_similarity",
    f"WITH {_PAIR_SQL}, c AS (SELECT id, a, b, {_canon_sql('a')} AS x, {_canon_sql('b')} AS y FROM pairs) "
    "SELECT id, round(CASE WHEN a IS NULL AND b IS NULL THEN 1e0 WHEN a IS NULL OR b IS NULL THEN 0e0 WHEN x = y THEN 1e0 "
    "WHEN regexp_replace(x, '[^\\w]', '', 'g') = regexp_replace(y, '[^\\w]', '', 'g') THEN 1e0 "
    "ELSE 1e0 - levenshtein(x, y) / CAST(greatest(length(x), length(y)) AS DOUBLE) END, 6) AS similarity FROM c",
)
def levenshtein(spark, sf_dir):
    rated = string_similarity(_pairs(spark, sf_dir), "a", "b", "levenshtein")
    return rated.select("id", F.round("similarity", 6).alias("similarity"))


@query(
    "x08_ratio_similarity",
    f"WITH RECURSIVE {_PAIR_SQL}, c AS (SELECT id, a, b, {_canon_sql('a')} AS x, {_canon_sql('b')} AS y FROM pairs), "
    + _ratio_sql("SELECT x, y FROM c WHERE a IS NOT NULL AND b IS NOT NULL AND x <> y")
    + " SELECT c.id, round(CASE WHEN a IS NULL AND b IS NULL THEN 1e0 WHEN a IS NULL OR b IS NULL THEN 0e0 WHEN c.x = c.y THEN 1e0 "
    "WHEN regexp_replace(c.x, '[^\\w]', '', 'g') = regexp_replace(c.y, '[^\\w]', '', 'g') THEN 1e0 ELSE sim END, 6) AS similarity "
    "FROM c LEFT JOIN rated r ON r.x = c.x AND r.y = c.y",
)
def ratio(spark, sf_dir):
    rated = string_similarity(_pairs(spark, sf_dir), "a", "b")
    return rated.select("id", F.round("similarity", 6).alias("similarity"))
