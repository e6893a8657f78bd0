"""Manifests, splits, leakage, audit and annotation queries."""

from pyspark.sql import functions as F

from captura.functions import paths as P
from captura.operators import audit as A
from captura.operators import splits as S
from captura.plans import views as V
from captura.plans.registry import query, r
from captura.sources import annotations as VIA
from captura.sources import manifests as M
from captura.sources.sinks import priority_first

_S = V.SQL_SAMPLES


@query(
    "x01_doc_id",
    f"WITH {_S} SELECT pos, source_dir, CASE pos % 3 WHEN 0 THEN source_dir WHEN 1 THEN 'alb_id_' || lpad(CAST(pos % 8 AS STRING), 2, '0') ELSE 'doc-' || CAST(pos % 90 AS STRING) END AS doc_id "
    "FROM (SELECT pos, doc_id AS source_dir FROM samples)",
)
def doc_ids(spark, sf_dir):
    rows = V.samples(spark, sf_dir).select("pos", F.col("doc_id").alias("source_dir"))
    path = (
        F.when(F.col("pos") % 3 == 0, F.concat(F.lit("REAL/"), F.col("source_dir"), F.lit("/frame_01.png")))
        .when(
            F.col("pos") % 3 == 1,
            F.concat(F.lit("ATTACKED/alb_id_"), F.lpad((F.col("pos") % 8).cast("string"), 2, "0"), F.lit(".cc0001_000007.jpg")),
        )
        .otherwise(F.concat(F.lit("real/doc-"), (F.col("pos") % 90).cast("string"), F.lit("_f02.png")))
    )
    return rows.select("pos", "source_dir", P.doc_id(path).alias("doc_id"))


_CLIPS = (
    "clips AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'alb_id_' || lpad(CAST(l_suppkey % 8 AS STRING), 2, '0') AS document_id, "
    "CASE l_partkey % 4 WHEN 0 THEN 'or' WHEN 1 THEN 'cc' WHEN 2 THEN 'cg' ELSE 're' END AS attack_type, lpad(CAST(l_suppkey AS STRING), 4, '0') AS serial, "
    "lpad(CAST(l_orderkey AS STRING), 8, '0') || '_' || CAST(l_linenumber AS STRING) AS frame FROM lineitem), "
    "files AS (SELECT document_id || '.' || attack_type || serial AS clip_id, document_id, attack_type, CASE WHEN attack_type = 'or' THEN 'REAL' ELSE 'ATTACKED' END AS label, "
    "'frames/' || document_id || '.' || attack_type || serial || '/' || frame || '.jpg' AS path, 1000 + l_partkey % 977 AS length, l_suppkey FROM clips)"
)


def clip_listing(spark, sf_dir, which="true"):
    """A file listing with one frame file per order line."""
    items = V.table(spark, sf_dir, "lineitem").filter(which)
    clip = (
        "'alb_id_' || lpad(CAST(l_suppkey % 8 AS STRING), 2, '0') || '.' || CASE l_partkey % 4 WHEN 0 THEN 'or' WHEN 1 THEN 'cc' WHEN 2 THEN 'cg' ELSE 're' END "
        "|| lpad(CAST(l_suppkey AS STRING), 4, '0')"
    )
    return items.selectExpr(
        f"'frames/' || {clip} || '/' || lpad(CAST(l_orderkey AS STRING), 8, '0') || '_' || CAST(l_linenumber AS STRING) || '.jpg' AS path",
        "1000 + l_partkey % 977 AS length",
    )


@query(
    "x02_p12_clip_metadata",
    f"WITH {_CLIPS} SELECT clip_id, document_id, attack_type, label, count(*) AS frames FROM files GROUP BY 1, 2, 3, 4",
)
def clip_meta(spark, sf_dir):
    files = M.clip_files(clip_listing(spark, sf_dir))
    return files.groupBy("clip_id", "document_id", "attack_type", "label").agg(F.count(F.lit(1)).alias("frames"))


_SPLIT_CASE = "CASE " + " ".join(f"WHEN document_id = '{d}' THEN '{s}'" for d, s in S.DOCUMENT_SPLITS.items()) + " ELSE 'unassigned' END"
_INVENTORY = (
    f"{_CLIPS}, annotated AS (SELECT DISTINCT clip_id FROM files WHERE l_suppkey % 3 <> 0), "
    f"inv AS (SELECT f.clip_id, document_id, attack_type, label, {_SPLIT_CASE} AS split, count(*) AS frame_count, sum(length) AS disk_bytes, min(path) AS sample_frame_path, "
    "CASE WHEN any_value(a.clip_id) IS NULL THEN 'missing' ELSE 'available' END AS annotation_status FROM files f LEFT JOIN annotated a ON f.clip_id = a.clip_id GROUP BY 1, 2, 3, 4, 5)"
)


def _inventory(spark, sf_dir):
    files = S.assign_split(M.clip_files(clip_listing(spark, sf_dir)), S.DOCUMENT_SPLITS, "document_id", "unassigned")
    # Names keep four digits of a supplier, so the annotated ones are known by the table alone.
    annotated = M.clip_files(clip_listing(spark, sf_dir, "l_suppkey % 3 <> 0")).select("clip_id")
    return A.inventory(files, annotated)


@query(
    "s07_j02_j04_inventory",
    f"WITH {_INVENTORY} SELECT clip_id, document_id, attack_type, label, split, frame_count, disk_bytes, sample_frame_path, annotation_status FROM inv",
)
def inventory(spark, sf_dir):
    return _inventory(spark, sf_dir)


@query(
    "a27_ingestion_report",
    f"WITH {_INVENTORY} SELECT count(DISTINCT document_id) AS total_documents, count(*) AS total_clips, sum(frame_count) AS total_frames, {r('sum(disk_bytes) / 1048576e0', 2)} AS total_disk_mb, "
    + ", ".join(f"count_if(attack_type = '{m}') AS clips_{m}" for m in ("or", "cc", "cg", "re"))
    + ", "
    + ", ".join(f"count_if(split = '{s}') AS clips_{s}" for s in ("train", "validation", "test"))
    + " FROM inv",
)
def ingestion(spark, sf_dir):
    return A.ingestion_report(_inventory(spark, sf_dir))


@query(
    "l01_leak_free_split_sizes",
    f"WITH {_S}, docs AS (SELECT doc_id, arg_min(label, pos) AS label FROM samples GROUP BY 1), n AS (SELECT label, count(*) AS n FROM docs GROUP BY 1), "
    "a AS (SELECT label, n, greatest(1, CAST(round_even(n * 0.7e0, 0) AS BIGINT)) AS nt, greatest(1, CAST(round_even(n * 0.15e0, 0) AS BIGINT)) AS nv FROM n), "
    "b AS (SELECT label, n, nt, CASE WHEN nt + nv >= n THEN greatest(1, n - nt) ELSE nv END AS nv FROM a), "
    "t AS (SELECT label, n, nt, nv, nt + nv >= n AND nt > 1 AS moved FROM b), "
    "z AS (SELECT label, 'train' AS split, CASE WHEN n <= 2 THEN 1 WHEN moved THEN nt - 1 ELSE nt END AS documents FROM t UNION ALL "
    "SELECT label, 'val', CASE WHEN n <= 2 THEN n - 1 ELSE least(nv, n - nt) END FROM t UNION ALL SELECT label, 'test', CASE WHEN n <= 2 THEN 0 WHEN moved THEN 1 ELSE n - nt - nv END FROM t) "
    "SELECT label, split, documents FROM z WHERE documents > 0",
)
def split_sizes(spark, sf_dir):
    assigned = S.document_splits(V.samples(spark, sf_dir).drop("split"))
    return assigned.groupBy("label", "split").agg(F.count(F.lit(1)).alias("documents"))


@query(
    "l01_l02_split_is_leak_free",
    f"WITH {_S} SELECT 0 AS train_val_overlap, 0 AS train_test_overlap, 0 AS val_test_overlap, true AS is_leak_free, count(*) AS samples FROM samples",
)
def leak_free(spark, sf_dir):
    split = S.grouped_split(V.samples(spark, sf_dir).drop("split"))
    report = S.leakage(split).withColumn("k", F.lit(1))
    total = split.agg(F.count(F.lit(1)).alias("samples")).withColumn("k", F.lit(1))
    return report.join(total, "k").drop("k")


_MEMBERS = f"{_S}, mem AS (SELECT doc_id, bool_or(split = 'train') AS a, bool_or(split = 'val') AS b, bool_or(split = 'test') AS c FROM samples GROUP BY 1)"


@query(
    "l02_leakage_check",
    f"WITH {_MEMBERS} SELECT count_if(a AND b) AS train_val_overlap, count_if(a AND c) AS train_test_overlap, count_if(b AND c) AS val_test_overlap, "
    "count_if((a AND b) OR (a AND c) OR (b AND c)) = 0 AS is_leak_free FROM mem",
)
def leakage(spark, sf_dir):
    return S.leakage(V.samples(spark, sf_dir))


@query(
    "l03_leaking_documents",
    f"WITH {_MEMBERS} SELECT doc_id, concat_ws(',', CASE WHEN a THEN 'train' END, CASE WHEN b THEN 'val' END, CASE WHEN c THEN 'test' END) AS splits FROM mem WHERE (a AND b) OR (a AND c) OR (b AND c)",
)
def leaking(spark, sf_dir):
    return S.leaking_documents(V.samples(spark, sf_dir))


@query(
    "l04_u2_identity_overlap",
    "SELECT DISTINCT sha256(d.text) AS identity FROM documents d JOIN benchmark b ON sha256(d.text) = sha256(b.text) UNION SELECT DISTINCT CAST(d.doc_id AS VARCHAR) FROM documents d JOIN benchmark b ON d.doc_id = b.item_id",
)
def identities(spark, sf_dir):
    docs, bench = V.table(spark, sf_dir, "documents"), V.table(spark, sf_dir, "benchmark")
    both = lambda df, key: df.select(
        F.explode(F.array(F.sha2("text", 256), F.col(key).cast("string"))).alias("identity")
    )
    return S.overlap(both(docs, "doc_id"), both(bench, "item_id"), "identity")


@query(
    "j03_u3_allocation_gaps",
    f"WITH {_S} SELECT DISTINCT doc_id, 'not_allocated' AS problem FROM samples WHERE doc_id NOT IN (SELECT lang FROM documents) UNION ALL "
    "SELECT DISTINCT lang, 'not_in_manifest' FROM documents WHERE lang NOT IN (SELECT source FROM documents)",
)
def gaps(spark, sf_dir):
    allocation = V.table(spark, sf_dir, "documents").select(F.col("lang").alias("doc_id"))
    return S.allocation_gaps(V.samples(spark, sf_dir), allocation)


@query(
    "l05_s11_reassign_split",
    f"WITH {_S}, alloc AS (SELECT doc_id, CASE WHEN count(*) % 3 = 0 THEN 'train' WHEN count(*) % 3 = 1 THEN 'val' ELSE 'test' END AS split FROM samples GROUP BY 1) "
    "SELECT pos, a.split, a.split || '/' || class_name || '/' || regexp_extract(path, '([^/]+)$', 1) AS crop_path FROM samples s JOIN alloc a ON s.doc_id = a.doc_id",
)
def reassign(spark, sf_dir):
    rows = V.samples(spark, sf_dir)
    n = F.count(F.lit(1)) % 3
    split = F.when(n == 0, F.lit("train")).when(n == 1, F.lit("val")).otherwise(F.lit("test"))
    allocation = rows.groupBy("doc_id").agg(split.alias("split"))
    manifest = rows.select("pos", "doc_id", "split", F.col("class_name").alias("label"), F.col("path").alias("crop_path"))
    moved = priority_first(S.reassign(manifest, allocation), ("pos", "split", "crop_path"))
    return moved.select(*moved.columns[:3])


@query(
    "a25_split_summary",
    f"WITH {_S} SELECT split, count(*) AS total, count_if(class_name = 'REAL') AS real, count_if(class_name = 'ATTACKED') AS attacked, count(DISTINCT doc_id) AS documents, "
    f"{r('count(*) / sum(count(*)) OVER () * 100e0', 1)} AS percentage FROM samples GROUP BY split",
)
def split_summary(spark, sf_dir):
    return A.split_summary(V.samples(spark, sf_dir))


@query(
    "a26_split_breakdown",
    f"WITH {_S} SELECT split, 'all' AS dimension, '' AS value, count(*) AS n FROM samples GROUP BY 1 UNION ALL "
    + " UNION ALL ".join(
        f"SELECT split, '{d}', CAST({d} AS VARCHAR), count(*) FROM samples GROUP BY 1, 3" for d in ("label", "doc_id", "document_type", "attack_type")
    ),
)
def breakdown(spark, sf_dir):
    return A.split_breakdown(V.samples(spark, sf_dir))


@query(
    "a28_normalization_summary",
    f"WITH {_S}, rows_ AS (SELECT split, class_name AS label, attack_type, CASE WHEN n_chars % 9 = 0 THEN 'none' WHEN n_chars % 2 = 0 THEN 'tier1' ELSE 'tier2' END AS method, CASE WHEN n_chars % 9 = 0 THEN 0 ELSE 1 END AS ok FROM samples), "
    "x AS (SELECT 'all' AS dimension, '' AS value, method, ok FROM rows_ UNION ALL SELECT 'split', split, method, ok FROM rows_ UNION ALL SELECT 'label', label, method, ok FROM rows_ "
    "UNION ALL SELECT 'mode', attack_type, method, ok FROM rows_ UNION ALL SELECT 'method', method, method, ok FROM rows_) "
    f"SELECT dimension, value, count(*) AS processed, sum(ok) AS succeeded, sum(1 - ok) AS failed, {r('sum(ok) / count(*) * 100e0', 2)} AS success_pct, "
    f"{r(chr(99) + 'ount_if(method = ' + chr(39) + 'tier2' + chr(39) + ') / count(*) * 100e0', 2)} AS tier2_pct FROM x GROUP BY 1, 2",
)
def normalization(spark, sf_dir):
    rows = V.samples(spark, sf_dir).withColumn("label", F.col("class_name"))
    method = F.when(F.col("n_chars") % 2 == 0, F.lit("tier1")).otherwise(F.lit("tier2"))
    good = rows.filter(F.col("n_chars") % 9 != 0).withColumn("localization_method", method)
    return A.normalization_summary(good, rows.filter(F.col("n_chars") % 9 == 0))


@query(
    "a30_validate_dataset",
    f"WITH {_S} SELECT doc_id AS source, count_if(label = 0) AS real_count, count_if(label = 1) AS attacked_count, count(*) AS total_count, count(DISTINCT split) AS unique_groups, "
    "count_if(label = 0) >= 20 AND count_if(label = 1) >= 20 AND count(DISTINCT split) >= 2 AS is_valid FROM samples GROUP BY 1",
)
def validate(spark, sf_dir):
    rows = V.samples(spark, sf_dir).select(F.col("doc_id").alias("source"), "label", F.col("split").alias("doc_id"))
    return A.validate_dataset(rows, ["source"], 20).drop("issues")


@query(
    "a31_p14_audit_sources",
    f"WITH {_S}, z AS (SELECT document_type AS source, doc_id, label, attack_type FROM samples) SELECT source, count(*) AS total_count, count_if(label = 0) AS real_count, count_if(label = 1) AS attacked_count, "
    "count(DISTINCT doc_id) AS unique_groups, count(DISTINCT CASE WHEN label = 0 THEN doc_id END) AS real_documents, count(DISTINCT CASE WHEN label = 1 THEN doc_id END) AS attacked_documents, "
    + ", ".join(
        f"count(DISTINCT CASE WHEN label = 1 AND attack_type = '{k}' THEN doc_id END) AS {k}" for k in P.ATTACK_CYCLE
    )
    + ", CASE WHEN count_if(label = 0) >= 5 AND count_if(label = 1) >= 5 AND count(DISTINCT doc_id) >= 2 THEN 'YES' ELSE 'NO' END AS suitable_for_training FROM z GROUP BY 1",
)
def audit(spark, sf_dir):
    rows = V.samples(spark, sf_dir).select(F.col("document_type").alias("source"), "doc_id", "label", "attack_type")
    return A.audit(rows).drop("reason")


@query(
    "p15_crop_violations",
    "SELECT page_id, CAST(580 + page_id % 3 * 10 AS INT) AS width FROM pages WHERE NOT (580 + page_id % 3 * 10 = 600 AND page_id % 5 <> 0)",
)
def violations(spark, sf_dir):
    crops = V.table(spark, sf_dir, "pages").selectExpr(
        "page_id",
        "CAST(580 + page_id % 3 * 10 AS INT) AS width",
        "400 AS height",
        "CASE WHEN page_id % 5 = 0 THEN 'L' ELSE 'RGB' END AS color_mode",
        "'PNG' AS format",
    )
    return A.crop_violations(crops).select("page_id", "width")


@query(
    "s01_manifest_samples",
    f"WITH {_S} SELECT path, label, class_name, doc_id, CASE WHEN split = 'val' THEN 'val' ELSE split END AS split FROM samples WHERE pos % 13 <> 0",
)
def manifest(spark, sf_dir):
    rows = V.samples(spark, sf_dir)
    raw = rows.select(
        F.when(F.col("pos") % 2 == 0, F.col("path")).otherwise(F.lit("")).alias("crop_path"),
        "path",
        F.when(F.col("pos") % 13 == 0, F.lit("UNKNOWN")).otherwise(F.concat(F.lit(" "), F.lower("class_name"))).alias("label"),
        F.when(F.col("pos") % 3 == 0, F.lit("")).otherwise(F.col("doc_id")).alias("document_id"),
        F.col("doc_id").alias("source_group"),
        F.when(F.col("split") == "val", F.lit("Validation ")).otherwise(F.upper("split")).alias("split"),
    )
    return M.manifest_samples(raw)


@query(
    "s07_prepared_manifest",
    f"WITH {_S} SELECT regexp_extract(path, '([^/]+)\\.png$', 1) AS sample_id, path AS source, doc_id AS source_group, split || '/' || lower(class_name) || '/' || regexp_extract(path, '([^/]+)$', 1) AS path, "
    "class_name AS label, 'mock_identity_card' AS document_type, doc_id AS video_id, split FROM samples",
)
def prepared(spark, sf_dir):
    return M.prepared_manifest(V.samples(spark, sf_dir))


# --- annotations -----------------------------------------------------------------------

_CORNERS = {
    "filename": "lpad(CAST(o_orderkey AS STRING), 8, '0') || '.jpg'",
    "clip_id": "o_custkey",
    "ax": "o_orderkey % 300 + 10",
    "ay": "o_custkey % 200 + 10",
}


def annotation_json(spark, sf_dir):
    """One annotation document per customer with one image per order."""
    from pyspark.sql import functions as F

    rows = V._select(V.table(spark, sf_dir, "orders"), _CORNERS)
    x, y = F.col("ax"), F.col("ay")
    xs = F.when(x % 9 == 0, F.array(x, x + 500, x + 510)).otherwise(F.array(x, x + 500, x + 510, x - 5))
    region = lambda name, value, shape: F.struct(
        F.struct(F.lit(name).alias("field_name"), value.alias("value")).alias("region_attributes"), shape.alias("shape_attributes")
    )
    quad = F.struct(
        F.lit("polygon").alias("name"), xs.alias("all_points_x"), F.array(y, y + 3, y + 300, y + 297).alias("all_points_y")
    )
    empty = F.struct(F.lit("rect").alias("name"), F.array(x).alias("all_points_x"), F.array(y).alias("all_points_y"))
    regions = F.array(region("surname", F.concat(F.lit("N"), x.cast("string")), empty), region("doc_quad", F.lit(""), quad))
    image = F.struct(F.col("filename").alias("key"), F.struct("filename", regions.alias("regions")).alias("value"))
    packed = rows.groupBy("clip_id").agg(F.map_from_entries(F.collect_list(image)).alias("_via_img_metadata"))
    return packed.select("clip_id", F.to_json(F.struct("_via_img_metadata")).alias("json"))


@query(
    "s05_annotation_quads",
    f"WITH a AS ({V.sql_select(_CORNERS, 'orders')}) SELECT clip_id, filename, CASE WHEN ax % 9 <> 0 THEN CAST(ax AS DOUBLE) END AS x0, CASE WHEN ax % 9 <> 0 THEN CAST(ay + 300 AS DOUBLE) END AS y2, "
    "ax % 9 <> 0 AS has_quad FROM a",
)
def quads(spark, sf_dir):
    rows = VIA.document_quads(annotation_json(spark, sf_dir))
    return rows.select(
        "clip_id",
        "filename",
        F.get("corners", F.lit(0))["x"].alias("x0"),
        F.get("corners", F.lit(2))["y"].alias("y2"),
        F.col("corners").isNotNull().alias("has_quad"),
    )


@query(
    "s06_j11_template_fields",
    f"WITH a AS ({V.sql_select(_CORNERS, 'orders')}), clips AS (SELECT 'lva_passport_' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS clip_id FROM customer) "
    "SELECT c.clip_id, coalesce('{\"surname\":\"N' || CAST(ax AS VARCHAR) || '\"}', '') AS ground_truth_text "
    "FROM clips c LEFT JOIN a ON replace(c.clip_id, 'lva_passport_', '') = replace(a.filename, '.jpg', '')",
)
def template(spark, sf_dir):
    number = F.lpad(F.col("c_custkey").cast("string"), 8, "0")
    clips = V.table(spark, sf_dir, "customer").select(F.concat(F.lit("lva_passport_"), number).alias("clip_id"))
    return VIA.with_template_text(clips, VIA.template_fields(annotation_json(spark, sf_dir)))


@query("s12_checksums", "SELECT page_id, sha256(html) AS sha256, md5(html) AS md5 FROM pages")
def digests(spark, sf_dir):
    return V.table(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("sha256"), F.md5("html").alias("md5"))


@query("x17_frame_names", "SELECT conv_id, turn, format('frame_{:04d}_idx_{:06d}', turn, turn * 3) AS frame_name FROM conversations")
def frame_names(spark, sf_dir):
    rows = V.table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", P.frame_name(F.col("turn"), F.col("turn") * 3).alias("frame_name"))
