"""VIA annotation documents: quads per frame and ground-truth fields per document."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from captura.functions.geometry import order_points

VIA_SCHEMA = (
    "_via_img_metadata map<string, struct<filename:string, regions:array<struct<"
    "region_attributes:struct<field_name:string, value:string>, "
    "shape_attributes:struct<name:string, all_points_x:array<double>, all_points_y:array<double>>>>>>"
)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """One row per annotation file: its name without suffix as ``clip_id`` and the JSON text."""
    files = spark.read.option("wholetext", True).text(path)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    return files.select(F.url_decode(name).alias("clip_id"), F.col("value").alias("json"))


def annotated_images(annotations: DataFrame, key: str = "clip_id", json: str = "json") -> DataFrame:
    """One row per annotated image with its regions."""
    parsed = annotations.select(key, F.from_json(json, VIA_SCHEMA).alias("via"))
    images = parsed.select(key, F.explode(F.map_values("via._via_img_metadata")).alias("img"))
    return images.select(key, F.col("img.filename").alias("filename"), F.col("img.regions").alias("regions"))


def _points(shape: Column) -> Column:
    xs, ys = shape["all_points_x"], shape["all_points_y"]
    quad = F.transform(F.arrays_zip(xs.alias("x"), ys.alias("y")), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return F.when((F.size(xs) == 4) & (F.size(ys) == 4), quad)


def document_quads(annotations: DataFrame, key: str = "clip_id", json: str = "json") -> DataFrame:
    """Quad per image from the first ``doc_quad`` region that has exactly four points."""
    images = annotated_images(annotations, key, json)
    quads = F.filter(
        F.transform(
            F.filter("regions", lambda r: r["region_attributes"]["field_name"] == "doc_quad"),
            lambda r: _points(r["shape_attributes"]),
        ),
        lambda q: q.isNotNull(),
    )
    return images.select(key, "filename", F.get(quads, F.lit(0)).alias("corners"))


def first_polygon_quads(annotations: DataFrame, key: str = "clip_id", json: str = "json") -> DataFrame:
    """Quad per image from its first region, if that is a four-point polygon, in canonical order."""
    images = annotated_images(annotations, key, json)
    shape = F.get("regions", F.lit(0))["shape_attributes"]
    quad = F.when(shape["name"] == "polygon", _points(shape))
    return images.select(key, "filename", F.when(quad.isNotNull(), order_points(quad)).alias("corners"))


def template_fields(annotations: DataFrame, key: str = "clip_id", json: str = "json") -> DataFrame:
    """Ground-truth text per document: regions with a name and a value; images without any give no row.

    A later region with the same name replaces an earlier one.
    """
    images = annotated_images(annotations, key, json)
    named = F.filter(
        "regions",
        lambda r: (F.coalesce(r["region_attributes"]["field_name"], F.lit("")) != "")
        & (F.coalesce(r["region_attributes"]["value"], F.lit("")) != ""),
    )
    attrs = F.transform(named, lambda r: r["region_attributes"])
    last = F.filter(
        attrs,
        lambda a, i: ~F.exists(
            F.slice(attrs, i + 2, F.greatest(F.size(attrs) - i - 1, F.lit(0))),
            lambda b: b["field_name"] == a["field_name"],
        ),
    )
    entries = F.map_from_entries(
        F.transform(last, lambda a: F.struct(a["field_name"].alias("key"), a["value"].alias("value")))
    )
    document = F.replace(F.col("filename"), F.lit(".jpg"), F.lit(""))
    return (
        images.select(key, document.alias("document"), entries.alias("fields"))
        .filter(F.size("fields") > 0)
        .withColumn("ground_truth_text", F.to_json("fields"))
    )


def with_template_text(clips: DataFrame, fields: DataFrame, prefix: str = "lva_passport_", key: str = "clip_id") -> DataFrame:
    """Clips with the ground-truth text of the template document of their number, empty where there is none.

    The number is what follows ``prefix`` in the clip's name and the whole name of the template document. A document
    that has fields in several annotation files counts once, with the text that is last in order.
    """
    one = fields.groupBy(F.col("document").alias("__number")).agg(F.max("ground_truth_text").alias("ground_truth_text"))
    number = F.replace(F.col(key), F.lit(prefix), F.lit(""))
    joined = clips.withColumn("__of", number).join(one, F.col("__of") == F.col("__number"), "left")
    return joined.select(*clips.columns, F.coalesce("ground_truth_text", F.lit("")).alias("ground_truth_text"))
