"""Identifiers hidden in file names: document, clip, presentation mode, label."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".bmp", ".webp", ".tiff")
CLASS_LABELS = {"REAL": 0, "ATTACKED": 1}
MODE_LABELS = {"or": "REAL", "cc": "ATTACKED", "cg": "ATTACKED", "re": "ATTACKED"}
CLASS_DIRECTORIES = ("REAL", "ATTACKED", "real", "attacked", ".", "")
ATTACK_CYCLE = ("photo_tamper", "text_alteration", "screen_replay", "print_scan")
DOC_PREFIX_PATTERN = r"^([a-zA-Z]+[-_]\d+)"
FRAME_SPLIT_PATTERN = r"(?iU)[_-](?:frame|f|t|\d+$)"
CLIP_PATTERN = r"(?U)^([a-zA-Z0-9_]+)\.([a-z]{2})\d+$"
# --------------------------------------------------------------------------


def unix_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_name(path: Column) -> Column:
    has_parent = F.instr(path, "/") > 0
    return F.when(has_parent, F.substring_index(F.regexp_replace(path, r"/[^/]*$", ""), "/", -1)).otherwise(F.lit(""))


def stem(path: Column) -> Column:
    """File name without its last suffix; a leading dot does not start a suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def doc_id(path: Column) -> Column:
    """Document or video group of an image path; the first matching rule wins."""
    s = stem(path)
    parent = parent_name(path)
    prefix = F.regexp_extract(s, DOC_PREFIX_PATTERN, 1)
    parts = F.split(s, FRAME_SPLIT_PATTERN)
    before_last = F.regexp_replace(s, r"_[^_]*$", "")
    return (
        F.when(~parent.isin(*CLASS_DIRECTORIES), parent)
        .when(F.instr(s, ".") > 0, F.substring_index(s, ".", 1))
        .when(prefix != "", prefix)
        .when((F.size(parts) > 1) & (F.get(parts, F.lit(0)) != ""), F.get(parts, F.lit(0)))
        .when((F.instr(s, "_") > 0) & (before_last != ""), before_last)
        .otherwise(s)
    )


def clip_metadata(clip_name: Column) -> Column:
    """Struct of document id, two-letter presentation mode and clip id."""
    parsed = F.regexp_extract(clip_name, CLIP_PATTERN, 1)
    parts = F.split(clip_name, r"\.")
    fallback_mode = F.when(F.size(parts) > 1, F.substring(F.get(parts, F.lit(1)), 1, 2)).otherwise(F.lit("unknown"))
    return F.struct(
        F.when(parsed != "", parsed).otherwise(F.get(parts, F.lit(0))).alias("document_id"),
        F.when(parsed != "", F.regexp_extract(clip_name, CLIP_PATTERN, 2)).otherwise(fallback_mode).alias("mode"),
        clip_name.alias("clip_id"),
    )


def lookup(key: Column, mapping: dict, default=None) -> Column:
    """Literal map lookup; the mapping is part of the plan, never a join."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    found = F.element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def label_from_mode(mode: Column) -> Column:
    return lookup(mode, MODE_LABELS, "ATTACKED")


def document_type(doc: Column) -> Column:
    return F.when(F.startswith(doc, F.lit("alb_id")), F.lit("albanian_id")).otherwise(F.lit("azerbaijan_passport"))


def synthetic_attack_type(doc: Column) -> Column:
    """Attack kind from the trailing number of a synthetic document id, else NULL."""
    number = F.substring_index(doc, "_", -1).try_cast("int")
    kinds = F.array(*[F.lit(k) for k in ATTACK_CYCLE])
    return F.element_at(kinds, F.pmod(number - 1, F.lit(4)) + 1)


def frame_name(position: Column, frame_idx: Column) -> Column:
    return F.format_string("frame_%04d_idx_%06d", position.cast("int"), frame_idx.cast("int"))
