"""Field extraction and validation over recognized text, as regular expressions.

Patterns carry ``(?U)`` so that word, digit and space classes are Unicode aware.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------
KEY_FIELDS = ("name", "dob", "document_number", "address")
LABELLED_PATTERNS = {
    "name": r"\b(?:NAME|Full Name|Holder)[\t :;\.\-]*([A-Za-z\t \.\-]{2,35})",
    "dob": r"\b(?:DOB|Date of Birth|Birth Date)[\t :;\.\-]*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{1,2}[/-]\d{1,2})",
    "document_number": r"\b(?:DOC\s*NO|DOCUMENT\s*NO|ID\s*NO|DOC|ID)[\t :;\.\-]+([A-Z0-9\+\-\t ]{4,30})",
    "address": r"\b(?:ADDR|Address|Add)[\t :;\.\-]*([A-Za-z0-9\t ,\.\-/#]{5,60})",
}
UNLABELLED_PATTERNS = {
    "dob": r"\b(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\b",
    "document_number": r"\b([A-Z]{1,4}[-\s]?\d{3,6}[-\s]?\d{3,6}|[A-Z]{1,4}\d{6,10})\b",
}
DATE_PATTERN = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})$"
# --------------------------------------------------------------------------

_BLANKS = " \t\n\x0b\x0c\r"


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(_BLANKS))


def _none_if_empty(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def extract_first(text: Column, pattern: str, flags: str) -> Column:
    """First capture of the first match, stripped; NULL when absent or blank."""
    return _none_if_empty(strip(F.regexp_extract(text, f"(?{flags}){pattern}", 1)))


def clean_document_number(raw: Column) -> Column:
    kept = strip(F.regexp_replace(raw, r"(?U)[^\w\- ]", ""))
    return F.when(kept.rlike(r"(?U)\d"), kept)


def clean_edges(raw: Column) -> Column:
    return strip(F.regexp_replace(raw, r"(?U)^[^\w]+|[^\w]+$", ""))


def extract_field(text: Column, field: str, patterns: dict | None = None) -> Column:
    """Labelled pattern (any case), then the exact-case unlabelled one, then clean-up."""
    labelled = (patterns or {}).get(field, LABELLED_PATTERNS[field])
    value = extract_first(text, labelled, "iU")
    if field in UNLABELLED_PATTERNS:
        value = F.coalesce(value, extract_first(text, UNLABELLED_PATTERNS[field], "U"))
    return clean_document_number(value) if field == "document_number" else clean_edges(value)


def valid_name(value: Column) -> Column:
    wordlike = F.length(F.regexp_replace(value, r"(?U)[^\p{L}\s.\-]", ""))
    return F.coalesce((F.length(value) >= 2) & (wordlike / F.length(value) >= 0.85), F.lit(False))


def valid_dob(value: Column) -> Column:
    """Day-month-year only; two-digit years pivot at 30, months have no length check."""
    pattern = "(?U)" + DATE_PATTERN
    day = F.regexp_extract(value, pattern, 1).try_cast("int")
    month = F.regexp_extract(value, pattern, 2).try_cast("int")
    year = F.regexp_extract(value, pattern, 3).try_cast("int")
    full_year = F.when(year >= 100, year).when(year > 30, year + 1900).otherwise(year + 2000)
    return F.coalesce(
        day.between(1, 31) & month.between(1, 12) & full_year.between(1900, 2026), F.lit(False)
    )


def valid_document_number(value: Column) -> Column:
    has_letter = value.rlike(r"\p{L}")
    has_digit = value.rlike(r"(?U)\d")
    long_enough = F.length(value) >= 5
    return F.coalesce(long_enough & has_digit & (has_letter | (F.length(value) >= 8)), F.lit(False))


def valid_address(value: Column) -> Column:
    return F.coalesce((F.length(value) >= 6) & (F.instr(value, " ") > 0), F.lit(False))


VALIDATORS = {
    "name": valid_name,
    "dob": valid_dob,
    "document_number": valid_document_number,
    "address": valid_address,
}


def canonical(value: Column) -> Column:
    """Lower case with collapsed white space: the form on which values are compared."""
    return strip(F.regexp_replace(F.lower(value), r"(?U)\s+", " "))


def alphanumeric(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)[^\w]", "")


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1.0 - F.levenshtein(a, b) / longest).otherwise(F.lit(1.0))
