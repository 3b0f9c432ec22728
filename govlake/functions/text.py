"""Text expressions: blanks, missing values, types by pattern, case, personal data, masks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that mean "missing", truth words and patterns of typed text.
MISSING = ("", "na", "n/a", "null", "none", "nan", "-", "--", "?", ".")
TRUE_WORDS = ("true", "t", "yes", "y", "1")
FALSE_WORDS = ("false", "f", "no", "n", "0")
INT = r"^[-+]?\d+$"
FLOAT = r"^[-+]?(\d+\.\d*|\.\d+|\d+)([eE][-+]?\d+)?$"
DATE = r"^\d{4}-\d{2}-\d{2}$"
TIMESTAMP = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2})?(\.\d+)?(Z|[+-]\d{2}:?\d{2})?$"
WITH_UNIT = r"^\s*([-+]?\d+(?:\.\d+)?)\s*([A-Za-z%][A-Za-z%/]*)\s*$"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?<!\d)(\+?\d[\d\s().-]{7,}\d)(?!\d)"
NATIONAL_ID = r"\b\d{3}-\d{2}-\d{4}\b"
# Words in column names that hint at names, personal data and health data.
NAME_HINTS = ("name", "first_name", "last_name", "full_name", "surname", "given_name")
PII_HINTS = ("email", "phone", "ssn", "national_id", "passport", "address", "dob", "birth")
PHI_HINTS = ("diagnosis", "icd", "mrn", "patient", "medical", "health", "treatment")


def strip(c: Column) -> Column:
    """Without white space at either end, no-break spaces included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def is_missing(c: Column) -> Column:
    """Whether a text means "missing"; null for null."""
    return F.lower(strip(c)).isin(*MISSING)


def real(c: Column) -> Column:
    """The stripped text, or null if it is null or means "missing"."""
    return F.when(~is_missing(c), strip(c))


def title(c: Column) -> Column:
    """Upper case for each letter that follows no letter, lower case for the others."""
    letters = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(letters, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), "")


def case(c: Column, mode: str) -> Column:
    return {"upper": F.upper, "title": title}.get(mode, F.lower)(c)


def unit_value(c: Column) -> Column:
    return F.when(c.rlike(WITH_UNIT), F.regexp_extract(c, WITH_UNIT, 1).try_cast("double"))


def unit_name(c: Column) -> Column:
    return F.when(c.rlike(WITH_UNIT), F.regexp_extract(c, WITH_UNIT, 2))


def number(c: Column) -> Column:
    """Stripped text as double if it is written as a number; Spark's own cast would take `12f` and `7d`, too."""
    return F.when(c.rlike(FLOAT), c.try_cast("double"))


def coerce(c: Column, target: str) -> Column:
    """Text as int, double, bool, date or timestamp (UTC); null if it can't be read so."""
    s = strip(c)
    if target in ("int", "long"):
        return F.when(s.rlike(INT), s.try_cast("long"))
    if target in ("double", "float"):
        return number(s)
    if target == "bool":
        return F.when(F.lower(s).isin(*TRUE_WORDS), True).when(F.lower(s).isin(*FALSE_WORDS), False)
    if target == "date":
        return F.when(s.rlike(DATE), s.try_cast("date"))
    if target == "timestamp":
        return F.when(s.rlike(TIMESTAMP) | s.rlike(DATE), s.try_cast("timestamp"))
    return c


def looks_personal(c: Column) -> Column:
    """Whether a text holds an e-mail address, national id or phone number."""
    return c.rlike(EMAIL) | c.rlike(NATIONAL_ID) | c.rlike(PHONE)


def hint(name: str) -> str | None:
    """What a column's name hints at: phi, pii or None."""
    low = name.lower()
    if any(h in low for h in PHI_HINTS):
        return "phi"
    return "pii" if any(h in low for h in (*PII_HINTS, *NAME_HINTS)) else None


def mask_hash(c: Column) -> Column:
    """First 16 hex digits of the sha256 of the value's text; null stays null."""
    return F.substring(F.sha2(c.cast("string"), 256), 1, 16)


def unit_interval(c: Column) -> Column:
    """A stable number in [0, 1) from the sha256 of a text."""
    return F.conv(F.substring(F.sha2(c.cast("string"), 256), 1, 12), 16, 10).cast("double") / float(1 << 48)


def redact_url(c: Column) -> Column:
    """A connection URL without its user, password and secret parameters."""
    hidden = F.regexp_replace(c, r"://[^/@\s]+@", "://***@")
    return F.regexp_replace(hidden, r"(?i)((?:password|passwd|pwd|token|secret|api_?key)=)[^&;\s]*", "$1***")


def humanised(name: str) -> str:
    return name.replace("_", " ").strip().title()


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
