"""Row-wise feature expressions (all JVM-side, inside whole-stage codegen).

Every function takes and returns ``Column``s, so callers compose them in one
``select`` and Catalyst prunes, folds and fuses them. No Python UDF anywhere.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Patterns and port sets whose exact text decides the features.
# ---------------------------------------------------------------------------
IP_PATTERN = r"\b\d{1,3}(?:\.\d{1,3}){3}\b"
SQL_CHARS_PATTERN = r"(?:%27|'|--|%23|#)"
CMD_PATTERNS = {
    # V4: three variants of the command-substitution test
    "open": r"(?:;|\|\||&&|\$\(|`)",
    "star": r"(;|\|\||&&|\$\(.*\)|`)",
    "plus": r"(?:;|\|\||&&|\$\(.+\)|`)",
}
XSS_PATTERN = r"(?i)(?:<script|%3cscript|onerror=|onload=)"
UA_PYTHON_PATTERNS = {
    # V5
    "broad": "python|requests|urllib",
    "python": "python",
}
UA_BROWSER_PATTERN = "mozilla|chrome|safari|firefox|edge"
PRIVATE_IP_PATTERN = r"^(10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[0-1])\.)"
WEB_PORTS = (80, 443, 8080, 8443)
SSH_PORTS = (22,)
DB_PORTS = (3306, 5432, 1433)
# ---------------------------------------------------------------------------

_SUFFIXED_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?[dDfF]\s*$"



def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- P4 / P5 / P9 -----------------------------------------------------------

NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")


def to_numeric(c, dtype: str | None = None) -> Column:
    """pandas ``to_numeric(errors='coerce')``: bad text → null.

    ``try_cast`` keeps ANSI mode from throwing; Spark alone would accept a
    Java-style ``1d`` / ``2f`` suffix, so those are rejected first. A column
    already typed numeric (``dtype``) is just widened to double — no text
    round trip, which keeps wide feature projections small enough for codegen.
    """
    c = col_of(c)
    if dtype is not None and (dtype in NUMERIC_TYPES or dtype.startswith("decimal")):
        return c.cast("double")
    s = c.cast("string")
    return F.when(s.rlike(_SUFFIXED_NUMBER), F.lit(None).cast("double")).otherwise(s.try_cast("double"))


def finite_or_null(c) -> Column:
    """±inf and NaN → null. Spark orders NaN above +inf, so one comparison clears all three."""
    c = col_of(c)
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def bool_text_to_int(c) -> Column:
    """'true'/'false' in any case → 1/0; anything else → null."""
    low = F.lower(col_of(c).cast("string"))
    return F.when(low == "true", F.lit(1)).when(low == "false", F.lit(0))


# -- F1–F4 time ------------------------------------------------------------

def parse_timestamp(c, fmt: str | list[str] | None = None, zoned: bool = False) -> Column:
    """Parse text to a timestamp; unparseable → null (never an ANSI error).

    Default: a zone-free TIMESTAMP_NTZ (pandas' naive parse), so hour, weekday
    and windows are the written wall-clock values in any session time zone.
    ``fmt`` may be a list: the first format that parses wins (non-ISO logs mix
    forms). ``zoned=True`` (the ``utc=True`` variant) yields an instant.
    """
    c = col_of(c).cast("string")
    if isinstance(fmt, (list, tuple)):
        return F.coalesce(*[parse_timestamp(c, f, zoned) for f in fmt])
    if zoned:
        return F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)
    if fmt:
        return F.try_to_timestamp(c, F.lit(fmt)).cast("timestamp_ntz")
    return c.try_cast("timestamp_ntz")


def epoch_micros(ts, dtype: str) -> Column:
    """Microseconds since 1970-01-01 as a long; for TIMESTAMP_NTZ without any
    time-zone conversion (so ordering never depends on the session zone)."""
    ts = col_of(ts)
    if dtype == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)
    return F.unix_micros(ts.cast("timestamp"))


def time_literal(us: int | None, dtype: str) -> Column | None:
    """The timestamp of type ``dtype`` at ``us`` epoch microseconds, a constant that filters push to the file reader;
    None for None and for times outside the years 1 to 9999."""
    if us is None or not -62_135_596_800_000_000 <= us < 253_402_300_800_000_000:
        return None
    if dtype == "timestamp_ntz":
        return F.lit(str(datetime(1970, 1, 1) + timedelta(microseconds=us))).cast("timestamp_ntz")
    return F.timestamp_micros(F.lit(us))


def hour_of(ts, bad: str = "null") -> Column:
    h = F.hour(col_of(ts))
    return F.coalesce(h, F.lit(0)) if bad == "zero" else h


def day_of_week(ts, bad: str = "null") -> Column:
    """Monday = 0 … Sunday = 6 (``weekday``; ``dayofweek`` would make Sunday 1)."""
    d = F.weekday(col_of(ts))
    return F.coalesce(d, F.lit(0)) if bad == "zero" else d


def is_weekend(ts) -> Column:
    return F.coalesce((F.weekday(col_of(ts)) >= 5).cast("int"), F.lit(0))


# -- F5–F12 text -----------------------------------------------------------

def clean_text(c) -> Column:
    """Null text → empty string (V8: the intent of ``astype(str).fillna('')``)."""
    return F.coalesce(col_of(c).cast("string"), F.lit(""))


def text_len(c) -> Column:
    return F.length(clean_text(c))


def url_num_params(c, mode: str = "all") -> Column:
    """V3. ``all``: count of ? and &; ``capped``: count of & plus one if any ?."""
    u = clean_text(c)
    if mode == "all":
        return F.regexp_count(u, F.lit("[?&]"))
    if mode == "capped":
        return F.regexp_count(u, F.lit("&")) + u.contains("?").cast("int")
    raise ValueError(f"unknown url_num_params mode: {mode}")


def has_pattern(c, pattern: str) -> Column:
    return clean_text(c).rlike(pattern).cast("int")


def has_ip(c) -> Column:
    return has_pattern(c, IP_PATTERN)


def has_sql_chars(c) -> Column:
    return has_pattern(c, SQL_CHARS_PATTERN)


def has_cmd_chars(c, variant: str = "open") -> Column:
    return has_pattern(c, CMD_PATTERNS[variant])


def has_xss(c) -> Column:
    return has_pattern(c, XSS_PATTERN)


def ua_flags(c, python_variant: str = "broad") -> dict[str, Column]:
    raw = clean_text(c)
    low = F.lower(raw)
    return {
        "ua_len": F.length(raw),
        "ua_is_curl": low.contains("curl").cast("int"),
        "ua_is_wget": low.contains("wget").cast("int"),
        "ua_is_python": low.rlike(UA_PYTHON_PATTERNS[python_variant]).cast("int"),
        "ua_is_browser": low.rlike(UA_BROWSER_PATTERN).cast("int"),
    }


# -- F13–F16 ports and bytes --------------------------------------------------

def port_flags(c, prefix: str, dtype: str | None = None) -> dict[str, Column]:
    p = to_numeric(c, dtype)
    return {
        f"{prefix}_is_web": F.coalesce(p.isin(*WEB_PORTS), F.lit(False)).cast("int"),
        f"{prefix}_is_ssh": F.coalesce(p.isin(*SSH_PORTS), F.lit(False)).cast("int"),
        f"{prefix}_is_db": F.coalesce(p.isin(*DB_PORTS), F.lit(False)).cast("int"),
    }


def byte_features(sent, received, sent_type: str | None = None, received_type: str | None = None
                  ) -> dict[str, Column]:
    bs = F.coalesce(to_numeric(sent, sent_type), F.lit(0.0))
    br = F.coalesce(to_numeric(received, received_type), F.lit(0.0))
    total = bs + br
    return {
        "bytes_total": total,
        # received = -1 would divide by zero (an error under ANSI): null instead
        "bytes_ratio_sent_recv": F.try_divide(bs, br + F.lit(1.0)),
        "log_bytes_total": F.log1p(total),
    }


# -- F17–F19 ------------------------------------------------------------------

def is_private_ip(c) -> Column:
    """RFC 1918 prefix test on the trimmed text; null → false."""
    return F.coalesce(F.trim(col_of(c).cast("string")).rlike(PRIVATE_IP_PATTERN), F.lit(False))


def is_internal_traffic(src, dst) -> Column:
    return (is_private_ip(src) & is_private_ip(dst)).cast("int")


def sigmoid(c) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col_of(c)))
