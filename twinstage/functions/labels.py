"""Label expressions: grouping, spelling repair, binary label (L1–L3)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import col_of

# ---------------------------------------------------------------------------
# Attack-type groups (L1) and web-attack spellings (L2).
# ---------------------------------------------------------------------------
ATTACK_GROUPS = {
    "benign": "benign",
    "port-scan": "scanning",
    "sql-injection": "injection",
    "command-injection": "injection",
    "xss": "injection",
    "brute-force": "credential_attack",
    "credential-stuffing": "credential_attack",
    "c2": "malware_c2",
    "ddos": "ddos",
    "exploit-attempt": "malware_c2",
}
WEB_ATTACK_SPELLINGS = {
    "Web Attack – Brute Force": "Web Attack Brute Force",
    "Web Attack – XSS": "Web Attack XSS",
    "Web Attack – Sql Injection": "Web Attack Sql Injection",
    "Web Attack - Brute Force": "Web Attack Brute Force",
    "Web Attack - XSS": "Web Attack XSS",
    "Web Attack - Sql Injection": "Web Attack Sql Injection",
    "Web Attack � Brute Force": "Web Attack Brute Force",
    "Web Attack � XSS": "Web Attack XSS",
    "Web Attack � Sql Injection": "Web Attack Sql Injection",
}
DEFAULT_OTHER = "other_attack"  # V1; the CV scripts use "other"
# ---------------------------------------------------------------------------


def map_literal(mapping: dict[str, str]) -> Column:
    """A literal map column: constant-folded, evaluated per row with no join."""
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])


def map_values(c, mapping: dict[str, str], default: Column | str | None = None, trim: bool = True) -> Column:
    """Look a value up in a fixed map; ``default`` for misses (None keeps the input)."""
    key = col_of(c).cast("string")
    if trim:
        key = F.trim(key)
    looked = F.element_at(map_literal(mapping), key)
    if default is None:
        return F.coalesce(looked, key)
    return F.coalesce(looked, F.lit(default) if isinstance(default, str) else default)


def attack_group(c, other: str = DEFAULT_OTHER, groups: dict[str, str] | None = None) -> Column:
    """L1: 10 attack types → 6 groups; unmapped (and null, like pandas' 'nan') → ``other``."""
    return map_values(c, groups or ATTACK_GROUPS, default=other, trim=True)


def repair_label(c) -> Column:
    """L2: trim, then canonical spelling of the web-attack variants; others unchanged."""
    return map_values(c, WEB_ATTACK_SPELLINGS, default=None, trim=True)


def binary_label(c, benign: str | Column) -> Column:
    """L3: 1 unless the class equals the benign label; null counts as attack (pandas ``!=``)."""
    b = F.lit(benign) if isinstance(benign, str) else benign
    return F.coalesce((col_of(c) != b).cast("int"), F.lit(1))
