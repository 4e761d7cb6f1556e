"""Place-name normalisation as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Ordered (pattern, replacement) rules that bring place names of the measured table
# to the spelling used by the boundary table. Each rule replaces its first match only.
ENTITY_NAME_RULES = [
    (r"(?i)\sparish", ""),
    (r"st\.", "st"),
    (r"ste\.", "ste"),
    (r"consolidated municipality of ", ""),
    (r"city and county of ", ""),
    (r"city of st louis", "st louis city"),
    (r"town and county of ", ""),
    (r"city of ", ""),
    (r"o'", "o"),
    (r"'s", "s"),
    (r"la\s", "la"),
    (r"de\s", "de"),
]
BOUNDARY_NAME_RULES = [
    (r"du page", "dupage"),
    (r"la\s", "la"),
    (r"de\s", "de"),
]


def replace_first(column, pattern: str, replacement: str) -> Column:
    """Replace only the first match; ``regexp_replace`` alone would replace every one."""
    c = F.col(column) if isinstance(column, str) else column
    safe = replacement.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(c, rf"(?s)^(.*?)(?:{pattern})", "$1" + safe)


def apply_rules(column, rules) -> Column:
    """Fold an ordered rule list over a column."""
    c = F.col(column) if isinstance(column, str) else column
    for pattern, replacement in rules:
        c = replace_first(c, pattern, replacement)
    return c


def strip_suffix(column, word: str) -> Column:
    """Lower-case, then drop a trailing word with the blanks around it."""
    c = F.col(column) if isinstance(column, str) else column
    return F.regexp_replace(F.lower(c), rf"\s+{re.escape(word.lower())}\s*$", "")
