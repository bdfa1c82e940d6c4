"""Regex patterns for personal data and secrets.

Each pattern is kept once, in its source (JavaScript-style) spelling, and
rewritten by rule into the dialect that runs it:

* Spark (java.util.regex): ``\\b`` is Unicode-aware in Java 17, while the source
  patterns expect an ASCII word boundary, so every ``\\b`` becomes an explicit
  ASCII look-around. ``\\d``, ``\\s`` and ``\\w`` are ASCII in Java by default.
* DuckDB (RE2, used by the oracle SQL): ``\\b`` already is ASCII; RE2 has no
  look-around, so the source spelling is used as it is.

Known dialect gaps, kept on purpose: JavaScript ``\\s`` also matches Unicode
spaces (NBSP ...); Java and RE2 use ASCII whitespace.
"""

from __future__ import annotations

import re as _re

# ---------------------------------------------------------------------------
# These must stay exactly as below for results to match.
# Sensitive-value patterns, in application order; replacement '[REDACTED]'.
CARD = r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
IP = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"
CREDENTIAL = r"(?i)\b(?:username|password|token|key|secret)[\s]*[=:]\s*[\w\-\.@]+"
# PII column names, case-insensitive, replacement '[PII_COLUMN]'.
PII_NAMES_1 = r"(?i)\b(customer_id|user_id|account_id|email|phone|ssn|credit_card)\b"
PII_NAMES_2 = r"(?i)\b(first_name|last_name|full_name|address|zip_code|postal_code)\b"
PII_NAMES_3 = r"(?i)\b(date_of_birth|dob|birth_date|salary|income|wage)\b"
REDACTED = "[REDACTED]"
PII_COLUMN = "[PII_COLUMN]"
# ---------------------------------------------------------------------------

# kind -> source pattern
VALUE_PATTERNS = {"card": CARD, "ssn": SSN, "email": EMAIL, "ip": IP}
SECRET_PATTERNS = {"credential": CREDENTIAL}
NAME_PATTERNS = {"pii_name_1": PII_NAMES_1, "pii_name_2": PII_NAMES_2, "pii_name_3": PII_NAMES_3}

# mask_text: the four value patterns, then the three column-name patterns.
MASK_TEXT_ORDER = ["card", "ssn", "email", "ip"]
# sanitize_prompt: the four value patterns, then credentials; no column names.
SANITIZE_ORDER = ["card", "ssn", "email", "ip", "credential"]

ALL_PATTERNS = {**VALUE_PATTERNS, **SECRET_PATTERNS, **NAME_PATTERNS}


def _combined_names() -> str:
    """The three name patterns as one alternation (derived by rule).

    Each matches whole words (boundaries on both sides) from disjoint word
    lists and all share one replacement, so applying them one after another
    equals applying their union once; counts add up the same way."""
    words = [_re.match(r"\(\?i\)\\b\((.*)\)\\b$", p).group(1) for p in NAME_PATTERNS.values()]
    return r"(?i)\b(" + "|".join(words) + r")\b"


_WORD = "[0-9A-Za-z_]"
ASCII_BOUNDARY = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"
_NOT_AFTER_WORD = f"(?<!{_WORD})"   # boundary before an atom that is a word char
_NOT_BEFORE_WORD = f"(?!{_WORD})"   # boundary after an atom that is a word char


_WORD_GROUP = r"\((?:\?:)?[A-Za-z_]+(?:\|[A-Za-z_]+)*\)"


def spark_form(pattern: str) -> str:
    """Source pattern -> java.util.regex pattern with ASCII word boundaries.

    Where the atom next to ``\\b`` can only match word characters (``\\d``, or
    a group of plain-word alternatives) the boundary reduces exactly to one
    look-behind or look-ahead, which is about 3x cheaper than the general
    two-sided form; every other ``\\b`` gets the general form."""
    p = pattern
    p = _re.sub(r"\\b(?=\\d)", lambda m: _NOT_AFTER_WORD, p)
    p = _re.sub(r"(\\d(?:\{\d+(?:,\d*)?\})?)\\b", lambda m: m.group(1) + _NOT_BEFORE_WORD, p)
    p = _re.sub(r"\\b(" + _WORD_GROUP + r")\\b",
                lambda m: _NOT_AFTER_WORD + m.group(1) + _NOT_BEFORE_WORD, p)
    p = _re.sub(r"\\b(?=" + _WORD_GROUP + ")", lambda m: _NOT_AFTER_WORD, p)
    return p.replace(r"\b", ASCII_BOUNDARY)


def duckdb_form(pattern: str) -> str:
    """Source pattern -> RE2 pattern (unchanged: RE2's \\b is ASCII)."""
    return pattern


def sql_literal(s: str) -> str:
    """Quote a string as a SQL literal (single quotes doubled)."""
    return "'" + s.replace("'", "''") + "'"


PII_NAMES_ALL = _combined_names()
