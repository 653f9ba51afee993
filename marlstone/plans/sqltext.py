"""The SQL counterparts of text columns, which many queries' SQL shares."""

from __future__ import annotations

from ..functions.text import BENGALI_DIGITS, TOKEN


def tokens_sql(text: str = "text") -> str:
    return f"regexp_extract_all(lower(translate(coalesce({text}, ''), '{BENGALI_DIGITS}', '0123456789')), '{TOKEN}')"
