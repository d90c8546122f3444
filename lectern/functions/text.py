"""Column functions for text cleaning, keys and display fields (JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace class of Python's ``str.isspace`` / ``re`` ``\s``,
# which the cleaning and every ``strip`` must follow exactly:
# U+0009-U+000D, U+001C-U+0020, U+0085, U+00A0, U+1680, U+2000-U+200A,
# U+2028, U+2029, U+202F, U+205F, U+3000.
# Java's ``\s`` knows only six ASCII characters, so the class is spelled out.
WS_CLASS = (r"[\t\n\u000B\f\r\u001C-\u0020\u0085\u00A0\u1680"
            r"\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]")
# The same class in RE2 syntax, for DuckDB oracle SQL.
WS_CLASS_RE2 = (r"[\t\n\x{0B}\f\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}"
                r"\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")

PREVIEW_CHARS = 200          # fixed: source previews keep 200 characters
ELLIPSIS = "..."


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_whitespace(text) -> Column:
    """Collapse every whitespace run to one space and strip both ends."""
    return F.trim(F.regexp_replace(_col(text), WS_CLASS + "+", " "))


def _edges(t: Column):
    """Lengths of the leading and trailing whitespace runs.

    Both are anchored prefix matches (the trailing run is read off the
    reversed text), so no pattern is tried at every character.
    """
    lead = F.length(F.regexp_extract(t, "^" + WS_CLASS + "*", 0))
    trail = F.length(F.regexp_extract(F.reverse(t), "^" + WS_CLASS + "*", 0))
    return lead, trail


def strip_ws(text) -> Column:
    """``str.strip()`` with Python's whitespace class (Spark ``trim`` only strips spaces)."""
    t = _col(text)
    lead, trail = _edges(t)
    n = F.length(t)
    return F.when(lead >= n, F.when(t.isNotNull(), F.lit(""))).otherwise(
        t.substr(lead + 1, n - lead - trail))


def stripped_length(text) -> Column:
    """``len(text.strip())`` without building the stripped string."""
    t = _col(text)
    lead, trail = _edges(t)
    n = F.length(t)
    return F.when(lead >= n, F.when(t.isNotNull(), F.lit(0))).otherwise(n - lead - trail)


def text_preview(text, n: int = PREVIEW_CHARS) -> Column:
    """First ``n`` characters, with ``...`` appended only when something was cut."""
    t = _col(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit(ELLIPSIS))).otherwise(t)


def basename(key) -> Column:
    """Last ``/``-separated segment of an object key (``''`` for a trailing slash)."""
    return F.substring_index(_col(key), "/", -1)


def decode_object_key(key) -> Column:
    """URL-decode an object key from an upload event (``+`` means space).

    Keys with a malformed ``%`` escape cannot be decoded by Spark; they keep
    their text with ``+`` turned into spaces instead of failing the batch.
    """
    k = _col(key)
    return F.coalesce(F.try_url_decode(k), F.regexp_replace(k, r"\+", " "))


def has_extension(key, ext: str = ".pdf") -> Column:
    """Case-insensitive suffix test on an object key."""
    return F.lower(_col(key)).endswith(ext.lower())


def chunk_key(doc_id, chunk_id) -> Column:
    """Index id ``<doc_id>_<chunk_id>``."""
    return F.concat_ws("_", _col(doc_id).cast("string"), _col(chunk_id).cast("string"))


def short_id(doc_id, n: int = 16) -> Column:
    """Display id: first ``n`` characters followed by ``...``."""
    return F.concat(F.substring(_col(doc_id).cast("string"), 1, n), F.lit(ELLIPSIS))


def thousands(n) -> Column:
    """Integer with thousands separators (``1,234,567``)."""
    return F.format_number(_col(n).cast("bigint"), 0)


def document_label(filename, status) -> Column:
    """Selector label ``filename (status)``."""
    return F.format_string("%s (%s)", _col(filename), _col(status))
