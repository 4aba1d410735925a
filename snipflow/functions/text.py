"""Column helpers with Python string semantics, built from native functions.

Spark's ``trim`` strips only blanks and Java's ``\\s`` misses several
characters Python treats as whitespace, so strip/split helpers use an
explicit class. Patterns use ``\\x{..}`` escapes that Java regex and RE2
(DuckDB) read the same way, so oracle SQL can reuse them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: characters for which Python's str.isspace() is true -----
PY_WS = (r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
         r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
# line boundaries of str.splitlines()
PY_LINE_BREAK = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}\x{1D}\x{1E}\x{85}\x{2028}\x{2029}]"
# ---------------------------------------------------------------------------


def py_strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{PY_WS}+|{PY_WS}+$", "")


def py_lstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{PY_WS}+", "")


def py_rstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"{PY_WS}+$", "")


def is_blank(c: Column) -> Column:
    """None, empty or whitespace only: no other character is found (the first one ends the search)."""
    return c.isNull() | ~F.regexp_like(c, F.lit(PY_WS.replace("[", "[^", 1)))


def py_splitlines(c: Column) -> Column:
    """Array of lines as ``str.splitlines()`` returns them (no trailing empty line)."""
    parts = F.split(c, PY_LINE_BREAK, -1)
    # a text ending in a line break yields a trailing '' that splitlines omits
    ends_with_break = F.regexp_like(c, F.lit(f"({PY_LINE_BREAK})$"))
    return F.when(c.isNull() | (c == ""), F.array().cast("array<string>")).when(
        ends_with_break, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def json_text(c: Column) -> Column:
    """A text as a JSON string."""
    array = F.to_json(F.array(c))
    return F.substring(array, F.lit(2), F.length(array) - 2)


def sql_py_strip(expr: str) -> str:
    """DuckDB expression with the same meaning as ``py_strip``."""
    return f"regexp_replace({expr}, '^{PY_WS}+|{PY_WS}+$', '', 'g')"
