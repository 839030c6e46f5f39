"""Column expressions for decoding text and cutting it into lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters removed by strip(): every code point with the white-space property used there.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def unix_newlines(text: Column) -> Column:
    """``\\r\\n`` and lone ``\\r`` become ``\\n``; text without ``\\r`` is passed through."""
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\\r\\n?", "\n")).otherwise(text)


def tolerant_text(raw: Column) -> Column:
    """Bytes to text, dropping whatever is not valid UTF-8, with unix newlines."""
    text = raw.cast("string")
    repaired = F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit(""))
    return unix_newlines(F.when(F.is_valid_utf8(text), text).otherwise(repaired))


def strict_ok(raw: Column) -> Column:
    return F.is_valid_utf8(raw.cast("string"))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def lines(text: Column) -> Column:
    """Array of lines; a final newline ends the last line instead of opening another."""
    body = F.when(F.endswith(text, F.lit("\n")), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    return F.split(body, "\n", -1)


def line_count(text: Column) -> Column:
    open_line = (F.length(text) > 0) & ~F.endswith(text, F.lit("\n"))
    return newlines(text) + open_line.cast("int")


def suffix(path: Column) -> Column:
    """File suffix with its dot: of the last path part, empty for ``.name`` and ``name``."""
    name = F.substring_index(path, "/", -1)
    return F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1)


def language(path: Column) -> Column:
    ext = suffix(path)
    return F.when(ext == ".py", "py").when(ext == ".java", "java").otherwise("other")
