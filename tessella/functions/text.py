"""Scalar functions over text. All but NFC composition run inside the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

#: Patterns of the audits.
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE = r"(?<!\d)(?:\+?91[-\s]?)?[6-9]\d{9}(?!\d)"
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
URL = r"(?i)https?://\S+"
SECRET = r"(?i)\b(api[_-]?key|secret|password|passwd|token)\b\s*[:=]\s*['\"][A-Za-z0-9_\-]{8,}['\"]"
BLANK = "[ \\t\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{202f}\\x{205f}\\x{3000}]"
BLANKS_AND_LINES = " \t\n\u00a0\u1680\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
JOINERS = "\\x{200c}\\x{200d}"
TOKEN = r"[^ \t\n\r\f]+"


@F.pandas_udf(StringType())
def _composed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))


def nfc(c: Column | str) -> Column:
    """Canonical composition. Spark has no built-in for it; only texts with other than ASCII characters go to Python."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(_composed(F.when(F.octet_length(c) != F.length(c), c)), c)


def controls(keep_joiners: bool) -> str:
    """Pattern of control and format characters other than line feed and tab."""
    return f"[\\p{{Cc}}\\p{{Cf}}&&[^\\n\\t{JOINERS if keep_joiners else ''}]]"


def normalize(c: Column, keep_joiners: bool = True, lines_first: bool = False, compose: bool = True) -> Column:
    """NFC (``compose``), without control characters, each line without trailing blanks, and stripped.

    ``lines_first``: CRLF becomes LF before control characters go (the code and Indic audits); otherwise a carriage return is
    just a control character. Null stays null.
    """
    if lines_first:
        c = F.regexp_replace(F.regexp_replace(c, "\r\n", "\n"), "\r", "\n")
    if compose:
        c = nfc(c)
    c = F.regexp_replace(c, controls(keep_joiners), "")
    c = F.regexp_replace(c, "[\\x{2028}\\x{2029}]", "\n")
    c = F.regexp_replace(c, f"(?md){BLANK}+$", "")
    return F.btrim(c, F.lit(BLANKS_AND_LINES))


def control_count(c: Column, keep_joiners: bool = True) -> Column:
    """Number of characters that :func:`normalize` removes as control characters."""
    return F.length(c) - F.length(F.regexp_replace(c, controls(keep_joiners), ""))


def missing(c: Column, default: str) -> Column:
    """``default`` for null and for the empty string."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def tokens(c: Column) -> Column:
    """Number of runs of characters that aren't ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(TOKEN)), F.lit(0))


def ascii_script_ratio(c: Column) -> Column:
    """ASCII letters among all letters; 1 where there are none."""
    # what is left without the others, as counting single letters would make a match of each
    letters = F.length(F.regexp_replace(c, "\\P{L}+", ""))
    return F.when(letters > 0, F.length(F.regexp_replace(c, "[^A-Za-z]+", "")) / letters).otherwise(F.lit(1.0))


#: What a text must hold for a pattern to match at all; looking for it is much cheaper than the pattern.
NEEDS = {EMAIL: "@", IPV4: ".", URL: "://"}


def pattern_count(c: Column, pattern: str) -> Column:
    """Matches of a pattern; 0 for null."""
    n = F.regexp_count(c, F.lit(pattern))
    if pattern in NEEDS:
        n = F.when(F.contains(c, F.lit(NEEDS[pattern])), n)
    return F.coalesce(n, F.lit(0))


def spans(c: Column, begin: str, end: str) -> Column:
    """All texts between two markers, as an array. The markers are taken literally."""
    quote = lambda x: "\\Q" + x + "\\E"
    return F.regexp_extract_all(c, F.lit(f"(?s){quote(begin)}(.*?){quote(end)}"), F.lit(1))


def band(c: Column, edges: list[float], labels: list[str]) -> Column:
    """Label of the half-open interval [edges[i], edges[i+1]); the last one is open above. Null below the first edge."""
    out = F.lit(None).cast("string")
    for e, name in zip(edges, labels):
        out = F.when(c >= e, F.lit(name)).otherwise(out)
    return out


def rank64(key: Column) -> Column:
    """First 64 bits of the SHA-256 of a key in hex: orders as text as the unsigned number does."""
    return F.substring(F.sha2(key, 256), 1, 16)


def unit_hash(key: Column) -> Column:
    """A number in [0, 1) from 52 bits of the SHA-256 of a key."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 13), 16, 10).cast("double") / float(1 << 52)


def decimal_bytes(c: Column) -> Column:
    """Bytes in units of 1000: two decimals under 10 of a unit, one under 100, none beyond."""
    out = shown = F.lit(None).cast("string")
    for i, unit in enumerate(["B", "KB", "MB", "GB", "TB"]):
        v = c.cast("double") / float(1000**i)
        shown = F.when(v < 10, F.format_string("%.2f " + unit, v)).when(v < 100, F.format_string("%.1f " + unit, v)).otherwise(F.format_string("%.0f " + unit, v))
        out = F.when(c.isNotNull(), shown) if i == 0 else F.when(c >= 1000**i, shown).otherwise(out)
    return out


#: Function words of the token categories.
FUNCTION_WORDS = """a an the and or but so then because if when while as of to in on at by for with from into
up out over under about after before he she it they we you i him her them us me his its their our your my was were is
are be been had has have do did not no that this there what who which said""".split()


def token_category(c: Column) -> Column:
    """One of six categories of a token by the first rule that holds."""
    w = F.regexp_replace(c, "^\\s+|\\s+\\z", "")
    return (
        F.when((c == "<|endoftext|>") | (w.eqNullSafe(F.lit("")) & c.contains("\n")), "newline/end")
        .when(w.rlike("^[!-/:-@\\[-`{-~]*\\z"), "punctuation")
        .when(w.rlike("[0-9]"), "number")
        .when(F.lower(w).isin(*FUNCTION_WORDS), "function word")
        .when(w.rlike("^\\p{Lu}"), "capitalised word")
        .otherwise("other word")
    )


#: A spelling of a number: digits, which may be grouped by underscores, with a point and an exponent; infinity; not a number.
DIGITS = r"\d+(?:_\d+)*"
NUMERAL = rf"^[+-]?(?:(?:{DIGITS}(?:\.(?:{DIGITS})?)?|\.{DIGITS})(?:[eE][+-]?{DIGITS})?|(?i:inf|infinity|nan))$"


def numeral(c: Column) -> Column:
    """The number that a token spells, else null. Suffixes of number types (``1f``) are no spelling."""
    t = F.trim(c)
    return F.when(t.rlike(NUMERAL), F.replace(t, F.lit("_"), F.lit("")).try_cast("double"))


def meaning(n: Column) -> Column:
    """Sign, ln(|n| + 1e-6) and n/1000 of a number; zeros where there is none."""
    z = lambda x: F.coalesce(x, F.lit(0.0))
    return F.struct(z(F.signum(n)).alias("sign"), z(F.log(F.abs(n) + 1e-6)).alias("magnitude"), z(n / 1000).alias("scaled"))
