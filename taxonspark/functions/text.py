"""Scalar text functions as Spark Column expressions (all JVM-side, codegen-friendly).

Every function takes and returns ``Column`` so it composes inside ``select``/``where``
and higher-order functions without leaving whole-stage codegen.
"""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import KEYWORD_SEPARATORS, URL_INVALID, URL_NOT_SET

# The characters Python's ``str.strip()`` removes: every code point with ``isspace()``.
# Built from that rule once at import (29 characters, U+0009 .. U+3000).
PY_WHITESPACE = "".join(ch for ch in map(chr, range(sys.maxunicode + 1)) if ch.isspace())


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Python ``str.strip()`` — all Unicode whitespace incl. U+3000, NBSP, U+001C-1F."""
    return F.trim(_c(c), F.lit(PY_WHITESPACE))


def cell_text(c) -> Column:
    """Null -> ""; anything else -> its text, stripped."""
    return F.coalesce(strip(_c(c).cast("string")), F.lit(""))


def clean_list(arr) -> Column:
    """Null -> []; strip elements; drop blanks; keep order and duplicates."""
    a = F.coalesce(_c(arr).cast("array<string>"), F.array().cast("array<string>"))
    return F.filter(F.transform(a, lambda x: F.coalesce(strip(x), F.lit(""))), lambda x: x != "")


_WS_CLASS = "[" + "".join(f"\\u{ord(ch):04x}" for ch in PY_WHITESPACE) + "]"


#: longer texts meet by their digest
WHOLE_KEY = 64


def text_key(c) -> Column:
    """What stands for a text in joins: itself, or of a long one the SHA-256 (as no short text can look), so that it needn't travel."""
    t = _c(c)
    return F.when(F.char_length(t) > WHOLE_KEY, F.concat(F.lit("#"), F.sha2(t, 256))).otherwise(t)


def split_keywords(c) -> Column:
    """Split a keyword cell on ``,`` ``，`` ``、``; strip each piece; drop blanks.

    Lambda-free (code-generated): whitespace next to a separator is removed with one regex,
    the cell is stripped, split, and empty pieces are removed."""
    text = F.coalesce(_c(c).cast("string"), F.lit(""))
    seps = f"[{KEYWORD_SEPARATORS}]"
    tight = F.regexp_replace(text, f"{_WS_CLASS}*({seps}){_WS_CLASS}*", "$1")
    return F.array_remove(F.split(strip(tight), seps), "")


# Every decimal digit of Unicode and its ASCII form, as Python's ``float()`` reads them (by rule, from
# the character data).
_DIGITS = [(ch, str(unicodedata.decimal(ch))) for ch in map(chr, range(128, sys.maxunicode + 1)) if ch.isdecimal()]
_DECIMAL = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def to_int0(c) -> Column:
    """E5: null/unparsable -> 0; else int(float(text)) truncating toward zero. Digits of any script and
    underscores between digits count, as in Python; suffixes and hexadecimal forms don't."""
    t = F.translate(strip(_c(c).cast("string")), "".join(d for d, _ in _DIGITS), "".join(a for _, a in _DIGITS))
    t = F.regexp_replace(t, "(?<=[0-9])_(?=[0-9])", "")
    number = F.when(t.rlike(_DECIMAL), t).try_cast("double")
    return F.coalesce(number.try_cast("bigint"), F.lit(0).cast("bigint"))


def ellipsize(c, n: int) -> Column:
    """First ``n`` code points + "..." when longer."""
    col = _c(c)
    return F.when(F.length(col) > n, F.concat(F.substring(col, 1, n), F.lit("..."))).otherwise(col)


def summary(c, n: int) -> Column:
    """E15 (log form): strip first, then ellipsize."""
    return ellipsize(cell_text(c), n)


def join_nonblank(arr, sep: str) -> Column:
    """Strip, drop blanks, join with ``sep``; duplicates kept."""
    return F.array_join(clean_list(arr), sep)


def mask_secret(c) -> Column:
    """Redact a secret for display."""
    s = cell_text(c)
    n = F.length(s)
    sk = F.concat(F.substring(s, 1, 6), F.lit("***"), F.substring(s, -4, 4))
    other = F.concat(F.substring(s, 1, 2), F.lit("***"), F.substring(s, -2, 2))
    return (F.when(s == "", F.lit(""))
            .when(n <= 8, F.lit("***"))
            .when(s.startswith("sk-"), F.when(n > 10, sk).otherwise(F.lit("sk-***")))
            .when(n > 4, other)
            .otherwise(F.lit("***")))


def url_origin(c) -> Column:
    """``scheme://host`` of an http(s) URL, a marker when blank or invalid."""
    s = F.regexp_replace(cell_text(c), "/+$", "")
    scheme = F.regexp_extract(s, "^(https?://)", 1)
    host = F.regexp_extract(s, "^https?://([^/?]*)", 1)
    return (F.when(cell_text(c) == "", F.lit(URL_NOT_SET))
            .when(scheme != "", F.concat(scheme, host))
            .otherwise(F.lit(URL_INVALID)))


def l2_normalize(v) -> Column:
    """Divide by the L2 norm; a zero vector is left as is."""
    vec = _c(v)
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x))
    return F.when(vec.isNull(), None).otherwise(
        F.transform(vec, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double"))))
