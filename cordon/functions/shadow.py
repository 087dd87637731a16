"""The shadow text that detectors read, and the way from its characters back to bytes of the original.

Text of characters that stay as they are, without a fold, is its own shadow and stays in the JVM. For other text a pandas UDF folds
bracketed at/dot, drops invisible characters, folds dashes and normalizes each character by itself.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import values as V

_FOLD = re.compile("|".join(re.escape(x) for xs in V.FOLDS.values() for x in xs), re.I | re.A)
_ODD = re.compile(r"[^\x00-\x7F]|" + _FOLD.pattern, re.I | re.A)
#: Characters beyond ASCII that are their own shadow: Latin, Greek and Cyrillic letters, quotes, kana, CJK.
SAME = [(0xC0, 0xFF), (0x100, 0x131), (0x391, 0x3A1), (0x3B1, 0x3C9), (0x400, 0x481), (0x2018, 0x201F), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF)]
#: Texts that need the slow way.
NEEDS_SHADOW = "[^\\x00-\\x7F" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in SAME) + r"]|(?i)[\[({](?:at|dot)[\])}]"


def _in(c: int, ranges: list[tuple[int, int]]) -> bool:
    return any(a <= c <= b for a, b in ranges)


@lru_cache(maxsize=65536)
def shadow_char(c: str) -> str:
    """What one character beyond ASCII becomes."""
    if _in(ord(c), V.INVISIBLE):
        return ""
    if _in(ord(c), V.DASHES):
        return "-"
    return "".join("-" if _in(ord(n), V.DASHES) else n for n in unicodedata.normalize("NFKC", c) if not _in(ord(n), V.INVISIBLE))


def shadow(text: str) -> tuple[str, list[int] | None, list[int] | None]:
    """(shadow, first byte, end byte): bytes of the original for each character of the shadow; None where it is the text."""
    if text.isascii() and not _FOLD.search(text):
        return text, None, None
    if all(c <= "\x7f" or shadow_char(c) == c for c in set(text)) and not _FOLD.search(text):
        return text, None, None
    out, first, end, at, byte = [], [], [], 0, 0
    for m in _ODD.finditer(text):
        plain = text[at : m.start()]
        out.append(plain)
        first.extend(range(byte, byte + len(plain)))
        end.extend(range(byte + 1, byte + len(plain) + 1))
        byte += len(plain)
        found = m[0]
        if len(found) > 1:
            new, size = "@" if found[1] in "aA" else ".", len(found)
        else:
            new, size = shadow_char(found), len(found.encode("utf-8", "surrogatepass"))
        out.append(new)
        first.extend([byte] * len(new))
        end.extend([byte + size] * len(new))
        byte, at = byte + size, m.end()
    plain = text[at:]
    out.append(plain)
    first.extend(range(byte, byte + len(plain)))
    end.extend(range(byte + 1, byte + len(plain) + 1))
    return "".join(out), first, end


_SHADOW = T.StructType([T.StructField("text", T.StringType()), T.StructField("first", T.ArrayType(T.IntegerType())), T.StructField("end", T.ArrayType(T.IntegerType()))])


@F.pandas_udf(_SHADOW)
def _shadow_udf(texts: pd.Series) -> pd.DataFrame:
    rows = [(None, None, None) if t is None else shadow(t) for t in texts]
    return pd.DataFrame(rows, columns=["text", "first", "end"])


def needs_shadow(text: Column) -> Column:
    return F.coalesce(text.rlike(NEEDS_SHADOW), F.lit(False))


def with_shadow(df, column: str, to: str = "__shadow"):
    """df with `to`: struct of text, first, end; first and end are null where the shadow is the text.

    Rows of texts that are their own shadow take the native branch, and only the others are sent to Python.
    """
    plain = ~needs_shadow(F.col(column))
    none = F.lit(None).cast("array<int>")
    own = df.where(plain).withColumn(to, F.struct(F.col(column).alias("text"), none.alias("first"), none.alias("end")))
    return own.unionByName(df.where(~plain).withColumn(to, _shadow_udf(column)))


# --- the single steps as native columns

def fold_at_dot(text: Column) -> Column:
    out = text
    for new, olds in V.FOLDS.items():
        out = F.regexp_replace(out, "(?i)" + "|".join(re.escape(x).replace("/", "\\/") for x in olds), new)
    return out


def _class(ranges: list[tuple[int, int]]) -> str:
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


def strip_invisible(text: Column) -> Column:
    return F.regexp_replace(text, _class(V.INVISIBLE), "")


def fold_dashes(text: Column) -> Column:
    return F.regexp_replace(text, _class(V.DASHES), "-")


def narrow_ascii(text: Column) -> Column:
    """Full-width ASCII and the no-break space to ASCII (the one-to-one part of the normalization that identifiers meet most)."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + " 　"
    return F.translate(text, wide, "".join(chr(c) for c in range(0x21, 0x7F)) + "  ")
