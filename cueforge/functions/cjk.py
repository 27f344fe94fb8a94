"""Chinese, Japanese and Korean texts: tokens, joining and spacing.

Words need an outside tokenizer, which a caller gives as a function list[str] -> list[list[str]]; without one, every
East Asian character is a token. Latin words, numbers, dotted names and URLs stay whole, and punctuation joins its neighbour.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from . import tables as T
from .text import in_slices

_CODES = lambda body: re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), body)
EAST = _CODES(T.IDEOGRAPHS + T.HANGUL + T.KANA)
_TOKEN = re.compile(rf"https?://[^\s{EAST}]+|[{EAST}]+|[^\W{EAST}]+(?:['’.\-_][^\W{EAST}]+)*|\S")
_EAST = re.compile(f"[{EAST}]")


def tokens_of(text: str, words=None, attach: bool = True) -> list[str]:
    out, glue = [], ""
    for piece in _TOKEN.findall(text or ""):
        if _EAST.match(piece):
            parts = words([piece])[0] if words else list(piece)
        elif attach and len(piece) == 1 and piece in T.TRAILING + T.CLOSING and out:
            out[-1] += piece
            continue
        elif attach and len(piece) == 1 and piece in T.OPENING:
            glue += piece
            continue
        else:
            parts = [piece]
        if glue and parts:
            parts = [glue + parts[0], *parts[1:]]
            glue = ""
        out += parts
    return [*out, glue] if glue else out


def join_of(tokens: list[str]) -> str:
    """A space only between letters or digits that aren't both East Asian. Tokens that are one space are the gaps between Korean words, of which each is joined by itself."""
    words = [""]
    for token in tokens:
        last = words[-1]
        if token == " ":
            if last:
                words.append("")
        elif last and token and last[-1].isalnum() and token[0].isalnum() and not (_EAST.match(last[-1]) and _EAST.match(token[0])):
            words[-1] += " " + token
        else:
            words[-1] += token
    return unicodedata.normalize("NFC", " ".join(w for w in words if w))


def tokenize(words=None, attach: bool = True):
    """A column function: text -> array of tokens."""

    @F.arrow_udf(ArrayType(StringType()))
    def run(texts: pa.Array) -> pa.Array:
        return in_slices(texts, lambda some: [tokens_of(t, words, attach) for t in some], pa.list_(pa.string()))

    return run


@F.pandas_udf(StringType())
def join(rows: pd.Series) -> pd.Series:
    return rows.map(lambda r: None if r is None else join_of(list(r)))


def normalize_spacing(c: Column) -> Column:
    """One space between East Asian characters and Latin letters or digits."""
    east = T.IDEOGRAPHS + T.HANGUL + T.KANA
    c = F.regexp_replace(c, rf"([{east}])\s*([A-Za-z0-9])", "$1 $2")
    return F.regexp_replace(c, rf"([A-Za-z0-9])\s*([{east}])", "$1 $2")


def length(c: Column, latin_width: int = 1) -> Column:
    """East Asian and other characters count 1, a run of Latin letters or digits its length over `latin_width`, rounded up, white space nothing."""
    latin = F.regexp_extract_all(c, F.lit("([A-Za-z0-9]+)"), 1)
    runs = F.aggregate(latin, F.lit(0).cast("long"), lambda a, r: a + F.ceil(F.length(r) / latin_width))
    return (F.length(F.regexp_replace(c, r"(?U)[\sA-Za-z0-9]", "")) + runs).cast("int")
