"""Texts aligned with word times, and splits of a sentence put right.

Where a sentence's chunks are its words with single spaces between, the words are counted off. Otherwise each chunk is
looked for from where the one before ended: as it is, without outer punctuation, whatever the case, and by letters and
digits alone.
"""

from __future__ import annotations

import bisect
import itertools
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from cueforge.functions import text as X

SPANS = ArrayType(StructType([StructField("first", IntegerType()), StructField("stop", IntegerType())]))


def _letters(text: str) -> str:
    return "".join(c for c in text.lower() if c.isalnum())


_OUTER = re.compile(rf"^[\s{X.chars(X.T.ALL_PUNCT)}]+|[\s{X.chars(X.T.ALL_PUNCT)}]+$")


def _word_end(text: str, form: str, at: int) -> int:
    """Where `form` ends in the text, from `at` on, with no letter or digit beside it; -1 if it isn't there."""
    k = text.find(form, at)
    while k >= 0:
        end = k + len(form)
        if not (k and text[k - 1].isalnum()) and not (end < len(text) and text[end].isalnum()):
            return end
        k = text.find(form, k + 1)
    return -1


def find_span(words: list[str], text: str, start: int = 0) -> tuple[int, int]:
    """The words from `start` on that come in the text one after another, as (first, stop); (start, start) if the first doesn't.

    Each word is looked up behind the one before: as it stands, without outer punctuation, in any case (all three as a word of its own), and by its letters
    and digits alone. The text may have more between words; the first word that isn't there ends the span. Punctuation alone goes with the word before.
    """
    if not text or not text.strip():
        return start, start
    bare = ends = None
    at, first, stop = 0, None, start
    for k in range(start, len(words)):
        core = _OUTER.sub("", words[k])
        if not core:
            stop = stop if first is None else k + 1
            continue
        end = _word_end(text, words[k].strip(), at)
        end = _word_end(text, core, at) if end < 0 else end
        if end < 0 and (hit := re.compile(rf"(?<![^\W_]){re.escape(core)}(?![^\W_])", re.IGNORECASE).search(text, at)):
            end = hit.end()
        if end >= 0:
            at = end
        else:
            if bare is None:
                letters = [(low, i + 1) for i, c in enumerate(text) if c.isalnum() for low in c.lower()]
                bare, ends = "".join(c for c, _ in letters), [e for _, e in letters]
            own = _letters(core)
            place = bare.find(own, bisect.bisect_right(ends, at)) if own else -1
            if place < 0:
                break
            at = ends[place + len(own) - 1]
        first, stop = k if first is None else first, k + 1
    return (start, start) if first is None else (first, stop)


def spans_of(words: list[str], chunks: list[str | None]) -> list[tuple[int, int]]:
    """For each chunk the span of words that it takes."""
    spaced = " ".join(words)
    if spaced == " ".join(c or "" for c in chunks) and len(spaced.split(" ")) == len(words) and all(w and any(map(str.isalnum, w)) for w in words):
        stops = [0, *itertools.accumulate(c.count(" ") + 1 for c in chunks)]
        return list(itertools.pairwise(stops))
    out, at = [], 0
    for c in chunks:
        first, at = find_span(words, c or "", at)
        out.append((first, at))
    return out


#: Rows whose words are Python objects together.
_ROWS = 1 << 8


@F.arrow_udf(SPANS)
def distributed(words: pa.Array, chunks: pa.Array) -> pa.Array:
    """For each chunk the span of words that it takes: array of (first, stop). Both are arrays of strings.

    Chunks that are the words with single spaces between are counted off; all others go through find_span().
    """
    kind = pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32())]))
    parts = []
    for k in range(0, len(words), _ROWS):
        pairs = zip(words.slice(k, _ROWS).to_pylist(), chunks.slice(k, _ROWS).to_pylist(), strict=True)
        parts.append(pa.array([None if ws is None or cs is None else [{"first": a, "stop": b} for a, b in spans_of([w or "" for w in ws], cs)] for ws, cs in pairs], kind))
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def aligned_segments(rows: DataFrame, words: str = "words", chunks: str = "chunks") -> DataFrame:
    """One row per chunk with its words' first start and last end; 0.0 where no word was found. words: array of (word, start, end)."""
    out = rows.withColumn("_s", distributed(F.col(words)["word"], F.col(chunks)))
    # each chunk takes its own words along, not all of the row
    own = lambda span: F.slice(words, span["first"] + 1, span["stop"] - span["first"])
    parts = F.transform(F.arrays_zip(F.col(chunks).alias("text"), F.col("_s").alias("span")), lambda z: F.struct(z["text"].alias("text"), own(z["span"]).alias("words")))
    rest = [c for c in rows.columns if c not in (words, chunks)]
    out = out.select(*rest, F.posexplode(parts).alias("chunk_pos", "z"))
    return out.select(
        *rest, "chunk_pos", F.col("z.text").alias("text"),
        F.coalesce(F.array_min(F.col("z.words.start")), F.lit(0.0)).alias("start"), F.coalesce(F.array_max(F.col("z.words.end")), F.lit(0.0)).alias("end"), F.col("z.words").alias("words"),
    )


#: Marks at the end of a piece.
_TAIL = re.compile(r"[^\w\s]+$")


def swapped_tails(first: str, second: str) -> tuple[str, str]:
    """Two pieces with each other's final marks, if both have some."""
    a, b = _TAIL.search(first), _TAIL.search(second)
    return (first[: a.start()] + b[0], second[: b.start()] + a[0]) if a and b else (first, second)


def repair_pair(pieces: list[str], sentence: str, keep_order: bool = False) -> list[str] | None:
    """Two pieces as stretches of the sentence's words, compared without outer punctuation, that make it up; a piece that isn't there is what the other leaves.

    Pieces in the other order are put in the sentence's, or with `keep_order` stay and exchange their final marks. None if the two don't make up the sentence.
    """
    taken: set[int] = set()
    words = sentence.split()
    cores = [_OUTER.sub("", w) for w in words]

    def stretch(piece: str) -> str:
        wanted = [_OUTER.sub("", w) for w in piece.split()]
        for k in range(len(words) - len(wanted) + 1 if wanted else 0):
            span = range(k, k + len(wanted))
            if cores[k : span.stop] == wanted and not taken & set(span):
                taken.update(span)
                return " ".join(words[k : span.stop])
        return ""

    def bare(*texts: str) -> str:
        return re.sub(r"\s", "", "".join(texts))

    def rest(part: str) -> str:
        return sentence.replace(part, "", 1).strip()

    a, b = map(stretch, pieces)
    if not a and not b:
        return None
    a, b = a or rest(b), b or rest(a)
    whole = bare(sentence)
    if bare(a, b) == whole:
        return [a, b]
    if bare(b, a) == whole:
        return list(swapped_tails(a, b)) if keep_order else [b, a]
    return next(([x, y] for x, y in ((a, rest(a)), (rest(b), b)) if x and y and bare(x, y) == whole), None)


def repaired_pair(pieces: Column, sentence: Column, keep_order: bool = False) -> Column:
    """repair_pair() on columns. Pieces that make up the sentence as they are stay so; null if they can't be put right."""

    @F.pandas_udf(ArrayType(StringType()))
    def repair(pieces: pd.Series, sentences: pd.Series) -> pd.Series:
        fine = lambda pair, s: pair is not None and len(pair) == 2 and s
        return pd.Series([repair_pair([x or "" for x in p], s, keep_order) if fine(p, s) else None for p, s in zip(pieces, sentences, strict=True)])

    plain = F.coalesce((F.size(pieces) == 2) & (F.array_join(pieces, " ") == sentence), F.lit(False))
    return F.when(plain, pieces).otherwise(repair(F.when(~plain, pieces), F.when(~plain, sentence)))


def from_words(words: DataFrame, keys: list[str]) -> DataFrame:
    """One segment per video out of its words."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "word", "start", "end")))
    return words.groupBy(*keys).agg(rows.alias("words")).select(
        *keys, F.array_join(F.transform("words", lambda w: w["word"]), " ").alias("text"), F.array_min(F.transform("words", lambda w: w["start"])).alias("start"), F.array_max(F.transform("words", lambda w: w["end"])).alias("end"), "words"
    )
