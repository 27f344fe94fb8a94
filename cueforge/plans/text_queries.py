"""Queries of language functions over conversations and documents, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueforge.functions import tables as T
from cueforge.functions import text as X
from cueforge.sources import bindings as B

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return keep


_RUN = X.chars(T.TRAILING + T.DASHES)
_PUNCT = X.chars(T.ALL_PUNCT).replace("'", "''")


@query(
    "WITH " + B.PAIRS_SQL
    + rf""", r AS (SELECT conv_id, turn, tgt, regexp_extract(regexp_replace(src, '\s+$', ''), '([{_RUN}]+)$', 1) AS own, regexp_replace(regexp_replace(tgt, '\s+$', ''), '[{_RUN}]+$', '') AS body FROM pairs)
    SELECT conv_id, turn, md5(CASE WHEN own <> '' THEN body || own ELSE tgt END) AS text_md5 FROM r"""
)
def final_marks(spark, sf_dir):
    """A reply ends with its source's own run of final punctuation."""
    pairs = B.pairs(spark, sf_dir)
    return pairs.select("conv_id", "turn", F.md5(X.keep_trailing(F.col("src"), F.col("tgt"))).alias("text_md5"))


@query(
    rf"""WITH t AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM conversations)
    SELECT conv_id, turn, md5(array_to_string(list_transform(ws, lambda w: regexp_extract(w, '^([{_PUNCT}]*)', 1)
      || regexp_replace(regexp_replace(lower(w), '^[{_PUNCT}]+', ''), '[{_PUNCT}]+$', '') || regexp_extract(regexp_replace(w, '^[{_PUNCT}]+', ''), '([{_PUNCT}]*)$', 1)), ' ')) AS text_md5 FROM t"""
)
def transferred_marks(spark, sf_dir):
    """Lower-cased words with the punctuation of the words as they were."""
    words = X.white_split(F.col("text"))
    found = B.table(spark, sf_dir, "conversations").select("conv_id", "turn", X.transfer_punctuation(F.transform(words, F.lower), words).alias("t"))
    return found.select("conv_id", "turn", F.md5(F.array_join("t", " ")).alias("text_md5"))


@query(
    r"""SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')[1:2], '|')) AS lines_md5 FROM documents"""
)
def first_lines(spark, sf_dir):
    """L28, text mode: the first two lines with text."""
    return B.table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(X.parse_lines(F.col("text")), "|")).alias("lines_md5"))


_NAMES = {"en": " English", "fr": "FRENCH", "de": "de", "es": "es-ES"}


@query(
    "SELECT CASE WHEN lang = 'es' THEN NULL ELSE lang END AS code, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1"
)
def language_codes(spark, sf_dir):
    """Names, other cases and an unknown tag as language codes."""
    name = F.create_map(*[F.lit(x) for kv in _NAMES.items() for x in kv])[F.col("lang")]
    return B.table(spark, sf_dir, "documents").where("lang is not null").groupBy(X.language_code(name).alias("code")).agg(F.count("*").alias("n"))


_GLYPHS = {"i": 0.25, "l": 0.25, "m": 0.875}


@query(
    """SELECT conv_id, turn, round(CAST(length(text) AS DOUBLE) * 0.5 - (length(text) - length(replace(replace(text, 'i', ''), 'l', ''))) * 0.25 + (length(text) - length(replace(text, 'm', ''))) * 0.375, 6) AS width FROM conversations"""
)
def glyph_widths(spark, sf_dir):
    """Widths of texts by a table of glyphs."""
    return B.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(X.width_by_glyph(F.col("text"), _GLYPHS, 0.5), 6).alias("width"))


_PREFIXES = {"The ": "le ", "In": "en ", "And ": "et "}


def _by_prefix(value) -> str:
    return "CASE k " + " ".join(f"WHEN {k} THEN {value(source, target)}" for k, (source, target) in enumerate(_PREFIXES.items())) + " END"


@query(
    "WITH r AS (SELECT conv_id, turn, text, CASE "
    + " ".join(f"WHEN starts_with(lower(text), '{p.lower()}') AND trim(text[{len(p) + 1}:]) <> '' THEN {k}" for k, p in enumerate(_PREFIXES))
    + f" END AS k FROM conversations) SELECT conv_id, turn, {_by_prefix(lambda source, target: repr(target))} AS prefix,"
    + f" md5(coalesce(ltrim(text[{_by_prefix(lambda source, target: len(source) + 1)}:]), text)) AS rest_md5 FROM r"
)
def stripped_prefixes(spark, sf_dir):
    """Texts without the first known prefix, and that prefix in the target language."""
    rest, prefix = X.strip_prefix(F.col("text"), _PREFIXES)
    return B.table(spark, sf_dir, "conversations").select("conv_id", "turn", prefix.alias("prefix"), F.md5(rest).alias("rest_md5"))
