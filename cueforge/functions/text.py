"""Text rules and language functions as native column expressions.

Each function takes a Column and gives a Column; regular expressions carry (?U) wherever the class has
to cover Unicode. The few that Catalyst can't express exactly are Arrow UDFs behind a native guard.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import tables as T


def chars(c: str) -> str:
    """The characters of a string as a regular expression class body."""
    return "".join("\\" + x if x in "\\[]^-&~#|" else x for x in c)


def let(value: Column, then) -> Column:
    """then(value), computing the value once inside a larger expression."""
    return F.element_at(F.transform(F.array(value), then), 1)


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def trim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def rtrim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


#: Bytes of text that are Python objects together.
SLICE_BYTES = 1 << 20


def in_slices(texts: pa.Array, work, kind: pa.DataType) -> pa.Array:
    """work (list of texts -> list of values) on all texts, some SLICE_BYTES at a time, one text at least."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    parts, row = [], 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + SLICE_BYTES, "right")))
        parts.append(pa.array(work(texts.slice(row, stop - row).to_pylist()), kind))
        row = stop
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


# --- cue text rules --------------------------------------------------------------------------------


@F.arrow_udf(StringType())
def _decode(texts: pa.Array) -> pa.Array:
    def one(found):
        name = found[1]
        if name[0] != "#":
            return T.ENTITIES.get(name, found[0])
        code = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
        return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else found[0]

    reference = re.compile(r"&(#x[0-9a-fA-F]+|#[0-9]+|[a-zA-Z]{2,8});")
    return in_slices(texts, lambda some: [t if t is None else reference.sub(one, t) for t in some], pa.string())


def decode_entities(c: Column) -> Column:
    """One pass of character references; unknown ones stay."""
    return F.when(c.contains("&"), _decode(F.when(c.contains("&"), c))).otherwise(c)


def strip_invisible(c: Column) -> Column:
    return F.regexp_replace(c, T.INVISIBLE, "")


def plain_spaces(c: Column) -> Column:
    return F.translate(c, T.EXOTIC_SPACES, " " * len(T.EXOTIC_SPACES))


def plain_quotes(c: Column) -> Column:
    return F.translate(c, "".join(T.SMART_QUOTES), "".join(T.SMART_QUOTES.values()))


def plain_ellipsis(c: Column) -> Column:
    return F.replace(c, F.lit("…"), F.lit("..."))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?i)</?(?:{'|'.join(T.CUE_TAGS)})(?:(?U)\s[^>]*)?/?>", "")


def strip_controls(c: Column) -> Column:
    """A tab is a space; other characters of the Unicode categories C go."""
    return F.regexp_replace(F.translate(c, "\t", " "), r"\p{C}", "")


def single_spaces(c: Column) -> Column:
    return F.regexp_replace(c, " {2,}", " ")


def attach_punctuation(c: Column) -> Column:
    """No space before a whole run of punctuation that no word or path follows; one after a comma-like mark between letters."""
    run = chars(T.ATTACHED + T.ATTACHED_CJK)
    pattern, kept = T.SPACE_BEFORE_MARKS
    c = F.regexp_replace(c, pattern.replace("{run}", run), kept)
    return F.regexp_replace(c, *T.MARK_BETWEEN_LETTERS)


def dot_runs(c: Column) -> Column:
    """Two dots or more are an ellipsis, but not inside a path."""
    return F.regexp_replace(c, *T.DOT_RUN)


#: Rule id and expression, in the order they apply.
CUE_RULES = [
    ("C10", decode_entities), ("C1", strip_invisible), ("C2", plain_spaces), ("C3", plain_quotes), ("C4", plain_ellipsis), ("C6", strip_tags),
    ("C9", strip_controls), ("C8", single_spaces), ("C7", attach_punctuation), ("C5", dot_runs), ("C8", single_spaces), ("E3", trim),
]

FENCE = T.FENCE


MARK = "⟦[0-9]+⟧"


def is_fenced(c: Column) -> Column:
    """Whether a text can hold a fenced span."""
    return F.contains(c, F.lit("[?")) | F.contains(c, F.lit("[!"))


def mask_fences(c: Column) -> tuple[Column, Column]:
    """(text with numbered marks for the fenced spans, the spans). A mark's first character in the text is a span too, so every mark is one of ours."""
    fence = f"(?s)({FENCE}|⟦)"
    spans = F.regexp_extract_all(c, F.lit(fence), 1)
    # the text between spans, with a mark after each but the last
    outside = F.split(c, fence)
    masked = F.array_join(F.transform(outside, lambda part, k: F.concat(part, F.when(k < F.size(outside) - 1, F.concat(F.lit("⟦"), k.cast("string"), F.lit("⟧"))).otherwise(F.lit("")))), "")
    return masked, spans


def unmask_fences(c: Column, spans: Column) -> Column:
    """The text with the spans in the places of the marks, which are in order."""
    return F.array_join(F.transform(F.split(c, MARK), lambda part, k: F.concat(part, F.coalesce(F.get(spans, k), F.lit("")))), "")


def clean_decoded(c: Column) -> Column:
    """The cue text rules after C10. Each value is computed once, and a rule only where the text holds what it looks for."""

    def guarded(x, mark, rule):
        return let(x, lambda v: F.when(F.contains(v, F.lit(mark)), rule(v)).otherwise(v))

    # of C1 to C4 plain ASCII can hold only DEL
    c = let(c, lambda v: F.when(is_ascii(v), F.translate(v, "\x7f", "")).otherwise(plain_ellipsis(plain_quotes(plain_spaces(strip_invisible(v))))))
    c = strip_controls(guarded(c, "<", strip_tags))
    c = attach_punctuation(guarded(c, "  ", single_spaces))
    # by now every white space is a plain space
    return F.trim(guarded(guarded(c, "..", dot_runs), "  ", single_spaces))


def clean_cue(c: Column) -> Column:
    """All cue text rules in order; fenced spans stay as they are. Null stays null."""
    fenced = is_fenced(c)
    masked, spans = mask_fences(c)
    cleaned = let(decode_entities(F.when(fenced, masked).otherwise(c)), clean_decoded)
    return let(cleaned, lambda x: F.when(fenced, unmask_fences(x, spans)).otherwise(x))


def sanitize_file(c: Column) -> Column:
    """C-SAN: the whole-file chain, which keeps line ends; fenced spans stay as they are."""
    c = F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), r"^\x{FEFF}+", "")
    masked, spans = mask_fences(c)
    x = masked
    for rule in (decode_entities, strip_invisible, plain_spaces, plain_quotes, plain_ellipsis, strip_tags):
        x = rule(x)
    x = F.regexp_replace(F.translate(x, "\t", " "), r"[\p{C}&&[^\n]]", "")
    x = F.regexp_replace(single_spaces(x), r"(?<!\.)\.\.(?!\.)", ".")
    return unmask_fences(x, spans)


@F.arrow_udf(StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    return in_slices(texts, lambda some: [t if t is None else unicodedata.normalize("NFKC", t) for t in some], pa.string())


def content_key(c: Column) -> Column:
    """C-KEY: what must survive cleaning: no markup, spaces or punctuation, compatibility-normalised."""
    # plain ASCII is its own NFKC form and holds no invisible character but DEL
    decoded = decode_entities(c)
    c = F.when(is_ascii(decoded), F.translate(strip_tags(decoded), "\x7f", "")).otherwise(_nfkc(F.when(~is_ascii(decoded), strip_invisible(strip_tags(decoded)))))
    return F.regexp_replace(c, r"(?U)[\s\x{2000}-\x{206F}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}\p{P}$+<=>^`|~]", "")


# --- language functions ----------------------------------------------------------------------------


def language_code(c: Column) -> Column:
    """The code of a name or alias; null if unknown."""
    known = {**T.ALIASES, **{x: x for x in T.CJK + T.SPACE}}
    return F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[F.lower(trim(c))]


def share_of(c: Column, ranges: str) -> Column:
    return F.length(F.regexp_replace(c, f"[^{ranges}]", "")) / F.length(c)


def detect_language(c: Column) -> Column:
    """By the shares of scripts in the first 2000 characters."""
    c = F.substring(F.coalesce(c, F.lit("")), 1, 2000)
    body = F.regexp_replace(c, r"(?U)\s", "")
    return (
        F.when(body == "", "en").when(share_of(body, T.HANGUL) > 0.2, "ko").when(share_of(body, T.KANA) > 0.1, "ja").when(share_of(body, T.IDEOGRAPHS) > 0.3, "zh").otherwise("en")
    )


def normalize_spacing(c: Column, lang: str = "en") -> Column:
    """L10, space family: spaces around punctuation."""
    for pattern, kept in T.FRENCH_SPACING if lang == "fr" else T.PLAIN_SPACING:
        c = F.regexp_replace(c, pattern, kept)
    return c


def white_split(c: Column) -> Column:
    return F.array_remove(F.split(c, r"(?U)\s+"), "")


def tokenize(c: Column, lang: Column | str = "en", mode: str = "word") -> Column:
    """Words of the space family; French keeps its spacing. mode `character`: every character that isn't white space."""
    c = F.coalesce(c, F.lit(""))
    if mode == "character":
        return F.array_remove(F.split(F.regexp_replace(c, r"(?U)\s", ""), ""), "")
    if isinstance(lang, str):
        return white_split(c if lang == "fr" else normalize_spacing(c))
    return white_split(F.when(lang == "fr", c).otherwise(normalize_spacing(c)))


def join_tokens(tokens: Column) -> Column:
    """Words with single spaces; tokens of one punctuation mark take the spacing of their kind."""
    lone = F.exists(tokens, lambda t: t.rlike(r"^[\"',.)\]}(\[{¡¿]$"))
    return F.when(lone, _join_marks(tokens)).otherwise(F.array_join(tokens, " "))


@F.pandas_udf(StringType())
def _join_marks(rows: pd.Series) -> pd.Series:
    def one(tokens):
        if tokens is None:
            return None
        out, glue, quoted, lone = "", True, False, ""
        for token in tokens:
            before, after = not glue, False
            if token == '"':
                quoted = not quoted
                after = quoted
                before = before and quoted
                if lone and not quoted:  # a mark before a closing quote stands with the word before it
                    out = out[: -len(lone) - 1] + lone
            elif token == "'":
                before, after = False, True
            elif token in (",", ".", ")", "]", "}"):
                before = False
            elif token in ("(", "[", "{", "¡", "¿"):
                after = True
            out += (" " if before else "") + token
            lone = token if before and len(token) == 1 and not token.isalnum() else ""
            glue = after
        return out

    return rows.map(one)


def text_length(c: Column, script: str = "space") -> Column:
    """Characters; for CJK without white space."""
    return F.length(c) if script == "space" else F.length(F.regexp_replace(c, r"(?U)\s", ""))


def decompose(c: Column) -> tuple[Column, Column, Column]:
    """Leading punctuation, content, trailing punctuation of a token."""
    p = chars(T.ALL_PUNCT)
    lead = F.regexp_extract(c, rf"^([{p}]*)", 1)
    rest = F.regexp_replace(c, rf"^[{p}]+", "")
    return lead, F.regexp_replace(rest, rf"[{p}]+$", ""), F.regexp_extract(rest, rf"([{p}]*)$", 1)


def strip_punctuation(c: Column) -> Column:
    return decompose(c)[1]


def transfer_punctuation(a: Column, b: Column) -> Column:
    """Words of a with the punctuation of b's words; null if the counts differ. Both are token arrays."""

    def one(x, y):
        lead, _, trail = decompose(y)
        return F.concat(lead, strip_punctuation(x), trail)

    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, one))


@F.pandas_udf(StringType())
def _dotted(before: pd.Series, after: pd.Series) -> pd.Series:
    def one(source, text):
        if source is None or text is None:
            return text
        for word in dict.fromkeys(re.findall(r"\w+(?:\.\w+)+", source)):
            loose = r"\.?\s*".join(map(re.escape, word.split(".")))
            text = re.sub(loose, word, text, flags=re.IGNORECASE)
        return text

    return pd.Series([one(a, b) for a, b in zip(before, after, strict=True)])


def protect_dotted(source: Column, restored: Column) -> Column:
    """Dotted words of the source that a model took apart are put together again."""
    return F.when(source.rlike(r"(?U)\w\.\w"), _dotted(source, restored)).otherwise(restored)


def keep_trailing(source: Column, restored: Column) -> Column:
    """The source's own run of final punctuation replaces that of the restored text."""
    run = rf"[{chars(T.TRAILING + T.DASHES)}]+$"
    own = F.regexp_extract(rtrim(source), rf"({run})", 1)
    return F.when(own != "", F.concat(F.regexp_replace(rtrim(restored), run, ""), own)).otherwise(restored)


def alnum_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"(?U)[^\p{IsAlphabetic}\p{N}]", "")


def punctuation_only_change(a: Column, b: Column) -> Column:
    """L15."""
    return alnum_key(a) == alnum_key(b)


def ends_clause(c: Column, script: str = "space") -> Column:
    """L16."""
    marks = (T.TERMINATORS["space"] + T.SEPARATORS["space"]) if script == "space" else (T.TERMINATORS["zh"] + T.SEPARATORS["cjk"])
    return F.coalesce(rtrim(c).rlike(rf"[{chars(marks)}]$"), F.lit(False))


def split_candidates(texts: Column) -> Column:
    """Inner boundaries of an array of texts, the best balanced first; ones after a clause's end before all others."""
    n = F.size(texts)

    def ranked(lengths):
        total = F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)

        def score(i):
            left = F.aggregate(F.slice(lengths, 1, i), F.lit(0).cast("long"), lambda a, x: a + x)
            weight = F.when(ends_clause(F.element_at(texts, i)), F.lit(1).cast("long")).otherwise(F.lit(10**9).cast("long"))
            return F.struct((weight * F.abs(2 * left - total)).alias("score"), i.alias("i"))

        return F.transform(F.array_sort(F.transform(F.sequence(F.lit(1), n - 1), score)), lambda s: s["i"])

    return F.when(n <= 2, F.array(F.lit(1))).otherwise(let(F.transform(texts, lambda t: F.length(t).cast("long")), ranked))


def length_ratio(a: Column, b: Column) -> Column:
    """L18."""
    return (F.length(a) + 1e-7) / (F.length(b) + 1e-7)


def cross_ratio(k1: Column, v1: Column, k2: Column, v2: Column) -> Column:
    """How far two lengths' proportions are apart; at least 1."""
    r = (k1 * v2 + 1e-4) / (v1 * k2 + 1e-7)
    return F.when(r < 1, 1 / r).otherwise(r)


def rebuilds(chunks: Column, source: Column, strict: bool = False) -> Column:
    """The chunks give the source back, joined by spaces, or by nothing, or (unless strict) in letters and digits."""
    joined = F.array_join(chunks, " ")
    same = (trim(joined) == trim(source)) | (F.array_join(chunks, "") == source) | (single_spaces(trim(joined)) == single_spaces(trim(source)))
    return same if strict else same | (alnum_key(joined) == alnum_key(source))


def short_hash(c: Column, digits: int = 8) -> Column:
    return F.substring(F.sha2(c, 256), 1, digits)


def source_hash(rec_id: Column, text: Column) -> Column:
    """Of the id and the text, stripped."""
    return short_hash(trim(F.concat(rec_id.cast("string"), text)))


def variant_key(alias: Column, model: Column, prompt: Column, config: Column) -> Column:
    """The alias, else a readable model[:prompt][@config hash] of at most 64 characters, else a hash of it."""
    readable = F.concat(model, F.when(prompt != "", F.concat(F.lit(":"), prompt)).otherwise(""), F.when(config != "", F.concat(F.lit("@"), short_hash(config, 6))).otherwise(""))
    return F.coalesce(F.nullif(alias, F.lit("")), F.when(F.length(readable) <= 64, readable).otherwise(short_hash(readable)))


def clean_reply(c: Column) -> Column:
    """Without think blocks, also unclosed ones, and outer backticks."""
    c = F.regexp_replace(c, r"(?s)<think>.*?</think>", "")
    c = F.regexp_replace(c, r"(?s)<think>.*$", "")
    return trim(F.regexp_replace(trim(c), r"^`+|`+$", ""))


def json_span(c: Column) -> Column:
    """The first { to the last }."""
    return F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit(""))


def parse_terms(c: Column) -> Column:
    """The reply's terms: trimmed pairs, neither side blank."""
    terms = F.from_json(F.get_json_object(json_span(c), "$.terms"), "map<string,string>")
    terms = F.transform_values(F.transform_keys(terms, lambda k, v: trim(k)), lambda k, v: trim(v))
    return F.map_filter(terms, lambda k, v: (k != "") & (v != ""))


def parse_mapping(c: Column) -> Column:
    """Pieces of a JSON reply under tgt, zh or target; code fences and trailing commas are forgiven."""
    c = F.regexp_replace(F.regexp_replace(c, r"(?s)```(?:json)?", ""), r",\s*([}\]])", "$1")
    rows = F.from_json(F.regexp_extract(c, r"(?s)(\[.*\])", 1), "array<struct<tgt:string,zh:string,target:string>>")
    return F.transform(rows, lambda r: F.coalesce(r["tgt"], r["zh"], r["target"]))


def parse_lines(c: Column) -> Column:
    """L28, text mode: the first two lines that aren't blank."""
    return F.slice(F.filter(F.transform(F.split(c, "\n"), trim), lambda x: x != ""), 1, 2)


def srt_time(ms: Column) -> Column:
    """HH:MM:SS,mmm."""
    ms = F.greatest(ms, F.lit(0)).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def seconds_time(s: Column) -> Column:
    """HH:MM:SS.mmm."""
    return F.translate(srt_time(F.round(s * 1000).cast("long")), ",", ".")


def strip_prefix(c: Column, rules: dict[str, str] = T.EN_ZH_PREFIXES) -> tuple[Column, Column]:
    """(the stripped text without the first rule's prefix that it starts with in any case, that rule's target prefix or null); something must be left, else the text stays as it is."""
    bare = trim(c)
    low = F.lower(bare)
    rest, prefix = F.when(F.lit(False), c), F.when(F.lit(False), c)
    for source, target in rules.items():
        left = trim(F.substring(bare, len(source) + 1, 1 << 30))
        hit = F.startswith(low, F.lit(source.lower())) & (left != "")
        rest, prefix = rest.when(hit, left), prefix.when(hit, target)
    return rest.otherwise(c), prefix


def capitalize(c: Column) -> Column:
    """L31."""
    return F.when(F.length(c) > 1, F.concat(F.upper(F.left(c, F.lit(1))), F.substring(c, 2, 1 << 30))).otherwise(c)


def width_by_glyph(c: Column, widths: dict[str, float], other: float) -> Column:
    """Sum of glyph widths from a small table."""
    table = F.create_map(*[F.lit(x) for kv in widths.items() for x in kv]) if widths else F.create_map().cast("map<string,double>")
    return F.aggregate(F.array_remove(F.split(c, ""), ""), F.lit(0.0), lambda a, x: a + F.coalesce(table[x].cast("double"), F.lit(float(other))))


def one_line(c: Column) -> Column:
    """L33."""
    for raw, shown in (("\r", "\\r"), ("\n", "\\n"), ("\t", "\\t")):
        c = F.replace(c, F.lit(raw), F.lit(shown))
    return c


def rough_words(c: Column) -> Column:
    """Words, or half the characters where there is one word or none, and at least 1."""
    n = F.size(white_split(c))
    return F.greatest(F.lit(1), F.when(n > 1, n).otherwise(F.floor(F.length(c) / 2))).cast("int")


def natural_key(c: Column) -> Column:
    """O2: a key that sorts runs of digits by their number."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")


# --- sanitizers of model output --------------------------------------------------------------------


def strip_backticks(target: Column, source: Column) -> Column:
    return F.replace(F.regexp_replace(target, r"^`+|`+$|^\n+|\n+$", ""), F.lit("`"), F.lit(""))


def strip_annotation(target: Column, source: Column) -> Column:
    for name in ("注", "说明", "注释"):
        target = F.regexp_replace(target, rf"(?U)（{name}[^（）]*?）\s*[,.?;!，。？；！]*$", "")
    return trim(target)


def colon_as_source(target: Column, source: Column) -> Column:
    last = F.right(rtrim(source), F.lit(1))
    full = F.create_map(*[F.lit(x) for kv in T.FULL_WIDTH.items() for x in kv])[last]
    cut = rtrim(target)
    return F.when(F.endswith(cut, F.lit("：")) & full.isNotNull() & (full != "："), F.concat(F.regexp_replace(cut, "：$", ""), full)).otherwise(target)


def strip_quotes(target: Column, source: Column) -> Column:
    def layer(c):
        out = None
        for a, b in T.QUOTE_PAIRS:
            hit = (F.length(c) >= 2) & F.startswith(c, F.lit(a)) & F.endswith(c, F.lit(b))
            inner = F.substring(c, F.lit(2), F.length(c) - 2)
            out = F.when(hit, inner) if out is None else out.when(hit, inner)
        return out.otherwise(c)

    return layer(layer(target))


def strip_leading(target: Column, source: Column) -> Column:
    return F.regexp_replace(target, r"(?U)^[，、。\s]+", "")


SANITIZERS = {"strip_backticks": strip_backticks, "trailing_annotation_strip": strip_annotation, "colon_to_punctuation": colon_as_source, "quote_strip": strip_quotes, "leading_punct_strip": strip_leading}
