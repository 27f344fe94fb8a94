"""Queries over cues and recognised words, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueforge.functions import tables as T
from cueforge.functions import text as X
from cueforge.operators import cues as C
from cueforge.operators import structure as S
from cueforge.operators import words as W
from cueforge.sources import bindings as B

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


# --- the rules in SQL (RE2 has no lookahead: what follows is captured and put back, and passes are repeated) ---

_INVISIBLE = T.INVISIBLE
_RUN = T.ATTACHED + T.ATTACHED_CJK


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_c10(x):
    for name, char in T.ENTITIES.items():
        if name != "amp":
            x = f"replace({x}, '&{name};', {_lit(char)})"
    return f"replace({x}, '&amp;', '&')"


def sql_c7(x):
    run = r",.!?:;，。！？：；、"
    for _ in range(3):
        x = rf"regexp_replace({x}, ' +([{run}]+)([^{run}A-Za-z0-9_/\\-]|$)', '\1\2', 'g')"
    for _ in range(2):
        x = rf"regexp_replace({x}, '([\p{{L}}\p{{N}}\p{{M}}_])([,:;!?])([A-Za-z])', '\1\2 \3', 'g')"
    return x


SQL_RULES = {
    "C10": sql_c10,
    "C1": lambda x: f"regexp_replace({x}, '{_INVISIBLE}', '', 'g')",
    "C2": lambda x: f"translate({x}, {_lit(T.EXOTIC_SPACES)}, '{' ' * len(T.EXOTIC_SPACES)}')",
    "C3": lambda x: f"translate({x}, {_lit(''.join(T.SMART_QUOTES))}, {_lit(''.join(T.SMART_QUOTES.values()))})",
    "C4": lambda x: f"replace({x}, '…', '...')",
    "C6": lambda x: rf"regexp_replace({x}, '</?(?:{'|'.join(T.CUE_TAGS)})(?:\s[^>]*)?/?>', '', 'gi')",
    "C9": lambda x: rf"regexp_replace(replace({x}, chr(9), ' '), '\p{{C}}', '', 'g')",
    "C8": lambda x: f"regexp_replace({x}, ' {{2,}}', ' ', 'g')",
    "C7": sql_c7,
    "C5": lambda x: rf"regexp_replace({x}, '\.{{2,}}([^.A-Za-z0-9_/\\-]|$)', '...\1', 'g')",
    "E3": lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')",
}
_ORDER = [name for name, _ in X.CUE_RULES]


def sql_clean(source: str, columns: str, text: str = "text", to: str = "cleaned") -> str:
    """CTEs that apply the rules one by one; the last is `to`, with s0..sN of every step."""
    out = [f"{to}_0 AS (SELECT {columns}, {text} AS s0 FROM {source})"]
    for k, name in enumerate(_ORDER):
        out.append(f"{to if k == len(_ORDER) - 1 else f'{to}_{k + 1}'} AS (SELECT *, {SQL_RULES[name](f's{k}')} AS s{k + 1} FROM {to}_{k})")
    return ", ".join(out)


_N = len(_ORDER)


def _ends_sql(core: str, lang: str) -> str:
    word = rf"regexp_replace({core}, '\.+$', '')"
    short = " ".join(f"WHEN {lang} = '{name}' THEN {word} IN ({', '.join(_lit(w) for w in words.split())})" for name, words in T.ABBREVIATIONS.items() if name in ("fr", "de", "es"))
    english = ", ".join(_lit(w) for w in T.ABBREVIATIONS["en"].split())
    return (
        rf"(regexp_matches({core}, '[.!?]$') AND NOT (ends_with({core}, '...') OR (ends_with({core}, '.') AND (regexp_matches({core}, '^(?:[A-Za-z]\.){{2,}}$')"
        rf" OR (CASE {short} ELSE {word} IN ({english}) END) OR regexp_matches({word}, '^[A-Za-z]$')))))"
    )


_TOKENS = r"list_filter(string_split_regex(regexp_replace(regexp_replace({x}, ' +([.,!?);:}}\]])', '\1', 'g'), '([(\[{{¡¿]) +', '\1', 'g'), '\s+'), lambda t: t <> '')"

SENTENCES_SQL = (
    "WITH " + B.CUES_SQL + ", " + sql_clean("cues", "video, lang, pos")
    + f", kept AS (SELECT video, lang, pos, s{_N} AS text FROM cleaned WHERE s{_N} <> '')"
    + ", tk AS (SELECT video, lang, pos, unnest(" + _TOKENS.format(x="text") + ") AS token, generate_subscripts(" + _TOKENS.format(x="text") + ", 1) AS j FROM kept)"
    + r""", tc AS (SELECT *, regexp_replace(token, '["”''’」』]+$', '') AS core, regexp_matches(token, '^["”''’」』]+$') AS lone FROM tk)"""
    + ", te AS (SELECT *, CASE WHEN NOT lone THEN " + _ends_sql("core", "lang") + " END AS fin FROM tc)"
    + ", tb AS (SELECT *, coalesce(last_value(fin IGNORE NULLS) OVER (PARTITION BY video ORDER BY pos, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AND NOT lone AS fresh FROM te)"
    + ", ts AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY video ORDER BY pos, j) AS sent_id FROM tb)"
    + ", ss AS (SELECT video, lang, sent_id, list(token ORDER BY pos, j) AS tokens FROM ts GROUP BY ALL)"
)


def _sentences(spark, sf_dir):
    clean = C.not_empty(C.clean_text(B.cues(spark, sf_dir)))
    return S.sentences(clean, ["video", "lang"], lang=F.col("lang"))


# chunks of at most 90 characters: a fold in SQL over the tokens of each sentence
_CHUNKS_SQL = """, ch AS (SELECT video, lang, sent_id, tokens, list_reduce(list_prepend([]::VARCHAR[], list_transform(tokens, lambda t: [t])), lambda a, x:
  CASE WHEN len(a) > 0 AND length(a[len(a)]) + 1 + length(x[1]) <= 90 THEN list_append(a[1:len(a) - 1], a[len(a)] || ' ' || x[1]) ELSE list_append(a, x[1]) END) AS chunks FROM ss)"""


@query(
    SENTENCES_SQL + _CHUNKS_SQL
    + """, c AS (SELECT lang, sum(len(chunks)) AS chunks, count(*) AS sentences, sum(list_sum(list_transform(chunks, lambda x: length(x)))) AS letters FROM ch GROUP BY lang),
    k AS (SELECT lang, count(*) AS cues FROM kept GROUP BY lang)
    SELECT c.lang, CAST(cues AS BIGINT) AS cues, CAST(sentences AS BIGINT) AS sentences, CAST(chunks AS BIGINT) AS chunks, round(CAST(letters AS DOUBLE) / chunks, 6) AS avg_chunk FROM c JOIN k ON c.lang = k.lang"""
)
def min_slice(spark, sf_dir):
    """Cues cleaned, tokenised, put into sentences and cut into chunks of at most 90 characters, summed by language."""
    clean = C.not_empty(C.clean_text(B.cues(spark, sf_dir)))
    found = S.sentences(clean, ["video", "lang"], lang=F.col("lang"), n_segments="n_cues")
    found = found.select("lang", "n_cues", S.fill_to_length(F.col("tokens"), 90).alias("chunks"))
    letters = F.aggregate("chunks", F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    by = found.groupBy("lang").agg(F.sum("n_cues").alias("cues"), F.count("*").alias("sentences"), F.sum(F.size("chunks")).alias("chunks"), F.sum(letters).alias("_letters"))
    return by.select("lang", "cues", "sentences", "chunks", F.round(F.col("_letters") / F.col("chunks"), 6).alias("avg_chunk"))


@query(SENTENCES_SQL + _CHUNKS_SQL + " SELECT video, CAST(sent_id AS BIGINT) AS sent_id, array_to_string(tokens, ' ') AS sentence, array_to_string(chunks, '|') AS chunks FROM ch")
def sentences(spark, sf_dir):
    """Q01, Q03-Q05, Q07: sentences of every video with their chunks."""
    found = _sentences(spark, sf_dir)
    return found.select("video", F.col("sent_id").cast("long").alias("sent_id"), F.array_join("tokens", " ").alias("sentence"), F.array_join(S.fill_to_length(F.col("tokens"), 90), "|").alias("chunks"))


@query("WITH " + B.CUES_SQL + ", " + sql_clean("cues", "video, pos") + f" SELECT video, pos, s{_N} AS text FROM cleaned WHERE s{_N} <> ''")
def clean_cues(spark, sf_dir):
    """Cleaned cue texts."""
    return C.not_empty(C.clean_text(B.cues(spark, sf_dir))).select("video", "pos", "text")


def _page_lines(spark, sf_dir):
    pages = B.table(spark, sf_dir, "pages").select(F.col("page_id").alias("video"), F.posexplode(F.split("html", "</(?:p|li|h1)>")).alias("pos", "text"))
    return pages.withColumn("pos", F.col("pos").cast("long"))


_PAGE_LINES = """lines AS (SELECT page_id AS video, unnest(string_split_regex(html, '</(?:p|li|h1)>')) AS text, generate_subscripts(string_split_regex(html, '</(?:p|li|h1)>'), 1) - 1 AS pos FROM pages)"""
_COUNTS = ", ".join(f"count_if(s{k} <> s{k + 1}) AS n{k}" for k in range(_N))


@query(
    "WITH " + _PAGE_LINES + ", " + sql_clean("lines", "video, pos")
    + f", c AS (SELECT {_COUNTS} FROM cleaned) SELECT rule_id, CAST(sum(n) AS BIGINT) AS n FROM ("
    + " UNION ALL ".join(f"SELECT '{name}' AS rule_id, n{k} AS n FROM c" for k, name in enumerate(_ORDER))
    + ") GROUP BY rule_id HAVING sum(n) > 0"
)
def rule_counts(spark, sf_dir):
    """C-HITS, U06: how often each rule changed a text."""
    hits = C.clean_text(_page_lines(spark, sf_dir), steps="steps").select(F.explode("steps").alias("s"))
    return hits.groupBy(F.col("s.rule_id").alias("rule_id")).agg(F.count("*").alias("n"))


_CHANGED = " OR ".join(f"s{k} <> s{k + 1}" for k in range(_N))


@query(
    "WITH " + _PAGE_LINES + ", " + sql_clean("lines", "video, pos")
    + f" SELECT video, count(*) AS cues_in, CAST(count_if(s{_N} <> '') AS BIGINT) AS cues_out, CAST(count_if({_CHANGED}) AS BIGINT) AS modified, round(100 * count_if({_CHANGED}) / count(*), 4) AS modified_pct FROM cleaned GROUP BY video"
)
def file_report(spark, sf_dir):
    """Cues in, out and modified of each file."""
    return C.file_report(C.clean_text(_page_lines(spark, sf_dir), steps="steps"), ["video"])


def _sql_sanitize(x):
    x = f"regexp_replace(replace({x}, chr(13), chr(10)), '^\\x{{FEFF}}+', '')"
    for name in ("C10", "C1", "C2", "C3", "C4", "C6"):
        x = SQL_RULES[name](x)
    x = rf"replace(regexp_replace(replace(replace({x}, chr(9), ' '), chr(10), chr(57344)), '[\p{{Cc}}\p{{Cf}}]', '', 'g'), chr(57344), chr(10))"
    x = rf"regexp_replace(regexp_replace({x}, ' {{2,}}', ' ', 'g'), '(^|[^.])\.\.([^.]|$)', '\1.\2', 'g')"
    return x


@query(f"SELECT page_id, md5({_sql_sanitize('html')}) AS text_md5 FROM pages")
def sanitized_files(spark, sf_dir):
    """C-SAN: the whole-file chain."""
    return B.table(spark, sf_dir, "pages").select("page_id", F.md5(X.sanitize_file(F.col("html"))).alias("text_md5"))


_KEY = r"regexp_replace(nfc_normalize(" + SQL_RULES["C1"](SQL_RULES["C6"](SQL_RULES["C10"]("text"))) + r"), '[\s\x{2000}-\x{206F}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}\p{P}$+<=>^`|~]', '', 'g')"


@query(f"SELECT md5({_KEY}) AS content_md5, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def content_keys(spark, sf_dir):
    """C-KEY: documents with the same content but for markup, spaces and punctuation."""
    return B.table(spark, sf_dir, "documents").groupBy(F.md5(X.content_key(F.col("text"))).alias("content_md5")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))


# --- times ---

_TIMES = B.CUES_SQL + """, v AS (SELECT video, pos, start_ms, CASE WHEN pos % 5 = 3 THEN start_ms + 2040 WHEN pos % 11 = 7 THEN start_ms + 2500 ELSE greatest(end_ms, start_ms + 1) END AS end_ms, text FROM cues),
 ok AS (SELECT * FROM v WHERE start_ms >= 0 AND start_ms <= end_ms AND end_ms < 360000000), n AS (SELECT *, lead(start_ms) OVER (PARTITION BY video ORDER BY pos) AS nx FROM ok)"""


def _timed(spark, sf_dir):
    end = F.when(F.col("pos") % 5 == 3, F.col("start_ms") + 2040).when(F.col("pos") % 11 == 7, F.col("start_ms") + 2500).otherwise(F.greatest("end_ms", F.col("start_ms") + 1))
    return B.cues(spark, sf_dir).withColumn("end_ms", end)


@query(
    "WITH " + _TIMES + """ SELECT video, pos, start_ms, greatest(CASE WHEN end_ms > nx AND end_ms - nx <= 100 AND nx > start_ms THEN nx ELSE end_ms END, start_ms + 1) AS end_ms,
    CASE WHEN end_ms > nx AND NOT (end_ms - nx <= 100 AND nx > start_ms) THEN 'overlap' ELSE '' END AS note, row_number() OVER (PARTITION BY video ORDER BY pos) AS number FROM n"""
)
def cue_times(spark, sf_dir):
    """T3, T2, T-MIN, N1."""
    out = C.renumbered(C.fix_overlaps(C.valid_times(_timed(spark, sf_dir)), ["video"]), ["video"])
    return out.select("video", "pos", "start_ms", "end_ms", "note", F.col("number").cast("long").alias("number"))


def _repairable(spark, sf_dir):
    """Cues of which some have no length, every third of them at its neighbour's start."""
    cues = B.cues(spark, sf_dir).withColumn("end_ms", F.when(F.col("pos") % 3 == 0, F.col("start_ms")).otherwise(F.col("end_ms")))
    return cues.withColumn("start_ms", F.when(F.col("pos") % 6 == 0, F.col("start_ms") + 2000).otherwise(F.col("start_ms"))).withColumn("end_ms", F.greatest("start_ms", "end_ms"))


@query()
def cue_repairs(spark, sf_dir):
    """T1M, T1, T-ISSUE: empty lines are cues of no length, every third of them at its neighbour's start."""
    cues = _repairable(spark, sf_dir)
    out = C.repair_times(cues, ["video"])
    return out.select("video", "pos", "start_ms", "end_ms", "note", F.md5("text").alias("text_md5"), F.array_join("issues", ",").alias("issues"))


@query("WITH " + B.CUES_SQL + " SELECT video, count(*) AS cues, CAST(sum(end_ms - start_ms) AS DOUBLE) / 1000 AS seconds, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(end_ms - start_ms) // count(*) AS BIGINT) AS avg_ms, CAST(sum(length(text)) // count(*) AS BIGINT) AS avg_chars FROM cues GROUP BY video")
def cue_stats(spark, sf_dir):
    """U08."""
    return C.cue_stats(B.cues(spark, sf_dir), ["video"])


_P = X.chars(T.ALL_PUNCT).replace("'", "''")


@query(
    "WITH " + _TIMES + f""", f AS (SELECT video, coalesce(lag(end_ms) OVER (PARTITION BY video ORDER BY pos) - start_ms > 10, false) AS o, regexp_matches(text, '^[{X.chars(T.TRAILING + T.CLOSING)}]') AS l, regexp_matches(text, '^[{_P}\\s]+$') AS p FROM v)
    SELECT CAST(count_if(o) AS BIGINT) AS overlaps, CAST(count_if(l) AS BIGINT) AS leading_punct, CAST(count_if(p) AS BIGINT) AS punct_only FROM f"""
)
def cue_issues(spark, sf_dir):
    """U14, U15."""
    return C.issue_flags(_timed(spark, sf_dir), ["video"]).agg(*[F.count_if(c).alias(c) for c in ("overlaps", "leading_punct", "punct_only")])


def sql_srt(ms):
    return f"printf('%02d:%02d:%02d,%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


@query(
    "WITH " + B.CUES_SQL + f", n AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY pos) AS k FROM cues) SELECT video, md5(string_agg(k || chr(10) || {sql_srt('start_ms')} || ' --> ' || {sql_srt('end_ms')} || chr(10) || text, chr(10) || chr(10) ORDER BY k) || chr(10)) AS srt_md5 FROM n GROUP BY video"
)
def srt_files(spark, sf_dir):
    """Every video's caption file."""
    return C.to_srt(B.cues(spark, sf_dir), ["video"]).select("video", F.md5("content").alias("srt_md5"))


@query("WITH " + B.CUES_SQL + " SELECT video, row_number() OVER (PARTITION BY video ORDER BY pos) - 1 AS pos, start_ms, end_ms, text FROM cues WHERE regexp_replace(text, '\\s', '', 'g') <> ''")
def parsed_files(spark, sf_dir):
    """Caption files written from the cues and parsed again; blank cues don't come back."""
    files = C.to_srt(B.cues(spark, sf_dir), ["video"])
    return C.parse_cues(files).select("video", "pos", "start_ms", "end_ms", "text")


# --- recognised words ---


@query("WITH " + B.WORDS_SQL + """, d AS (SELECT *, coalesce("start" IS NULL AND lag("start") OVER w IS NULL AND lag(word) OVER w = word, false) AS same FROM words WINDOW w AS (PARTITION BY video ORDER BY pos)) SELECT video, pos, word FROM d WHERE NOT same""")
def untimed_repeats(spark, sf_dir):
    """W1."""
    return W.drop_untimed_repeats(B.words(spark, sf_dir), ["video"]).select("video", "pos", "word")


@query(
    "WITH " + B.WORDS_SQL + r""", p AS (SELECT *, regexp_matches(word, '^[!-/:-@\[-`{-~]+$') AND row_number() OVER w > 1 AS alone FROM words WINDOW w AS (PARTITION BY video ORDER BY pos)),
    g AS (SELECT *, sum(CASE WHEN alone THEN 0 ELSE 1 END) OVER (PARTITION BY video ORDER BY pos) AS g FROM p)
    SELECT video, min(pos) AS pos, string_agg(word, '' ORDER BY pos) AS word, round(arg_max(coalesce("end", -1), pos), 6) AS "end" FROM g GROUP BY video, g"""
)
def attached_words(spark, sf_dir):
    """W5."""
    return W.attach_ascii(B.words(spark, sf_dir).withColumn("end", F.coalesce("end", F.lit(-1.0))), ["video"]).select("video", "pos", "word", F.round("end", 6).alias("end"))


@query(
    "WITH " + B.WORDS_SQL + r"""SELECT video, pos, CASE WHEN length(word) > 30 AND ((regexp_matches(word, '[A-Za-z]') AND NOT regexp_matches(word, '[a-z]')) OR length(word) > 50) THEN '...' ELSE word END AS word FROM words"""
)
def long_words(spark, sf_dir):
    """W4."""
    return W.shorten_long(B.words(spark, sf_dir)).select("video", "pos", "word")


@query()
def clean_words(spark, sf_dir):
    """W1, W2, W5, W3, W4, W-FIN: all word rules."""
    out = W.clean_words(B.words(spark, sf_dir), ["video"])
    return out.select("video", "pos", "word", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "score")


@query(
    "WITH " + B.WORDS_SQL + """ SELECT video, count(*) AS words, CAST(count_if("start" IS NULL) AS BIGINT) AS untimed, CAST(count_if(score < 0.1) AS BIGINT) AS low_score, CAST(count_if(length(word) > 30) AS BIGINT) AS long_words,
    round(arg_max("end", CASE WHEN "start" IS NOT NULL THEN pos END) - arg_min("start", CASE WHEN "start" IS NOT NULL THEN pos END), 6) AS span FROM words GROUP BY video"""
)
def word_stats(spark, sf_dir):
    """U09."""
    return W.word_stats(B.words(spark, sf_dir), ["video"])


@query()
def word_step_deltas(spark, sf_dir):
    """U10."""
    return W.step_deltas(B.words(spark, sf_dir), ["video"])


@query(
    "WITH " + B.CUES_SQL + r""", t AS (SELECT video, pos, start_ms / 1000 AS s, end_ms / 1000 AS e, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS j FROM (SELECT *, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM cues)),
    c AS (SELECT *, sum(length(word)) OVER (PARTITION BY video, pos ORDER BY j) AS d, sum(length(word)) OVER (PARTITION BY video, pos) AS n FROM t)
    SELECT video, pos AS seg, j AS pos, word, round(s + (e - s) * (d - length(word)) / n + 1e-7, 5) AS w_start, round(s + (e - s) * d / n + 1e-7, 5) AS w_end FROM c"""
)
def synthesized_words(spark, sf_dir):
    """Word times in proportion to their lengths."""
    t = B.cues(spark, sf_dir).select("video", F.col("pos").alias("seg"), (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), X.white_split(F.col("text")).alias("words"))
    out = W.synthesized(t)
    return out.select("video", "seg", "pos", "word", F.round(F.col("w_start") + 1e-7, 5).alias("w_start"), F.round(F.col("w_end") + 1e-7, 5).alias("w_end"))


@query(
    "WITH " + B.WORDS_SQL + ", " + B.CUES_SQL + """, s AS (SELECT video, pos AS seg_pos, start_ms / 1000 AS a, end_ms / 1000 AS b FROM cues)
    SELECT w.video, w.pos, min(s.seg_pos) AS seg_pos FROM words w JOIN s ON w.video = s.video AND s.a - 1e-6 <= w."start" AND w."end" <= s.b + 1e-6 GROUP BY w.video, w.pos"""
)
def words_in_segments(spark, sf_dir):
    """Interval join of words with the first segment that holds them."""
    segs = B.cues(spark, sf_dir).select("video", F.col("pos").alias("seg_pos"), (F.col("start_ms") / 1000).alias("seg_start"), (F.col("end_ms") / 1000).alias("seg_end"))
    return W.assign_to_segments(B.words(spark, sf_dir).where("start is not null"), segs, ["video"]).select("video", "pos", "seg_pos")


_CLOSE, _OPEN = X.chars(T.TRAILING + T.CLOSING + T.DASHES), X.chars(T.OPENING)


@query(
    "WITH " + B.WORDS_SQL + f""", f AS (SELECT *, row_number() OVER w > 1 AND regexp_matches(word, '^[{_CLOSE}]+$') AS back FROM words WHERE "start" IS NOT NULL WINDOW w AS (PARTITION BY video ORDER BY pos)),
    g AS (SELECT *, sum(CASE WHEN back THEN 0 ELSE 1 END) OVER (PARTITION BY video ORDER BY pos) AS g FROM f),
    m AS (SELECT video, min(pos) AS pos, string_agg(word, '' ORDER BY pos) AS word, min("start") AS s, max("end") AS e FROM g GROUP BY video, g),
    o AS (SELECT *, coalesce(lag(regexp_matches(word, '^[{_OPEN}]+$')) OVER (PARTITION BY video ORDER BY pos), false) AS glued FROM m),
    h AS (SELECT *, sum(CASE WHEN glued THEN 0 ELSE 1 END) OVER (PARTITION BY video ORDER BY pos) AS g FROM o)
    SELECT video, min(pos) AS pos, string_agg(word, '' ORDER BY pos) AS word, round(min(s), 6) AS "start", round(max(e), 6) AS "end" FROM h GROUP BY video, g"""
)
def punctuated_words(spark, sf_dir):
    """A01."""
    return W.attach_punctuation(W.finished(B.words(spark, sf_dir)).drop("score"), ["video"]).select("video", "pos", "word", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))
