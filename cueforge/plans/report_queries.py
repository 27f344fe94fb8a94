"""Queries over alignment, East Asian texts and corpus reports, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cueforge.functions import cjk
from cueforge.functions import text as X
from cueforge.operators import align as A
from cueforge.operators import cues as C
from cueforge.operators import reports as R
from cueforge.operators import structure as S
from cueforge.plans import cue_queries
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


@query("SELECT conv_id AS video, CASE conv_id % 4 WHEN 0 THEN 'ko' WHEN 1 THEN 'ja' WHEN 2 THEN 'zh' ELSE 'en' END AS lang FROM conversations GROUP BY conv_id")
def file_languages(spark, sf_dir):
    """Conversations of which three in four have their letters in another script."""
    sign = F.get(F.array(F.lit("한국어로 "), F.lit("これはかな"), F.lit("这是汉字")), (F.col("video") % 4).cast("int"))
    rows = B.turns(spark, sf_dir).withColumn("text", F.when(F.col("video") % 4 == 3, F.col("text")).otherwise(F.regexp_replace("text", "[A-Za-z]+", sign)))
    return R.file_languages(rows, ["video"])


def _timed_turns(spark, sf_dir):
    words = F.transform(X.tokenize(F.col("text")), lambda t, i: F.struct(t.alias("word"), (F.col("pos") * 100.0 + i).alias("start"), (F.col("pos") * 100.0 + i + 0.5).alias("end")))
    return B.turns(spark, sf_dir).withColumn("words", words)


@query(
    r"""WITH t AS (SELECT conv_id AS video, turn AS pos, list_filter(string_split_regex(regexp_replace(regexp_replace(text, ' +([.,!?);:}\]])', '\1', 'g'), '([(\[{¡¿]) +', '\1', 'g'), '\s+'), lambda x: x <> '') AS ws FROM conversations),
    f AS (SELECT video, pos, ws, list_reduce(list_prepend([]::VARCHAR[], list_transform(ws, lambda t: [t])), lambda a, x: CASE WHEN len(a) > 0 AND length(a[len(a)]) + 1 + length(x[1]) <= 60 THEN list_append(a[1:len(a) - 1], a[len(a)] || ' ' || x[1]) ELSE list_append(a, x[1]) END) AS ch FROM t),
    c AS (SELECT video, pos, unnest(ch) AS text, generate_subscripts(ch, 1) - 1 AS chunk_pos FROM f),
    n AS (SELECT *, len(string_split(text, ' ')) AS k FROM c), s AS (SELECT *, sum(k) OVER (PARTITION BY video, pos ORDER BY chunk_pos) AS stop FROM n)
    SELECT video, pos, chunk_pos, text, CAST(pos * 100.0 + stop - k AS DOUBLE) AS "start", CAST(pos * 100.0 + stop - 1 + 0.5 AS DOUBLE) AS "end" FROM s"""
)
def aligned_chunks(spark, sf_dir):
    """Chunks of each turn with the times of their words."""
    rows = _timed_turns(spark, sf_dir).withColumn("chunks", S.split_by_length(F.col("text"), 60)).select("video", "pos", "words", "chunks")
    out = A.aligned_segments(rows)
    return out.select("video", "pos", F.col("chunk_pos").cast("long").alias("chunk_pos"), "text", "start", "end")


@query(
    r"""WITH t AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM conversations) SELECT conv_id, turn, array_to_string(ws[1:2], ' ') AS a, array_to_string(ws[3:], ' ') AS b FROM t WHERE len(ws) > 4"""
)
def repaired_pairs(spark, sf_dir):
    """A sentence in two pieces of which the first is without punctuation and the second is missing."""
    ws = X.white_split(F.col("text"))
    rows = B.table(spark, sf_dir, "conversations").where(F.size(ws) > 4)
    sentence = F.array_join(ws, " ")
    out = A.repaired_pair(F.array(F.array_join(F.slice(ws, 1, 2), " "), F.lit("")), sentence)
    return rows.select("conv_id", "turn", out[0].alias("a"), out[1].alias("b"))


@query(
    r"""WITH w AS (SELECT conv_id AS video, turn, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM (SELECT conv_id, turn, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM conversations))
    SELECT video, count(*) AS words, md5(string_agg(word, ' ' ORDER BY turn, k)) AS text_md5, CAST(min(turn) AS DOUBLE) AS "start", max(turn) + 0.5::DOUBLE AS "end" FROM w GROUP BY video"""
)
def video_words(spark, sf_dir):
    """A video's words as one segment."""
    rows = _timed_turns(spark, sf_dir).select("video", F.explode(F.transform(X.white_split(F.col("text")), lambda t, i: F.struct((F.col("pos") * 10000 + i).alias("pos"), t.alias("word"), (F.col("pos") * 1.0).alias("start"), (F.col("pos") + 0.5).alias("end")))).alias("w")).select("video", "w.*")
    out = A.from_words(rows, ["video"])
    return out.select("video", F.size("words").cast("long").alias("words"), F.md5("text").alias("text_md5"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))


@query("SELECT doc_id, CAST(length(regexp_replace(text, '\\s', '', 'g')) AS INTEGER) AS n, true AS rejoined FROM documents".replace("\\\\", "\\"))
def east_asian_tokens(spark, sf_dir):
    """The East Asian tokenizer keeps every character but white space."""
    docs = B.table(spark, sf_dir, "documents")
    tokens = cjk.tokenize()(F.col("text"))
    bare = lambda c: F.regexp_replace(c, r"(?U)\s", "")
    out = docs.select("doc_id", "text", tokens.alias("t")).select("doc_id", cjk.length(F.col("text")).alias("n"), (bare(F.array_join("t", "")) == bare(F.col("text"))).alias("rejoined"))
    return out


@query(
    "WITH " + cue_queries._PAGE_LINES + ", " + cue_queries.sql_clean("lines", "video, pos")
    + f", f AS (SELECT video, max({cue_queries._CHANGED}) AS ch, max(s5 <> s6) AS has FROM cleaned GROUP BY video) SELECT count(*) AS files, CAST(count_if(NOT ch) AS BIGINT) AS unchanged, CAST(count_if(ch AND NOT has) AS BIGINT) AS rule_missed, CAST(count_if(ch AND has) AS BIGINT) AS processed FROM f"
)
def corpus_totals(spark, sf_dir):
    """U07."""
    return R.corpus_totals(C.clean_text(cue_queries._page_lines(spark, sf_dir), steps="steps"), ["video"], require="C6")


@query("SELECT doc_id AS video, true AS content_kept, true AS content_kept_twice, true AS idempotent FROM documents")
def cleaning_invariants(spark, sf_dir):
    """U12."""
    return R.cleaning_invariants(B.cues(spark, sf_dir), ["video"])


@query("SELECT conv_id AS video, true AS text_kept, true AS words_kept, true AS times_kept, true AS ordered, true AS within FROM conversations GROUP BY conv_id")
def structure_invariants(spark, sf_dir):
    """Restructuring into chunks keeps text, words, times and order."""
    before = B.turns(spark, sf_dir).withColumn("text", X.normalize_spacing(F.col("text"))).withColumns({"start": F.col("pos") * 2.0, "end": F.col("pos") * 2.0 + 1.5})
    after = before.select("video", (F.col("pos") * 100000).alias("p"), "start", "end", F.posexplode(S.split_by_length(F.col("text"), 200)).alias("k", "text"))
    return R.structure_invariants(before, after.select("video", (F.col("p") + F.col("k")).alias("pos"), "start", "end", "text"), ["video"], 200)


@query(
    "WITH c AS (" + cue_queries.ORACLE["cue_issues"] + "), n AS (SELECT count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) FROM documents)) "
    + " UNION ALL ".join(f"SELECT '{f}' AS flag, c.\"{f}\" AS n, round(100 * c.\"{f}\" / n.n, 4) AS pct FROM c, n" for f in ("overlaps", "leading_punct", "punct_only"))
)
def corpus_report(spark, sf_dir):
    """U14, U15."""
    return R.corpus_report(C.issue_flags(cue_queries._timed(spark, sf_dir), ["video"]), ["overlaps", "leading_punct", "punct_only"])


@query(
    r"""WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '\s+'), lambda x: regexp_matches(x, '[A-Za-z0-9]')) AS ws FROM conversations), n AS (SELECT *, CAST(len(ws) AS INTEGER) AS n, CAST((len(ws) + 1) // 2 AS INTEGER) AS k FROM w WHERE len(ws) > 1)
    SELECT conv_id, turn, 0 AS chunk, 0 AS first, k AS stop FROM n UNION ALL SELECT conv_id, turn, 1, k, n FROM n"""
)
def words_of_texts(spark, sf_dir):
    """Spans of words in texts that have more than the words."""
    ws = F.filter(X.white_split(F.col("text")), lambda x: x.rlike("[A-Za-z0-9]"))
    rows = B.turns(spark, sf_dir).select(F.col("video").alias("conv_id"), F.col("pos").alias("turn"), ws.alias("ws")).where(F.size("ws") > 1)
    half = F.expr("(size(ws) + 1) div 2").cast("int")
    chunks = F.array(F.concat(F.array_join(F.slice("ws", F.lit(1), half), " "), F.lit(" 00000")), F.array_join(F.slice("ws", half + 1, F.size("ws")), " "))
    spans = rows.select("conv_id", "turn", "ws", chunks.alias("chunks")).select("conv_id", "turn", F.posexplode(A.distributed(F.col("ws"), F.col("chunks"))).alias("chunk", "span"))
    return spans.select("conv_id", "turn", "chunk", F.col("span.first").alias("first"), F.col("span.stop").alias("stop"))


@query(
    r"""WITH w AS (SELECT conv_id, turn, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM (SELECT conv_id, turn, list_filter(string_split_regex(text, '\s+'), lambda x: regexp_matches(x, '[\p{L}\p{N}]')) AS ws FROM conversations)),
    n AS (SELECT *, row_number() OVER v - 1 AS r, coalesce(sum(length(regexp_replace(lower(word), '[^\p{L}\p{N}]', '', 'g'))) OVER (PARTITION BY conv_id ORDER BY turn, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM w WINDOW v AS (PARTITION BY conv_id ORDER BY turn, k))
    SELECT conv_id AS video, 'text' AS kind, CAST(o AS BIGINT) AS "at", word AS "before", 'zzzz' AS "after" FROM n WHERE conv_id % 5 = 1 AND r = 7
    UNION ALL SELECT conv_id, 'time', CAST(o AS BIGINT), word, word FROM n WHERE conv_id % 5 IN (1, 2) AND r = 3"""
)
def planted_faults(spark, sf_dir):
    """Words changed and times moved in some videos, found at their places."""
    ws = F.filter(X.white_split(F.col("text")), lambda x: x.rlike(r"[\p{L}\p{N}]"))
    rows = B.turns(spark, sf_dir).select("video", F.col("pos").alias("turn"), F.posexplode(ws).alias("k", "word"))
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("video").orderBy("turn", "k")) - 1).withColumn("start", F.col("pos") * 0.5).withColumn("end", F.col("pos") * 0.5 + 0.4)
    rows = rows.select("video", "pos", "word", "start", "end")
    kind = F.col("video") % 5
    late = F.when(kind.isin(1, 2) & (F.col("pos") == 3), 0.25).otherwise(0.0)
    after = rows.withColumn("word", F.when((kind == 1) & (F.col("pos") == 7), "zzzz").otherwise(F.col("word"))).withColumn("start", F.col("start") + late)
    return R.word_issues(rows, after, ["video"])
