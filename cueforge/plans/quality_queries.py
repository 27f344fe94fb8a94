"""Queries over texts, translation pairs, attempts and alignments, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cueforge.functions import checks as K
from cueforge.functions import tables as T
from cueforge.functions import text as X
from cueforge.operators import select as G
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


def _turns(spark, sf_dir):
    return B.table(spark, sf_dir, "conversations")


_P = "[" + X.chars(T.ALL_PUNCT).replace("'", "''") + "]"
_NORM = r"regexp_replace(regexp_replace(text, ' +([.,!?);:}\]])', '\1', 'g'), '([(\[{¡¿]) +', '\1', 'g')"


@query(
    r"""SELECT conv_id, turn, CAST(CASE WHEN regexp_replace(text, '\s', '', 'g') = '' THEN 'en' ELSE 'en' END AS VARCHAR) AS lang,
    CAST(len(list_filter(string_split_regex(""" + _NORM + r""", '\s+'), lambda x: x <> '')) AS INTEGER) AS n_tokens, CAST(length(regexp_replace(text, '\s', '', 'g')) AS INTEGER) AS n_characters, CAST(length(text) AS INTEGER) AS n_length,
    md5(""" + _NORM + r""") AS normalized_md5, coalesce(regexp_matches(regexp_replace(text, '\s+$', ''), '[.!?,;:—]$'), false) AS ends_clause,
    substr(sha256(regexp_replace(conv_id || text, '^\s+|\s+$', '', 'g')), 1, 8) AS src_hash,
    md5(replace(replace(replace(text, chr(13), '\r'), chr(10), '\n'), chr(9), '\t')) AS shown_md5,
    CAST(greatest(1, CASE WHEN len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) > 1 THEN len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) ELSE length(text) // 2 END) AS INTEGER) AS rough_words,
    CASE WHEN length(text) > 1 THEN upper(text[1]) || text[2:] ELSE text END AS capitalized FROM conversations"""
)
def text_functions(spark, sf_dir):
    """L02, L05, L09, L10, L16, L23, L31, L33, L34."""
    t = F.col("text")
    return _turns(spark, sf_dir).select(
        "conv_id", "turn", X.detect_language(t).alias("lang"), F.size(X.tokenize(t)).alias("n_tokens"), F.size(X.tokenize(t, mode="character")).alias("n_characters"), X.text_length(t).alias("n_length"),
        F.md5(X.normalize_spacing(t)).alias("normalized_md5"), X.ends_clause(t).alias("ends_clause"), X.source_hash(F.col("conv_id"), t).alias("src_hash"),
        F.md5(X.one_line(t)).alias("shown_md5"), X.rough_words(t).alias("rough_words"), X.capitalize(t).alias("capitalized"),
    )


@query(
    "WITH k AS (SELECT conv_id, turn, unnest(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS token FROM conversations)"
    rf" SELECT regexp_extract(token, '^({_P}*)', 1) AS lead, regexp_replace(regexp_replace(token, '^{_P}+', ''), '{_P}+$', '') AS content, regexp_extract(regexp_replace(token, '^{_P}+', ''), '({_P}*)$', 1) AS trail, count(*) AS n FROM k GROUP BY 1, 2, 3"
)
def decomposed_tokens(spark, sf_dir):
    """Tokens by leading punctuation, content and trailing punctuation."""
    lead, content, trail = X.decompose(F.col("token"))
    rows = _turns(spark, sf_dir).select(F.explode(X.white_split(F.col("text"))).alias("token"))
    return rows.select(lead.alias("lead"), content.alias("content"), trail.alias("trail")).groupBy("lead", "content", "trail").agg(F.count("*").alias("n"))


@query(
    "WITH " + B.PAIRS_SQL + r""" SELECT conv_id, turn, round((length(src) + 1e-7) / (length(tgt) + 1e-7), 6) AS ratio,
    round(CASE WHEN r < 1 THEN 1 / r ELSE r END, 6) AS cross, regexp_replace(lower(src), '[^\p{L}\p{N}]', '', 'g') = regexp_replace(lower(tgt), '[^\p{L}\p{N}]', '', 'g') AS same_words FROM
    (SELECT *, (length(src) * prompt_tokens + 1e-4) / (completion_tokens * length(tgt) + 1e-7) AS r FROM pairs)"""
)
def pair_ratios(spark, sf_dir):
    """L15, L18, L19."""
    s, t = F.col("src"), F.col("tgt")
    return B.pairs(spark, sf_dir).select(
        "conv_id", "turn", F.round(X.length_ratio(s, t), 6).alias("ratio"),
        F.round(X.cross_ratio(F.length("src"), F.col("completion_tokens"), F.length("tgt"), F.col("prompt_tokens")), 6).alias("cross"), X.punctuation_only_change(s, t).alias("same_words"),
    )


@query(
    """WITH v AS (SELECT DISTINCT event_type AS model, 'p' || event_id % 3 AS prompt, 'cfg' || event_id % 4 AS config FROM events)
    SELECT model, prompt, config, CASE WHEN length(k) <= 64 THEN k ELSE substr(sha256(k), 1, 8) END AS variant FROM (SELECT *, model || ':' || prompt || '@' || substr(sha256(config), 1, 6) AS k FROM v)"""
)
def variant_keys(spark, sf_dir):
    """L25."""
    e = B.table(spark, sf_dir, "events")
    v = e.select(F.col("event_type").alias("model"), F.concat(F.lit("p"), (F.col("event_id") % 3).cast("string")).alias("prompt"), F.concat(F.lit("cfg"), (F.col("event_id") % 4).cast("string")).alias("config")).distinct()
    return v.withColumn("variant", X.variant_key(F.lit(None).cast("string"), F.col("model"), F.col("prompt"), F.col("config")))


@query(
    r"""SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, regexp_replace(regexp_replace('<think>' || event_type || '</think> ```' || props || '```', '<think>.*?</think>', '', 'g'), '^\s*`+|`+\s*$', '', 'g') AS cleaned FROM events"""
)
def reply_parsing(spark, sf_dir):
    """Cleaned replies and their JSON span."""
    reply = F.concat(F.lit("<think>"), "event_type", F.lit("</think> ```"), "props", F.lit("```"))
    cleaned = X.clean_reply(reply)
    return B.table(spark, sf_dir, "events").select("event_id", F.get_json_object(X.json_span(cleaned), "$.k").alias("k"), cleaned.alias("cleaned"))


@query(
    "WITH " + B.PAIRS_SQL + r""", z AS (SELECT conv_id, turn, regexp_replace(replace(regexp_replace('`' || tgt || '`', '^`+|`+$|^\n+|\n+$', '', 'g'), '`', ''), '^\s+|\s+$', '', 'g') AS t FROM pairs),
    q AS (SELECT conv_id, turn, CASE WHEN length(t) >= 2 AND ((t[1] = '"' AND t[-1] = '"') OR (t[1] = '''' AND t[-1] = '''')) THEN t[2:-2] ELSE t END AS t FROM z)
    SELECT conv_id, turn, md5(regexp_replace(t, '^[，、。\s]+', '')) AS target_md5 FROM q"""
)
def sanitized_targets(spark, sf_dir):
    """The strict scene's sanitizers."""
    scene = K.pair_scene("en", "fr")
    out = K.sanitized(scene, F.col("src"), F.concat(F.lit("`"), "tgt", F.lit("`")))
    return B.pairs(spark, sf_dir).select("conv_id", "turn", F.md5(out).alias("target_md5"))


_EN, _FR = T.PROFILES["en"], T.PROFILES["fr"]
_FORBID = " OR ".join(f"contains(lower(tgt), '{w.replace(chr(39), chr(39) * 2)}')" for w in _FR["forbidden"])
_PAIRS = " OR ".join(
    "((" + " OR ".join(f"contains(lower(tgt), '{w}')" for w in _FR["concepts"][k]) + ") AND NOT (" + " OR ".join(f"contains(lower(src), '{w}')" for w in words) + "))" for k, words in _EN["concepts"].items()
)
_TRIM = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_S, _T = _TRIM.format(x="src"), _TRIM.format(x="tgt")
_WORDS = r"len(list_filter(string_split_regex(src, '\s+'), lambda x: x <> ''))"
CHECKS_SQL = f"""chk AS (SELECT *, {_S} AS s, {_T} AS t, {_WORDS} AS w FROM pairs),
 one AS (SELECT *, list_filter([
   CASE WHEN s <> '' AND t = '' THEN 'non_empty:error' END,
   CASE WHEN s <> '' AND t <> '' AND length(t) > 200 THEN 'length_abs_max:error' WHEN s <> '' AND t <> '' AND length(t) <= 3 AND length(s) > 4.0 * length(t) THEN 'length_short_target:error' END,
   CASE WHEN s <> '' AND t <> '' AND CAST(length(t) AS DOUBLE) / length(s) > CASE WHEN w < 3 THEN 5.0 WHEN w < 8 THEN 3.0 WHEN w < 20 THEN 2.0 ELSE 1.6 END THEN 'length_ratio:error' END,
   CASE WHEN contains(t, chr(10)) AND (length(t) - length(replace(t, '$$', ''))) / 2 < 2 THEN 'format_newline:error' WHEN contains(t, '**') THEN 'format_markdown:error'
        WHEN regexp_matches(lower(t), '^(?:bien sûr[,.]?\\s|d''accord[,.]?\\s|compris[,.]?\\s)') THEN 'format_hallucination:error'
        WHEN regexp_matches(t, '^[（【\\[(]') AND NOT regexp_matches(s, '^[\\[(]') THEN 'format_bracket:error' END,
   CASE WHEN {_FORBID} THEN 'keyword_forbidden:error' WHEN {_PAIRS} THEN 'keyword_inconsistency:error' END,
   CASE WHEN ends_with(s, '?') AND NOT contains(tgt, '?') THEN 'question_mark:' || CASE WHEN ends_with(lower(s), 'right?') OR ends_with(lower(s), 'ok?') OR ends_with(lower(s), 'okay?') OR ends_with(lower(s), 'why?') THEN 'info' ELSE 'warning' END END,
   CASE WHEN completion_tokens > 800 THEN 'output_tokens_max:warning' WHEN prompt_tokens > 0 AND prompt_tokens < 50 AND completion_tokens > 80 THEN 'output_tokens_short_input:warning'
        WHEN prompt_tokens > 0 AND completion_tokens / prompt_tokens > 10.0 THEN 'output_tokens_ratio:warning' END
 ], lambda x: x IS NOT NULL) AS found FROM chk)"""


@query(
    "WITH " + B.PAIRS_SQL + ", " + CHECKS_SQL
    + """ SELECT conv_id, turn, CASE WHEN len(list_filter(found, lambda x: ends_with(x, ':error'))) > 0 THEN list_filter(found, lambda x: ends_with(x, ':error'))[1] ELSE coalesce(array_to_string(found, ','), '') END AS issues,
    len(list_filter(found, lambda x: ends_with(x, ':error'))) = 0 AS passed FROM one"""
)
def checked_pairs(spark, sf_dir):
    """The strict scene from English to French; the first issue of the first failing check, or all warnings."""
    scene = K.pair_scene("en", "fr")
    rows = B.pairs(spark, sf_dir).withColumn("issues", K.run_scene(scene, F.col("src"), F.col("tgt")))
    shown = F.transform("issues", lambda x: F.concat(x["rule"], F.lit(":"), x["severity"]))
    errors = F.filter(shown, lambda x: F.endswith(x, F.lit(":error")))
    return rows.select("conv_id", "turn", F.when(F.size(errors) > 0, F.get(errors, F.lit(0))).otherwise(F.array_join(shown, ",")).alias("issues"), K.passed(F.col("issues")).alias("passed"))


@query(
    "WITH " + B.PAIRS_SQL + """, x AS (SELECT conv_id, turn, src, tgt, lag(tgt) OVER (PARTITION BY conv_id ORDER BY turn) AS prior FROM pairs),
    e AS (SELECT *, CASE WHEN length(trim(tgt)) > 200 OR length(trim(tgt)) * 1.0 / length(trim(src)) > 5 THEN 1 ELSE 0 END AS a, CASE WHEN length(trim(prior)) > 200 OR length(trim(prior)) * 1.0 / length(trim(src)) > 5 THEN 1 ELSE 0 END AS b FROM x)
    SELECT conv_id, turn, md5(CASE WHEN prior IS NOT NULL AND a > b THEN prior ELSE tgt END) AS chosen_md5 FROM e"""
)
def regression_gate(spark, sf_dir):
    """A worse translation gives way to the one before."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = B.pairs(spark, sf_dir).withColumn("prior", F.lag("tgt").over(w))
    scene = {"sanitize": [], "rules": [("length_bounds", "error", {"short_target_max": 0}), ("length_ratio", "error", {"thresholds": (5.0, 5.0, 5.0, 5.0)})]}
    now, before = K.run_scene(scene, F.col("src"), F.col("tgt")), K.run_scene(scene, F.col("src"), F.col("prior"))
    return rows.select("conv_id", "turn", F.md5(K.keep_better(now, before, F.col("tgt"), F.col("prior"))).alias("chosen_md5"))


# --- selection ---


def _attempts(spark, sf_dir):
    """Assistant turns are successive attempts of a conversation; one is accepted if it is short enough and has a full stop at its end."""
    t = _turns(spark, sf_dir).where("role = 'assistant'").select(F.col("conv_id").alias("rec_id"), F.col("turn").alias("attempt"), "text")
    return t.withColumn("passed", (F.length("text") < 400) & F.endswith("text", F.lit(".")))


_ATTEMPTS = "att AS (SELECT conv_id AS rec_id, turn AS attempt, text, length(text) < 400 AND ends_with(text, '.') AS passed FROM conversations WHERE role = 'assistant')"


@query(
    "WITH " + _ATTEMPTS + """, r AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY NOT passed, CASE WHEN passed THEN attempt END, attempt DESC) AS k, count(*) OVER (PARTITION BY rec_id) AS n FROM att)
    SELECT rec_id, attempt, md5(text) AS text_md5, passed AS accepted, n AS attempts FROM r WHERE k = 1"""
)
def accepted_attempts(spark, sf_dir):
    """The first accepted attempt, else the last."""
    return G.first_accepted(_attempts(spark, sf_dir), ["rec_id"]).select("rec_id", "attempt", F.md5("text").alias("text_md5"), F.col("passed").alias("accepted"), "attempts")


@query(
    "WITH " + _ATTEMPTS + """, a AS (SELECT *, CAST(sum(CASE WHEN passed THEN 1 ELSE 0 END) OVER (ORDER BY rec_id, attempt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - CASE WHEN passed THEN 1 ELSE 0 END AS BIGINT) AS k, rec_id // 50 AS video FROM att),
    b AS (SELECT *, k - min(k) OVER (PARTITION BY video) AS n FROM a),
    c AS (SELECT video, rec_id, attempt, n, CASE WHEN n <= 4 THEN n ELSE 3 + (n - 5) % 2 END AS h FROM b)
    SELECT c.video, c.rec_id, c.attempt, coalesce(string_agg(p.rec_id || ':' || p.attempt, ',' ORDER BY p.n), '') AS context FROM c LEFT JOIN (SELECT * FROM b WHERE passed) p ON p.video = c.video AND p.n >= c.n - c.h AND p.n < c.n GROUP BY ALL"""
)
def context_windows(spark, sf_dir):
    """Recent accepted pairs before each row; the window of 4 drops half at once."""
    rows = _attempts(spark, sf_dir).withColumn("video", F.expr("rec_id div 50")).withColumn("pair", F.concat_ws(":", "rec_id", "attempt"))
    out = G.context_window(rows, ["video"], F.struct("rec_id", "attempt"), F.col("passed"), "pair", size=4)
    return out.select("video", "rec_id", "attempt", F.array_join("context", ",").alias("context"))


@query("SELECT doc_id, text, CASE WHEN trim(text) = '' THEN 'blank' WHEN length(text) > 2000 THEN 'too_long' WHEN lower(text) IN (SELECT lower(text) FROM benchmark) THEN 'direct' ELSE 'model' END AS route FROM documents")
def translation_routes(spark, sf_dir):
    """Direct dictionary, blank and too long sources."""
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "text")
    direct = B.table(spark, sf_dir, "benchmark").select(F.lower("text").alias("key"), F.col("text").alias("target"))
    return G.routed(docs, direct, "text", 2000).select("doc_id", "text", "route")


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def pending_work(spark, sf_dir):
    """Rows without a result yet."""
    done = B.table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return B.table(spark, sf_dir, "documents").select("doc_id").join(done, "doc_id", "left_anti")


@query(
    """WITH v AS (SELECT doc_id // 4 AS rec_id, lang AS variant, doc_id AS seq, text FROM documents)
    SELECT rec_id, coalesce(arg_min(text, seq) FILTER (WHERE rec_id % 2 = 0 AND variant = 'fr'), arg_min(text, seq) FILTER (WHERE variant = 'de'), arg_min(text, seq)) AS chosen FROM v GROUP BY rec_id"""
)
def chosen_variants(spark, sf_dir):
    """The selected variant, else the default, else the first; four documents are a record."""
    docs = B.table(spark, sf_dir, "documents").select(F.expr("doc_id div 4").alias("rec_id"), F.col("lang").alias("variant"), F.col("doc_id").alias("ins_seq"), "text")
    return G.chosen(docs, ["rec_id"], selected=F.when(F.col("rec_id") % 2 == 0, "fr"), default=F.lit("de")).select("rec_id", "chosen")


@query(
    "WITH " + _ATTEMPTS + """ SELECT rec_id, attempt, CASE WHEN attempt <= 1 THEN 'full' WHEN attempt <= 3 THEN 'compressed' WHEN attempt <= 5 THEN 'minimal' ELSE 'bare' END AS prompt_form FROM att"""
)
def prompt_ladder(spark, sf_dir):
    """The prompt's form by attempt."""
    return _attempts(spark, sf_dir).select("rec_id", "attempt", G.prompt_form(F.expr("attempt div 2")).alias("prompt_form"))


@query(
    r"""WITH c AS (SELECT video, pos, text, ws, CAST(sum(n) OVER (PARTITION BY video ORDER BY pos) AS BIGINT) AS total FROM (SELECT conv_id AS video, turn AS pos, text, length(text) AS n, 1 AS ws FROM conversations))
    SELECT video, min(pos) AS pos FROM c WHERE total >= 2000 GROUP BY video"""
)
def term_trigger(spark, sf_dir):
    """The first row at which 2000 characters are reached."""
    return G.term_trigger(B.turns(spark, sf_dir), ["video"])


@query("SELECT conv_id AS video, md5(substr(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE trim(text) <> ''), 1, 8000)) AS block_md5 FROM conversations GROUP BY conv_id")
def corpus_blocks(spark, sf_dir):
    """G07."""
    return G.corpus_block(B.turns(spark, sf_dir), ["video"]).select("video", F.md5("block").alias("block_md5"))


@query(
    r"""WITH RECURSIVE t AS (SELECT conv_id AS video, turn AS pos, text, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS w FROM conversations WHERE regexp_replace(text, '\s', '', 'g') <> ''),
    n AS (SELECT video, pos, text, CAST(CASE WHEN w > 1 THEN w ELSE greatest(1, length(text) // 2) END AS BIGINT) AS n, row_number() OVER (PARTITION BY video ORDER BY pos) AS k FROM t),
    f AS (SELECT video, pos, text, n, k, n AS s, 1 AS g FROM n WHERE k = 1 UNION ALL
      SELECT n.video, n.pos, n.text, n.n, n.k, CASE WHEN f.s >= 60 THEN n.n ELSE f.s + n.n END, CASE WHEN f.s >= 60 THEN f.g + 1 ELSE f.g END FROM f JOIN n ON n.video = f.video AND n.k = f.k + 1)
    SELECT video, CAST(g AS INTEGER) AS version, CAST(min(pos) AS BIGINT) AS first_pos, CAST(max(pos) AS BIGINT) AS last_pos, CAST(sum(n) AS BIGINT) AS words, md5(substr(string_agg(text, chr(10) ORDER BY pos), 1, 12000)) AS body_md5
    FROM f GROUP BY video, g HAVING sum(n) >= 60"""
)
def summary_windows(spark, sf_dir):
    """Texts gathered until the word budget is reached."""
    return G.summary_windows(B.turns(spark, sf_dir), ["video"], budget=60).select("video", "version", "first_pos", "last_pos", "words", F.md5("body").alias("body_md5"))


@query(
    """WITH s AS (SELECT conv_id AS video, turn AS pos, role AS speaker, text FROM conversations WHERE trim(text) <> '') SELECT printf('%d_%06d_%02d', video, pos, 0) AS stem, CASE speaker WHEN 'user' THEN 'alto' WHEN 'assistant' THEN 'bass' ELSE 'tenor' END AS voice FROM s"""
)
def speech_plan(spark, sf_dir):
    """Pieces to speak and their voices."""
    voices = spark.createDataFrame([("alto", "f", 0), ("bass", "m", 1), ("tenor", "m", 2)], "voice string, gender string, ord int")
    plan = spark.createDataFrame([("user", "alto", None), ("assistant", None, "m")], "speaker string, voice string, gender string")
    return G.with_voice(G.speech_pieces(B.turns(spark, sf_dir)), plan, voices, default="tenor").select("stem", "voice")


@query(
    r"""WITH p AS (SELECT conv_id AS rec_id, list(text ORDER BY turn) AS texts FROM conversations GROUP BY conv_id) SELECT rec_id, CAST(len(texts) AS INTEGER) AS n, md5(array_to_string(list_filter(string_split_regex(array_to_string(texts, ' '), '\s+'), lambda x: x <> ''), ' ')) AS whole_md5 FROM p"""
)
def aligned_translations(spark, sf_dir):
    """A record's translation is cut over its segments; joined again it is the same text."""
    rows = B.turns(spark, sf_dir).groupBy(F.col("video").alias("rec_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]).alias("segments"))
    out = G.aligned(rows.withColumn("translation", F.array_join("segments", " ")), "rec_id")
    return out.select("rec_id", F.size("pieces").alias("n"), F.md5(X.single_spaces(F.array_join(F.filter("pieces", lambda x: x != ""), " "))).alias("whole_md5"))


_RATIO = "((length(s[low + 1]) * length(r) + 1e-4) / (length(l) * length(s[high]) + 1e-7))"


@query(
    r"""WITH RECURSIVE w AS (SELECT conv_id AS rec_id, turn, array_to_string(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''), ' ') AS t FROM conversations),
    p AS (SELECT rec_id, list(t ORDER BY turn) AS s FROM w WHERE t <> '' GROUP BY rec_id),
    g AS (SELECT rec_id, s, 0 AS low, len(s) AS high, NULL::VARCHAR AS d FROM p UNION ALL
      SELECT rec_id, s, CASE WHEN side = 0 THEN low ELSE low + (high - low + 1) // 2 END, CASE WHEN side = 0 THEN low + (high - low + 1) // 2 ELSE high END, 'accept' FROM g, (SELECT unnest([0, 1]) AS side) WHERE high - low > 2),
    e AS (SELECT *, string_split(array_to_string(s[low + 1:high], ' '), ' ') AS ws, greatest(1, least(len(string_split(s[low + 1], ' ')) + rec_id % 4, len(string_split(array_to_string(s[low + 1:high], ' '), ' ')) - 1)) AS j FROM g WHERE high - low <= 2),
    c AS (SELECT *, array_to_string(ws[1:j], ' ') AS l, array_to_string(ws[j + 1:], ' ') AS r FROM e),
    f AS (SELECT *, CASE WHEN high - low = 2 AND least(length(s[low + 1]), length(s[high])) > 2 THEN greatest(@, 1 / @) END AS ratio FROM c),
    o AS (SELECT rec_id, low, CASE WHEN high - low = 1 THEN [s[high]] WHEN ratio < 1.5 THEN [l, r] ELSE [array_to_string(ws, ' '), ''] END AS ps, CASE WHEN ratio > 1.05 AND ratio < 1.5 THEN 2 ELSE 0 END AS re FROM f)
    SELECT rec_id, md5(array_to_string(flatten(list(ps ORDER BY low)), '|')) AS pieces_md5, CAST(sum(re) AS BIGINT) AS rearranged FROM o GROUP BY rec_id""".replace("@", _RATIO)
)
def bisected_translations(spark, sf_dir):
    """A record's translation cut over its segments as replies propose; some replies move words over the boundary, and are accepted, accepted for rearranging, or rejected."""
    one = F.array_join(X.white_split(F.col("text")), " ")
    rows = B.turns(spark, sf_dir).select(F.col("video").alias("rec_id"), "pos", one.alias("text")).where("text <> ''")
    rows = rows.groupBy("rec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]).alias("segments"))
    # replies: every group of a halving tree is cut in the middle, pairs with up to three words moved
    tree, level, depth = None, rows.select("rec_id", "segments", F.lit(0).alias("low"), F.size("segments").alias("high")), 0
    deepest = rows.agg(F.coalesce(F.max(F.size("segments")), F.lit(1))).first()[0]
    middle = F.col("low") + F.expr("(high - low + 1) div 2").cast("int")
    while 1 << depth < deepest:
        level = level.where("high - low > 1").withColumn("cut", middle)
        tree = level if tree is None else tree.unionByName(level)
        level = level.select("rec_id", "segments", F.explode(F.array(F.struct("low", F.col("cut").alias("high")), F.struct(F.col("cut").alias("low"), "high"))).alias("h")).select("rec_id", "segments", "h.low", "h.high")
        depth += 1
    tree = level.where("false").withColumn("cut", middle) if tree is None else tree
    words = F.split(F.array_join(F.slice("segments", F.col("low") + 1, F.col("high") - F.col("low")), " "), " ")
    left = F.size(F.split(F.array_join(F.slice("segments", F.col("low") + 1, F.col("cut") - F.col("low")), " "), " "))
    moved = F.when(F.col("high") - F.col("low") == 2, (F.col("rec_id") % 4).cast("int")).otherwise(0)
    tree = tree.select("rec_id", "low", "high", "cut", words.alias("ws"), (left + moved).alias("j")).withColumn("j", F.greatest(F.lit(1), F.least("j", F.size("ws") - 1)))
    replies = tree.select("rec_id", "low", "high", "cut", F.lit(0).alias("attempt"), F.array_join(F.slice("ws", F.lit(1), F.col("j")), " ").alias("left"), F.array_join(F.slice("ws", F.col("j") + 1, F.size("ws")), " ").alias("right"))
    groups = G.bisected_groups(rows.withColumn("translation", F.array_join("segments", " ")), replies, ["rec_id"], 1.05, 1.5)
    return G.pieces_of(groups, ["rec_id"]).select("rec_id", F.md5(F.array_join("pieces", "|")).alias("pieces_md5"), "rearranged")


# --- structuring functions over texts ---


@query()
def clause_chunks(spark, sf_dir):
    """Clauses, connectives, cascades; every form gives the text back."""
    t = F.col("text")
    rows = _turns(spark, sf_dir).select("conv_id", "turn", "text")
    rows = rows.select(
        "*", S.split_clauses(t, merge_under=60).alias("clauses"), S.split_sentences(t).alias("sents"), S.split_by_length(t, 90).alias("chunks"), S.at_connectives(t).alias("connected"),
        S.gated_chunks(t, S.split_clauses(t), 90).alias("gated"),
    )
    cascaded = S.cascade(rows.select("conv_id", "turn", "text"), "text", 90, [S.split_sentences, S.split_clauses, lambda c: S.split_by_length(c, 90)])
    cascaded = cascaded.groupBy("conv_id", "turn").agg(F.transform(F.array_sort(F.collect_list(F.struct("path", "chunk"))), lambda s: s["chunk"]).alias("cascaded"))
    halved = S.bisected(rows.select("conv_id", "turn", "text"), "text", 90, S.halves).groupBy("conv_id", "turn").agg(F.count("*").alias("n_halves"))
    out = rows.join(cascaded, ["conv_id", "turn"]).join(halved, ["conv_id", "turn"])
    forms = ("clauses", "sents", "chunks", "connected", "gated", "cascaded")
    ok = F.lit(True)
    for c in forms:
        ok = ok & X.rebuilds(F.col(c), X.normalize_spacing(t))
    return out.select("conv_id", "turn", *[F.size(c).alias(f"n_{c}") for c in forms], "n_halves", ok.alias("rebuilt"))


@query(
    """WITH r AS (SELECT conv_id AS video, turn AS pos, role AS speaker, text, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
    g AS (SELECT *, sum(CASE WHEN k > 1 AND speaker IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY video ORDER BY pos) AS run FROM r)
    SELECT video, CAST(run AS BIGINT) AS run, min(speaker) AS speaker, count(*) AS turns, min(pos) AS first_pos FROM g GROUP BY video, run"""
)
def speaker_runs(spark, sf_dir):
    """Q02, U21."""
    runs = S.speaker_runs(B.turns(spark, sf_dir), ["video"])
    return runs.groupBy("video", F.col("run").cast("long").alias("run")).agg(F.min("speaker").alias("speaker"), F.count("*").alias("turns"), F.min("pos").alias("first_pos"))


_RECORD_TOKENS = cue_queries._TOKENS.format(x="text")


@query(
    "WITH RECURSIVE k AS (SELECT conv_id AS video, turn AS pos, unnest(" + _RECORD_TOKENS + ") AS token, generate_subscripts(" + _RECORD_TOKENS + ", 1) AS j, 'en' AS lang FROM conversations)"
    + r""", c AS (SELECT *, regexp_replace(token, '["”''’」』]+$', '') AS core, regexp_matches(token, '^["”''’」』]+$') AS lone FROM k)"""
    + ", e AS (SELECT *, CASE WHEN NOT lone THEN " + cue_queries._ends_sql("core", "lang") + " END AS fin FROM c)"
    + """, b AS (SELECT *, coalesce(last_value(fin IGNORE NULLS) OVER (PARTITION BY video ORDER BY pos, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AND NOT lone AS fresh FROM e),
    s AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY video ORDER BY pos, j) AS sent FROM b),
    r AS (SELECT video, CAST(sent AS BIGINT) AS pos, string_agg(token, ' ' ORDER BY pos, j) AS t, min(pos) * 2.0 AS a, max(pos) * 2.0 + 1.5 AS z, row_number() OVER (PARTITION BY video ORDER BY sent) AS k FROM s GROUP BY video, sent),
    f AS (SELECT *, length(t) AS n, 1 AS g FROM r WHERE k = 1 UNION ALL
      SELECT r.*, CASE WHEN f.n + 1 + length(r.t) <= 120 THEN f.n + 1 + length(r.t) ELSE length(r.t) END, CASE WHEN f.n + 1 + length(r.t) <= 120 THEN f.g ELSE f.g + 1 END FROM f JOIN r ON r.video = f.video AND r.k = f.k + 1)
    SELECT video, min(pos) AS pos, md5(string_agg(t, ' ' ORDER BY pos)) AS text_md5, CAST(min(a) AS DOUBLE) AS "start", CAST(arg_max(z, pos) AS DOUBLE) AS "end" FROM f GROUP BY video, g"""
)
def merged_records(spark, sf_dir):
    """Q12, Q16: sentences as records, neighbours merged up to 120 characters."""
    rows = B.turns(spark, sf_dir).withColumns({"start": F.col("pos") * 2.0, "end": F.col("pos") * 2.0 + 1.5})
    tokens = S.token_rows(rows, ["video"])
    recs = S.records(S.with_groups(tokens, ["video"], S.ends_sentence(F.col("token"))), ["video"])
    recs = recs.select("video", F.col("sent_id").cast("long").alias("pos"), "src_text", "start", "end")
    return S.merged_records(recs, ["video"], 120).select("video", "pos", F.md5("src_text").alias("text_md5"), "start", "end")


@query(
    """WITH p AS (SELECT conv_id AS video, list(text ORDER BY turn) AS ts FROM conversations GROUP BY conv_id),
    s AS (SELECT video, ts, unnest(range(1, len(ts))) AS i FROM p WHERE len(ts) > 2),
    q AS (SELECT video, i, (CASE WHEN regexp_matches(regexp_replace(ts[i], '\\s+$', ''), '[.!?,;:—]$') THEN 1 ELSE 1000000000 END) * abs(2 * list_sum(list_transform(ts[1:i], lambda x: length(x))) - list_sum(list_transform(ts, lambda x: length(x)))) AS score FROM s)
    SELECT video, string_agg(i, ',' ORDER BY score, i) AS candidates FROM q GROUP BY video UNION ALL SELECT video, '1' FROM p WHERE len(ts) <= 2""".replace("\\\\", "\\")
)
def split_candidates(spark, sf_dir):
    """Boundaries by balance."""
    rows = B.turns(spark, sf_dir).groupBy("video").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]).alias("ts"))
    return rows.select("video", F.array_join(X.split_candidates(F.col("ts")).cast("array<string>"), ",").alias("candidates"))
