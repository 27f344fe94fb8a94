"""Queries over ledgers, state and files, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueforge.functions import text as X
from cueforge.operators import ledger as U
from cueforge.operators import reports as R
from cueforge.operators import state as D
from cueforge.operators import words as W
from cueforge.sources import bindings as B
from cueforge.sources import files as S

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


@query(
    "WITH " + B.USAGE_SQL + """ SELECT user_id, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, round(sum(cost_usd), 3) AS cost_usd, CAST(sum(requests) AS BIGINT) AS requests,
    CASE WHEN min(nullif(model, '')) = max(nullif(model, '')) THEN max(nullif(model, '')) ELSE '' END AS model FROM usage GROUP BY user_id"""
)
def usage_totals(spark, sf_dir):
    """U01."""
    return U.usage_sum(B.usage(spark, sf_dir), ["user_id"]).withColumn("cost_usd", F.round("cost_usd", 3))


_LEDGER = B.USAGE_SQL + """, ev AS (SELECT *, CAST(ts AS DATE) AS day FROM usage WHERE cost_usd IS NOT NULL OR prompt_tokens + completion_tokens > 0),
 lg AS (SELECT user_id, day, sum(prompt_tokens) AS p, sum(completion_tokens) AS c, sum(cost_usd) AS cost, sum(requests) AS r FROM ev GROUP BY 1, 2)"""


@query("WITH " + _LEDGER + " SELECT user_id, CAST(day AS VARCHAR) AS day, CAST(p AS BIGINT) AS prompt_tokens, CAST(c AS BIGINT) AS completion_tokens, round(cost, 3) AS cost_usd, CAST(r AS BIGINT) AS requests FROM lg")
def daily_ledger(spark, sf_dir):
    """U02."""
    out = U.daily_ledger(B.usage(spark, sf_dir))
    return out.select("user_id", F.col("day").cast("string").alias("day"), "prompt_tokens", "completion_tokens", F.round("cost_usd", 3).alias("cost_usd"), "requests")


@query(
    "WITH " + _LEDGER + """ SELECT 'all' AS model, count(DISTINCT user_id) AS users, round(sum(cost), 2) AS cost_usd FROM lg UNION ALL
    SELECT model, count(DISTINCT user_id), round(sum(cost_usd), 2) FROM ev WHERE cost_usd IS NOT NULL AND model <> '' GROUP BY model"""
)
def usage_summary(spark, sf_dir):
    """U03."""
    out = U.usage_summary(U.daily_ledger(B.usage(spark, sf_dir)))
    return out.select(F.coalesce("model", F.lit("all")).alias("model"), "users", F.round("cost_usd", 2).alias("cost_usd"))


@query("WITH " + _LEDGER + " SELECT user_id, round(sum(cost), 3) AS cost_usd, CAST(sum(r) AS BIGINT) AS requests FROM lg GROUP BY user_id ORDER BY sum(cost) DESC NULLS LAST, user_id LIMIT 10")
def top_users(spark, sf_dir):
    """A top-k report."""
    return U.top_users(U.daily_ledger(B.usage(spark, sf_dir))).withColumn("cost_usd", F.round("cost_usd", 3))


@query(
    "WITH " + B.USAGE_SQL + """, s AS (SELECT event_id, user_id % 3 AS tier, user_id % 17 = 0 AS byok, sum(greatest(coalesce(cost_usd, 0), 0)) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS p FROM usage)
    SELECT event_id, CASE WHEN byok OR tier = 2 THEN 'ok' WHEN p >= CASE tier WHEN 0 THEN 50 ELSE 200 END THEN 'deny' WHEN p >= 0.8 * CASE tier WHEN 0 THEN 50 ELSE 200 END THEN 'soft_warn' ELSE 'ok' END AS decision FROM s"""
)
def budget_decisions(spark, sf_dir):
    """U05."""
    tiers = spark.createDataFrame([(0, 50.0), (1, 200.0), (2, None)], "tier long, daily_usd double")
    rows = B.usage(spark, sf_dir).withColumns({"tier": F.col("user_id") % 3, "byok": F.col("user_id") % 17 == 0})
    return U.budget_decisions(rows, tiers).select("event_id", "decision")


@query(
    """SELECT user_id % 20 AS tenant, CAST(count_if(event_type = 'view') AS BIGINT) AS submitted, CAST(count_if(event_type = 'click') AS BIGINT) AS granted, CAST(count_if(event_type = 'purchase') AS BIGINT) AS rejected,
    round(coalesce(sum(value) FILTER (WHERE event_type = 'click'), 0), 3) AS wait_sum, CAST(greatest(count_if(event_type = 'click') - count_if(event_type NOT IN ('view', 'click', 'purchase')), 0) AS BIGINT) AS active FROM events GROUP BY 1"""
)
def admissions(spark, sf_dir):
    """U16."""
    name = F.when(F.col("event_type") == "view", "submitted").when(F.col("event_type") == "click", "granted").when(F.col("event_type") == "purchase", "rejected").otherwise("released")
    log = B.table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("tenant"), name.alias("event"), F.col("value").alias("waited"))
    return U.admissions(log).withColumn("wait_sum", F.round("wait_sum", 3))


@query("SELECT event_type, count(*) AS n, round(sum(value), 3) AS total, CAST(count_if(value <= 1.0) AS BIGINT) AS le_1_0, CAST(count_if(value <= 10.0) AS BIGINT) AS le_10_0, CAST(count_if(value <= 100.0) AS BIGINT) AS le_100_0 FROM events GROUP BY event_type")
def metric_counters(spark, sf_dir):
    """U17."""
    return U.counters(B.table(spark, sf_dir, "events"), ["event_type"], "value", [1.0, 10.0, 100.0]).withColumn("total", F.round("total", 3))


@query("SELECT event_id, event_type, user_id FROM events WHERE event_type = 'error' OR value > 50 ORDER BY ts DESC, event_id DESC LIMIT 25")
def last_errors(spark, sf_dir):
    """A last-n report."""
    rows = B.table(spark, sf_dir, "events").where("event_type = 'error' or value > 50")
    return U.last_n(rows, 25, F.desc("ts"), F.desc("event_id")).select("event_id", "event_type", "user_id")


@query("SELECT user_id, arg_max(event_id, CAST(epoch_us(ts) AS HUGEINT) * 1000000 + event_id) AS last_event, count(*) AS seen FROM events GROUP BY user_id")
def channel_snapshots(spark, sf_dir):
    """U19."""
    e = B.table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return U.latest(e, "user_id", "at", "event_id").select("user_id", F.col("event_id").alias("last_event"), "seen")


@query("SELECT user_id % 50 AS processor, CAST(count_if(event_id % 4 > 1) AS BIGINT) AS done, CAST(count_if(event_id % 4 = 1) AS BIGINT) AS cache_hits, CAST(count_if(event_id % 4 = 0) AS BIGINT) AS failures, round(avg(value) FILTER (WHERE event_id % 4 > 1), 6) AS avg_duration FROM events GROUP BY 1")
def progress(spark, sf_dir):
    """U20."""
    k = F.col("event_id") % 4
    rows = B.table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("processor"), F.when(k > 1, "done").when(k == 1, "cached").otherwise("failed").alias("status"), F.col("value").alias("duration"))
    return U.progress(rows, "processor").withColumn("avg_duration", F.round("avg_duration", 6))


@query("WITH f AS (SELECT conv_id, role, min(turn) AS o FROM conversations GROUP BY 1, 2) SELECT conv_id AS video, string_agg(role, ',' ORDER BY o, role) AS speakers FROM f GROUP BY conv_id")
def speakers(spark, sf_dir):
    """U21."""
    return U.first_seen(B.turns(spark, sf_dir), ["video"], "speaker").select("video", F.array_join("speakers", ",").alias("speakers"))


@query(
    """WITH p AS (SELECT user_id, event_id, event_type FROM events), s AS (SELECT c_custkey AS user_id, -1 AS event_id, 'stored' AS event_type FROM customer)
    SELECT user_id, arg_max(event_type, event_id) AS status FROM (SELECT * FROM p UNION ALL SELECT * FROM s) GROUP BY user_id"""
)
def patched_records(spark, sf_dir):
    """A snapshot with the patches of a change log."""
    snapshot = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("user_id"), F.lit("stored").alias("status"))
    log = B.table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("status"), F.col("event_id").alias("seq"))
    return D.patched(snapshot, log, ["user_id"])


@query(
    """WITH t AS (SELECT doc_id // 6 AS rec_id, lang, 'v' || doc_id % 3 AS variant, doc_id, doc_id % 2 AS mem FROM documents),
    m AS (SELECT rec_id, lang, variant, arg_max(doc_id, mem * 1000000000 + doc_id) AS doc FROM t GROUP BY ALL) SELECT rec_id, lang, variant, doc FROM m WHERE rec_id IN (SELECT rec_id FROM t WHERE mem = 1)"""
)
def hydrated_records(spark, sf_dir):
    """Translations in memory over stored ones."""
    t = B.table(spark, sf_dir, "documents").select(F.expr("doc_id div 6").alias("rec_id"), "lang", F.concat(F.lit("v"), (F.col("doc_id") % 3).cast("string")).alias("variant"), "doc_id", (F.col("doc_id") % 2).alias("mem"))

    def side(k):
        by = t.where(F.col("mem") == k).groupBy("rec_id", "lang", "variant").agg(F.max("doc_id").cast("string").alias("d"))
        by = by.groupBy("rec_id", "lang").agg(F.map_from_entries(F.collect_list(F.struct("variant", "d"))).alias("m"))
        return by.groupBy("rec_id").agg(F.map_from_entries(F.collect_list(F.struct("lang", "m"))).alias("translations"))

    out = D.hydrated(side(1), side(0), ["rec_id"])
    out = out.select("rec_id", F.explode("translations").alias("lang", "m")).select("rec_id", "lang", F.explode("m").alias("variant", "doc"))
    return out.withColumn("doc", F.col("doc").cast("long"))


@query(
    """WITH s AS (SELECT doc_id AS video, step, ord, CASE WHEN doc_id % 7 = ord THEN NULL ELSE substr(sha256(source || step), 1, 8) END AS old, substr(sha256(CASE WHEN doc_id % 11 = ord THEN 'new' ELSE source END || step), 1, 8) AS now
      FROM documents, (VALUES ('raw', 1), ('preprocess.punc', 2), ('preprocess.chunk', 3), ('translate', 4), ('tts', 5)) v(step, ord))
    SELECT video, step, max(CASE WHEN old IS NULL OR old <> now THEN 1 ELSE 0 END) OVER (PARTITION BY video ORDER BY ord) = 1 AS stale FROM s"""
)
def stale_steps(spark, sf_dir):
    """Steps of videos from the first whose fingerprint differs."""
    docs = B.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video"), "source", F.posexplode(F.array(*[F.lit(s) for s in D.STEPS])).alias("k", "step"))
    value = lambda c: X.short_hash(F.concat(c, F.col("step")))
    now = docs.select("video", "step", value(F.when(F.col("video") % 11 == F.col("k") + 1, "new").otherwise(F.col("source"))).alias("value"))
    old = docs.where(F.col("video") % 7 != F.col("k") + 1).select("video", "step", value(F.col("source")).alias("value"))
    return D.stale_steps(now, old, ["video"])


@query(
    "WITH st AS (" + ORACLE["stale_steps"] + ") SELECT d.doc_id AS video, v.step FROM documents d, (VALUES ('translate'), ('tts')) v(step) WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.video = d.doc_id AND st.step = v.step AND st.stale)"
)
def valid_outputs(spark, sf_dir):
    """Outputs whose step isn't stale."""
    outputs = B.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video"), F.explode(F.array(F.lit("translate"), F.lit("tts"))).alias("step"))
    return D.invalidated(outputs, stale_steps(spark, sf_dir), ["video"])


@query("SELECT d.doc_id, min(b.doc_id) AS first_doc FROM documents d JOIN documents b ON d.text = b.text WHERE b.source = 'src0' GROUP BY d.doc_id")
def cache_hits(spark, sf_dir):
    """Texts that a cache of one source's texts holds."""
    docs = B.table(spark, sf_dir, "documents")
    cache = docs.where("source = 'src0'").groupBy("text").agg(F.min("doc_id").alias("first_doc"))
    return D.cached(docs.select("doc_id", "text"), cache)[0].select("doc_id", "first_doc")


@query("SELECT d.doc_id AS course, CAST(coalesce(count(c.conv_id), 0) AS BIGINT) AS n_records, coalesce(md5(string_agg(c.turn || c.role, ',' ORDER BY c.turn)), md5('')) AS digest FROM documents d LEFT JOIN conversations c ON c.conv_id = d.doc_id GROUP BY d.doc_id")
def documents_by_key(spark, sf_dir):
    """Documents by key, empty where there are no rows."""
    wanted = B.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("course"))
    rows = B.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("course"), "turn", "role")
    out = D.document(wanted, rows, ["course"])
    return out.select("course", F.size("records").cast("long").alias("n_records"), F.md5(F.array_join(F.transform("records", lambda r: F.concat(r["turn"].cast("string"), r["role"])), ",")).alias("digest"))


@query("SELECT doc_id, 2 AS schema_version FROM documents WHERE doc_id % 5 < 3")
def upgraded_documents(spark, sf_dir):
    """S24."""
    docs = B.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 > 0, (F.col("doc_id") % 5).cast("int")).alias("schema_version"))
    return D.upgraded(docs)[0].select("doc_id", "schema_version")


# --- files ---


@query(
    r"""WITH t AS (SELECT conv_id AS video, turn, role, text, turn * 2.0 AS s, turn * 2.0 + 1.5 AS e, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM conversations),
    w AS (SELECT video, turn, role, s, e, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM t)
    SELECT video, row_number() OVER (PARTITION BY video ORDER BY turn, i) - 1 AS pos, word, round(s + (e - s) / n * i + 1e-7, 5) AS "start", round(CASE WHEN i = n - 1 THEN e ELSE s + (e - s) / n * (i + 1) END + 1e-7, 5) AS "end", role AS speaker FROM w"""
)
def asr_words(spark, sf_dir):
    """Conversations as recognition dumps without words, read as words."""
    turns = B.turns(spark, sf_dir).select("video", "pos", F.struct((F.col("pos") * 2.0).alias("start"), (F.col("pos") * 2.0 + 1.5).alias("end"), "text", "speaker").alias("s"))
    docs = turns.groupBy("video").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias("segments"))).alias("content"))
    out = W.usable(S.asr_words(docs))
    return out.select("video", "pos", "word", F.round(F.col("start") + 1e-7, 5).alias("start"), F.round(F.col("end") + 1e-7, 5).alias("end"), "speaker")


@query(
    """WITH o AS (SELECT conv_id, role, min(turn) AS o FROM conversations GROUP BY 1, 2), s AS (SELECT conv_id, string_agg(role, ',' ORDER BY o) AS speakers FROM o GROUP BY 1)
    SELECT c.conv_id AS video, count(*) AS n, CAST(max(turn) * 2.0 + 1.5 - min(turn) * 2.0 AS DOUBLE) AS duration, any_value(s.speakers) AS speakers, sha256(string_agg(text, chr(10) ORDER BY turn)) AS sha256 FROM conversations c JOIN s ON s.conv_id = c.conv_id GROUP BY c.conv_id"""
)
def manifests(spark, sf_dir):
    """S18."""
    rows = B.turns(spark, sf_dir).withColumns({"start": F.col("pos") * 2.0, "end": F.col("pos") * 2.0 + 1.5})
    return S.manifest(rows, ["video"]).withColumn("speakers", F.array_join("speakers", ","))


@query(
    r"""WITH p AS (SELECT page_id, '/ws/' || CASE page_id % 3 WHEN 0 THEN 'subs' WHEN 1 THEN 'audio' ELSE 'json' END || '/' || regexp_extract(url, '//([^/]*)', 1) || ' [' || page_id || '].' || CASE page_id % 2 WHEN 0 THEN 'en' ELSE 'fr' END || CASE page_id % 3 WHEN 0 THEN '.srt' WHEN 1 THEN '.mp3' ELSE '.json' END AS path, url FROM pages)
    SELECT path, CASE page_id % 3 WHEN 0 THEN 'subs' WHEN 1 THEN 'audio' ELSE 'json' END AS folder, CAST(page_id AS VARCHAR) AS ident, CASE page_id % 2 WHEN 0 THEN 'en' ELSE 'fr' END AS lang_tail, regexp_extract(url, '//([^/]*)', 1) AS "key", CASE page_id % 3 WHEN 0 THEN 'srt' WHEN 1 THEN 'audio' ELSE 'whisperx' END AS kind FROM p"""
)
def workspace_files(spark, sf_dir):
    """What the names of files tell."""
    k, lang = F.col("page_id") % 3, F.when(F.col("page_id") % 2 == 0, "en").otherwise("fr")
    folder = F.when(k == 0, "subs").when(k == 1, "audio").otherwise("json")
    tail = F.when(k == 0, ".srt").when(k == 1, ".mp3").otherwise(".json")
    path = F.concat(F.lit("/ws/"), folder, F.lit("/"), F.regexp_extract("url", "//([^/]*)", 1), F.lit(" ["), F.col("page_id").cast("string"), F.lit("]."), lang, tail)
    files = B.table(spark, sf_dir, "pages").select(path.alias("path"))
    return S.workspace_keys(files).select("path", "folder", "ident", "lang_tail", "key", S.source_kind(F.col("path")).alias("kind"))


@query(
    "WITH f AS (" + ORACLE["workspace_files"] + """), k AS (SELECT "key", min(path) AS p FROM f GROUP BY 1)
    SELECT page_id, coalesce(i.path, k.p) AS path FROM pages g LEFT JOIN f i ON i.ident = CAST(g.page_id + 1 AS VARCHAR) LEFT JOIN k ON k."key" = regexp_extract(g.url, '//([^/]*)', 1)"""
)
def resolved_files(spark, sf_dir):
    """Files by id, else by key."""
    wanted = B.table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") + 1).cast("string").alias("ident"), F.regexp_extract("url", "//([^/]*)", 1).alias("key"))
    return S.resolved(wanted, workspace_files(spark, sf_dir)).select("page_id", "path")


@query("WITH f AS (" + ORACLE["workspace_files"] + """) SELECT "key", min(path) FILTER (WHERE folder = 'subs') AS subs, min(path) FILTER (WHERE folder = 'audio') AS audio, min(path) FILTER (WHERE folder = 'json') AS json FROM f GROUP BY 1""")
def artifact_map(spark, sf_dir):
    """S14."""
    return S.artifact_map(workspace_files(spark, sf_dir), ["subs", "audio", "json"])


@query(
    """SELECT page_id AS id, CASE WHEN page_id % 3 = 0 THEN 'youtube' WHEN page_id % 3 = 1 THEN 'vimeo' ELSE 'unknown' END AS platform, CASE WHEN page_id % 2 = 0 THEN 'de,en' ELSE 'en' END AS languages FROM pages"""
)
def media_info(spark, sf_dir):
    """Stored media dumps."""
    i = F.col("page_id")
    url = F.when(i % 3 == 0, "https://www.youtube.com/watch?v=1").otherwise(F.col("url"))
    doc = F.to_json(
        F.struct(
            i.cast("string").alias("id"), F.lit("t").alias("title"), F.when(i % 3 == 1, "Vimeo").alias("extractor"), url.alias("webpage_url"), F.create_map(F.lit("en"), F.lit("x")).alias("subtitles"),
            F.when(i % 2 == 0, F.create_map(F.lit("de"), F.lit("y"))).alias("automatic_captions"),
        )
    )
    out = S.media_info(B.table(spark, sf_dir, "pages").select(doc.alias("content")))
    return out.select(F.col("id").cast("long").alias("id"), "platform", F.array_join("languages", ",").alias("languages"))


@query(
    """SELECT conv_id AS video, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, turn * 2000 AS start_ms, turn * 2000 + 1500 AS end_ms, md5(text) AS text_md5 FROM conversations WHERE trim(text) <> ''"""
)
def exported_cues(spark, sf_dir):
    """Translated records as cues."""
    seg = F.array(F.struct((F.col("pos") * 2.0).alias("start"), (F.col("pos") * 2.0 + 1.5).alias("end")))
    m = lambda v: F.create_map(F.lit("fr"), v)
    rows = B.turns(spark, sf_dir).select(
        "video", F.col("pos").alias("rec_id"), seg.alias("segments"), m(F.create_map(F.lit("a"), F.lit("other"), F.lit("b"), F.col("text"))).alias("translations"), m(F.lit("b")).alias("selected"), m(F.array(F.col("text"))).alias("alignment"),
    )
    out = S.export_cues(rows, "fr", ["video"])
    return out.select("video", F.col("pos").cast("long").alias("pos"), "start_ms", "end_ms", F.md5("text").alias("text_md5"))


@query("SELECT source AS course, count(*) AS n FROM documents GROUP BY source")
def migration_counts(spark, sf_dir):
    """A dry run."""
    return S.migrated(B.table(spark, sf_dir, "documents").withColumnRenamed("source", "course"))


@query("SELECT url, array_to_string(list_transform(regexp_extract_all(lower(url), '(\\d+|\\D+)'), lambda p: CASE WHEN regexp_matches(p, '^\\d') THEN lpad(p, 20, '0') ELSE p END), '') AS sort_key FROM pages".replace("\\\\", "\\"))
def natural_order(spark, sf_dir):
    """O2: keys for natural order."""
    return B.table(spark, sf_dir, "pages").select("url", X.natural_key(F.col("url")).alias("sort_key"))


@query("WITH s AS (SELECT conv_id AS video, turn + (conv_id % 3) * (turn // 2) AS seq FROM conversations), g AS (SELECT video, seq, seq - lag(seq) OVER (PARTITION BY video ORDER BY seq) - 1 AS m FROM s) SELECT video, seq, CAST(greatest(coalesce(m, 0), 0) AS BIGINT) AS missing FROM g")
def sequence_gaps(spark, sf_dir):
    """Two videos of three skip numbers after every other turn."""
    rows = B.turns(spark, sf_dir).withColumn("seq", F.expr("pos + (video % 3) * (pos div 2)"))
    return W.gaps(rows, ["video"]).select("video", "seq", F.col("missing").cast("long").alias("missing"))


_PATHS = """CASE event_id % 7 WHEN 0 THEN ['translations'] WHEN 1 THEN ['translations', 'fr'] WHEN 2 THEN ['translations', 'fr', 'a.b'] WHEN 3 THEN ['translations', 'de'] WHEN 4 THEN ['errors', event_type] WHEN 5 THEN ['errors'] ELSE ['log'] END"""


def _path_log(spark, sf_dir):
    """Events as writes to places of their user's document, to places within one another."""
    kinds = [["translations"], ["translations", "fr"], ["translations", "fr", "a.b"], ["translations", "de"], ["errors"], ["errors"], ["log"]]
    path = F.element_at(F.array(*[F.array(*map(F.lit, k)) for k in kinds]), (F.col("event_id") % 7 + 1).cast("int"))
    path = F.when(F.col("event_id") % 7 == 4, F.array(F.lit("errors"), F.col("event_type"))).otherwise(path)
    op = F.when(F.col("event_id") % 7 == 6, "append").when(F.col("event_id") % 35 == 5, "drop").otherwise("set")
    e = B.table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("doc"), F.col("event_id").alias("seq"), "event_type", op.alias("op"), path.alias("path"))
    return e.select("doc", "seq", "op", "path", F.when(F.col("op") != "drop", F.concat(F.lit('"'), "event_type", F.lit('"'))).alias("value"))


@query(
    "WITH w AS (SELECT user_id AS doc, event_id AS seq, CASE WHEN event_id % 7 = 6 THEN 'append' WHEN event_id % 35 = 5 THEN 'drop' ELSE 'set' END AS op, " + _PATHS + """ AS path, '"' || event_type || '"' AS value FROM events),
    l AS (SELECT * FROM w a WHERE op <> 'drop' AND NOT EXISTS (SELECT 1 FROM w b WHERE b.doc = a.doc AND b.seq > a.seq AND (
      (len(b.path) < len(a.path) AND a.path[1:len(b.path)] = b.path) OR (a.path = b.path AND (b.op <> 'append' OR a.op = 'set')) OR (b.op <> 'drop' AND len(b.path) > len(a.path) AND b.path[1:len(a.path)] = a.path)))),
    g AS (SELECT doc, path, CASE WHEN op = 'append' THEN '[' || string_agg(value, ',' ORDER BY seq) || ']' ELSE min(value) END AS value FROM l GROUP BY doc, path, op)
    SELECT doc, array_to_string(path, '/') AS path, value FROM g"""
)
def patched_places(spark, sf_dir):
    """A log of writes to places within one another."""
    return D.patched_paths(_path_log(spark, sf_dir), ["doc"]).select("doc", F.array_join("path", "/").alias("path"), "value")


@query(
    """WITH r AS (SELECT user_id, event_id AS seq, event_id % 3 AS priority, epoch(ts) AS t FROM events), s AS (SELECT user_id, event_id AS seek_id, epoch(ts) + 100 AS p FROM events WHERE event_id % 50 = 0),
    o AS (SELECT s.user_id, seek_id, seq, row_number() OVER (PARTITION BY s.user_id, seek_id ORDER BY priority, abs(t - p), seq) AS place FROM s JOIN r ON s.user_id = r.user_id)
    SELECT user_id, seek_id, seq, place FROM o WHERE place <= 5"""
)
def seek_orders(spark, sf_dir):
    """O3: the five rows that come first after each of many seeks."""
    e = B.table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    rows = e.select("user_id", (F.col("event_id") % 3).alias("priority"), (F.col("us") / 1e6).alias("start"), F.col("event_id").alias("seq"))
    seeks = e.where("event_id % 50 = 0").select("user_id", F.col("event_id").alias("seek_id"), (F.col("us") / 1e6 + 100).alias("at"))
    return R.seek_order(rows, seeks, ["user_id"], 5).select("user_id", "seek_id", "seq", F.col("place").cast("long").alias("place"))
