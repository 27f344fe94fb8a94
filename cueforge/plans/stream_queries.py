"""Queries that run streams over the given tables to their end, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cueforge.plans import cue_queries, quality_queries, state_queries
from cueforge.sources import bindings as B
from cueforge.sources.shared import written
from cueforge.streaming import streams as V

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def _fed(spark, rows, name):
    """A table as a feed of files."""
    path = V.folder(spark, name)
    rows.write.parquet(path)
    return V.source(spark, path, rows.schema, per_trigger=1000)


def _fed_in_order(spark, rows, name, order="pos"):
    """A table as a feed of several micro-batches, by the place of a row in its video.

    The rows are computed once. Each batch is as many files as there are shuffle partitions, with a video's rows in one of them, so that a micro-batch that takes files of two keeps
    every video's order.
    """
    path, files = V.folder(spark, name), int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = written(rows, name + "-rows")
    for low, high in ((0, 4), (4, 16), (16, 64), (64, None)):
        part = rows.where(F.col(order) >= low)
        (part if high is None else part.where(F.col(order) < high)).repartition(files, "video").write.mode("append").parquet(path)
    return V.source(spark, path, rows.schema, per_trigger=files)


def _groups(spark):
    """Groups of videos: some in each partition, so that one is small however large the table."""
    return 64 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def _segments(spark, sf_dir):
    w = Window.partitionBy("video")
    rows = B.turns(spark, sf_dir).withColumn("last", F.max("pos").over(w) == F.col("pos"))
    return rows.select("video", F.col("pos").cast("long").alias("seq"), (F.col("pos") * 2.0).alias("start"), (F.col("pos") * 2.0 + 1.5).alias("end"), "text", "speaker", "last")


_TURN_TOKENS = cue_queries._TOKENS.format(x="text")


@query(
    "WITH k AS (SELECT conv_id AS video, turn AS pos, role AS speaker, unnest(" + _TURN_TOKENS + ") AS token, generate_subscripts(" + _TURN_TOKENS + ", 1) AS j, 'en' AS lang FROM conversations)"
    + r""", c AS (SELECT *, regexp_replace(token, '["”''’」』]+$', '') AS core, regexp_matches(token, '^["”''’」』]+$') AS lone, lag(speaker) OVER (PARTITION BY video ORDER BY pos, j) AS prev FROM k)"""
    + ", e AS (SELECT *, CASE WHEN NOT lone THEN " + cue_queries._ends_sql("core", "lang") + " END AS fin FROM c)"
    + """, b AS (SELECT *, (prev IS NOT NULL AND prev <> speaker) OR (coalesce(last_value(fin IGNORE NULLS) OVER (PARTITION BY video ORDER BY pos, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AND NOT lone) AS fresh FROM e),
    s AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY video ORDER BY pos, j) AS rec_id FROM b)
    SELECT video, CAST(rec_id AS BIGINT) AS rec_id, CAST(min(pos) * 2.0 AS DOUBLE) AS "start", CAST(max(pos) * 2.0 + 1.5 AS DOUBLE) AS "end", md5(string_agg(token, ' ' ORDER BY pos, j)) AS text_md5, min(speaker) AS speaker FROM s GROUP BY video, rec_id"""
)
def stream_sentences(spark, sf_dir):
    """V01, V03, V04."""
    out = V.drained(V.sentences(_fed_in_order(spark, _segments(spark, sf_dir), "segments", "seq"), groups=_groups(spark)), "sentences")
    return out.select("video", "rec_id", "start", "end", F.md5("text").alias("text_md5"), "speaker")


@query("SELECT video, pos, start_ms, end_ms, note FROM (" + cue_queries.ORACLE["cue_times"] + ")")
def stream_cue_times(spark, sf_dir):
    """Stream and batch give the same."""
    rows = cue_queries._timed(spark, sf_dir).withColumn("last", F.max("pos").over(Window.partitionBy("video")) == F.col("pos"))
    fed = _fed_in_order(spark, rows.select("video", "pos", "start_ms", "end_ms", "text", "last"), "cues")
    return V.by_batch(V.settled_cues(fed, clean=False, groups=_groups(spark)), "settled", V.repaired).select("video", "pos", "start_ms", "end_ms", "note")


@query()
def stream_clean_cues(spark, sf_dir):
    """The text rules and all time rules on cues that come in several micro-batches."""
    rows = cue_queries._repairable(spark, sf_dir).withColumn("last", F.max("pos").over(Window.partitionBy("video")) == F.col("pos"))
    fed = _fed_in_order(spark, rows.select("video", "pos", "start_ms", "end_ms", "text", "last"), "cues")
    out = V.by_batch(V.settled_cues(fed, groups=_groups(spark)), "clean", V.repaired)
    return out.select("video", "pos", "start_ms", "end_ms", "note", F.md5("text").alias("text_md5"), F.array_join("issues", ",").alias("issues"))


@query()
def stream_clean_words(spark, sf_dir):
    """All word rules on words that come in several micro-batches."""
    rows = B.words(spark, sf_dir).withColumn("last", F.max("pos").over(Window.partitionBy("video")) == F.col("pos"))
    out = V.by_batch(V.settled_words(_fed_in_order(spark, rows, "words"), joined=True, groups=_groups(spark)), "words", lambda pieces: V.finished_words(pieces, joined=True))
    return out.select("video", "pos", "word", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "score")


_SUMMARIES = quality_queries.ORACLE["summary_windows"]


@query("SELECT video, version, words, body_md5 FROM (" + _SUMMARIES + ")")
def stream_summaries(spark, sf_dir):
    """Stream and batch give the same."""
    fed = _fed_in_order(spark, _segments(spark, sf_dir), "segments", "seq")
    return V.drained(V.summary_windows(fed, 60, groups=_groups(spark)), "summaries").select("video", "version", "words", F.md5("body").alias("body_md5"))


@query("SELECT conv_id AS video, CAST(turn AS BIGINT) AS seq, CAST(coalesce(greatest(turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) - 1, 0), 0) AS BIGINT) AS missing FROM conversations WHERE turn % 3 <> 1")
def stream_gaps(spark, sf_dir):
    """Turns missing from a feed that comes in several micro-batches, each in no order."""
    rows = _segments(spark, sf_dir).where("seq % 3 <> 1")
    rows = rows.withColumn("last", F.max("seq").over(Window.partitionBy("video")) == F.col("seq")).orderBy(F.xxhash64("video", "seq"))
    return V.drained(V.sequence_gaps(_fed_in_order(spark, rows, "turns", "seq"), groups=_groups(spark)), "gaps")


@query("SELECT event_type, count(DISTINCT event_id) AS n FROM events WHERE event_type LIKE 'c%' GROUP BY event_type")
def stream_events(spark, sf_dir):
    """A feed that sends everything twice, filtered and without repeats."""
    e = B.table(spark, sf_dir, "events").select("event_id", "ts", "event_type").where("event_type like 'c%'")
    # a repeat can be as late as the feed is long, and files come in any order
    at = F.col("ts").cast("timestamp").cast("long")
    span = e.agg(F.coalesce(F.max(at) - F.min(at), F.lit(0))).first()[0]
    out = V.drained(V.once_each(_fed(spark, e.unionAll(e), "events"), late=f"{span + 1} seconds"), "once")
    return out.groupBy("event_type").agg(F.count("*").alias("n"))


@query(state_queries.ORACLE["daily_ledger"])
def stream_ledger(spark, sf_dir):
    """V10."""
    out = V.drained(V.daily_usage(_fed(spark, B.usage(spark, sf_dir), "usage")), "ledger", "complete")
    return out.select("user_id", F.col("day").cast("string").alias("day"), "prompt_tokens", "completion_tokens", F.round("cost_usd", 3).alias("cost_usd"), "requests")


@query("SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS hour, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    """V12, tumbling."""
    out = V.event_windows(B.table(spark, sf_dir, "events"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n", F.round("total", 3).alias("total"))


@query(
    """WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start_us, count(*) AS n, round(sum(value), 3) AS total FROM s GROUP BY user_id, k"""
)
def event_sessions(spark, sf_dir):
    """V12, sessions."""
    out = V.event_windows(B.table(spark, sf_dir, "events"), "session")
    return out.select("user_id", F.unix_micros(F.col("w.start").cast("timestamp")).alias("start_us"), "n", F.round("total", 3).alias("total"))
