"""The operators' input tables, taken from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueforge.functions import text as X


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cues(spark, sf_dir) -> DataFrame:
    """Every line of a document is a cue: 2 s apart, 40 ms a character."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video"), "lang", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    start = F.col("pos").cast("long") * 2000
    return docs.select("video", "lang", F.col("pos").cast("long").alias("pos"), start.alias("start_ms"), (start + 40 * F.length("text")).alias("end_ms"), "text")


CUES_SQL = """cues AS (SELECT video, lang, pos, pos * 2000 AS start_ms, pos * 2000 + 40 * length(text) AS end_ms, text FROM
  (SELECT doc_id AS video, lang, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents))"""


def words(spark, sf_dir) -> DataFrame:
    """Tokens of a document as recognised words: about a seventh have no time."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video"), F.posexplode(X.white_split(F.col("text"))).alias("pos", "word"))
    n = F.col("pos").cast("long")
    untimed = ((F.col("video") * 31 + n) % 7 == 0) | F.col("word").rlike("[0-9]")
    return docs.select(
        "video", n.alias("pos"), "word", F.when(~untimed, n * 0.5).alias("start"), F.when(~untimed, n * 0.5 + 0.4).alias("end"),
        (((F.col("video") * 17 + n) % 100) / 100).alias("score"),
    )


WORDS_SQL = r"""words AS (SELECT video, pos, word, CASE WHEN NOT u THEN pos * 0.5::DOUBLE END AS "start", CASE WHEN NOT u THEN pos * 0.5::DOUBLE + 0.4::DOUBLE END AS "end", ((video * 17 + pos) % 100) / 100 AS score FROM
  (SELECT video, word, pos, (video * 31 + pos) % 7 = 0 OR regexp_matches(word, '[0-9]') AS u FROM
    (SELECT doc_id AS video, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM
      (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM documents))))"""


def turns(spark, sf_dir) -> DataFrame:
    """A conversation is a video, a turn a segment, its role the speaker."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video"), F.col("turn").alias("pos"), F.col("role").alias("speaker"), "text")


def pairs(spark, sf_dir) -> DataFrame:
    """Source and target: a user's turn and the assistant's turn after it."""
    c = table(spark, sf_dir, "conversations")
    a = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("src"))
    b = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("tgt"))
    return a.join(b, ["conv_id", "turn"]).withColumns({"prompt_tokens": F.length("src"), "completion_tokens": F.length("tgt")})


PAIRS_SQL = """pairs AS (SELECT a.conv_id, a.turn, a.text AS src, b.text AS tgt, length(a.text) AS prompt_tokens, length(b.text) AS completion_tokens
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.role = 'user' AND b.role = 'assistant')"""


def usage(spark, sf_dir) -> DataFrame:
    """Events as usage: the model is the event type, cost the value (none for a tenth), tokens from the properties."""
    e = table(spark, sf_dir, "events")
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
    return e.select(
        "event_id", "ts", "user_id", F.when(F.col("event_id") % 13 == 0, "").otherwise(F.col("event_type")).alias("model"), (k * 3).alias("prompt_tokens"), k.alias("completion_tokens"),
        F.when(F.col("event_id") % 10 != 0, F.round("value", 4)).alias("cost_usd"), F.lit(1).cast("long").alias("requests"),
    )


USAGE_SQL = """usage AS (SELECT event_id, ts, user_id, CASE WHEN event_id % 13 = 0 THEN '' ELSE event_type END AS model,
  coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) * 3 AS prompt_tokens, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) AS completion_tokens,
  CASE WHEN event_id % 10 <> 0 THEN round(value, 4) END AS cost_usd, 1 AS requests FROM events)"""
