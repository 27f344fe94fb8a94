"""Files: caption files, recognised words, response dumps, listings and reports.

Everything reads through Spark's readers, so any store works; malformed input goes to a quarantine frame, not an exception.
"""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cueforge.functions import tables as T
from cueforge.functions import text as X
from cueforge.operators import cues as C
from cueforge.sources.shared import written

#: Encodings in the order they are tried once no byte order mark tells.
ENCODINGS = ["utf-8", "gb18030", "shift_jis", "cp1252"]

WORD = "struct<word:string,start:double,end:double,score:double,speaker:string>"
ASR = f"language string, segments array<struct<start:double,end:double,text:string,speaker:string,words:array<{WORD}>>>, word_segments array<{WORD}>"


@F.pandas_udf(StringType())
def _decoded(raw: pd.Series) -> pd.Series:
    def one(data):
        if data is None:
            return None
        data = bytes(data)
        if data.startswith(codecs.BOM_UTF8):
            return data[3:].decode("utf-8", "replace")
        if data.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)):
            return data.decode("utf-16", "replace")
        for name in ENCODINGS:
            try:
                return data.decode(name)
            except UnicodeDecodeError:
                continue
        return data.decode("utf-8", "replace")

    return raw.map(one)


def decode_bytes(content: Column) -> Column:
    """Text of bytes in whatever encoding."""
    return _decoded(content)


def caption_files(spark: SparkSession, path: str, glob: str = "*.srt") -> DataFrame:
    """(path, content) of caption files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", decode_bytes(F.col("content")).alias("content"))


def video_list(spark: SparkSession, path: str, glob: str = "*.srt") -> DataFrame:
    """(video, path) of the files of a folder by name; a video's key is the name without its extension."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.regexp_replace(name, r"(?<=.)\.[^.]*$", "").alias("video"), "path", name.alias("_name")).orderBy("_name", "path").drop("_name")


def clean_captions(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cleaned cues of good files, issues of files that can't be repaired)."""
    cues = C.not_empty(C.clean_text(C.parse_cues(files).drop("raw")))
    done = written(C.repair_times(cues, ["path"]), "captions")
    bad = done.where(F.size("issues") > 0)
    issues = bad.groupBy("path").agg(F.array_sort(F.flatten(F.collect_list("issues"))).alias("codes"), F.array_sort(F.collect_list("pos")).alias("cue_indices"))
    return done.join(issues.select("path"), "path", "left_anti"), issues


def spread_words(start: Column, end: Column, text: Column, speaker: Column) -> Column:
    """A segment's words in even time slices; all in one word if it has no duration; none if its times are wrong."""
    tokens = X.white_split(text)
    none = F.array().cast(f"array<{WORD}>")
    word = lambda t, a, b: F.struct(t.alias("word"), a.alias("start"), b.alias("end"), F.lit(None).cast("double").alias("score"), speaker.alias("speaker"))

    def spread(ts):
        n = F.size(ts)
        step = (end - start) / n
        return F.transform(ts, lambda t, i: word(t, start + step * i, F.when(i == n - 1, end).otherwise(start + step * (i + 1))))

    joined = F.array(word(F.array_join(tokens, " "), start, end)).cast(f"array<{WORD}>")
    bad = start.isNull() | end.isNull() | F.isnan(start) | F.isnan(end) | (end < start) | (F.size(tokens) == 0)
    return F.when(bad, none).when(end == start, joined).otherwise(X.let(tokens, spread).cast(f"array<{WORD}>"))


def asr_words(docs: DataFrame, content: str = "content") -> DataFrame:
    """The words of each document: a segment's own with its speaker, else spread from its text; without segments the top-level ones."""
    rows = docs.withColumn("_d", F.from_json(content, ASR))

    def inner(s):
        own = F.transform(s["words"], lambda w: F.struct(w["word"].alias("word"), w["start"].alias("start"), w["end"].alias("end"), w["score"].alias("score"), F.coalesce(w["speaker"], s["speaker"]).alias("speaker")))
        return F.when(F.size(F.coalesce(s["words"], F.array().cast(f"array<{WORD}>"))) > 0, own).otherwise(spread_words(s["start"], s["end"], s["text"], s["speaker"]))

    every = F.flatten(F.transform("_d.segments", inner))
    chosen = F.when(F.size(F.coalesce(F.col("_d.segments"), F.array())) > 0, every).otherwise(F.col("_d.word_segments"))
    kept = [c for c in docs.columns if c != content]
    return rows.select(*kept, F.posexplode(chosen).alias("pos", "w")).select(*kept, F.col("pos").cast("long").alias("pos"), "w.*")


def response_segments(docs: DataFrame, content: str = "content") -> DataFrame:
    """Segments of transcription responses: trimmed texts, defaults for what is missing, words under `word` or `text`."""
    schema = "segments array<struct<start:double,end:double,text:string,speaker:string,words:array<struct<word:string,text:string,start:double,end:double>>>>"
    kept = [c for c in docs.columns if c != content]
    rows = docs.select(*kept, F.posexplode(F.from_json(content, schema)["segments"]).alias("pos", "s"))
    words = F.transform("s.words", lambda w: F.struct(X.trim(F.coalesce(w["word"], w["text"])).alias("word"), w["start"].alias("start"), w["end"].alias("end")))
    return rows.select(
        *kept, F.col("pos").cast("long").alias("pos"), F.coalesce("s.start", F.lit(0.0)).alias("start"), F.coalesce("s.end", "s.start", F.lit(0.0)).alias("end"), X.trim(F.coalesce("s.text", F.lit(""))).alias("text"),
        "s.speaker", F.filter(words, lambda w: w["word"] != "").alias("words"),
    )


def media_info(docs: DataFrame, content: str = "content") -> DataFrame:
    """Platform, title and subtitle languages of each video in media dumps; a playlist gives one row per entry."""
    fields = {"id": "string", "title": "string", "extractor": "string", "webpage_url": "string", "subtitles": "map<string,string>", "automatic_captions": "map<string,string>"}
    one = ",".join(f"{c}:{t}" for c, t in fields.items())
    whole = F.from_json(content, f"struct<{one},entries:array<struct<{one}>>>")
    kept = [c for c in docs.columns if c != content]
    rows = docs.withColumn("_d", whole)
    entry = F.when(F.col("_d.entries").isNotNull(), F.filter("_d.entries", lambda e: e.isNotNull())).otherwise(
        F.array(F.struct(*[F.col(f"_d.{c}") for c in ("id", "title", "extractor", "webpage_url", "subtitles", "automatic_captions")]))
    )
    rows = rows.select(*kept, F.explode(entry).alias("v"))
    url = F.lower(F.coalesce("v.webpage_url", F.lit("")))
    platform = F.when(url.contains("youtube.com") | url.contains("youtu.be"), "youtube").when(url.contains("bilibili.com"), "bilibili").otherwise(F.coalesce(F.lower("v.extractor"), F.lit("unknown")))
    keys = lambda c: F.coalesce(F.map_keys(c), F.array().cast("array<string>"))
    return rows.select(*kept, "v.id", "v.title", platform.alias("platform"), F.array_sort(F.array_union(keys("v.subtitles"), keys("v.automatic_captions"))).alias("languages"))


def workspace_keys(files: DataFrame, path: str = "path") -> DataFrame:
    """Folder, stem, [ID] at its end, language tail and key of each file path."""
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    langs = "|".join([*T.CJK, *T.SPACE])
    bare = F.regexp_replace(stem, rf"[._-](?:{langs})$", "")
    ident = F.regexp_extract(bare, r"\[([^\[\]]+)\]\s*$", 1)
    return files.withColumns(
        {
            "folder": F.element_at(F.split(path, "/"), -2), "stem": stem, "lang_tail": F.regexp_extract(stem, rf"[._-]({langs})$", 1),
            "ident": ident, "key": F.trim(F.regexp_replace(bare, r"\s*\[[^\[\]]+\]\s*$", "")),
        }
    )


def resolved(wanted: DataFrame, files: DataFrame, missing: str = "none") -> DataFrame:
    """The file of each wanted key: by id, then by key. missing: `none` (null path), `skip` or `raise`. wanted: pos, ident, key."""
    by_id = files.where("ident <> ''").groupBy("ident").agg(F.min("path").alias("_p1"))
    by_key = files.groupBy("key").agg(F.min("path").alias("_p2"))
    out = wanted.join(by_id, "ident", "left").join(by_key, "key", "left").withColumn("path", F.coalesce("_p1", "_p2")).drop("_p1", "_p2")
    if missing == "skip":
        return out.where(F.col("path").isNotNull())
    if missing == "raise":
        return out.withColumn("path", F.coalesce("path", F.raise_error(F.concat(F.lit("no file for "), F.col("key")))))
    return out


def pending(videos: DataFrame, include: DataFrame | None, exclude: DataFrame | None, key: str = "key") -> DataFrame:
    """S13."""
    if include is not None:
        videos = videos.join(include.select(key), key, "left_semi")
    return videos if exclude is None else videos.join(exclude.select(key), key, "left_anti")


def artifact_map(files: DataFrame, kinds: list[str]) -> DataFrame:
    """One row per key with a path for each kind of folder."""
    return files.groupBy("key").pivot("folder", kinds).agg(F.min("path"))


def source_kind(path: Column) -> Column:
    """S16."""
    low = F.lower(path)
    audio = F.lit(False)
    for tail in ("mp3", "wav", "m4a", "mp4", "mkv", "webm", "flac", "ogg"):
        audio = audio | F.endswith(low, F.lit("." + tail))
    return F.when(F.endswith(low, F.lit(".srt")), "srt").when(F.endswith(low, F.lit(".json")), "whisperx").when(audio, "audio").otherwise("unknown")


def json_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One JSON text per row, ready for write.text."""
    return rows.select(F.to_json(F.struct(*columns)).alias("value"))


def from_lines(lines: DataFrame, schema: str) -> DataFrame:
    """Rows of JSON texts; lines that don't parse have null columns."""
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def manifest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per video: rows, duration, speakers in order of appearance, and a hash of the texts in order."""
    texts = F.array_sort(F.collect_list(F.struct("pos", "text")))
    order = F.array_sort(F.collect_list(F.when(F.col("speaker").isNotNull(), F.struct("pos", "speaker"))))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.greatest(F.lit(0.0), F.max("end") - F.min("start")).alias("duration"), F.array_distinct(F.transform(order, lambda s: s["speaker"])).alias("speakers"),
        F.sha2(F.array_join(F.transform(texts, lambda s: s["text"]), "\n"), 256).alias("sha256"),
    )


def export_cues(records: DataFrame, lang: str, keys: list[str]) -> DataFrame:
    """Cues of a translated video: the selected variant, else the first; aligned pieces if they fit, else the whole on the first segment; empty pieces go."""
    bucket = F.element_at("translations", F.lit(lang))
    chosen = F.coalesce(F.element_at(bucket, F.element_at("selected", F.lit(lang))), F.get(F.map_values(bucket), F.lit(0)))
    pieces = F.element_at("alignment", F.lit(lang))
    spread = F.transform(F.sequence(F.lit(1), F.size("segments")), lambda i: F.when(i == 1, chosen).otherwise(""))
    fit = F.coalesce(F.size(pieces) == F.size("segments"), F.lit(False))
    rows = records.withColumn("_p", F.when(fit, pieces).otherwise(spread)).select(*keys, "rec_id", F.posexplode(F.arrays_zip("segments", "_p")).alias("k", "z"))
    rows = rows.where(F.trim("z._p") != "")
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    out = rows.select(*keys, "rec_id", "k", ms("z.segments.start").alias("start_ms"), ms("z.segments.end").alias("end_ms"), F.col("z._p").alias("text"))
    return out.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy("rec_id", "k")))


def rule_report(df: DataFrame, keys: list[str], steps: str = "steps") -> DataFrame:
    """A line for every changed row and one summary line per file."""
    detail = df.where(F.size(steps) > 0).select(*keys, F.lit("detail").alias("kind"), F.to_json(F.struct("pos", steps)).alias("value"))
    total = C.file_report(df, keys, steps).select(*keys, F.lit("summary").alias("kind"), F.to_json(F.struct("cues_in", "cues_out", "modified")).alias("value"))
    return detail.unionByName(total)


def migrated(docs: DataFrame, target: str | None = None, fmt: str = "parquet", key: str = "course") -> DataFrame:
    """Counts by course; without a target nothing is written."""
    if target:
        docs.write.format(fmt).mode("errorifexists").save(target)
    return docs.groupBy(key).agg(F.count("*").alias("n"))
