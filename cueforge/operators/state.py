"""Per-record state as tables: patches, hydration, fingerprints and invalidation."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Steps in order; a step is stale if it or one before it changed.
STEPS = ["raw", "preprocess.punc", "preprocess.chunk", "translate", "tts"]


def fingerprint(settings: dict) -> str:
    """Of a step's settings, whatever their order."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def patched(snapshot: DataFrame, patches: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The last write of each key wins; a snapshot row is older than any patch. Both have the same columns but for seq."""
    old = snapshot.withColumn(seq, F.lit(-1).cast("bigint"))
    rows = old.unionByName(patches.withColumn(seq, F.col(seq).cast("bigint")))
    rest = [c for c in rows.columns if c not in (*keys, seq)]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


#: A path as one string: its names, each with this before it.
_STEP = "\x1f"


def _joined_path(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda x: F.concat(F.lit(_STEP), x)), "")


def patched_paths(patches: DataFrame, keys: list[str]) -> DataFrame:
    """What a log of writes to places inside documents leaves: keys, path, value (JSON), one row a place.

    patches: keys, seq (different in each document), op, path (array of names), value (JSON). `set` puts a value at a place and drops what was at, below or (if that was no
    object) above it; `append` adds an element to the list there, a new one where no list is left; `drop` empties the place and all below. A map is merged by a set a name; an
    object is replaced by a drop and sets after it. A stored document goes before the log as sets of smaller seq.

    No two writes are compared with one another: each is listed under every path that leads to its own, the latest write of each path at it and below it
    are maxima, and a write stays if none of those that bear on it is later.
    """
    rows = patches.where(F.size("path") > 0).select(*keys, "seq", "op", "path", "value", _joined_path(F.col("path")).alias("_at"))
    up = F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.struct(_joined_path(F.slice("path", F.lit(1), n)).alias("to"), (n == F.size("path")).alias("own"))))
    led = rows.select("*", up.alias("_u")).select(*rows.columns, F.col("_u.to").alias("_to"), F.col("_u.own").alias("_own"))
    last = led.groupBy(*keys, "_to").agg(
        F.max(F.when(F.col("_own") & (F.col("op") != "append"), F.col("seq"))).alias("_here"), F.max(F.when(F.col("_own") & (F.col("op") == "append"), F.col("seq"))).alias("_added"),
        F.max(F.when(~F.col("_own") & (F.col("op") != "drop"), F.col("seq"))).alias("_below"),
    )
    on = [*keys, "_to"]
    # a list higher up replaces what is below it too
    above = F.greatest("_here", F.when(~F.col("_own"), F.col("_added")), F.when(F.col("_own") & (F.col("op") == "set"), F.col("_added")))
    later = F.greatest(above, F.when(F.col("_own"), F.col("_below")))
    judged = led.join(last, on).groupBy(*keys, "seq", "op", "_at").agg(F.max(later).alias("_later"), F.first("path").alias("path"), F.first("value").alias("value"))
    left = judged.where((F.col("op") != "drop") & F.coalesce(F.col("_later") <= F.col("seq"), F.lit(True)))
    items = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda s: s["value"]), ","), F.lit("]"))
    return left.groupBy(*keys, "_at", "op").agg(F.first("path").alias("path"), F.when(F.col("op") == "append", items).otherwise(F.first("value")).alias("value")).select(*keys, "path", "value")


def rebuilt(places: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, document: JSON objects from their places (keys, path, value), names in order; built from the longest paths up, one aggregation a level."""
    depth = places.agg(F.coalesce(F.max(F.size("path")), F.lit(0))).first()[0]
    quoted = F.to_json(F.struct(F.element_at("path", -1).alias("n")))  # {"n":"name"}
    entry = F.concat(F.expr("left(_q, length(_q) - 1)"), F.lit(":"), F.col("value"))
    up = None
    for level in range(depth, 0, -1):
        here = places.where(F.size("path") == level).select(*keys, "path", "value")
        here = (here if up is None else here.unionByName(up)).withColumn("_q", F.substring(quoted, 6, 1 << 30)).withColumn("_e", entry)
        whole = F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list("_e")), ","), F.lit("}"))
        up = here.groupBy(*keys, F.slice("path", 1, level - 1).alias("path")).agg(whole.alias("value"))
    return places.select(*keys, F.col("value").alias("document")).limit(0) if up is None else up.select(*keys, F.col("value").alias("document"))


#: What an invalidation without a processor empties in a record, and with one takes the processor out of.
BUCKETS = ("translations", "alignment", "tts", "errors", "_fingerprints")
PROCESSOR_BUCKETS = ("errors", "_fingerprints")


def invalidations(asked: DataFrame, places: DataFrame, keys: list[str]) -> DataFrame:
    """`drop` patches for places (keys, rec_id, path, value) of records. asked: keys, rec_id (null: all), processor (null: all outputs)."""
    asked = asked.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("rec_id").alias("_rec"), "processor")
    on = F.col("_rec").isNull() | (F.col("_rec") == F.col("rec_id"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    bucket, name = F.get("path", F.lit(0)), F.get("path", F.lit(1))
    hit = F.when(F.col("processor").isNull(), bucket.isin(*BUCKETS) & (F.size("path") > 1)).otherwise(bucket.isin(*PROCESSOR_BUCKETS) & (name == F.col("processor")))
    return places.join(asked, on).where(hit).select(*keys, "rec_id", F.lit("drop").alias("op"), "path", F.lit(None).cast("string").alias("value")).distinct()


def merged_maps(old: Column, new: Column) -> Column:
    """Two maps, the new entries winning; null is empty."""
    return F.coalesce(F.map_zip_with(old, new, lambda k, a, b: F.coalesce(b, a)), new, old)


def hydrated(memory: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in memory with the stored translations under theirs (map lang -> map variant -> text); the rest of the stored row fills what memory lacks."""
    s = stored.select(*keys, *[F.col(c).alias(f"_{c}") for c in stored.columns if c not in keys])
    out = memory.join(s, keys, "left")
    both = F.map_zip_with(F.coalesce("translations", F.map_from_arrays(F.array(), F.array()).cast("map<string,map<string,string>>")), F.coalesce("_translations", F.map_from_arrays(F.array(), F.array()).cast("map<string,map<string,string>>")), lambda k, a, b: merged_maps(b, a))
    out = out.withColumn("translations", both)
    for c in stored.columns:
        if c not in (*keys, "translations") and c in memory.columns:
            out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"_{c}")))
    return out.select(*memory.columns)


def stale_steps(current: DataFrame, stored: DataFrame, keys: list[str], steps: list[str] | None = None) -> DataFrame:
    """From the first step whose fingerprint differs or is missing, every step is stale. Both: keys, step, value."""
    order = F.array_position(F.array(*[F.lit(s) for s in (steps or STEPS)]), F.col("step"))
    both = current.join(stored.select(*keys, "step", F.col("value").alias("_v")), [*keys, "step"], "left").withColumn("ord", order).where("ord > 0")
    w = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    changed = F.when(F.col("value").eqNullSafe(F.col("_v")), 0).otherwise(1)
    return both.withColumn("stale", F.max(changed).over(w) == 1).select(*keys, "step", "stale")


def invalidated(outputs: DataFrame, stale: DataFrame, keys: list[str]) -> DataFrame:
    """Outputs (keys, step, ...) without those of stale steps."""
    return outputs.join(stale.where("stale").select(*keys, "step"), [*keys, "step"], "left_anti")


def cached(texts: DataFrame, cache: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts that the cache has with their value, different texts that it lacks)."""
    hashed = lambda d: d.withColumn("_h", F.xxhash64(text))
    hits = hashed(texts).join(hashed(cache), ["_h", text]).drop("_h")
    misses = hashed(texts.select(text).distinct()).join(hashed(cache.select(text)), ["_h", text], "left_anti").drop("_h")
    return hits, misses


def document(keys_table: DataFrame, rows: DataFrame, keys: list[str], as_: str = "records") -> DataFrame:
    """One document per wanted key; a key without rows gives an empty one."""
    order = F.array_sort(F.collect_list(F.struct(*[c for c in rows.columns if c not in keys])))
    docs = rows.join(keys_table.select(*keys), keys, "left_semi").groupBy(*keys).agg(order.alias(as_))
    return keys_table.select(*keys).join(docs, keys, "left").withColumn(as_, F.coalesce(as_, F.array().cast(docs.schema[as_].dataType)))


def upgraded(docs: DataFrame, newest: int = 2) -> tuple[DataFrame, DataFrame]:
    """(documents brought to the newest schema, those of a newer one). A document without a version is of version 1."""
    v = F.coalesce(F.col("schema_version"), F.lit(1))
    empty = F.map_from_arrays(F.array(), F.array()).cast("map<string,string>")
    good = docs.where(v <= newest)
    for c in ("variants", "prompts", "terms"):
        good = good.withColumn(c, F.coalesce(F.col(c), empty) if c in docs.columns else empty)
    return good.withColumn("schema_version", F.lit(newest)), docs.where(v > newest)
