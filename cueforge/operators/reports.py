"""Corpus reports: totals, invariants of cleaning and restructuring, languages of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueforge.functions import text as X
from cueforge.operators import cues as C
from cueforge.sources.shared import written


def file_languages(rows: DataFrame, keys: list[str], first: int = 20) -> DataFrame:
    """The language of each file by its first rows."""
    w = Window.partitionBy(*keys).orderBy("pos")
    head = rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= first)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), " ")
    return head.groupBy(*keys).agg(X.detect_language(text).alias("lang"))


def corpus_totals(traced: DataFrame, keys: list[str], require: str | None = None, steps: str = "steps") -> DataFrame:
    """Files processed, unchanged, and without the required rule."""
    hit = F.exists(steps, lambda s: s["rule_id"] == require) if require else F.lit(True)
    files = traced.groupBy(*keys).agg(F.max(F.size(steps) > 0).alias("changed"), F.max(hit).alias("has"))
    return files.agg(F.count("*").alias("files"), F.count_if(~F.col("changed")).alias("unchanged"), F.count_if(F.col("changed") & ~F.col("has")).alias("rule_missed"), F.count_if(F.col("changed") & F.col("has")).alias("processed"))


def stable_sample(df: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """The same n rows on every run."""
    return df.orderBy(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), key).limit(n)


def recovered(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Segments without words but with text and times."""
    ok = (F.coalesce(F.size("words"), F.lit(0)) <= 0) & (F.trim("text") != "") & F.col("start").isNotNull() & F.col("end").isNotNull()
    return segments.groupBy(*keys).agg(F.count_if(ok).alias("recovered"))


def cleaning_invariants(cues: DataFrame, keys: list[str]) -> DataFrame:
    """Per file: whether cleaning keeps the content, also the second time, and changes nothing the second time."""
    once = C.clean_text(cues.withColumn("_a", F.col("text")))
    twice = C.clean_text(once.withColumn("_b", F.col("text")))


    def kept(before, after):
        # a text that stays as it is keeps its content, so keys are made of the others alone
        same = F.col(before) == F.col(after)
        key = lambda c: X.content_key(F.when(~same, F.col(c)))
        return F.when(same, True).otherwise(key(before) == key(after))

    kept1, kept2 = kept("_a", "_b"), kept("_b", "text")
    return twice.groupBy(*keys).agg(F.min(kept1).alias("content_kept"), F.min(kept2).alias("content_kept_twice"), F.min(F.col("_b") == F.col("text")).alias("idempotent"))


def structure_invariants(before: DataFrame, after: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """Per video: text and words kept, times kept and in order, lengths within `most`. Both: keys, pos, start, end, text."""

    def side(d, name):
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), " ")
        return d.groupBy(*keys).agg(X.alnum_key(text).alias(f"{name}_key"), F.size(X.white_split(text)).alias(f"{name}_words"), F.min("start").alias(f"{name}_start"), F.max("end").alias(f"{name}_end"), F.max(F.length("text")).alias(f"{name}_longest"))

    w = Window.partitionBy(*keys).orderBy("pos")
    order = after.withColumn("_bad", F.coalesce(F.lag("start").over(w) > F.col("start") + 1e-6, F.lit(False))).groupBy(*keys).agg((~F.max("_bad")).alias("ordered"))
    out = side(before, "a").join(side(after, "b"), keys, "left").join(order, keys, "left")
    near = lambda x, y: F.abs(F.col(x) - F.col(y)) <= 1e-6
    return out.select(
        *keys, (F.col("a_key") == F.col("b_key")).alias("text_kept"), (F.col("a_words") == F.col("b_words")).alias("words_kept"),
        (near("a_start", "b_start") & near("a_end", "b_end")).alias("times_kept"), "ordered", (F.lit(True) if most is None else F.col("b_longest") <= most).alias("within"),
    )


def word_issues(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, kind, at, before, after: places where words or their times differ. Both: keys, pos, word, start, end.

    A word's place is the number of letters and digits before it, so it is found again however texts were cut and joined. `text`: the first place of a video where the two part (a null word: nothing
    of that place on that side); `time`: words before that place whose times differ. Words without letters or digits have no place.
    """

    def placed(d):
        d = d.withColumn("_key", X.alnum_key(F.col("word"))).where("_key <> ''")
        so_far = F.sum(F.length("_key")).over(Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
        return d.select(*keys, F.coalesce(so_far, F.lit(0)).alias("at"), F.struct("_key", "word", "start", "end").alias("w"))

    both = placed(before).withColumnRenamed("w", "a").join(placed(after).withColumnRenamed("w", "b"), [*keys, "at"], "full")
    parted = ~F.coalesce(F.col("a._key") == F.col("b._key"), F.lit(False))
    parts = both.withColumn("_parts", F.min(F.when(parted, F.col("at"))).over(Window.partitionBy(*keys)))
    moved = (F.abs(F.col("a.start") - F.col("b.start")) > 1e-6) | (F.abs(F.col("a.end") - F.col("b.end")) > 1e-6)
    kind = F.when(F.col("at") == F.col("_parts"), "text").when((F.col("_parts").isNull() | (F.col("at") < F.col("_parts"))) & F.coalesce(moved, F.lit(False)), "time")
    return parts.withColumn("kind", kind).where("kind is not null").select(*keys, "kind", "at", F.col("a.word").alias("before"), F.col("b.word").alias("after"))


def segment_issues(segments: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """Keys, kind, pos: segments that end before they start (`inverted`), start before the one before ends (`overlap`), or have over `most` characters and several words (`long`)."""
    segments = segments.withColumn("_ended", F.lag("end").over(Window.partitionBy(*keys).orderBy("pos")))
    text = X.trim(F.col("text"))
    long = F.lit(False) if most is None else (F.length(text) > most) & (F.size(X.white_split(text)) > 1)
    kinds = F.array(F.when(F.col("start") > F.col("end") + 1e-6, "inverted"), F.when(F.col("_ended") > F.col("start") + 1e-6, "overlap"), F.when(long, "long"))
    return segments.select(*keys, "pos", F.explode(F.array_compact(kinds)).alias("kind")).select(*keys, "kind", "pos")


def boundary_issues(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, kind, before, after: videos whose first start (`start`) or last end (`end`) differ."""
    ends = lambda d, name: d.groupBy(*keys).agg(F.min_by("start", "pos").alias(f"{name}_start"), F.max_by("end", "pos").alias(f"{name}_end"))
    both = ends(before, "a").join(ends(after, "b"), keys)
    rows = both.select(*keys, F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"a_{k}").alias("before"), F.col(f"b_{k}").alias("after")) for k in ("start", "end")])).alias("r"))
    return rows.select(*keys, "r.*").where(F.abs(F.col("before") - F.col("after")) > 1e-6)


def second_pass(df: DataFrame, keys: list[str], rules: list, columns: list[str]) -> DataFrame:
    """Keys, pos, first, second: rows that a chain of rules (DataFrame -> DataFrame) changes when it runs over its own result; null where a pass has no such row."""
    passes = []
    for _ in range(2):
        for rule in rules:
            df = rule(df)
        df = written(df, "pass")
        passes.append(df.select(*keys, "pos", F.struct(*columns).alias("v")))
    first, second = (d.withColumnRenamed("v", name) for d, name in zip(passes, ("first", "second"), strict=True))
    return first.join(second, [*keys, "pos"], "full").where(~F.col("first").eqNullSafe(F.col("second")))


def corpus_report(flags: DataFrame, names: list[str], total: str = "rows") -> DataFrame:
    """Each flag's count and percentage, most common first."""
    counts = flags.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c)).alias(c) for c in names])
    rows = counts.select("_n", F.explode(F.array(*[F.struct(F.lit(c).alias("flag"), F.col(c).alias("n")) for c in names])).alias("r"))
    return rows.select("r.flag", "r.n", F.round(100 * F.col("r.n") / F.col("_n"), 4).alias("pct")).orderBy(F.desc("n"), "flag")


def first_failures(flags: DataFrame, keys: list[str], kind: str, n: int = 10) -> DataFrame:
    """The first failures of each kind."""
    return flags.withColumn("_k", F.row_number().over(Window.partitionBy(kind).orderBy(*keys))).where(F.col("_k") <= n).drop("_k")


def seek_order(rows: DataFrame, seeks: DataFrame, keys: list[str], top: int) -> DataFrame:
    """O3: for many seek points at once, the first `top` rows in the order after a seek: by priority, then distance of start from the point, then seq.

    rows: keys, priority, start, seq; seeks: keys, seek_id, at. Of each priority the nearest rows are the `top` before the point and the `top` after it in order of time, so a seek
    point is given its place among the rows of each priority and looks at those alone.
    """
    lanes = rows.select(*keys, "priority").distinct()
    lane = [*keys, "priority"]
    points = seeks.join(lanes, keys).select(*lane, F.col("at").alias("start"), "seek_id")
    # rows at the point's own time count as after it
    both = rows.select(*lane, "start", F.lit(None).cast(seeks.schema["seek_id"].dataType).alias("seek_id"), F.lit(1).alias("_row")).unionByName(points.withColumn("_row", F.lit(0)))
    placed = both.withColumn("_n", F.coalesce(F.sum("_row").over(Window.partitionBy(*lane).orderBy("start", "_row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = placed.where("_row = 0").select(*lane, "seek_id", F.col("start").alias("at"), "_n")
    out = None
    for rank, span in ((F.desc("seq"), F.sequence(F.col("_n") - top + 1, F.col("_n"))), (F.asc("seq"), F.sequence(F.col("_n") + 1, F.col("_n") + top))):
        # of rows that start together the smaller seq is nearer, from either side
        ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*lane).orderBy("start", rank)).cast("long"))
        side = placed.withColumn("_r", F.explode(span)).drop("_n").join(ranked, [*lane, "_r"]).drop("_r")
        out = side if out is None else out.unionByName(side)
    order = Window.partitionBy(*keys, "seek_id").orderBy("priority", F.abs(F.col("start") - F.col("at")), "seq")
    return out.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
