"""Recognised words: the cleaning rules W1 to W5, and words attached to punctuation.

Tables have keys, `pos`, `word`, `start` and `end` in seconds (null where a word has no time), `score`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from cueforge.functions import text as X
from cueforge.operators import folds
from cueforge.sources.shared import written

ASCII_PUNCT = r"!-/:-@\[-`{-~"
LONG_WORD, VERY_LONG = 30, 50
REPEATS = 4


def _by(keys):
    return Window.partitionBy(*keys).orderBy("pos")


def drop_untimed_repeats(df: DataFrame, keys: list[str]) -> DataFrame:
    """An untimed word equal to the untimed word before it goes."""
    return df.withColumn("_same", _untimed_repeat(keys)).where("not _same").drop("_same")


def _untimed_repeat(keys: list[str]):
    w = _by(keys)
    same = F.col("start").isNull() & F.lag("start").over(w).isNull() & (F.lag("word").over(w) == F.col("word"))
    return F.coalesce(same, F.lit(False))


#: Seconds within which a time counts as the next word's, and the share of the word before that is taken then.
TOUCH, TAKEN = 1e-6, 0.01


def fill_gaps(start, end, n, following=np.inf, letters=1e-7, timed=0.0, filled=0.0) -> tuple[float, float]:
    """W2 on the words of a video, or of a piece that begins with a timed word: start and end (nan where a word has none) are changed in place.

    Words without times go on from the word before at the rate of seconds a letter so far, up to the next timed word. Sums of
    letters and timed seconds come from prefix sums, so a gap takes one step as long as it stays below that limit. n: lengths of the words; following: the
    next start after them; letters, timed, filled: what earlier pieces add up to. Returns the seconds given to words so far and their derivative by `filled`.
    """
    bare = np.isnan(start)
    letters = letters + np.append(0, np.cumsum(n))
    timed = timed + np.append(0.0, np.cumsum(np.where(bare, 0.0, end - start)))
    slope, edge = 1.0, np.diff(np.concatenate([[False], bare, [False]]).astype(np.int8))
    begins, over = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # the words beside a gap are timed, so no other gap moves the times that it goes by
    now_of = np.where(begins > 0, end[begins - 1], 0.0).tolist()
    limit_of = np.append(start, following)[over].tolist()
    gaps_ = zip(begins.tolist(), over.tolist(), now_of, limit_of, letters[begins].tolist(), timed[begins].tolist(), n[begins].tolist(), strict=True)
    for a, b, now, limit, letters_a, timed_a, n_a in gaps_:
        if b == a + 1 and abs(now - limit) >= TOUCH:
            # one word, as below
            at = min(now + n_a * ((timed_a + filled) / letters_a), limit)
            start[a], end[a] = now, at
            filled += at - now
            if at < limit:
                slope += slope / letters_a * n_a
            continue
        k = a
        if abs(now - limit) >= TOUCH:
            own = np.cumsum(n[a:b])
            at = now + own * ((timed[a] + filled) / letters[a])
            near = at > limit - TOUCH
            k = a + (int(near.argmax()) + 1 if near.any() else b - a)
            at = np.minimum(at[: k - a], limit)
            start[a:k], end[a:k] = np.append(now, at[:-1]), at
            filled += at[-1] - now
            if at[-1] < limit:
                slope += slope / letters[a] * own[k - a - 1]
            now = at[-1]
        for k in range(k, b):  # words that stand at the limit
            if k and abs(now - limit) < TOUCH:
                now = end[k - 1] = end[k - 1] - TAKEN * min(1.0, end[k - 1] - start[k - 1])
            start[k], end[k] = now, min(limit, now + (timed[k] + filled) / letters[k] * n[k])
            filled, now = filled + end[k] - start[k], end[k]
    return filled, slope


_SUMS = {"following": np.inf, "letters": 1e-7, "timed": 0.0, "filled": 0.0}


def _fill(rows: pd.DataFrame) -> tuple[pd.DataFrame, tuple[float, float]]:
    rows = rows.sort_values("pos").reset_index(drop=True)
    start, end = (rows[c].to_numpy(np.float64, na_value=np.nan).copy() for c in ("start", "end"))
    bare = np.isnan(start)
    before = {c: float(rows[f"_{c}"][0]) for c in _SUMS} if "_filled" in rows else _SUMS
    found = fill_gaps(start, end, rows["word"].str.len().to_numpy(np.int64), **before)
    return rows.assign(start=start, end=end, score=np.where(bare, 0.0, rows["score"].to_numpy(np.float64, na_value=np.nan))), found


def _fill_all(rows: pa.Table) -> pa.Table:
    """W2 on many videos."""
    first = folds.begins(rows)
    start, end, score = (rows.column(c).to_numpy().astype(np.float64) for c in ("start", "end", "score"))
    n = pc.utf8_length(rows.column("word")).to_numpy().astype(np.int64)
    untimed = rows.column("start").is_null().to_numpy()
    gap = np.add.reduceat(untimed, first, dtype=np.int64) > 0
    bounds = np.append(first, len(n))
    changed = np.repeat(gap, np.diff(bounds))
    score[changed & np.isnan(start)] = 0.0
    for a, b in zip(bounds[:-1][gap].tolist(), bounds[1:][gap].tolist(), strict=True):
        fill_gaps(start[a:b], end[a:b], n[a:b])
    for name, done in (("start", start), ("end", end), ("score", score)):
        at = rows.schema.get_field_index(name)
        own = pa.chunked_array([pa.array(done, rows.schema.field(at).type, mask=np.isnan(done))])
        rows = rows.set_column(at, rows.schema.field(at), pc.if_else(pa.array(changed), own, rows.column(at)))
    return rows


def fill_times(df: DataFrame, keys: list[str]) -> DataFrame:
    """Missing times from the running rate of characters; videos without an untimed word stay as they are."""
    return folds.in_order(df, keys, _fill_all)


def fill_times_long(long: DataFrame, keys: list[str]) -> DataFrame:
    """W2 for long videos (a written table with `_chunk`), in pieces that begin with a timed word.

    Letters and timed seconds before a piece are sums. The seconds given to untimed words before it aren't: all pieces are worked out with a
    guess of them, which says how much a piece adds and how that depends on the guess; a video's pieces in order give the next guess. A round makes at
    least one more piece of each video exact; as the dependence is nearly linear, two or three rounds are usual.
    """
    piece = [*keys, "_piece"]
    cut = written(folds.pieces(long, keys, F.col("start").isNotNull()), "pieces")
    timed = F.when(F.col("start").isNotNull(), F.col("pos"))
    sums = cut.groupBy(*piece).agg(F.sum(F.length("word")).alias("n"), F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0.0)).alias("t"), F.min_by("start", timed).alias("s"))
    before, after = folds.earlier(keys, "_piece"), folds.later(keys, "_piece")
    sums = sums.select(
        *piece, F.coalesce(F.first("s", ignorenulls=True).over(after), F.lit(float("inf"))).alias("_following"),
        (F.lit(1e-7) + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("_letters"), F.coalesce(F.sum("t").over(before), F.lit(0.0)).alias("_timed"), F.lit(0.0).alias("_filled"),
    )
    kinds = ", ".join(f"{k} {cut.schema[k].dataType.simpleString()}" for k in piece)

    def effect(rows: pd.DataFrame) -> pd.DataFrame:
        filled, slope = _fill(rows)[1]
        return rows[[*piece, "_following", "_letters", "_timed", "_filled"]].head(1).assign(_out=filled, _slope=slope)

    def next_guess(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_piece")
        guess, filled = [], 0.0
        for was, out, slope in zip(rows["_filled"], rows["_out"], rows["_slope"], strict=True):
            guess.append(filled)
            filled = out + slope * (filled - was)
        return rows.assign(_moved=np.abs(rows["_filled"] - guess) > 1e-9 * (1 + np.abs(guess)), _filled=guess)

    sums = written(sums, "sums")
    numbers = ", ".join(f"{c} double" for c in ("_following", "_letters", "_timed", "_filled", "_out", "_slope"))
    while True:
        effects = folds.joined(cut, sums, piece).groupBy(*piece).applyInPandas(effect, f"{kinds}, {numbers}")
        sums = written(effects.groupBy(*keys).applyInPandas(next_guess, f"{kinds}, {numbers}, _moved boolean"), "sums")
        if sums.where("_moved").isEmpty():
            break
        sums = sums.drop("_out", "_slope", "_moved")
    rows, columns = folds.joined(cut, sums.drop("_out", "_slope", "_moved"), piece), long.columns
    return rows.groupBy(*piece).applyInPandas(lambda pdf: _fill(pdf)[0][columns], long.schema)


def attach_ascii(df: DataFrame, keys: list[str]) -> DataFrame:
    """Words of ASCII punctuation join the word before and give it their end."""
    return folds.in_order(df.withColumn("_alone", _alone()), keys, _attach_all).drop("_alone")


def _attach_all(rows: pa.Table) -> pa.Table:
    """W5 on many videos; `_alone`: whether a word is of ASCII punctuation."""
    alone = rows.column("_alone").to_numpy(zero_copy_only=False).astype(bool)
    alone[folds.begins(rows)] = False
    if not alone.any():
        return rows
    head = np.flatnonzero(~alone)
    bounds = pa.array(np.append(head, len(alone)), pa.int32())
    words = pc.binary_join(pa.ListArray.from_arrays(bounds, pc.fill_null(rows.column("word").combine_chunks(), "")), "")
    ends = rows.column("end").take(pa.array(np.append(head[1:], len(alone)) - 1))
    rows = rows.take(pa.array(head))
    for name, column in (("word", words), ("end", ends)):
        rows = rows.set_column(rows.schema.get_field_index(name), rows.schema.field(name), column)
    return rows


def kept_once(same: np.ndarray, size: int) -> np.ndarray:
    """Which words stay where each pattern of `size` words that comes REPEATS times or more in a row stays once. same: whether a word equals the one `size` before.

    A stretch of n equal words repeats the pattern before it n // size times. A pattern is taken where it begins first, after the repeats that went before.
    """
    keep = np.ones(len(same), bool)
    edge = np.diff(np.concatenate([[False], same, [False]]).astype(np.int8))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = last - first >= size * (REPEATS - 1)
    free = 0
    for a, b in zip(first[long].tolist(), last[long].tolist(), strict=True):
        begin = max(a - size, free)
        repeats = (b - begin - size) // size
        if repeats + 1 >= REPEATS:
            free = begin + size * (repeats + 1)
            keep[begin + size : free] = False
    return keep


def collapse_repeats(df: DataFrame, keys: list[str], size: int) -> DataFrame:
    """A pattern of `size` words repeated 4 times or more stays once."""
    return folds.in_order(df, keys, lambda rows: _collapse_all(rows, size))


def _collapse_all(rows: pa.Table, size: int) -> pa.Table:
    """W3 on many videos. The first words of each equal nothing before them, so no run goes over its end."""
    word = rows.column("word")
    same = np.zeros(len(word), bool)
    same[size:] = pc.fill_null(pc.equal(word[size:], word[: max(len(word) - size, 0)]), False).to_numpy()
    first = folds.begins(rows)
    for k in range(size):
        same[np.minimum(first + k, np.append(first[1:], len(same)) - 1)] = False
    keep = kept_once(same, size)
    return rows if keep.all() else rows.filter(pa.array(keep))


def _no_repeat_across(size: int):
    """A row before which no pattern of `size` words can have begun that goes on in it."""
    return lambda w: F.reduce(F.array(*[F.lead("word", k).over(w) != F.lag("word", size - k).over(w) for k in range(size)]), F.lit(True), lambda a, x: a & x)


def shorten_long(df: DataFrame) -> DataFrame:
    """A word of over 30 characters becomes `...` if its Latin letters are all capitals or it has over 50."""
    t = F.trim("word")
    capitals = t.rlike("[A-Za-z]") & ~t.rlike("[a-z]")
    return df.withColumn("word", F.when((F.length(t) > LONG_WORD) & (capitals | (F.length(t) > VERY_LONG)), "...").otherwise(F.col("word")))


def finished(df: DataFrame) -> DataFrame:
    """W-FIN: stripped words with times."""
    return df.withColumn("word", X.trim(F.col("word"))).where(_timed_word(F.col("word")))


def _timed_word(word):
    return (word != "") & F.col("start").isNotNull() & F.col("end").isNotNull()


def _alone(word="word"):
    return F.trim(word).rlike(f"^[{ASCII_PUNCT}]+$")


#: The rules in their order: name, rule(rows, keys), and for rules that look at neighbours, which row may begin a piece of a long video (by a window over a chunk).
RULES = [
    ("W1", drop_untimed_repeats, lambda w: F.col("start").isNotNull()),
    ("W2", fill_times, None),
    ("W5", attach_ascii, lambda w: ~_alone()),
    ("W3x2", lambda d, keys: collapse_repeats(d, keys, 2), _no_repeat_across(2)),
    ("W3x3", lambda d, keys: collapse_repeats(d, keys, 3), _no_repeat_across(3)),
    ("W4", lambda d, keys: shorten_long(d), None),
    ("FIN", lambda d, keys: finished(d), None),
]


def steps(keys: list[str]):
    """(name, rule of the rows) for each rule."""
    return [(name, lambda d, rule=rule: rule(d, keys)) for name, rule, _ in RULES]


def attached_once(df: DataFrame, keys: list[str], *before) -> DataFrame:
    """W5, W3, W4 and W-FIN in one pass over the rows in order, after the steps `before`."""
    return finished(shorten_long(folds.in_order(df.withColumn("_alone", _alone()), keys, *before, joined).drop("_alone")))


def joined(rows: pa.Table) -> pa.Table:
    """W5 and W3 on many videos, or pieces: a step of folds.in_order() with `_alone`."""
    rows = _attach_all(rows)
    for size in (2, 3):
        rows = _collapse_all(rows, size)
    return rows


def clean_words(df: DataFrame, keys: list[str]) -> DataFrame:
    """All word rules, in one pass. Videos of more than folds.CHUNK positions are cut into pieces, rule by rule, and written after each."""
    short, long = folds.split_long(df, keys)
    short = attached_once(drop_untimed_repeats(short, keys), keys, _fill_all)
    if long is None:
        return short
    for name, rule, fresh in RULES:
        if name == "W2":
            long = fill_times_long(long, keys)
        elif fresh is None:
            long = rule(long, keys)
            continue
        else:
            cut = folds.pieces(long, keys, fresh(Window.partitionBy(*keys, "_chunk").orderBy("pos")))
            long = rule(cut, [*keys, "_piece"]).drop("_piece")
        long = written(long, "words")
    return short.unionByName(long.drop("_chunk"))


def usable(df: DataFrame) -> DataFrame:
    """Finite times, the end after the start."""
    inf = F.lit(float("inf"))
    return df.where(~F.isnan("start") & ~F.isnan("end") & (F.abs("start") < inf) & (F.abs("end") < inf) & (F.col("end") > F.col("start")))


def word_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    """Words, untimed, of low score, long ones, and the span from the first timed word to the last."""
    timed = F.when(F.col("start").isNotNull(), F.col("pos"))
    return df.groupBy(*keys).agg(
        F.count("*").alias("words"), F.count_if(F.col("start").isNull()).alias("untimed"), F.count_if(F.col("score") < 0.1).alias("low_score"),
        F.count_if(F.length("word") > LONG_WORD).alias("long_words"), F.round(F.max_by("end", timed) - F.min_by("start", timed), 6).alias("span"),
    )


def _counted(rows: pa.Table) -> pa.Table:
    """The words that W1 to W3 leave of many videos, and a row for each step so far with its number, words and untimed words. `_same`: what W1 takes; `_alone`: see _attach_all()."""
    rows, told = rows.append_column("score", pa.nulls(rows.num_rows, pa.float64())), []
    rules = [lambda x: x, lambda x: x.filter(pc.invert(x.column("_same"))), _fill_all, _attach_all, lambda x: _collapse_all(x, 2), lambda x: _collapse_all(x, 3)]
    for step, rule in enumerate(rules):
        rows = rule(rows)
        told.append((step, rows.num_rows, rows.column("start").null_count))
    schema = pa.schema([("word", pa.string()), ("start", pa.float64()), ("end", pa.float64()), ("step", pa.int32()), ("words", pa.int64()), ("untimed", pa.int64())])
    table = lambda columns, n: pa.table([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)
    counts = {c: pa.array(x) for c, x in zip(("step", "words", "untimed"), zip(*told, strict=True), strict=True)}
    return pa.concat_tables([table({c: rows.column(c) for c in ("word", "start", "end")}, rows.num_rows), table(counts, len(told))])


def step_deltas(df: DataFrame, keys: list[str]) -> DataFrame:
    """Words and untimed words after each rule, and the change by it. All rules run in one pass over the rows in order, which counts as it goes: nothing is written."""
    rows = df.select(*keys, "pos", "word", "start", "end").withColumn("_same", _untimed_repeat(keys)).withColumn("_alone", _alone())
    found = shorten_long(folds.in_order(rows, keys, _counted, schema="word string, start double, end double, step int, words bigint, untimed bigint"))
    left, none = F.col("step").isNull(), F.col("start").isNull()
    of = lambda c, k: F.coalesce(F.sum(F.when(F.col("step") == k, F.col(c))), F.lit(0))
    names = ["raw", *(name for name, _, _ in RULES)]
    sums = [(of("words", k), of("untimed", k)) for k in range(len(names) - 2)]
    sums += [(F.count_if(left & test), F.count_if(left & test & none)) for test in (F.lit(True), _timed_word(X.trim(F.col("word"))))]
    row = found.agg(F.array(*[F.struct(F.lit(k).alias("step"), F.lit(name).alias("rule"), words.alias("words"), untimed.alias("untimed")) for k, (name, (words, untimed)) in enumerate(zip(names, sums, strict=True))]).alias("steps"))
    return row.select(F.inline("steps")).withColumn("change", F.col("words") - F.lag("words").over(Window.orderBy("step")))


def attach_punctuation(df: DataFrame, keys: list[str]) -> DataFrame:
    """Closing punctuation joins the word before, opening punctuation the word after; times widen."""
    close, opening = (rf"(?U)^\s*[{X.chars(c)}]+\s*$" for c in (X.T.TRAILING + X.T.CLOSING + X.T.DASHES, X.T.OPENING))
    other = [c for c in df.columns if c not in (*keys, "pos", "word", "start", "end")]
    word = F.coalesce("word", F.lit(""))
    marked = df.withColumns({"word": word, "_back": word.rlike(close), "_opens": word.rlike(opening)})
    return folds.in_order(marked, keys, _widen_all).select(*keys, "pos", "word", "start", "end", *other)


def _widen_all(rows: pa.Table) -> pa.Table:
    """A01 on many videos. `_back`: closing punctuation; `_opens`: opening punctuation."""
    back, opens = (rows.column(c).to_numpy().astype(bool) for c in ("_back", "_opens"))
    joins = back | np.append(False, opens[:-1])
    joins[folds.begins(rows)] = False
    if not joins.any():
        return rows
    head = np.flatnonzero(~joins)
    last = np.append(head[1:], len(joins)) - 1
    words = rows.column("word").combine_chunks()
    parts = pc.if_else(pa.array(joins), pc.utf8_ltrim(words, " "), words)
    values = {"word": pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(head, len(joins)), pa.int32()), parts), "")}
    for name, none, widest in (("start", np.nan, np.fmin), ("end", -np.inf, np.maximum)):
        column = rows.column(name).combine_chunks()
        bare = column.is_null().to_numpy(zero_copy_only=False)
        own = np.where(bare, none, column.to_numpy(zero_copy_only=False).astype(np.float64))
        values[name] = pa.array(widest.reduceat(own, head), mask=np.logical_and.reduceat(bare, head))
    firsts = rows.take(pa.array(head))
    rows = rows.take(pa.array(last))
    for name in ("pos", "_new"):
        values[name] = firsts.column(name)
    for name, column in values.items():
        at = rows.schema.get_field_index(name)
        rows = rows.set_column(at, rows.schema.field(at), column.cast(rows.schema.field(at).type))
    return rows


@F.arrow_udf(ArrayType(LongType()))
def _letters_before(words: pa.Array) -> pa.Array:
    """Characters before each word of an array, and in all of them."""
    n = pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.append(0, np.cumsum(n))
    total = np.append(0, np.cumsum(pc.utf8_length(words.flatten()).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)))
    at = np.arange(first[-1] + len(n)) - np.repeat(np.arange(len(n)), n + 1)
    return pa.ListArray.from_arrays(pa.array(first + np.arange(len(n) + 1), pa.int32()), pa.array(total[at] - np.repeat(total[first[:-1]], n + 1)))


def synthesized(segments: DataFrame, words: str = "words", start: str = "start", end: str = "end") -> DataFrame:
    """The segments' rows, one for each of their words, with pos, word, w_start and w_end: times in proportion to the words' lengths."""
    span, rest = F.col(end) - F.col(start), [c for c in segments.columns if c != words]
    done = segments.withColumn("_done", _letters_before(F.col(words)))
    at = lambda k: F.col(start) + span * F.get("_done", k) / F.get("_done", F.size(words))
    made = F.transform(words, lambda w, k: F.struct(w.alias("word"), at(k).alias("w_start"), at(k + 1).alias("w_end")))
    return done.select(*rest, F.posexplode(made).alias("pos", "w")).select(*rest, F.col("pos").cast("long").alias("pos"), "w.*")


#: Words are joined with segments by slabs of 2^SLAB seconds.
SLAB = 5


def assign_to_segments(words: DataFrame, segments: DataFrame, keys: list[str], slack: float = 1e-6) -> DataFrame:
    """Each word goes to the first segment that holds it; words that none holds are dropped.

    An equi-join on slabs of 2^SLAB seconds: a word is in the slab of its start, a segment of up to that length in the slabs that it touches, which are two at most. Longer ones
    are brought to the slabs that have words by bins that fit the segments: one of up to 2^k seconds is listed in the bins of that width that it touches, and a slab
    is looked up once in each width that its keys' segments have. Words are shuffled once. Segments without times, or that end before they start, hold nothing.
    """
    a, b = F.col("seg_start") - slack, F.col("seg_end") + slack
    level = F.greatest(F.lit(SLAB), F.ceil(F.log2(b - a))).cast("int")
    bin_of = lambda at, level: F.floor(at / F.pow(F.lit(2.0), level))
    segs = segments.where("seg_end >= seg_start").select(*keys, "seg_pos", "seg_start", "seg_end", level.alias("_level"))
    segs = segs.withColumn("_bin", F.explode(F.array_distinct(F.array(bin_of(a, F.col("_level")), bin_of(b, F.col("_level"))))))
    long, width = segs.where(F.col("_level") > SLAB), float(1 << SLAB)
    slab = bin_of(F.col("start"), F.lit(SLAB)).alias("_slab")
    levels = long.groupBy(*keys).agg(F.collect_set("_level").alias("_levels"))  # a few dozen at most
    slabs = words.select(*keys, slab).distinct().join(levels, keys).withColumn("_level", F.explode("_levels")).drop("_levels")
    slabs = slabs.withColumn("_bin", bin_of(F.col("_slab"), F.col("_level") - SLAB)).join(long, [*keys, "_level", "_bin"])
    slabs = slabs.where((a <= (F.col("_slab") + 1) * width) & (F.col("_slab") * width <= b))
    columns = [*keys, "_slab", "seg_pos", "seg_start", "seg_end"]
    held = segs.where(F.col("_level") == SLAB).withColumnRenamed("_bin", "_slab").select(*columns).unionByName(slabs.select(*columns))
    found = words.withColumn("_slab", slab).join(held, [*keys, "_slab"]).where((a <= F.col("start")) & (F.col("end") <= b))
    rest = [c for c in words.columns if c not in (*keys, "pos")]
    # a word has one slab, so its rows are together already
    return found.groupBy(*keys, "_slab", "pos").agg(F.min("seg_pos").alias("seg_pos"), *[F.first(c).alias(c) for c in rest]).drop("_slab")


def with_whole_texts(segments: DataFrame, payloads: DataFrame, keys: list[str]) -> DataFrame:
    """Payloads (keys, text, duration) that have a text and no segment become one segment each, from 0 to their duration."""
    alone = payloads.where(F.coalesce(F.col("text"), F.lit("")) != "").join(segments.select(*keys).distinct(), keys, "left_anti")
    whole = {"seg_pos": F.lit(0), "seg_start": F.lit(0.0), "seg_end": F.coalesce(F.col("duration"), F.lit(0.0)), "text": X.trim(F.col("text"))}
    return segments.unionByName(alone.select(*keys, *[v.cast(segments.schema[c].dataType).alias(c) for c, v in whole.items()]), allowMissingColumns=True)


def reconciled(segments: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """Words and text of each segment made to fit; keys name the segment. segments: keys, start, end, text; words: keys, pos, word, start, end.

    A text without words gets words in proportion to their lengths (A02), words without a text give it, joined as they stand; in all cases punctuation
    is attached to words (A01). Returns keys, text, words: an array of (pos, word, start, end), empty where there is neither.
    """
    has = words.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda s: s["word"]), "").alias("_joined"))
    both = segments.join(has, keys, "left")
    some = X.trim(F.coalesce("text", F.lit(""))) != ""
    bare = both.where(some & F.col("_joined").isNull()).select(*keys, F.col("start").alias("_a"), F.col("end").alias("_b"), X.white_split(F.col("text")).alias("_words"))
    made = synthesized(bare, "_words", "_a", "_b").select(*keys, "pos", "word", F.col("w_start").alias("start"), F.col("w_end").alias("end"))
    given = words.join(segments.select(*keys).distinct(), keys, "left_semi").select(*keys, F.col("pos").cast("long").alias("pos"), "word", "start", "end")
    rows = attach_punctuation(given.unionByName(made), keys)
    rows = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "word", "start", "end"))).alias("words"))
    empty = F.array().cast("array<struct<pos:bigint,word:string,start:double,end:double>>")
    return both.join(rows, keys, "left").select(*keys, F.when(some, F.col("text")).otherwise(F.coalesce("_joined", "text", F.lit(""))).alias("text"), F.coalesce("words", empty).alias("words"))


def gaps(df: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Numbers missing before a row."""
    return df.withColumn("missing", F.coalesce(F.greatest(F.col(seq) - F.lag(seq).over(Window.partitionBy(*keys).orderBy(seq)) - 1, F.lit(0)), F.lit(0)))
