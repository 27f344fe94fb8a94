"""Sentences, clauses and length-bounded chunks.

Token tables have keys, `pos` (order within the keys) and `token`. Boundaries are found by windows over the keys, for
whole sentences over stretches of tokens without a boundary; what happens inside one sentence folds over its short array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueforge.functions import tables as T
from cueforge.functions import text as X
from cueforge.operators import folds
from cueforge.sources.shared import written


def _has_fence(text: str) -> Column:
    return X.is_fenced(F.col(text))


def _mixed_tokens(text: str, lang: str) -> Column:
    """Tokens of a text with fenced spans, which are one token each."""
    outside = F.split(F.col(text), f"(?s){X.FENCE}")
    spans = F.regexp_extract_all(F.col(text), F.lit(f"(?s)({X.FENCE})"), 1)
    return F.flatten(F.transform(outside, lambda part, k: F.concat(X.tokenize(part, lang), F.when(k < F.size(spans), F.array(F.get(spans, k))).otherwise(F.array().cast("array<string>")))))


def token_rows(segments: DataFrame, keys: list[str], text: str = "text", lang: str = "en") -> DataFrame:
    """Q01: one row per token, ordered by segment and place; fenced spans are one token each."""
    tokens = F.when(_has_fence(text), _mixed_tokens(text, lang)).otherwise(X.tokenize(F.col(text), lang))
    rows = segments.select(*segments.columns, F.posexplode(tokens).alias("tok_pos", "token"))
    return rows.withColumn("at", F.struct(F.col("pos").alias("seg_pos"), "tok_pos"))


def ends_sentence(token: Column, lang: str | Column = "en", script: str = "space") -> Column:
    """Q03: whether a sentence ends with the token: a terminator under closing quotes, but no ellipsis, acronym, abbreviation or initial."""
    quotes, ends = X.chars(T.CLOSING_QUOTES), X.chars(T.TERMINATORS[script])
    core = F.regexp_replace(token, f"[{quotes}]+$", "")
    word = F.regexp_replace(core, r"\.+$", "")
    if isinstance(lang, str):
        short = word.isin(*T.ABBREVIATIONS.get(lang, T.ABBREVIATIONS["en"]).split())
    else:
        short = word.isin(*T.ABBREVIATIONS["en"].split())
        for name, words in T.ABBREVIATIONS.items():
            if name != "en":
                short = F.when(lang == name, word.isin(*words.split())).otherwise(short)
    dot = F.endswith(core, F.lit("."))
    guarded = F.endswith(core, F.lit("...")) | (dot & (core.rlike(r"^(?:[A-Za-z]\.){2,}$") | short | word.rlike("^[A-Za-z]$")))
    # most tokens end no sentence and need no closer look
    return F.when(token.rlike(f"[{ends}][{quotes}]*$"), ~guarded).otherwise(F.lit(False))


def ends_clause(token: Column, script: str = "space") -> Column:
    return token.rlike(f"[{X.chars(T.SEPARATORS[script])}]$")


def with_groups(tokens: DataFrame, keys: list[str], boundary: Column, to: str = "sent_id", order: str = "at") -> DataFrame:
    """Q04: number groups that end at boundary tokens; closing quotes by themselves stay with the group before them."""
    w = Window.partitionBy(*keys).orderBy(order)
    lone = F.col("token").rlike(f"^[{X.chars(T.CLOSING_QUOTES)}]+$")
    tokens = tokens.withColumn("_lone", lone).withColumn("_end", F.when(~F.col("_lone"), boundary))
    before = F.coalesce(F.last("_end", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    tokens = tokens.withColumn("_new", F.when(before & ~F.col("_lone"), 1).otherwise(0))
    return tokens.withColumn(to, F.sum("_new").over(w)).drop("_lone", "_end", "_new")


def speaker_runs(rows: DataFrame, keys: list[str], speaker: str = "speaker", order: str = "pos", to: str = "run") -> DataFrame:
    """Q02: a new run whenever the speaker changes."""
    w = Window.partitionBy(*keys).orderBy(order)
    change = (~F.col(speaker).eqNullSafe(F.lag(speaker).over(w))) & (F.row_number().over(w) > 1)
    return rows.withColumn("_c", F.when(change, 1).otherwise(0)).withColumn(to, F.sum("_c").over(w)).drop("_c")


def collected(tokens: DataFrame, keys: list[str], group: str = "sent_id", order: str = "at", to: str = "tokens") -> DataFrame:
    """Q05: one row per group with its tokens in order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("token").alias("t"))))
    return tokens.groupBy(*keys, group).agg(F.transform(rows, lambda s: s["t"]).alias(to))


def stretches(segments: DataFrame, keys: list[str], text: str = "text", lang: str = "en") -> DataFrame:
    """Q01 for sentences: one row per stretch of a segment's tokens in which no sentence ends, with keys, at, its tokens and the last of them as `token`.

    Segments are cut behind every token whose last character ends sentences or closes quotes, and before lone closing quotes; those with fenced spans after each token.
    """
    quotes, ends = X.chars(T.CLOSING_QUOTES), X.chars(T.TERMINATORS["space"])
    spaced = F.coalesce(F.col(text), F.lit(""))
    cut = F.split(spaced if lang == "fr" else X.normalize_spacing(spaced), rf"(?U)(?<=[{ends}{quotes}])\s+|\s+(?=[{quotes}]+(?:\s|$))")
    plain = F.filter(F.transform(cut, X.white_split), lambda t: F.size(t) > 0)
    fenced = F.transform(_mixed_tokens(text, lang), lambda t: F.array(t))
    rows = segments.select(*keys, "pos", F.posexplode(F.when(_has_fence(text), fenced).otherwise(plain)).alias("tok_pos", "tokens"))
    return rows.select(*keys, F.struct(F.col("pos").alias("seg_pos"), "tok_pos").alias("at"), "tokens", F.element_at("tokens", -1).alias("token"))


def sentences(segments: DataFrame, keys: list[str], text: str = "text", lang: str | Column = "en", split_lang: str = "en", n_segments: str | None = None) -> DataFrame:
    """Q01, Q03-Q05: one row per sentence with its tokens in order; with `n_segments`, also how many segments begin in it. lang may be a column of the keys."""
    rows = with_groups(stretches(segments, keys, text, split_lang), keys, ends_sentence(F.col("token"), lang))
    tokens = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "tokens"))), lambda s: s["tokens"])).alias("tokens")
    more = [F.count_if(F.col("at.tok_pos") == 0).alias(n_segments)] if n_segments else []
    return rows.groupBy(*keys, "sent_id").agg(tokens, *more)


def fill_to_length(tokens: Column, most: int) -> Column:
    """Q07: greedy chunks of tokens whose joined length is at most `most`; a longer token is a chunk of its own. Array of strings."""
    if most <= 0:
        raise ValueError("the length must be positive")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now"))

    def step(acc, t):
        fits = F.length(acc["now"]) + 1 + F.length(t) <= most
        return F.when(acc["now"].isNull(), F.struct(acc["done"].alias("done"), t.alias("now"))).when(fits, F.struct(acc["done"].alias("done"), F.concat_ws(" ", acc["now"], t).alias("now"))).otherwise(
            F.struct(F.concat(acc["done"], F.array(acc["now"])).alias("done"), t.alias("now"))
        )

    return F.aggregate(tokens, start, step, lambda acc: F.when(acc["now"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))))


def merge_to_length(chunks: Column, most: int, separator: str = " ") -> Column:
    """Q08, Q09: adjacent chunks merge while the whole is at most `most`; a longer one stays as it is."""
    if most <= 0:
        raise ValueError("the length must be positive")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now"))

    def step(acc, c):
        joined = F.concat(acc["now"], F.when(F.startswith(c, F.lit(" ")) if separator else F.lit(True), "").otherwise(separator), c)
        return F.when(acc["now"].isNull(), F.struct(acc["done"].alias("done"), c.alias("now"))).when(F.length(joined) <= most, F.struct(acc["done"].alias("done"), joined.alias("now"))).otherwise(
            F.struct(F.concat(acc["done"], F.array(acc["now"])).alias("done"), c.alias("now"))
        )

    return F.aggregate(chunks, start, step, lambda acc: F.when(acc["now"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))))


def grouped(tokens: Column, ends) -> Column:
    """Token groups of one array that end where ends(token) is true, joined by spaces; lone closing quotes stay with the group before."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now"), F.lit(False).alias("ended"))
    lone = lambda t: t.rlike(f"^[{X.chars(T.CLOSING_QUOTES)}]+$")

    def step(acc, t):
        fresh = acc["ended"] & ~lone(t)
        return F.struct(
            F.when(fresh, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"),
            F.when(fresh | acc["now"].isNull(), t).otherwise(F.concat_ws(" ", acc["now"], t)).alias("now"),
            F.when(lone(t), acc["ended"]).otherwise(ends(t)).alias("ended"),
        )

    return F.aggregate(tokens, start, step, lambda acc: F.when(acc["now"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))))


def split_sentences(text: Column, lang: str = "en") -> Column:
    """Q10: sentences of a text."""
    return grouped(X.tokenize(text, lang), lambda t: ends_sentence(t, lang))


def split_clauses(text: Column, lang: str = "en", merge_under: int | None = None) -> Column:
    """Q06, Q10: clauses of a text; with merge_under, short neighbours merge."""
    out = grouped(X.tokenize(text, lang), lambda t: ends_sentence(t, lang) | ends_clause(t))
    return merge_to_length(out, merge_under) if merge_under else out


def split_by_length(text: Column, most: int, lang: str = "en") -> Column:
    """Q10: chunks of at most `most` characters."""
    return fill_to_length(X.tokenize(text, lang), most)


def at_connectives(text: Column, lang: str = "en", least: int = 5) -> Column:
    """Cut before connectives with `least` words on both sides."""
    words = T.CONNECTIVES.get(lang, "").split()
    if not words:
        return F.array(text)

    def cut(tokens):
        content = lambda t: F.when(X.strip_punctuation(t) != "", 1).otherwise(0)
        marks = F.transform(
            tokens,
            lambda t, i: F.struct(
                t.alias("t"), content(t).alias("c"),
                (F.lower(X.strip_punctuation(t)).isin(*words) & ~F.coalesce(F.get(tokens, i + 1).rlike("^['’]"), F.lit(False))).alias("k"),
            ),
        )

        def fold(rows):
            total = F.aggregate(rows, F.lit(0), lambda a, r: a + r["c"])
            start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("now"), F.lit(0).alias("since"), F.lit(0).alias("seen"))

            def step(acc, r):
                go = r["k"] & (acc["since"] >= least) & (total - acc["seen"] - r["c"] >= least)
                return F.struct(
                    F.when(go, F.concat(acc["done"], F.array(F.array_join(acc["now"], " ")))).otherwise(acc["done"]).alias("done"),
                    F.when(go, F.array(r["t"])).otherwise(F.concat(acc["now"], F.array(r["t"]))).alias("now"),
                    F.when(go, r["c"]).otherwise(acc["since"] + r["c"]).alias("since"),
                    (acc["seen"] + r["c"]).alias("seen"),
                )

            return F.aggregate(rows, start, step, lambda acc: F.when(F.size(acc["now"]) == 0, acc["done"]).otherwise(F.concat(acc["done"], F.array(F.array_join(acc["now"], " ")))))

        return X.let(marks, fold)

    return F.when(X.trim(text) == "", F.array(text)).otherwise(X.let(X.tokenize(text, lang), cut))


def records(tokens: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """Q12: one record per sentence: text, start and end from its segments' times, and the pieces by segment. tokens: token_rows with start, end and sent_id."""
    part = F.array_sort(F.collect_list(F.struct("tok_pos", "token")))
    pieces = tokens.groupBy(*keys, "sent_id", F.col("pos")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_join(F.transform(part, lambda s: s["token"]), " ").alias("text"))
    rows = F.array_sort(F.collect_list(F.struct("pos", "start", "end", "text")))
    out = pieces.groupBy(*keys, "sent_id").agg(F.min("start").alias("start"), F.max("end").alias("end"), rows.alias("segments"))
    out = out.withColumn("src_text", F.array_join(F.transform("segments", lambda s: s["text"]), " "))
    return out.where(X.trim(F.col("src_text")) != "")


def exploded(df: DataFrame, chunks: Column, to: str = "chunk") -> DataFrame:
    """Q15: one row per chunk, each with its parent's columns."""
    return df.select("*", F.posexplode(chunks).alias("chunk_pos", to))


def cascade(df: DataFrame, text: str, most: int, stages: list) -> DataFrame:
    """Each stage (a Column -> array function) sees only the chunks that are still too long. Adds chunk and path (its order)."""
    now = df.select("*", F.col(text).alias("chunk"), F.array(F.lit(0)).alias("path"))
    rest = [c for c in now.columns if c not in ("chunk", "path")]
    for stage in stages:
        long = F.coalesce(F.length("chunk") > most, F.lit(False))
        parts = F.when(long, stage(F.col("chunk"))).otherwise(F.array("chunk"))
        path = F.when(F.col("_long"), F.concat("path", F.array("_k"))).otherwise(F.col("path"))
        now = now.select(*rest, "path", long.alias("_long"), F.posexplode(parts).alias("_k", "chunk")).select(*rest, "chunk", path.alias("path"))
    return now


def bisected(df: DataFrame, text: str, most: int, split, depth: int = 4) -> DataFrame:
    """Too long chunks are split in two by split(Column) -> array, at most `depth` times, and then by length."""
    return cascade(df, text, most, [split] * depth + [lambda c: split_by_length(c, most)])


def halves(text: Column) -> Column:
    """A splitter for bisected(): at the space nearest to the middle."""
    words = X.white_split(text)

    def cut(w):
        n = F.size(w)
        half = F.ceil(n / 2).cast("int")
        return F.when(n < 2, F.array(text)).otherwise(F.array(F.array_join(F.slice(w, F.lit(1), half), " "), F.array_join(F.slice(w, half + 1, n), " ")))

    return X.let(words, cut)


def gated_chunks(source: Column, proposal: Column, most: int) -> Column:
    """The proposed chunks if the text is too long and they rebuild it, else the text."""
    ok = (F.length(source) > most) & (F.size(proposal) > 0) & X.rebuilds(proposal, source)
    return F.when(F.coalesce(ok, F.lit(False)), proposal).otherwise(F.array(source))


def gated_punctuation(source: Column, restored: Column, threshold: int = 0) -> Column:
    """The restored text if only its punctuation changed, with dotted words and the source's final marks kept."""
    use = (X.trim(source) != "") & (F.length(source) >= threshold) & X.punctuation_only_change(source, restored)
    return F.when(F.coalesce(use, F.lit(False)), X.keep_trailing(source, X.protect_dotted(source, restored))).otherwise(source)


def by_language(lang: Column, backends: dict) -> Column:
    """Backends by language; `*` is for all others."""
    out = None
    for name, value in backends.items():
        if name != "*":
            out = F.when(lang == name, value) if out is None else out.when(lang == name, value)
    last = backends.get("*")
    return last if out is None else out.otherwise(last) if last is not None else out


def merged_records(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Q16: neighbours of a video merge while a + 1 + b is at most `most`; the second one's segments aren't kept. A null text counts as empty."""
    text = F.coalesce("src_text", F.lit(""))
    # records are costly to make and read twice
    rows = folds.packed(written(df, "records"), keys, F.length(text), folds.Packing(most=most))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", text.alias("text")))), lambda s: s["text"])
    first = {c: F.min_by(c, "pos") for c in df.columns if c not in (*keys, "pos")} | {"src_text": F.array_join(parts, " "), "end": F.max_by("end", "pos")}
    return rows.groupBy(*keys, "_group").agg(F.min("pos").alias("pos"), *[v.alias(c) for c, v in first.items()]).select(*df.columns)


def cached_transform(df: DataFrame, text: str, cache: DataFrame, apply) -> tuple[DataFrame, DataFrame]:
    """(rows with one row per result of their text, the grown cache). apply: DataFrame(text) -> DataFrame(text, result array); only texts that the cache lacks reach it. An empty result deletes the row."""
    wanted = df.select(F.col(text).alias("text")).where(F.col(text).isNotNull()).distinct()
    fresh = apply(wanted.join(cache.select("text"), "text", "left_anti")).select("text", "result")
    grown = cache.select("text", "result").unionByName(fresh)
    out = df.join(grown.withColumnRenamed("text", text), text, "left").select(*df.columns, F.explode("result").alias("out"))
    return out, grown


def rebalanced(words: Column, lengths_ratio: Column, most: int) -> Column:
    """Where to cut an array of words so that the parts' lengths come nearest to the ratio, both within `most`; null if nowhere."""
    n = F.size(words)

    def scored(i):
        left, right = F.length(F.array_join(F.slice(words, F.lit(1), i), " ")), F.length(F.array_join(F.slice(words, i + 1, n), " "))
        return F.when((left <= most) & (right <= most) & (right > 0), F.struct(F.abs(lengths_ratio - left / right).alias("score"), i.alias("i")))

    best = F.array_min(F.filter(F.transform(F.sequence(F.lit(1), n - 1), scored), lambda s: s.isNotNull()))
    return F.when(n >= 2, best["i"])
