"""Choosing among translations, contexts, terms, alignment, summaries and speech plans.

Model calls aren't made here: attempts and replies are tables.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from cueforge.functions import text as X
from cueforge.operators import folds
from cueforge.operators.align import repaired_pair
from cueforge.sources.shared import written


def first_accepted(attempts: DataFrame, keys: list[str], attempt: str = "attempt", passed: str = "passed") -> DataFrame:
    """The first attempt that passed, else the last one; with the number of attempts."""
    p = F.col(passed)
    w = Window.partitionBy(*keys)
    order = w.orderBy((~p).asc(), F.when(p, F.col(attempt)).asc(), F.col(attempt).desc())
    return attempts.withColumns({"_k": F.row_number().over(order), "attempts": F.count("*").over(w)}).where("_k = 1").drop("_k")


def prompt_form(attempt: Column) -> Column:
    """The prompt shrinks from attempt to attempt (counted from 0)."""
    return F.when(attempt <= 0, "full").when(attempt == 1, "compressed").when(attempt == 2, "minimal").otherwise("bare")


def prompt_text(form: Column, system: Column, context: Column, source: Column) -> Column:
    """The request for each form."""
    whole = F.concat_ws("\n\n", system, context, source)
    return F.when(form == "full", whole).when(form == "compressed", F.concat_ws("\n\n", system, source)).when(form == "minimal", F.concat_ws("\n", F.substring(system, 1, 200), source)).otherwise(source)


def context_window(rows: DataFrame, keys: list[str], order: Column, accepted: Column, pair: str, size: int = 4, evict: float = 0.5) -> DataFrame:
    """The accepted pairs that each row sees. When the window overflows, the oldest max(int(size * evict), 1) go at once."""
    drop = max(int(size * evict), 1)
    w = Window.partitionBy(*keys).orderBy(order)
    rows = rows.withColumn("_o", order).withColumn("_ok", F.coalesce(accepted, F.lit(False)))
    before = F.coalesce(F.sum(F.when(F.col("_ok"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_n", before.cast("long"))
    span = Window.partitionBy(*keys).orderBy("_n").rangeBetween(-size, -1)
    seen = F.array_sort(F.collect_list(F.when(F.col("_ok"), F.struct(F.col("_n").alias("n"), F.col(pair).alias("p")))).over(span))
    have = F.when(F.col("_n") <= size, F.col("_n")).otherwise((size + 1 - drop) + F.pmod(F.col("_n") - size - 1, F.lit(drop)))
    recent = F.filter(seen, lambda s: s["n"] >= F.col("_n") - have)
    return rows.withColumn("context", F.transform(recent, lambda s: s["p"])).drop("_o", "_ok", "_n")


def few_shot(terms: Column) -> Column:
    """Term pairs (array of struct src, dst) as a primer and one pair, or two pairs from 8 terms on (5 and the rest)."""
    lines = lambda t: F.struct(F.array_join(F.transform(t, lambda x: x["src"]), "\n").alias("src"), F.array_join(F.transform(t, lambda x: x["dst"]), "\n").alias("dst"))
    n = F.size(terms)
    none = F.array().cast("array<struct<src:string,dst:string>>")
    return F.when(n == 0, none).when(n < 8, F.array(lines(terms))).otherwise(F.array(lines(F.slice(terms, F.lit(1), F.lit(5))), lines(F.slice(terms, F.lit(6), n))))


def routed(rows: DataFrame, direct: DataFrame, text: str, longest: int) -> DataFrame:
    """Route `blank`, `too_long`, `direct` (the dictionary has the text, whatever its case; `target` says as what) or `model`."""
    known = direct.groupBy("key").agg(F.min("target").alias("target"))
    out = rows.withColumn("key", F.lower(text)).join(known, "key", "left").drop("key")
    t = F.col(text)
    return out.withColumn("route", F.when(F.trim(t) == "", "blank").when(F.length(t) > longest, "too_long").when(F.col("target").isNotNull(), "direct").otherwise("model"))


def uncached(work: DataFrame, translations: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose key has no translation that isn't empty."""
    return work.join(translations.where(F.trim("text") != "").select(*keys), keys, "left_anti")


def chosen(translations: DataFrame, keys: list[str], selected: Column, default: Column) -> DataFrame:
    """The selected variant's text, else the default variant's, else the first (by ins_seq)."""
    t = translations.withColumns({"_s": F.coalesce(F.col("variant") == selected, F.lit(False)), "_d": F.coalesce(F.col("variant") == default, F.lit(False))})
    pick = lambda c: F.min_by(F.when(F.col(c), F.col("text")), F.when(F.col(c), F.col("ins_seq")))
    return t.groupBy(*keys).agg(F.coalesce(pick("_s"), pick("_d"), F.min_by("text", "ins_seq")).alias("chosen"))


def with_variant(bucket: Column, variant: Column, text: Column) -> Column:
    """The map with one variant set, the others as they were."""
    return F.map_concat(F.map_filter(bucket, lambda k, v: k != variant), F.map_from_arrays(F.array(variant), F.array(text)))


def default_prompt(pairs: DataFrame, prompts: DataFrame) -> DataFrame:
    """The system prompt of each language pair, with a line for topic and field where there are any. The prompt table has one row per pair."""
    out = pairs.join(prompts.select("src_lang", "tgt_lang", "prompt"), ["src_lang", "tgt_lang"], "left")
    line = F.concat_ws(", ", F.concat(F.lit("Topic: "), F.col("topic")), F.concat(F.lit("Field: "), F.col("field")))
    return out.withColumn("system", F.concat_ws("\n", F.coalesce("prompt", F.lit("Translate.")), F.nullif(line, F.lit("")))).drop("prompt")


def all_terms(provider: DataFrame, user: DataFrame, keys: list[str]) -> DataFrame:
    """X11: the provider's pairs first, then the user's, in their orders, none removed."""
    both = provider.withColumn("rank", F.lit(0)).unionByName(user.withColumn("rank", F.lit(1)))
    rows = F.array_sort(F.collect_list(F.struct("rank", "ord", "src", "dst")))
    return both.groupBy(*keys).agg(F.transform(rows, lambda r: F.struct(r["src"].alias("src"), r["dst"].alias("dst"))).alias("terms"))


# --- alignment ---


def decision(ratio: Column, norm: float, accept: float) -> Column:
    """Accept up to `norm`, rearrange below `accept`, else reject."""
    return F.when(ratio <= norm, "accept").when(ratio < accept, "rearrange").otherwise("reject")


def _pieces(segments: list[str], text: str) -> list[str]:
    """A text over its segments: cut in two again and again at the best balanced boundary and the space nearest to its share."""
    if len(segments) <= 1:
        return [text] * len(segments)
    lengths = [len(x) for x in segments]
    total, done, ranked = sum(lengths), 0, []
    for k in range(1, len(segments)):
        done += lengths[k - 1]
        ranked.append(((1 if segments[k - 1].rstrip()[-1:] in set(".!?,;:—") else 10**9) * abs(2 * done - total), k, done))
    _, k, left = min(ranked)
    words = text.split()
    if len(words) < 2:
        return [text] + [""] * (len(segments) - 1)
    ends, at = [], -1
    for w in words[:-1]:
        at += len(w) + 1
        ends.append(at)
    cut = min(range(len(ends)), key=lambda j: abs(ends[j] - left / max(total, 1) * len(text))) + 1
    return _pieces(segments[:k], " ".join(words[:cut])) + _pieces(segments[k:], " ".join(words[cut:]))


@F.pandas_udf(ArrayType(StringType()))
def _aligned(segments: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([None if s is None else _pieces(list(s), t or "") for s, t in zip(segments, texts, strict=True)])


def aligned(rows: DataFrame, key: str) -> DataFrame:
    """`pieces` of each translation, one per source segment. rows: key, segments (array of texts), translation.

    No segment gives none and one takes the whole; what can't be split stays on its first segment.
    """
    whole = F.when(F.size("segments") == 1, F.array("translation")).when(F.size("segments") == 0, F.array().cast("array<string>"))
    several = F.size("segments") > 1
    return rows.select(key, F.coalesce(whole, _aligned(F.when(several, F.col("segments")), F.when(several, F.col("translation")))).alias("pieces"))


def bisected_groups(rows: DataFrame, proposals: DataFrame, keys: list[str], norm: float, accept: float, short: int = 2) -> DataFrame:
    """Translations cut over their segments in two again and again, as replies propose: keys, low, high, text, decision, one row per group that is left.

    rows: keys, segments (array of texts), translation; proposals: keys, low, high, cut, attempt, left, right: a reply for the segments from `low` to before `high`, cut before
    `cut`. A reply counts if it makes up the group's text, or can be put right so (L20), and its lengths and those of the source are in proportion (L19, `decision`). Of those that count
    the best balanced cut (L17) and then the first attempt is taken. Two segments of which one has at most `short` characters aren't cut.

    The groups that can still be cut are a table that is joined with the proposals, round by round, until it is empty; each round cuts every group that has a reply, and a group
    without one is done. `decision` is that of the cut that made the group (null: never cut); groups of several segments are those that no reply could cut.
    """
    group = [*keys, "low", "high"]
    n = F.size("_texts")
    start = rows.where((F.size("segments") > 0) & (X.trim(F.coalesce("translation", F.lit(""))) != ""))
    open_ = start.select(*keys, F.lit(0).alias("low"), F.size("segments").alias("high"), F.col("translation").alias("text"), F.col("segments").alias("_texts"), F.lit(None).cast("string").alias("decision"))
    open_, done = written(open_, "frontier"), []
    may = (n > 1) & ~((n == 2) & (F.least(F.length(F.get("_texts", F.lit(0))), F.length(F.get("_texts", F.lit(1)))) <= short))
    while True:
        done.append(open_.where(~may).select(*group, "text", "decision"))
        asked = open_.where(may)
        if asked.isEmpty():
            break
        tried = asked.join(proposals.where((F.col("cut") > F.col("low")) & (F.col("cut") < F.col("high"))), group)
        tried = tried.select(*asked.columns, "cut", "attempt", repaired_pair(F.array("left", "right"), F.col("text")).alias("_pair")).where("_pair is not null")
        own = F.col("cut") - F.col("low")
        a, b = F.array_join(F.slice("_texts", F.lit(1), own), " "), F.array_join(F.slice("_texts", own + 1, n), " ")
        ratio = X.cross_ratio(F.length(a), F.length(F.col("_pair")[0]), F.length(b), F.length(F.col("_pair")[1]))
        tried = tried.withColumn("_how", decision(ratio, norm, accept)).where("_how <> 'reject'").withColumn("_rank", F.array_position(X.split_candidates(F.col("_texts")), own))
        best = tried.groupBy(*group).agg(F.min_by(F.struct("cut", "_pair", "_how"), F.struct("_rank", "attempt")).alias("b"))
        cut = written(asked.join(best, group, "left"), "cut")
        done.append(cut.where("b is null").select(*group, "text", "decision"))
        halves = F.array(
            F.struct(F.col("low").alias("low"), F.col("b.cut").alias("high"), F.col("b._pair")[0].alias("text"), F.slice("_texts", F.lit(1), F.col("b.cut") - F.col("low")).alias("_texts")),
            F.struct(F.col("b.cut").alias("low"), F.col("high").alias("high"), F.col("b._pair")[1].alias("text"), F.slice("_texts", F.col("b.cut") - F.col("low") + 1, n).alias("_texts")),
        )
        parts = cut.where("b is not null").select(*keys, F.explode(halves).alias("h"), F.col("b._how").alias("decision"))
        open_ = written(parts.select(*keys, "h.low", "h.high", "h.text", "h._texts", "decision"), "frontier")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def pieces_of(groups: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pieces, rearranged: one text per segment out of bisected_groups(), a group's text on its first segment and the others empty; how many groups want their source rearranged."""
    padded = F.concat(F.array("text"), F.array_repeat(F.lit(""), F.col("high") - F.col("low") - 1))
    rows = groups.select(*keys, "low", "decision", padded.alias("_p"))
    parts = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("low", "_p"))), lambda s: s["_p"]))
    return rows.groupBy(*keys).agg(parts.alias("pieces"), F.count_if(F.col("decision") == "rearrange").alias("rearranged"))


# --- summaries, terms and speech ---


def summary_windows(rows: DataFrame, keys: list[str], budget: int = 4500, longest: int = 12000) -> DataFrame:
    """Per video, texts gather until their words reach the budget; each full window is a version with its body cut to `longest` characters. Blank texts don't count; one without spaces counts half its characters."""
    some = rows.select(*keys, F.col("pos").cast("long").alias("pos"), "text").where(X.trim(F.col("text")) != "")
    words = F.size(X.white_split(F.col("text")))
    some = some.withColumn("_n", F.when(words > 1, words).otherwise(F.greatest(F.lit(1), F.expr("length(text) div 2"))).cast("long"))
    found = folds.packed(some, keys, F.col("_n"), folds.Packing(budget=budget))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), "\n")
    windows = found.groupBy(*keys, F.col("_group").cast("int").alias("version")).agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.sum("_n").alias("words"), F.substring(body, 1, longest).alias("body"))
    return windows.where(F.col("words") >= budget)


def reusable_summaries(current: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Current rows whose config_sig is the stored one and whose summary has a version."""
    return current.join(stored.where("version > 0").select(*keys, "config_sig", "version"), [*keys, "config_sig"])


def term_trigger(rows: DataFrame, keys: list[str], chars: int = 2000) -> DataFrame:
    """The first position at which so many characters are reached."""
    w = Window.partitionBy(*keys).orderBy("pos")
    return rows.withColumn("_n", F.sum(F.length("text")).over(w)).where(F.col("_n") >= chars).groupBy(*keys).agg(F.min("pos").alias("pos"))


def corpus_block(rows: DataFrame, keys: list[str], longest: int = 8000) -> DataFrame:
    """A video's texts that aren't blank, joined by line ends and cut."""
    part = F.array_sort(F.collect_list(F.when(F.trim("text") != "", F.struct("pos", "text"))))
    return rows.groupBy(*keys).agg(F.substring(F.array_join(F.transform(part, lambda s: s["text"]), "\n"), 1, longest).alias("block"))


def speech_pieces(rows: DataFrame) -> DataFrame:
    """Pieces to speak: a record's aligned pieces (column `pieces`, if there is one), else its whole text; blanks go. The stem names the sound file."""
    if "pieces" in rows.columns:
        rows = rows.select("*", F.posexplode("pieces").alias("k", "piece"))
    else:
        rows = rows.withColumns({"k": F.lit(0), "piece": F.col("text")})
    return rows.where(F.trim("piece") != "").withColumn("stem", F.format_string("%s_%06d_%02d", F.col("video").cast("string"), F.col("pos").cast("long"), F.col("k").cast("int")))


def with_voice(pieces: DataFrame, plan: DataFrame, voices: DataFrame, default: str | None = None) -> DataFrame:
    """The speaker's own voice, else the first of its gender, else the default, else the first voice. plan: speaker, voice, gender; voices: voice, gender, ord."""
    first = voices.groupBy("gender").agg(F.min_by("voice", "ord").alias("by_gender"))
    any_voice = voices.agg(F.min_by("voice", "ord").alias("any_voice"))
    plan = plan.join(first, "gender", "left").select("speaker", F.coalesce("voice", "by_gender").alias("_v"))
    out = pieces.join(plan, "speaker", "left").crossJoin(F.broadcast(any_voice))
    return out.withColumn("voice", F.coalesce("_v", F.lit(default).cast("string"), "any_voice")).drop("_v", "any_voice")
