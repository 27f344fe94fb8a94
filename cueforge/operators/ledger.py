"""Usage ledgers, budgets and operational counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Daily limits of tiers: (deny at, share of it at which to warn).
WARN_SHARE = 0.8


def usage_sum(df: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens, cost (null only if all are), requests; the model if there is one besides the empty name, else empty."""
    named = F.nullif(F.col("model"), F.lit(""))
    return df.groupBy(*keys).agg(
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum("cost_usd").alias("cost_usd"), F.sum("requests").alias("requests"),
        F.when(F.min(named) == F.max(named), F.max(named)).otherwise("").alias("model"),
    )


def counted(df: DataFrame) -> DataFrame:
    """Events that a ledger counts: with a cost or with tokens."""
    return df.where(F.col("cost_usd").isNotNull() | (F.col("prompt_tokens") + F.col("completion_tokens") > 0)).withColumn("day", F.to_date("ts"))


def daily_ledger(df: DataFrame) -> DataFrame:
    """Per user and day, with cost by model (only priced events with a model)."""
    rows = counted(df)
    priced = F.col("cost_usd").isNotNull() & (F.col("model") != "")
    by_model = rows.groupBy("user_id", "day", "model").agg(
        F.sum("prompt_tokens").alias("p"), F.sum("completion_tokens").alias("c"), F.sum("cost_usd").alias("cost"), F.sum("requests").alias("r"), F.sum(F.when(priced, F.col("cost_usd"))).alias("m"),
    )
    return by_model.groupBy("user_id", "day").agg(
        F.sum("p").alias("prompt_tokens"), F.sum("c").alias("completion_tokens"), F.sum("cost").alias("cost_usd"), F.sum("r").alias("requests"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("m").isNotNull(), F.struct("model", "m"))))).alias("by_model"),
    )


def usage_summary(ledger: DataFrame) -> DataFrame:
    """Users, totals, and totals by model (model null: all)."""
    total = ledger.agg(F.lit(None).cast("string").alias("model"), F.count_distinct("user_id").alias("users"), F.sum("cost_usd").alias("cost_usd"))
    models = ledger.select("user_id", F.explode("by_model").alias("model", "c")).groupBy("model").agg(F.count_distinct("user_id").alias("users"), F.sum("c").alias("cost_usd"))
    return total.unionByName(models)


def top_users(ledger: DataFrame, n: int = 10) -> DataFrame:
    """The users of highest cost."""
    return ledger.groupBy("user_id").agg(F.sum("cost_usd").alias("cost_usd"), F.sum("requests").alias("requests")).orderBy(F.desc_nulls_last("cost_usd"), "user_id").limit(n)


def budget_decisions(df: DataFrame, tiers: DataFrame) -> DataFrame:
    """For each event: ok, soft_warn or deny, from the day's cost so far with this one. tiers: tier, daily_usd; events carry tier and byok (own key: always ok)."""
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    so_far = F.sum(F.greatest(F.coalesce("cost_usd", F.lit(0.0)), F.lit(0.0))).over(w)
    rows = df.withColumn("projected", so_far).join(tiers, "tier", "left")
    verdict = F.when(F.col("byok") | F.col("daily_usd").isNull(), "ok").when(F.col("projected") >= F.col("daily_usd"), "deny").when(F.col("projected") >= WARN_SHARE * F.col("daily_usd"), "soft_warn")
    return rows.withColumn("decision", verdict.otherwise("ok"))


def admissions(log: DataFrame) -> DataFrame:
    """U16: per tenant: submitted, granted, rejected, seconds waited, still active. log: tenant, event, waited."""
    n = lambda e: F.count_if(F.col("event") == e)
    return log.groupBy("tenant").agg(
        n("submitted").alias("submitted"), n("granted").alias("granted"), n("rejected").alias("rejected"),
        F.sum(F.when(F.col("event") == "granted", F.col("waited")).otherwise(0)).alias("wait_sum"), F.greatest(n("granted") - n("released"), F.lit(0)).alias("active"),
    )


def counters(df: DataFrame, labels: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Events and sums by labels, and how many values are at most each bound."""
    return df.groupBy(*labels).agg(F.count("*").alias("n"), F.sum(value).alias("total"), *[F.count_if(F.col(value) <= b).alias(f"le_{str(b).replace('.', '_')}") for b in bounds])


def last_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """U18, O4."""
    return df.orderBy(*order).limit(n)


def latest(df: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """The last snapshot of each key, with counters of what was seen."""
    return df.groupBy(key).agg(F.max_by(value, at).alias(value), F.max(at).alias(at), F.count("*").alias("seen"))


def progress(df: DataFrame, key: str) -> DataFrame:
    """Done, cache hits, failures and average duration. Columns: status, duration."""
    n = lambda s: F.count_if(F.col("status") == s)
    return df.groupBy(key).agg(n("done").alias("done"), n("cached").alias("cache_hits"), n("failed").alias("failures"), F.avg(F.when(F.col("status") == "done", F.col("duration"))).alias("avg_duration"))


def first_seen(df: DataFrame, keys: list[str], value: str, order: str = "pos") -> DataFrame:
    """Different values in the order in which they first appear."""
    firsts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(order).alias("o"))
    return firsts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", value))), lambda s: s[value]).alias(value + "s"))
