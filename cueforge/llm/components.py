"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, stored_at


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u moves to the smallest node next to u."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours move to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).union(moved)


def components(edges: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """(u, v): each node that is not its component's smallest, with the smallest. edges: columns u and v of one ordered type. The result's folder is added to `paths`."""
    spark = edges.sparkSession
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now, path = stored_at(edges.where("u <> v").distinct(), "edges")
    seen = state(now)
    while seen[0]:
        after, new_path = stored_at(_small_star(_large_star(now)).distinct(), "edges")
        discard(spark, path)
        now, path, before, seen = after, new_path, seen, state(after)
        if seen == before:
            break
    if paths is not None:
        paths.append(path)
    return now
