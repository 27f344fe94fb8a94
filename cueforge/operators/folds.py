"""Folds over a video's rows in order, without a task that holds a whole video.

A video of up to CHUNK positions is folded whole. Longer ones are cut:

- into pieces, where a rule's state is known to start afresh (pieces());
- where it doesn't, into chunks of CHUNK positions. What a chunk does to the state is a small table, the tables of a video's
  chunks are gone through in order, and then each chunk is folded with the state that comes into it (packed()).

Keys may be null. `order` is a column of different integers in each video.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueforge.sources.shared import written

#: Positions of a video that one task folds together.
CHUNK = 1 << 16


def split_long(df: DataFrame, keys: list[str], order: str = "pos", size: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(rows of videos of up to `size` positions, rows of longer ones as a written table with `_chunk`); None where no video is longer."""
    size = size or CHUNK
    span = df.groupBy(*keys).agg((F.max(order) - F.min(order)).alias("_span")).where(F.col("_span") >= size).drop("_span")
    span = written(span, "long-videos")
    if span.isEmpty():
        return df, None
    long = written(joined(df, span, keys, "left_semi").withColumn("_chunk", F.floor(F.col(order) / size)), "long")
    return joined(df, span, keys, "left_anti"), long


def joined(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join by keys that may be null; the other side's keys go."""
    other = other.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return df.join(other, on, how).drop(*[f"__{k}" for k in keys])


#: Rows of whole videos that are folded together.
TOGETHER = 1 << 16


def in_order(df: DataFrame, keys: list[str], *steps: Callable[[pa.Table], pa.Table], order: str = "pos", schema: str | None = None) -> DataFrame:
    """The rows that the steps leave of many whole videos at a time, in order; `_new` marks the first row of each and must stay with it. Columns keep their types, or are those of `schema`.

    One pass over sorted partitions: the rows before are computed once, and no group of its own is handed over for a video.
    """
    rows = df.withColumn("_new", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) == 1)

    def run(batches):
        waiting, size = [], 0

        def folded():
            table = pa.Table.from_batches(waiting).combine_chunks()
            for step in steps:
                table = step(table)
            return table.combine_chunks().to_batches()

        for batch in batches:
            begins = np.flatnonzero(batch.column(batch.schema.get_field_index("_new")).to_numpy(zero_copy_only=False))
            if size >= TOGETHER and len(begins):
                # all before the last video that begins here is whole
                cut = int(begins[-1])
                if cut:
                    waiting.append(batch.slice(0, cut))
                yield from folded()
                waiting, size, batch = [], 0, batch.slice(cut)
            waiting.append(batch)
            size += batch.num_rows
        if size:
            yield from folded()

    return rows.mapInArrow(run, schema or rows.schema).drop("_new")


def begins(rows: pa.Table) -> np.ndarray:
    """The places where videos begin in a step of in_order()."""
    return np.flatnonzero(rows.column("_new").to_numpy())


def earlier(keys: list[str], by: str):
    """All rows of the key before this one."""
    return Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)


def later(keys: list[str], by: str):
    """All rows of the key after this one."""
    return Window.partitionBy(*keys).orderBy(by).rowsBetween(1, Window.unboundedFollowing)


def pieces(long: DataFrame, keys: list[str], fresh: Column, order: str = "pos") -> DataFrame:
    """The rows of a written table with `_piece`: in each chunk that has a row where `fresh` holds, the first of them begins a piece.

    `fresh` may use windows by the keys and `_chunk`; null is no.
    """
    chunk = [*keys, "_chunk"]
    marked = long.withColumn("_fresh", fresh).where("_fresh")
    begins = marked.groupBy(*chunk).agg(F.min(order).alias("_begin"))
    chunks = joined(long.groupBy(*chunk).agg(F.min(order).alias("_any")).drop("_any"), begins, chunk, "left")
    chunks = chunks.withColumn("_before", F.coalesce(F.last(F.when(F.col("_begin").isNotNull(), F.col("_chunk")), ignorenulls=True).over(earlier(keys, "_chunk")), F.lit(-1).cast("long")))
    piece = F.when(F.col(order) >= F.col("_begin"), F.col("_chunk")).otherwise(F.col("_before"))
    return joined(long, chunks, chunk).withColumn("_piece", piece).drop("_begin", "_before")


def by_pieces(df: DataFrame, keys: list[str], rule: Callable[[DataFrame, list[str]], DataFrame], fresh: Callable[[Window], Column], order: str = "pos", size: int | None = None) -> DataFrame:
    """rule(rows, keys) with long videos in pieces, which are keys of their own to the rule. fresh(window of a chunk in order): whether a row may begin one."""
    short, long = split_long(df, keys, order, size)
    if long is None:
        return rule(df, keys)
    cut = pieces(long, keys, fresh(Window.partitionBy(*keys, "_chunk").orderBy(order)), order).drop("_chunk")
    return rule(short, keys).unionByName(rule(cut, [*keys, "_piece"]).drop("_piece"))


class Packing:
    """Rows of integer weights go into groups, greedily in order.

    With `most`, a row joins while group + 1 + row is at most `most` (texts joined by one character). With `budget`, a group is full, and the next row begins another, once
    its weight reaches `budget`. The state between two rows is the weight of the open group, from 0 to `states` - 1; with `most`, `first` stands for none.
    """

    def __init__(self, most: int | None = None, budget: int | None = None):
        self.most, self.budget = most, budget
        self.states = most + 1 if budget is None else budget
        self.first = most if budget is None else 0

    def _jumps(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sum before each place, the place after the group that begins at each row); places beyond the end are n + 1 where the group stays open."""
        n = len(weights)
        if self.budget is None:
            total = np.append(0, np.cumsum(weights + 1))
            after = np.maximum(np.searchsorted(total, total[:-1] + self.most + 1, "right") - 1, np.arange(n) + 1)
            return total, np.where(after >= n, n + 1, after)
        total = np.append(0, np.cumsum(weights))
        after = np.searchsorted(total, total[:-1] + self.budget, "left")
        return total, after  # n + 1 where the sum is never reached

    def _entry(self, total: np.ndarray, states: np.ndarray) -> np.ndarray:
        """The place where the first new group begins, for each state before the rows; n + 1 where the open one goes on."""
        n = len(total) - 1
        if self.budget is None:
            at = np.searchsorted(total, self.most - states, "right") - 1
            return np.where(at >= n, n + 1, at)
        return np.where(states == 0, 0, np.searchsorted(total, self.budget - states, "left"))

    def table(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state after the rows, groups begun in them) for each state before them."""
        n = len(weights)
        total, after = self._jumps(weights)
        # of each beginning: the last group that begins in these rows, and how many do
        last, count = np.arange(n + 2), np.zeros(n + 2, np.int64)
        count[:n] = 1
        for k in range(n - 1, -1, -1):
            if after[k] < n:
                last[k] = last[after[k]]
                count[k] = count[after[k]] + 1
        entry = self._entry(total, np.arange(self.states))
        begun = entry < n
        start = last[np.where(begun, entry, n)]
        if self.budget is None:
            out = np.where(begun, np.minimum(total[n] - total[np.minimum(start, n)] - 1, self.most), np.minimum(np.arange(self.states) + total[n], self.most))
        else:
            # a group that ends with the rows leaves none open
            open_ = np.where(begun, total[n] - total[np.minimum(start, n)], np.arange(self.states) + total[n])
            out = np.where(open_ >= self.budget, 0, open_)
            out = np.where(entry == n, 0, out)
        return out, count[np.where(begun, entry, n)]

    def begins(self, weights: np.ndarray, state: int) -> np.ndarray:
        """Whether each row begins a group."""
        n = len(weights)
        total, after = self._jumps(weights)
        out = np.zeros(n, bool)
        at = int(self._entry(total, np.array([state]))[0])
        while at < n:
            out[at] = True
            at = int(after[at])
        return out


def packed(df: DataFrame, keys: list[str], weight: Column, packing: Packing, order: str = "pos", size: int | None = None) -> DataFrame:
    """The rows with `_group`, from 1 in each video: greedy packing by `weight` in order."""
    df = df.withColumn("_weight", weight.cast("long"))
    short, long = split_long(df, keys, order, size)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order).reset_index(drop=True)
        state, before = (int(rows["_state"][0]), int(rows["_groups"][0])) if "_state" in rows else (packing.first, 0)
        return rows.assign(_group=before + np.cumsum(packing.begins(rows["_weight"].to_numpy(), state)))

    schema = df.withColumn("_group", F.lit(0).cast("long")).schema
    out = short.groupBy(*keys).applyInPandas(fold, schema)
    if long is not None:
        # runs of states with one outcome: (first state, state after, groups)
        kinds = ", ".join(f"{k} {long.schema[k].dataType.simpleString()}" for k in [*keys, "_chunk"])

        def effect(rows: pd.DataFrame) -> pd.DataFrame:
            after, groups = packing.table(rows.sort_values(order)["_weight"].to_numpy())
            heads = np.flatnonzero(np.append(True, (after[1:] != after[:-1]) | (groups[1:] != groups[:-1])))
            return rows[[*keys, "_chunk"]].head(1).assign(_from=[heads], _after=[after[heads]], _begun=[groups[heads]])

        def entering(tables: pd.DataFrame) -> pd.DataFrame:
            tables = tables.sort_values("_chunk")
            state, groups, states, before = packing.first, 0, [], []
            for low, after, begun in zip(tables["_from"], tables["_after"], tables["_begun"], strict=True):
                states.append(state)
                before.append(groups)
                k = int(np.searchsorted(low, state, "right")) - 1
                state, groups = int(after[k]), groups + int(begun[k])
            return tables[[*keys, "_chunk"]].assign(_state=states, _groups=before)

        effects = long.select(*keys, "_chunk", order, "_weight").groupBy(*keys, "_chunk").applyInPandas(effect, f"{kinds}, _from array<bigint>, _after array<bigint>, _begun array<bigint>")
        states = effects.groupBy(*keys).applyInPandas(entering, f"{kinds}, _state bigint, _groups bigint")
        rows = joined(long, states, [*keys, "_chunk"])
        done = rows.groupBy(*keys, "_chunk").applyInPandas(lambda pdf: fold(pdf)[[*schema.names]], schema)
        out = out.unionByName(done)
    return out.drop("_weight")
