"""Benchmark decontamination with suffix arrays over the training text.

The training documents are cut into shards of SHARD_BYTES of text, a longer document being a shard of its own. Each
shard gets the suffix array of all its words: positions ordered by the words that follow in their document, first by as
many words as fit into a 64-bit key, then by doubling for the positions that are still equal. Every window of a test
item is binary-searched in it, level by level of the same keys, which gives the range of suffixes that begin with the
window, and so its places. Runs of successive places are the longest verbatim matches.

Words are compared by 64-bit hashes. Null and empty texts have no words; items without words match
nothing. The words of an item without an id count as hit, but the list of items leaves it out. Repeated rows are
judged each for itself, repeated items once; a window that many items share is searched once. Empty tables work. Extra
columns pass through; the columns that this operator adds replace columns of the same name. The test items are read in
blocks of about BLOCK_BYTES of text. Only one block is broadcast at a time: where there are several, the documents
are written with their hits after each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .store import keeping_columns, stored

WIDTH = 13
#: Share of a document's words that has to lie in matches, as one in SHARE.
SHARE = 20
BLOCK_BYTES = 16 << 20
SHARD_BYTES = 1 << 20


class Items:
    """One block of test items: their different windows as words, and which items have each."""

    def __init__(self, rows: list[tuple], width: int):
        texts = pa.array([t for _, t in rows], pa.string())
        data, offsets = W.text_bytes(texts, lower=True)
        starts, ends, first = W.find_words(data, offsets, W.NOT_ALNUM)
        self.ids = [i for i, _ in rows]
        hashes = W.hash_words(data, starts, ends)
        self.known, words = np.unique(hashes, return_inverse=True)
        counts = np.diff(first)
        lengths = np.minimum(counts, width)
        n_windows = np.where(counts > 0, counts - lengths + 1, 0)
        at = W.ragged(first[:-1], n_windows)
        item = np.repeat(np.arange(len(rows)), n_windows)
        each = np.repeat(lengths, n_windows)
        name = np.zeros(len(at), np.uint64)
        for k in set(lengths.tolist()) - {0}:
            name[each == k] = W.hash_windows(hashes, k)[at[each == k]]
        _, head, kind = np.unique(name, return_index=True, return_inverse=True)
        self.widths = each[head]
        places = at[head][:, None] + np.arange(width)
        inside = np.arange(width) < self.widths[:, None]
        self.words = np.where(inside, words[np.minimum(places, max(len(words) - 1, 0))] if len(words) else -1, -1)
        # the items and places in them of each window, window by window
        order = np.argsort(kind, kind="stable")
        self.item, self.offset = item[order], (at - first[:-1][item])[order]
        self.begin = np.searchsorted(kind[order], np.arange(len(head) + 1))


class SuffixArray:
    """All suffixes of a shard's documents in the order of their words, those that go on after a shorter equal one."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray):
        n = len(hashes)
        self.known, ids = np.unique(hashes, return_inverse=True)
        self.bits = max(1, len(self.known).bit_length())
        self.step = 63 // self.bits
        self.room = np.repeat(first[1:], np.diff(first)) - np.arange(n)
        # keys of `step` words, zeros after the end of a document
        self.keys = np.zeros(n, np.int64)
        for k in range(self.step):
            self.keys <<= self.bits
            self.keys[: max(n - k, 0)] |= np.where(self.room[: max(n - k, 0)] > k, ids[k:] + 1, 0)
        order = np.argsort(self.keys, kind="stable")
        ordered = self.keys[order]
        place = np.arange(n)
        heads = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if n else place
        sizes = np.diff(np.append(heads, n))
        rank = np.zeros(n, np.int64)
        rank[order] = np.repeat(heads, sizes)
        depth = self.step
        open_ = np.flatnonzero((np.repeat(sizes, sizes) > 1) & (self.room[order] >= depth))
        while len(open_):
            at = order[open_]
            group = rank[at]
            following = np.where(self.room[at] > depth, rank[np.minimum(at + depth, n - 1)] + 1, 0)
            by = np.lexsort((following, group))
            at, group, following = at[by], group[by], following[by]
            order[open_] = at
            heads = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (following[1:] != following[:-1])))
            sizes = np.diff(np.append(heads, len(at)))
            rank[at] = np.repeat(open_[heads], sizes)
            depth *= 2
            open_ = open_[(np.repeat(sizes, sizes) > 1) & (self.room[at] >= depth)]
        self.order = order

    def ranges(self, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, low, high): the ranges of suffixes that begin with each window that occurs."""
        at = np.searchsorted(self.known, items.known)
        at[at == len(self.known)] = 0
        ids = np.append(np.where(self.known[at] == items.known, at + 1, 0), 0)
        window = np.flatnonzero((ids[items.words] > 0).sum(axis=1) == items.widths)
        low, high = np.zeros(len(window), np.int64), np.full(len(window), len(self.order))
        done, level = np.zeros(len(window), bool), 0
        found = []
        while len(window):
            words = ids[items.words[window, level : level + self.step]]
            least, most = np.zeros(len(window), np.int64), np.zeros(len(window), np.int64)
            for k in range(self.step):
                has = (level + k < items.widths[window]) if k < words.shape[1] else np.zeros(len(window), bool)
                word = words[:, k] if k < words.shape[1] else 0
                least = least << self.bits | np.where(has, word, 0)
                most = most << self.bits | np.where(has, word, (1 << self.bits) - 1)
            low, high = self._bound(level, low, high, least, False), self._bound(level, low, high, most, True)
            level += self.step
            done = items.widths[window] <= level
            hit = high > low
            found.append((window[done & hit], low[done & hit], high[done & hit]))
            window, low, high = (x[~done & hit] for x in (window, low, high))
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate([none, *part]) for part in zip(*found, strict=True)) if found else (none, none, none)

    def _bound(self, level, low, high, key, after):
        """The first place of each range whose key at that level isn't below `key`, or with `after` is above it."""
        if level == 0:
            if not hasattr(self, "first_keys"):
                self.first_keys = self.keys[self.order]
            return np.searchsorted(self.first_keys, key, "right" if after else "left")
        low, high = low.copy(), high.copy()
        while len(todo := np.flatnonzero(low < high)):
            middle = (low[todo] + high[todo]) // 2
            at = self.order[middle]
            here = np.where(self.room[at] > level, self.keys[np.minimum(at + level, len(self.keys) - 1)], 0)
            below = here <= key[todo] if after else here < key[todo]
            low[todo] = np.where(below, middle + 1, low[todo])
            high[todo] = np.where(below, high[todo], middle)
        return low


def matches(items: Items, data, offsets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word position in the shard, window, first word of each row) of every window's occurrences."""
    starts, ends, first = W.find_words(data, offsets, W.NOT_ALNUM)
    none = np.zeros(0, np.int64)
    if not len(items.widths) or not len(starts):
        return none, none, first
    shard = SuffixArray(W.hash_words(data, starts, ends), first)
    window, low, high = shard.ranges(items)
    return shard.order[W.ragged(low, high - low)], np.repeat(window, high - low), first


def _item_blocks(bench: DataFrame, limit: int):
    bench = bench.where(F.col("text").isNotNull()).select("item_id", "text").distinct()
    total = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // limit))
    for k in range(n):
        part = bench if n == 1 else bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield part.collect(), k == n - 1


def _by_block(docs: DataFrame, bench: DataFrame, text: str, width: int, block_bytes: int, column: str, schema: str, find, finish=None, last_schema=None) -> DataFrame:
    """The documents with `column`, an array of all that find(items, batch) gives for each block: values and how many each row has.

    With `finish`, what that makes of each batch with the whole array, in the pass over the last block.
    """
    out = docs.drop(column).withColumn(column, F.lit(None).cast(f"array<{schema}>"))
    for rows, is_last in _item_blocks(bench, block_bytes):
        items = docs.sparkSession.sparkContext.broadcast(Items([tuple(r) for r in rows], width))

        def search(batches, items=items, is_last=is_last):
            for batch in W.slices(batches, text, SHARD_BYTES):
                values, counts = find(items.value, batch)
                fresh = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), values)
                k = batch.schema.get_field_index(column)
                old = batch.column(k)
                if old.null_count < len(old):
                    fresh = pa.array([(a or []) + b for a, b in zip(old.to_pylist(), fresh.to_pylist(), strict=True)], fresh.type)
                whole = pa.RecordBatch.from_arrays([*batch.columns[:k], fresh, *batch.columns[k + 1 :]], names=batch.schema.names)
                yield finish(whole) if finish and is_last else whole

        out = out.mapInArrow(search, last_schema if finish and is_last else out.schema)
        if not is_last:
            out = stored(out, "hits")
            items.destroy()
    return out


def with_hits(docs: DataFrame, bench: DataFrame, text: str = "text", width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents with `hits`: array of (item_id, item_word, doc_word, length), the longest verbatim matches of `width` words or more.

    An item of fewer words than `width`, but not none, matches as a whole.
    """
    item_type = bench.schema["item_id"].dataType.simpleString()

    def longest(items, batch):
        data, offsets = W.text_bytes(batch.column(text), lower=True)
        at, window, first = matches(items, data, offsets)
        several = items.begin[window + 1] - items.begin[window]
        member = W.ragged(items.begin[window], several)
        at, length = np.repeat(at, several), np.repeat(items.widths[window], several)
        row = np.searchsorted(first, at, "right") - 1
        doc_word, item, item_word = at - first[row], items.item[member], items.offset[member]
        order = np.lexsort((doc_word, doc_word - item_word, item, row))
        row, doc_word, item, item_word, length = (x[order] for x in (row, doc_word, item, item_word, length))
        chain = np.ones(len(row), bool)
        chain[1:] = ~((row[1:] == row[:-1]) & (item[1:] == item[:-1]) & (doc_word[1:] == doc_word[:-1] + 1) & (item_word[1:] == item_word[:-1] + 1))
        heads = np.flatnonzero(chain)
        runs = np.diff(np.append(heads, len(row)))
        kind = batch.schema.field("hits").type.value_type
        values = pa.StructArray.from_arrays(
            [pa.array([items.ids[k] for k in item[heads].tolist()], kind.field(0).type), *(pa.array(x, pa.int32()) for x in (item_word[heads], doc_word[heads], length[heads] + runs - 1))],
            fields=list(kind),
        )
        return values, np.bincount(row[heads], minlength=batch.num_rows)

    schema = f"struct<item_id:{item_type},item_word:int,doc_word:int,length:int>"
    return _by_block(docs, bench, text, width, block_bytes, "hits", schema, longest)


def judged(docs: DataFrame, bench: DataFrame, text: str = "text", share: int = SHARE, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents with n_words, n_hit, items (sorted as strings), contaminated."""

    def found(items, batch):
        """Stretches of hit words and names of items of each document: (first word, end, null) and (null, null, item)."""
        data, offsets = W.text_bytes(batch.column(text), lower=True)
        at, window, first = matches(items, data, offsets)
        change = np.zeros(first[-1] + 1, np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + items.widths[window], -1)
        hit = np.append(np.cumsum(change)[:-1] > 0, False)
        edge = np.isin(np.arange(len(hit)), first)
        opens = np.flatnonzero(hit & (edge | ~np.append(False, hit[:-1])))
        closes = np.flatnonzero(hit & (np.append(edge[1:], True) | ~np.append(hit[1:], False))) + 1
        row = np.searchsorted(first, opens, "right") - 1
        # each document's different windows, then its different items
        pairs = np.unique(np.stack([np.searchsorted(first, at, "right") - 1, window], 1), axis=0)
        several = items.begin[pairs[:, 1] + 1] - items.begin[pairs[:, 1]]
        members = np.unique(np.stack([np.repeat(pairs[:, 0], several), items.item[W.ragged(items.begin[pairs[:, 1]], several)]], 1), axis=0)
        names = [None if items.ids[k] is None else str(items.ids[k]) for k in members[:, 1].tolist()]
        order = np.argsort(np.concatenate([row, members[:, 0]]), kind="stable")
        take = pa.array(order)
        none = pa.nulls(len(members), pa.int32())
        columns = [
            pa.concat_arrays([pa.array(opens - first[row], pa.int32()), none]), pa.concat_arrays([pa.array(closes - first[row], pa.int32()), none]),
            pa.concat_arrays([pa.nulls(len(opens), pa.string()), pa.array(names, pa.string())]),
        ]
        values = pa.StructArray.from_arrays([c.take(take) for c in columns], fields=list(batch.schema.field("__found").type.value_type))
        return values, np.bincount(row, minlength=batch.num_rows) + np.bincount(members[:, 0], minlength=batch.num_rows)

    kept = [c for c in docs.columns if c not in ("n_words", "n_hit", "items", "contaminated")]
    schema = docs.select(*kept).schema.simpleString()[7:-1]

    def count(batch):
        data, offsets = W.text_bytes(batch.column(text), lower=True)
        _, _, first = W.find_words(data, offsets, W.NOT_ALNUM)
        n_words = np.diff(first)
        hits = batch.column("__found")
        flat, ends = hits.flatten(), np.append(0, np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(hits), 0).to_numpy(zero_copy_only=False)))
        row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
        stretch = flat.field("a").is_valid().to_numpy(zero_copy_only=False)
        a, b = (pa.compute.fill_null(flat.field(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)[stretch] for c in "ab")
        change = np.zeros(first[-1] + 1, np.int64)
        np.add.at(change, first[row[stretch]] + a, 1)
        np.add.at(change, first[row[stretch]] + b, -1)
        covered = np.append(0, np.cumsum(np.cumsum(change)[:-1] > 0))
        n_hit = covered[first[1:]] - covered[first[:-1]]
        names = flat.field("item").to_pylist()
        items = [sorted(set(names[a:b]) - {None}) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array((n_hit > 0) & (share * n_hit >= n_words))],
            names=[*kept, "n_words", "n_hit", "items", "contaminated"],
        )

    last = f"{schema},n_words:bigint,n_hit:bigint,items:array<string>,contaminated:boolean"
    return _by_block(docs, bench, text, width, block_bytes, "__found", "struct<a:int,b:int,item:string>", found, count, last)


def clean_rows(docs: DataFrame, bench: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are not contaminated, with their own columns only."""
    return keeping_columns(docs, [text], lambda d: judged(d, bench, text).where(~F.col("contaminated")))


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return judged(docs, bench).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


#: {docs} is the table to judge; gives doc_id, n_words, n_hit, contaminated and the items as rows.
HITS_SQL = r"""
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM {docs}),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iv AS (SELECT item_id, least(len(ws), 13) AS k, array_to_string(ws[i:i + least(len(ws), 13) - 1], ' ') AS win
       FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS i FROM iw WHERE len(ws) > 0)),
dv AS (SELECT doc_id, i, k, array_to_string(ws[i:i + k - 1], ' ') AS win
       FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM iv) WHERE len(ws) >= k)),
hit AS (SELECT dv.doc_id, dv.i, dv.k, iv.item_id FROM dv JOIN iv ON dv.k = iv.k AND dv.win = iv.win),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY doc_id),
jd AS (SELECT dw.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_hit,
         CAST(coalesce(its.n, 0) AS BIGINT) AS n_items, sha256(coalesce(its.ids, '')) AS items_sha256,
         coalesce(cov.n, 0) > 0 AND 20 * coalesce(cov.n, 0) >= len(ws) AS contaminated
       FROM dw LEFT JOIN cov ON dw.doc_id = cov.doc_id LEFT JOIN its ON dw.doc_id = its.doc_id)
"""
OP9_SQL = "WITH " + HITS_SQL.replace("{docs}", "documents") + " SELECT doc_id, n_words, n_hit, n_items, items_sha256, contaminated FROM jd"
