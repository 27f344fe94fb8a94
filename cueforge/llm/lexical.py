"""Ranked lexical search: the documents of highest score for each item, by exact search of sparse ball trees.

A score is an inner product: a term's weight (from the number of documents that hold it) times its impact in a document
(from its occurrences and the document's length), all in integers. Of the documents' vectors only the terms of the items matter. The
documents of a slice of TREE_BYTES of text form one tree: halved again and again across the widest direction of a hashed
sketch (which decides the shape, never a result) down to leaves of LEAF documents. Each node has its documents' centroid,
in integers, and, for each band of weights, a radius: the largest distance of a document's part in that band from
the centroid's. Terms that no document of the node has are outside its space, so an item's bound is

    item . centroid + sum over bands of |item's part within the node's terms| * radius

Dot products are exact; lengths and radii are floats, rounded up by more than their error. Each item goes through a tree best-first: the node of the highest bound
is opened next, and the search ends when that bound is below the item's 10th score so far. Leaves are scored exactly. An item's best documents
so far are kept from tree to tree of a task; what the tasks found is ranked in two steps.

Corpus counts come from one pass over all documents. Terms are compared by 64-bit hashes. The items are read in blocks of about BLOCK_TERMS
terms, of which one at a time is broadcast.

Null and empty texts have no terms: such documents aren't counted, such items find nothing. Whole texts count, however long. Rows that share an item_id (null
too) are one item with the terms of all. Repeated documents are ranked each for itself; equal scores go by ascending doc_id, rows without an id last.
Extra columns don't matter. Empty tables give no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .store import scratch, stored

TOP = 10
TREE_BYTES = 8 << 20
LEAF = 16
BLOCK_TERMS = 1 << 20
#: Width of a band of weights, and how many there are.
BAND_WIDTH, BANDS = 100, 128
SKETCH = 32
#: Bits of the table that terms of documents are looked up in before they are counted; of a fixed size.
TERM_BITS = 1 << 24
#: More than the relative error of a length or radius in floats.
SLACK = 1 + 2.0**-40


def _terms(batch, text):
    """(hash of each term, first term of each row)"""
    data, offsets = W.text_bytes(batch.column(text), lower=True)
    starts, ends, first = W.find_words(data, offsets, W.NOT_ALNUM)
    return W.hash_words(data, starts, ends), first


def _item_terms(items: DataFrame, item_col: str, text: str) -> DataFrame:
    kind = items.schema[item_col].dataType.simpleString()

    def find(batches):
        for batch in W.slices(batches, text):
            hashes, first = _terms(batch, text)
            yield pa.RecordBatch.from_arrays([batch.column(item_col).take(pa.array(W.rows_of(first))), pa.array(hashes.view(np.int64))], names=["item", "h"])

    return items.select(item_col, text).mapInArrow(find, f"item {kind}, h bigint").distinct()


def _term_bits(terms: DataFrame) -> np.ndarray:
    """Whether some term's hash has each value of its low bits: TERM_BITS / 64 rows at most."""
    low = F.col("h").bitwiseAND(F.lit(TERM_BITS - 1))
    words = terms.groupBy(F.shiftright(low, 6).alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(TERM_BITS // 64, np.int64)
    table[words["k"].to_numpy()] = words["bits"].to_numpy()
    return np.unpackbits(table.view(np.uint8), bitorder="little").astype(bool)


def _holders(docs: DataFrame, asked: np.ndarray, text: str) -> DataFrame:
    """(h, docs, terms): documents that hold each term that is asked for; for the null h, documents with terms and all their terms."""
    table = docs.sparkSession.sparkContext.broadcast(np.packbits(asked))

    def count(batches):
        wanted = np.unpackbits(table.value).astype(bool)
        for batch in W.slices(batches, text, 2 << 20):
            hashes, first = _terms(batch, text)
            row, n = W.rows_of(first), np.diff(first)
            take = wanted[(hashes & W.U64(TERM_BITS - 1)).astype(np.int64)]
            hashes, row = hashes[take], row[take]
            order = np.lexsort((row, hashes))
            hashes, row = hashes[order], row[order]
            new = np.append(True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])) if len(row) else np.zeros(0, bool)
            terms, held = np.unique(hashes[new], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(terms.view(np.int64))]), pa.array(np.append(int((n > 0).sum()), held)), pa.array(np.append(int(n.sum()), np.zeros(len(held), np.int64)))],
                names=["h", "docs", "terms"],
            )

    return docs.select(text).mapInArrow(count, "h bigint, docs bigint, terms bigint").groupBy("h").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms"))


class Items:
    """A block of items: their terms by number in the order of weights, and how each term weighs."""

    def __init__(self, rows: pa.Table):
        h, w = rows["h"].to_numpy().view(W.U64), rows["w"].to_numpy()
        terms, head, term = np.unique(h, return_index=True, return_inverse=True)
        by_weight = np.argsort(w[head], kind="stable")
        number = np.empty(len(terms), np.int64)
        number[by_weight] = np.arange(len(terms))
        self.hashes, self.number = terms, number
        self.weight = w[head][by_weight]
        self.band = np.minimum(self.weight // BAND_WIDTH, BANDS - 1)
        of: dict = {}
        for k, item in enumerate(rows["item"].to_pylist()):
            of.setdefault(item, []).append(k)
        self.ids = list(of)
        self.terms = [np.sort(number[term[ks]]) for ks in of.values()]

    def numbers(self, hashes):
        """The term's number of each hash; -1 where no item has it."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == hashes, self.number[at], -1)


def vectors(items: Items, hashes, first, n_docs: int, n_terms: int):
    """(rows, bounds, term, impact): the documents with any term of the items, as sparse vectors, terms in order."""
    n = np.diff(first)
    term, row = items.numbers(hashes), W.rows_of(first)
    row, term = row[term >= 0], term[term >= 0]
    key, tf = np.unique(row * max(len(items.weight), 1) + term, return_counts=True)
    row, term = np.divmod(key, max(len(items.weight), 1))
    m = 10 + 90 * n[row] * n_docs // max(n_terms, 1)
    rows, begin = np.unique(row, return_index=True)
    return rows, np.append(begin, len(row)), term, 1_000_000_000 * tf // (1000 * tf + 8 * m)


class BallTree:
    """A balanced tree over sparse vectors; level k has 2^k nodes, the last one the leaves."""

    def __init__(self, items: Items, bounds, term, impact):
        self.items = items
        n = len(bounds) - 1
        depth = max(0, (max(n, 1) - 1) // LEAF).bit_length()
        self.cuts = [np.array([0, n])]
        for _ in range(depth):
            c = self.cuts[-1]
            self.cuts.append(np.sort(np.append(c, (c[:-1] + c[1:]) // 2)))
        self.order = self._arranged(bounds, term, impact, n)
        lengths = np.diff(bounds)[self.order]
        take = W.ragged(bounds[:-1][self.order], lengths)
        self.bounds = np.append(0, np.cumsum(lengths))
        self.term, self.impact = term[take], impact[take]
        self._measured(lengths)

    def _arranged(self, bounds, term, impact, n):
        """The documents in leaf order: each node's half below the median along the line between two far documents."""
        draw = np.random.Generator(np.random.PCG64(12))
        slot, sign = draw.integers(0, SKETCH, len(self.items.weight)), draw.choice([-1.0, 1.0], len(self.items.weight))
        row = np.repeat(np.arange(n), np.diff(bounds))
        sketch = np.bincount(row * SKETCH + slot[term], impact * sign[term], n * SKETCH).reshape(n, SKETCH)
        order = np.arange(n)
        for cuts, halves in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            for low, middle, high in zip(cuts[:-1], halves[1::2], cuts[1:], strict=True):
                if high - low < 2:
                    continue
                part = order[low:high]
                x = sketch[part]
                far = x[((x - x[0]) ** 2).sum(axis=1).argmax()]
                along = x @ (x[((x - far) ** 2).sum(axis=1).argmax()] - far)
                order[low:high] = part[np.argpartition(along, min(middle - low, high - low - 1))]
        return order

    def _measured(self, lengths):
        """Centroids and radii of all nodes, from the leaves up."""
        v, n = max(len(self.items.weight), 1), len(lengths)
        row = np.repeat(np.arange(n), lengths)
        band = self.items.band[self.term] if len(self.term) else self.term
        # (document, band) runs of the entries
        head = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (band[1:] != band[:-1]))) if len(row) else row
        sums, inverse, keys = self.impact, np.arange(len(row)), row * v + self.term
        self.levels = []
        for k in range(len(self.cuts) - 1, -1, -1):
            cuts = self.cuts[k]
            leaf_level = k == len(self.cuts) - 1
            node = np.searchsorted(cuts, keys // v, "right") - 1 if leaf_level else keys // v >> 1
            keys, into = np.unique(node * v + keys % v, return_inverse=True)
            sums = np.bincount(into, sums, len(keys)).astype(np.int64)  # below 2^53
            inverse = into[inverse]
            of, terms = np.divmod(keys, v)
            size = np.diff(cuts)
            centre = sums // np.maximum(size[of], 1)
            base = np.zeros((len(size), BANDS), np.int64)
            np.add.at(base, (of, self.items.band[terms] if len(terms) else terms), centre * centre)
            doc_node = np.repeat(np.arange(len(size)), size)
            off = base[doc_node]
            if len(row):
                off[row[head], band[head]] += np.add.reduceat(self.impact * (self.impact - 2 * centre[inverse]), head)
            full = np.flatnonzero(size)
            radius = np.zeros((len(size), BANDS))
            if len(full):
                radius[full] = np.sqrt(np.maximum.reduceat(off, cuts[:-1][full], axis=0).astype(np.float64)) * SLACK
            self.levels.append((np.searchsorted(of, np.arange(len(size) + 1)), terms, centre, radius))
        self.levels.reverse()

    def bound(self, level: int, node: int, terms, weight, band) -> float:
        """At least the score of every document of the node."""
        begin, all_terms, centre, radius = self.levels[level]
        low, high = begin[node], begin[node + 1]
        if low == high:
            return 0.0
        own = all_terms[low:high]
        at = own.searchsorted(terms)
        at[at == len(own)] = 0
        hit = own[at] == terms
        w = weight[hit]
        inner = int(w @ centre[low + at[hit]])
        spread = np.sqrt(np.bincount(band[hit], w * w, BANDS)) @ radius[node]
        return (inner + spread * SLACK) * SLACK

    def search(self, terms, dense, least, found):
        """Best-first: found(documents in leaf order, scores) for each leaf whose bound reaches least(). dense: the item's weight of every term."""
        weight, band = self.items.weight[terms], self.items.band[terms]
        last = len(self.cuts) - 1
        heap = [(-self.bound(0, 0, terms, weight, band), 0, 0)]
        leaves = 0
        while heap and -heap[0][0] >= least():
            _, level, node = heapq.heappop(heap)
            if level == last:
                a, b = self.cuts[last][node], self.cuts[last][node + 1]
                part = slice(self.bounds[a], self.bounds[b])
                found(a, np.add.reduceat(dense[self.term[part]] * self.impact[part], self.bounds[a:b] - self.bounds[a]))
                leaves += 1
                continue
            for child in (2 * node, 2 * node + 1):
                bound = self.bound(level + 1, child, terms, weight, band)
                if bound >= least():
                    heapq.heappush(heap, (-bound, level + 1, child))
        return leaves


class Best:
    """The TOP documents of one item so far, as (minus score, id is null, id)."""

    def __init__(self, top):
        self.top, self.rows, self.least = top, [], 1

    def add(self, scores, ids):
        new = [(-int(s), i is None, i) for s, i in zip(scores, ids, strict=True)]
        self.rows = heapq.nsmallest(self.top, self.rows + new, key=lambda r: r if not r[1] else r[:2])
        if len(self.rows) == self.top:
            self.least = max(1, -self.rows[-1][0])


def _searched(docs: DataFrame, items, kind: str, n_docs: int, n_terms: int, id_col: str, text: str, top: int) -> DataFrame:
    """(item, doc, score): the best documents of each task. items: a broadcast block."""
    id_type = docs.schema[id_col].dataType

    def search(batches):
        block: Items = items.value
        best = [Best(top) for _ in block.ids]
        dense = np.zeros(len(block.weight), np.int64)
        for batch in W.slices(batches, text, TREE_BYTES):
            hashes, first = _terms(batch, text)
            rows, bounds, term, impact = vectors(block, hashes, first, n_docs, n_terms)
            if not len(rows):
                continue
            tree = BallTree(block, bounds, term, impact)
            ids = batch.column(id_col).take(pa.array(rows[tree.order]))
            for terms, of in zip(block.terms, best, strict=True):
                dense[terms] = block.weight[terms]

                def found(a, scores, of=of, ids=ids):
                    high = np.flatnonzero(scores >= of.least)
                    if len(high):
                        of.add(scores[high], ids.take(pa.array(a + high)).to_pylist())

                tree.search(terms, dense, lambda of=of: of.least, found)
                dense[terms] = 0
        out = [(k, r[2], -r[0]) for k, of in enumerate(best) for r in of.rows]
        if out:
            k, doc, score = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([block.ids[x] for x in k], kinds[0]), pa.array(doc, kinds[1]), pa.array(score, pa.int64())], names=["item", "doc", "score"])

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kinds = to_arrow_type(_parse_datatype_string(kind)), to_arrow_type(id_type)
    return docs.select(id_col, text).mapInArrow(search, f"item {kind}, doc {id_type.simpleString()}, score bigint")


def _ranked(found: DataFrame, keys: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def ranked(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents of highest score above 0 for each item."""
    spark = docs.sparkSession
    kind = items.schema[item_col].dataType.simpleString()
    with scratch(spark) as (kept, _):
        terms = kept(_item_terms(items, item_col, item_text), "item-terms")
        held = kept(_holders(docs, _term_bits(terms), text), "holders")
        n_docs, n_terms = held.where("h is null").agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
        weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2) / (F.lit(2.0) * F.col("docs") + F.lit(1.0))))
        weighed = terms.join(held.where("h is not null"), "h").select("item", "h", weight.cast("long").alias("w"))
        weighed = kept(weighed.where("w > 0"), "weighed")
        blocks = max(1, -(-weighed.count() // block_terms))
        parts = []
        for k in range(blocks):
            part = weighed.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)
            block = spark.sparkContext.broadcast(Items(part.toArrow()))
            found = _searched(docs, block, kind, n_docs, n_terms, id_col, text, top).withColumn("task", F.spark_partition_id())
            parts.append(kept(found, "found"))
            block.destroy()
        found = parts[0]
        for part in parts[1:]:
            found = found.union(part)
        # tasks by the hundred first, so that no item's rows of all tasks meet at once
        some = _ranked(found.withColumn("group", F.floor(F.col("task") / 128)), ["item", "group"], top)
        best = _ranked(some.select("item", "doc", "score"), ["item"], top)
        return stored(best.select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(id_col), "score"), "ranked")


def op12_ranked_lexical_search(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return ranked(docs, items)


OP12_SQL = r"""
WITH dt AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
c AS (SELECT count(*) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM dt WHERE len(ts) > 0),
tf AS (SELECT r, any_value(doc_id) AS doc_id, t, any_value(n) AS n, count(*) AS tf FROM (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS t FROM dt) GROUP BY r, t),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
it AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
w AS (SELECT item_id, it.t, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM it JOIN df ON it.t = df.t, c),
s AS (SELECT item_id, r, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score FROM w JOIN tf ON w.t = tf.t, c GROUP BY item_id, r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
