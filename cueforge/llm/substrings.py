"""Substring dedup: words of long passages that an earlier document already has.

A window is WIDTH successive words of one document. A word goes if some window over it also starts in
a document with a smaller id; windows are judged on the input.

Anchors are shorter windows hashed only where the position modulo PERIOD lies in a difference cover,
a set whose differences give every residue: two equal windows of WIDTH words, wherever they stand in
their documents, hold an anchor at the same place in both. Anchors that occur in two documents extend to
the whole windows around them, and the smallest document of each such window decides.

Exact copies are settled by the text's hash first, so a group of copies sends one member on. Groups
are pre-aggregated before each shuffle; the joins back on a hash are plain equi-joins that adaptive
execution splits where a hash is hot. Windows are compared by 64-bit hashes of 64-bit word hashes.

Null and empty texts have no words. Rows without an id are never removed from and remove nothing. Rows
that share an id are one document for the rule, and each gets its own result. Extra columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .store import keeping_columns

WIDTH = 50
# A perfect difference set modulo 31.
PERIOD = 31
COVER = [1, 5, 11, 24, 25, 27]


def _windows(batch, text, width, at_least):
    """(hash, row, position in the row) of the batch's windows of `width` words in rows of `at_least` words."""
    data, offsets = W.text_bytes(batch.column(text))
    starts, ends, first = W.find_words(data, offsets)
    hashes = W.hash_windows(W.hash_words(data, starts, ends), width)
    row = W.rows_of(first)
    n = len(hashes)
    inside = (row[:n] == row[width - 1 : width - 1 + n]) & (np.diff(first)[row[:n]] >= at_least) if n else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    return hashes[at], row[at], at - first[row[at]]


def _own_hashes(hashes, row, ids):
    """Each row's different hashes with the row's id."""
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return pa.RecordBatch.from_arrays([pa.array(hashes[new].view(np.int64)), ids.take(pa.array(row[new]))], names=["h", "id"])


def anchors(docs: DataFrame, id_col: str, text: str, width: int) -> DataFrame:
    """(h, id): hashes of the windows at cover positions of each text."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def find(batches):
        cover = np.zeros(PERIOD, bool)
        cover[COVER] = True
        for batch in W.slices(batches, text):
            hashes, row, at = _windows(batch, text, width - PERIOD + 1, width)
            keep = cover[at % PERIOD]
            yield _own_hashes(hashes[keep], row[keep], batch.column(id_col))

    return docs.select(id_col, text).mapInArrow(find, f"h bigint, id {id_type}")


def _listed(lists, hashes, row):
    """Whether each hash is in its row's list."""
    values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    of = np.repeat(np.arange(len(lists)), pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    salt = W.U64(0xC2B2AE3D27D4EB4F)
    return np.isin(W.mix(hashes + row.astype(np.uint64) * salt), W.mix(values + of.astype(np.uint64) * salt))


def _around(docs: DataFrame, id_col: str, text: str, width: int) -> DataFrame:
    """(h, id): hashes of the whole windows around the shared anchors of each text, which `__shared` lists."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def extend(batches):
        for batch in W.slices(batches, text):
            small, of, at = _windows(batch, text, width - PERIOD + 1, width)
            hit = _listed(batch.column("__shared"), small, of)
            of, at = of[hit], at[hit]
            hashes, row, _ = _windows(batch, text, width, width)
            # windows that hold the anchor start at most PERIOD - 1 words before it
            base = np.searchsorted(row, np.arange(batch.num_rows + 1))
            change = np.zeros(len(row) + 1, np.int64)
            np.add.at(change, base[of] + np.maximum(at - (PERIOD - 1), 0), 1)
            np.add.at(change, np.minimum(base[of] + at + 1, base[of + 1]), -1)
            keep = np.cumsum(change)[:-1] > 0
            yield _own_hashes(hashes[keep], row[keep], batch.column(id_col))

    return docs.select(id_col, text, "__shared").mapInArrow(extend, f"h bigint, id {id_type}")


def _shared(found: DataFrame) -> DataFrame:
    """The first document of each hash that two documents have."""
    ends = found.groupBy("h").agg(F.min("id").alias("_first"), F.max("id").alias("_last"))
    return ends.where(F.col("_first") < F.col("_last")).select("h", "_first")


def with_removals(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """The rows with `__is_copy` (an earlier document has the same text) and `__removed`: hashes of the document's windows that go."""
    if width < 2 * PERIOD - 12:
        raise ValueError(f"windows of {width} words leave no room for anchors of period {PERIOD}")
    docs = docs.withColumns({"__a": F.xxhash64(text), "__b": F.xxhash64(F.lit(1), text)})
    own = docs.where(F.col(id_col).isNotNull())
    ids = own.where(F.col(text).isNotNull()).select("__a", "__b", id_col)
    first = ids.groupBy("__a", "__b").agg(F.min(id_col).alias("_first"), F.max(id_col).alias("_last")).where(F.col("_first") < F.col("_last"))
    copies = ids.join(first, ["__a", "__b"]).where(F.col(id_col) > F.col("_first"))
    copies = copies.groupBy(id_col).agg(F.collect_set(F.struct("__a", "__b")).alias("__copies"))
    # everything that needs the texts is joined by id alone, so one exchange of the texts serves all
    is_copy = F.coalesce(F.array_contains("__copies", F.struct("__a", "__b")), F.lit(False))
    singles = own.join(copies, id_col, "left").where(~is_copy).select(id_col, text)
    found = anchors(singles, id_col, text, width)
    near = found.join(_shared(found), "h").groupBy(F.col("id").alias(id_col)).agg(F.collect_set("h").alias("__shared"))
    around = _around(singles.join(near, id_col), id_col, text, width)
    gone = around.join(_shared(around), "h").where(F.col("id") > F.col("_first"))
    removed = gone.groupBy(F.col("id").alias(id_col)).agg(F.collect_set("h").alias("__removed"))
    judged = own.drop("__removed", "__is_copy").join(copies, id_col, "left").join(removed, id_col, "left").withColumn("__is_copy", is_copy)
    rest = docs.where(F.col(id_col).isNull()).drop("__removed", "__is_copy").withColumns({"__is_copy": F.lit(False), "__removed": F.lit(None).cast("array<bigint>")})
    return judged.drop("__a", "__b", "__copies").unionByName(rest.drop("__a", "__b"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """The rows with `kept_text` (kept words joined by one space), `n_words` and `n_removed`."""
    found = with_removals(docs, id_col, text, width)
    kept = [c for c in docs.columns if c not in ("kept_text", "n_words", "n_removed")]
    found = found.select(*kept, "__is_copy", "__removed")
    schema = found.select(*kept).schema.simpleString()[7:-1]

    def cut(batches):
        for batch in W.slices(batches, text):
            data, offsets = W.text_bytes(batch.column(text))
            starts, ends, first = W.find_words(data, offsets)
            n_words = np.diff(first)
            hashes, of, at = _windows(batch, text, width, width)
            hit = _listed(batch.column("__removed"), hashes, of)
            change = np.zeros(len(starts) + 1, np.int64)
            np.add.at(change, first[of[hit]] + at[hit], 1)
            np.add.at(change, first[of[hit]] + at[hit] + width, -1)
            copy = batch.column("__is_copy").to_numpy(zero_copy_only=False).astype(bool) & (n_words >= width)
            keep = (np.cumsum(change)[:-1] == 0) & ~np.repeat(copy, n_words)
            at = np.flatnonzero(keep)
            n_kept = np.diff(np.searchsorted(at, first))
            # each kept word and one space after it; the last space of a row is cut off below
            lengths = ends[at] - starts[at]
            spaced = np.append(data, np.uint8(32))
            take = W.ragged(starts[at], lengths + 1)
            stops = np.cumsum(lengths + 1) - 1
            take[stops] = len(data)
            out = spaced[take]
            sizes = np.append(0, np.cumsum(lengths + 1))
            bounds = sizes[np.append(0, np.cumsum(n_kept))]
            raw = out.tobytes()
            texts = [raw[a : max(a, b - 1)] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_words - n_kept, pa.int64())],
                names=[*kept, "kept_text", "n_words", "n_removed"],
            )

    return found.mapInArrow(cut, f"{schema},kept_text:string,n_words:bigint,n_removed:bigint")


def deduplicated_rows(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with what is left of their texts; a text that loses nothing stays as it is, and one that loses everything goes."""

    def work(d):
        out = deduplicated(d, id_col, text).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
        return out.withColumn(text, F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col(text)))

    return keeping_columns(docs, [id_col, text], work)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduplicated(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


#: {docs} is the table; gives words, the removed positions and what is left.
KEPT_SQL = r"""
sw AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM {docs}),
sv AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM sw WHERE len(ws) >= 50)),
sg AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS lo FROM sv),
sr AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM sg WHERE lo < doc_id),
sl AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM sr GROUP BY doc_id),
sk AS (SELECT sw.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
         CASE WHEN n IS NULL THEN array_to_string(ws, ' ') ELSE array_to_string(list_select(ws, list_filter(range(1, len(ws) + 1), lambda j: NOT list_contains(ps, j))), ' ') END AS kept_text
       FROM sw LEFT JOIN sl ON sw.doc_id = sl.doc_id)
"""
OP2_SQL = "WITH " + KEPT_SQL.replace("{docs}", "documents") + " SELECT doc_id, n_words, n_removed, sha256(kept_text) AS kept_sha256 FROM sk"
