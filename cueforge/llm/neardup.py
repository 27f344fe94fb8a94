"""MinHash near-dedup: documents whose sets of word shingles overlap enough, linked into components.

Each document's set gets BANDS * ROWS minima of universal hashes (multiply and add modulo 2^64). Two
sets of Jaccard similarity s agree on a band with probability s^ROWS, so at 0.8 a pair shares none of 24
bands of 4 rows with probability 3e-6. Pairs are compared by their whole signatures first (SIG_LEAST of
96 one-byte minima; a pair at 0.8 falls below it with probability under 1e-7), and what is left on the full sets.

Documents with equal sets form one class, of which only the smallest document goes on. In a bucket (documents with
a band in common) every member is compared with one centre, the member that shares most bands with others, and
linked documents form components by alternating large-star and small-star.

What is left are pairs of one bucket in different components, neither of them the centre, which has been compared with
all. At least one of the two is open, outside the largest component of the bucket's other members. Such pairs are found by their rarest shingles: with all shingles in one order, by how many
of these documents have them, the first shingle that x and y share stands at places i and j of their sorted sets, and
the overlap is at most min(n_x - i, n_y - j). Most open documents hold so many shingles of their own that nothing
can be linked with them, and they end here without a comparison. No bound on members, rounds or candidates is set.

Null and empty texts have empty sets and link with nothing. Texts of fewer words than a shingle are one shingle. Whole
texts count, however long. Repeated rows and equal sets are of one component. Rows without an id keep a null component.
Rows that share an id are one document with the union of their links, each row returned. Other columns don't matter
and an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .store import scratch, stored

SHINGLE = 5
PERCENT = 80
BANDS, ROWS = 24, 4
SIG_LEAST = 52
#: Bits of the table of document ids by hash that texts are looked up in; a fixed size, so it can be broadcast.
ID_BITS = 1 << 24


def _sets(batch, text, width):
    """(flat sorted distinct shingle hashes, bounds of each row)."""
    data, offsets = W.text_bytes(batch.column(text), lower=True)
    starts, ends, first = W.find_words(data, offsets)
    hashes = W.hash_words(data, starts, ends)
    row = W.rows_of(first)
    n_words = np.diff(first)
    shingles = W.hash_windows(hashes, width)
    n = len(shingles)
    inside = row[:n] == row[width - 1 : width - 1 + n] if n else np.zeros(0, bool)
    found, of = [shingles[inside]], [row[:n][inside]]
    for k in range(1, width):  # texts of fewer words: the whole sequence
        rows = np.flatnonzero(n_words == k)
        if len(rows):
            found.append(W.hash_windows(hashes, k)[first[rows]])
            of.append(rows)
    found, of = np.concatenate(found), np.concatenate(of)
    order = np.lexsort((found, of))
    found, of = found[order], of[order]
    if len(found):
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
        found, of = found[new], of[new]
    return found, np.searchsorted(of, np.arange(batch.num_rows + 1))


def _coefficients():
    draw = np.random.Generator(np.random.PCG64(20240607))
    return draw.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * W.U64(2) + W.U64(1), draw.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def signatures(docs: DataFrame, id_col: str, text: str, width: int) -> DataFrame:
    """(id, n_shingles, s1, s2, sig, bands): set size, two sums that name the set, one byte of each minimum, and band keys."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def sign(batches):
        times, plus = _coefficients()
        for batch in W.slices(batches, text):
            flat, bounds = _sets(batch, text, width)
            sizes = np.diff(bounds)
            full = np.flatnonzero(sizes)
            minima = np.zeros((batch.num_rows, BANDS * ROWS), W.U64)
            s1, s2 = np.zeros(batch.num_rows, W.U64), np.zeros(batch.num_rows, W.U64)
            if len(full):
                heads = bounds[:-1][full]
                for k in range(BANDS * ROWS):
                    minima[full, k] = np.minimum.reduceat(flat * times[k] + plus[k], heads)
                s1[full] = np.add.reduceat(flat, heads)
                s2[full] = np.add.reduceat(W.mix(flat ^ W.U64(0x5851F42D4C957F2D)), heads)
            keys = np.zeros((batch.num_rows, BANDS), W.U64)
            for r in range(ROWS):
                keys = W.mix(keys * W.U64(0x9E3779B97F4A7C15) + minima[:, r::ROWS] + np.arange(BANDS, dtype=W.U64))
            sig = (W.mix(minima) & W.U64(255)).astype(np.uint8)
            listed = np.where(sizes > 0, BANDS, 0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(id_col), pa.array(sizes, pa.int64()), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)),
                    pa.array([x.tobytes() for x in sig], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(listed)), pa.int32()), pa.array(keys[full].ravel().view(np.int64))),
                ],
                names=[id_col, "n_shingles", "s1", "s2", "sig", "bands"],
            )

    return docs.select(id_col, text).mapInArrow(sign, f"{id_col} {id_type}, n_shingles bigint, s1 bigint, s2 bigint, sig binary, bands array<bigint>")


def _shingle_sets(docs: DataFrame, id_col: str, text: str, width: int) -> DataFrame:
    id_type = docs.schema[id_col].dataType.simpleString()

    def find(batches):
        for batch in W.slices(batches, text):
            flat, bounds = _sets(batch, text, width)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat.view(np.int64)))], names=["u", "shingles"])

    return docs.select(id_col, text).mapInArrow(find, f"u {id_type}, shingles array<bigint>")


def _agreeing(pairs: DataFrame) -> DataFrame:
    """The pairs with `alike`: whether their signatures agree on SIG_LEAST minima or more."""
    schema = pairs.drop("sig_a", "sig_b").schema.simpleString()[7:-1]

    def compare(batches):
        for batch in batches:
            n = batch.num_rows
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(n, BANDS * ROWS) for c in ("sig_a", "sig_b"))
            alike = pa.array((a == b).sum(axis=1) >= SIG_LEAST)
            names = [c for c in batch.schema.names if c not in ("sig_a", "sig_b")]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), alike], names=[*names, "alike"])

    return pairs.mapInArrow(compare, f"{schema},alike boolean")


def _probably_in(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows whose id is in `ids` (column u), and a few others, without moving the rows: a table of ID_BITS bits by the id's hash, 64 in a row, is broadcast.

    Where ids are as many as bits, most rows pass, which costs work but changes no result.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(ID_BITS))
    word, bit = lambda c: (slot(c) / 64).cast("long"), lambda c: (slot(c) % 64).cast("int")
    bits = ids.groupBy(word("u").alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(xxhash64(u), 64) as int))")).alias("__bits"))
    rows = df.withColumn("__word", word(id_col)).join(F.broadcast(bits), "__word")
    return rows.where(F.getbit("__bits", bit(id_col)) == 1).drop("__word", "__bits")


def _linked(pairs: DataFrame, sig: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v) of the distinct pairs that are linked: by signature first, then on the full sets."""
    pairs = pairs.join(sig.select("u", F.col("sig").alias("sig_a")), "u").join(sig.select(F.col("u").alias("v"), F.col("sig").alias("sig_b")), "v")
    b = sets.select(F.col("u").alias("v"), F.col("shingles").alias("sv"))
    found = _agreeing(pairs).where("alike").drop("alike").join(sets, "u").join(b, "v")
    both, n = F.size(F.array_intersect("shingles", "sv")), F.size("shingles") + F.size("sv")
    return found.where((100 + percent) * both >= percent * n).select("u", "v")


def _rooted(df: DataFrame, roots: DataFrame) -> DataFrame:
    """With `root`, the smallest document of u's component so far."""
    return df.join(roots.select("u", F.col("v").alias("root")), "u", "left").withColumn("root", F.coalesce("root", "u"))


def _open_members(led: DataFrame, roots: DataFrame) -> DataFrame:
    """(u, n, root, open) of the members of buckets whose members beside the centre are of several components; open outside the largest of some bucket."""
    ranked = _rooted(led.select("key", "u", "n"), roots)
    by_root = ranked.groupBy("key", "root").agg(F.count("*").alias("k"))
    mixed = by_root.groupBy("key").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1")
    return ranked.join(mixed.select("key", "main"), "key").groupBy("u", "n", "root").agg(F.max(F.col("root") != F.col("main")).alias("open"))


def _by_rare_shingles(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v) of the pairs of an open member u and a member v of another component whose overlap can be large enough."""
    # of two linked sets not even the larger one has more shingles than this before the first common one
    reach = lambda before: 100 * before <= (100 - percent) * F.col("n")
    has = sets.join(members.select("u"), "u", "left_semi").select("u", F.explode("shingles").alias("t"))
    common = has.groupBy("t").agg(F.count("*").alias("df")).where("df > 1")
    rows = has.join(common, "t").groupBy("u").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("ts")).join(members, "u")
    # the shingles that no other member has come first
    rows = rows.withColumn("own", F.col("n") - F.size("ts"))
    rows = rows.where(reach(F.col("own"))).select("u", "n", "root", "open", "own", F.posexplode("ts").alias("at", "x"))
    rows = rows.where(reach(F.col("own") + F.col("at"))).select("u", "n", "root", "open", F.col("x.t").alias("t"), (F.col("n") - F.col("own") - F.col("at")).alias("rest"))
    x = rows.where("open")
    y = rows.select("t", F.col("u").alias("v"), F.col("n").alias("nv"), F.col("root").alias("rv"), F.col("open").alias("ov"), F.col("rest").alias("restv"))
    enough = (100 + percent) * F.least("rest", "restv") >= percent * (F.col("n") + F.col("nv"))
    once = ~F.col("ov") | (F.col("u") < F.col("v"))
    return x.join(y, (x.t == y.t) & (x.root != y.rv) & enough & once).select("u", "v").distinct()


def clusters(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id): one row per row of the table."""
    if percent < 80:
        raise ValueError("the bands are laid out for a similarity of 0.8 or more")
    with scratch(docs.sparkSession) as (kept, paths):
        signed = kept(signatures(docs, id_col, text, width), "signatures")
        known = signed.where(F.col(id_col).isNotNull() & (F.col("n_shingles") > 0))
        # classes of equal sets: the smallest id stands for all
        classes = known.groupBy("n_shingles", "s1", "s2").agg(F.min(id_col).alias("u"), F.min("sig").alias("sig"), F.min("bands").alias("bands"))
        classes = kept(classes, "classes")
        member = known.select(id_col, "n_shingles", "s1", "s2").join(classes.select("n_shingles", "s1", "s2", "u"), ["n_shingles", "s1", "s2"])
        same = member.where(F.col(id_col) > F.col("u")).select(F.col(id_col).alias("a"), F.col("u").alias("b")).distinct()
        sig = classes.select("u", "sig")
        buckets = classes.select("u", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
        several = buckets.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
        buckets = kept(buckets.join(several, "key"), "buckets")
        texts = _probably_in(docs.select(id_col, text).where(F.col(id_col).isNotNull()), id_col, buckets.select("u"))
        sets = kept(_shingle_sets(texts, id_col, text, width), "sets")

        score = buckets.groupBy("u").agg(F.sum("m").alias("score"))
        centres = buckets.join(score, "u").groupBy("key").agg(F.max_by(F.struct("u", "n"), F.struct("score", "u")).alias("c"))
        close = 100 * F.least("n", "c.n") >= percent * F.greatest("n", "c.n")
        led = kept(buckets.select("key", "u", "n").join(centres, "key").where(F.col("u") != F.col("c.u")), "led")
        pairs = led.where(close).select("u", F.col("c.u").alias("v")).distinct()
        roots = components(_linked(pairs, sig, sets, percent), paths)
        members = kept(_open_members(led, roots), "members")
        pairs = kept(_by_rare_shingles(members, sets, percent), "pairs")
        links = roots.select("u", "v").union(_linked(pairs, sig, sets, percent))
        # an id that has several sets ties its classes together
        ids_twice = known.groupBy(id_col).agg(F.count_distinct("s1", "s2").alias("k")).where("k > 1")
        if ids_twice.isEmpty():
            roots = components(links, paths)
            final = same.join(roots.select(F.col("u").alias("b"), F.col("v").alias("root")), "b", "left").select(F.col("a").alias(id_col), F.coalesce("root", "b").alias("component_id"))
            final = final.union(roots.select(F.col("u").alias(id_col), F.col("v").alias("component_id")))
        else:
            edges = same.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links)
            final = components(edges, paths).select(F.col("u").alias(id_col), F.col("v").alias("component_id"))
        found = signed.select(id_col, "n_shingles").join(final, id_col, "left").withColumn("component_id", F.coalesce("component_id", id_col))
        return stored(found, "clusters")


def op3_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = clusters(docs, width=2)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The document with the smallest id of each component, with its own columns. Rows without an id are in no component and all stay."""
    known = docs.where(F.col(id_col).isNotNull())
    gone = clusters(known, id_col, text, width, percent).where(F.col(id_col) > F.col("component_id")).select(id_col).distinct()
    kept = known.join(gone, id_col, "left_anti").select(*docs.columns)
    return kept.union(docs.where(F.col(id_col).isNull()))


#: {docs} is the table, {k} the shingle's words; (doc_id, n_shingles, component_id) as nc.
CLUSTERS_SQL = r"""
nw AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM {docs}),
ns AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + {k} - 1], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {k} + 1, 1) + 1)) AS i FROM nw WHERE len(ws) > 0)),
nn AS (SELECT doc_id, count(*) AS n FROM ns GROUP BY doc_id),
np AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM ns a JOIN ns b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
ne AS (SELECT a, b FROM np JOIN nn x ON x.doc_id = a JOIN nn y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
nb AS (SELECT a AS u, b AS v FROM ne UNION ALL SELECT b, a FROM ne),
nr(doc_id, r) AS (SELECT doc_id, doc_id FROM nw UNION SELECT nb.v, nr.r FROM nr JOIN nb ON nr.doc_id = nb.u),
nc AS (SELECT nw.doc_id, CAST(coalesce(any_value(nn.n), 0) AS BIGINT) AS n_shingles, min(nr.r) AS component_id
       FROM nw LEFT JOIN nn ON nn.doc_id = nw.doc_id JOIN nr ON nr.doc_id = nw.doc_id GROUP BY nw.doc_id)
"""
OP3_SQL = (
    "WITH RECURSIVE " + CLUSTERS_SQL.replace("{docs}", "documents").replace("{k}", "2")
    + " SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM nc"
)
