"""SimHash near-dedup: documents whose 64-bit fingerprints differ in at most RADIUS bits, linked into components.

A fingerprint bit is set if it is set in over half the XXH64 hashes of the text's word shingles, repeats included. Two
fingerprints at most two bits apart both lie within one bit of some 64-bit value, so every fingerprint emits itself and
the 64 values one bit away, and the emitted values are shuffled. Fingerprints are different at this point (equal ones
are one class from the start), so a value has at most 65 owners; they are told by the bit that was changed and
travel as one bit mask, aggregated before the shuffle. All owners of a value are linked with the smallest one after their
distance is checked, which connects them as all pairs would; links() lists all pairs. Components come from
alternating large-star and small-star.

Null and empty texts have the fingerprint zero and link like any other. Texts of fewer words than a shingle are one
shingle. Whole texts count, however long. Repeated rows and equal fingerprints are of one component. Rows without an
id get a fingerprint and a null component and link nothing. Rows that share an id are one document with the union of
their links, each row returned. Other columns don't matter, whatever their names, and an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .store import scratch, stored

SHINGLE = 3
SEED = 42
RADIUS = 2
BITS = 64
#: Shingles whose bits are counted together; bounds the memory of a very long text.
CHUNK = 1 << 15


def _shingles(data, offsets, width):
    """(bytes, starts, ends, row): the texts with their words one space apart, and the place of each shingle, row by row."""
    begin, end, first = W.find_words(data, offsets)
    lengths = end - begin
    flat = np.append(data, np.uint8(32))[W.ragged(begin, lengths + 1)]
    to = np.cumsum(lengths + 1) - 1
    flat[to] = 32
    n_words = np.diff(first)
    several = np.where(n_words > 0, np.maximum(n_words - width + 1, 1), 0)
    at = W.ragged(first[:-1], several)
    row = np.repeat(np.arange(len(n_words)), several)
    last = np.minimum(at + width, first[1:][row]) - 1
    return flat.tobytes(), (to - lengths)[at], to[last], row


def simhash(column, width: int = SHINGLE) -> np.ndarray:
    """The fingerprints of an Arrow column of texts, as unsigned 64-bit integers."""
    import xxhash

    data, offsets = W.text_bytes(column, lower=True)
    flat, starts, ends, row = _shingles(data, offsets, width)
    set_in = np.zeros((len(column), BITS), np.int64)
    for k in range(0, len(row), CHUNK):
        part = slice(k, k + CHUNK)
        hashes = np.fromiter((xxhash.xxh64_intdigest(flat[a:b], SEED) for a, b in zip(starts[part].tolist(), ends[part].tolist(), strict=True)), W.U64)
        heads = np.flatnonzero(np.diff(row[part], prepend=-1))
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_in[row[part][heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
    over_half = 2 * set_in > np.bincount(row, minlength=len(column))[:, None]
    return np.packbits(over_half, axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint as a signed 64-bit integer, one row per row."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def find(batches):
        for batch in W.slices(batches, text):
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(simhash(batch.column(text), width).view(np.int64))], names=[id_col, "fp"])

    return docs.select(id_col, text).mapInArrow(find, f"{id_col} {id_type}, fp bigint")


def _owners(fps: DataFrame) -> DataFrame:
    """(value, owners): values within one bit of several of the different fingerprints `fp`, and those fingerprints in order."""
    flips = F.array(*[F.lit(k) for k in range(-1, BITS)])
    emitted = fps.select("fp", F.explode(flips).alias("bit"))
    flipped = lambda x, bit: x.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    itself = F.col("bit") < 0
    values = emitted.select(F.when(itself, F.col("fp")).otherwise(flipped(F.col("fp"), F.col("bit"))).alias("value"), itself.alias("itself"), F.when(itself, F.lit(0).cast("long")).otherwise(flipped(F.lit(0).cast("long"), F.col("bit"))).alias("mask"))
    met = values.groupBy("value").agg(F.max("itself").alias("itself"), F.bit_or("mask").alias("mask"))
    several = met.where(F.bit_count("mask") + F.col("itself").cast("int") > 1)
    changed = F.transform(F.filter(F.array(*[F.lit(k) for k in range(BITS)]), lambda k: F.getbit("mask", k) == 1), lambda k: flipped(F.col("value"), k))
    own = F.when(F.col("itself"), F.array("value")).otherwise(F.array().cast("array<bigint>"))
    return several.select("value", F.array_sort(F.concat(own, changed)).alias("owners"))


def _near():
    return F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS


def links(fps: DataFrame) -> DataFrame:
    """(u, v), u < v: every pair of the fingerprints in column `fp` that is linked. A fingerprint is in at most 2,080 pairs."""
    met = _owners(fps.select("fp").distinct())
    pairs = met.select("owners", F.posexplode("owners").alias("at", "u")).select("u", F.explode(F.expr("slice(owners, at + 2, 65)")).alias("v"))
    return pairs.where(_near()).distinct()


def clusters(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """(id, fp, component_id): one row per row of the table."""
    with scratch(docs.sparkSession) as (kept, paths):
        signed = kept(fingerprints(docs, id_col, text, width), "fingerprints")
        known = signed.where(F.col(id_col).isNotNull())
        classes = kept(known.groupBy("fp").agg(F.min(id_col).alias("least")), "classes")
        # a fingerprint becomes 65 rows: spread them first, the table has few files
        spread = classes.select("fp").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
        met = _owners(spread)
        near = met.select(F.explode("owners").alias("u"), F.col("owners")[0].alias("v")).where(F.col("u") != F.col("v")).where(_near()).distinct()
        # an id with several fingerprints ties them
        tied = known.groupBy(id_col).agg(F.min("fp").alias("v"), F.max("fp").alias("top")).where("v <> top").select(id_col, "v")
        tied = known.join(tied, id_col).select(F.col("fp").alias("u"), "v").where("u <> v").distinct()
        named = classes.select(F.col("fp").alias("u"), F.col("least").alias("a")), classes.select(F.col("fp").alias("v"), F.col("least").alias("b"))
        edges = near.union(tied).join(named[0], "u").join(named[1], "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
        roots = components(edges, paths).select(F.col("u").alias("least"), F.col("v").alias("root"))
        of_class = classes.join(roots, "least", "left").select("fp", F.coalesce("root", "least").alias("component_id"))
        found = signed.join(of_class, "fp", "left")
        return stored(found.select(id_col, "fp", F.when(F.col(id_col).isNotNull(), F.col("component_id")).alias("component_id")), "simhash")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """The document with the smallest id of each component, with its own columns. Rows without an id all stay."""
    gone = clusters(docs, id_col, text, width).where(F.col(id_col) > F.col("component_id")).select(id_col).distinct()
    known = docs.where(F.col(id_col).isNotNull()).join(gone, id_col, "left_anti").select(*docs.columns)
    return known.union(docs.where(F.col(id_col).isNull()))


def op11_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return clusters(docs).select("doc_id", digits.alias("fingerprint"), "component_id")
