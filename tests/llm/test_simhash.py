"""SimHash near-dedup against brute force."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from cueforge.llm import simhash
from tests.llm.test_llm import LOWER, ODD, WORD, clashing, rows, story


def brute_fingerprint(text):
    ws = WORD.findall((text or "").encode().translate(LOWER))
    hashes = [xxhash.xxh64_intdigest(b" ".join(ws[i : i + 3]), 42) for i in range(max(1, len(ws) - 2))] if ws else []
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def brute_components(docs, fps):
    """docs: (id, fingerprint) with ids that may repeat."""
    parent = {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in docs:
        for j, b in docs:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i, _ in docs}


def test_fingerprints_and_components(spark):
    rnd = random.Random(11)
    base = [story(rnd, 300, 5000) for _ in range(25)]
    texts = [*ODD, *base]
    for t in base * 3:  # near copies
        ws = t.split()
        for _ in range(rnd.randrange(0, 4)):
            ws[rnd.randrange(len(ws))] = "W%d" % rnd.randrange(50)
        texts.append("  ".join(ws))
    texts += ["a b", "A\tB", "a b c", "x " * 70_000]
    fps = [brute_fingerprint(t) for t in texts]
    got = simhash.clusters(clashing(spark, texts)).collect()
    assert {r.doc_id: r.fp % 2**64 for r in got} == dict(enumerate(fps))
    want = brute_components(list(enumerate(fps)), fps)
    assert {r.doc_id: r.component_id for r in got} == want
    assert len(set(want.values())) < len(texts) - 5
    kept = simhash.one_of_each(rows(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_all_links_between_random_neighbours(spark):
    rnd = random.Random(12)
    fps = {0, 2**64 - 1, 1 << 63}
    for _ in range(150):
        centre = rnd.getrandbits(64)
        fps |= {centre ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) ^ (rnd.random() < 0.5) << rnd.randrange(64) for _ in range(8)}
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    got = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= 2}
    assert {(r.u, r.v) for r in got} == want and len(got) == len(want) > 50


def test_ids(spark):
    """Null ids, one id with two texts, string ids, and no rows."""
    df = spark.createDataFrame([("b", "one two three four"), ("b", "quite other words here now"), ("c", "quite other words here now"), ("a", "one two three four"), (None, "one two three four"), (None, None)], "doc_id string, text string")
    got = sorted((r.doc_id or "", r.component_id) for r in simhash.clusters(df).collect())
    assert got == [("", None), ("", None), ("a", "a"), ("b", "a"), ("b", "a"), ("c", "a")]
    assert simhash.clusters(df.limit(0)).count() == 0
    assert simhash.one_of_each(df).count() == 3


def test_large_class(spark):
    """Thousands of equal fingerprints and a full ball of neighbours stay linear."""
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("the same few words again").alias("text"))
    assert {r.component_id for r in simhash.clusters(df).collect()} == {0}
    ball = spark.createDataFrame([(x,) for x in [0, *[1 << k for k in range(63)], -(1 << 63)]], "fp long")
    assert simhash.links(ball).count() == 65 * 64 // 2


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_short_texts(n):
    import pyarrow as pa

    text = " ".join(["Ab", "C", "é", "d"][:n])
    assert simhash.simhash(pa.array([text]))[0] == brute_fingerprint(text)
