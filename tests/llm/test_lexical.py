"""Ranked lexical search by ball trees against scoring every document."""

import collections
import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cueforge.llm import lexical
from tests.llm.test_llm import LOWER, ODD, clashing, rows

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return [t.translate(LOWER) for t in TERM.findall((text or "").encode())]


def brute(docs, items, top=10):
    """docs: (id, text); items: (id, text). Returns sorted (item, rank, doc, score)."""
    split = [(i, terms_of(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(ts) for _, ts in split), sum(len(ts) for _, ts in split)
    df = collections.Counter(t for _, ts in split for t in set(ts))
    of = collections.defaultdict(set)
    for item, text in items:
        of[item] |= set(terms_of(text))
    out = []
    for item, asked in of.items():
        found = []
        for i, ts in split:
            tf, m = collections.Counter(ts), 10 + 90 * len(ts) * n_docs // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in asked if tf[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, k, i, -s) for k, (s, _, _, i) in enumerate(sorted(found, key=lambda x: x[:3])[:top], 1)]
    return out


def prose(rnd, n, topic, own=0.3):
    return " ".join(f"{rnd.choice('abcdefg')}{min(int(rnd.expovariate(0.05)), 300)}" + (f"t{topic}" if rnd.random() < own else "") for _ in range(n))


def corpus(seed, n, own=0.3):
    """own: share of words that only texts of the same topic have."""
    rnd = random.Random(seed)
    docs = [prose(rnd, rnd.randrange(1, 120), rnd.randrange(6), own) for _ in range(n)]
    docs += [docs[3]] * 20 + ODD
    items = [(f"i{k}", f"{prose(rnd, 12, k % 6, own)} {docs[rnd.randrange(n)][:60]}") for k in range(12)]
    return docs, [*items, ("none", None), ("empty", " .,"), ("far", "zzz qqq"), ("i1", "a1 b2 É"), ("i1", "a1 b2 É"), (None, "a1 b1 SAME")]


def key(r):
    return (str(r[0] or ""), r[1])


def found_by(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=key)


def test_search(spark, monkeypatch):
    docs, items = corpus(12, 500)
    monkeypatch.setattr(lexical, "TREE_BYTES", 20_000)
    asked = spark.createDataFrame(items, "item_id string, text string").withColumn("score", F.lit("x")).withColumn("h", F.lit(1))
    want = sorted(brute(list(enumerate(docs)), items), key=key)
    whole = clashing(spark, docs).withColumn("rank", F.lit(0)).repartition(5)
    assert found_by(lexical.ranked(whole, asked)) == want
    assert found_by(lexical.ranked(whole, asked, block_terms=20)) == want
    assert found_by(lexical.ranked(whole, asked, top=3)) == [r for r in want if r[1] <= 3]


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, "one two"), ("b", "one two"), ("a", "one two"), ("a", None), (None, "three")], "doc_id string, text string")
    items = spark.createDataFrame([(1, "ONE three four"), (None, "two")], "item_id int, text string")
    got = found_by(lexical.ranked(docs, items))
    assert [(r[0], r[1], r[2]) for r in sorted(got, key=lambda r: (r[0] or 0, r[1]))] == [(None, 1, "a"), (None, 2, "b"), (None, 3, None), (1, 1, None), (1, 2, "a"), (1, 3, "b"), (1, 4, None)]
    assert lexical.ranked(docs.limit(0), items).count() == 0
    assert lexical.ranked(docs, items.limit(0)).count() == 0


def test_bounds_hold_and_prune():
    docs, items = corpus(13, 1500, 0.9)
    hashes, first = lexical._terms(pa.record_batch([pa.array(docs)], ["text"]), "text")
    item_hashes, item_first = lexical._terms(pa.record_batch([pa.array([t for _, t in items])], ["text"]), "text")
    pairs = sorted({(int(r), int(h)) for r, h in zip(lexical.W.rows_of(item_first), item_hashes, strict=True)})
    rnd = random.Random(5)
    weights = {h: rnd.choice([1, 5, 300, 4000, 12_999]) for _, h in pairs}
    table = pa.table({"item": [r for r, _ in pairs], "h": pa.array(np.array([h for _, h in pairs], np.uint64).view(np.int64)), "w": pa.array([weights[h] for _, h in pairs], pa.int64())})
    block = lexical.Items(table)
    rows_, bounds, term, impact = lexical.vectors(block, hashes, first, len(docs), len(hashes))
    tree = lexical.BallTree(block, bounds, term, impact)
    assert sorted(tree.order.tolist()) == list(range(len(rows_)))
    opened = []
    for terms in block.terms:
        dense = np.zeros(len(block.weight), np.int64)
        dense[terms] = block.weight[terms]
        scores = np.add.reduceat(dense[tree.term] * tree.impact, tree.bounds[:-1])
        for level, cuts in enumerate(tree.cuts):
            for node, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                assert tree.bound(level, node, terms, block.weight[terms], block.band[terms]) >= scores[a:b].max()
        seen = []
        best = lexical.Best(10)
        opened.append(tree.search(terms, dense, lambda best=best: best.least, lambda a, s, best=best, seen=seen: (seen.append(a), best.add(s, range(a, a + len(s))))) / (len(tree.cuts[-1]) - 1))
        assert [-r[0] for r in best.rows] == sorted((int(s) for s in scores if s > 0), reverse=True)[:10]
        assert len(seen) == len(set(seen))
    assert sum(opened) / len(opened) < 0.7  # whole subtrees are left out


def test_twin(spark, tmp_path):
    docs, items = corpus(14, 150)
    rows(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = sorted(con.execute(lexical.OP12_SQL).fetchall(), key=key)
    assert found_by(lexical.op12_ranked_lexical_search(spark, str(tmp_path))) == want
