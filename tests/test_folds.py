"""Folds in pieces and chunks give what whole videos give; packing and the word rules against brute force."""

import random
import re

import numpy as np
import pytest

from cueforge.operators import cues as C
from cueforge.operators import folds
from cueforge.operators import select as G
from cueforge.operators import structure as S
from cueforge.operators import words as W


def rounded(df):
    order = sorted(df.columns)
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*order).collect()), key=str)


def brute_groups(weights, packing):
    state, out = packing.first, []
    for w in weights:
        joins = state != 0 if packing.budget else state + 1 + w <= packing.most
        out.append(not joins)
        if packing.budget:
            state = state + w if state + w < packing.budget else 0
        else:
            state = state + 1 + w if joins else min(w, packing.most)
    return out


@pytest.mark.parametrize("kind", ["most", "budget"])
def test_packing_in_chunks(spark, kind):
    rnd = random.Random(1)
    rows, want = [], []
    for video in (None, "a", "b"):
        packing = folds.Packing(**{kind: 25})
        weights = [rnd.randrange(1, 40) if rnd.random() < 0.1 else rnd.randrange(1, 9) for _ in range(300)]
        at = sorted(rnd.sample(range(600), 300))
        rows += [(video, p, w) for p, w in zip(at, weights, strict=True)]
        want += [(video, p, int(g)) for p, g in zip(at, np.cumsum(brute_groups(weights, packing)), strict=True)]
    df = spark.createDataFrame(rows, "video string, pos long, w int")
    for size in (7, 100, 1000):
        got = folds.packed(df, ["video"], df.w, folds.Packing(**{kind: 25}), size=size)
        assert sorted(((r.video, r.pos, r._group) for r in got.collect()), key=str) == sorted(want, key=str)


def test_tables_of_random_chunks():
    rnd = random.Random(2)
    for turn in range(300):
        packing = folds.Packing(most=rnd.randrange(1, 30)) if turn % 2 else folds.Packing(budget=rnd.randrange(1, 30))
        weights = [rnd.randrange(1, 12) for _ in range(rnd.randrange(0, 40))]
        after, begun = packing.table(np.array(weights, np.int64))
        for state in range(packing.states):
            ours = packing.begins(np.array(weights, np.int64), state)
            assert begun[state] == ours.sum()
            later = packing.begins(np.array([*weights, 3, 5, 2, 9], np.int64), state)
            assert later[len(weights):].tolist() == packing.begins(np.array([3, 5, 2, 9], np.int64), int(after[state])).tolist()


def word_rows(seed, n):
    rnd = random.Random(seed)
    rows, at = [], 0.0
    for video in ("long", None):
        out = []
        while len(out) < n:
            r = rnd.random()
            out += [rnd.choice(["ha", "no"]), rnd.choice(["ha", "x"])] * rnd.randrange(2, 9) if r < 0.05 else ["very", "so", "well"] * rnd.randrange(3, 7) if r < 0.08 else [rnd.choice("! . ,".split())] if r < 0.2 else ["w" * rnd.randrange(1, 12) + str(rnd.randrange(9))]
        for k, w in enumerate(out):
            timed = rnd.random() < 0.6
            at += rnd.choice([0.0, 0.05, 0.4])
            rows.append((video, 2 * k, w, at if timed else None, at + 0.3 if timed else None, 0.5))
            at += 0.3 if timed else 0.0
    return rows


def test_word_rules_of_long_videos(spark, monkeypatch):
    df = spark.createDataFrame(word_rows(3, 400), "video string, pos long, word string, start double, end double, score double")
    whole = rounded(W.clean_words(df, ["video"]))
    assert folds.split_long(df, ["video"])[1] is None
    for size in (40, 200):
        monkeypatch.setattr(folds, "CHUNK", size)
        assert folds.split_long(df, ["video"])[1].select("_chunk").distinct().count() > 3
        assert rounded(W.clean_words(df, ["video"])) == whole


def test_patterns_stay_once():
    rnd = random.Random(4)
    for _ in range(2000):
        s = "".join(rnd.choice("abc"[: rnd.randrange(1, 4)]) for _ in range(rnd.randrange(0, 60)))
        for size in (2, 3):
            same = np.array([k >= size and s[k] == s[k - size] for k in range(len(s))], bool)
            assert "".join(c for c, keep in zip(s, W.kept_once(same, size), strict=True) if keep) == re.sub(r"(.{%d})\1{3,}" % size, r"\1", s)


def test_gaps_by_hand():
    start, end = np.array([0.0, np.nan, np.nan, 5.0, np.nan]), np.array([2.0, np.nan, np.nan, 6.0, np.nan])
    filled, _ = W.fill_gaps(start, end, np.array([4, 2, 4, 1, 2]))
    # half a second a letter, then 3 s for 6 letters fill the gap up to 5.0
    assert np.allclose(start, [0, 2, 3, 5, 6], atol=1e-5) and np.allclose(end, [2, 3, 5, 6, 6 + 2 * 6 / 11], atol=1e-5)
    assert abs(filled - 3 - 2 * 6 / 11) < 1e-5


def test_cue_times_of_long_videos(spark, monkeypatch):
    rnd = random.Random(5)
    rows = []
    for video in ("a", None):
        at = 0
        for k in range(500):
            at += rnd.choice([0, 0, 30, 400, 2000])
            r = rnd.random()
            end = at if r < 0.3 else at + rnd.choice([1, 1, 20, 20, 300, 300, 300, 2100])
            rows.append((video, k, at - (900 if at > 900 and rnd.random() < 0.05 else 0), end, f"text {k % 7}" * rnd.randrange(0, 3)))
    df = spark.createDataFrame(rows, "video string, pos long, start_ms long, end_ms long, text string")
    whole = rounded(C.repair_times(df, ["video"]))
    assert any("interpolated" in str(r) for r in whole) and any("merged" in str(r) for r in whole)
    for size in (20, 90):
        monkeypatch.setattr(folds, "CHUNK", size)
        assert C._cut(folds.split_long(C.valid_times(df), ["video"])[1], ["video"]).select("video", "_piece").distinct().count() > 6
        assert rounded(C.repair_times(df, ["video"])) == whole


def test_records_and_summaries_of_long_videos(spark, monkeypatch):
    rnd = random.Random(6)
    texts = [(v, k, " ".join("word" for _ in range(rnd.randrange(0, 9))) or rnd.choice(["", "  ", None, "日本語のテキスト"])) for v in ("a", "b") for k in range(300)]
    df = spark.createDataFrame(texts, "video string, pos long, text string")
    records = df.selectExpr("video", "pos", "text as src_text", "pos * 2.0D as start", "pos * 2.0D + 1 as end")
    whole = rounded(S.merged_records(records, ["video"], 60)), rounded(G.summary_windows(df, ["video"], 20, 50))
    assert all(len(r[2]) <= 60 for r in whole[0]) and all(r[5] >= 20 for r in whole[1])
    monkeypatch.setattr(folds, "CHUNK", 25)
    assert (rounded(S.merged_records(records, ["video"], 60)), rounded(G.summary_windows(df, ["video"], 20, 50))) == whole


def test_word_rules_in_one_pass(spark):
    """Short videos go through all word rules in one pass over their rows, with the same result as rule by rule; rows of many videos are folded together."""
    rows = [(v if v else None, *r[1:]) for v in range(40) for r in word_rows(v, 60) if r[0]]
    df = spark.createDataFrame(rows, "video long, pos long, word string, start double, end double, score double")
    fused = W.clean_words(df, ["video"])
    plan = fused._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "FlatMapGroupsInPandas" not in plan
    for _, rule in W.steps(["video"]):
        df = rule(df)
    assert rounded(fused) == rounded(df) and 0 < df.count() < len(rows)
