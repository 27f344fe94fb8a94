"""What larger tables ask of the operators: no work that grows faster than the rows, no shuffle that isn't needed."""

import pyarrow as pa
from pyspark.sql import functions as F

from cueforge.functions import text as X
from cueforge.operators import align as A
from cueforge.operators import cues as C
from cueforge.operators import reports as R
from cueforge.operators import structure as S
from cueforge.operators import words as W
from tests.test_folds import word_rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_that_stand_in_the_text_need_no_pattern(monkeypatch):
    def no(*_):
        raise AssertionError("compiled")

    monkeypatch.setattr(A.re, "compile", no)
    assert A.find_span("It isn't, so there !".split(), "It isn't, so there !", 0) == (0, 5)
    assert A.find_span("art is art".split(), "start, art is art", 0) == (0, 3)


def test_long_rows_take_their_words_apart(spark):
    n = 30_000
    words = [{"word": f"w{k}", "start": float(k), "end": k + 0.5} for k in range(n)]
    chunks = [" ".join(w["word"] for w in words[k : k + 3]) for k in range(0, n, 3)]
    rows = spark.createDataFrame([(1, words, chunks), (2, words[:2], ["W0", "- w1"]), (3, None, None)], "video int, words array<struct<word:string,start:double,end:double>>, chunks array<string>")
    got = A.aligned_segments(rows).orderBy("video", "chunk_pos").collect()
    assert [(r.chunk_pos, r.text, r.start, r.end, len(r.words)) for r in got[: n // 3]] == [(k, c, 3.0 * k, 3 * k + 2.5, 3) for k, c in enumerate(chunks)]
    assert [(r.video, r.text, r.start, r.end) for r in got[n // 3 :]] == [(2, "W0", 0.0, 0.5), (2, "- w1", 1.0, 1.5)]


def test_pushed_cues_go_over_sorted_rows(spark):
    rows = [(v, k, 100 * (k // 3), 100 * (k // 3), f"t{k} " * 60) for v in range(3) for k in range(9)]
    df = spark.createDataFrame(rows, "video int, pos long, start_ms long, end_ms long, text string")
    out = C.repair_times(df, ["video"])
    assert "FlatMapGroupsInPandas" not in plan(out)
    got = {v: [(r.start_ms, r.end_ms, r.note) for r in out.where(f"video = {v}").orderBy("pos").collect()] for v in range(3)}
    assert got[0] == got[1] == got[2] and len(got[0]) == 9
    assert got[0][:4] == [(0, 33, "interpolated"), (33, 66, "interpolated"), (66, 99, "interpolated"), (100, 133, "interpolated")]


def test_punctuation_joins_words_in_one_shuffle(spark):
    rows = [(1, 0, ",", 0.0, 0.1, "a"), (1, 1, "(", 0.2, 0.3, "b"), (1, 2, " Hi", 0.3, None, "c"), (1, 3, " )", 0.5, 0.6, "d"), (1, 4, "(", None, None, "e"), (1, 5, ")", None, None, "f"), (1, 6, "x", 1.0, 2.0, "g"), (2, 0, "]", 0.0, 0.1, "h")]
    out = W.attach_punctuation(spark.createDataFrame(rows, "video int, pos long, word string, start double, end double, who string"), ["video"])
    assert plan(out).count("Exchange hashpartitioning") == 1
    assert [tuple(r) for r in out.orderBy("video", "pos").collect()] == [
        (1, 0, ",", 0.0, 0.1, "a"), (1, 1, "(Hi)", 0.2, 0.6, "d"), (1, 4, "()", None, None, "f"), (1, 6, "x", 1.0, 2.0, "g"), (2, 0, "]", 0.0, 0.1, "h"),
    ]


def test_word_times_are_made_without_a_shuffle(spark):
    rows = spark.createDataFrame([(1, 0.0, 4.0, ["ab", "éé", "c"]), (2, 1.0, 2.0, []), (3, 1.0, 2.0, None), (4, 0.0, 1.0, ["x"])], "seg int, start double, end double, words array<string>")
    out = W.synthesized(rows)
    assert "Exchange" not in plan(out)
    assert [(r.seg, r.pos, r.word, round(r.w_start, 9), round(r.w_end, 9)) for r in out.collect()] == [(1, 0, "ab", 0.0, 1.6), (1, 1, "éé", 1.6, 3.2), (1, 2, "c", 3.2, 4.0), (4, 0, "x", 0.0, 1.0)]


def test_sentences_shuffle_stretches_not_tokens(spark):
    texts = ['He said "go . " " And Dr. Smith', "left at U.S.A. time. [? a b. ?] Then", '" so', "", None, "! ” ok"]
    df = spark.createDataFrame([("v", k, t) for k, t in enumerate(texts)], "video string, pos long, text string")
    tokens = S.token_rows(df, ["video"])
    assert S.stretches(df, ["video"]).count() < tokens.count()
    want = S.collected(S.with_groups(tokens, ["video"], S.ends_sentence(F.col("token"))), ["video"]).orderBy("sent_id").collect()
    got = S.sentences(df, ["video"], n_segments="n").orderBy("sent_id").collect()
    assert [(r.sent_id, r.tokens) for r in got] == [(r.sent_id, r.tokens) for r in want] and len(got) > 2
    assert sum(r.n for r in got) == 4


def test_cascades_need_no_shuffle(spark):
    rows = spark.createDataFrame([(1, "one two. three four, five"), (2, "short"), (3, None)], "id int, t string")
    out = S.cascade(rows, "t", 9, [S.split_sentences, S.split_clauses, lambda c: S.split_by_length(c, 9)])
    assert "Exchange" not in plan(out) and "Join" not in plan(out)
    assert [(r.id, r.chunk) for r in out.orderBy("id", "path").collect()] == [(1, "one two."), (1, "three"), (1, "four,"), (1, "five"), (2, "short"), (3, None)]


def test_content_keys_are_made_of_changed_texts_only(spark, monkeypatch):
    seen = []
    key = X.content_key
    monkeypatch.setattr(X, "content_key", lambda c: seen.append(c) or key(c))
    out = R.cleaning_invariants(spark.createDataFrame([(1, 0, "a  b"), (1, 1, "same"), (2, 0, None), (3, 0, "x")], "video int, pos long, text string"), ["video"])
    assert len(seen) == 4 and all("CASE WHEN" in str(c) for c in seen)
    assert [tuple(r) for r in out.orderBy("video").collect()] == [(1, True, True, True), (2, None, None, None), (3, True, True, True)]


def test_few_texts_are_objects_together(monkeypatch):
    sizes = []
    monkeypatch.setattr(X, "SLICE_BYTES", 10)
    texts = pa.array(["abcd", "ef", None, "", "x" * 25, "éé", "ghijkl"])
    got = X.in_slices(texts, lambda some: sizes.append(some) or [t and t.upper() for t in some], pa.string())
    assert got.to_pylist() == [t and t.upper() for t in texts.to_pylist()]
    assert sizes == [["abcd", "ef", None, ""], ["x" * 25], ["éé", "ghijkl"]]
    assert X.in_slices(texts[:0], lambda some: some, pa.string()).to_pylist() == []


def test_words_are_shuffled_once_to_their_segments(spark):
    words = spark.createDataFrame([("v", k, k * 0.5, k * 0.5 + 0.4) for k in range(400)], "video string, pos long, start double, end double")
    segs = spark.createDataFrame([("v", 0, 190.0, 1e6), ("v", 1, 31.9, 32.6), ("v", 2, 0.0, 100.0)], "video string, seg_pos int, seg_start double, seg_end double")
    out = W.assign_to_segments(words, segs, ["video"])
    assert not [x for x in plan(out).splitlines() if "Exchange hashpartitioning" in x and "pos#" in x.split("ENSURE")[0]]
    got = {r.pos: r.seg_pos for r in out.collect()}
    assert got == {k: 0 if k >= 380 else 1 if k == 64 else 2 for k in range(400) if k < 200 or k >= 380}


def test_words_are_counted_after_each_rule_in_one_pass(spark, monkeypatch):
    rows = [(v if v else None, *r[1:]) for v in range(20) for r in word_rows(v, 60) if r[0]] + [(99, k, w, None, None, 0.5) for k, w in enumerate(["\u00a0", " ", "x" * 60, "x" * 60])]
    df = spark.createDataFrame(rows, "video long, pos long, word string, start double, end double, score double")
    want, now = [], df
    for name, rule in [("raw", lambda d: d), *W.steps(["video"])]:
        now = rule(now)
        want.append((len(want), name, now.count(), now.where("start is null").count()))

    def no(*_):
        raise AssertionError("written")

    monkeypatch.setattr(W, "written", no)
    out = W.step_deltas(df, ["video"])
    assert plan(out).count("Exchange hashpartitioning") == 1
    got = out.orderBy("step").collect()
    assert [tuple(r)[:4] for r in got] == want and [r.change for r in got] == [None, *(b[2] - a[2] for a, b in zip(want, want[1:], strict=False))]
    assert len({r.words for r in got}) > 4
    assert [(r.words, r.untimed) for r in W.step_deltas(df.limit(0), ["video"]).collect()] == [(0, 0)] * 8
