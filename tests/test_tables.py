"""Cues, words, ledgers, state, files and streams on small tables."""

import pytest
from pyspark.sql import functions as F

from cueforge.functions import text as X
from cueforge.operators import cues as C
from cueforge.operators import ledger as U
from cueforge.operators import select as G
from cueforge.operators import state as D
from cueforge.operators import structure as S
from cueforge.operators import words as W
from cueforge.sources import files as R
from cueforge.streaming import streams as V

SRT = "﻿1\r\n00:00:01,000 --> 00:00:02,5\r\nHello , you\r\nthere\r\n\r\n\r\nbad block\r\n\r\n00:00:03.000 --> 00:00:04.000\nno index\n\n4\n00:00:05,000 --> 00:00:06,000\n"


def test_parse(spark):
    got = C.parse_cues(spark.createDataFrame([("f", SRT), ("g", "")], "path string, content string")).orderBy("pos").collect()
    assert [(r.path, r.pos, r.start_ms, r.end_ms, r.text, r.raw) for r in got] == [
        ("f", 0, 1000, 2500, "Hello , you there", "Hello , you\nthere"),
        ("f", 1, 3000, 4000, "no index", "no index"),
    ]


@pytest.mark.parametrize("name", ["utf-8", "utf-8-sig", "utf-16", "gb18030"])
def test_encodings(spark, tmp_path, name):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.srt").write_bytes("1\n00:00:01,000 --> 00:00:02,000\n你好，世界\n".encode(name))
    got = C.parse_cues(R.caption_files(spark, str(tmp_path))).collect()
    assert [r.text for r in got] == ["你好，世界"]


def cues(spark, *rows):
    return spark.createDataFrame([("v", i, a, b, t) for i, (a, b, t) in enumerate(rows)], "video string, pos long, start_ms long, end_ms long, text string")


def times(df):
    return [(r.start_ms, r.end_ms, r.text, r.note) for r in df.orderBy("pos").collect()]


def test_times(spark):
    got = times(C.repair_times(cues(spark, (0, 1050, "a"), (1000, 2500, "b"), (2000, 3000, "c"), (-5, 3, "bad")), ["video"]))
    assert got == [(0, 1000, "a", ""), (1000, 2500, "b", "overlap"), (2000, 3000, "c", "")]
    # a cue of no length joins the one that starts with it
    got = times(C.repair_times(cues(spark, (0, 0, "a"), (0, 900, "b"), (1000, 2000, "c")), ["video"]))
    assert got == [(0, 900, "a b", "merged-zero-duration"), (1000, 2000, "c", "")]
    # alone it borrows from the gap, and with no gap it pushes
    got = times(C.repair_times(cues(spark, (0, 0, "a"), (500, 900, "b")), ["video"]))
    assert got == [(0, 50, "a", "interpolated"), (500, 900, "b", "")]
    got = C.repair_times(cues(spark, (0, 0, "a" * 100), (0, 900, "b" * 100)), ["video"]).orderBy("pos").collect()
    assert got[0].issues == ["T1_MERGE_LIMIT_EXCEEDED"] and len(got) == 2


def test_bad_files_are_set_aside(spark):
    bad = "1\n00:00:00,000 --> 00:00:00,000\n" + "a" * 100 + "\n\n2\n00:00:00,000 --> 00:00:01,000\n" + "b" * 100 + "\n"
    good = "1\n00:00:01,000 --> 00:00:02,000\nfine\n"
    kept, issues = R.clean_captions(spark.createDataFrame([("bad", bad), ("good", good)], "path string, content string"))
    assert [r.path for r in kept.collect()] == ["good"]
    assert [r.path for r in issues.collect()] == ["bad"]


def words(spark, *rows):
    data = [("v", i, *r, 1.0) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "video string, pos long, word string, start double, end double, score double")


def listed(df):
    return [r.word for r in df.orderBy("pos").collect()]


def test_words(spark):
    v = ["video"]
    assert listed(W.drop_untimed_repeats(words(spark, ("a", None, None), ("a", None, None), ("a", 0.0, 1.0)), v)) == ["a", "a"]
    filled = W.fill_times(words(spark, ("ab", 0.0, 1.0), ("cd", None, None), ("ef", 1.5, 2.0)), v).orderBy("pos").collect()
    assert filled[1].start == 1.0 and filled[1].end == 1.5 and filled[1].score == 0.0
    touching = W.fill_times(words(spark, ("ab", 0.0, 1.0), ("cd", None, None), ("ef", 1.0, 2.0)), v).orderBy("pos").collect()
    assert touching[0].end == pytest.approx(0.99) and touching[1].start == pytest.approx(0.99) and touching[1].end == 1.0
    joined = W.attach_ascii(words(spark, ("!", 0.0, 0.1), ("a", 0.0, 1.0), (",", 1.0, 1.2), ("?", 1.2, 1.3), ("b", 2.0, 3.0)), v)
    assert [(r.word, r.end) for r in joined.orderBy("pos").collect()] == [("!", 0.1), ("a,?", 1.3), ("b", 3.0)]
    ten = [("x", 0.0, 1.0), ("y", 0.0, 1.0)] * 4 + [("x", 0.0, 1.0), ("z", 0.0, 1.0)]
    assert listed(W.collapse_repeats(words(spark, *ten), v, 2)) == ["x", "y", "x", "z"]
    assert listed(W.collapse_repeats(words(spark, *ten[:6]), v, 2)) == ["x", "y"] * 3
    assert listed(W.shorten_long(words(spark, ("A" * 31, 0.0, 1.0), ("a" * 31, 0.0, 1.0), ("a" * 51, 0.0, 1.0), ("1" * 31, 0.0, 1.0)))) == ["...", "a" * 31, "...", "1" * 31]
    attached = W.attach_punctuation(words(spark, ("(", 0.0, 0.1), ("a", 0.2, 0.5), (")", 0.5, 0.6), ("b", 1.0, 2.0)), v)
    assert [(r.word, r.start, r.end) for r in attached.orderBy("pos").collect()] == [("(a)", 0.0, 0.6), ("b", 1.0, 2.0)]


def test_containment(spark):
    segs = spark.createDataFrame([("v", 0, 0.0, 100.0), ("v", 1, 50.0, 70.0)], "video string, seg_pos int, seg_start double, seg_end double")
    got = W.assign_to_segments(words(spark, ("a", 59.0, 61.0), ("b", 99.0, 101.0), ("c", 100.0, 100.0)), segs, ["video"])
    assert sorted((r.pos, r.seg_pos) for r in got.collect()) == [(0, 0), (2, 0)]


def test_asr(spark):
    doc = '{"segments": [{"start": 0, "end": 2, "text": "a b", "speaker": "s"}, {"start": 2, "end": 2, "text": "c d"}, {"start": 3, "end": 1, "text": "e"}, {"start": 4, "end": 5, "text": "x", "speaker": "t", "words": [{"word": "x", "start": 4.1, "end": 4.2}]}]}'
    top = '{"word_segments": [{"word": "z", "start": 1, "end": 2}]}'
    got = R.asr_words(spark.createDataFrame([("v", doc), ("w", top), ("n", "not json")], "video string, content string")).orderBy("video", "pos").collect()
    assert [(r.video, r.word, r.start, r.end, r.speaker) for r in got] == [
        ("v", "a", 0.0, 1.0, "s"), ("v", "b", 1.0, 2.0, "s"), ("v", "c d", 2.0, 2.0, None), ("v", "x", 4.1, 4.2, "t"), ("w", "z", 1.0, 2.0, None),
    ]


def test_ledger(spark):
    rows = spark.createDataFrame([(1, "a", 1, 2, None, 1), (1, "", 1, 2, 0.5, 1), (2, "a", 0, 0, None, 1), (2, "b", 1, 1, 1.0, 1)], "user_id int, model string, prompt_tokens long, completion_tokens long, cost_usd double, requests long")
    got = {r.user_id: (r.model, r.cost_usd) for r in U.usage_sum(rows, ["user_id"]).collect()}
    assert got == {1: ("a", 0.5), 2: ("", 1.0)}
    assert U.counted(rows.withColumn("ts", F.current_timestamp())).count() == 3


def test_state(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    log = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id int, v string, seq long")
    assert sorted(tuple(r) for r in D.patched(old, log, ["id"]).collect()) == [(1, "a"), (2, "d"), (3, "e")]
    now = spark.createDataFrame([("v", s, "1") for s in D.STEPS], "video string, step string, value string")
    was = spark.createDataFrame([("v", "raw", "1"), ("v", "preprocess.punc", "1"), ("v", "preprocess.chunk", "0"), ("v", "translate", "1")], "video string, step string, value string")
    assert {r.step for r in D.stale_steps(now, was, ["video"]).where("stale").collect()} == {"preprocess.chunk", "translate", "tts"}
    assert D.fingerprint({"a": 1, "b": 2}) == D.fingerprint({"b": 2, "a": 1})
    good, newer = D.upgraded(spark.createDataFrame([(1, None), (2, 3)], "id int, schema_version int"))
    assert good.first().variants == {} and newer.count() == 1


def brute_window(accepted, size, drop):
    held, out = [], []
    for k, ok in enumerate(accepted):
        out.append(list(held))
        if ok:
            held.append(str(k))
            if len(held) > size:
                held = held[drop:]
    return out


@pytest.mark.parametrize("size", [1, 3, 4, 5])
def test_context_window(spark, size):
    accepted = [k % 4 != 1 for k in range(40)]
    rows = spark.createDataFrame([("v", k, ok, str(k)) for k, ok in enumerate(accepted)], "video string, k int, ok boolean, pair string")
    got = [r.context for r in G.context_window(rows, ["video"], F.col("k"), F.col("ok"), "pair", size=size).orderBy("k").collect()]
    assert got == brute_window(accepted, size, max(int(size * 0.5), 1))


def test_alignment(spark):
    rows = spark.createDataFrame([(1, ["one two.", "three", "four five"], "uno dos. tres cuatro cinco"), (2, ["a"], "x y"), (3, [], "x"), (4, ["a", "b"], "x")], "rec_id int, segments array<string>, translation string")
    got = {r.rec_id: r.pieces for r in G.aligned(rows, "rec_id").collect()}
    assert got[1][0] == "uno dos." and " ".join(got[1]) == "uno dos. tres cuatro cinco"
    assert got[2] == ["x y"] and got[3] == [] and got[4] == ["x", ""]


def test_stream_equals_batch(spark):
    texts = ["Hello there. How", "are you? Fine", "thanks", "Dr. Who came.", "Bye"]
    rows = spark.createDataFrame([(1, k, float(k), k + 0.5, t, "a" if k < 4 else "b", k == 4) for k, t in enumerate(texts)], V.SEGMENT)
    path = V.folder(spark, "feed")
    for k in range(5):  # one file, and so one batch, for each segment
        rows.where(F.col("seq") == k).coalesce(1).write.mode("append").parquet(path)
    got = V.drained(V.sentences(V.source(spark, path, rows.schema, per_trigger=1)), "out").orderBy("rec_id").collect()
    assert [r.text for r in got] == ["Hello there.", "How are you?", "Fine thanks Dr. Who came.", "Bye"]
    runs = S.speaker_runs(rows.withColumn("pos", F.col("seq")), ["video"])
    batch = S.sentences(runs, ["video", "run"]).orderBy("run", "sent_id").select(F.array_join("tokens", " ")).collect()
    assert [r[0] for r in batch] == [r.text for r in got]


def test_empty_tables(spark):
    none = cues(spark, (0, 1, "x")).limit(0)
    assert C.repair_times(none, ["video"]).count() == 0
    assert C.clean_text(none).count() == 0
    assert W.clean_words(words(spark, ("a", 0.0, 1.0)).limit(0), ["video"]).count() == 0
    assert X.language_code(F.lit("x")) is not None
