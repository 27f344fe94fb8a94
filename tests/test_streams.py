"""Streams in many micro-batches give what batch gives; timers, late rows and batches that come twice."""

import datetime
import random

from pyspark.sql import functions as F

from cueforge.operators import cues as C
from cueforge.operators import words as W
from cueforge.streaming import streams as V
from tests.test_folds import rounded, word_rows


def fed(spark, batches, schema):
    """One file and so one micro-batch for each list of rows."""
    path = V.folder(spark, "feed")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return V.source(spark, path, spark.createDataFrame([], schema).schema, per_trigger=1)


def in_batches(rows, n, at=1):
    """Rows with `last` added, in n batches that cut videos anywhere."""
    top = {}
    for r in rows:
        top[r[0]] = max(top.get(r[0], -1), r[at])
    rows = sorted((*r, r[at] == top[r[0]]) for r in rows)
    size = -(-max(top.values()) // n)
    return [[r for r in rows if r[at] // size == k] for k in range(n + 1)]


def test_cues_in_many_batches(spark):
    rnd = random.Random(7)
    rows = []
    for video in (1, 2):
        at = 0
        for k in range(150):
            at += rnd.choice([0, 0, 30, 400, 2000])
            end = at if rnd.random() < 0.3 else at + rnd.choice([1, 20, 300, 2100])
            rows.append((video, k, at, end, rnd.choice(["", "a  text", "« b »", "x &amp; y", "..."])))
    schema = "video long, pos long, start_ms long, end_ms long, text string"
    batch = C.repair_times(C.not_empty(C.clean_text(spark.createDataFrame(rows, schema))), ["video"])
    stream = V.by_batch(V.settled_cues(fed(spark, in_batches(rows, 6), schema + ", last boolean")), "cues", V.repaired)
    assert rounded(stream.select(*sorted(batch.columns))) == rounded(batch) and batch.count() > 100


def test_words_in_many_batches(spark):
    rows = [(1 if r[0] else 2, *r[1:]) for r in word_rows(8, 200)]
    schema = "video long, pos long, word string, start double, end double, score double"
    batch = W.clean_words(spark.createDataFrame(rows, schema), ["video"])
    stream = V.settled_words(fed(spark, in_batches(rows, 5), schema + ", last boolean"))
    pieces = V.by_batch(stream, "pieces")
    assert pieces.select("video", "_piece").distinct().count() > 4
    assert rounded(V.finished_words(pieces)) == rounded(batch)


T0 = datetime.datetime(2026, 1, 1)
TIMED = V.SEGMENT + ", lang string, ts timestamp"


def segment(video, seq, text, minute, lang="en", last=False):
    return (video, seq, float(seq), seq + 0.5, text, "a", last, lang, T0 + datetime.timedelta(minutes=minute))


def test_timers_end_idle_videos(spark):
    """Nobody sends `last`: video 1 falls silent while others go on, comes back and keeps its count; a heartbeat of no video ends the rest."""
    batches = [
        [segment(1, 0, "Good morning. And", 0), segment(2, 0, "Bonjour M. Dupont. Ça va", 0, "fr")], [segment(2, 1, "bien", 20, "fr")], [segment(2, 2, "merci", 60, "fr")],
        [segment(1, 1, "back again", 70)], [segment(None, 0, "", 60 * 24 * 30)], [segment(None, 0, "", 60 * 24 * 60)],
    ]
    out = V.drained(V.sentences(fed(spark, batches, TIMED), ts="ts", late="1 minute", idle=600), "sentences").where("video is not null")
    got = sorted((r.video, r.rec_id, r.text) for r in out.collect())
    assert got == [(1, 0, "Good morning."), (1, 1, "And"), (1, 2, "back again"), (2, 0, "Bonjour M. Dupont."), (2, 1, "Ça va bien merci")]


def test_summaries_are_cut(spark):
    rows = [(1, k, 0.0, 1.0, "word " * 30, "a", k == 9) for k in range(10)]
    out = V.drained(V.summary_windows(fed(spark, [rows[:3], rows[3:7], rows[7:]], V.SEGMENT), 80, 100), "cut").collect()
    assert sorted((r.version, r.words, len(r.body)) for r in out) == [(1, 90, 100), (2, 90, 100), (3, 90, 100)]


def test_gaps_out_of_order(spark):
    rnd = random.Random(9)
    seqs = sorted(rnd.sample(range(400), 250))
    late = sorted(seqs, key=lambda s: s + rnd.randrange(40))
    batches = [[(1, s, s == -1) for s in late[k : k + 50]] for k in range(0, 250, 50)]
    batches.append([(1, 400, True)])
    stream = V.drained(V.sequence_gaps(fed(spark, batches, "video long, seq long, last boolean"), slack=60), "gaps")
    batch = W.gaps(spark.createDataFrame([(1, s) for s in [*seqs, 400]], "video long, seq long"), ["video"])
    assert rounded(stream) == rounded(batch.select("video", "seq", F.col("missing").cast("long").alias("missing")))


def test_a_batch_written_twice_is_there_once(spark):
    to = V.folder(spark, "errors")
    write = V.batch_writer(to, lambda df: df.where("category <> 'x'"), "json", ("category",))
    first = spark.createDataFrame([(1, "permanent"), (2, "degraded"), (3, "x")], "id int, category string")
    write(first, 0)
    write(first, 0)
    write(spark.createDataFrame([(4, "permanent")], "id int, category string"), 1)
    assert sorted((r.batch, r.category, r.id) for r in spark.read.json(to).collect()) == [(0, "degraded", 2), (0, "permanent", 1), (1, "permanent", 4)]


def test_videos_share_a_group(spark):
    """Large ids and the null video, all in one state or each in its own, give what batch gives; W5 and W3 done in the stream too."""
    large = (1 << 60) + 1
    rows = [r for v, seed in ((large, 11), (large + 1, 12), (None, 13)) for r in [(v, *x[1:]) for x in word_rows(seed, 90) if x[0]]]
    schema = "video long, pos long, word string, start double, end double, score double"
    batch = rounded(W.clean_words(spark.createDataFrame(rows, schema), ["video"]))
    top = {}
    for r in rows:
        top[r[0]] = max(top.get(r[0], -1), r[1])
    batches = [[(*r, r[1] == top[r[0]]) for r in rows if r[1] // 40 == k] for k in range(max(top.values()) // 40 + 1)]
    for groups, joined in ((1, True), (1, False), (64, True)):
        stream = V.settled_words(fed(spark, batches, schema + ", last boolean"), joined=joined, groups=groups)
        assert rounded(V.by_batch(stream, "words", lambda df, j=joined: V.finished_words(df, joined=j))) == batch


def test_pieces_are_finished_in_one_shuffle(spark):
    pieces = spark.createDataFrame([(1, 0, "a", 0.0, 0.1, 0.5, 0)], "video long, pos long, word string, start double, end double, score double, _piece long")
    assert V.finished_words(pieces)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
