"""Streams of segments and events with Structured Streaming.

State is kept per video in the state store, packed for a group of videos where no timer is asked for; a row with `last` true ends its video and flushes what is held, and so does a timer. File sources take
`per_trigger` files at a time, which stands for the bounded queues of a live feed.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from cueforge.functions import tables as T
from cueforge.operators import cues as C
from cueforge.operators import words as W
from cueforge.sources.shared import folder

SEGMENT = "video bigint, seq bigint, start double, end double, text string, speaker string, last boolean"
SENTENCE = "video bigint, rec_id bigint, start double, end double, text string, speaker string"


def source(spark: SparkSession, path: str, schema, fmt: str = "parquet", per_trigger: int = 100) -> DataFrame:
    """A stream of files with a rate limit."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", per_trigger).load(path)


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and read what it wrote."""
    spark = stream.sparkSession
    out, marks = folder(spark, name), folder(spark, name + "-marks")
    if mode == "append":
        query = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
    else:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def by_batch(stream: DataFrame, name: str, rule=lambda df: df) -> DataFrame:
    """Run a stream over all that is there, with rule(rows) for each micro-batch, and read what was written. A batch that is tried again replaces what it wrote."""
    spark = stream.sparkSession
    out, marks = folder(spark, name), folder(spark, name + "-marks")
    empty = rule(spark.createDataFrame([], stream.schema))
    empty.write.parquet(f"{out}/batch=none")
    stream.writeStream.option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(batch_writer(out, rule)).start().awaitTermination()
    return spark.read.schema(empty.schema).parquet(f"{out}/batch=*")


def batch_writer(to: str, rule=lambda df: df, fmt: str = "parquet", by: tuple = ()):
    """For foreachBatch: each batch has a folder of its own, batch=N, that is overwritten, so a batch that comes twice is there once."""

    def write(df: DataFrame, batch: int):
        rule(df).write.mode("overwrite").format(fmt).partitionBy(*by).save(f"{to}/batch={batch}")

    return write


# --- rows held in state ---

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Held(StatefulProcessor):
    """Rows of a video that are held until step() lets them go.

    A row with `last` true ends the video. With `idle_ms`, an event-time timer ends one from which nothing has come for so long: what is held goes out, and what
    the video is known by (`value`) stays for FORGET times as long in case it goes on. Rows of a batch are put in order first.
    """

    FORGET = 24
    #: schemas of what is held and known
    rows = value = ""
    order = "seq"
    first: tuple = ()

    def __init__(self, idle_ms: int | None = None, ts: str = "ts"):
        self.idle_ms, self.ts = idle_ms, ts

    def step(self, video, held: pd.DataFrame, value: tuple, over: bool) -> tuple[list[tuple], pd.DataFrame, tuple]:
        """(rows to emit, rows to hold, what is known) from the rows held so far with the new ones after them."""
        raise NotImplementedError

    def many(self, rows: pd.DataFrame, first: np.ndarray, values: list[tuple], over: list[bool]) -> tuple[pd.DataFrame, pd.DataFrame, list[tuple]]:
        """step() for several videos, whose rows stand one after another. first: where each begins, with the total last."""
        names, out, rest, known = [c.split()[0] for c in self.rows.split(", ")], [], [rows.iloc[:0]], []
        for a, b, value, end in zip(first[:-1].tolist(), first[1:].tolist(), values, over, strict=True):
            video = rows["video"].iloc[a]
            made, held, value = self.step(None if pd.isna(video) else video, rows.iloc[a:b][names].reset_index(drop=True), value, end)
            out += made
            known.append(value)
            if len(held):
                rest.append(held.assign(video=video))
        return pd.DataFrame(out, columns=self.emitted()), pd.concat(rest, ignore_index=True), known

    def one(self, video, held, value, over):
        """step() by many()."""
        out, rest, known = self.many(held.assign(video=video), np.array([0, len(held)]), [value], [over])
        return list(out.itertuples(index=False, name=None)), rest, known[0]

    def init(self, handle):
        self.handle = handle
        self.held, self.known = handle.getListState("held", self.rows), handle.getValueState("known", self.value)
        self.names = [c.split()[0] for c in self.rows.split(", ")]

    def _go(self, key, fresh: pd.DataFrame, over: bool):
        before = list(self.held.get()) if self.held.exists() else []
        value = self.known.get() if self.known.exists() else self.first
        rows = pd.concat([pd.DataFrame(before, columns=self.names), fresh[self.names]], ignore_index=True) if before else fresh[self.names].reset_index(drop=True)
        out, rest, value = self.step(key[0], rows, tuple(value), over)
        if len(rest):
            self.held.put([tuple(None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in r) for r in rest[self.names].itertuples(index=False)])
        else:
            self.held.clear()
        return out, value

    def handleInputRows(self, key, rows, timerValues):
        fresh = pd.concat(list(rows)).sort_values(self.order)
        over = bool(fresh["last"].fillna(False).any()) if "last" in fresh else False
        out, value = self._go(key, fresh, over)
        self._set_timer(fresh[self.ts].max().timestamp() * 1000 + self.idle_ms if self.idle_ms and not over else None)
        if over:
            self.known.clear()
        else:
            self.known.update(value)
        yield pd.DataFrame(out, columns=self.emitted())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        out = []
        if self.held.exists():
            out, value = self._go(key, pd.DataFrame(columns=self.names), True)
            self.known.update(value)
            self._set_timer(expiredTimerInfo.getExpiryTimeInMs() + self.FORGET * self.idle_ms)
        else:
            self.known.clear()
        yield pd.DataFrame(out, columns=self.emitted())

    def _set_timer(self, at):
        if self.idle_ms:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            if at is not None:
                self.handle.registerTimer(int(at))

    def emitted(self):
        return [c.split()[0] for c in self.out.split(", ")]

    def close(self):
        pass


class Grouped(StatefulProcessor):
    """Many videos at a time through a processor's many(): a call, a state and a frame for each group of videos instead of each video. Without timers."""

    def __init__(self, of: Held, video: str, fresh: pa.Schema):
        self.of, self.fresh = of, fresh
        # the types are made here, as tasks have no session
        self.held, self.known = (to_arrow_schema(StructType.fromDDL(f"video {video}, {fields}")) for fields in (of.rows, of.value))

    def init(self, handle):
        self.state = handle.getValueState("state", "held binary, known binary")

    def _read(self) -> list[pa.Table]:
        if not self.state.exists():
            return [self.held.empty_table(), self.known.empty_table()]
        return [pa.ipc.open_stream(bytes(x)).read_all() for x in self.state.get()]

    def _write(self, *tables: pa.Table):
        if not any(t.num_rows for t in tables):
            self.state.clear()
            return
        packed = []
        for table in tables:
            to = pa.BufferOutputStream()
            with pa.ipc.new_stream(to, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
                writer.write_table(table)
            packed.append(to.getvalue().to_pybytes())
        self.state.update(tuple(packed))

    def handleInputRows(self, key, rows, timerValues):
        batches = [pa.ipc.read_record_batch(pa.py_buffer(x), self.fresh) for some in rows for x in some["packed"]]
        fresh = pa.Table.from_batches(batches, self.fresh).to_pandas().sort_values(self.of.order, kind="stable")
        last = set(fresh["video"][fresh["last"].fillna(False).astype(bool)].tolist()) if "last" in fresh else set()
        held, known = self._read()
        touched = pa.array(fresh["video"].unique(), self.held.field("video").type)
        goes = pc.is_in(held["video"], touched)
        waiting, before = held.filter(pc.invert(goes)), held.filter(goes).to_pandas()
        now = fresh[self.held.names]
        now = pd.concat([before, now], ignore_index=True) if len(before) else now
        code, videos = pd.factorize(now["video"])
        by = np.argsort(code, kind="stable")
        now, first = now.take(by).reset_index(drop=True), np.searchsorted(code[by], np.arange(len(videos) + 1))
        videos = videos.tolist()
        over = [v in last for v in videos]
        knew = {row["video"]: tuple(row.values())[1:] for row in known.to_pylist()}
        out, rest, values = self.of.many(now, first, [knew.get(v, self.of.first) for v in videos], over)
        for video, value, end in zip(videos, values, over, strict=True):
            knew[video] = value
            if end:
                del knew[video]
        rest = pa.Table.from_pandas(rest[self.held.names], self.held, preserve_index=False)
        known = pa.Table.from_pylist([dict(zip(self.known.names, (v, *value), strict=True)) for v, value in knew.items()], self.known)
        self._write(pa.concat_tables([waiting, rest]), known)
        yield out.assign(video=None) if key[0] < 0 else out

    def close(self):
        pass


#: Groups of videos that have a state together.
GROUPS = 1 << 12
#: Bytes of rows that a task packs by their groups at once.
PACKED = 1 << 24


def packed(rows: DataFrame, names: list[str]) -> DataFrame:
    """(_group, packed): the rows of a group that a task has one after another as one record batch, as a stateful processor gets its rows one by one."""

    def pack(batches):
        waiting, size = [], 0

        def flushed():
            table = pa.Table.from_batches(waiting)
            group = table["_group"].to_numpy()
            by = np.argsort(group, kind="stable")
            group, table = group[by], table.select(names).take(pa.array(by))
            heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            made = [pa.Table.to_batches(table.slice(a, b - a).combine_chunks())[0].serialize().to_pybytes() for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(group)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(group[heads], pa.int32()), pa.array(made, pa.binary())], names=["_group", "packed"])

        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                size += batch.nbytes
            if size > PACKED:
                yield flushed()
                waiting, size = [], 0
        if waiting:
            yield flushed()

    return rows.select("_group", *names).mapInArrow(pack, "_group int, packed binary")


def held(rows: DataFrame, kind: type[Held], *args, ts: str | None = None, late: str = "10 minutes", idle: float | None = None, groups: int = GROUPS) -> DataFrame:
    """A stream through a processor of that kind, by video. With `ts` and `idle` (seconds), videos end after so long without a row, by event time.

    Else a group of videos is handled at once; a task holds what a micro-batch has of one. A stream that is started again needs the `groups` it had.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    if ts is None or idle is None:
        # the null video is group -1 and goes by another value, as a null would make doubles of the ids beside it
        video, none = rows.schema["video"].dataType.simpleString(), F.col("video").isNull()
        group = F.when(none, -1).otherwise(F.pmod(F.xxhash64("video"), F.lit(groups))).cast("int")
        names = ["video", *(c.split()[0] for c in kind.rows.split(", ")), *(["last"] if "last" in rows.columns else [])]
        by = packed(rows.withColumns({"_group": group, "video": F.when(none, F.lit(0).cast(video)).otherwise(F.col("video"))}), names).groupBy("_group")
        return by.transformWithStateInPandas(Grouped(kind(*args), video, to_arrow_schema(rows.select(*names).schema)), kind.out, "Append", "None")
    return rows.withWatermark(ts, late).groupBy("video").transformWithStateInPandas(kind(*args, idle_ms=int(idle * 1000), ts=ts), kind.out, "Append", "EventTime")


# --- sentences ---

_QUOTES = re.escape(T.CLOSING_QUOTES)
_SHORT = {lang: set(words.split()) for lang, words in T.ABBREVIATIONS.items()}


def _ends(token: str, lang: str = "en") -> bool:
    """The sentence test of the batch operator, for one token."""
    core = re.sub(f"[{_QUOTES}]+$", "", token)
    if core[-1:] not in (".", "!", "?") or core.endswith("..."):
        return False
    word = core.rstrip(".")
    return not (core.endswith(".") and (re.fullmatch(r"(?:[A-Za-z]\.){2,}", core) or word in _SHORT.get(lang, _SHORT["en"]) or re.fullmatch("[A-Za-z]", word)))


def _tokens(text: str) -> list[str]:
    return re.sub(r"([(\[{¡¿]) +", r"\1", re.sub(r" +([.,!?);:}\]])", r"\1", text or "")).split()


class Sentences(Held):
    """Whole sentences as they complete; a change of speaker ends one. The segments of the open sentence are held, with the tokens of the first that are gone (`skip`)."""

    rows = "seq bigint, start double, end double, text string, speaker string, lang string, skip int"
    value = "count bigint"
    first = (0,)
    out = SENTENCE

    def step(self, video, held, value, over):
        out, words, count = [], [], value[0]
        start = end = speaker = begin = None
        fresh = False

        def emit():
            nonlocal words, count
            if words:
                out.append((video, count, start, end, " ".join(words), speaker))
                count += 1
            words = []

        for at, row in enumerate(held.itertuples()):
            if words and row.speaker != speaker:
                emit()
                fresh = False
            speaker = row.speaker
            skip = 0 if pd.isna(row.skip) else int(row.skip)
            for k, token in enumerate(_tokens(row.text)):
                if k < skip:
                    continue
                # closing quotes alone end nothing and stay with the sentence before
                lone = re.fullmatch(f"[{_QUOTES}]+", token) is not None
                if fresh and not lone:
                    emit()
                if not words:
                    start, begin = row.start, (at, k)
                words.append(token)
                end = row.end
                if not lone:
                    fresh = _ends(token, row.lang or "en")
        if over:
            emit()
        if not words:
            return out, held.iloc[:0], (count,)
        rest = held.iloc[begin[0] :].copy()
        rest["skip"] = [begin[1]] + [0] * (len(rest) - 1)
        return out, rest, (count,)


def _with(df: DataFrame, **defaults) -> DataFrame:
    for name, value in defaults.items():
        if name not in df.columns:
            df = df.withColumn(name, value)
    return df


def sentences(segments: DataFrame, **timing) -> DataFrame:
    """Records of whole sentences from a stream of segments, by the rules of each row's `lang` (English without one). timing: see held()."""
    return held(_with(segments, lang=F.lit("en"), skip=F.lit(0)), Sentences, **timing)


# --- cues and words cleaned as they come ---


def _break_of_cues(start, end) -> int:
    """The last cue that may begin a piece (see cues.repair_times): 0 if none but the first."""
    n = len(start)
    new = np.append(True, start[1:] != start[:-1])
    so_far = np.arange(n) - np.flatnonzero(new)[np.cumsum(new) - 1] + 1
    room = np.append(start[1:], start[-1:]) - start
    pushes = (end <= start) & ~((room > 0) & (room >= so_far))
    total = np.cumsum(np.maximum(1, end - start))
    pushed = total + np.maximum.accumulate(np.where(pushes, start + 1 - total, -(1 << 60)))
    fresh = (start[1:] > np.maximum.accumulate(start)[:-1]) & (start[1:] >= pushed[:-1])
    return int(np.flatnonzero(fresh)[-1]) + 1 if fresh.any() else 0


class CuePieces(Held):
    """Valid cues go out in whole pieces, once a cue has come that nothing before it can reach. Without `empty`, cues without a text go first."""

    order = "pos"
    rows = "pos bigint, start_ms bigint, end_ms bigint, text string"
    value = "piece bigint"
    first = (0,)
    out = "video bigint, pos bigint, start_ms bigint, end_ms bigint, text string, _piece bigint, _coming bigint"

    def __init__(self, empty: bool = True, **timing):
        super().__init__(**timing)
        self.empty = empty

    def step(self, video, held, value, over):
        return self.one(video, held, value, over)

    def many(self, rows, first, values, over):
        start, end = (rows[c].to_numpy(np.float64, na_value=np.nan) for c in ("start_ms", "end_ms"))
        fine = (start >= 0) & (start <= end) & (end < C.MAX_MS)
        if not self.empty:
            fine &= rows["text"].fillna("").to_numpy() != ""
        rows, start, end, first = rows[fine], start[fine].astype(np.int64), end[fine].astype(np.int64), np.append(0, np.cumsum(fine))[first]
        n, at = np.diff(first), first[:-1]
        cut = np.array([size if whole else _break_of_cues(start[a : a + size], end[a : a + size]) if size else 0 for a, size, whole in zip(at.tolist(), n.tolist(), over, strict=True)], np.int64)
        gone = np.arange(len(rows)) < np.repeat(at + cut, n)
        piece, more = np.array([v[0] for v in values], np.int64), (cut > 0) & (cut < n)
        coming = np.full(len(n), np.nan)
        coming[more] = start[(at + cut)[more]]
        out = rows[gone].assign(start_ms=start[gone], end_ms=end[gone], _piece=np.repeat(piece, cut), _coming=np.repeat(coming, cut))
        return out[self.emitted()], rows[~gone], [(p,) for p in (piece + (cut > 0)).tolist()]


def settled_cues(cues: DataFrame, clean: bool = True, **timing) -> DataFrame:
    """A stream of cues in whole pieces, with the text rules done. repaired() is what is left to do on a batch of them."""
    return held(C.clean_text(cues) if clean else cues, CuePieces, not clean, **timing)


def repaired(pieces: DataFrame) -> DataFrame:
    """The time rules on whole pieces: what cues.repair_times gives on whole videos."""
    return C.repaired(C.with_notes(pieces), ["video", "_piece"]).drop("_piece", "_coming")


#: Words that must have come after one before it may begin a piece.
WORDS_AHEAD = 5
_ASCII_PUNCT = re.compile(rf"[{W.ASCII_PUNCT}]+")


def _attached(words: list[str]) -> list[str]:
    """W5 on texts alone; the first word isn't punctuation."""
    out = []
    for word in words:
        if out and _ASCII_PUNCT.fullmatch(word.strip(" ")):
            out[-1] += word
        else:
            out.append(word)
    return out


def _meets(before: list[str], ahead: list[str], size: int) -> bool:
    """Whether a word after the place is equal to the one `size` words before it, before the place."""
    return any(before[k - size] == ahead[k] for k in range(size))


def _break_of_words(words: list[str], start, tries: int = 16) -> int:
    """The last timed word before which no rule looks at what comes after, and after which none looks at what came before: 0 if none of the last `tries`."""
    alone = [_ASCII_PUNCT.fullmatch(w.strip(" ")) is not None for w in words]
    begins = [k for k in range(1, len(words)) if not alone[k] and not np.isnan(start[k])]
    for k in reversed(begins[-tries - WORDS_AHEAD :]):
        ahead = _attached(words[k : k + 400])
        if len(ahead) <= WORDS_AHEAD:
            continue
        before = _attached(words[:k])
        same = np.array([i >= 2 and before[i] == before[i - 2] for i in range(len(before))], bool)
        kept = [w for w, keep in zip(before, W.kept_once(same, 2), strict=True) if keep]
        if len(kept) >= 3 and not _meets(before, ahead, 2) and not _meets(kept, ahead, 3) and ahead[:2] != ahead[2:4]:
            return k
    return 0


#: What F.trim(word).rlike() takes for a word of punctuation.
_ALONE = rf"^[{W.ASCII_PUNCT}]+(\r\n|[\n\r\x{{85}}\x{{2028}}\x{{2029}}])?$"


class WordPieces(Held):
    """Recognised words go out in whole pieces with W1 and W2 done; the sums that W2 needs are kept. With `joined`, W5 and W3 are done too."""

    order = "pos"
    rows = "pos bigint, word string, start double, end double, score double"
    value = "piece bigint, letters double, timed double, filled double"
    first = (0, 1e-7, 0.0, 0.0)
    out = "video bigint, pos bigint, word string, start double, end double, score double, _piece bigint"

    def __init__(self, joined: bool = False, **timing):
        super().__init__(**timing)
        self.joined = joined

    def step(self, video, held, value, over):
        return self.one(video, held, value, over)

    def many(self, rows, first, values, over):
        start, end = (rows[c].to_numpy(np.float64, na_value=np.nan) for c in ("start", "end"))
        words = rows["word"].to_numpy(object)
        # W1
        stay = np.ones(len(rows), bool)
        stay[1:] = ~(np.isnan(start[1:]) & np.isnan(start[:-1]) & (words[1:] == words[:-1]).astype(bool))
        stay[first[:-1][first[:-1] < len(rows)]] = True
        rows, start, end, words, first = rows[stay], start[stay], end[stay], words[stay], np.append(0, np.cumsum(stay))[first]
        done_start, done_end, n = start.copy(), end.copy(), np.fromiter(map(len, words), np.int64, len(words))
        cuts, known = [], []
        for a, b, value, whole in zip(first[:-1].tolist(), first[1:].tolist(), values, over, strict=True):
            cut = b if whole else a + _break_of_words(words[a:b].tolist(), start[a:b])
            cuts.append(cut)
            if cut > a:
                piece, letters, timed, filled = value
                seconds = float(np.where(np.isnan(start[a:cut]), 0.0, end[a:cut] - start[a:cut]).sum())
                filled, _ = W.fill_gaps(done_start[a:cut], done_end[a:cut], n[a:cut], np.inf if whole else start[cut], letters, timed, filled)
                value = (piece + 1, letters + float(n[a:cut].sum()), timed + seconds, float(filled))
            known.append(value)
        size = np.array(cuts, np.int64) - first[:-1]
        gone = np.arange(len(rows)) < np.repeat(cuts, np.diff(first))
        score = np.where(np.isnan(start), 0.0, rows["score"].to_numpy(np.float64, na_value=np.nan))
        piece = np.repeat(np.array([v[0] for v in values], np.int64), size)
        out = rows[gone].assign(start=done_start[gone], end=done_end[gone], score=score[gone], _piece=piece)[self.emitted()]
        if self.joined and len(out):
            new = np.zeros(len(out), bool)
            new[(np.cumsum(size) - size)[size > 0]] = True
            table = pa.Table.from_pandas(out.assign(_new=new), preserve_index=False)
            alone = pc.fill_null(pc.match_substring_regex(pc.utf8_trim(table["word"], " "), _ALONE), False)
            table = W.joined(table.append_column("_alone", alone))
            out = table.select(self.emitted()).to_pandas()
        return out, rows[~gone], known


def settled_words(words: DataFrame, joined: bool = False, **timing) -> DataFrame:
    """A stream of recognised words in whole pieces. finished_words() is what is left to do on a batch of them."""
    return held(words, WordPieces, joined, **timing)


def finished_words(pieces: DataFrame, joined: bool = False) -> DataFrame:
    """W5, W3, W4 and W-FIN on whole pieces: what words.clean_words gives on whole videos. joined: W5 and W3 are done."""
    out = W.finished(W.shorten_long(pieces)) if joined else W.attached_once(pieces, ["video", "_piece"])
    return out.drop("_piece")


# --- summaries, gaps ---


class Summaries(Held):
    """Texts gathered until their words reach the budget; a version's body is cut to `longest` characters."""

    rows = "seq bigint, text string"
    value = "version int"
    first = (0,)
    out = "video bigint, version int, words bigint, body string"

    def __init__(self, budget: int = 4500, longest: int = 12000, **timing):
        super().__init__(**timing)
        self.budget, self.longest = budget, longest

    def step(self, video, held, value, over):
        out, version, words, begin = [], value[0], 0, 0
        for k, text in enumerate(held["text"].tolist()):
            if not text or not text.strip():
                continue
            n = len(text.split())
            words += n if n > 1 else max(1, len(text) // 2)
            if words >= self.budget:
                version += 1
                texts = [t for t in held["text"].tolist()[begin : k + 1] if t and t.strip()]
                out.append((video, version, words, "\n".join(texts)[: self.longest]))
                words, begin = 0, k + 1
        return out, held.iloc[begin:], (version,)


def summary_windows(segments: DataFrame, budget: int = 4500, longest: int = 12000, **timing) -> DataFrame:
    """V06. A video that ends, or whose timer does, leaves no version for what has not reached the budget."""
    return held(segments, Summaries, budget, longest, **timing)


class Gaps(Held):
    """Numbers missing before a row, of rows that may come out of order by `slack` numbers; a video's largest number so far is known."""

    rows = "seq bigint"
    value = "top bigint"
    first = (None,)
    out = "video bigint, seq bigint, missing bigint"

    def __init__(self, slack: int = 100, **timing):
        super().__init__(**timing)
        self.slack = slack

    def step(self, video, held, value, over):
        held = held.sort_values("seq")
        seqs, top = held["seq"].tolist(), value[0]
        many = len(seqs) if over else sum(s <= seqs[-1] - self.slack for s in seqs)
        out = []
        for s in seqs[:many]:
            out.append((video, s, max(s - top - 1, 0) if top is not None else 0))
            top = s if top is None else max(top, s)
        return out, held.iloc[many:], (top,)


def sequence_gaps(rows: DataFrame, slack: int = 100, **timing) -> DataFrame:
    """V05 as a stream: equals words.gaps() while no row comes more than `slack` numbers late."""
    return held(rows, Gaps, slack, **timing)


def matching(events: DataFrame, prefix: str | None = None, **equal) -> DataFrame:
    """Events of a dotted type prefix, and of given columns."""
    if prefix:
        events = events.where((F.col("type") == prefix) | F.startswith("type", F.lit(prefix.rstrip(".") + ".")))
    for column, value in equal.items():
        events = events.where(F.col(column) == value)
    return events


def once_each(events: DataFrame, key: str = "event_id", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """An at-least-once feed without repeats."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def daily_usage(usage: DataFrame, late: str = "1 day") -> DataFrame:
    """The ledger of each user and day."""
    rows = usage.where(F.col("cost_usd").isNotNull() | (F.col("prompt_tokens") + F.col("completion_tokens") > 0)).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    sums = rows.groupBy(F.window("ts", "1 day"), "user_id").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum("cost_usd").alias("cost_usd"), F.sum("requests").alias("requests"))
    return sums.select("user_id", F.to_date("window.start").alias("day"), "prompt_tokens", "completion_tokens", "cost_usd", "requests")


def error_outputs(errors: DataFrame, to: str, categories: tuple = ("permanent", "degraded")):
    """A foreachBatch sink of the kept categories, by batch and category; a batch that is tried again replaces what it wrote."""
    return errors.writeStream.foreachBatch(batch_writer(to, lambda df: df.where(F.col("category").isin(*categories)), "json", ("category",)))


def event_windows(events: DataFrame, kind: str = "tumbling") -> DataFrame:
    """Counts and sums in tumbling hours, sliding hours (every 30 minutes) or sessions (gaps of 30 minutes)."""
    span = {"tumbling": F.window("ts", "1 hour"), "sliding": F.window("ts", "1 hour", "30 minutes"), "session": F.session_window("ts", "30 minutes")}[kind]
    keys = [span.alias("w")] + (["user_id"] if kind == "session" else ["event_type"])
    return events.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
