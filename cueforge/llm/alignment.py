"""Cross-tokenizer alignment: which ids of a byte-level BPE and of a SentencePiece model cover the same bytes of a text.

Both encode space + text, the second by the space that its model puts before a text. The byte offsets where tokens of
both end come from hash-set intersection: one dictionary from end to index a tokenizer, over a stretch of STRETCH bytes at a
time, and the sorted common keys cut both id lists into groups. Inside the groups every stretch of bytes between two
neighbouring ends belongs to one token of each: that is a link.

Counts of id pairs are over the whole corpus. Documents are worked on in slices of about SLICE_BYTES of text. A slice is
written once, packed: its different pairs with the number of its documents that have each, one row for each part that holds some of them, and
one row with what each document has of them. A part has whole A ids, so it knows which pairs are their most frequent ones. Each row of a
slice goes to its part's counts and comes back as one row; rows go by in order, so a task holds a part's counts and one slice, whatever the
corpus. Nothing that grows with the corpus is broadcast, and no pair is a row of its own.

Special tokens have no special meaning in a text. Null and empty texts, and texts whose tokens don't give space + text back
(as with U+2581 in the text), have no tokens: all figures are zero and the digest is an empty string. Whole texts count,
however long. Repeated rows are documents of their own, whatever their ids, null ones too. Extra columns don't matter to
scored() and pass through groups(), whose own columns replace columns of the same name. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import operator
import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .bpe import Bpe, public_path
from .store import scratch, stored

MARK = "▁"
SLICE_BYTES = 1 << 19
#: Parts of the id pairs, by their A id; and slices whose sums one task adds up.
PARTS, TOGETHER = 64, 32
#: Pairs that are summed at once.
SUMMED = 1 << 20
#: Bytes whose ends are in the dictionaries together.
STRETCH = 1 << 13
#: Different words a worker keeps between slices, and their characters.
KNOWN_WORDS, KNOWN_BYTES = 200_000, 16 << 20
#: A run of spaces and what follows it. No piece goes on after a space, so these encode each by itself.
_WORDS = re.compile(" +[^ ]*")


class Pieces:
    """SentencePiece ids of whole texts; different words are encoded once and kept, the ones that come again longest."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        if any(MARK in name.lstrip(MARK) for name in names):
            raise ValueError("a piece goes over the end of a word")
        self.raw = [bytes([int(name[3:5], 16)]) if self.model.is_byte(k) else name.replace(MARK, " ").encode() for k, name in enumerate(names)]
        self.space = self.model.piece_to_id(MARK)
        self.forget()

    def forget(self):
        """Known words: number by word, whether the ids give the word back, and the ids one after another."""
        self.known: dict[str, int] = {}
        self.same = np.zeros(0, bool)
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.seen = np.zeros(0, np.int32)  # calls of encode() that a word was in
        self.bytes = 0

    def keep_frequent(self):
        """Words of one call only go, half of those known at least; what is left has to come again to stay the next time."""
        keep = W.most_seen(self.seen, KNOWN_WORDS // 2)
        words = list(itertools.compress(self.known, keep))
        if sum(map(len, words)) > KNOWN_BYTES // 2:
            return self.forget()
        starts, lengths = self.ends[:-1][keep], np.diff(self.ends)[keep]
        self.ids, self.ends = self.ids[W.ragged(starts, lengths)], np.append(0, np.cumsum(lengths))
        self.same, self.seen = self.same[keep], self.seen[keep] // 2
        self.known = dict(zip(words, range(len(words)), strict=True))
        self.bytes = sum(map(len, words))

    def learn(self, words: set[str]):
        words = list(words)
        # the model puts the first space there itself
        found = [ids if word != " " else [self.space] for word, ids in zip(words, self.model.encode([w[1:] for w in words], num_threads=1), strict=True)]
        raw = self.raw.__getitem__
        if b"\n".join([b"".join(map(raw, ids)) for ids in found]) == "\n".join(words).encode():
            same = [True] * len(words)
        else:
            same = [b"".join(map(raw, ids)) == word.encode() for word, ids in zip(words, found, strict=True)]
        self.same = np.append(self.same, same)
        self.seen = np.append(self.seen, np.zeros(len(words), np.int32))
        self.ends = np.append(self.ends, self.ends[-1] + np.cumsum([len(ids) for ids in found]))
        self.ids = np.append(self.ids, np.fromiter(itertools.chain.from_iterable(found), np.int32))
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.bytes += sum(map(len, words))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts one after another, how many each has, whether they give it back). Each text begins with a space."""
        if len(self.known) > KNOWN_WORDS or self.bytes > KNOWN_BYTES:
            self.keep_frequent()
        split = [_WORDS.findall(t) for t in texts]
        found = list(itertools.chain.from_iterable(split))
        if fresh := set(found) - self.known.keys():
            self.learn(fresh)
        at = np.fromiter(map(self.known.__getitem__, found), np.int64, len(found))
        self.seen += W.marked(at, len(self.seen))
        lengths = self.ends[at + 1] - self.ends[at]
        bounds = np.append(0, np.cumsum([len(ws) for ws in split]))
        ends, wrong = np.append(0, np.cumsum(lengths)), np.append(0, np.cumsum(~self.same[at]))
        return self.ids[W.ragged(self.ends[at], lengths)], np.diff(ends[bounds]), np.diff(wrong[bounds]) == 0


class Pair:
    """Both tokenizers with the bytes of their ids."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = Bpe(a_path), Pieces(b_path)
        self.a.split = None  # special tokens are plain text
        self.a_bytes, self.b_bytes = (np.array([len(x) for x in model.raw], np.int64) for model in (self.a, self.b))
        self.signs = [f"{k}{sign}" for k in range(max(len(self.a_bytes), len(self.b_bytes))) for sign in ",|;"]


@functools.lru_cache(1)
def pair(a_path: str, b_path: str) -> Pair:
    """The worker's own copies, kept between batches and tasks."""
    return Pair(a_path, b_path)


class Aligned:
    """The texts of a slice, one after another: ids, the ends of both in bytes, where groups end, and all links."""

    def __init__(self, of: Pair, texts: list[str | None]):
        spaced = [f" {t}" if t else "" for t in texts]
        a = of.a.encode(spaced)
        b, n_b, same = of.b.encode([t or " " for t in spaced])
        some = np.array([bool(t) for t in texts], bool)
        n_a, a = np.array([len(x) for x in a], np.int64), np.concatenate([np.zeros(0, np.int32), *a])
        sums = [np.append(0, np.cumsum(size[ids])) for size, ids in ((of.a_bytes, a), (of.b_bytes, b))]
        firsts = [np.append(0, np.cumsum(n)) for n in (n_a, n_b)]
        fits = some & same & (np.diff(sums[0][firsts[0]]) == np.diff(sums[1][firsts[1]]))
        self.a, self.b = a[np.repeat(fits, n_a)], b[np.repeat(fits, n_b)]
        self.n_a, self.n_b = np.where(fits, n_a, 0), np.where(fits, n_b, 0)
        self.first_a, self.first_b = (np.append(0, np.cumsum(n)) for n in (self.n_a, self.n_b))
        self.ends_a, self.ends_b = np.cumsum(of.a_bytes[self.a]), np.cumsum(of.b_bytes[self.b])
        self.cut_a, self.cut_b = self._cuts()
        self.signs = of.signs

    def _cuts(self):
        """Tokens of each before the end of each group."""
        cuts_a, cuts_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        total = int(self.ends_a[-1]) if len(self.ends_a) else 0
        for low in range(0, total, STRETCH):
            (a0, a1), (b0, b1) = (np.searchsorted(ends, [low, low + STRETCH], "right") for ends in (self.ends_a, self.ends_b))
            at_a = dict(zip(self.ends_a[a0:a1].tolist(), range(a0 + 1, a1 + 1), strict=True))
            at_b = dict(zip(self.ends_b[b0:b1].tolist(), range(b0 + 1, b1 + 1), strict=True))
            common = list(filter(at_b.__contains__, at_a))  # in order, as A's ends are
            for at, cuts in ((at_a, cuts_a), (at_b, cuts_b)):
                cuts.append(np.array(operator.itemgetter(*common)(at) if len(common) > 1 else [at[e] for e in common], np.int64))
        return np.concatenate(cuts_a), np.concatenate(cuts_b)

    def groups_of(self) -> np.ndarray:
        """The first group of each text, with the total last. A text's end is always a common one."""
        return np.searchsorted(self.cut_a, self.first_a, "right")

    def links(self):
        """(row, A token, B token) by index, in order of place: one for each stretch between neighbouring ends."""
        total = int(self.ends_a[-1]) + 1 if len(self.ends_a) else 0
        in_a, in_b = np.zeros(total, bool), np.zeros(total, bool)
        in_a[self.ends_a] = in_b[self.ends_b] = True
        ends = np.flatnonzero(in_a | in_b)
        a, b = (np.cumsum(inside)[ends] - inside[ends] for inside in (in_a, in_b))
        return np.repeat(np.arange(len(self.n_a)), np.diff(np.append(0, np.searchsorted(ends, np.append(0, self.ends_a)[self.first_a[1:]], "right")))), a, b

    def digests(self) -> list[str]:
        """SHA-256 of each text's groups as a1,a2|b1;a3|b2,b3."""
        size_a, size_b = np.diff(self.cut_a, prepend=0), np.diff(self.cut_b, prepend=0)
        sign_a, sign_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        sign_a[self.cut_a - 1], sign_b[self.cut_b - 1] = 1, 2
        told = np.zeros(len(self.a) + len(self.b), np.int64)
        told[np.arange(len(self.a)) + np.repeat(self.cut_b - size_b, size_a)] = 3 * self.a.astype(np.int64) + sign_a
        told[np.arange(len(self.b)) + np.repeat(self.cut_a, size_b)] = 3 * self.b.astype(np.int64) + sign_b
        bounds, sign = self.first_a + self.first_b, self.signs.__getitem__
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            text = "".join(map(sign, told[a:b].tolist()))
            out.append(hashlib.sha256(text[:-1].encode()).hexdigest() if text else "")
        return out


def groups(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """The rows with a_ids, b_ids, and a_cuts and b_cuts: how many ids of each stand before the end of each group."""
    added = ["a_ids", "b_ids", "a_cuts", "b_cuts"]
    kept = [c for c in docs.columns if c not in added]
    schema = docs.select(*kept).schema.simpleString()[7:-1]

    def run(batches):
        for batch in W.slices(batches, text, SLICE_BYTES):
            x = Aligned(pair(a_path, b_path), batch.column(text).to_pylist())
            g = x.groups_of()
            lists = [(x.first_a, x.a), (x.first_b, x.b), (g, x.cut_a - np.repeat(x.first_a[:-1], np.diff(g))), (g, x.cut_b - np.repeat(x.first_b[:-1], np.diff(g)))]
            made = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32())) for bounds, flat in lists]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), *made], names=[*kept, *added])

    return docs.select(*kept).mapInArrow(run, ", ".join([schema, *[f"{c} array<int>" for c in added]]))


def _packed(x: np.ndarray) -> bytes:
    """Numbers from 0 on in as few bytes each as the largest needs, their number first; all first bytes, then all second bytes and so on."""
    x = x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))
    return bytes([x.itemsize]) + np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    size = blob[0]
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8, offset=1).reshape(size, -1).T).view(f"u{size}").reshape(-1).astype(np.int64)


def _parts(pairs: np.ndarray) -> np.ndarray:
    """The part of each pair."""
    return (W.mix((pairs >> 32).astype(np.uint64)) % np.uint64(PARTS)).astype(np.int64)


def _runs(part: np.ndarray):
    """(part, start, stop) of parts in order."""
    heads = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else part
    return zip(part[heads].tolist(), heads.tolist(), np.append(heads, len(part))[1:].tolist(), strict=True)


def _slices(docs: DataFrame, a_path: str, b_path: str, id_col: str, text: str) -> DataFrame:
    """Of each slice, one row with the figures of its documents and how often each has which pairs (part -1), and one for each part with its different pairs and how many documents hold each."""
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["slice", "part", "id", "n_a", "n_b", "n_groups", "n_links", "digest", "has", "times", "pairs", "holders"]

    def run(batches):
        for batch in W.slices(batches, text, SLICE_BYTES):
            x = Aligned(pair(a_path, b_path), batch.column(text).to_pylist())
            n = batch.num_rows
            row, a, b = x.links()
            kind, pairs = pd.factorize(x.a[a].astype(np.int64) << 32 | x.b[b])
            n_links = np.bincount(row, minlength=n)
            del a, b
            # rows come in order, and so do the first places of what each has
            each, has = pd.factorize(row * max(len(pairs), 1) + kind)
            times = np.bincount(each, minlength=len(has))
            row, kind = np.divmod(has, max(len(pairs), 1))
            # pairs in order of their parts
            part = _parts(pairs)
            order = np.lexsort((pairs, part))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            # what each document has, in order: steps are small numbers
            has = row * max(len(pairs), 1) + rank[kind]
            by = np.argsort(has)
            holders, pairs, part = np.bincount(kind, minlength=len(pairs))[order], pairs[order], part[order]
            runs = list(_runs(part))
            own = {
                "id": batch.column(id_col), "n_a": x.n_a, "n_b": x.n_b, "n_groups": np.diff(x.groups_of()), "n_links": n_links, "digest": pa.array(x.digests(), pa.string()),
                "has": _packed(np.diff(has[by], prepend=0)), "times": _packed(times[by]),
            }
            size = 1 + len(runs)
            columns = {"slice": pa.array(np.repeat(np.frombuffer(os.urandom(8), np.int64), size)), "part": pa.array([-1, *(p for p, _, _ in runs)], pa.int32())}
            for c, v in own.items():
                if isinstance(v, bytes):
                    columns[c] = pa.array([v, *[None] * len(runs)], pa.binary())
                else:
                    v = v if isinstance(v, pa.Array) else pa.array(v)
                    columns[c] = pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), v), pa.nulls(len(runs), pa.list_(v.type))])
            columns["pairs"] = pa.array([None, *(pairs[i:j].tobytes() for _, i, j in runs)], pa.binary())
            columns["holders"] = pa.array([None, *(_packed(holders[i:j]) for _, i, j in runs)], pa.binary())
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    longs = ", ".join(f"{c} array<bigint>" for c in ("n_a", "n_b", "n_groups", "n_links"))
    blobs = ", ".join(f"{c} binary" for c in ("has", "times", "pairs", "holders"))
    return docs.select(id_col, text).mapInArrow(run, f"slice bigint, part int, id array<{id_type}>, {longs}, digest array<string>, {blobs}")


def _summed(pairs: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(different pairs in order, their sums)."""
    pairs, n = np.concatenate(pairs), np.concatenate(n)
    order = np.argsort(pairs, kind="stable")
    pairs, n = pairs[order], n[order]
    heads = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
    return pairs[heads], np.add.reduceat(n, heads)


def _columns(rows: list[tuple], schema: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.values(), strict=True)], names=list(schema))


_COUNTED = {"part": pa.int32(), "pairs": pa.binary(), "docs": pa.binary(), "best": pa.binary()}


def _counts(slices: DataFrame, tasks: int) -> DataFrame:
    """One row a part: its pairs, how many documents have each, and whether that is the most of all pairs of its A id; packed."""

    def count(batches):
        """Sums of what a task has of each part; emitted whenever they are many."""
        found, size = {}, 0

        def rows():
            return [(p, x.tobytes(), _packed(n), None) for p, (x, n) in ((p, _summed(*zip(*found[p], strict=True))) for p in sorted(found))]

        for batch in batches:
            for p, pairs, holders in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found.setdefault(p, []).append((np.frombuffer(pairs, np.int64), _unpacked(holders)))
                size += len(pairs) // 8
                if size > SUMMED:
                    found = {p: [_summed(*zip(*x, strict=True))] for p, x in found.items()}
                    size = sum(len(x[0][0]) for x in found.values())
                    if size > SUMMED // 2:
                        yield _columns(rows(), _COUNTED)
                        found, size = {}, 0
        if found:
            yield _columns(rows(), _COUNTED)

    def merge(batches):
        now, found, size = None, [], 0

        def row():
            pairs, docs = _summed(*zip(*found, strict=True))
            a = pairs >> 32
            heads = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
            most = np.repeat(np.maximum.reduceat(docs, heads), np.diff(np.append(heads, len(a))))
            return _columns([(now, pairs.tobytes(), _packed(docs), (docs == most).tobytes())], _COUNTED)

        for batch in batches:
            for p, pairs, docs in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if p != now and found:
                    yield row()
                    found, size = [], 0
                now = p
                found.append((np.frombuffer(pairs, np.int64), _unpacked(docs)))
                size += len(found[-1][0])
                if size > max(SUMMED, 2 * len(found[0][0])):
                    found = [_summed(*zip(*found, strict=True))]
                    size = len(found[0][0])
        if found:
            yield row()

    schema = "part int, pairs binary, docs binary, best binary"
    some = slices.where("part >= 0").select("part", "pairs", "holders").mapInArrow(count, schema)
    return some.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(merge, schema)


def pair_counts(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(a_id, b_id, docs, best): every pair of linked ids of the corpus, how many documents have it, and whether no pair of its A id is in more."""

    def rows(batches):
        for batch in batches:
            for pairs, docs, best in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                pairs = np.frombuffer(pairs, np.int64)
                columns = [(pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32), _unpacked(docs), np.frombuffer(best, bool)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["a_id", "b_id", "docs", "best"])

    with scratch(docs.sparkSession) as (kept, _):
        slices = kept(_slices(docs, a_path, b_path, id_col, text), "slices")
        return stored(_counts(slices, PARTS).mapInArrow(rows, "a_id int, b_id int, docs bigint, best boolean"), "pair-counts")


def _answers(slices: DataFrame, tasks: int) -> DataFrame:
    """(slice, part, docs, best): the counts of the pairs of each slice and part, in their order."""
    asked = slices.where("part >= 0").select("part", F.lit(1).alias("kind"), "slice", "pairs")
    counts = _counts(slices, tasks).select("part", F.lit(0).alias("kind"), "pairs", "docs", "best")
    rows = counts.unionByName(asked, allowMissingColumns=True).select("part", "kind", "slice", "pairs", "docs", "best")
    schema = {"slice": pa.int64(), "part": pa.int32(), "docs": pa.binary(), "best": pa.binary()}

    def answer(batches):
        known = docs = best = None
        for batch in batches:
            out = []
            # row by row, so that only one part's counts are there at a time
            columns = [batch.column(i) for i in range(6)]
            for k in range(batch.num_rows):
                part, kind, place, pairs = (columns[i][k].as_py() for i in range(4))
                pairs = np.frombuffer(pairs, np.int64)
                if not kind:
                    known, docs, best = pairs, _unpacked(columns[4][k].as_py()), np.frombuffer(columns[5][k].as_py(), bool)
                    continue
                at = np.searchsorted(known, pairs)
                out.append((place, part, _packed(docs[at]), best[at].tobytes()))
            if out:
                yield _columns(out, schema)

    return rows.repartition(tasks, "part").sortWithinPartitions("part", "kind").mapInArrow(answer, "slice bigint, part int, docs binary, best binary")


def scored(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per row."""
    id_type = docs.schema[id_col].dataType.simpleString()
    figures = ["n_a", "n_b", "n_groups", "n_links"]
    names = [id_col, *figures, "n_best", "count_sum", "groups_sha256"]

    def total(batches):
        """The sums of each slice, whose own row comes before the answers of the parts in order."""
        own, told = None, []

        def summed():
            docs_of, best_of = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*told, strict=True)) if told else (np.zeros(0, np.int64),) * 2
            row, kind = np.divmod(np.cumsum(_unpacked(own["has"])), max(len(docs_of), 1))
            bounds, times = np.searchsorted(row, np.arange(len(own["id"]) + 1)), _unpacked(own["times"])
            sums = [np.append(0, np.cumsum(times * x[kind])) for x in (best_of, docs_of)]
            made = [pa.array(s[bounds[1:]] - s[bounds[:-1]], pa.int64()) for s in sums]
            return pa.RecordBatch.from_arrays([own["id"], *(own[c] for c in figures), *made, own["digest"]], names=names)

        for batch in batches:
            col = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            for k in range(batch.num_rows):
                if col["part"][k].as_py() < 0:
                    if own:
                        yield summed()
                    lists = {c: pa.concat_arrays([col[c].slice(k, 1).flatten()]) for c in ("id", *figures, "digest")}
                    own, told = lists | {c: col[c][k].as_py() for c in ("has", "times")}, []
                else:
                    told.append((_unpacked(col["docs"][k].as_py()), np.frombuffer(col["best"][k].as_py(), np.uint8).astype(np.int64)))
        if own:
            yield summed()

    with scratch(docs.sparkSession) as (kept, _):
        slices = kept(_slices(docs, a_path, b_path, id_col, text), "slices")
        whole = slices.where("part < 0").drop("pairs", "holders")
        tasks = 1 + whole.count() // TOGETHER
        rows = whole.unionByName(_answers(slices, min(tasks, PARTS)), allowMissingColumns=True)
        rows = rows.repartition(tasks, "slice").sortWithinPartitions("slice", "part")
        longs = ", ".join(f"{c} bigint" for c in [*figures, "n_best", "count_sum"])
        return stored(rows.mapInArrow(total, f"{id_col} {id_type}, {longs}, groups_sha256 string"), "alignment")


def op13_cross_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scored(docs, public_path("byte_bpe_50k.json"), public_path("piece_bpe_32k.model"))
