"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax and pair features that grow with the corpus.

P(word | history) = m * n(previous, word) / n(previous) + (1 - m) * P(class | history) * P(word | class). The class
factor is a softmax over CLASSES classes whose logits are sums of hashed feature rows: the previous word, the
previous two, the word two back and the word three back (skips). P(word | class) is the word's smoothed share of its
class. The pair features are as many as the corpus has different pairs: a table in Spark, looked up by hash. Their
weight m = 1 - PAIR_A * n(previous) ** -PAIR_B rises with what is known of the previous word. Words below 1 in HOT of all training
tokens stand in pairs for the rare words of their class, among which the word has its smoothed share, so the
probabilities of all words still sum to one. Classes: the most frequent words have one each, the end of a text has
one, and the others are classed by their last two bytes.

Training counts all words of the training rows in Spark, then makes UPDATES synchronous gradient updates:
each takes one part of the training rows by hash of the text, every task sums the gradient of its rows in fixed point
(sums don't depend on their order), Spark adds the sums by feature row, and the driver applies them to a weight
matrix of fixed size. The features of a token share a step. All rows are used. Then all pairs are counted, packed by hash into parts.

Scoring looks frequent words and pairs up in broadcast tables of at most HOT and HOT_PAIRS entries. The other words and pairs go, packed,
to the part that has their counts, pairs with a factor of 16 bits, and the sums come back by slice and row: log(m * x + (1 - m) * y) is
log((1 - m) * y) + log(1 + m * x / ((1 - m) * y)), so each pair adds its own term. A pair is known in its part by 40 bits of its hash;
a part is sized for PART tokens.

Words are known by 64-bit hashes. Null texts are empty: only the end token. Repeated rows each get their score, rows
without an id too. Long texts are one slice. Ties in frequency go to the smaller hash. An empty training table leaves uniform shares, an empty
table to score no rows. Extra columns don't matter; the result has the id and the scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .store import stored, stored_at

CLASSES, TOP = 48, 23
SUFFIXES = CLASSES - TOP - 1
END_CLASS = CLASSES - 1
ROW_BITS = 13
N_FEATURES = 4
UPDATES = 4
HOT = 1 << 22
HOT_PAIRS = 1 << 18
#: Training tokens a part of the pair table is sized for.
PART = 1 << 20
PAIR_A, PAIR_B = 0.9, 0.1
END = np.uint64(0xE7037ED1A0B428DB)
BOS = np.uint64(0x8EBC6AF09C88C6E3)
RARE = np.uint64(0xA24BAED4963EE407)
STEP, DAMP, CLIP = 0.35, 4.0, 2.0
#: Tokens whose class probabilities are computed together: they fit a core's cache.
CHUNK = 1 << 12
#: Tokens whose gradient is added at once, however long their text.
STRETCH = 1 << 16
#: Fixed-point units of one in a gradient.
UNITS = 1 << 10
LOW = np.uint64((1 << 40) - 1)
#: Kinds of rows in a part, in their order there.
PAIR_COUNTS, WORD_COUNTS, PAIRS, WORDS, ROWS = range(5)


def tokens(batch, text):
    """(hashes, suffix classes, first token of each row) of lower-cased words with an end token after each row."""
    data, offsets = W.text_bytes(batch.column(text), lower=True)
    starts, ends, first = W.find_words(data, offsets)
    n, rows = len(starts), len(first) - 1
    first_token = first + np.arange(rows + 1)
    at = np.arange(n) + W.rows_of(first)
    hashes = np.full(n + rows, END, np.uint64)
    hashes[at] = W.hash_words(data, starts, ends)
    suffix = np.full(n + rows, END_CLASS, np.int64)
    last = data[ends - 1].astype(np.int64) if n else np.zeros(0, np.int64)
    before = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.int64) if n else last
    suffix[at] = (last * 7919 + before * 104729) % SUFFIXES
    return hashes, suffix, first_token


def classes(hashes, suffix, top):
    """Class of each token; top: (sorted hashes, their classes)."""
    known, own = top
    if not len(known):
        return suffix
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where((known[at] == hashes) & (suffix != END_CLASS), own[at], suffix)


def feature_rows(hashes, first):
    """(tokens, N_FEATURES) indices of weight rows."""
    place = np.arange(len(hashes)) - np.repeat(first[:-1], np.diff(first))

    def back(k):
        out = np.full(len(hashes), BOS, np.uint64)
        out[k:] = hashes[: len(hashes) - k]
        out[place < k] = BOS
        return out

    one, two, three = back(1), back(2), back(3)
    mixed = [one * np.uint64(3), one * np.uint64(5) + two * np.uint64(7), two * np.uint64(11) + np.uint64(1), three * np.uint64(13) + np.uint64(2)]
    return np.stack([(W.mix(m) >> np.uint64(64 - ROW_BITS)).astype(np.int64) for m in mixed], axis=1)


def class_logits(rows, weights, bias):
    """Logits of every class at every token, with the largest at 0."""
    logits = weights[rows[:, 0]] + bias
    for k in range(1, rows.shape[1]):
        logits += weights[rows[:, k]]
    logits -= logits.max(axis=1, keepdims=True)
    return logits


def class_shares(rows, weights, bias):
    """Probability of every class at every token."""
    shares = class_logits(rows, weights, bias)
    np.exp(shares, out=shares)
    shares /= shares.sum(axis=1, keepdims=True)
    return shares


def class_log(rows, k, weights, bias):
    """Natural log probability of class k[i] at token i."""
    logits = class_logits(rows, weights, bias)
    own = logits[np.arange(len(k)), k].astype(np.float64)
    return own - np.log(np.exp(logits, out=logits).sum(axis=1))


def word_counts(train: DataFrame, text: str) -> DataFrame:
    """(h, c, s): count and suffix class of each training token."""

    def count(batches):
        kept = []

        def merged():
            h, c, s = (np.concatenate(x) for x in zip(*kept, strict=True))
            u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            return u, np.bincount(inverse, weights=c).astype(np.int64), s[first]

        size = limit = 1 << 20
        size = 0
        for batch in W.slices(batches, text):
            h, s, _ = tokens(batch, text)
            kept.append((h, np.ones(len(h), np.int64), s))
            size += len(h)
            if size > limit:
                kept = [merged()]
                size = len(kept[0][0])
                limit = max(1 << 20, 2 * size)
                if size > 1 << 21:
                    yield pa.RecordBatch.from_arrays([pa.array(kept[0][0].view(np.int64)), pa.array(kept[0][1]), pa.array(kept[0][2])], names=["h", "c", "s"])
                    kept, size, limit = [], 0, 1 << 20
        if kept:
            h, c, s = merged()
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c), pa.array(s)], names=["h", "c", "s"])

    found = train.select(text).mapInArrow(count, "h bigint, c bigint, s bigint")
    return found.groupBy("h").agg(F.sum("c").alias("c"), F.min("s").alias("s"))


class Model:
    """What scoring needs; every part has a fixed size bound. The pair table stays in Spark."""

    def __init__(self, counts: DataFrame):
        suffix = F.col("s") != END_CLASS
        total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
        self.n, self.v = int(total[0]), int(total[1])
        most = counts.where(suffix).orderBy(F.desc("c"), "h").limit(TOP).collect()
        own = {r["h"]: SUFFIXES + i for i, r in enumerate(most)}
        hashes = np.array(sorted(np.array(list(own), np.int64).view(np.uint64).tolist()), np.uint64)
        self.top = (hashes, np.array([own[int(h)] for h in hashes.view(np.int64)], np.int64))
        self.class_n, self.class_v = np.zeros(CLASSES), np.zeros(CLASSES)
        for s, n, v in counts.groupBy("s").agg(F.sum("c"), F.count("*")).collect():
            self.class_n[s], self.class_v[s] = n, v
        for r in most:
            self.class_n[r["s"]] -= r["c"]
            self.class_v[r["s"]] -= 1
            self.class_n[own[r["h"]]], self.class_v[own[r["h"]]] = r["c"], 1
        self.bias = np.log((self.class_n + 0.5) / (self.n + 0.5 * CLASSES)).astype(np.float32)
        self.weights = np.zeros((1 << ROW_BITS, CLASSES), np.float32)
        self.parts = min(1 + self.n // PART, 1 << 16)
        hot = counts.where(F.col("c") * HOT >= self.n).select("h", "c").toPandas()
        h = hot["h"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(h)
        self.known, self.counted = h[order], hot["c"].to_numpy(np.int64)[order]
        self.texts = int(self.counted[self.known == END].sum()) or int(self.class_n[END_CLASS])
        # what the frequent words leave of each class
        rare = counts.where(F.col("c") * HOT < self.n).select("h", "s", "c")
        self.rare_n, self.rare_v = np.zeros(CLASSES), np.zeros(CLASSES)
        mine = F.col("h").isin([int(x) for x in own]) if own else F.lit(False)
        for s, n, v in rare.where(~mine).groupBy("s").agg(F.sum("c"), F.count("*")).collect():
            self.rare_n[s], self.rare_v[s] = n, v
        for r in most:
            if r["c"] * HOT < self.n:
                self.rare_n[own[r["h"]]], self.rare_v[own[r["h"]]] = r["c"], 1
        self.hot_pairs, self.hot_counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def places(self, hashes, suffix):
        """(class, whether frequent, count or 0, key in pairs, count of that key) of each token."""
        k = classes(hashes, suffix, self.top)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
            found = self.known[at] == hashes
            c = np.where(found, self.counted[at], 0)
        else:
            found, c = np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        return k, found, c, np.where(found, hashes, W.mix(RARE + k.astype(np.uint64))), np.where(found, c, self.rare_n[k])

    def previous(self, keys, n, first):
        """(key, count) of the token before each; a text begins after BOS, which as many texts have as an end."""
        before, count = np.empty_like(keys), np.empty(len(keys))
        before[1:], count[1:] = keys[:-1], n[:-1]
        before[first[:-1]], count[first[:-1]] = BOS, self.texts
        return before, count

    def pair_hashes(self, before, keys):
        """Part in the upper 16 bits, 40 bits of the hash below."""
        h = W.mix(before * np.uint64(0x9FB21C651E98DF25) + keys)
        return ((((h >> np.uint64(48)) * np.uint64(self.parts)) >> np.uint64(16)) << np.uint64(48)) | (h & LOW)

    def word_parts(self, hashes):
        """The part of each word, in the upper 16 bits."""
        return (((hashes >> np.uint64(48)) * np.uint64(self.parts)) >> np.uint64(16)) << np.uint64(48)

    def update(self, gradient: np.ndarray, seen: np.ndarray):
        """One step: the gradient by feature row, scaled by how much of each class the row should have seen."""
        share = np.exp(self.bias)
        step = STEP * gradient / (seen[:, None] * share[None, :] + DAMP)
        self.weights += np.clip(step, -CLIP, CLIP).astype(np.float32)

    def base_log10(self, c):
        return np.log10((c + 0.5) / (self.n + 0.5 * (self.v + 1)))

    def word_log10(self, c, k):
        return np.log10((c + 0.5) / (self.class_n[k] + 0.5 * (self.class_v[k] + 1)))


def gradient(train: DataFrame, text: str, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(observed minus expected class counts, tokens seen) of each feature row, over all training rows given."""
    shared = train.sparkSession.sparkContext.broadcast((model.top, model.weights, model.bias))
    names = ["r", *[f"g{c}" for c in range(CLASSES)], "n"]

    def run(batches):
        top, weights, bias = shared.value
        size = 1 << ROW_BITS
        g = np.zeros((CLASSES + 1, size))
        for batch in W.slices(batches, text):
            h, s, first = tokens(batch, text)
            rows, own = feature_rows(h, first), classes(h, s, top)
            for start in range(0, len(h), STRETCH):
                some, k = rows[start : start + STRETCH], own[start : start + STRETCH]
                p = np.empty((CLASSES, len(k)), np.float32)
                for a in range(0, len(k), CHUNK):
                    np.negative(class_shares(some[a : a + CHUNK], weights, bias).T, out=p[:, a : a + CHUNK])
                p[k, np.arange(len(k))] += 1
                for feature in range(N_FEATURES):
                    r = np.ascontiguousarray(some[:, feature])
                    for c in range(CLASSES):
                        g[c] += np.bincount(r, p[c], size)
                    g[CLASSES] += np.bincount(r, minlength=size)
        r = np.flatnonzero(g[CLASSES])
        yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), *[pa.array(np.rint(g[c, r] * UNITS).astype(np.int64)) for c in range(CLASSES + 1)]], names=names)

    parts = train.select(text).mapInArrow(run, ", ".join(["r int", *[f"{c} bigint" for c in names[1:]]]))
    found = parts.groupBy("r").agg(*[F.sum(c).alias(c) for c in names[1:]]).toPandas()
    out = np.zeros((1 << ROW_BITS, CLASSES + 1))
    out[found["r"].to_numpy()] = found[names[1:]].to_numpy() / UNITS
    shared.unpersist()
    return out[:, :-1], out[:, -1]


def _packed(hashes):
    """The lower 40 bits of each hash, 5 bytes each."""
    return np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpacked(blob):
    out = np.zeros((len(blob) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view(np.uint64)


def _planes(x):
    """All first bytes, then all second bytes and so on: small numbers compress well so."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _from_planes(blob, kind):
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(kind.itemsize, -1).T).view(kind).reshape(-1)


def _rising(row):
    """Row numbers in ascending order, as packed differences."""
    return _planes(np.diff(row, prepend=0).astype(np.int32))


def _short(x):
    """Positive numbers in 16 bits each: float32 rounded to its upper half, at most 2^-8 off."""
    return ((x.astype(np.float32).view(np.uint32) + np.uint32(1 << 15)) >> np.uint32(16)).astype(np.uint16).tobytes()


def _long(blob):
    return (np.frombuffer(blob, np.uint16).astype(np.uint32) << np.uint32(16)).view(np.float32).astype(np.float64)


def _by_part(hashes):
    """(part, start, stop) of the parts in hashes that are in order of their parts."""
    part = (hashes >> np.uint64(48)).astype(np.int64)
    heads = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
    return zip(part[heads].tolist(), heads.tolist(), np.append(heads[1:], len(part)).tolist(), strict=True)


def _summed(h, c):
    """(different hashes in order, their summed counts)."""
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    heads = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    return h[heads], np.add.reduceat(c, heads) if len(h) else c


def pair_counts(train: DataFrame, text: str, model: Model) -> tuple[DataFrame, str]:
    """Table of (part, h, c): sorted 40-bit hashes of the pairs of each part and how often each occurs, packed; and its path."""
    shared = train.sparkSession.sparkContext.broadcast(model)

    def count(batches):
        model = shared.value
        kept, size, limit = [], 0, 1 << 20

        def rows(h, c):
            for part, a, b in _by_part(h):
                yield part, _packed(h[a:b]), _planes(c[a:b])

        def batch_of(h, c):
            p, x, y = zip(*rows(h, c), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(x, pa.binary()), pa.array(y, pa.binary())], names=["part", "h", "c"])

        for batch in W.slices(batches, text):
            h, s, first = tokens(batch, text)
            _, _, _, keys, n = model.places(h, s)
            before, _ = model.previous(keys, n, first)
            h = model.pair_hashes(before, keys)
            kept.append((h, np.ones(len(h), np.int64)))
            size += len(h)
            if size > limit:
                kept = [_summed(*(np.concatenate(x) for x in zip(*kept, strict=True)))]
                size = len(kept[0][0])
                limit = max(1 << 20, 2 * size)
                if size > 1 << 21:
                    yield batch_of(*kept[0])
                    kept, size, limit = [], 0, 1 << 20
        if kept:
            yield batch_of(*_summed(*(np.concatenate(x) for x in zip(*kept, strict=True))))

    def merge(frame):
        h, c = _summed(np.concatenate([_unpacked(x) for x in frame["h"]]), np.concatenate([_from_planes(x, np.int64) for x in frame["c"]]))
        return frame.iloc[:1].assign(h=[_packed(h)], c=[c.tobytes()])

    schema = "part int, h binary, c binary"
    found = train.select(text).mapInArrow(count, schema)
    return stored_at(found.groupBy("part").applyInPandas(merge, schema), "pairs")


def _frequent_pairs(pairs: DataFrame, least: int):
    """(hashes, counts) of the pairs that occur `least` times or more."""

    def pick(batches):
        for batch in batches:
            for part, h, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                c = np.frombuffer(c, np.int64)
                at = np.flatnonzero(c >= least)
                h = _unpacked(h)[at] | (np.uint64(part) << np.uint64(48))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c[at])], names=["h", "c"])

    found = pairs.select("part", "h", "c").mapInArrow(pick, "h bigint, c bigint").toPandas()
    h = found["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], found["c"].to_numpy(np.int64)[order]


def trained(train: DataFrame, text: str = "text") -> tuple[Model, DataFrame, DataFrame]:
    """The model, the counts of all words, and the table of pairs."""
    counts = stored(word_counts(train, text), "counts")
    model = Model(counts)
    for k in range(UPDATES):
        part = train.where(F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(UPDATES)) == k)
        model.update(*gradient(part, text, model))
    pairs, _ = pair_counts(train, text, model)
    model.hot_pairs, model.hot_counts = _frequent_pairs(pairs, max(1, -(-model.n // HOT_PAIRS)))
    return model, counts, pairs


def word_table(counts: DataFrame, model: Model) -> DataFrame:
    """(part, h, c): hashes of the rare words of each part and how often each occurs, packed; a part may have several rows."""
    place = model.word_parts

    def pack(batches):
        kept, size = [], 0

        def packed():
            h, c = _summed(*(np.concatenate(x) for x in zip(*kept, strict=True)))
            p, x, y = zip(*((part, h[a:b].tobytes(), c[a:b].tobytes()) for part, a, b in _by_part(place(h))), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(x, pa.binary()), pa.array(y, pa.binary())], names=["part", "h", "c"])

        for batch in batches:
            kept.append((batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size > 1 << 20:
                yield packed()
                kept, size = [], 0
        if size:
            yield packed()

    return counts.where(F.col("c") * HOT < model.n).select("h", "c").mapInArrow(pack, "part int, h binary, c binary")


def _lookups(asked: DataFrame, pairs: DataFrame, words: DataFrame, model: Model) -> DataFrame:
    """What the pairs and rare words asked for add to the rows of a slice: one packed row for each row of asked, whatever the rows in it; slices' own rows as they are."""
    tables = [t.select("part", F.lit(kind).alias("kind"), "h", F.col("c").alias("a")) for t, kind in ((pairs, PAIR_COUNTS), (words, WORD_COUNTS))]
    rows = asked.unionByName(tables[0], allowMissingColumns=True).unionByName(tables[1], allowMissingColumns=True)
    rows = rows.repartition(model.parts, "part").sortWithinPartitions("part", "kind")
    names = ["slice", "kind", "row", "n", "n_known", "base", "score", "ids"]
    all_words, room = model.n + 0.5 * (model.v + 1), model.class_n + 0.5 * (model.class_v + 1)

    def ordered(table):
        h, c = (np.concatenate(x) for x in zip(*table, strict=True)) if table else (np.zeros(1, np.uint64), np.zeros(1, np.int64))
        order = np.argsort(h)
        return h[order], c[order]

    def answer(batches):
        part, tables, ready = None, {}, {}
        for batch in batches:
            col = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            kind = col["kind"].to_numpy()
            plain = pa.array(kind == ROWS)
            yield pa.RecordBatch.from_arrays([col[c].filter(plain) for c in names], names=names)
            found = []
            for i in np.flatnonzero(kind != ROWS).tolist():
                p, of, h, a = col["part"][i].as_py(), int(kind[i]), col["h"][i].as_py(), col["a"][i].as_py()
                if p != part:
                    part, tables, ready = p, {PAIR_COUNTS: [], WORD_COUNTS: []}, {}
                h = _unpacked(h) if of in (PAIR_COUNTS, PAIRS) else np.frombuffer(h, np.uint64)
                if of in tables:
                    tables[of].append((h, np.frombuffer(a, np.int64)))
                    continue
                source = PAIR_COUNTS if of == PAIRS else WORD_COUNTS
                if source not in ready:
                    ready[source] = ordered(tables.pop(source))
                known, counted = ready[source]
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                n = np.where(known[at] == h, counted[at], 0)
                row = np.cumsum(_from_planes(col["row"][i].as_py(), np.int32))
                if of == PAIRS:
                    hit = np.flatnonzero(n)
                    row = row[hit]
                    own = np.zeros(len(hit)), np.zeros(len(hit)), np.log10(1 + n[hit] * _long(a)[hit])
                else:
                    own = n > 0, np.log10((n + 0.5) / all_words), np.log10((n + 0.5) / room[np.frombuffer(a, np.uint8)])
                heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else row
                if len(heads):
                    known_words, base, score = (np.add.reduceat(x.astype(np.float64), heads) for x in own)
                    some = (None, None) if of == PAIRS else (known_words.astype(np.int64).tobytes(), base.tobytes())
                    found.append((col["slice"][i].as_py(), of, row[heads].astype(np.int32).tobytes(), None, *some, score.tobytes(), None))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, batch.schema.field(c).type) for c, x in zip(names, zip(*found, strict=True), strict=True)], names=names)

    kinds = {f.name: f.dataType.simpleString() for f in asked.schema.fields}
    return rows.mapInArrow(answer, ", ".join(f"{c} {kinds[c]}" for c in names))


def scored(docs: DataFrame, model: Model, counts: DataFrame, pairs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    # three kinds of rows: of a slice and part, the pairs (h, a: factor, row) or rare words (h, a: class, row) asked for, packed; the rows of a slice themselves (ids), one row a slice
    schema = f"part int, kind int, slice bigint, h binary, a binary, row binary, n binary, n_known binary, base binary, score binary, ids array<{kind}>"
    names = ["part", "kind", "slice", "h", "a", "row", "n", "n_known", "base", "score", "ids"]

    def score(batches):
        model = shared.value
        task = TaskContext.get().partitionId()
        room = model.class_n + 0.5 * (model.class_v + 1)
        rare_room = model.rare_n + 0.5 * (model.rare_v + 1)

        def some(size, own):
            return pa.RecordBatch.from_arrays([own[c] if c in own else pa.nulls(size, pa.list_(id_type) if c == "ids" else pa.binary()) for c in names], names=names)

        for number, batch in enumerate(W.slices(batches, text)):
            id_type = batch.column(id_col).type
            here = (task << 32) + number
            rows = batch.num_rows
            h, s, first = tokens(batch, text)
            k, found, c, keys, n = model.places(h, s)
            log_class = np.empty(len(h))
            features = feature_rows(h, first)
            for a in range(0, len(h), CHUNK):
                log_class[a : a + CHUNK] = class_log(features[a : a + CHUNK], k[a : a + CHUNK], model.weights, model.bias)
            before, n_before = model.previous(keys, n, first)
            rest_share = np.where(n_before > 0, PAIR_A * np.maximum(n_before, 1.0) ** -PAIR_B, 1.0)
            # of a pair: m * x / ((1 - m) * y) for each time it occurs; a rare word has the same share of the rare ones in both
            within = np.where(found, (c + 0.5) / room[k], rare_room[k] / room[k])
            a = (1 - rest_share) / (np.maximum(n_before, 1.0) * rest_share * within) * np.exp(-log_class)
            pair = model.pair_hashes(before, keys)
            frequent = np.zeros(len(h), bool)
            extra = np.zeros(len(h))
            if len(model.hot_pairs):
                at = np.minimum(np.searchsorted(model.hot_pairs, pair), len(model.hot_pairs) - 1)
                frequent = model.hot_pairs[at] == pair
                extra[frequent] = np.log10(1 + a[frequent] * model.hot_counts[at[frequent]])
            add = lambda x: np.add.reduceat(np.where(found, x, 0), first[:-1])  # noqa: B023, E731
            whole = np.add.reduceat(log_class / np.log(10) + np.log10(rest_share) + extra, first[:-1]) + add(model.word_log10(c, k))
            figures = {"n": np.diff(first).astype(np.int64), "n_known": add(np.ones(len(h), np.int64)).astype(np.int64), "base": add(model.base_log10(c)), "score": whole}
            yield some(1, {
                "part": pa.array([number % model.parts], pa.int32()), "kind": pa.array([ROWS], pa.int32()), "slice": pa.array([here], pa.int64()),
                **{c: pa.array([x.tobytes()], pa.binary()) for c, x in figures.items()}, "ids": pa.ListArray.from_arrays(pa.array([0, rows], pa.int32()), batch.column(id_col)),
            })
            row = np.repeat(np.arange(rows, dtype=np.int32), np.diff(first))

            def packets(kind, at, place, pack_hash, pack_own):
                """The tokens at these places by part, rows in order within each, so they compress."""
                at = at[np.argsort((place[at] >> np.uint64(48)).astype(np.uint16), kind="stable")]
                runs = [(p, pack_hash(at[x:y]), pack_own(at[x:y]), _rising(row[at[x:y]])) for p, x, y in _by_part(place[at])]  # noqa: B023
                p, *x = zip(*runs, strict=True)
                size = len(p)
                packed = {c: pa.array(v, pa.binary()) for c, v in zip(("h", "a", "row"), x, strict=True)}
                return some(size, {"part": pa.array(p, pa.int32()), "kind": pa.array(np.full(size, kind), pa.int32()), "slice": pa.array(np.full(size, here, np.int64)), **packed})  # noqa: B023

            ask = np.flatnonzero(~frequent & (a > 0))
            if len(ask):
                yield packets(PAIRS, ask, pair, lambda t: _packed(pair[t]), lambda t: _short(a[t]))  # noqa: B023
            rest = np.flatnonzero(~found)
            if len(rest):
                yield packets(WORDS, rest, model.word_parts(h), lambda t: h[t].tobytes(), lambda t: k[t].astype(np.uint8).tobytes())  # noqa: B023

    asked = docs.select(id_col, text).mapInArrow(score, schema)
    found = _lookups(asked, pairs, word_table(counts, model), model)
    out = [id_col, "n_tokens", "n_known", "base_score", "score"]

    def total(batches):
        """The sums of each slice, whose own row comes first."""
        ids, sums, now = None, {}, None

        def summed():
            return pa.RecordBatch.from_arrays([ids, pa.array(sums["n"]), pa.array(sums["n_known"]), pa.array(sums["base"]), pa.array(sums["score"])], names=out)

        for batch in batches:
            col = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                place = col["slice"][i].as_py()
                if place != now:
                    if now is not None:
                        yield summed()
                    now, ids = place, pa.concat_arrays([col["ids"].slice(i, 1).flatten()])
                    sums = {c: np.frombuffer(col[c][i].as_py(), np.int64 if c in ("n", "n_known") else np.float64).copy() for c in ("n", "n_known", "base", "score")}
                    continue
                at = np.frombuffer(col["row"][i].as_py(), np.int32)
                for c in ("n_known", "base", "score"):
                    if col[c][i].is_valid:
                        sums[c][at] += np.frombuffer(col[c][i].as_py(), sums[c].dtype)
        if now is not None:
            yield summed()

    rows = found.repartition("slice").sortWithinPartitions("slice", F.desc("kind"))
    return rows.mapInArrow(total, f"{id_col} {kind}, n_tokens bigint, n_known bigint, base_score double, score double")


def held_out(id_col: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves `part` modulo `parts`; a null id is never held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % parts == part, F.lit(False))


def op10_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model, counts, pairs = trained(docs.where(~held_out(F.col("doc_id"), 5, 1)))
    found = scored(docs, model, counts, pairs)
    return found.select("doc_id", held_out(F.col("doc_id"), 5, 1).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("bigint").alias("train_tokens"), "base_score", "score")
