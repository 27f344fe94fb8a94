"""Token ids in binary files: blocks coded by a static range asymmetric numeral system.

Documents are ordered by id over range partitions. Each partition is cut into segments of whole
documents with about SEGMENT_TOKENS ids. A segment has one static table of the frequencies of its own ids,
scaled to 2^PRECISION, that its BLOCKS share; each block holds a run of the segment's ids, dealt over
LANES interleaved states, has its own words and can be decoded alone. The segment's header is the
checkpoint: for each block where its words start, the final states, how many ids it has, and the CRC-32
of its words. Numpy codes all lanes of all blocks of a segment in step.

The files are Parquet files of segments (one row each, the payload a binary column), so Spark's own
writers and readers commit and split them on any store. Reading back checks every block's checksum.

Null texts are empty: their documents have only the end id. Documents without an id come first. Rows that share
an id keep no order among themselves. Extra columns aren't stored.
"""

from __future__ import annotations

import json
import struct
import zlib
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .bpe import byte_letters
from .store import new_path

SEGMENT_TOKENS = 1 << 20
BLOCKS, LANES = 32, 64
PRECISION = 18
LOW = np.uint64(1) << np.uint64(31)
END_ID = 1
#: Words a worker keeps between batches; beyond that, those used once go first.
KNOWN_WORDS = 1_000_000

# How the tokenizer's file prepares texts and cuts them into pieces.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PIECES = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: What a byte of a word is to that pattern; letters are those of ASCII and of U+00C0 to U+00FF. UNSURE: apostrophes, control and all other characters.
SPACE, SIGN, LETTER, DIGIT, UNSURE = range(5)
KINDS = np.full(256, UNSURE, np.uint8)
KINDS[0x21:0x7F] = SIGN
KINDS[0x30:0x3A] = DIGIT
KINDS[0x41:0x5B] = KINDS[0x61:0x7B] = KINDS[0x80:0xC0] = KINDS[0xC3] = LETTER
KINDS[0x20], KINDS[0x27] = SPACE, UNSURE


def scaled(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to sum to 2^PRECISION, each at least 1."""
    total = 1 << PRECISION
    if len(counts) > total // 2:
        raise ValueError(f"{len(counts)} different ids in a segment are too many for {PRECISION} bits")
    out = np.maximum(1, counts * (total - len(counts)) // counts.sum())
    out[np.argmax(out)] += total - out.sum()
    if out.min() < 1:
        # the largest can't pay for all: take from those above 1 by size
        out = np.maximum(1, counts * (total - 2 * len(counts)) // counts.sum())
        out[np.argmax(out)] += total - out.sum()
    return out.astype(np.int64)


def _shape(n: int) -> tuple[int, int]:
    """(ids a block has room for, steps)."""
    per_block = -(-n // BLOCKS)
    steps = -(-per_block // LANES)
    return per_block, steps


def _dealt(values: np.ndarray, other: int) -> np.ndarray:
    """The values by step and lane, with `other` where a lane has none."""
    per_block, steps = _shape(len(values))
    grid = np.full((BLOCKS, steps * LANES), other, values.dtype)
    grid[:, :per_block] = np.append(values, np.full(BLOCKS * per_block - len(values), other, values.dtype)).reshape(BLOCKS, per_block)
    return np.ascontiguousarray(grid.reshape(BLOCKS, steps, LANES).swapaxes(0, 1)).reshape(steps, BLOCKS * LANES)


def _gathered(grid: np.ndarray, n: int) -> np.ndarray:
    """The n values that _dealt() made the grid of."""
    per_block, steps = _shape(n)
    return grid.reshape(steps, BLOCKS, LANES).swapaxes(0, 1).reshape(BLOCKS, steps * LANES)[:, :per_block].ravel()[:n]


def pack(ids: np.ndarray) -> bytes:
    """One segment: header, table, checkpoints and the words of each block."""
    n = len(ids)
    if n and ids.max() < 1 << 20:
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        place = np.zeros(len(counts), np.int64)
        place[symbols] = np.arange(len(symbols))
        dense, counts = place[ids], counts[symbols]
    else:
        symbols, dense, counts = np.unique(ids, return_inverse=True, return_counts=True)
    table = zlib.compress(np.diff(symbols, prepend=0).astype("<u4").tobytes() + (freq := scaled(counts) if n else np.zeros(0, np.int64)).astype("<u4").tobytes(), 6)
    # a lane without an id codes one that takes up all of the range, which leaves the state as it is
    dealt = _dealt(dense, len(symbols))
    start = np.append(np.cumsum(freq) - freq, 0).astype(np.uint64)
    freq = np.append(freq, 1 << PRECISION).astype(np.uint64)
    gap, limit = np.uint64(1 << PRECISION) - freq, freq * ((LOW >> np.uint64(PRECISION)) << np.uint64(32))
    state = np.full(BLOCKS * LANES, LOW, np.uint64)
    words = np.zeros(dealt.shape, np.uint32)
    given = np.zeros(dealt.shape, bool)
    for t in range(len(dealt) - 1, -1, -1):
        s = dealt[t]
        out = state >= limit[s]
        words[t], given[t] = state, out
        x = state >> (out * np.uint64(32))
        state = x + x // freq[s] * gap[s] + start[s]
    blocks = [words[:, b * LANES : (b + 1) * LANES][given[:, b * LANES : (b + 1) * LANES]].astype("<u4").tobytes() for b in range(BLOCKS)]
    states = state.astype("<u8").tobytes()
    head = struct.pack("<4sIIIII", b"RANS", n, len(symbols), len(table), PRECISION, zlib.crc32(table + states))
    checkpoints = np.array([[len(b), zlib.crc32(b)] for b in blocks], "<u4").tobytes()
    return head + table + checkpoints + states + b"".join(blocks)


def unpack(raw: bytes) -> np.ndarray:
    """The segment's ids; raises ValueError if a block's checksum is wrong."""
    magic, n, n_symbols, table_len, precision, crc = struct.unpack_from("<4sIIIII", raw)
    if magic != b"RANS":
        raise ValueError("not a segment")
    at = struct.calcsize("<4sIIIII")
    states = at + table_len + 8 * BLOCKS
    if zlib.crc32(raw[at : at + table_len] + raw[states : states + 8 * BLOCKS * LANES]) != crc:
        raise ValueError("the checksum of a segment's table is wrong")
    table = np.frombuffer(zlib.decompress(raw[at : at + table_len]), "<u4").astype(np.int64)
    symbols, freq = np.cumsum(table[:n_symbols]), table[n_symbols:]
    at += table_len
    checkpoints = np.frombuffer(raw, "<u4", 2 * BLOCKS, at).reshape(BLOCKS, 2)
    at += 8 * BLOCKS
    state = np.frombuffer(raw, "<u8", BLOCKS * LANES, at).astype(np.uint64)
    at += 8 * BLOCKS * LANES
    place = []
    for size, crc in checkpoints.tolist():
        if zlib.crc32(raw[at : at + size]) != crc:
            raise ValueError("a block's checksum is wrong")
        place.append(at)
        at += size
    body = place[0] if place else at
    stream = np.append(np.frombuffer(raw, "<u4", (at - body) // 4, body).astype(np.uint64), np.uint64(0))
    pointer = (np.array(place, np.int64) - body) // 4
    if not n:
        return np.zeros(0, np.int64)
    start = np.cumsum(freq) - freq
    of_slot = np.repeat(np.arange(n_symbols, dtype=np.int32), freq)
    freq, start = freq.astype(np.uint64), start.astype(np.uint64)
    there = _dealt(np.ones(n, bool), False)
    full = there.all(axis=1).tolist()
    out = np.zeros(there.shape, np.int32)
    mask = np.uint64((1 << precision) - 1)
    for t in range(len(there)):
        slot = state & mask
        s = out[t] = of_slot[slot]
        x = freq[s] * (state >> np.uint64(precision)) + slot - start[s]
        if not full[t]:
            x = np.where(there[t], x, state)
        need = np.flatnonzero(x < LOW)
        taken = np.bincount(need // LANES, minlength=BLOCKS)
        word = stream[np.arange(len(need)) + np.repeat(pointer - np.cumsum(taken) + taken, taken)]
        x[need] = (x[need] << np.uint64(32)) | word
        state = x
        pointer = pointer + taken
    return symbols[_gathered(out, n)]


def pieces_of(words: list[bytes], kinds: np.ndarray = KINDS) -> np.ndarray:
    """How many pieces the pattern cuts each word into; 0 for words with something UNSURE."""
    raw = np.frombuffer(b" ".join([*words, b""]), np.uint8)
    kind = kinds[raw]
    # U+00D7 and U+00F7 are no letters
    kind[1:][(raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))] = UNSURE
    ends = np.flatnonzero(kind == SPACE)
    heads = kind != SPACE
    heads[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    pieces = np.diff(np.cumsum(heads)[ends], prepend=0)
    pieces[np.diff(np.cumsum(kind == UNSURE)[ends], prepend=0) > 0] = 0
    return pieces


class WordIds:
    """Ids of texts by the tokenizers library, which sees each different word once.

    The tokenizer's pattern drops white space and no token spans it, so a text's ids are its words' ids.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.mark_id, token = max(self.model.get_added_tokens_decoder().items())
        self.mark = token.content.encode()
        self.between = b" " + self.mark + b" "
        self.kinds = KINDS.copy()
        self.kinds[[t.content.encode()[0] for t in self.model.get_added_tokens_decoder().values()]] = UNSURE
        self.closing = self._closing()
        self.forget()

    def _closing(self) -> np.ndarray | None:
        """By id, whether the token ends a piece; None if the file isn't known to cut pieces in the way of pieces_of()."""
        model, suffix = self.model.model, getattr(self.model.model, "end_of_word_suffix", None)
        if any(t.normalized for t in self.model.get_added_tokens_decoder().values()):
            return None
        for part, known in ((self.model.normalizer, NORMALIZER), (self.model.pre_tokenizer, PIECES)):
            if part is None or json.loads(part.__getstate__()) != known:
                return None
        vocab = self.model.get_vocab(with_added_tokens=False)
        if not suffix or model.continuing_subword_prefix or not all(c in vocab and c + suffix in vocab for c in byte_letters()):
            return None
        closing = np.zeros(max(vocab.values()) + 1, bool)
        closing[[k for token, k in vocab.items() if token.endswith(suffix)]] = True
        return closing

    def forget(self):
        self.index: dict[bytes, int] = {}
        self.ids, self.ends, self.uses = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def shrink(self):
        """Forget words used no more often than the usual word, half of them at least."""
        n = len(self.index)
        keep = self.uses[:n] > max(1, np.median(self.uses[:n]))
        starts = np.append(0, self.ends[: n - 1])[keep]
        lengths = self.ends[:n][keep] - starts
        ids, ends, uses = self.ids[W.ragged(starts, lengths)], np.cumsum(lengths), self.uses[:n][keep]
        kept = [w for w, k in zip(self.index, keep.tolist(), strict=True) if k]
        self.forget()
        self.index = dict(zip(kept, range(len(kept)), strict=True))
        room = lambda x: np.concatenate([x, np.zeros(1 << 16, x.dtype)])
        self.ids, self.ends, self.uses = room(ids), room(ends), room(uses)

    def joined(self, words: list[bytes], between: bytes) -> np.ndarray:
        """The ids of many words in few texts, with `between` after each word."""
        rows = self.model.encode_batch_fast([between.join([*words[k : k + 1000], b""]).decode() for k in range(0, len(words), 1000)], add_special_tokens=False)
        return np.concatenate([np.array(row.ids, np.uint32) for row in rows])

    def learn(self, fresh: list[bytes]):
        """Encode new words, many in one text. A word ends with the last of its pieces where their number is known; else a special token between two words shows it."""
        if not fresh:
            return
        pieces = pieces_of(fresh, self.kinds) if self.closing is not None else np.zeros(len(fresh), np.int64)
        easy, rest = list(compress(fresh, (pieces > 0).tolist())), list(compress(fresh, (pieces == 0).tolist()))
        plain, odd = [w for w in rest if self.mark not in w], [w for w in rest if self.mark in w]
        parts, counts = [], []
        if easy:
            ids = self.joined(easy, b" ")
            ends = np.flatnonzero(self.closing[ids]) + 1
            if len(ends) != pieces.sum():
                raise ValueError("the tokenizer's pieces aren't those counted")
            parts.append(ids)
            counts.append(np.diff(ends[np.cumsum(pieces[pieces > 0]) - 1], prepend=0))
        if plain:
            ids = self.joined(plain, self.between)
            ends = np.flatnonzero(ids == self.mark_id)
            parts.append(np.delete(ids, ends))
            counts.append(np.diff(ends, prepend=-1) - 1)
        for w in odd:
            parts.append(np.array(self.model.encode(w.decode(), add_special_tokens=False).ids, np.uint32))
            counts.append(np.array([len(parts[-1])]))
        new, counts, fresh = np.concatenate(parts), np.concatenate(counts), easy + plain + odd
        n, k = len(self.index), len(fresh)
        used = int(self.ends[n - 1]) if n else 0
        if used + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(new)), np.uint32)])
        if n + k > len(self.ends):
            more = max(len(self.ends), k)
            self.ends, self.uses = np.concatenate([self.ends, np.zeros(more, np.int64)]), np.concatenate([self.uses, np.zeros(more, np.int64)])
        self.ids[used : used + len(new)] = new
        self.ends[n : n + k] = used + np.cumsum(counts)
        self.index.update(zip(fresh, range(n, n + k), strict=True))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another with the end id of each text, how many each text has)."""
        if len(self.index) > KNOWN_WORDS:
            self.shrink()
        index, found, sizes, places, new = self.index, [], [], [], []
        for k, text in enumerate(texts, 1):
            # the tokenizer lower-cases, but not the special tokens that it looks for first
            parts = text.split() if b"<|" in text else text.lower().split()
            found += parts
            sizes.append(len(parts))
            # a few texts at a time, so that their words are still in the processor's cache
            if len(found) > 1 << 12 or k == len(texts):
                here = np.fromiter(map(index.get, found, repeat(-1)), np.int64, len(found))
                new += [found[j] for j in np.flatnonzero(here < 0).tolist()]
                places.append(here)
                found = []
        at = np.concatenate(places)
        if new:
            self.learn(list(dict.fromkeys(new)))
            at[at < 0] = np.fromiter(map(index.__getitem__, new), np.int64, len(new))
        self.uses[: len(index)] += np.bincount(at, minlength=len(index))
        starts = np.where(at > 0, self.ends[at - 1], 0)
        lengths = self.ends[at] - starts
        bounds = np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(sizes))]
        counts = np.diff(bounds) + 1
        out = np.full(int(counts.sum()), END_ID, np.uint32)
        end = np.zeros(len(out), bool)
        end[np.cumsum(counts) - 1] = True
        out[~end] = self.ids[W.ragged(starts, lengths)]
        return out, counts


_loaded: dict[str, WordIds] = {}


def _word_ids(path: str) -> WordIds:
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = WordIds(path)
    return _loaded[path]


def write_ids(docs: DataFrame, tokenizer_path: str, to: str, id_col: str = "doc_id", text: str = "text", segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encode the texts and write segments in ascending order of the ids."""
    kind = docs.schema[id_col].dataType.simpleString()

    def segments(batches):
        ids, keys, counts, size, number, before = [], [], [], 0, 0, 0

        def segment():
            joined = np.concatenate(ids)
            lengths = np.concatenate(counts)
            key = pa.concat_arrays(keys)
            of = lambda values, t: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(t))
            return pa.RecordBatch.from_arrays(
                [part, pa.array([number], pa.int64()), pa.array([before], pa.int64()), of(key, key.type), of(pa.array(lengths), pa.int64()), pa.array([len(joined)], pa.int64()), pa.array([pack(joined)], pa.binary())],
                names=["part", "segment", "first", "ids", "lengths", "n", "payload"],
            )

        part = None
        for batch in W.slices(batches, text, 1 << 21):
            part = batch.column("part").slice(0, 1)
            column = pa.compute.fill_null(batch.column(text).cast(pa.binary()), b"")
            found, lengths = _word_ids(tokenizer_path).encode(column.to_pylist())
            ids.append(found)
            counts.append(lengths)
            keys.append(batch.column(id_col))
            size += len(found)
            if size >= segment_tokens:
                yield segment()
                ids, keys, counts, size, number, before = [], [], [], 0, number + 1, before + size
        if ids:
            yield segment()

    ordered = docs.select(id_col, text).repartitionByRange(_parts(docs), id_col).sortWithinPartitions(id_col).withColumn("part", F.spark_partition_id())
    ordered.mapInArrow(segments, f"part int, segment bigint, first bigint, ids array<{kind}>, lengths array<bigint>, n bigint, payload binary").write.parquet(to)


def _parts(docs: DataFrame) -> int:
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


def read_ids(spark, path: str, id_col: str = "doc_id", digest: bool = False) -> DataFrame:
    """One row per document of the files: id, start (ids before it), n_tokens, and ids (unsigned 32-bit, little-endian bytes), or with `digest` their ids_crc32."""
    files = spark.read.parquet(path)
    kind = files.schema["ids"].dataType.elementType.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    # as many rows as the writer had partitions, so they can be broadcast
    parts = files.groupBy("part").agg(F.sum("n").alias("total"))
    parts = parts.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))

    def documents(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                ids = unpack(batch.column("payload")[row].as_py()).astype("<u4")
                lengths = batch.column("lengths")[row].values.to_numpy(zero_copy_only=False)
                ends = np.cumsum(lengths)
                raw = ids.tobytes()
                each = [raw[4 * a : 4 * b] for a, b in zip(ends - lengths, ends, strict=True)]
                last = pa.array([zlib.crc32(x) for x in each], pa.int64()) if digest else pa.array(each, pa.binary())
                starts = batch.column("first")[row].as_py() + ends - lengths
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(lengths), batch.column("part")[row].as_py(), np.int32)), batch.column("ids")[row].values.cast(arrow), pa.array(starts), pa.array(lengths), last],
                    names=["part", id_col, "inner", "n_tokens", "value"],
                )

    schema = f"part int, {id_col} {kind}, inner bigint, n_tokens bigint, value {'bigint' if digest else 'binary'}"
    found = files.select("part", "first", "ids", "lengths", "payload").mapInArrow(documents, schema)
    return found.join(F.broadcast(parts), "part").select(id_col, (F.col("base") + F.col("inner")).alias("start"), "n_tokens", F.col("value").alias("ids_crc32" if digest else "ids"))


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    from .bpe import public_path

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = new_path(spark, "token-ids")
    write_ids(docs, public_path("word_bpe_49k.json"), path)
    return read_ids(spark, path, digest=True)
