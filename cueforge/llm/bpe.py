"""Byte-level BPE encoding and decoding with a public tokenizer file.

Texts are cut at the file's special tokens and then into pieces by the byte-level pattern. The distinct
pieces of a batch that the worker doesn't know yet are merged together: their symbols lie in one flat
array, every round looks all neighbouring pairs up by binary search over the sorted pair keys, and in each
piece the pair of lowest rank merges wherever it stands (overlapping places from the left). Pieces of over LONG
bytes go through rounds of one rank each, which look up only the pairs beside the places just merged, so a line of a
megabyte without a space takes seconds. Decoding joins the bytes of the ids.

The tokenizer's path must be readable on every executor; it is a parameter. Null texts are empty and have
no ids. Whole texts are encoded, however long; repeated rows get the same ids each, and an empty table gives no rows.
Extra columns pass through; the columns added here replace columns of the same name.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import words as W

# Fixed value: the pattern of byte-level pre-tokenization.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces a worker keeps between batches, and their bytes.
KNOWN_PIECES, KNOWN_BYTES = 150_000, 16 << 20
#: Bytes from which a piece merges by rank instead of in rounds with the others.
LONG = 200


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pieces = regex.compile(PIECES)
        self.of_byte = np.array([vocab[c] for c in letters], np.int64)
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.raw = [b""] * size
        for token, k in vocab.items():
            self.raw[k] = bytes(back[c] for c in token)
        for token, k in self.special.items():
            self.raw[k] = token.encode()
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.forget()

    def forget(self):
        """Known pieces: index by piece, and their ids one after another."""
        self.index: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.ends = np.zeros(1 << 16, np.int64)
        self.seen = np.zeros(1 << 16, np.int32)  # calls of encode() that a piece was in
        self.used = self.bytes = 0

    def keep_frequent(self):
        """Pieces of one call only go, half of those known at least; what is left has to come again to stay the next time."""
        n = len(self.index)
        keep = W.most_seen(self.seen[:n], KNOWN_PIECES // 2)
        pieces, seen = list(itertools.compress(self.index, keep)), self.seen[:n][keep] // 2
        size = sum(len(p.encode()) for p in pieces)
        lengths = np.diff(self.ends[:n], prepend=0)
        starts, lengths = (self.ends[:n] - lengths)[keep], lengths[keep]
        ids = self.ids[W.ragged(starts, lengths)]
        self.forget()
        if size <= KNOWN_BYTES // 2:
            self.add(pieces, ids, lengths, size)
            self.seen[: len(pieces)] = seen

    def ranks_of(self, left, right):
        """Rank of each pair; len(self.merged) where it merges never."""
        keys = left << 32 | right
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.ranks[at], len(self.merged))

    def merge_by_rank(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As merge(), for long pieces: all places of the lowest rank that is left merge, and only the pairs beside them are looked up again."""
        never, lengths = len(self.merged), np.array([len(p) for p in pieces], np.int64)
        n = int(lengths.sum())
        symbols = np.append(self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)], 0)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        ends = np.cumsum(lengths)
        after[ends - 1] = n  # place n is no place
        before[ends - lengths] = n
        rank = np.full(n + 1, never, np.int64)
        alive = np.ones(n, bool)
        places: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def look_up(at):
            at = at[after[at] < n]
            rank[at] = self.ranks_of(symbols[at], symbols[after[at]])
            at = at[rank[at] < never]
            at = at[np.argsort(rank[at], kind="stable")]
            heads = np.flatnonzero(np.diff(rank[at], prepend=-1))
            for r, part in zip(rank[at[heads]].tolist(), np.split(at, heads[1:]) if len(heads) else (), strict=True):
                if r not in places:
                    places[r] = []
                    heapq.heappush(heap, r)
                places[r].append(part)

        look_up(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            # overlapping places: every second one of a run merges
            start = np.flatnonzero(np.append(True, after[at[:-1]] != at[1:]))
            run = np.diff(np.append(start, len(at)))
            at = at[(np.arange(len(at)) - np.repeat(start, run)) % 2 == 0]
            gone = after[at]
            symbols[at] = self.merged[r]
            alive[gone] = False
            rank[gone] = rank[at] = never
            after[at] = after[gone]
            before[after[at]] = at
            left = before[at]
            left = left[left < n]
            rank[left] = never
            look_up(np.unique(np.concatenate([at, left])))
        return symbols[:n][alive].astype(np.int32), np.add.reduceat(alive, ends - lengths, dtype=np.int64)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, how many each piece has)."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        symbols = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        piece = np.repeat(np.arange(len(pieces)), lengths)
        done_symbols, done_piece = [], []
        never = len(self.merged)
        while len(symbols):
            # the pair at each symbol and the next one of the same piece
            inner = np.flatnonzero(piece[:-1] == piece[1:])
            rank = np.full(len(symbols), never, np.int64)
            rank[inner] = self.ranks_of(symbols[inner], symbols[inner + 1])
            heads = np.flatnonzero(np.diff(piece, prepend=-1))
            least = np.minimum.reduceat(rank, heads)
            sizes = np.diff(np.append(heads, len(symbols)))
            over = np.repeat(least, sizes)
            still = over < never
            done_symbols.append(symbols[~still])
            done_piece.append(piece[~still])
            take = (rank == over) & still
            # successive places of one pair overlap: every second place of such a run merges
            where = np.flatnonzero(take)
            start = np.flatnonzero(np.diff(where, prepend=-2) != 1)
            run = np.diff(np.append(start, len(where)))
            odd = (np.arange(len(where)) - np.repeat(start, run)) % 2 == 1
            where = where[~odd]
            symbols = symbols.copy()
            symbols[where] = self.merged[rank[where]]
            still[where + 1] = False
            symbols, piece = symbols[still], piece[still]
        symbols, piece = np.concatenate([*done_symbols, symbols]), np.concatenate([*done_piece, piece])
        order = np.argsort(piece, kind="stable")
        return symbols[order].astype(np.int32), np.bincount(piece, minlength=len(pieces))

    def learn(self, pieces: list[str]):
        if not pieces:
            return
        raw = [p.encode() for p in pieces]
        long = [k for k, p in enumerate(raw) if len(p) > LONG]
        if long:
            whole = set(long)
            pieces = [p for k, p in enumerate(pieces) if k not in whole] + [pieces[k] for k in long]
            short = [p for k, p in enumerate(raw) if k not in whole]
            ids, counts = self.merge(short) if short else (np.zeros(0, np.int32), np.zeros(0, np.int64))
            more, more_counts = self.merge_by_rank([raw[k] for k in long])
            ids, counts = np.concatenate([ids, more]), np.concatenate([counts, more_counts])
        else:
            ids, counts = self.merge(raw)
        self.add(pieces, ids, counts, sum(map(len, raw)))

    def add(self, pieces: list[str], ids: np.ndarray, counts: np.ndarray, size: int):
        """Pieces of `size` bytes become known, with their ids one after another."""
        self.bytes += size
        n, k = len(self.index), len(pieces)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.int32)])
        if n + k > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(max(len(self.ends), k), np.int64)])
            self.seen = np.concatenate([self.seen, np.zeros(len(self.ends) - len(self.seen), np.int32)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.ends[n : n + k] = self.used + np.cumsum(counts)
        self.used += len(ids)
        self.index.update(zip(pieces, range(n, n + k), strict=True))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.index) > KNOWN_PIECES or self.bytes > KNOWN_BYTES:
            self.keep_frequent()
        found, sizes, specials = [], [], []
        for text in texts:
            before = len(found)
            if text and self.split and (cut := self.split.search(text)):
                done = 0
                for cut in self.split.finditer(text):
                    found += self.pieces.findall(text, done, cut.start())
                    specials.append((len(found), self.special[cut[0]]))
                    found.append("")
                    done = cut.end()
                found += self.pieces.findall(text, done)
            elif text:
                found += self.pieces.findall(text)
            sizes.append(len(found) - before)
        index = self.index
        self.learn([p for p in dict.fromkeys(found) if p and p not in index])
        at = np.fromiter(map(index.get, found, [0] * len(found)), np.int64, len(found))
        if len(index):
            self.seen += W.marked(at, len(self.seen))
        if not len(index):
            lengths, starts = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        else:
            starts = np.where(at > 0, self.ends[at - 1], 0)
            lengths = self.ends[at] - starts
        for k, _ in specials:
            lengths[k] = 1
        ids = self.ids[np.minimum(W.ragged(starts, lengths), len(self.ids) - 1)]
        ends = np.append(0, np.cumsum(lengths))
        for k, special in specials:
            ids[ends[k]] = special
        bounds = ends[np.append(0, np.cumsum(sizes))]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def decode(self, ids) -> str:
        return b"".join(map(self.raw.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode("utf-8", "replace")


_loaded: dict[str, Bpe] = {}


def tokenizer(path: str) -> Bpe:
    """The worker's own copy, kept between batches and tasks."""
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = Bpe(path)
    return _loaded[path]


def _mapped(df: DataFrame, column: str, added: dict[str, tuple[str, pa.DataType]], make) -> DataFrame:
    kept = [c for c in df.columns if c not in added]
    schema = df.select(*kept).schema.simpleString()[7:-1]
    is_text = df.schema[column].dataType.simpleString() == "string"
    types = [t for _, t in added.values()]
    names = [*kept, *added]

    def run(batches):
        for batch in W.slices(batches, column, 1 << 20) if is_text else batches:
            values = make(batch.column(column).to_pylist())
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(v, t) for v, t in zip(values, types, strict=True)]], names=names)

    source = df.select(*kept) if column in kept else df
    return source.mapInArrow(run, ", ".join([schema, *[f"{c} {t}" for c, (t, _) in added.items()]]))


def encoded(df: DataFrame, path: str, text: str = "text", to: str = "ids") -> DataFrame:
    """The rows with the token ids of the whole text."""
    return _mapped(df, text, {to: ("array<int>", pa.list_(pa.int32()))}, lambda texts: [tokenizer(path).encode(texts)])


def decoded(df: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """The rows with the text that the ids stand for; null ids give null."""
    return _mapped(df, ids, {to: ("string", pa.string())}, lambda rows: [[None if r is None else tokenizer(path).decode(r) for r in rows]])


def round_trips(df: DataFrame, path: str, text: str = "text", ids: str | None = None) -> DataFrame:
    """The rows with n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers) and decoded_sha256; with the ids too if `ids` names a column for them."""

    def digest(texts):
        model = tokenizer(path)
        rows = model.encode(texts)
        return (
            [len(r) for r in rows],
            [hashlib.sha256(r.astype("<u4").tobytes()).hexdigest() for r in rows],
            [hashlib.sha256(model.decode(r).encode()).hexdigest() for r in rows],
            *([rows] if ids else []),
        )

    added = {"n_tokens": ("bigint", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    if ids:
        added[ids] = ("array<int>", pa.list_(pa.int32()))
    return _mapped(df, text, added, digest)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trips(docs, public_path("byte_bpe_50k.json")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
