"""Token counts by the best path through a unigram vocabulary, without making the tokens.

An Aho-Corasick automaton enumerates every vocabulary piece that ends at each character; dynamic programming
carries the best score and its number of pieces. Ties go as in the tokenizers library's Unigram model: of paths
with equal score to a place, the one whose last piece starts first stays. A character without a piece of
its own costs UNKNOWN below the smallest score and counts as its bytes (byte fallback).

Before that, a space becomes the mark and every mark opens a new word, and a mark is put before the text, as the
library's Metaspace step does. No piece holds a character that the vocabulary lacks, so texts are also cut at
line ends, and each different word is worked out once by a worker.

The vocabulary comes from a SentencePiece file: its pieces and scores as they stand. Null texts are empty and have no
tokens. Extra columns pass through; `n_tokens` replaces a column of that name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

MARK = "▁"
UNKNOWN = 10.0
KNOWN_WORDS = 600_000


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(k), model.get_score(k)) for k in range(model.get_piece_size())]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.find = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.find.add_word(piece, (len(piece), score))
        self.find.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN
        self.single = {piece for piece, _ in pieces if len(piece) == 1}
        letters = {c for piece, _ in pieces for c in piece}
        #: characters to cut at, the one that stands for all of them first
        self.cuts = [c for c in "\0\n\r\t" if c not in letters]
        if "\0" not in self.cuts:
            self.cuts = []
        if any(MARK in piece.lstrip(MARK) for piece, _ in pieces):
            raise ValueError("a piece goes over the end of a word")
        self.known: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Pieces on the best path of one word."""
        n = len(word)
        score = [0.0] * (n + 1)
        count = [0] * (n + 1)
        place = 0
        single, unknown = self.single, self.unknown

        def lone(end):
            """The character before `end` by itself, if no piece ends there that is better."""
            c = word[end - 1]
            if c not in single:
                s = score[end - 1] + unknown
                if not reached or s > score[end]:
                    score[end] = s
                    count[end] = count[end - 1] + len(c.encode())

        reached = False
        for last, (length, own) in self.find.iter(word):
            end = last + 1
            while place < end:
                if place:
                    lone(place)
                place += 1
                reached = False
            s = score[end - length] + own
            if not reached or s > score[end]:
                score[end] = s
                count[end] = count[end - length] + 1
                reached = True
        while place <= n:
            if place:
                lone(place)
            place += 1
            reached = False
        return count[n]

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        known = self.known
        body = text.replace(" ", MARK)
        if body[0] != MARK:
            body = MARK + body
        extra = 0
        for c in self.cuts:
            if c in body:
                extra += body.count(c)
                body = body.replace(c, "\0")
        total = extra
        for line in body.split("\0") if self.cuts else [body]:
            parts = line.split(MARK)
            if parts[0]:
                total += self.of(parts[0])
            for part in parts[1:]:
                part = MARK + part
                k = known.get(part)
                total += self.of(part) if k is None else k
        return total

    def of(self, word: str) -> int:
        k = self.known.get(word)
        if k is None:
            if len(self.known) >= KNOWN_WORDS:
                self.known.clear()
            k = self.known[word] = self.word(word)
        return k


_loaded: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = Counter(vocabulary(path))
    return _loaded[path]


def counted(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The rows with n_tokens."""
    kept = [c for c in df.columns if c != "n_tokens"]
    schema = df.select(*kept).schema.simpleString()[7:-1]

    def run(batches):
        model = counter(path)
        for batch in W.slices(batches, text):
            n = np.array([model.text(t) for t in batch.column(text).to_pylist()], np.int64)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n)], names=[*kept, "n_tokens"])

    return df.select(*kept).mapInArrow(run, f"{schema}, n_tokens bigint")


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    from .bpe import public_path

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return counted(docs, public_path("piece_bpe_32k.model")).select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), "n_tokens")
