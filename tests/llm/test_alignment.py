"""Cross-tokenizer alignment against the tokenizer libraries and a brute-force count of overlaps."""

import collections
import hashlib
import random

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cueforge.llm import alignment, bpe
from tests.llm.test_llm import ODD, clashing, rows

A, B = bpe.public_path("byte_bpe_50k.json"), bpe.public_path("piece_bpe_32k.model")


def brute(texts):
    """Per text: (n_a, n_b, n_groups, n_links, n_best, count_sum, digest); counts over all texts."""
    import sentencepiece

    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    back = {c: b for b, c in enumerate(bpe.byte_letters())}
    found, holders = [], collections.Counter()
    for text in texts:
        if not text:
            found.append(None)
            continue
        a = library.encode(" " + text, add_special_tokens=False).ids
        b = model.encode(text)
        raw_a = [bytes(back[c] for c in library.id_to_token(k)) for k in a]
        raw_b = [bytes([int(model.id_to_piece(k)[3:5], 16)]) if model.is_byte(k) else model.id_to_piece(k).replace("▁", " ").encode() for k in b]
        if b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
            found.append(None)
            continue
        spans = [[(sum(map(len, raw[:i])), sum(map(len, raw[: i + 1]))) for i in range(len(raw))] for raw in (raw_a, raw_b)]
        common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        parts, low = [], 0
        for e in common:
            parts.append("|".join(",".join(str(k) for k, (s, _) in zip(ids, sp, strict=True) if low <= s < e) for ids, sp in ((a, spans[0]), (b, spans[1]))))
            low = e
        links = [(x, y) for x, (s, e) in zip(a, spans[0], strict=True) for y, (t, f) in zip(b, spans[1], strict=True) if s < f and t < e]
        holders.update(set(links))
        found.append((len(a), len(b), len(common), links, ";".join(parts)))
    most = {}
    for (x, _), n in holders.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            best = sum(holders[link] == most[link[0]] for link in f[3])
            out.append((*f[:3], len(f[3]), best, sum(holders[link] for link in f[3]), hashlib.sha256(f[4].encode()).hexdigest()))
    return out, holders, most


def mixed_texts(n, seed):
    rnd = random.Random(seed)
    bits = ["the", " and", "  ", " ", "\n", "\t", "é", "日本語", "🙂", "<s>", "</s>", "<unk>", "<0x41>", "<|endoftext|>", "naïve", "123", "...", "'ve", "x", "Straße", " ", "ﬁ", "é", "​", "\r\n", "\x00"]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 30))) for _ in range(n)]


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


TEXTS = [*mixed_texts(400, 13), *ODD, "a ▁ mark", "▁", " ", "   ", "trail  ", " lead", "tail \n"]


def test_stretches_change_nothing(monkeypatch):
    whole = alignment.Aligned(alignment.pair(A, B), TEXTS)
    monkeypatch.setattr(alignment, "STRETCH", 7)
    parts = alignment.Aligned(alignment.pair(A, B), TEXTS)
    assert parts.cut_a.tolist() == whole.cut_a.tolist() and parts.cut_b.tolist() == whole.cut_b.tolist()


def test_alignment(spark):
    texts = TEXTS
    want, holders, most = brute(texts)
    got = {r.doc_id: tuple(r[c] for c in NAMES) for r in alignment.scored(clashing(spark, texts).repartition(5), A, B).collect()}
    assert [got[i] for i in range(len(texts))] == want
    counts = {(r.a_id, r.b_id): (r.docs, r.best) for r in alignment.pair_counts(rows(spark, texts), A, B).collect()}
    assert counts == {k: (n, n == most[k[0]]) for k, n in holders.items()}


def test_groups_give_both_texts_back(spark):
    texts = mixed_texts(60, 14) + [None, ""]
    model = alignment.pair(A, B)
    for r in alignment.groups(clashing(spark, texts).withColumn("a_ids", F.lit(1)), A, B).collect():
        low = (0, 0)
        parts = []
        for cut in zip(r.a_cuts, r.b_cuts, strict=True):
            a, b = (b"".join(m.raw[k] for k in ids[x:y]) for m, ids, x, y in zip((model.a, model.b), (r.a_ids, r.b_ids), low, cut, strict=True))
            assert a == b and a
            parts.append(a)
            low = cut
        assert b"".join(parts).decode() == (f" {r.text}" if r.text else "") and r.ids == "x"


def test_pieces_by_word_are_those_of_the_text():
    model = alignment.Pieces(B)
    for text in mixed_texts(800, 15) + ["a  b   c    ", "    x", "\n \n  \n", "x" * 5000]:
        ids, _, same = model.encode([" " + text])
        assert same[0] and ids.tolist() == model.model.encode(text)


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "one two"), (1, "one two"), (1, "one two"), (1, None)], "doc_id int, text string")
    got = sorted((r.doc_id or 0, r.n_links, r.count_sum) for r in alignment.scored(df, A, B).collect())
    assert got == [(0, 2, 6), (1, 0, 0), (1, 2, 6), (1, 2, 6)]
    assert alignment.scored(df.limit(0), A, B).count() == 0
    assert alignment.pair_counts(df.where("text is null"), A, B).count() == 0


def test_frequent_words_stay_known(monkeypatch):
    monkeypatch.setattr(alignment, "KNOWN_WORDS", 6)
    monkeypatch.setattr(bpe, "KNOWN_PIECES", 6)
    pieces, coder = alignment.Pieces(B), bpe.Bpe(A)
    whole = Tokenizer.from_file(A)
    for k in range(12):
        text = f" often again x{k} y{k} z{k}"
        fresh = alignment.Pieces(B).encode([text])
        assert all((a == b).all() for a, b in zip(pieces.encode([text]), fresh, strict=True))
        assert coder.encode([text])[0].tolist() == whole.encode(text, add_special_tokens=False).ids
        if k:
            assert {" often", " again"} <= pieces.known.keys() and {" often", " again"} <= coder.index.keys()
        assert len(pieces.known) <= 12 and len(coder.index) <= 16


def test_counts_go_by_packed_and_in_pieces(spark, monkeypatch):
    """Many slices, parts and partial sums give the same, and no pair is a row of its own in joins or lists of the JVM."""
    texts = [*mixed_texts(300, 16), None, ""]
    want, holders, _ = brute(texts)
    plans, keep = [], alignment.stored
    monkeypatch.setattr(alignment, "stored", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, name))
    for name, value in (("SLICE_BYTES", 500), ("TOGETHER", 3), ("SUMMED", 40)):
        monkeypatch.setattr(alignment, name, value)
    got = {r.doc_id: tuple(r[c] for c in NAMES) for r in alignment.scored(rows(spark, texts).repartition(3), A, B).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert not [x for x in ("Join", "Generate", "collect_list") if x in plans[0]]
    assert alignment.pair_counts(rows(spark, texts), A, B).count() == len(holders)


def test_numbers_are_packed_as_small_as_they_are():
    for x, size in (([], 1), ([0, 255], 1), ([256, 3], 2), ([1 << 16], 4), ([1 << 40, 0], 8)):
        blob = alignment._packed(np.array(x, np.int64))
        assert blob[0] == size and len(blob) == 1 + size * len(x) and alignment._unpacked(blob).tolist() == x
