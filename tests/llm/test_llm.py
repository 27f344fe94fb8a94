"""The ten operators against brute force, the tokenizers library and exact round trips, with odd input."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from cueforge.llm import bpe, components, decontaminate, langid, lm, neardup, pages, quality, substrings, tokenfiles, unigram
from cueforge.llm import words as W

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def rows(spark, texts, start=0):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts, start)], "doc_id long, text string")


def clashing(spark, texts):
    """Extra columns with the names that operators use inside."""
    df = rows(spark, texts)
    for c in ("n_words", "score", "h", "key", "hits", "ids", "shared", "kept", "lang_pred", "n_tokens", "removed", "_c"):
        df = df.withColumn(c, F.lit("x"))
    return df


def story(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


ODD = [None, "", " \t\n", "a", "é\x0b日本 \x1c x", "same text", "same text", "x " * 3000]


# --- words -------------------------------------------------------------------------------------------


def test_words_match_the_pattern():
    import pyarrow as pa

    texts = [t or "" for t in ODD] + [" lead", "trail ", "\x0ca\x0bb"]
    data, offsets = W.text_bytes(pa.array(texts))
    starts, ends, first = W.find_words(data, offsets)
    raw = data.tobytes()
    got = [[raw[a:b] for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(first[:-1], first[1:], strict=True)]
    assert got == [WORD.findall(t.encode()) for t in texts]
    hashes = W.hash_words(data, starts, ends)
    by = collections.defaultdict(set)
    for h, a, b in zip(hashes.tolist(), starts, ends, strict=True):
        by[raw[a:b]].add(h)
    assert all(len(v) == 1 for v in by.values()) and len({min(v) for v in by.values()}) == len(by)


# --- 1: BPE ------------------------------------------------------------------------------------------


def test_bpe(spark):
    path = bpe.public_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rnd = random.Random(1)
    bits = ["'", "s", "'ve", " ", "  ", "\n", "a", "aaaa", "É", "日本", "12", "...", "<|endoftext|>", "<|endof", " ", "\x85", "🙂"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(25))) for _ in range(3000)] + ODD
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    got = {r.doc_id: r for r in bpe.round_trips(rows(spark, texts), path, ids="ids").collect()}
    assert [list(got[i].ids) for i in range(len(texts))] == want
    for i, t in enumerate(texts):
        assert got[i].ids_sha256 == hashlib.sha256(np.array(want[i], "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.decoded(bpe.encoded(clashing(spark, ODD), path), path).collect()
    assert [r.decoded for r in sorted(back, key=lambda r: r.doc_id)] == [t or "" for t in ODD]
    assert bpe.encoded(rows(spark, ["a"]).limit(0), path).count() == 0


def test_long_pieces():
    path = bpe.public_path("byte_bpe_50k.json")
    model, library = bpe.Bpe(path), Tokenizer.from_file(path)
    rnd = random.Random(22)
    texts = ["".join(rnd.choice(letters) for _ in range(n)) for n in (199, 201, 3000, 30_000) for letters in ("ab", "a", "abcdefghijklmnopqrstuvwxyz", "日本語é")]
    texts.append(f"{texts[5]} words between {texts[9]} and {texts[5]}")
    for text, ids in zip(texts, model.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids and model.decode(ids) == text


# --- 2: substring dedup --------------------------------------------------------------------------------


def brute_substrings(docs, width=50):
    first = {}
    split = [(i, WORD.findall((t or "").encode())) for i, t in docs]
    for i, ws in split:
        for k in range(len(ws) - width + 1):
            key = tuple(ws[k : k + width])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, ws in split:
        gone = {k + j for k in range(len(ws) - width + 1) if first[tuple(ws[k : k + width])] < i for j in range(width)}
        out.append((i, len(ws), len(gone), b" ".join(w for k, w in enumerate(ws) if k not in gone).decode()))
    return sorted(out)


def test_cover_meets_every_shift():
    assert {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER} == set(range(substrings.PERIOD))


def test_substrings(spark):
    rnd = random.Random(2)
    passage = [story(rnd, n) for n in (49, 50, 51, 80, 200)]
    texts = [*ODD, *passage, *passage[1:3]]
    for _ in range(60):
        parts = [story(rnd, rnd.randrange(0, 90))]
        for _ in range(rnd.randrange(0, 3)):
            p = rnd.choice(passage).split()
            a = rnd.randrange(0, 20)
            parts += [" ".join(p[a : a + rnd.randrange(30, 200)]), story(rnd, rnd.randrange(0, 40))]
        texts.append(" \n".join(parts))
    texts += [texts[20]] * 5 + ["z " * 120, "z " * 70, "y " + "z " * 60]
    docs = list(enumerate(texts))
    docs += [(7, texts[22]), (30, None), (31, texts[31])]  # ids that stand twice, one with the same text
    rnd.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substrings.deduplicated(df).collect())
    assert got == brute_substrings(docs)
    no_id = spark.createDataFrame([(None, passage[3]), (1, passage[3])], "doc_id long, text string")
    assert [r.n_removed for r in substrings.deduplicated(no_id).collect()] == [0, 0]
    assert substrings.deduplicated(clashing(spark, ODD)).count() == len(ODD)
    assert substrings.deduplicated(rows(spark, ["a"]).limit(0)).count() == 0


# --- 3: near-dedup -------------------------------------------------------------------------------------


def brute_clusters(docs, width):
    sets = {}
    for i, t in docs:
        ws = WORD.findall((t or "").encode().translate(LOWER))
        sets[i] = {tuple(ws[k : k + width]) for k in range(max(1, len(ws) - width + 1))} if ws else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return sorted((i, len(sets[i]), find(i)) for i in ids)


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, width):
    rnd = random.Random(3)
    texts = list(ODD)
    for base in (story(rnd, 120), story(rnd, 40), story(rnd, 300)):
        words = base.split()
        for _ in range(40):  # copies with a few words changed, some close to the limit, and copies of copies
            copy = list(words)
            for _ in range(rnd.randrange(0, len(copy) // (5 * width))):
                copy[rnd.randrange(len(copy))] = f"n{rnd.randrange(50)}"
            texts.append(" ".join(copy).upper() if rnd.random() < 0.1 else " ".join(copy))
            if rnd.random() < 0.2:
                words = copy
    texts += [story(rnd, rnd.randrange(1, 30)) for _ in range(40)]
    docs = list(enumerate(texts))
    rnd.shuffle(docs)
    found = neardup.clusters(spark.createDataFrame(docs, "doc_id long, text string"), width=width).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_clusters(docs, width)


def test_near_duplicates_odd(spark):
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "A b c"), (None, "a b c")], "doc_id long, text string")
    got = [(r.doc_id, r.component_id) for r in neardup.clusters(twice).collect()]
    assert sorted(got, key=str) == [(1, 1), (1, 1), (2, 1), (None, None)]
    kept = neardup.one_of_each(clashing(spark, ODD))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7] and kept.columns == clashing(spark, ODD).columns
    assert neardup.clusters(rows(spark, ["a"]).limit(0)).count() == 0


def test_a_large_group_of_near_copies(spark):
    """Copies at all distances from one text: most are compared with the centre, the others by their rare shingles."""
    rnd = random.Random(25)
    base = story(rnd, 90, 5000).split()
    docs = []
    for i in range(400):
        words = list(base)
        for k in rnd.sample(range(len(words)), rnd.choice([0, 2, 5, 8, 9, 10, 12, 20])):
            words[k] = f"n{rnd.randrange(30)}"
        docs.append((i, " ".join(words)))
    got = neardup.clusters(spark.createDataFrame(docs, "doc_id long, text string"), width=2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_clusters(docs, 2)


def test_one_of_each_without_ids(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "A b c"), (None, "a b c"), (None, "a b c"), (None, None)], "doc_id int, text string")
    kept = neardup.one_of_each(df)
    assert kept.schema == df.schema
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == [(1, "a b c"), (None, "a b c"), (None, "a b c"), (None, None)]


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1064)] + [(5, 5)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {(x, find(x)) for x in list(root) if find(x) != x}
    got = components.components(spark.createDataFrame(edges, "u long, v long"))
    assert {tuple(r) for r in got.collect()} == want


# --- 4: language ---------------------------------------------------------------------------------------


def test_language(spark):
    rnd = random.Random(5)
    parts = {"en": "the ing tion and of er", "de": "der sch ung ein ch ge", "fr": "le eau ment que é les", "es": "el ción ado que ñ los"}
    data = []
    for i in range(400):
        lang = rnd.choice(list(parts))
        text = " ".join("".join(rnd.choice(parts[lang].split()) for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(3, 60)))
        data.append((i, text, lang if rnd.random() < 0.95 else None, lang))
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, truth string")
    model = langid.learn(df.where("doc_id % 4 <> 2"))
    found = langid.predicted(df.select("doc_id", "text", "truth"), model).where("doc_id % 4 = 2").collect()
    assert sum(r.lang_pred == r.truth for r in found) >= 0.97 * len(found)
    assert all(0 <= r.score <= 1 for r in found)
    odd = {r.doc_id: r.lang_pred for r in langid.predicted(clashing(spark, [*ODD, "12 !?"]), model).collect()}
    assert odd[0] == odd[1] == odd[2] == odd[8] == "und" and odd[3] != "und"
    none = langid.learn(df.where("lang is null"))
    assert {r.lang_pred for r in langid.predicted(df.select("doc_id", "text"), none).collect()} == {"und"}
    one = langid.learn(df.where("lang = 'en'"))
    assert {r.lang_pred for r in langid.predicted(df.select("doc_id", "text"), one).collect()} == {"en"}


# --- 5: pages ------------------------------------------------------------------------------------------

PAGES = [
    ("<html><body><nav>menu</nav><article><h1>T &amp; u</h1><p>one<br>two<p>three  four</article><footer>f</footer>", "T & u\none two\nthree four"),
    ("<body><div class='ad box'>buy</div><main><ul><li>a<li>b</ul><div id=comments><p>bad</p></div><pre>x\n y</pre>1 < 2</main>", "a\nb\nx y\n1 < 2"),
    ("<p>bare &lt;p&gt; &#233;&nbsp;x", "bare <p> é x"),
    ("<script>var a='</p>'</script><style>p{}</style><!-- c --><p>ok", "ok"),
    ("<article><table><tr><td>a<td>b</table><aside>no</aside><form>no</form></article>", "a\nb"),
    ("<div hidden>no</div><div style='display: none'>no</div>yes", "yes"),
    ("", ""),
    (None, ""),
    ("just text", "just text"),
    ("<<<>>> </p></div> &am", "<<<>>> &am"),
]


def test_pages(spark):
    df = spark.createDataFrame([(i, "http://h/x", h) for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string").withColumn("text", F.lit("x"))
    got = {r.page_id: (r.text, r.n_chars) for r in pages.extracted(df).collect()}
    assert got == {i: (t, len(t)) for i, (_, t) in enumerate(PAGES)}
    assert pages.extracted(df.limit(0)).count() == 0


def test_templates(spark):
    body = "<div><p>Company news for all readers</p></div><div><p>Own words {0} of page {0}</p></div><p>said twice</p>"
    article = "<article><p>shared paragraph</p><p>own {0}</p><div>press here</div></article>"
    data = [(i, "https://Host.example/a", body.format(i)) for i in range(9)] + [(20 + i, "https://b.example/", article.format(i)) for i in range(9)] + [(40, "http://other.example/", body.format(1))]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in pages.extracted(df).collect()}
    assert got[3] == "Own words 3 of page 3"
    assert got[21] == "shared paragraph\nown 1"
    assert got[40].startswith("Company news")  # a host with one page has no template


def test_templates_need_different_pages(spark):
    page = "<article><p>{0}</p><ul><li>one</ul><div>aside of it</div></article>"
    bare = "<p>first words</p><div><p>second</p></div><p>{0}</p>"
    data = [(i, f"https://mirror/{i}", page.format("same")) for i in range(9)]  # copies of one page
    data += [(20 + i, f"https://bare/{i}", bare.format("same")) for i in range(9)]
    listed = "<article><p>{0}</p><ul><li>shared item</ul><section><p>shared section</p></section><p>" + "x" * 100 + "</article>"
    data += [(40 + i, f"https://lists/{i}", listed.format(i)) for i in range(9)]
    # 30 of 400 pages are below a fifth of them, and not many enough; 60 are
    data += [(100 + i, f"https://large/{i}", f"<article><p>own {i}</p>{'<div>press</div>' if i < 60 else '<div>call</div>' if i < 90 else ''}</article>") for i in range(400)]
    got = {r.page_id: r.text for r in pages.extracted(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert got[3] == "same\none\naside of it"
    assert got[23] == "first words\nsecond\nsame"
    assert got[43] == "3\nshared item\nshared section\n" + "x" * 100
    assert got[110] == "own 10" and got[170] == "own 70\ncall"


def test_templates_against_brute_force(spark):
    rnd = random.Random(21)
    press = [f"press {k} " + story(rnd, 5) for k in range(12)]
    data, parts = [], {}
    for i in range(300):
        host = rnd.choice(["a", "b", "b", "c", "c", "c", "c"])
        divs = [p for p in press if rnd.random() < 0.15] + [f"own {i} " + story(rnd, 30)]
        rnd.shuffle(divs)
        parts[i] = (host, divs)
        data.append((i, None if i % 50 == 0 else f"http://{host}.example/{i}", "<body>" + "".join(f"<div><p>{d}</p></div>" for d in divs)))
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    counts, of_host = collections.Counter(), collections.Counter()
    for i, (host, divs) in parts.items():
        if i % 50:
            of_host[host] += 1
            counts.update((host, d) for d in divs)
    want = {}
    for i, (host, divs) in parts.items():
        pages_of = min(of_host[host], 10 * math.sqrt(of_host[host]))
        gone = lambda d: i % 50 and counts[host, d] >= 5 and 100 * counts[host, d] >= 20 * pages_of and 2 * len(d) < sum(map(len, divs))  # noqa: B023, E731
        want[i] = "\n".join(d for d in divs if not gone(d))
    got = {r.page_id: r.text for r in pages.extracted(df).collect()}
    assert got == want
    whole = {i: pages.main_text(h) for i, _, h in data}  # templates off
    assert sum(got[i] != whole[i] for i in got) > 100


def test_hostile_markup():
    began = time.perf_counter()
    for page in ('<a "' * 250_000, '<a "\'' * 100_000 + "'>", "<b>" * 50_000 + "</i>" * 50_000, "<ul><li>" * 20_000, "<!--" * 100_000):
        pages.main_text(page)
    assert time.perf_counter() - began < 20
    page = '<article><p class="share-price">Apple rose</p><h2 id="related-work">R</h2><math><mi>x</mi></math><article>a reader</article></article><article>b</article>'
    assert pages.main_text(page) == "Apple rose\nR\nx"


def test_page_copies_and_names(spark):
    df = spark.createDataFrame([(1, None, "<p>a"), (1, None, "<p>a"), (1, "x", "<p>b"), (None, "http://h", None)], "page_id long, url string, html string").withColumn("_host", F.lit("x"))
    got = pages.extracted(df.withColumnRenamed("_host", "host_")).collect()
    assert sorted((str(r.page_id), r.text, r.html or "") for r in got) == [("1", "a", "<p>a"), ("1", "a", "<p>a"), ("1", "b", "<p>b"), ("None", "", "")]


def test_unclosed_raw_elements():
    assert pages.main_text("<p>a<svg>b<p>c<iframe>d<svg>e") == "ab\ncde"
    assert pages.main_text("<p>a<svg>no</svg>b<svg>c") == "abc"
    assert pages.main_text("<p>a<script>b<p>c") == "a"


# --- 6: token files ------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 63, 64, 2049, 70_000])
@pytest.mark.parametrize("top", [1, 2, 49_000])
def test_coder(n, top):
    ids = np.random.default_rng(n).integers(0, top, n).astype(np.uint32)
    raw = tokenfiles.pack(ids)
    assert (tokenfiles.unpack(raw) == ids).all()
    if n > 2000 and top > 2:
        with pytest.raises(ValueError, match="checksum"):
            tokenfiles.unpack(raw[:-1] + bytes([raw[-1] ^ 1]))


def test_token_files(spark, tmp_path):
    path = bpe.public_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    rnd = random.Random(6)
    bits = ["'s", "A", "bc", " ", "\n", "É", "日本", "12", "...", "<|endoftext|>", "<|STARTOFTEXT|>", "\x1c", " ", "é", "İ"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(20))) for _ in range(800)] + ODD
    to = str(tmp_path / "ids")
    tokenfiles.write_ids(rows(spark, texts).repartition(7), path, to, segment_tokens=500)
    got = {r.doc_id: r for r in tokenfiles.read_ids(spark, to).collect()}
    start = 0
    for i, t in enumerate(texts):
        want = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        assert np.frombuffer(got[i].ids, "<u4").tolist() == want
        assert (got[i].start, got[i].n_tokens) == (start, len(want))
        start += len(want)
    crcs = {r.doc_id: r.ids_crc32 for r in tokenfiles.read_ids(spark, to, digest=True).collect()}
    assert crcs == {i: zlib.crc32(r.ids) for i, r in got.items()}
    tokenfiles.write_ids(rows(spark, ["a"]).limit(0), path, to + "0")
    assert tokenfiles.read_ids(spark, to + "0").count() == 0


def test_new_words_cost_the_library_little_more_than_their_letters():
    path = bpe.public_path("word_bpe_49k.json")
    ids, sent = tokenfiles.WordIds(path), []

    class Counted:
        def __getattr__(self, name):
            return getattr(library, name)

        def encode_batch_fast(self, texts, **options):
            sent.extend(texts)
            return library.encode_batch_fast(texts, **options)

    library, ids.model = ids.model, Counted()
    rnd = random.Random(62)
    words = ["".join(rnd.choice("abcdefghiéßü") for _ in range(9)) + rnd.choice(["", ",", ".", "###", "42"]) for _ in range(3000)]
    ids.encode([" ".join(words).encode()])
    assert sum(map(len, sent)) <= sum(len(w) + 1 for w in set(words))


@pytest.mark.parametrize("closing", [True, False])
def test_words_of_any_characters_have_the_ids_of_their_text(closing):
    path = bpe.public_path("word_bpe_49k.json")
    library, ids = Tokenizer.from_file(path), tokenfiles.WordIds(path)
    library.no_truncation()
    library.no_padding()
    assert ids.closing is not None
    if not closing:
        ids.closing = None
    rnd = random.Random(63)
    bits = [chr(c) for c in range(1, 0x180)] + ["'s", "'ve", "''", "<|endoftext|>", "<|startoftext|>", "<|", "\u0301", "\u00a0", "\u2028", "²", "Ⅷ", "日本", "İ", "😀", "</w>", "e" * 300]
    texts = ["".join(rnd.choice(bits) + rnd.choice(["", "", " ", "a"]) for _ in range(rnd.randrange(30))) for _ in range(1500)]
    for few in (texts[:700], texts[700:], texts[:50]):
        got, counts = ids.encode([t.encode() for t in few])
        want = [[*library.encode(t, add_special_tokens=False).ids, 1] for t in few]
        assert counts.tolist() == list(map(len, want))
        assert got.tolist() == [k for row in want for k in row]


def test_pieces_are_counted_as_the_pattern_cuts_them():
    pattern = regex.compile(tokenfiles.PIECES["pretokenizers"][0]["pattern"]["Regex"])
    bits = [chr(c) for c in range(33, 0x17F) if c not in range(0x7F, 0xA1)]
    rnd = random.Random(64)
    words = [*bits, *("".join(rnd.choices(bits, k=rnd.randrange(1, 12))) for _ in range(3000)), *("".join(rnd.choices("ab1é×.#", k=rnd.randrange(1, 12))) for _ in range(3000))]
    pieces = tokenfiles.pieces_of([w.encode() for w in words]).tolist()
    assert sum(n > 0 for n in pieces) > 1500
    for w, n in zip(words, pieces, strict=True):
        assert n in (0, len(pattern.findall(w)))
        assert n or any(c in "'×÷" or not (33 <= ord(c) <= 126 or 192 <= ord(c) <= 255) for c in w)


# --- 7: quality ----------------------------------------------------------------------------------------


def test_quality(spark):
    rnd = random.Random(7)
    texts = [*ODD, story(rnd, 60), " ".join("".join(rnd.choice("ABCDEFGHIJ") for _ in range(6)) for _ in range(60)), "a b c " * 30, "x\n" * 60, " | ".join(story(rnd, 60).split()), "a a a b", "a b c a b c d"]
    texts += [" ".join(rnd.choice("abcd") for _ in range(rnd.randrange(3, 40))) + "\n" + story(rnd, 5) for _ in range(60)]
    got = {r.doc_id: r for r in quality.judged(rows(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        tri = collections.Counter(tuple(ws[k : k + 3]) for k in range(len(ws) - 2))
        repeated = {k + j for k in range(len(ws) - 2) if tri[tuple(ws[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
    assert got[8].rejected_by is None and got[9].rejected_by == "shouting" and got[12].rejected_by == "symbols"
    kept = quality.kept_rows(clashing(spark, [*ODD, story(rnd, 80)]))
    assert [r.doc_id for r in kept.collect()] == [8] and kept.columns == clashing(spark, ODD).columns
    assert quality.kept_rows(rows(spark, ["a"]).limit(0)).count() == 0


def test_cascade_order_keeps_the_verdict(spark):
    df = rows(spark, [story(random.Random(8), n) for n in (10, 60, 70)])
    tests = quality.rules()
    back = dict(reversed(tests.items()))
    assert [r.rejected_by is None for r in quality.judged(df, tests=tests).orderBy("doc_id").collect()] == [r.rejected_by is None for r in quality.judged(df, tests=back).orderBy("doc_id").collect()]


# --- 8: token counts -----------------------------------------------------------------------------------


def test_token_counts(spark):
    path = bpe.public_path("piece_bpe_32k.model")
    library = Tokenizer(models.Unigram(unigram.vocabulary(path), unk_id=0, byte_fallback=True))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    rnd = random.Random(9)
    bits = ["the ", " ", "a", "é", "ññ", "\n", "\t", "\0", "日", "▁", "<0x0A>", "and", "tion", "🙂", "zzz", "́"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(25))) for _ in range(2000)] + ODD
    got = {r.doc_id: r.n_tokens for r in unigram.counted(rows(spark, texts), path).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) if t else 0 for i, t in enumerate(texts)}
    assert unigram.counted(clashing(spark, ODD), path).count() == len(ODD)


# --- 9: decontamination --------------------------------------------------------------------------------


def brute_hits(docs, items):
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall((t or "").encode().translate(LOWER))
    windows = collections.defaultdict(set)
    for i, t in items:
        ws = split(t)
        k = min(13, len(ws))
        for a in range(len(ws) - k + 1) if k else ():
            windows[tuple(ws[a : a + k])].add(str(i))
    sizes = {len(w) for w in windows}
    out = []
    for i, t in docs:
        ws, hit, ids = split(t), set(), set()
        for k in sizes:
            for a in range(len(ws) - k + 1):
                if found := windows.get(tuple(ws[a : a + k])):
                    hit |= set(range(a, a + k))
                    ids |= found
        out.append((i, len(ws), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(ws)))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 24, 300])
def test_decontamination(spark, block_bytes):
    rnd = random.Random(10)
    items = [story(rnd, n, 60) for n in (5, 12, 13, 14, 40, 40)] + [None, "", "one", "!!"]
    items.append(items[4])
    texts = [*ODD, *[t or "" for t in items]]
    for _ in range(60):
        parts = [story(rnd, rnd.randrange(0, 200), 60)]
        for _ in range(rnd.randrange(0, 3)):
            p = rnd.choice(items[:6]).split()
            a = rnd.randrange(0, 10)
            parts += [", ".join(p[a : a + rnd.randrange(1, 40)]).upper(), story(rnd, rnd.randrange(0, 30), 60)]
        texts.append("\n".join(parts))
    docs = list(enumerate(texts))
    bench = spark.createDataFrame(list(enumerate(items, 8)), "item_id long, text string")
    got = decontaminate.judged(rows(spark, texts), bench, block_bytes=block_bytes).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got] == brute_hits(docs, list(enumerate(items, 8)))
    kept = decontaminate.clean_rows(clashing(spark, texts), bench)
    assert kept.columns == clashing(spark, texts).columns and kept.count() == sum(not r.contaminated for r in got)
    assert decontaminate.judged(rows(spark, ODD), bench.limit(0)).where("contaminated").count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_items_without_id(spark, kind):
    first, second = story(random.Random(15), 20), story(random.Random(16), 20)
    bench = spark.createDataFrame([(None, first), (7, second), (None, None)], "item_id int, text string").withColumn("item_id", F.col("item_id").cast(kind))
    got = decontaminate.judged(rows(spark, [first + " " + second, first, second, "clean"]), bench).orderBy("doc_id").collect()
    assert [(r.n_hit, list(r["items"]), r.contaminated) for r in got] == [(40, ["7"], True), (20, [], True), (20, ["7"], True), (0, [], False)]


def test_suffix_arrays():
    rnd = np.random.default_rng(23)
    for _ in range(100):
        first = np.append(0, np.cumsum(rnd.integers(0, 30, 4)))
        words = rnd.integers(0, 3, first[-1]).astype(np.uint64)
        array = decontaminate.SuffixArray(words, first)
        suffixes = [tuple(words[i : i + array.room[i]].tolist()) for i in array.order]
        assert suffixes == sorted(suffixes) and sorted(array.order) == list(range(first[-1]))


def test_a_window_of_many_items(spark):
    common = story(random.Random(24), 13)
    bench = spark.createDataFrame([(i, common) for i in range(300)] + [(i, common) for i in range(300)], "item_id int, text string")
    found = decontaminate.judged(rows(spark, [" x ".join([common] * 50), "clean", None]), bench).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, len(r["items"]), r.contaminated) for r in found] == [(699, 650, 300, True), (1, 0, 0, False), (0, 0, 0, False)]


def test_longest_matches(spark):
    text = story(random.Random(11), 30)
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    hits = decontaminate.with_hits(rows(spark, ["before " + text + " after"]), bench).first().hits
    assert [tuple(h) for h in hits] == [(1, 0, 1, 30)]


# --- 10: language model --------------------------------------------------------------------------------


def test_lm(spark):
    rnd = random.Random(12)
    chain = {w: rnd.sample(range(50), 3) for w in range(50)}

    def walk(n):
        w, out = 0, []
        for _ in range(n):
            w = rnd.choice(chain[w])
            out.append(f"T{w}")
        return " ".join(out)

    texts = [walk(rnd.randrange(1, 80)) for _ in range(300)] + ODD
    docs = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    model, counts, pairs = lm.trained(df.where(~lm.held_out(F.col("doc_id"), 5, 1)))
    found = lm.scored(df, model, counts, pairs).collect()
    assert len(found) == len(docs)
    tokens = lambda t: [*WORD.findall((t or "").encode().translate(LOWER)), None]
    seen = collections.Counter(w for i, t in docs if not held(i) for w in tokens(t))
    n, v = sum(seen.values()), len(seen)
    assert (model.n, model.v) == (n, v)
    text_of = dict(docs)
    for r in found:
        ws = tokens(text_of[r.doc_id])
        assert (r.n_tokens, r.n_known) == (len(ws), sum(seen[w] > 0 for w in ws))
        assert r.base_score == pytest.approx(sum(math.log10((seen[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
    out = [r for r in found if held(r.doc_id)]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_lm_classes_sum_to_one(spark):
    model, _, _ = lm.trained(rows(spark, ["a b c a b", "b c"]))
    p = lm.class_shares(np.zeros((1, lm.N_FEATURES), np.int64), model.weights, model.bias)
    assert p.sum() == pytest.approx(1, abs=1e-5)
    empty, counts, pairs = lm.trained(rows(spark, ["a"]).limit(0))
    assert lm.scored(rows(spark, ["a", None]), empty, counts, pairs).count() == 2
    assert lm.scored(rows(spark, ["a"]).limit(0), model, counts, pairs).count() == 0


@pytest.mark.parametrize("hot", [1 << 22, 12])
def test_lm_words_sum_to_one(spark, monkeypatch, hot):
    """After any history the known words, an end and one unknown word of each class have probability one, with frequent and with rare words."""
    monkeypatch.setattr(lm, "HOT", hot)
    monkeypatch.setattr(lm, "HOT_PAIRS", 4)
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice("abcdefghijklmnop") * 2 + "x" for _ in range(rnd.randrange(9))) for _ in range(40)] + ["aax bbx aax bbx ccx"] * 3
    model, counts, pairs = lm.trained(rows(spark, texts))
    history = "aax bbx"
    words = sorted({w for t in texts for w in t.split()})
    asked = [history, *[f"{history} {w}" for w in words]]
    score = {r.doc_id: r.score for r in lm.scored(rows(spark, asked), model, counts, pairs).collect()}
    # score(history word end) = score(history) - log P(end | history) + log P(word | history) + log P(end | history word), so ask for the ends apart
    ends = dict(zip([history, *asked[1:]], [_lm_end(model, pairs, t) for t in asked], strict=True))
    total = 10 ** ends[history] + sum(10 ** (score[i] - score[0] + ends[history] - ends[t]) for i, t in enumerate(asked) if i)
    unknown = sum(_lm_unknown(model, pairs, history, k) for k in range(lm.CLASSES))
    assert total + unknown == pytest.approx(1, abs=1e-4)


def _lm_parts(model, pairs, text, key, k, known_count):
    """(m, pair count, count of the history, P(class)) after a text, computed plainly."""
    import pyarrow as pa

    h, s, first = lm.tokens(pa.RecordBatch.from_pydict({"text": [text]}), "text")
    _, _, _, keys, n = model.places(h, s)
    before, count = model.previous(keys, n, first)
    table = {}
    for r in pairs.collect():
        for x, c in zip(lm._unpacked(bytes(r.h)).tolist(), np.frombuffer(bytes(r.c), np.int64).tolist(), strict=True):
            table[(r.part << 48) | x] = c
    pair = int(model.pair_hashes(before[-1:], np.array([key], np.uint64))[0])
    share = lm.class_shares(lm.feature_rows(h, first)[-1:], model.weights, model.bias)[0, k]
    m = 1 - lm.PAIR_A * count[-1] ** -lm.PAIR_B if count[-1] else 0
    return m, table.get(pair, 0), count[-1], share


def _lm_end(model, pairs, text):
    found = model.known == lm.END
    key = lm.END if found.any() else W.mix(lm.RARE + np.array([lm.END_CLASS], np.uint64))[0]
    m, n, count, share = _lm_parts(model, pairs, text, key, lm.END_CLASS, None)
    room = model.class_n[lm.END_CLASS] + 0.5 * (model.class_v[lm.END_CLASS] + 1)
    c = model.class_n[lm.END_CLASS]
    within = 1 if found.any() else (c + 0.5) / (model.rare_n[lm.END_CLASS] + 0.5 * (model.rare_v[lm.END_CLASS] + 1))
    return math.log10(m * n * within / max(count, 1) + (1 - m) * share * (c + 0.5) / room)


def _lm_unknown(model, pairs, text, k):
    m, n, count, share = _lm_parts(model, pairs, text, W.mix(lm.RARE + np.array([k], np.uint64))[0], k, None)
    room, rare = model.class_n[k] + 0.5 * (model.class_v[k] + 1), model.rare_n[k] + 0.5 * (model.rare_v[k] + 1)
    return m * n * 0.5 / rare / max(count, 1) + (1 - m) * share * 0.5 / room


# --- pipeline ------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(13)
    good = [story(rnd, 120, 5000) for _ in range(6)]
    passage = story(rnd, 60, 5000)
    item = story(rnd, 30, 5000)
    near = good[0].split()
    near[60] = "changed"
    texts = [*good, " ".join(near), good[1], "short", good[2] + " " + passage, story(rnd, 100, 5000) + " " + passage, item, story(rnd, 100, 5000) + " " + item, None]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # 6 is near 0, 7 is 1, 8 and 11 are short, 12 holds the item, 9 keeps its own passage and loses document 2's words
    assert sorted(got) == [0, 1, 2, 3, 4, 5, 9, 10]
    assert got[9].text == passage and got[10].text == " ".join(texts[10].split()[:100])
    library = Tokenizer.from_file(bpe.public_path("byte_bpe_50k.json"))
    for r in got.values():
        assert list(r.ids) == library.encode(r.text, add_special_tokens=False).ids
        assert r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_pipeline_keeps_rows_without_ids(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(14)
    data = [(i, story(rnd, 120, 5000)) for i in (0, 1, None, None)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, story(rnd, 30, 5000))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = [(r.doc_id, r.text) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(data, key=str)
