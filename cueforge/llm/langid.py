"""Language identification in two steps: the family first, then the language within it.

Features are hashed byte n-grams of the whole lower-cased text, as square roots of their shares, so every text
has length 1. One-versus-rest linear support vector machines choose the family; one-versus-one machines of the
chosen family's languages vote for the language. All machines learn from one bounded sample: about PER_LANGUAGE
rows of each language chosen by hash, whole and in FRAGMENTS shorter pieces each, so training holds at most
languages * PER_LANGUAGE rows whatever the corpus. Every machine is trained in a task of its own.

A language that FAMILIES does not list is a family of its own. Null texts and texts without a letter give `und`
with score 0. Without labelled rows every text is `und`. Extra columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W

DIMENSIONS = 4096
ORDERS = (1, 2, 3, 4)
PER_LANGUAGE = 250
FRAGMENTS = (4, 12, 30)
STEPS = 200
PENALTY = 1e-5
ROWS_AT_ONCE = 512

# Families of languages by code.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is", "af"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"],
    "chinese": ["zh"],
    "japanese": ["ja"],
    "korean": ["ko"],
    "vietic": ["vi"],
}


def family_of(lang: str) -> str:
    return next((name for name, langs in FAMILIES.items() if lang in langs), f"only {lang}")


def features(texts: pa.Array) -> np.ndarray:
    """One row for each text; at most ROWS_AT_ONCE texts should be given at a time."""
    data, offsets = W.text_bytes(pa.compute.utf8_lower(texts.cast(pa.string())))
    n = len(offsets) - 1
    letters = data.copy()
    letters[(data < 97) | ((data > 122) & (data < 128))] = 32
    row = np.repeat(np.arange(n), np.diff(offsets))
    code = np.zeros(len(data), np.uint64)
    out = np.zeros(n * DIMENSIONS, np.float64)
    for order in range(1, max(ORDERS) + 1):
        # the n-gram that ends here; at a text's start it is shorter
        shifted = np.zeros(len(data), np.uint64)
        shifted[1:] = code[:-1]
        starts = offsets[:-1][np.diff(offsets) > 0]
        shifted[starts] = 0
        code = shifted * np.uint64(257) + letters.astype(np.uint64) + np.uint64(1)
        if order in ORDERS:
            bucket = (W.mix(code + np.uint64(order << 40)) >> np.uint64(52)).astype(np.int64)
            out += np.bincount(row * DIMENSIONS + bucket, minlength=n * DIMENSIONS)
    out = out.reshape(n, DIMENSIONS)
    total = out.sum(axis=1, keepdims=True)
    return np.sqrt(out / np.maximum(total, 1)).astype(np.float32)


def machine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias of a linear support vector machine with squared hinge loss; y is 1 or -1, both sides weigh the same."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w = ahead = np.zeros(x.shape[1], np.float32)
    for t in range(STEPS):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        step = ahead - 0.25 * (PENALTY * ahead - 2 * ((weight * y * slack) @ x))
        w, ahead = step, step + np.float32(t / (t + 3)) * (step - w)
    return w


def learn(labelled: DataFrame, lang: str = "lang", text: str = "text", id_col: str = "doc_id") -> dict:
    """The machines: {(kind, a, b): weights}."""
    counts = {r[0]: r[1] for r in labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).groupBy(lang).count().collect()}
    langs = sorted(counts)
    families = sorted({family_of(x) for x in langs})
    if len(langs) < 2:
        return {"langs": langs, "families": families, "machines": {}}
    slots = 1 << 30
    share = F.create_map(*[F.lit(v) for x in langs for v in (x, min(slots, slots * PER_LANGUAGE // counts[x] + 1))])
    sample = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).where(F.pmod(F.xxhash64(id_col, text), F.lit(slots)) < share[F.col(lang)])
    tasks = {x: [] for x in langs}
    for x in langs:
        if len(families) > 1:
            tasks[x] += [f"family|{f}|" for f in families]
        tasks[x] += [f"pair|{a}|{b}" for a in langs for b in langs if a < b and family_of(a) == family_of(b) and x in (a, b)]
    machines = F.create_map(*[v for x in langs for v in (F.lit(x), F.array(*[F.lit(t) for t in tasks[x]]).cast("array<string>"))])
    rows = sample.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.explode(machines[F.col(lang)]).alias("machine"))

    def train(key, rows):
        kind, a, _ = key[0].split("|")
        rows = rows.sort_values(["lang", "text"])
        texts, labels = [], []
        for own, body in zip(rows["lang"], rows["text"], strict=True):
            words = body.split()
            pieces = [body, *[" ".join(words[len(words) // 3 :][:k]) for k in FRAGMENTS if len(words) > k]]
            texts += pieces
            labels += [1 if (family_of(own) if kind == "family" else own) == a else -1] * len(pieces)
        x = np.concatenate([features(pa.array(texts[k : k + ROWS_AT_ONCE])) for k in range(0, len(texts), ROWS_AT_ONCE)])
        import pandas as pd

        return pd.DataFrame({"machine": [key[0]], "w": [machine(x, np.array(labels, np.float32)).tolist()]})

    found = rows.groupBy("machine").applyInPandas(train, "machine string, w array<float>").collect()
    return {"langs": langs, "families": families, "machines": {r["machine"]: np.array(r["w"], np.float32) for r in found}}


def _squash(x):
    return 1 / (1 + np.exp(-4 * x))


def predicted(df: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """The rows with lang_pred and score."""
    kept = [c for c in df.columns if c not in ("lang_pred", "score")]
    schema = df.select(*kept).schema.simpleString()[7:-1]
    shared = df.sparkSession.sparkContext.broadcast(model)
    known = bool(model["langs"])

    def predict(batches):
        model = shared.value
        langs, families, machines = model["langs"], model["families"], model["machines"]
        with_bias = lambda names: np.stack([machines[m] for m in names], axis=1)
        for big in W.slices(batches, text):
            for at in range(0, big.num_rows, ROWS_AT_ONCE):
                batch = big.slice(at, ROWS_AT_ONCE)
                n = batch.num_rows
                x = features(batch.column(text))
                family, sure = np.zeros(n, np.int64), np.ones(n)
                if len(families) > 1:
                    w = with_bias([f"family|{f}|" for f in families])
                    margins = x @ w[:-1] + w[-1]
                    family, sure = margins.argmax(axis=1), _squash(margins.max(axis=1))
                best = np.zeros(n, np.int64)
                for f, name in enumerate(families):
                    own = [k for k, lang in enumerate(langs) if family_of(lang) == name]
                    rows = np.flatnonzero(family == f)
                    best[rows] = own[0]
                    pairs = [(a, b) for a in own for b in own if a < b]
                    if pairs and len(rows):
                        w = with_bias([f"pair|{langs[a]}|{langs[b]}" for a, b in pairs])
                        margins = x[rows] @ w[:-1] + w[-1]
                        votes = np.zeros((len(rows), len(langs)))
                        for k, (a, b) in enumerate(pairs):
                            p = _squash(margins[:, k])
                            # whole votes, and the margins to break ties
                            votes[:, a] += (margins[:, k] >= 0) + 0.01 * p
                            votes[:, b] += (margins[:, k] < 0) + 0.01 * (1 - p)
                        best[rows] = votes.argmax(axis=1)
                        sure[rows] *= votes.max(axis=1) / (1.01 * (len(own) - 1))
                columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.array(langs, object)[best], pa.string()), pa.array(np.clip(sure, 0, 1).astype(np.float64))], names=[*kept, "lang_pred", "score"])

    no_letter = F.col(text).isNull() | ~F.col(text).rlike(r"\p{L}")
    if not known:
        return df.select(*kept, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    out = df.select(*kept).mapInArrow(predict, f"{schema}, lang_pred string, score double")
    return out.withColumns({"lang_pred": F.when(no_letter, "und").otherwise(F.col("lang_pred")), "score": F.when(no_letter, 0.0).otherwise(F.col("score"))})


def held_out(id_col: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves `part` modulo `parts`; a null id is never held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % parts == part, F.lit(False))


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = held_out(F.col("doc_id"), 4, 2)
    model = learn(docs.where(~out).select("doc_id", "text", "lang"))
    found = predicted(docs.select("doc_id", "text"), model)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")
