"""A training corpus from `documents`: each stage's rows are written as Parquet and read again by the next."""

from __future__ import annotations

from cueforge.llm import bpe, decontaminate, neardup, quality, substrings
from cueforge.llm.store import new_path


def quality_rules(spark, docs, sf_dir):
    """Documents that a quality rule rejects go."""
    return quality.kept_rows(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document of each near-duplicate group stays: shingles of five words, similarity 0.8 or more; rows without an id all stay."""
    return neardup.one_of_each(docs)


def repeated_passages(spark, docs, sf_dir):
    """Words of passages of 50 words or more that an earlier document has go; a document that loses all its words goes."""
    return substrings.deduplicated_rows(docs)


def benchmark_passages(spark, docs, sf_dir):
    """Documents contaminated with benchmark passages go."""
    return decontaminate.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark, docs, sf_dir):
    """What is left, as token ids that decode to the same text."""
    return bpe.round_trips(docs, bpe.public_path("byte_bpe_50k.json"), ids="ids")


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("benchmark passages", benchmark_passages),
    ("token ids", token_ids),
]

#: The last stage's ids can't be expressed in SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
