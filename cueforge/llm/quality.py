"""Quality rules as a short-circuit cascade of native expressions.

A rule is a boolean Column that is true for text to reject. On a sample, each rule's cost (time beyond
that of splitting the words) and selectivity (share it rejects) are estimated; the cascade evaluates the rules by
falling rejection per cost. Each measure is computed where a rule asks for it, so a row that one rule rejects pays for
none after it. The order changes only the work done, never which rows are kept.

Nulls and empty texts have no words, so they fail the length rule. Whole texts are measured, however long; repeated rows
get the same verdict each, and an empty table gives no rows. Extra columns pass through; the columns that this operator
adds replace columns of the same name.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOL_PERCENT = 30
UPPER_PERCENT = 40
DUP_LINE_PERCENT = 60
#: Rows of the sample on which cost and selectivity are estimated, how often each is evaluated in a timed run, and the runs of each rule.
SAMPLE_ROWS, TIMES, RUNS = 500, 4, 2


def let(value: Column, then) -> Column:
    """then(value) with the value computed once."""
    return F.transform(F.array(value), then)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more, the first included."""
    n = F.size(words)
    windows = F.transform(
        F.arrays_zip(F.slice(words, 1, n - 2).alias("a"), F.slice(words, 2, n - 2).alias("b"), F.slice(words, 3, n - 2).alias("c")),
        lambda z: F.xxhash64(z),
    )

    def covered(hashes: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            m = F.size(s)
            same = F.zip_with(F.slice(s, 1, m - 1), F.slice(s, 2, m - 1), lambda x, y: x["h"] == y["h"])
            marked = let(same, lambda e: F.arrays_zip(s.alias("s"), F.concat(F.array(F.lit(False)), e).alias("b"), F.concat(e, F.array(F.lit(False))).alias("a")))
            at = F.array_sort(F.transform(F.filter(marked, lambda z: z["b"] | z["a"]), lambda z: z["s"]["p"]))
            return let(
                at,
                lambda p: F.aggregate(
                    F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda x, y: F.least(F.lit(3), y - x)),
                    F.lit(3).cast("long"),
                    lambda total, d: total + d,
                ),
            )

        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(F.array_sort(pairs), of_sorted))

    return F.when(n < 4, F.lit(0).cast("long")).otherwise(let(windows, covered))


def lines_of(body: Column) -> Column:
    return F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def lazy_measures(body: Column, words: Column) -> dict[str, Column]:
    """What the rules look at, each an expression of its own."""
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)).cast("long"),
        "n_lines": F.size(lines_of(body)).cast("long"),
        "n_dup_lines": let(lines_of(body), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        "n_repeat_words": repeat_words(words),
        "n_upper": F.regexp_count(body, F.lit(r"\p{Lu}")).cast("long"),
    }


#: The measures that the report has.
REPORTED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows with the REPORTED measures."""
    body = F.coalesce(F.col(text), F.lit(""))
    found = lazy_measures(body, F.col("__words"))
    return df.withColumn("__words", words_of(body)).withColumns({c: found[c] for c in REPORTED}).drop("__words")


def rules() -> dict:
    """Name and rejection test of each rule, a function of the measures."""
    return {
        "short": lambda m: m["n_words"] < MIN_WORDS,
        "repeats": lambda m: 100 * m["n_repeat_words"] > REPEAT_PERCENT * m["n_words"],
        "symbols": lambda m: 100 * m["n_symbols"] > SYMBOL_PERCENT * m["n_words"],
        "shouting": lambda m: 100 * m["n_upper"] > UPPER_PERCENT * m["word_chars"],
        "same_lines": lambda m: 100 * m["n_dup_lines"] > DUP_LINE_PERCENT * m["n_lines"],
    }


def ranked(df: DataFrame, tests: dict, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, seconds on the sample beyond the splitting of words, share rejected), by falling rejection per cost."""
    total = df.count()
    if not total:
        return [(name, 0.0, 0.0) for name in tests]
    body = F.coalesce(F.col(text), F.lit(""))
    sample = df.select(text).sample(min(1.0, sample_rows / total), seed=7).persist()
    rows = sample.count()
    often = sample.select(text, F.explode(F.sequence(F.lit(1), F.lit(TIMES))).alias("__k"))

    def timed(test):
        verdict = let(words_of(body), lambda ws: test(lazy_measures(body, ws)))
        job = often.agg(F.count_if(verdict))
        best, rejected = None, 0
        for _ in range(RUNS):
            began = time.perf_counter()
            rejected = job.first()[0]
            spent = time.perf_counter() - began
            best = spent if best is None else min(best, spent)
        return best, (rejected or 0) / max(rows * TIMES, 1)

    idle, _ = timed(lambda m: m["n_words"] < 0)
    found = [(name, max(spent - idle, 0.001), share) for name, (spent, share) in ((name, timed(test)) for name, test in tests.items())]
    sample.unpersist()
    return sorted(found, key=lambda x: -x[2] / x[1])


def cascade(order: list[str], tests: dict, m: dict[str, Column]) -> Column:
    """The first rule in the order that rejects the text, else null."""
    found = F.when(F.lit(False), F.lit(""))
    for name in order:
        found = found.when(tests[name](m), F.lit(name))
    return found


def order_of(df: DataFrame, tests: dict, text: str) -> list[str]:
    return [name for name, _, _ in ranked(df, tests, text)]


def judged(df: DataFrame, text: str = "text", tests: dict | None = None) -> DataFrame:
    """The rows with the REPORTED measures and `rejected_by`: the first rule of the cascade that rejects the text, else null."""
    tests = tests or rules()
    order = order_of(df, tests, text)
    body = F.coalesce(F.col(text), F.lit(""))
    m = lazy_measures(body, words_of(body)) | {c: F.col(c) for c in REPORTED}
    return measures(df, text).withColumn("rejected_by", cascade(order, tests, m))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    m = {c: F.col(c) for c in REPORTED}
    failed = rules()["short"](m) | rules()["repeats"](m)
    return judged(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"),
    )


def kept_rows(df: DataFrame, text: str = "text", tests: dict | None = None) -> DataFrame:
    """The rows that no rule rejects, with their own columns only."""
    tests = tests or rules()
    order = order_of(df, tests, text)
    body = F.coalesce(F.col(text), F.lit(""))
    return df.where(let(words_of(body), lambda ws: cascade(order, tests, lazy_measures(body, ws))).isNull())


#: The same rows in DuckDB SQL; {docs} is the table to judge.
MEASURES_SQL = r"""
w AS (SELECT doc_id, coalesce(text, '') AS body,
        list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
      FROM {docs}),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS tri
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
r AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM
        (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, tri) AS c FROM g) x, (VALUES (0), (1), (2)) v(d)
      WHERE c >= 2 GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
        CAST(length(body) - length(regexp_replace(body, '\p{Lu}', '', 'g')) AS BIGINT) AS n_upper
      FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
q AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 30 * n_words
             OR 100 * n_upper > 40 * word_chars OR 100 * n_dup_lines > 60 * n_lines) AS kept FROM m)
"""
OP7_SQL = (
    "WITH " + MEASURES_SQL.replace("{docs}", "documents")
    + " SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM q"
)
