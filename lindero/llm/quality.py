"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a condition on the text that rejects it. Cost and selectivity of each rule are measured
on a sample of about SAMPLE_ROWS rows drawn over the whole table: the time that it takes beyond a rule
that counts nothing, the least of RUNS runs each, and the share that it rejects. The rules then stand
in one CASE in the order of rejection per cost, so that cheap rules that reject much spare the others;
what a rule counts is computed only if no rule before it has rejected. The verdict is the same in any
order; only first_failed depends on it.

Cases: a null or empty text has no words and is rejected by too_few_words. Very long texts are one
array of words each. Equal rows get equal verdicts. An empty table gives an empty result. Other
columns are kept by filter_documents; a column named like one of ours does not clash, since all
work is done on the column text.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
SAMPLE_ROWS, RUNS = 2000, 3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    whole = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(whole == "", F.array().cast("array<string>")).otherwise(F.split(whole, "[\\x20\\x09-\\x0D]+"))


def count_of(text: Column, chars: str) -> Column:
    """How many characters of text are among chars, none of which has a meaning within brackets."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[{chars}]"))


def lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")


def repeat_words(ws: Column, n: int = 3) -> Column:
    """Words in windows of n that occur twice or more. ws: the words.

    Equal hashes of windows stand together once sorted with their places; the places found twice,
    in order, cover up to n words each, less where the next one begins earlier.
    """

    def sorted_(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = let(pairs, lambda p: F.transform(F.filter(p, lambda x, k: F.coalesce(F.get(p, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"]))
        return let(F.sort_array(again), lambda at: F.aggregate(F.transform(at, lambda x, k: F.least(F.lit(n), F.coalesce(F.get(at, k + 1) - x, F.lit(n)))), F.lit(0), lambda a, b: a + b))

    def found(w: Column) -> Column:
        windows = F.transform(F.slice(w, F.lit(1), F.size(w) - (n - 1)), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, n)]))
        return F.when(F.size(w) < n, F.lit(0)).otherwise(let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(sorted_(h))))

    return let(ws, found)


def counts(text: Column, w: Column) -> dict[str, Column]:
    """What the rules count, by name. w: the words of text."""
    return {
        "n_words": F.size(w),
        "n_repeat_words": repeat_words(w),
        "word_chars": F.length(F.array_join(w, "")),
        "n_chars": F.length(F.coalesce(text, F.lit(""))),
        "n_symbols": count_of(text, SYMBOLS),
        "n_exclamations": count_of(text, "!"),
        "n_digits": count_of(text, "0123456789"),
        "n_lines": F.size(lines(text)),
        "n_dup_lines": let(lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))),
    }


def rules(c: dict[str, Column]) -> dict[str, Column]:
    """Conditions that reject a text, by name, on what is counted."""
    n = c["n_words"]
    return {
        "too_few_words": n < 50,
        "repeated_windows": 100 * c["n_repeat_words"] > 50 * n,
        "symbols": 10 * c["n_symbols"] > n,
        "exclamations": 4 * c["n_exclamations"] > n,
        "duplicate_lines": 100 * c["n_dup_lines"] > 40 * c["n_lines"],
        "long_words": c["word_chars"] > 20 * n,
        "short_words": c["word_chars"] < 2 * n,
        "digits": 100 * c["n_digits"] > 30 * c["n_chars"],
    }


def measured(docs: DataFrame, rows: int = SAMPLE_ROWS) -> dict[str, tuple[float, float]]:
    """Seconds and rejected share of each rule over the sample. Words are cut beforehand, as the cascade has them."""
    every = docs.select("text")
    n = every.count()
    sample = every.sample(min(1.0, rows / max(1, n)), 17).select("text", words(F.col("text")).alias("w")).persist()
    try:
        n = sample.count()

        def seconds(hit: Column) -> tuple[float, int]:
            found, best = 0, float("inf")
            for _ in range(RUNS):
                began = time.perf_counter()
                found = sample.agg(F.count_if(hit)).first()[0]
                best = min(best, time.perf_counter() - began)
            return best, found

        conditions = rules(counts(F.col("text"), F.col("w")))
        idle, _ = seconds(F.length("text") < 0) if n else (0.0, 0)
        out = {}
        for name, hit in conditions.items():
            took, found = seconds(hit) if n else (0.0, 0)
            out[name] = (max(took - idle, 1e-4), found / n if n else 0.0)
        return out
    finally:
        sample.unpersist()


def cascade(conditions: dict[str, Column], figures: dict[str, tuple[float, float]]) -> Column:
    """The name of the first rule that rejects, null if none does."""
    order = sorted(conditions, key=lambda k: (-figures[k][1] / figures[k][0], figures[k][0], k))
    out = F.lit(None).cast("string")
    for name in reversed(order):
        out = F.when(conditions[name], F.lit(name)).otherwise(out)
    return out


def first_failed(text: Column, figures: dict[str, tuple[float, float]]) -> Column:
    """The first rule of the cascade that rejects the text, null if none does. Words are cut once; the rest is counted as the cascade asks for it."""
    return let(words(text), lambda w: cascade(rules(counts(text, w)), figures))


def judged(docs: DataFrame, name: str = "first_failed") -> DataFrame:
    """docs with the first rule in the cascade that rejects each text, null for those to keep."""
    return docs.withColumn(name, first_failed(F.col("text"), measured(docs)))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that no rule rejects, with all their columns."""
    return docs.where(first_failed(F.col("text"), measured(docs)).isNull())


#: What described() reports of every text, so that the cascade need not count it again.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def described(docs: DataFrame) -> DataFrame:
    """doc_id, the counts in REPORTED, and first_failed by the cascade: it takes these counts as they are and counts what else a rule needs only if no rule before it has rejected."""
    text, figures = F.col("text"), measured(docs)

    def found(w: Column) -> Column:
        lazy = counts(text, w)
        return let(F.struct(*[lazy[k].cast("long").alias(k) for k in REPORTED]), lambda c: F.struct(*[c[k].alias(k) for k in REPORTED], cascade(rules(lazy | {k: c[k] for k in REPORTED}), figures).alias("first_failed")))

    return docs.select("doc_id", let(words(text), found).alias("c")).select("doc_id", "c.*")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = described(table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.select("doc_id", *REPORTED, failed.alias("base_failed"), (~failed & F.col("first_failed").isNull()).alias("kept"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
v AS (SELECT doc_id, i, x, lead(x, 1) OVER o AS y, lead(x, 2) OVER o AS z FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x, y, z) AS n FROM v WHERE z IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM c WHERE n > 1) GROUP BY doc_id),
f AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines,
  coalesce(r.n, 0) AS n_repeat_words, length(regexp_replace(t, '[^!]+', '', 'g')) AS n_excl,
  length(regexp_replace(t, '[^0-9]+', '', 'g')) AS n_digits, length(t) AS n_chars
  FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (10 * n_symbols > n_words OR 4 * n_excl > n_words OR 100 * n_dup_lines > 40 * n_lines
    OR word_chars > 20 * n_words OR word_chars < 2 * n_words OR 100 * n_digits > 30 * n_chars) AS kept
FROM b
"""
