"""Quality rules: a threshold table compiled into one projection, in built-in functions only.

A null or empty text has no words and fails the base rule. Repeated rows and ties are judged
row by row. Columns of the input other than ``doc_id`` and ``text`` pass through ``apply_rules`` untouched unless
they have the name of a measure, which then wins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP, LOWER, UPPER, table, words

SYMBOLS = "#*$%&|<>"
#: Frequent short words of the four languages.
STOP_WORDS = ("the of and to in that is was de la le les et un une que el los en y der die das und ist von mit").split()
#: measure, least, most (either may be None). Ratios are to words, for lines to lines with a word.
THRESHOLDS = (
    ("mean_word_chars", 2.0, 16.0),
    ("symbol_ratio", None, 0.3),
    ("stop_ratio", 0.005, None),
    ("dup_line_ratio", None, 0.5),
)


def measures(docs: DataFrame) -> DataFrame:
    """Adds the measures that the contract and the thresholds need."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumns({"_w": words(F.col("text")), "_lines": lines})
    n = F.size("_w")
    tail = lambda k: F.slice("_w", F.lit(k + 1), F.greatest(n - k, F.lit(0)))
    out = out.withColumn(
        "_t", F.when(n >= 3, F.sort_array(F.arrays_zip(tail(2).alias("c"), F.slice("_w", F.lit(1), n - 2).alias("a"), F.slice("_w", F.lit(2), n - 2).alias("b"), F.sequence(F.lit(0), n - 3).alias("i"))))
    )
    same = lambda j: (F.get("_t", j)["c"] == F.get("_t", j + 1)["c"]) & (F.get("_t", j)["a"] == F.get("_t", j + 1)["a"]) & (F.get("_t", j)["b"] == F.get("_t", j + 1)["b"])
    twins = F.when(n >= 4, F.filter(F.sequence(F.lit(0), n - 4), same))
    out = out.withColumn("_twins", F.coalesce(twins, F.array().cast("array<int>")))
    at = F.flatten(F.transform("_twins", lambda j: F.array(F.get("_t", j)["i"], F.get("_t", j + 1)["i"])))
    covered = F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))
    found = {
        "n_words": n.cast("long"),
        "word_chars": F.length(F.regexp_replace(text, GAP, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": covered.cast("long"),
        "n_stop_words": F.size(F.filter(F.split(F.translate(text, UPPER, LOWER), GAP), lambda x: x.isin(*STOP_WORDS))).cast("long"),
    }
    # A generator of one row: filters on measures are not pushed below it, where each array would be built anew for every use.
    kept = [out[c] for c in docs.columns if c not in found]
    return out.select(*kept, F.inline(F.array(F.struct(*[v.alias(k) for k, v in found.items()]))))


def verdict(thresholds=THRESHOLDS) -> Column:
    """The threshold table as one boolean expression."""
    ratio = {
        "mean_word_chars": F.col("word_chars") / F.greatest("n_words", F.lit(1)),
        "symbol_ratio": F.col("n_symbols") / F.greatest("n_words", F.lit(1)),
        "stop_ratio": F.col("n_stop_words") / F.greatest("n_words", F.lit(1)),
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
    }
    tests = [t for name, low, high in thresholds for t in ([ratio[name] >= low] if low is not None else []) + ([ratio[name] <= high] if high is not None else [])]
    return reduce(Column.__and__, tests, F.lit(True))


def apply_rules(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    out = measures(docs)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(thresholds))


def op2(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "base_failed", "kept")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
  [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM d),
t AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest([w[k:k+2] FOR k IN range(1, len(w) - 1)]) AS t FROM w),
rep AS (SELECT r, i FROM t QUALIFY count(*) OVER (PARTITION BY r, t) > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, range(3) AS s(k) GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(l) AS n_lines,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
  CAST(len([x FOR x IN w IF list_contains(string_split('STOPS', ' '), translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))]) AS BIGINT) AS n_stop_words
  FROM w LEFT JOIN cov USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, base_failed,
  NOT base_failed AND word_chars / n_words >= 2.0 AND word_chars / n_words <= 16.0 AND n_symbols / n_words <= 0.3
  AND n_stop_words / n_words >= 0.005 AND n_dup_lines / n_lines <= 0.5 AS kept FROM b
""".replace("STOPS", " ".join(STOP_WORDS))
