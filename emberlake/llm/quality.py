"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Nulls: a null text has no words and fails the word minimum. Empty and all-space texts likewise.
Texts of any length are judged as a whole. Rows are judged one by one, so repeated rows get equal
verdicts. Input columns named like a measure or a verdict are replaced; all others pass through.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.llm.common import SPACES, text_of, with_columns, words_of
from emberlake.operators.grid import computed

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be but by for from have he in is it not of on or that the their they this to was with",
    "auch auf das dem den der des die ein eine für ich ist mit nicht sich sie und von zu",
    "au aux ce dans des du elle est et il la le les ne par pas pour que qui sur un une",
    "al como con de del el en es las lo los más no para por se su una y",
)
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """``low <= measure <= high``, either end left open by None. Per word unless ``per`` says otherwise."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    per: str | None = None


# Symbols and shouts are counted per word, repeated lines per line.
RULES = (
    Rule("mean_word_length", "word_chars", 2.0, 25.0, "n_words"),
    Rule("symbol_ratio", "n_symbols", None, 0.1, "n_words"),
    Rule("shout_ratio", "n_shouts", None, 0.1, "n_words"),
    Rule("stop_word_ratio", "n_stop_words", 0.02, None, "n_words"),
    Rule("short_line_ratio", "n_short_lines", None, 0.9, "n_lines"),
    Rule("repeated_line_ratio", "n_dup_lines", None, 0.5, "n_lines"),
)

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_shouts", "n_stop_words", "n_lines", "n_short_lines",
)


def _repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window found at least twice.

    Hashes only show that all windows differ; where they do not, the windows themselves are sorted
    and neighbours compared.
    """
    starts = F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0)))
    hashes = F.transform(starts, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    windows = F.sort_array(
        F.transform(
            starts,
            lambda w, i: F.struct(
                F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)).alias("g"), i.alias("at")
            ),
        )
    )

    def twice(sorted_windows):
        return F.transform(
            F.filter(
                sorted_windows,
                lambda x, j: F.coalesce(x["g"] == F.get(sorted_windows, j - 1)["g"], F.lit(False))
                | F.coalesce(x["g"] == F.get(sorted_windows, j + 1)["g"], F.lit(False)),
            ),
            lambda x: x["at"],
        )

    covered = F.aggregate(
        # one-element array: binds the sorted windows once instead of once per element
        F.sort_array(F.flatten(F.transform(F.array(windows), twice))),
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, at: F.struct(at.alias("last"), (acc["n"] + F.least(F.lit(3), at - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    return F.when(
        F.exists(F.array(hashes), lambda h: F.size(F.array_distinct(h)) < F.size(h)), covered
    ).otherwise(F.lit(0).cast("long"))


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the measures, all of type long."""
    stop = sorted({w for line in STOP_WORDS for w in line.split()})
    body = text_of(text)
    full = F.filter(F.split(body, "\n"), lambda x: F.length(F.regexp_replace(x, SPACES, "")) > 0)
    # a filter on a measure must not pull the splitting into its lambdas
    df = computed(df, __words=words_of(body), __full=full, __body=body)
    words, lines, body = F.col("__words"), F.col("__full"), F.col("__body")
    measures = {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": _repeat_words(words),
        "n_shouts": F.regexp_count(body, F.lit("!")),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(stop))),
        "n_lines": F.size(lines),
        "n_short_lines": F.size(F.filter(lines, lambda x: F.length(x) < 20)),
    }
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in MEASURES and c not in ("__words", "__full", "__body")]
    found = F.struct(*[v.cast("long").alias(k) for k, v in measures.items()])
    return df.select(*kept, F.inline(F.array(found)))


def compiled(rules=RULES) -> Column:
    """One boolean column for the whole table of thresholds; ratios over nothing pass."""

    def holds(rule: Rule) -> Column:
        value = F.col(rule.measure).cast("double")
        if rule.per:
            value = F.when(F.col(rule.per) > 0, value / F.col(rule.per))
        ends = []
        if rule.low is not None:
            ends.append(value >= F.lit(float(rule.low)))
        if rule.high is not None:
            ends.append(value <= F.lit(float(rule.high)))
        return F.coalesce(reduce(Column.__and__, ends, F.lit(True)), F.lit(True))

    return reduce(Column.__and__, map(holds, rules), F.lit(True))


def judged(df: DataFrame, text: str = "text", rules=RULES, min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """Add the measures, ``base_failed`` and ``kept``.

    A text fails the base test with fewer than ``min_words`` words or with more than ``max_repeat``
    percent of its words in repeated windows.
    """
    df = measured(df, text)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    df = with_columns(df, base_failed=failed)
    return with_columns(df, kept=~F.col("base_failed") & compiled(rules))


def kept_rows(df: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows that pass, with their own columns only."""
    return judged(df.select("*", F.struct("*").alias("__row")), text, **options).where("kept").select("__row.*")


# SQL over table ``documents`` with the same measures and verdict.
SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws,
        [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS lines FROM d),
p AS (SELECT doc_id, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM w),
t AS (SELECT doc_id, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM t WHERE c IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS pos FROM g WHERE n > 1) GROUP BY 1),
m AS (SELECT doc_id, len(ws) AS n_words, len(array_to_string(ws, '')) AS word_chars,
        len(regexp_extract_all(text, '{SYMBOLS}')) AS n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
        len(regexp_extract_all(text, '!')) AS n_shouts,
        len([x for x in ws if lower(x) IN ({', '.join(repr(w) for w in sorted({w for line in STOP_WORDS for w in line.split()}))})]) AS n_stop_words,
        len(lines) AS n_lines, len([x for x in lines if len(x) < 20]) AS n_short_lines
      FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words >= 2.0 AND word_chars / n_words <= 25.0 AND n_symbols / n_words <= 0.1
    AND n_shouts / n_words <= 0.1 AND n_stop_words / n_words >= 0.02
    AND n_short_lines / n_lines <= 0.9 AND n_dup_lines / n_lines <= 0.5 AS kept
FROM b"""
