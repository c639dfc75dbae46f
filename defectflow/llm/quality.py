"""Quality rules: a short-circuit cascade ordered by rejection per cost.

Each rule is a Boolean column over the text. On a bounded sample from all partitions the cost (seconds over the sample, repeated until launching doesn't matter, without the split into words that they share) and the selectivity (share rejected) of
each rule are measured; the cascade then tests the rules by falling rejection per cost, and CASE WHEN stops at the first that rejects.
The order changes how much work a row takes, never which rows are rejected: a document is kept if no rule rejects it.
Everything is built-in columns: no Python runs on the executors.

Defined results: a null or empty text has no words and is rejected as too short; long texts are read whole; repeated rows each get their row;
an empty table gives an empty result; further columns of the input don't matter, whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectflow.llm.common import let, words

MIN_WORDS = 50
SAMPLE_ROWS = 200
LEAST_SECONDS, MOST_TIMES, RUNS = 0.3, 4096, 3
#: Of longer texts the sample has the beginning, so that it has a bounded size.
SAMPLE_CHARS = 50_000


def n_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^#*$%&|<>]+", "")).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def n_lines(text: Column) -> Column:
    """Lines with a word."""
    return F.size(_lines(text)).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(_lines(text), lambda lines: F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more: sort the windows with their starts, keep those with an equal neighbour."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def count(s: Column) -> Column:
        same = lambda k, h: F.coalesce(F.get(s, k)["h"] == h, F.lit(False))
        repeated = F.filter(s, lambda p, k: same(k - 1, p["h"]) | same(k + 1, p["h"]))
        return F.size(F.array_distinct(F.flatten(F.transform(repeated, lambda p: F.array(p["i"], p["i"] + 1, p["i"] + 2)))))

    return let(placed, count)


def n_repeat_words(w: Column) -> Column:
    """Words in 3-word windows that the text has twice or more, the first included; windows are compared by a 64-bit hash."""
    hashed = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    counted = let(hashed, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h)).otherwise(F.lit(0)))
    return F.when(F.size(w) >= 3, counted).otherwise(F.lit(0)).cast("long")


#: From the text and its words. ``word_chars``: code points in words.
STATISTICS: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda t, w: F.size(w).cast("long"),
    "word_chars": lambda t, w: F.length(F.array_join(w, "")).cast("long"),
    "n_symbols": lambda t, w: n_symbols(t),
    "n_lines": lambda t, w: n_lines(t),
    "n_dup_lines": lambda t, w: n_dup_lines(t),
    "n_repeat_words": lambda t, w: n_repeat_words(w),
}
Statistic = Callable[[str], Column]


@dataclass(frozen=True)
class Rule:
    """``rejects``: from the statistics by name to true (reject) or false, never null."""

    name: str
    rejects: Callable[[Statistic], Column]


#: The two base rules come first; the cascade reorders them all.
RULES: tuple[Rule, ...] = (
    Rule("few_words", lambda s: s("n_words") < MIN_WORDS),
    Rule("repeated_windows", lambda s: 100 * s("n_repeat_words") > 50 * s("n_words")),
    Rule("symbols", lambda s: 10 * s("n_symbols") > s("n_words")),
    Rule("word_length", lambda s: (s("word_chars") < 3 * s("n_words")) | (s("word_chars") > 12 * s("n_words"))),
    Rule("duplicate_lines", lambda s: 2 * s("n_dup_lines") > s("n_lines")),
)


def statistics_of(text: Column, w: Column) -> Statistic:
    """Each statistic as an expression, computed where a rule asks for it."""
    return lambda name: STATISTICS[name](text, w)


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    seconds: float
    rejected: float

    @property
    def rank(self) -> float:
        return self.rejected / max(self.seconds, 1e-7)


def estimate_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Estimate]:
    """Cost and selectivity of each rule on about ``sample_rows`` random rows (the same ones for the same table), best rule first, ties by name.

    A job of so few rows costs its launch, so the sample is repeated until the split into words alone takes ``LEAST_SECONDS``; of ``RUNS`` runs of each rule, after one that compiles, the fastest counts."""
    n_rows = docs.count()
    share = min(1.0, sample_rows / max(n_rows, 1))
    rows = docs.select(F.left("text", F.lit(SAMPLE_CHARS)).alias("text")).sample(fraction=share, seed=7).take(2 * sample_rows)
    if not rows:
        return [Estimate(r, 0.0, 0.0) for r in rules]
    sample, times = docs.sparkSession.createDataFrame(rows, "text string").coalesce(1), 1

    def measured(verdict: Column, runs: int = RUNS) -> tuple[float, int]:
        counted = sample.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(times)))).agg(F.count_if(verdict).alias("n"))
        counted.first()
        seconds = []
        for _ in range(runs):
            began = time.perf_counter()
            n = counted.first()["n"]
            seconds.append(time.perf_counter() - began)
        return min(seconds), n // times

    split = let(words(F.col("text")), lambda w: F.size(w) < 0)
    while (alone := measured(split, 1)[0]) < LEAST_SECONDS and times < MOST_TIMES:
        times *= 4
    found = [(rule, *measured(_verdict(rule))) for rule in rules]
    return sorted((Estimate(rule, max(seconds - alone, 0.0) / times, n / len(rows)) for rule, seconds, n in found), key=lambda e: (-e.rank, e.rule.name))


def _verdict(rule: Rule) -> Column:
    return let(words(F.col("text")), lambda w: rule.rejects(statistics_of(F.col("text"), w)))


def cascade(statistic: Statistic, ordered: Sequence[Rule]) -> Column:
    """Name of the first rule that rejects, null if none does; later rules aren't evaluated."""
    first, *rest = ordered
    out = F.when(first.rejects(statistic), first.name)
    for rule in rest:
        out = out.when(rule.rejects(statistic), rule.name)
    return out


def _ordered(docs: DataFrame, rules: Sequence[Rule], order: Sequence[str] | None) -> list[Rule]:
    return [e.rule for e in estimate_rules(docs, rules)] if order is None else sorted(rules, key=lambda r: list(order).index(r.name))


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES, order: Sequence[str] | None = None) -> DataFrame:
    """The documents that no rule rejects, with their own columns. A statistic is computed only for rows that reach its rule. ``order``: names of the rules, instead of the sample's."""
    ordered = _ordered(docs, rules, order)
    text = F.col("text")
    # let(): a filter may be moved below a column of words, which would then be split anew for each element.
    return docs.where(let(words(text), lambda w: cascade(statistics_of(text, w), ordered)).isNull())


def quality_report(docs: DataFrame, rules: Sequence[Rule] = RULES, order: Sequence[str] | None = None) -> DataFrame:
    """``doc_id``, every statistic, and ``rejected_by``: the name of the cascade's rule that rejects, or null for a kept document.

    Which of several rejecting rules is named depends on the measured order; with a stored ``order`` (as of ``estimate_rules``) reruns agree in that too."""
    ordered = _ordered(docs, rules, order)
    text, w = F.col("text"), F.col("w")
    counted = docs.select("doc_id", "text", words(text).alias("w")).select("doc_id", *(f(text, w).alias(name) for name, f in STATISTICS.items()))
    return counted.withColumn("rejected_by", cascade(F.col, ordered))


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    judged = quality_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ~failed & F.col("rejected_by").isNull()
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"))


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
tri AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
tri2 AS (SELECT r, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g FROM tri),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM tri2) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY r),
s AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words FROM w LEFT JOIN cov USING (r)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (10 * n_symbols > n_words OR word_chars < 3 * n_words OR word_chars > 12 * n_words OR 2 * n_dup_lines > n_lines) AS kept
FROM b
"""
