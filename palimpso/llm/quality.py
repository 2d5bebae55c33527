"""Quality rules as a short-circuit cascade (built-in functions only).

Every rule is a boolean column expression that says "reject".  On a sample the cascade measures
what each rule costs and which rows it rejects, and orders the rules by rejection per cost: the best one first, then
the best on the rows that the first leaves, and so on (equal ones by name).  The verdict is one CASE expression in that order: Spark
evaluates a later branch only for rows that no earlier branch rejected.  The order never changes a verdict, only
the work (and which of several rejecting rules is named).

A rule's cost is the time of evaluating it many times over on each row of the sample, less that of a run with no
rule, per evaluation: launching a job costs more than comparing two numbers, and must not be taken for it.  The base
measures are columns of the result, so every row needs them and they are no rule's cost; what only a rule needs (counts
of letters) is part of that rule.

Words are runs of characters other than space and U+0009 to U+000D.  Base measures of a text:
``n_words``, ``word_chars`` (code points in words), ``n_symbols`` (of ``#*$%&|<>``),
``n_dup_lines`` (lines with a word that equal an earlier line) and ``n_repeat_words`` (words inside
an 8-word window that occurs twice or more in the text).  Windows are compared by 64-bit hash
within one document; no row is exploded, so nothing is shuffled.

Defined results: a null or empty text, or one of separators only, has zero words and fails the
base test; lengths are unbounded; repeated rows are judged one by one; an empty table gives no rows (and the rules stay in
the order in which they are given); extra columns are kept by ``with_measures`` and ``cascade`` unless they bear the
name of a measure, which then replaces them.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = " \t\n\x0b\f\r"
SYMBOLS = "[#*$%&|<>]"
REPEAT_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SAMPLE_ROWS = 2000
#: rows of the sample on which costs are measured, and runs of which the shortest counts
COST_ROWS = 256
TRIES = 3
#: the least seconds that a measured run takes, so that noise is small beside it, and the most evaluations of a rule on a row in it
LEAST_SECONDS = 0.1
MOST_REPEATS = 64
#: seconds an evaluation that a rule is taken to cost at least; what lies below is noise, and rules that cheap are ordered by rejection
LEAST_COST = 1e-6
SEED = 17


def words_of(text: Column) -> Column:
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(SEPARATORS))
    return F.when(F.length(body) == 0, F.array().cast("array<string>")).otherwise(F.split(body, r"[\x20\x09-\x0D]+"))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and give it to ``body``: a one-element array and a lambda."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column, window: int = REPEAT_WINDOW) -> Column:
    """How many words lie in a window of ``window`` words that occurs at least twice."""

    def hashes(w):
        # hashes of 1, 2, 4, ... words, each of two of the size before: a word is hashed once, not once for each window it is in
        def joined(h, width):
            if width == window:
                return h
            step = min(width, window - width)
            return let(F.zip_with(F.slice(h, 1, F.size(h) - step), F.slice(h, step + 1, F.size(h) - step), lambda a, b: F.xxhash64(a, b)), lambda x: joined(x, width + step))

        return let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: joined(h, 1))

    def repeated_starts(h):
        # (hash, position) sorted: a start is repeated if a neighbour has the same hash
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(
            ordered,
            lambda s: F.sort_array(
                F.transform(
                    F.filter(
                        F.transform(s, lambda e, k: F.struct(e["i"].alias("i"), (F.get(s, k - 1)["h"].eqNullSafe(e["h"]) | F.get(s, k + 1)["h"].eqNullSafe(e["h"])).alias("twice"))),
                        lambda e: e["twice"],
                    ),
                    lambda e: e["i"],
                )
            ),
        )

    def covered(starts):
        steps = F.transform(starts, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(starts, k + 1) - p, F.lit(window))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    found = let(hashes(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(repeated_starts(h), covered)))
    return F.when(F.size(words) < window + 1, F.lit(0).cast("long")).otherwise(found)


def with_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the base measures and the columns the rules need."""
    t = F.coalesce(F.col(text), F.lit(""))
    words, lines = (next(f"{name}{k}" for k in range(len(df.columns) + 1) if f"{name}{k}" not in df.columns) for name in ("words", "lines"))
    has_word = F.filter(F.split(t, "\n", -1), lambda line: F.length(F.btrim(line, F.lit(SEPARATORS))) > 0)
    split = df.withColumns({words: words_of(F.col(text)), lines: has_word})
    w = F.col(words)
    measured = split.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(F.array_join(w, "")).cast("long"),
            "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": repeat_words(w),
        }
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measured.withColumn("base_failed", failed).drop(words, lines)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def default_rules(text: str = "text") -> list[Rule]:
    """Rules on top of the base test; thresholds are shares of words, lines or letters."""
    t = F.coalesce(F.col(text), F.lit(""))
    return [
        Rule("word_length", (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 16 * F.col("n_words"))),
        Rule("symbols", 10 * F.col("n_symbols") > F.col("n_words")),
        Rule("dup_lines", (F.col("n_dup_lines") * 10 > F.col("n_lines") * 3) & (F.col("n_dup_lines") >= 3)),
        Rule("shouting", 2 * F.regexp_count(t, F.lit(r"\p{Lu}")) > F.regexp_count(t, F.lit(r"\p{L}"))),
        Rule("letters", 2 * F.regexp_count(t, F.lit(r"\p{L}")) < F.col("word_chars")),
    ]


def rule_costs(sample: DataFrame, rules: list[Rule]) -> list[float]:
    """Seconds that one evaluation of each rule takes, on average over the first ``COST_ROWS`` rows of the sample.

    A run evaluates a rule ``n`` times on every row; ``n`` grows until the run takes long enough to tell it from noise, and
    what the same run takes without a rule is subtracted.
    """
    sample = sample.limit(COST_ROWS).repartition(1).persist()  # one task, so that what is measured is the rule and not how tasks are dealt
    rows = max(1, sample.count())
    copy = next(n for k in range(len(sample.columns) + 1) if (n := f"_again{k}") not in sample.columns)

    def seconds(rule: Column | None, n: int) -> float:
        again = sample.withColumn(copy, F.explode(F.sequence(F.lit(1), F.lit(n))))
        # the count depends on the repeat, so that no plan evaluates the rule once for all of them
        hit = F.lit(True) if rule is None else F.coalesce(rule, F.lit(False))
        run = again.agg(F.sum(F.when(hit, F.col(copy)).otherwise(F.lit(0))))
        least = float("inf")
        for _ in range(TRIES):  # other work on the machine only ever adds time
            began = time.perf_counter()
            run.first()
            least = min(least, time.perf_counter() - began)
        return least

    seconds(None, 1)  # the first job of a kind takes longer
    empty: dict[int, float] = {}
    costs = []
    for rule in rules:
        n = 1
        while True:
            if n not in empty:
                empty[n] = seconds(None, n)
            took = seconds(rule.rejects, n) - empty[n]
            if took >= LEAST_SECONDS or n >= MOST_REPEATS:
                break
            n = min(MOST_REPEATS, n * max(4, min(64, int(LEAST_SECONDS / max(took, 1e-3)))))
        costs.append(max(LEAST_COST, took / (n * rows)))
    sample.unpersist()
    return costs


def order_rules(measured: DataFrame, rules: list[Rule], given: Column | None = None) -> list[Rule]:
    """The rules by rejection per cost, most first, each on the rows that those before it (and ``given``) leave.

    Both are measured on a sample (about ``SAMPLE_ROWS`` rows of the whole table).  A wrong estimate (noise, an odd
    sample) costs time and changes no verdict.  Rules that reject nothing more come last, cheap ones first.
    """
    sample = measured.persist()
    try:
        if not rules or sample.isEmpty():
            return list(rules)
        costs = rule_costs(sample, rules)
        bits = [F.coalesce(r.rejects, F.lit(False)).alias(f"r{k}") for k, r in enumerate(rules)]
        left = sample.filter(~F.coalesce(given, F.lit(False))) if given is not None else sample
        # at most 2^rules kinds of rows
        kinds = [(tuple(r[:-1]), r[-1]) for r in left.select(*bits).groupBy(*[f"r{k}" for k in range(len(rules))]).agg(F.count(F.lit(1))).collect()]
        out, rest = [], list(range(len(rules)))
        while rest:
            gain = {k: sum(n for hit, n in kinds if hit[k]) for k in rest}
            best = min(rest, key=lambda k: (-gain[k] / costs[k], costs[k], rules[k].name))
            out.append(rules[best])
            rest.remove(best)
            kinds = [(hit, n) for hit, n in kinds if not hit[best]]
        return out
    finally:
        sample.unpersist()


def cascade(measured: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``rejected_by`` (the first rule that rejects, null if none) by one short-circuit CASE."""
    verdict = F.when(F.lit(False), F.lit(""))
    for rule in rules:
        verdict = verdict.when(rule.rejects, F.lit(rule.name))
    return measured.withColumn("rejected_by", verdict)


def quality_filter(df: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    rules = default_rules(text) if rules is None else rules
    total = df.count()
    sample = df.sample(fraction=min(1.0, SAMPLE_ROWS / max(1, total)), seed=SEED)
    # the base test comes first, as the contract fixes it, and the others are measured on what it leaves
    base = Rule("base", F.col("base_failed"))
    ordered = order_rules(with_measures(sample, text), rules, base.rejects)
    judged = cascade(with_measures(df, text), [base, *ordered])
    return judged.withColumn("kept", F.col("rejected_by").isNull())


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_filter(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
