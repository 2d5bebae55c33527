"""Dictionary hints: which defined terms a question touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import settle

HIT, SIGNAL, EXACT, LEXICAL, DENSE = 0.55, 0.08, 0.12, 0.20, 0.70
FLOOR = 0.42
MAX_HINTS, PER_GROUP = 3, 3

#: names and signals up to this many are sent to every task (they are counted), and runs of words are not shuffled
BROADCAST_PHRASES = 200_000

#: Fixed spellings, replaced in this order.
SPELLINGS = {"shoppe": "shopee", "tik tok": "tiktok", "tiktokshop": "tiktok shop", "lazadaa": "lazada"}


def fold(text: Column) -> Column:
    """Lower case, usual spellings of four names, single blanks; digits and Latin letters (with the marks of the language) only."""
    out = F.lower(text)
    for said, meant in SPELLINGS.items():
        out = F.replace(out, F.lit(said), F.lit(meant))
    return F.trim(F.regexp_replace(out, r"[^0-9a-zA-Z\u00c0-\u024f\u1e00-\u1eff]+", " "))


def _grams(words: Column, length: int) -> Column:
    """The runs of ``length`` words, each once; ``words`` is a column and no expression, as every run reads it."""
    if length == 1:
        return F.array_distinct(words)
    run = lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(length)]) if length < 8 else F.array_join(F.slice(words, i + 1, F.lit(length)), " ")
    return F.when(F.size(words) >= length, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(words) - length), run))).otherwise(F.array().cast("array<string>"))


def hints(questions: DataFrame, entries: DataFrame, dense: DataFrame | None = None, lexical: DataFrame | None = None, limit: int = MAX_HINTS, per_group: int = PER_GROUP) -> DataFrame:
    """Up to three entries a question: ``question_id``, ``legal_term``, ``score``, ``rank``.

    ``entries`` has ``legal_term``, ``aliases``, ``strong_signals``, ``negative_signals``, ``ambiguity_group``; ``dense`` and
    ``lexical`` have scores from 0 to 1 by ``question_id`` and ``legal_term``.

    A question is cut into its runs of words, of the lengths that names and signals have, and each run looked up by an equality
    join: a question is walked through once for each length, whatever the number of entries, and meets only what it says.  An
    entry that a question neither names nor signals nor has a score for can't reach the floor.  Entries alike in every column count once.
    """
    none = F.array().cast("array<string>")
    q = questions.select("question_id", fold(F.col("text")).alias("q"))
    names = F.array_distinct(F.transform(F.concat(F.array("legal_term"), F.coalesce("aliases", none)), fold))
    signals = lambda c: F.transform(F.coalesce(c, none), fold)
    e = entries.select("legal_term", F.coalesce("ambiguity_group", "legal_term").alias("grp"), names.alias("name"), signals("strong_signals").alias("pro"), signals("negative_signals").alias("con"))
    e = e.withColumn("entry", F.md5(F.to_json(F.struct("legal_term", "grp", "name", "pro", "con"), {"ignoreNullFields": "false"}))).dropDuplicates(["entry"])
    phrases = None
    for role in ("name", "pro", "con"):
        one = e.select("entry", "legal_term", "grp", F.lit(role).alias("role"), F.explode(role).alias("gram"))
        phrases = one if phrases is None else phrases.unionByName(one)
    phrases = settle(phrases.filter("gram is not null").groupBy("entry", "legal_term", "grp", "role", "gram").agg(F.count(F.lit(1)).alias("times")))
    lengths = sorted(r["n"] for r in phrases.select(F.size(F.split("gram", " ")).alias("n")).distinct().collect())  # numbers of words of a phrase
    grams = F.transform(F.array(F.split("q", " ")), lambda w: F.flatten(F.array(*[_grams(w, n) for n in lengths]) if lengths else F.array(none)))
    # only the run goes on to be looked up, not the question with each of its runs
    said = q.filter("q is not null").select("question_id", "q", F.explode(grams[0]).alias("gram")).select("question_id", "gram", (F.col("gram") == F.col("q")).alias("whole"))
    few = phrases.limit(BROADCAST_PHRASES + 1).count() <= BROADCAST_PHRASES
    met = said.join(F.broadcast(phrases) if few else phrases, "gram").select("question_id", "entry", "legal_term", "grp", "role", "times", "whole")
    if scored := [t.select("question_id", "legal_term") for t in (dense, lexical) if t is not None]:
        pairs = scored[0] if len(scored) == 1 else scored[0].unionByName(scored[1])
        by_score = pairs.distinct().join(q.filter("q is not null").select("question_id"), "question_id", "left_semi").join(e.select("entry", "legal_term", "grp"), "legal_term")
        met = met.unionByName(by_score.select("question_id", "entry", "legal_term", "grp", F.lit("score").alias("role"), F.lit(0).cast("long").alias("times"), F.lit(False).alias("whole")))
    count = lambda role: F.coalesce(F.sum(F.when(F.col("role") == role, F.col("times"))), F.lit(0))
    own = met.groupBy("question_id", "entry", "legal_term", "grp").agg(
        (count("name") > 0).cast("int").alias("hit"), F.max(((F.col("role") == "name") & F.col("whole")).cast("int")).alias("exact"), (count("pro") - count("con")).alias("signals")
    )
    for name, table in (("dense", dense), ("lexical", lexical)):
        own = own.join(table.select("question_id", "legal_term", F.col("score").alias(name)), ["question_id", "legal_term"], "left") if table is not None else own.withColumn(name, F.lit(0.0))
    total = HIT * F.col("hit") + SIGNAL * F.col("signals") + EXACT * F.col("exact") + LEXICAL * F.coalesce("lexical", F.lit(0.0)) + DENSE * F.coalesce("dense", F.lit(0.0))
    scored = own.withColumn("score", F.least(F.lit(1.0), total)).filter(F.col("score") >= FLOOR)
    best = lambda *by: F.row_number().over(Window.partitionBy("question_id", *by).orderBy(F.desc("score"), "legal_term"))
    return scored.withColumn("_g", best("grp")).filter(F.col("_g") <= per_group).withColumn("rank", best()).filter(F.col("rank") <= limit).select("question_id", "legal_term", "score", "rank")
