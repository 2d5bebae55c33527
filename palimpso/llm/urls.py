"""URL filters: a list of host and path rules first, and mined association rules for the rest.

Mining: a URL is a fixed number of tokens (host, its last two and its last label, each word of the
host, first path segment, file ending, names in the query, ...).  Labelled URLs, with
the token ``bad`` where the label says so, go through Spark's FP-growth; itemsets of up to ``MOST_TOKENS`` tokens that imply ``bad``
with enough support, confidence and lift become rules.  A rule has to name the host or the host's own label: language, scheme
or depth by themselves describe half of the web.  A rule is dropped if a part of it is a rule of
no less confidence.  Rules are matched by an inverted index from token to rules: a rule fires when
as many of its tokens were met as it has.  Of several that fire the one with the fewest tokens is named, then the one of
most confidence, then the first by its tokens in order.

Labels: a URL that a listed rule decides has that verdict as its label, so that what the list says about parts of a host
is learned about the host; any other URL has the label of the document that it names, if there is one (low quality or toxic: bad).

The number of tokens of a URL is fixed by their kinds: at most 12, so at most 793 sets of up to four however
long the URL is.  Every rule's tokens are in a share of ``min_support`` of the labelled URLs at least, so there are at most 793 / ``min_support``
rules (396,500 by default) whatever the number of URLs; that bounds what the driver prunes and what goes to every task.

Defined results: null or a URL without ``://`` has empty host and path and the method's verdict;
without labelled URLs no rule is mined and the method allows; repeated rows are judged one by one, and learned as often as
they are there; URLs of any length are read whole; an empty table gives no rows; columns other than id and URL are not read.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.deploy import ship_code
from .common import discard, materialize

BAD = "bad"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.6
MIN_BAD_URLS = 20
#: a rule's confidence over the share of bad ones among all labelled URLs
MIN_LIFT = 1.1
MOST_TOKENS = 4
#: kinds of token of which a rule has one at least
SPECIFIC = ("host:", "label3:")

#: (verdict, host, path)
LISTED = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def listed_rule(host: Column, path: Column, rules=LISTED) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; both null if none does."""
    name, verdict = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = name.when(fits, F.lit(h + p)), verdict.when(fits, F.lit(v))
    return name, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL, each of one of twelve kinds; the scheme counts up to the first ``://``."""
    labels = F.split(host, r"\.")
    own = lambda kind, value: F.when(value.isNotNull() & (value != ""), F.concat(F.lit(kind + ":"), value))
    label = lambda k: F.get(labels, F.size(labels) - k)
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    shape = F.regexp_replace(F.get(segments, F.size(segments) - 1), r"[0-9]+", "0")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    names = F.array_join(F.array_sort(F.array_distinct(F.transform(F.split(query, "&"), lambda q: F.split_part(q, F.lit("="), F.lit(1))))), "&")
    return F.array_distinct(
        F.array_compact(
            F.array(
                own("host", host),
                own("domain", F.when(F.size(labels) > 1, F.concat_ws(".", label(2), label(1)))),
                own("top", label(1)),
                own("label3", label(3)),
                own("label4", label(4)),
                own("first", F.get(segments, 0)),
                own("shape", shape),
                own("ending", F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)),
                own("query", names),
                own("depth", F.least(F.size(segments), F.lit(9)).cast("string")),
                own("scheme", F.split_part(F.coalesce(url, F.lit("")), F.lit("://"), F.lit(1))),
                F.when(F.coalesce(url, F.lit("")).contains("#"), F.lit("fragment")),
            )
        )
    )


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT) -> list[tuple[frozenset[str], float, int]]:
    """Rules (tokens, confidence, how many bad URLs they explain) from ``tokens`` and the boolean ``bad``; the best first."""
    from pyspark.ml.fpm import FPGrowth

    items = labelled.select(F.when(F.col("bad"), F.array_append("tokens", F.lit(BAD))).otherwise(F.col("tokens")).alias("items"))
    n, n_bad = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0))).first()
    if n < MIN_BAD_URLS:
        return []
    least = max(min_confidence, min_lift * n_bad / n)
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, MIN_BAD_URLS / n), minConfidence=min_confidence).fit(items)
    sets = model.freqItemsets.filter(F.size("items") <= MOST_TOKENS + 1)
    names_host = F.exists("tokens", lambda t: F.lit(False) if not SPECIFIC else functools.reduce(lambda a, b: a | b, [t.startswith(k) for k in SPECIFIC]))
    with_bad = sets.filter(F.array_contains("items", BAD) & (F.size("items") > 1)).select(F.array_sort(F.array_remove("items", BAD)).alias("tokens"), F.col("freq").alias("n_bad"))
    without = sets.filter(~F.array_contains("items", BAD)).select(F.array_sort("items").alias("tokens"), "freq")
    found = with_bad.filter(names_host).join(without, "tokens").filter(F.col("n_bad") >= least * F.col("freq"))
    confidence = {frozenset(r["tokens"]): (r["n_bad"] / r["freq"], r["n_bad"]) for r in found.collect()}
    parts = lambda own: (frozenset(x) for k in range(1, len(own)) for x in itertools.combinations(own, k))
    kept = [(own, *c) for own, c in confidence.items() if not any(x in confidence and confidence[x][0] >= c[0] for x in parts(own))]
    return sorted(kept, key=lambda r: (len(r[0]), -r[1], sorted(r[0])))


def match(pages: DataFrame, rules: list[tuple[frozenset[str], float, int]]) -> DataFrame:
    """``pages`` with ``mined`` (the tokens of the first rule that fires, null if none); reads ``tokens``."""
    spark = pages.sparkSession
    ship_code(spark)
    index: dict[str, list[int]] = {}
    for k, (own, _, _) in enumerate(rules):
        for t in own:
            index.setdefault(t, []).append(k)
    shared = spark.sparkContext.broadcast((index, [len(r[0]) for r in rules], [" ".join(sorted(r[0])) for r in rules]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_token, sizes, texts = shared.value
        for batch in batches:
            mined = []
            for own in batch.column("tokens").to_pylist():
                met: dict[int, int] = {}
                for t in own:
                    for k in by_token.get(t, ()):
                        met[k] = met.get(k, 0) + 1
                first = min((k for k, n in met.items() if n == sizes[k]), default=None)
                mined.append(None if first is None else texts[first])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mined, pa.string())], [*batch.schema.names, "mined"])

    return pages.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField("mined", T.StringType())]))


def labelled_urls(pages: DataFrame, labels: DataFrame, url: str = "url") -> DataFrame:
    """URLs that name a labelled document (the first number in their path): ``url``, ``bad`` (low quality or toxic)."""
    doc = F.regexp_extract(path_of(F.col(url)), r"/([0-9]{1,18})(?:[/.]|$)", 1)
    named = pages.select(F.col(url).alias("url"), F.when(doc != "", doc).cast("long").alias("doc")).filter("doc is not null")
    marks = labels.select(F.col("doc_id").alias("doc"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")).filter("doc is not null and bad is not null")
    return named.join(marks.groupBy("doc").agg(F.max("bad").alias("bad")), "doc").select("url", "bad")


def training_urls(pages: DataFrame, labels: DataFrame, url: str = "url", rules=LISTED) -> DataFrame:
    """``url`` and ``bad``: the verdict of the listed rule that decides a URL, or else the label of the document that it names."""
    verdict = listed_rule(host_of(F.col("url")), path_of(F.col("url")), rules)[1]
    listed = pages.select(F.col(url).alias("url")).select("url", (verdict == "block").alias("bad")).filter("bad is not null")
    rest = labelled_urls(pages, labels, url).filter(verdict.isNull())
    return listed.unionByName(rest)


def filter_urls(pages: DataFrame, labels: DataFrame, url: str = "url", key: str = "page_id", rules=LISTED, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``key``, ``host``, ``path``, ``rule``, ``verdict`` and ``mined`` (the mined rule that fired first, of those that no listed rule decides)."""
    parts = lambda c: (host_of(c), path_of(c))
    train = training_urls(pages, labels, url, rules).select(tokens(F.col("url"), *parts(F.col("url"))).alias("tokens"), "bad")
    train = materialize(train, "labelled-urls")
    mined = mine(train, min_support, min_confidence)
    discard(train)
    host, path = parts(F.col(url))
    name, verdict = listed_rule(F.col("host"), F.col("path"), rules)
    out = pages.select(F.col(key).alias(key), host.alias("host"), path.alias("path"), tokens(F.col(url), host, path).alias("tokens"))
    out = match(out, mined).withColumns({"rule": name, "listed": verdict})
    method = F.when(F.col("mined").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return out.select(key, "host", "path", "rule", F.coalesce("listed", method).alias("verdict"), F.when(F.col("listed").isNull(), F.col("mined")).alias("mined"))


def op5(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return filter_urls(pages, labels).select("page_id", "host", "path", "rule", "verdict", "mined")
