"""Dates, temporal scopes and validity intervals as column expressions.

A scope is a struct (``schemas.SCOPE``); it compiles to a closed range of days.  A validity interval
is half-open: ``[valid_from, valid_to)``, a null end is open, an empty or inverted one holds no day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARLIEST = "0001-01-01"
LATEST = "9999-12-31"
POINT_TYPES = ("current", "exact_date")
TYPES = ("current", "exact_date", "month", "year", "date_range", "comparison")


def lenient_date(text: Column) -> Column:
    """The date in the first ten characters, or null."""
    return F.try_to_date(F.substring(text.cast("string"), 1, 10), "yyyy-MM-dd")


def strict_date(text: Column, name: str) -> Column:
    value = F.when(F.trim(text).rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(F.trim(text), "yyyy-M-d"))
    return F.coalesce(value, F.raise_error(F.concat(F.lit(f"{name} must be a date: "), F.coalesce(text, F.lit("null")))).cast("date"))


def _day(year: Column, month: Column, day: int) -> Column:
    text = F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), F.lit(day))
    return F.when(year.isNotNull() & month.isNotNull(), F.try_to_date(text, "yyyy-MM-dd"))


def boundary_date(boundary: Column, side: str, as_of: Column) -> Column:
    """First day of a boundary on side ``from``, last day on side ``to``."""
    kind, raw = F.lower(F.trim(boundary["granularity"])), F.lower(F.trim(boundary["value"]))
    fail = lambda why: F.raise_error(F.concat(F.lit(f"{why} on side {side}: "), F.coalesce(raw, F.lit("null")))).cast("date")
    year = F.when(raw.rlike(r"^\d{4}$"), raw.cast("int"))
    month_year = F.when(raw.rlike(r"^\d{4}-\d{1,2}$"), F.split_part(raw, F.lit("-"), F.lit(1)).cast("int"))
    month = F.when(raw.rlike(r"^\d{4}-\d{1,2}$"), F.split_part(raw, F.lit("-"), F.lit(2)).cast("int"))
    month_start = _day(month_year, month, 1)
    out = F.when((kind == "year"), F.coalesce(_day(year, F.lit(1), 1) if side == "from" else F.last_day(_day(year, F.lit(12), 1)), fail("bad year")))
    out = out.when(kind == "month", F.coalesce(month_start if side == "from" else F.last_day(month_start), fail("bad month")))
    out = out.when(kind == "day", strict_date(raw, side))
    if side == "to":
        out = out.when(kind == "current", as_of)
    return out.otherwise(fail("bad granularity"))


def scope_range(scope: Column, as_of: Column) -> Column:
    """struct(type, from, to) of a scope that is no comparison; anything invalid is an error."""
    kind = F.coalesce(F.nullif(F.lower(F.trim(scope["type"])), F.lit("")), F.lit("current"))
    month_start = _day(scope["year"], scope["month"], 1)
    fail = lambda why: F.raise_error(F.lit(why)).cast("date")

    def side(which: str) -> Column:
        edge = (lambda d: d) if which == "from" else F.last_day
        year = _day(scope["year"], F.lit(1 if which == "from" else 12), 1)
        return (
            F.when(kind == "current", as_of)
            .when(kind == "exact_date", strict_date(scope["date"], "date"))
            .when(kind == "month", F.coalesce(edge(month_start), fail("month and year are invalid")))
            .when(kind == "year", F.coalesce(edge(year), fail("year is invalid")))
            .when(kind == "date_range", boundary_date(scope[which], which, as_of))
            .otherwise(fail("a comparison has to be expanded first; other types are unknown"))
        )

    low, high = side("from"), side("to")
    checked = F.when(low > high, fail("a range may not end before it begins")).otherwise(high)
    return F.struct(kind.alias("type"), low.alias("from"), checked.alias("to"))


def scope_key(range_: Column) -> Column:
    return F.concat_ws("|", range_["type"], range_["from"].cast("string"), range_["to"].cast("string"))


def is_point(kind: Column) -> Column:
    return kind.isin(*POINT_TYPES)


def expand_scopes(tasks: DataFrame, scope: str = "scope", as_of: str = "as_of") -> DataFrame:
    """One row a scope: comparisons become their children, in order and with their labels.

    Adds ``branch`` (from 1), ``label`` (null unless a child of a comparison) and ``range``.
    """
    s = F.col(scope)
    children = s["comparison_scopes"]
    compared = F.lower(F.trim(s["type"])) == "comparison"
    few = F.coalesce(F.size(children), F.lit(0)) < 2
    nested = F.exists(children, lambda c: F.lower(F.trim(c["type"])) == "comparison")
    checked = F.when(few, F.raise_error(F.lit("a comparison needs two scopes"))).when(nested, F.raise_error(F.lit("comparisons can't be nested"))).otherwise(F.lit(None))
    parts = ("type", "date", "month", "year", "from", "to")
    own = F.array(F.struct(*[s[p].alias(p) for p in parts], F.lit(None).cast("string").alias("label")))
    of_child = F.transform(children, lambda c, i: F.struct(*[c[p].alias(p) for p in parts], F.coalesce(F.nullif(c["label"], F.lit("")), F.concat(F.lit("Mốc "), (i + 1).cast("string"))).alias("label")))
    flat = tasks.withColumn("_all", F.when(compared & F.coalesce(checked.isNull(), F.lit(True)), of_child).otherwise(own))
    names = [F.col(f"`{c}`") for c in tasks.columns]
    rows = flat.select(*names, F.posexplode("_all").alias("_at", "_one"))
    return rows.select(*names, (F.col("_at") + 1).alias("branch"), F.col("_one.label").alias("label"), scope_range(F.col("_one"), F.col(as_of)).alias("range"))


def start_of(valid_from: Column, effective: Column | None = None) -> Column:
    given = [lenient_date(valid_from)] + ([lenient_date(effective)] if effective is not None else [])
    return F.coalesce(*given, F.lit(EARLIEST).cast("date"))


def overlaps(start: Column, end: Column, low: Column, high: Column) -> Column:
    """Whether a validity interval and a closed range of days share a day; one formula serves points and ranges."""
    never = end <= start
    return F.coalesce(~never, F.lit(True)) & (start <= high) & (end.isNull() | (end > low))


def audit_interval(range_: Column) -> Column:
    """Half-open interval of an expected range; a range that ends on the last day stays open."""
    after = F.when(range_["to"] < F.lit(LATEST).cast("date"), F.date_add(range_["to"], 1))
    return F.struct(range_["from"].alias("from"), after.alias("until"))


def audit_overlaps(start: Column, end: Column, interval: Column) -> Column:
    """The audit's own test, which has no rule for empty intervals."""
    return (interval["until"].isNull() | (start < interval["until"])) & (end.isNull() | (end > interval["from"]))


def words_to_date(text: Column) -> Column:
    """Date of "ngày d tháng m năm y" or d/m/y in the text; null if there is none or it is no date."""
    pattern = r"(?iu)(?:ngày\s+)?(\d{1,2})(?:\s+tháng\s+|\s*[/-]\s*)(\d{1,2})(?:\s+năm\s+|\s*[/-]\s*)(\d{4})"
    d, m, y = (F.regexp_extract(text, pattern, k) for k in (1, 2, 3))
    return F.when(d != "", F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd"))


def describe(range_: Column) -> Column:
    kind, low, high = range_["type"], range_["from"], range_["to"]
    return (
        F.when(kind == "current", F.concat(F.lit("in force on "), low.cast("string")))
        .when(kind == "exact_date", F.concat(F.lit("on "), low.cast("string")))
        .when(kind == "month", F.concat(F.lit("in "), F.date_format(low, "yyyy-MM")))
        .when(kind == "year", F.concat(F.lit("in "), F.date_format(low, "yyyy")))
        .otherwise(F.concat(F.lit("from "), low.cast("string"), F.lit(" to "), high.cast("string")))
    )


# ---- scopes as models write them -----------------------------------------------------------------

RAW_BOUNDARY = "struct<granularity:string,value:string,date:string,month:string,year:string>"
RAW_FIELDS = f"type:string,date:string,month:string,year:string,value:string,label:string,from:{RAW_BOUNDARY},to:{RAW_BOUNDARY}"
RAW_SCOPE = f"struct<{RAW_FIELDS},comparison_scopes:array<struct<{RAW_FIELDS}>>>"


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and give it to ``body``: a one-element array and a lambda."""
    return F.transform(F.array(value), body)[0]


def _given(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def coerce_boundary(boundary: Column, side: str) -> Column:
    """A boundary whose value stands under another name, or whose granularity shows in its value; nothing is guessed."""
    plain = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    last = F.lit(side == "to")
    alias = F.when(_given(boundary["date"]).isNotNull(), F.lit("day")).when(_given(boundary["month"]).isNotNull(), F.lit("month")).when(_given(boundary["year"]).isNotNull(), F.lit("year")).otherwise("")
    value = plain(boundary["value"])
    found = F.struct(
        F.when(value != "", value).otherwise(plain(F.coalesce(_given(boundary["date"]), _given(boundary["month"]), _given(boundary["year"])))).alias("raw"),
        F.coalesce(F.nullif(plain(boundary["granularity"]), F.lit("")), F.when(value == "", alias), F.lit("")).alias("kind"),
    )

    def shaped(x):
        raw = x["raw"]
        shape = F.when((raw == "current") & last, "current").when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), "day").when(raw.rlike(r"^\d{4}-\d{2}$"), "month").when(raw.rlike(r"^\d{4}$"), "year").otherwise("")
        return F.struct(F.when(x["kind"] != "", x["kind"]).otherwise(shape).alias("granularity"), raw.alias("value"))

    fixed = _let(_let(found, shaped), lambda x: F.struct(x["granularity"].alias("granularity"), F.when((x["granularity"] == "current") & last, F.lit("current")).otherwise(x["value"]).alias("value")))
    return F.when(boundary.isNotNull(), fixed)


def coerce_flat(scope: Column) -> Column:
    """A scope that is no comparison, with a lossless ``value`` put where its type wants it: struct(type, date, month, year, from, to)."""
    kind, value = F.lower(F.trim(F.coalesce(scope["type"], F.lit("")))), F.trim(F.coalesce(scope["value"], F.lit("")))
    number = lambda c: F.try_to_number(_given(c), F.lit("9999")).cast("int")
    year, month, date = number(scope["year"]), number(scope["month"]), _given(scope["date"])
    no_year, no_month = _given(scope["year"]).isNull(), _given(scope["month"]).isNull()
    as_year = (kind == "year") & no_year & value.rlike(r"^\d{4}$")
    as_month = (kind == "month") & (no_year | no_month) & value.rlike(r"^\d{4}-\d{1,2}$")
    as_date = (kind == "exact_date") & date.isNull() & value.rlike(r"^\d{4}-\d{2}-\d{2}$")
    part = lambda k: F.try_to_number(F.split_part(value, F.lit("-"), F.lit(k)), F.lit("9999")).cast("int")
    ranged = kind == "date_range"
    side = lambda name: F.when(ranged, coerce_boundary(scope[name], name))
    return F.struct(
        kind.alias("type"),
        F.when(as_date, value).otherwise(date).alias("date"),
        F.when(as_month, part(2)).otherwise(month).alias("month"),
        F.when(as_year | as_month, part(1)).otherwise(year).alias("year"),
        side("from").alias("from"),
        side("to").alias("to"),
    )


NUMBER_DATE = r"(?<!\d)(\d{1,2})[/-](\d{1,2})[/-](\d{4})(?!\d)"
WORD_DATE = r"(?iu)ngày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})"
WORD_MONTH = r"(?iu)tháng\s+(\d{1,2})(?:\s+năm\s+|\s*/\s*)(\d{4})"
WORD_YEAR = r"(?iu)^\s*(?:năm\s+)?(\d{4})\s*$"


def from_label(label: Column) -> Column:
    """struct(type, date, month, year) of the day, month or year that a label names; type is null if it names none."""
    at = lambda p, k: F.regexp_extract(label, p, k)
    number, word = at(NUMBER_DATE, 3) != "", at(WORD_DATE, 3) != ""
    pick = lambda k: F.when(number, at(NUMBER_DATE, k)).otherwise(at(WORD_DATE, k))
    day, month, year = number | word, at(WORD_MONTH, 2) != "", at(WORD_YEAR, 1) != ""
    date = F.concat_ws("-", F.lpad(pick(3), 4, "0"), F.lpad(pick(2), 2, "0"), F.lpad(pick(1), 2, "0"))
    return F.struct(
        F.when(day, "exact_date").when(month, "month").when(year, "year").alias("type"),
        F.when(day, date).alias("date"),
        F.when(~day & month, at(WORD_MONTH, 1)).alias("month"),
        F.when(~day & month, at(WORD_MONTH, 2)).when(~day & year, at(WORD_YEAR, 1)).alias("year"),
    )


def coerce_child(scope: Column) -> Column:
    """A child of a comparison; one that has lost its value has it back from its label.  Without a type it is an error."""
    kind, label = F.lower(F.trim(F.coalesce(scope["type"], F.lit("")))), F.trim(F.coalesce(scope["label"], F.lit("")))
    no = lambda name: _given(scope[name]).isNull()
    wanting = (kind == "") | ((kind == "current") & (label != "")) | ((kind == "exact_date") & no("date")) | ((kind == "month") & (no("month") | no("year"))) | ((kind == "year") & no("year"))
    def fill(read):
        put = lambda name: F.coalesce(read[name], scope[name]).alias(name)
        return F.struct(put("type"), put("date"), put("month"), put("year"), scope["value"].alias("value"), scope["from"].alias("from"), scope["to"].alias("to"))

    filled = _let(from_label(F.when(wanting, label)), fill)
    names = ("date", "month", "year", "from", "to")

    def typed(flat):
        fail = F.raise_error(F.concat(F.lit("a part of a comparison has no type, and its label names no date: "), label)).cast("string")
        return F.struct(F.when(flat["type"] == "", fail).otherwise(flat["type"]).alias("type"), *[flat[n].alias(n) for n in names], F.nullif(label, F.lit("")).alias("label"))

    return _let(_let(filled, coerce_flat), typed)


def coerce_scope(scope: Column) -> Column:
    """A scope (``RAW_SCOPE``) as a model wrote it in the form that is compiled (``schemas.SCOPE``)."""

    def whole(flat):
        children = F.when(flat["type"] == "comparison", F.transform(scope["comparison_scopes"], coerce_child))
        return F.struct(*[flat[n].alias(n) for n in ("type", "date", "month", "year", "from", "to")], children.alias("comparison_scopes"))

    return _let(coerce_flat(scope), whole)


def preserve_month(scope: Column, question: Column) -> Column:
    """An exact date whose month, but no day of it, the question names is that month: struct(type, date, month, year)."""
    kind, date = F.lower(F.trim(scope["type"])), F.trim(F.coalesce(scope["date"], F.lit("")))
    number = lambda text, k: F.split_part(text, F.lit("-"), F.lit(k)).cast("int")
    month_of = lambda p, m, y: F.transform(
        F.arrays_zip(F.regexp_extract_all(question, F.lit(p), F.lit(m)).alias("m"), F.regexp_extract_all(question, F.lit(p), F.lit(y)).alias("y")), lambda x: x["y"].cast("int") * 100 + x["m"].cast("int")
    )
    known = (kind == "exact_date") & date.rlike(r"^\d{4}-\d{2}-\d{2}$")
    own = F.when(known, number(date, 1) * 100 + number(date, 2))
    to_month = F.coalesce(F.array_contains(month_of(WORD_MONTH, 1, 2), own) & ~F.array_contains(month_of(WORD_DATE, 2, 3), own), F.lit(False))
    return F.struct(
        F.when(to_month, "month").otherwise(scope["type"]).alias("type"),
        F.when(~to_month, scope["date"]).alias("date"),
        F.when(to_month, number(date, 2)).otherwise(scope["month"]).alias("month"),
        F.when(to_month, number(date, 1)).otherwise(scope["year"]).alias("year"),
    )


def branches(cases: DataFrame, scope: str = "scope", as_of: str = "as_of") -> DataFrame:
    """A row for each scope that a case is retrieved for: a comparison's children without their labels, or the scope itself."""
    return expand_scopes(cases, scope, as_of).drop("label")
