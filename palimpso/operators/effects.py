"""Effects that a document has on others, from loose JSON to typed and checked rows.

An extraction gives a JSON object for each document, whose fields may be absent, null, of another type or nested where a plain value belongs;
it is read as VARIANT and taken apart by paths, so that a wrong type is a null and no error.  Three tables come of it: relations of documents, operations on places,
and problems.  A problem is an operation that can't be carried out as it is written; whether one stops a run is the caller's choice (``strict``).

Everything is column expressions: items are exploded, sections joined by document and place, points of one
parent gathered into one operation within their item's row, and operations exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import locations
from ..functions.lineage import stored
from ..functions.text import let, verbatim
from .documents import article_preamble, article_title, level_of

#: fixed values
TYPES = ("sua_doi", "bo_sung", "thay_the", "bai_bo")
PHRASE = "sua_doi_cum_tu"
SCOPES = ("partial", "whole_document")
COMPONENTS = ("title", "preamble", "all")
TEXT_OPERATIONS = ("replace", "insert_before", "insert_after", "delete")


def _text(item: Column, path: str) -> Column:
    """A field as trimmed text; null where it is absent, empty or no plain value."""
    return F.nullif(F.trim(F.try_variant_get(item, f"$.{path}", "string")), F.lit(""))


def _texts(item: Column, path: str) -> Column:
    """A list of texts, or a single one as a list."""
    listed = F.try_variant_get(item, f"$.{path}", "array<variant>")
    own = F.filter(F.transform(listed, lambda x: F.nullif(F.trim(F.try_variant_get(x, "$", "string")), F.lit(""))), lambda x: x.isNotNull())
    one = _text(item, path)
    return F.when(listed.isNotNull(), own).when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<string>"))


def iso_date(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(text, "yyyy-M-d"))


def _items(raw: DataFrame, name: str) -> DataFrame:
    doc = F.try_parse_json("effects")
    rows = raw.select("document_id", doc.alias("doc"))
    return rows.select("document_id", iso_date(_text(F.col("doc"), "effective_date")).alias("doc_date"), F.posexplode(F.try_variant_get("doc", f"$.{name}", "array<variant>")).alias("position", "item"))


def relations(raw: DataFrame) -> DataFrame:
    """``document_id``, ``position``, ``target_document_id``, ``relation_types``, ``impact_scope``, ``effective_date``, ``quoted``, ``status``; the first of equal ones.

    ``raw`` has ``document_id`` and ``effects`` (JSON).  Relations without a target or without a known type are left out; an unknown scope is partial; a
    missing date is the document's.
    """
    i = F.col("item")
    typed = F.filter(_texts(i, "relation_types"), lambda t: t.isin(*TYPES))
    scope = _text(i, "impact_scope")
    rows = _items(raw, "document_relations").select(
        "document_id", "position", _text(i, "target_document_id").alias("target_document_id"), typed.alias("relation_types"),
        F.when(scope.isin(*SCOPES), scope).otherwise("partial").alias("impact_scope"), F.coalesce(iso_date(_text(i, "effective_date")), "doc_date").alias("effective_date"),
        F.coalesce(_text(i, "can_cu_trich_doan"), F.lit("")).alias("quoted"), F.lit("active").alias("status"),
    ).filter(F.col("target_document_id").isNotNull() & (F.size("relation_types") > 0))
    return _first_of_equals(rows, "document_id")


def _first_of_equals(rows: DataFrame, by: str) -> DataFrame:
    """Of rows alike but for their position the first, however often one is repeated.

    Rows are dealt by ``by`` before they are counted, so that a task holds its share of them and not all that its part of the input says.
    """
    same = [c for c in rows.columns if c != "position"]
    return rows.repartition(by).groupBy(*same).agg(F.min("position").alias("position")).select(*rows.columns)


def _numbers(location: Column) -> Column:
    """struct(diem, khoan, dieu) as ``locations.tokens`` has them."""
    found = lambda text: F.struct(*[F.upper(F.regexp_extract(text, locations.PATTERNS[k], 1)).alias(k) for k in ("diem", "khoan", "dieu")])
    return let(let(locations.collapse(F.coalesce(location, F.lit(""))), found), lambda t: F.struct(*[F.nullif(t[k], F.lit("")).alias(k) for k in ("diem", "khoan", "dieu")]))


def _label(t: Column) -> Column:
    """The label that opens a place's own text, as a pattern, by the place's numbers; null if it has none."""
    quoted = lambda x: F.concat(F.lit(r"\Q"), x, F.lit(r"\E"))
    numbered = lambda x: F.concat(quoted(x), F.lit(r"\s*[.)]"))
    return F.when(t["diem"].isNotNull(), numbered(t["diem"])).when(t["khoan"].isNotNull(), numbered(t["khoan"])).when(t["dieu"].isNotNull(), F.concat(F.lit(r"(?:##\s+)?Điều\s+"), quoted(t["dieu"]), F.lit(r"(?![\p{L}\d])")))


def _blocks(section: Column) -> Column:
    """The quoted blocks of a section, or else the whole without its heading."""
    body = F.trim(F.regexp_replace(section, r"^#{1,3}\s+[^\n]*\n?", ""))
    quoted = F.regexp_extract_all(body, F.lit(r"(?s)(?:^|\n)\s*[“\"]\s*(.*?)\s*[”\"][.;,:]?(?=\s*(?:\n|$))"), F.lit(1))
    return let(quoted, lambda q: F.when(F.size(q) > 0, q).otherwise(F.array(body)))


def _unit(blocks: Column, label: Column, any_label: Column) -> Column:
    pattern = F.concat(F.lit(r"(?imsu)^[ \t]*((?:"), label, F.lit(r").*?)(?=^[ \t]*(?:"), any_label, F.lit(r")|\z)"))
    found = F.flatten(F.transform(blocks, lambda b: F.transform(F.regexp_extract_all(b, pattern, F.lit(1)), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))))
    return let(found, lambda f: F.when(F.size(f) == 1, F.nullif(F.get(f, 0), F.lit(""))))


def unit_text(section: Column, target: Column, targets: Column) -> Column:
    """The new text of a target in a section that may give several: from its label to the next label of any target, in quoted blocks or else in the whole; null unless there is just one."""
    label = lambda place: let(_numbers(place), _label)
    return _unit(_blocks(section), label(target), F.array_join(F.transform(targets, label), "|"))


def operations(raw: DataFrame, sections: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Operations on places, and the problems of those that can't be carried out (``document_id``, ``position``, ``target_location``, ``problem``).

    ``sections`` has ``document_id``, ``location`` and ``section``, the text of a place with its heading first.  An amendment without a target
    or with an unknown change, or of a document that no relation names, is left out.  With ``strict`` a problem is an error.
    """
    known = relations(raw)
    # of several relations with one document the last one's date counts
    dates = known.groupBy("document_id", "target_document_id").agg(F.max_by("effective_date", "position").alias("relation_date"))
    i = F.col("item")
    rows = _items(raw, "amendment_relations").select(
        "document_id", "position", "doc_date", _text(i, "van_ban_bi_sua").alias("target_document_id"), _text(i, "loai_thay_doi").alias("change"), F.lower(_text(i, "target_component")).alias("target_component"),
        _texts(i, "dieu_khoan_bi_sua").alias("targets"), _text(i, "dieu_khoan_sua").alias("source_location"), iso_date(_text(i, "effective_date")).alias("own_date"),
        _text(i, "text_operation").alias("text_operation"), _text(i, "anchor_text").alias("anchor_text"), _text(i, "operand_text").alias("operand_text"),
    ).filter(F.col("target_document_id").isNotNull() & F.col("change").isin(*TYPES, PHRASE)).join(dates, ["document_id", "target_document_id"])
    place = lambda c: F.lower(locations.collapse(c))
    own = sections.select("document_id", place(F.col("location")).alias("_place"), "section").dropDuplicates(["document_id", "_place"])
    rows = rows.withColumn("_place", place(F.col("source_location"))).join(own, ["document_id", "_place"], "left")
    heading = F.split("section", "\n")[0]
    phrase = F.col("change") == PHRASE
    replaced = F.when((F.col("change") == "thay_the") & ~heading.rlike(r"(?iu)(?<!\p{L})thay\s+thế(?!\p{L})") & heading.rlike(r"(?iu)(?<!\p{L})sửa\s+đổi(?!\p{L})"), "sua_doi").otherwise(F.col("change"))
    delete = F.col("text_operation") == "delete"
    says = lambda c: F.contains(verbatim(F.col("section")), verbatim(F.col(c)))
    problem = (
        F.when(phrase & F.col("target_component").isNotNull(), "a phrase has no component")
        .when(~phrase & ~F.coalesce(F.col("target_component").isin(*COMPONENTS), F.lit(False)), "no such component")
        .when(F.size("targets") == 0, "no target place")
        .when(F.col("source_location").isNull(), "no source place")
        .when(F.col("section").isNull(), "no such section")
        .when((F.col("_change") == "thay_the") & ~heading.rlike(r"(?iu)(?<!\p{L})thay\s+thế(?!\p{L})"), "the heading replaces nothing")
        .when(phrase & (~F.coalesce(F.col("text_operation").isin(*TEXT_OPERATIONS), F.lit(False)) | F.col("operand_text").isNull()), "no text operation")
        .when(phrase & ~delete & F.col("anchor_text").isNull(), "no anchor")
        .when(phrase & ~(says("operand_text") & (delete | F.coalesce(says("anchor_text"), F.lit(False)))), "the section doesn't say so")
    )
    rows = rows.withColumn("_change", replaced).withColumn("_problem", problem).withColumn("change", F.col("_change"))
    title, preamble = F.col("target_component") == "title", F.col("target_component") == "preamble"
    # a place's numbers, label and text are worked out once; no place at all is one without a name
    nameless = F.array(F.struct(F.lit(None).cast("int").alias("n"), F.lit(None).cast("string").alias("target")))
    listed = F.when(F.size("targets") > 0, F.transform("targets", lambda x, k: F.struct(k.alias("n"), x.alias("target")))).otherwise(nameless)
    numbered = F.transform(listed, lambda p: F.struct(p["n"].alias("n"), p["target"].alias("target"), _numbers(p["target"]).alias("t")))
    labelled = F.transform(numbered, lambda p: F.struct(p["n"].alias("n"), p["target"].alias("target"), _label(p["t"]).alias("label"), level_of(p["t"]).alias("level")))
    cut = lambda labels: F.array_join(F.transform(labels, lambda p: p["label"]), "|")
    own_texts = lambda ps: let(F.struct(_blocks(F.col("section")).alias("blocks"), cut(ps).alias("any")), lambda c: F.transform(ps, lambda p: _unit(c["blocks"], p["label"], c["any"])))
    of_article = lambda ps, find: F.transform(ps, lambda p: find(F.col("section"), p["target"])["text"])
    none = lambda ps: F.transform(ps, lambda p: F.lit(None).cast("string"))
    texts = lambda ps: (
        F.when(F.col("_problem").isNotNull() | phrase | (F.col("change") == "bai_bo"), none(ps)).when(title, of_article(ps, article_title)).when(preamble, of_article(ps, article_preamble)).otherwise(own_texts(ps))
    )
    # points of one parent are one operation, any other place is one by itself
    parent = lambda x: F.lower(locations.collapse(F.regexp_replace(x, r"(?iu)\s*>\s*Điểm\s+[a-zđ](?:\d+|(?:\.\d+)+)?\s*$", "")))
    group = lambda p: F.when(p["level"] == "diem", F.concat(F.lit("p"), parent(p["target"]))).otherwise(F.concat(F.lit("n"), F.coalesce(p["n"], F.lit(0)).cast("string")))
    part = lambda p, x: F.struct(p["n"].alias("n"), p["target"].alias("target"), x.alias("text"), p["level"].alias("level"), group(p).alias("group"))
    parts = let(labelled, lambda ps: F.zip_with(ps, texts(ps), part))
    gathered = let(parts, lambda ps: F.transform(F.array_distinct(F.transform(ps, lambda p: p["group"])), lambda g: F.filter(ps, lambda p: p["group"] == g)))
    grouped = rows.select("*", F.explode(gathered).alias("parts"))
    first = F.get("parts", 0)
    texts = F.transform("parts", lambda p: p["text"])
    whole = F.when(F.forall(texts, lambda t: t.isNotNull()), F.array_join(texts, "\n\n"))
    title, preamble, phrase = (F.col("target_component") == "title"), (F.col("target_component") == "preamble"), F.col("change") == PHRASE
    wrong_level = F.coalesce((title | preamble) & ((first["level"] != "dieu") | first["level"].isNull() | (F.col("change") != "sua_doi")), F.lit(False))
    joined = lambda a, b: F.concat(a, F.when(a.rlike(r"\s$") | b.rlike(r"^\s"), F.lit("")).otherwise(F.lit(" ")), b)
    anchor, operand, kind = F.col("anchor_text"), F.col("operand_text"), F.col("text_operation")
    old = F.when(phrase, F.when(kind == "delete", operand).otherwise(anchor))
    new = F.when(phrase, F.when(kind == "delete", "").when(kind == "replace", operand).when(kind == "insert_before", joined(operand, anchor)).otherwise(joined(anchor, operand))).otherwise(whole)
    needs_text = ~phrase & (F.col("change") != "bai_bo")
    checked = grouped.withColumns({"_whole": whole, "problem": F.coalesce("_problem", F.when(wrong_level, "the component is an article's, and amended").when(needs_text & F.coalesce(whole, F.lit("")).eqNullSafe(""), "no new text"))})
    out = checked.select(
        "document_id", (F.col("position") * 10_000 + F.coalesce(first["n"], F.lit(0))).alias("position"), "source_location", "target_document_id", first["target"].alias("target_location"), first["level"].alias("target_level"), "target_component",
        F.transform("parts", lambda p: p["target"]).alias("targets"), "change", F.when(phrase, kind).alias("text_operation"), F.when(phrase & (kind != "delete"), anchor).alias("anchor_text"), F.when(phrase, operand).alias("operand_text"),
        old.alias("old_text"), new.alias("new_text"), F.coalesce("own_date", "relation_date", "doc_date").alias("effective_date"), F.split("section", "\n")[0].alias("heading"), "problem",
    )
    identity = ["anchor_text", "change", "document_id", "effective_date", "new_text", "old_text", "operand_text", "source_location", "target_component", "target_document_id", "target_location", "targets", "text_operation"]
    # good ones and problems are read apart, and worked out once
    out = stored(out, "operations")
    number = F.sha2(F.to_json(F.struct(*identity), {"ignoreNullFields": "false"}), 256)
    problems = out.filter("problem is not null").select("document_id", "position", "target_location", "problem")
    good = out.filter("problem is null").drop("problem")
    if strict:
        good = out.withColumn("document_id", F.when(F.col("problem").isNull(), F.col("document_id")).otherwise(F.raise_error(F.concat_ws(": ", "document_id", "target_location", "problem")).cast("string"))).drop("problem")
    return _first_of_equals(good, "document_id").withColumn("operation_id", number), problems
