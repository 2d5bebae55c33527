"""Documents as lines, headings, provisions and points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import locations, text as T
from ..functions.deploy import ship_code

HEADING = r"^(#{1,3})\s+(.+?)\s*$"


def lines(docs: DataFrame, text: str = "text", key: str = "document_id") -> DataFrame:
    """``line_no`` from 0 and ``line`` of every document."""
    return docs.select(F.col(key), F.posexplode(F.split(F.col(text), r"\r\n|\r|\n")).alias("line_no", "line"))


def headings(rows: DataFrame, key: str = "document_id") -> DataFrame:
    """Heading lines with level, title, the line after their whole section (``end``) and after their own body (``body_end``).

    A section ends at the next heading of its level or above; chapters carry on over articles and
    articles over clauses until a heading above them comes.
    """
    found = rows.select(key, F.col("line_no").alias("start"), F.length(F.regexp_extract("line", HEADING, 1)).alias("level"), F.regexp_extract("line", HEADING, 2).alias("title")).filter("level > 0")
    size = rows.groupBy(key).agg((F.max("line_no") + 1).alias("n_lines"))
    w = Window.partitionBy(key).orderBy("start")
    after = w.rowsBetween(1, Window.unboundedFollowing)
    before = w.rowsBetween(Window.unboundedPreceding, 0)
    # next heading at or above the level: the nearest among those of level 1, of 1 or 2, of 1 to 3
    nxt = lambda k: F.min(F.when(F.col("level") <= k, F.col("start"))).over(after)
    up = F.when(F.col("level") == 1, nxt(1)).when(F.col("level") == 2, nxt(2)).otherwise(nxt(3))
    last = lambda k: F.max(F.when(F.col("level") == k, F.struct("start", "title"))).over(before)
    carried = found.withColumns({"_up": up, "_next": F.lead("start").over(w), "_c": last(1), "_a": last(2)}).join(size, key)
    chapter = F.col("_c.title")
    article = F.when((F.col("level") > 1) & (F.col("_c").isNull() | (F.col("_a.start") > F.col("_c.start"))), F.col("_a.title"))
    return carried.select(
        key,
        "start",
        "level",
        "title",
        F.coalesce("_up", "n_lines").alias("end"),
        F.coalesce("_next", "n_lines").alias("body_end"),
        chapter.alias("chapter"),
        article.alias("article"),
        F.when(F.col("level") == 3, F.col("title")).alias("clause"),
    )


def provisions(docs: DataFrame, text: str = "markdown", key: str = "document_id") -> DataFrame:
    """Chapters, articles and clauses with their own text only (children left out) and their location."""
    rows = lines(docs, text, key)
    heads = headings(rows, key)
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    owned = rows.join(heads.select(key, F.col("start").alias("line_no"), F.col("start")), [key, "line_no"], "left").withColumn("start", F.last("start", ignorenulls=True).over(w)).filter("start is not null")
    body = owned.groupBy(key, "start").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("content"))
    located = heads.join(body, [key, "start"]).withColumn("location_label", locations.label(F.col("chapter"), F.col("article"), F.col("clause")))
    return located.filter(F.col("location_label").isNotNull()).select(key, "start", "location_label", "chapter", "article", "clause", F.btrim("content", F.lit(" \n\t\r")).alias("provision_content"))


def from_plain_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``markdown``: the text with its headings marked."""
    ship_code(docs.sparkSession)
    return docs.withColumn("markdown", T.markdown(F.col(text)))


def base_versions(provision_rows: DataFrame, meta: DataFrame, key: str = "document_id") -> DataFrame:
    """Version 1 of every provision, open from the day its document takes effect."""
    ident = locations.provision_key(F.col(key), F.col("location_label"))
    joined = provision_rows.join(meta.select(key, "document_type", "legal_rank", "status", "effective_date", "expiration_date"), key, "left")
    return joined.withColumns(
        {
            "provision_key": ident,
            "version": F.lit(1),
            "version_id": locations.version_id(ident, F.lit(1)),
            "valid_from": F.col("effective_date"),
            "valid_to": F.lit(None).cast("date"),
            "is_latest": F.lit(True),
            "previous_version_id": F.lit(None).cast("string"),
            "superseded_by_version_id": F.lit(None).cast("string"),
            "applied_operation_ids": F.array().cast("array<string>"),
            "change_type": F.lit(None).cast("string"),
        }
    )


def tier1(document_id: Column, effective: Column, summary: Column) -> Column:
    """What every piece of a document is introduced by."""
    since = F.when(effective.isNotNull(), F.concat(F.lit(" | Hiệu lực: "), effective.cast("string"))).otherwise(F.lit(""))
    return F.concat(F.lit("["), document_id, since, F.lit("] "), F.coalesce(summary, F.lit("")))


def points(versions: DataFrame, summaries: DataFrame | None = None, document_summaries: DataFrame | None = None, size: int = 500, overlap: int = 100) -> DataFrame:
    """Pieces of every version's text with their place in it (null if it is whole), id, and the text to embed.

    ``summaries``: ``version_id``, ``sub_chunk_index``, ``tier2``; missing ones read N/A.
    """
    ship_code(versions.sparkSession)
    cut = T.with_pieces(versions, "provision_content", size=size, overlap=overlap)
    rows = cut.select(*[F.col(f"`{c}`") for c in versions.columns], F.size("_pieces").alias("_n"), F.posexplode("_pieces").alias("_i", "original_content"))
    rows = rows.withColumn("sub_chunk_index", F.when(F.col("_n") > 1, F.col("_i"))).withColumn("point_id", locations.point_id(F.col("version_id"), F.col("sub_chunk_index")))
    if summaries is not None:
        s = summaries.select("version_id", F.coalesce("sub_chunk_index", F.lit(0)).alias("_i"), "tier2")
        rows = rows.join(s, ["version_id", "_i"], "left")
    else:
        rows = rows.withColumn("tier2", F.lit(None).cast("string"))
    if document_summaries is not None:
        rows = rows.join(document_summaries.select("document_id", "document_summary"), "document_id", "left")
    else:
        rows = rows.withColumn("document_summary", F.lit(None).cast("string"))
    head = tier1(F.col("document_id"), F.col("valid_from"), F.col("document_summary"))
    augmented = F.concat_ws("\n\n", head, F.coalesce("tier2", F.lit("N/A")), F.col("original_content"))
    return rows.withColumns({"content": augmented, "chunk_size": F.length("original_content"), "augmented_size": F.length(augmented)}).drop("_n", "_i")


def leaf_sections(heads: DataFrame, key: str = "document_id") -> DataFrame:
    """Headings that have no heading below them."""
    w = Window.partitionBy(key).orderBy("start")
    return heads.withColumn("_next", F.lead("level").over(w)).filter(F.col("_next").isNull() | (F.col("_next") <= F.col("level"))).drop("_next")


def manifest_scope(rows: DataFrame, heads: DataFrame, manifest: DataFrame, key: str = "document_id") -> DataFrame:
    """Lines that a manifest lets in: those before the first heading, the selected sections, and the headings above them.

    ``manifest`` has ``include_locations``; a document without selectors is kept whole, a selector that
    matches no section is an error.
    """
    listed = manifest.select(key, F.coalesce("include_locations", F.array().cast("array<string>")).alias("sel"))
    whole = listed.filter(F.size("sel") == 0).select(key)
    named = heads.withColumn("_loc", locations.canonical(locations.label(F.col("chapter"), F.col("article"), F.col("clause")), False))
    wanted = listed.select(key, F.explode("sel").alias("selector")).withColumn("_loc", locations.selector(F.col("selector")))
    hit = wanted.join(named, [key, "_loc"], "left")
    checked = hit.withColumn("start", F.when(F.col("start").isNull(), F.raise_error(F.concat(F.lit("no such section: "), F.col("selector"))).cast("int")).otherwise(F.col("start")))
    ranges = checked.select(key, "start", "end")
    chosen = rows.join(ranges, key).filter((F.col("line_no") >= F.col("start")) & (F.col("line_no") < F.col("end"))).select(key, "line_no")
    above = heads.select(key, F.col("start").alias("line_no"), F.col("end").alias("_end")).join(ranges, key).filter((F.col("line_no") <= F.col("start")) & (F.col("_end") >= F.col("end"))).select(key, "line_no")
    firsts = heads.groupBy(key).agg(F.min("start").alias("first"))
    front = rows.join(firsts, key, "left").filter(F.col("first").isNull() | (F.col("line_no") < F.col("first"))).select(key, "line_no")
    part = chosen.unionByName(above).unionByName(front).join(listed.filter(F.size("sel") > 0).select(key), key, "left_semi").distinct()
    return rows.join(part, [key, "line_no"], "left_semi").unionByName(rows.join(whole, key, "left_semi"))


def is_footer(cells: Column, n_rows: Column) -> Column:
    """A signature or archive table: at least two of a signature word, an archive word, under three rows."""
    all_text = F.lower(F.array_join(cells, " "))
    votes = all_text.rlike(r"(?iu)(ký\s+tên|chủ\s+tịch|bộ\s+trưởng|thủ\s+tướng|\(đã\s+ký\))").cast("int") + all_text.rlike(r"(?iu)(nơi\s+nhận|lưu:)").cast("int") + (n_rows < 3).cast("int")
    return votes >= 2


def table_row(cells: Column, width: Column) -> Column:
    """A Markdown row of just ``width`` cells."""
    padded = F.slice(F.concat(cells, F.array_repeat(F.lit(""), width)), F.lit(1), width)
    return F.concat(F.lit("| "), F.array_join(F.transform(padded, lambda c: F.regexp_replace(F.trim(c), r"\s*\n\s*", " ")), " | "), F.lit(" |"))


def header_metadata(docs: DataFrame, text: str = "text") -> DataFrame:
    """Document id, type, title and date of issue from the lines before the first heading (80 at most)."""
    front = F.array_join(F.slice(F.split(F.split(F.col(text), r"(?m)^#{1,3}\s")[0], "\n"), 1, 80), "\n")
    number = F.regexp_extract(front, r"(?iu)số\s*:?\s*(\d+\s*/\s*\d{4}\s*/\s*[A-ZĐ0-9-]+)", 1)
    kind = F.lower(F.regexp_extract(front, r"(?imu)^\s*(luật|nghị\s+định|thông\s+tư|nghị\s+quyết|quyết\s+định)(?![\p{L}])", 1))
    plain = {"luật": "luat", "nghị định": "nghi_dinh", "thông tư": "thong_tu", "nghị quyết": "nghi_quyet", "quyết định": "quyet_dinh"}
    named = F.lit(None).cast("string")
    for word, code in plain.items():
        named = F.when(T.collapse(kind) == word, F.lit(code)).otherwise(named)
    title = F.regexp_extract(front, r"(?imu)^\s*(?:luật|nghị\s+định|thông\s+tư|nghị\s+quyết|quyết\s+định)\s*\n+\s*(\S[^\n]*)", 1)
    from ..functions.temporal import words_to_date

    return docs.withColumns({"document_id": F.nullif(F.regexp_replace(number, r"\s", ""), F.lit("")), "document_type": named, "title": F.nullif(F.trim(title), F.lit("")), "issued_date": words_to_date(front)})


def replacement_for(source: Column, target: Column) -> Column:
    """struct(text, n): the quoted block that begins with the target's own number, and how many there are; usable if n is 1."""
    t = locations.tokens(target)
    head = (
        F.when(t["khoan"].isNotNull(), F.concat(F.lit(r"(?isu)^\s*(?:khoản\s+)?"), t["khoan"], F.lit(r"\s*[.:].*")))
        .when(t["dieu"].isNotNull(), F.concat(F.lit(r"(?isu)^\s*điều\s+"), t["dieu"], F.lit(r"(?![\p{L}\d]).*")))
        .otherwise(F.lit("^$."))
    )
    head = F.when(t["diem"].isNotNull(), F.concat(F.lit(r"(?isu)^\s*"), F.regexp_replace(t["diem"], r"\.", r"\\\\."), F.lit(r"\s*[.)].*"))).otherwise(head)
    blocks = F.filter(T.quoted_blocks(source), lambda b: F.regexp_like(b, head))
    return F.struct(F.when(F.size(blocks) == 1, F.get(blocks, 0)).alias("text"), F.size(blocks).alias("n"))


def phrase_operation(kind: Column, anchor: Column, operand: Column, section: Column) -> Column:
    """struct(old, new) of a phrase operation; null unless its words occur in the section it comes from."""
    said = F.contains(section, anchor) & (F.contains(section, operand) | operand.isNull() | (kind == "delete"))
    pair = lambda old, new: F.struct(old.alias("old"), new.alias("new"))
    out = F.when(kind == "replace", pair(anchor, operand)).when(kind == "insert_before", pair(anchor, F.concat(operand, F.lit(" "), anchor)))
    out = out.when(kind == "insert_after", pair(anchor, F.concat(anchor, F.lit(" "), operand))).when(kind == "delete", pair(anchor, F.lit("")))
    return F.when(F.coalesce(said & (F.trim(anchor) != ""), F.lit(False)), out)


def target_level(location: Column) -> Column:
    return level_of(locations.tokens(location))


def level_of(t: Column) -> Column:
    return F.when(t["diem"].isNotNull(), "diem").when(t["khoan"].isNotNull(), "khoan").when(t["dieu"].isNotNull(), "dieu")


def amendment_blocks(relations: DataFrame, by: str, order: str = "position") -> DataFrame:
    """``block``: what amended a place, in order, under one heading; a place with no amendment has no row."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    new = F.trim(blank("new_text"))
    text = F.concat(
        F.lit("Nguồn: "), blank("source_document_id"), F.lit(" > "), blank("source_location"), F.lit("\nLoại thay đổi: "), blank("change"), F.lit("\nHiệu lực: "), F.coalesce(F.nullif(blank("effective_date"), F.lit("")), F.lit("Không xác định")),
        F.when(new != "", F.concat(F.lit("\n"), new)).otherwise(F.lit("")),
    )
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))), lambda x: x["t"])
    return relations.groupBy(by).agg(F.concat(F.lit("[CẬP NHẬT PHÁP LÝ ÁP DỤNG CHO VỊ TRÍ NÀY]\n"), F.array_join(listed, "\n\n")).alias("block"))


def corpus_report(points: DataFrame) -> DataFrame:
    """One row: documents, points, terms, and the mean length of pieces before and after they are augmented."""
    from .retrieval import tokens

    sizes = points.agg(F.countDistinct("document_id").alias("documents"), F.count(F.lit(1)).alias("points"), F.round(F.avg(F.length("original_content")), 6).alias("avg_original"), F.round(F.avg(F.length("content")), 6).alias("avg_augmented"))
    terms = points.select(F.explode(F.array_distinct(tokens(F.col("original_content")))).alias("t")).distinct().agg(F.count(F.lit(1)).alias("terms"))
    return sizes.join(F.broadcast(terms), F.lit(True))  # one row each


def article_title(section: Column, target: Column) -> Column:
    """struct(text, n): the new heading of the target's article in a section, and how many different ones there are; usable if n is 1."""
    number = locations.tokens(target)["dieu"]
    pattern = F.concat(F.lit(r"(?imu)^\s*(?:##\s+)?[“\"]?\s*(điều\s+"), F.lower(number), F.lit(r"\s*[.:]?\s*[^\n”\"]+)"))
    found = F.array_distinct(F.transform(F.regexp_extract_all(section, pattern, F.lit(1)), lambda x: F.regexp_replace(x, r"^\s+|[”.\"\s]+$", "")))
    return F.struct(F.when(F.size(found) == 1, F.get(found, 0)).alias("text"), F.coalesce(F.size(found), F.lit(0)).alias("n"))


def article_preamble(section: Column, target: Column) -> Column:
    """struct(text, n): what stands between the heading of the target's article and its first clause, in quoted blocks or else in the whole section; usable if n is 1."""
    number = F.lower(locations.tokens(target)["dieu"])
    quoted = F.regexp_extract_all(section, F.lit(r"(?s)(?:^|\n)\s*[“\"]\s*(.*?)\s*[”\"][.;,:]?(?=\s*(?:\n|$))"), F.lit(1))
    blocks = F.when(F.size(quoted) > 0, quoted).otherwise(F.array(section))
    below = F.concat(F.lit(r"(?imu)^\s*(?:##\s+)?điều\s+"), number, F.lit(r"\s*[.:]?[^\n]*\n([\s\S]*)"))
    body = lambda b: F.regexp_replace(F.coalesce(F.get(F.regexp_extract_all(b, below, F.lit(1)), 0), F.lit("")), r"(?imu)^\s*(?:khoản\s+)?1\s*[.)]\s+[\s\S]*", "")
    found = F.array_distinct(F.filter(F.transform(blocks, lambda b: F.regexp_replace(body(b), r"^\s+|[”\"\s]+$", "")), lambda x: x != ""))
    known = number.isNotNull()
    return F.struct(F.when(known & (F.size(found) == 1), F.get(found, 0)).alias("text"), F.when(known, F.size(found)).otherwise(0).alias("n"))


def header_chunks(docs: DataFrame, text: str = "markdown", key: str = "document_id", size: int = 500, overlap: int = 100) -> DataFrame:
    """The older cut of a document: by headings, with the older labels, and further where a piece is longer than ``size``; ``sub_chunk_index`` is null for a whole one."""
    ship_code(docs.sparkSession)
    rows = provisions(docs, text, key).withColumn("legacy_location", locations.legacy_label(F.col("chapter"), F.col("article"), F.col("clause")))
    cut = T.with_pieces(rows.select(key, "start", "legacy_location", "provision_content"), "provision_content", size=size, overlap=overlap)
    flat = cut.select(key, "start", "legacy_location", F.size("_pieces").alias("_n"), F.posexplode("_pieces").alias("_i", "original_content"))
    return flat.select(key, "start", "legacy_location", F.when(F.col("_n") > 1, F.col("_i")).alias("sub_chunk_index"), "original_content", F.length("original_content").alias("chunk_size"))
