"""Places inside a document: chapters, articles, clauses, points, appendices and sections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What follows each kind of heading word: fixed by the language of the corpus.
PATTERNS = {
    "chuong": r"(?iu)chương\s+([IVXLCDM\d]+)",
    "dieu": r"(?iu)điều\s+(\d+[a-zđ]?)",
    "khoan": r"(?iu)khoản\s+(\d+[a-zđ]?)",
    "diem": r"(?iu)điểm\s+([a-zđ](?:\d+|(?:\.\d+)+)?)(?![\p{L}\d])",
    "phu_luc": r"(?iu)phụ\s*lục\s+([IVXLCDM\d]+)",
    "muc": r"(?iu)mục\s+([IVXLCDM\d]+)",
}


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def found(text: Column, kind: str) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), PATTERNS[kind], 1), F.lit(""))


def tokens(location: Column) -> Column:
    """struct of the six numbers or letters, upper-cased; null where absent."""
    text = collapse(F.coalesce(location, F.lit("")))
    return F.struct(*[F.upper(found(text, k)).alias(k) for k in PATTERNS])


def canonical(location: Column, with_point: bool = True) -> Column:
    """Identity of a location; empty if it names nothing.  An article's identity leaves its chapter out."""
    t = tokens(location)
    part = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(name + "_"), value))
    parts = [
        part("PHU_LUC", t["phu_luc"]),
        part("MUC", t["muc"]),
        F.when(t["dieu"].isNotNull(), part("DIEU", t["dieu"])).when(t["phu_luc"].isNull(), part("CHUONG", t["chuong"])),
        part("KHOAN", t["khoan"]),
    ]
    return F.concat_ws("|", *parts, *([part("DIEM", t["diem"])] if with_point else []))


def label(chapter: Column, article: Column, clause: Column) -> Column:
    """Location of a heading from the three headings it stands under; null if none of them is numbered."""
    named = lambda word, value, case: F.when(value.isNotNull(), F.concat(F.lit(word + " "), case(value)))
    appendix, chap = found(chapter, "phu_luc"), found(chapter, "chuong")
    section, art = found(article, "muc"), found(article, "dieu")
    parts = (
        F.coalesce(named("Phụ lục", appendix, F.upper), named("Chương", chap, F.upper)),
        F.coalesce(named("Mục", section, F.upper), named("Điều", art, F.lower)),
        named("Khoản", found(clause, "khoan"), F.lower),
    )
    return F.nullif(F.concat_ws(" > ", *parts), F.lit(""))


def provision_key(document_id: Column, location: Column) -> Column:
    return F.concat(document_id, F.lit("|"), F.nullif(canonical(location, False), F.lit("")))


def version_id(key: Column, version: Column) -> Column:
    return F.concat(key, F.lit("|V"), F.coalesce(version, F.lit(1)).cast("string"))


def point_id(version: Column, sub_chunk: Column) -> Column:
    """16 hex digits: as a number it would not fit a signed 64-bit one."""
    raw = F.concat(version, F.lit("|SUB_"), F.coalesce(sub_chunk, F.lit(0)).cast("string"))
    return F.substring(F.sha2(raw.cast("binary"), 256), 1, 16)


def hex_number(point: Column) -> Column:
    return F.conv(point, 16, 10).cast("decimal(20,0)")


def canonical_document(document_id: Column) -> Column:
    """Upper case, Đ as D, reduced to ``number/year/code`` where there is one, letters and digits only."""
    upper = F.translate(F.upper(F.coalesce(document_id, F.lit(""))), "Đ", "D")
    core = F.regexp_extract(upper, r"(\d+\s*/\s*\d{4}\s*/\s*[A-Z0-9-]+)", 1)
    return F.regexp_replace(F.when(core != "", core).otherwise(upper), "[^A-Z0-9]", "")


def segment_number(location: Column, word: str) -> Column:
    """Number of the segment that is just ``word`` and digits; null if there is none (letters don't count)."""
    hits = F.filter(F.transform(F.split(location, ">"), lambda s: F.regexp_extract(F.trim(s), rf"(?iu)^{word}\s+(\d+)$", 1)), lambda n: n != "")
    return F.get(hits, 0).cast("int")


def article_number(location: Column) -> Column:
    return segment_number(location, "điều")


def clause_number(location: Column) -> Column:
    return segment_number(location, "khoản")


def is_article_level(location: Column, numeric_only: bool = True) -> Column:
    """Has an article and no clause; with ``numeric_only`` a lettered article is none."""
    segments = F.split(location, ">")
    number = r"\d+" if numeric_only else r"\d+[a-zđ]?"
    has = lambda p: F.exists(segments, lambda s: F.trim(s).rlike(p))
    return F.coalesce(has(rf"(?iu)^điều\s+{number}$") & ~has(r"(?iu)^khoản(?:\s|$)"), F.lit(False))


def same_article(a: Column, b: Column) -> Column:
    left, right = tokens(a)["dieu"], tokens(b)["dieu"]
    return F.coalesce(left == right, F.lit(False))


def same_provision(a: Column, b: Column) -> Column:
    return canonical(a, False) == canonical(b, False)


def within(location: Column, target: Column) -> Column:
    """The target itself or anything below it: the target's segments stand in a row inside the location's."""
    edge = lambda x: F.concat(F.lit("|"), canonical(x), F.lit("|"))
    return (canonical(target) != "") & F.contains(edge(location), edge(target))


def selector(text: Column) -> Column:
    """A manifest selector in canonical form; a clause without an article is an error."""
    t = tokens(text)
    orphan = t["khoan"].isNotNull() & t["dieu"].isNull() & t["muc"].isNull() & t["phu_luc"].isNull()
    return F.when(orphan | (canonical(text) == ""), F.raise_error(F.concat(F.lit("no usable selector: "), F.coalesce(text, F.lit("null"))))).otherwise(canonical(text))


POINT_ALPHABET = "a b c d đ e g h i k l m n o p q r s t u v x y"


def point_order(point: Column) -> Column:
    """Array that sorts points: letter by the language's alphabet, then the numbers behind it."""
    letters = F.array(*[F.lit(x) for x in POINT_ALPHABET.split()])
    at = F.array_position(letters, F.lower(F.substring(point, 1, 1))).cast("int")
    numbers = F.transform(F.filter(F.split(F.substring(point, 2, 100), r"\."), lambda x: x != ""), lambda x: x.cast("int"))
    return F.concat(F.array(F.when(at > 0, at).otherwise(F.lit(99))), numbers)


def legacy_label(chapter: Column, article: Column, clause: Column) -> Column:
    """The older label: numbers without letters, headings to the letter of their case, and words for nothing found."""
    first = lambda c, p: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), p, 1), F.lit(""))
    part = lambda word, n: F.concat(F.lit(word + " "), n)
    has = lambda c, *words: F.coalesce(c.contains(words[0]) | c.contains(words[1]), F.lit(False))
    top = F.when(has(chapter, "Phụ lục", "PHỤ LỤC"), part("Phụ lục", first(chapter, r"(?iu)Phụ lục\s+([IVXLCDM\d]+)"))).otherwise(part("Chương", first(chapter, r"Chương\s+([IVXLCDM]+)")))
    middle = F.when(has(article, "Mục", "MỤC"), part("Mục", first(article, r"(?iu)Mục\s+([IVXLCDM\d]+)"))).otherwise(part("Điều", first(article, r"Điều\s+(\d+)")))
    return F.coalesce(F.nullif(F.concat_ws(" > ", top, middle, part("Khoản", first(clause, r"(?iu)Khoản\s+(\d+)"))), F.lit("")), F.lit("Không xác định"))


def legacy_canonical(location: Column) -> Column:
    """The older identity: chapter, article and clause by number, in lower case."""
    text = F.coalesce(location, F.lit(""))
    first = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    part = lambda word, n: F.concat(F.lit(word + " "), n)
    return F.concat_ws(" > ", part("chương", F.upper(first(r"(?iu)Chương\s+([IVXLCDM\d]+)"))), part("điều", first(r"(?iu)Điều\s+(\d+)")), part("khoản", first(r"(?iu)Khoản\s+(\d+)")))


def align_headings(location: Column, content: Column, article: Column, clause: Column) -> Column:
    """struct(article, clause): headings of a provision whose article has gained or lost clauses; the content's own heading counts first."""
    t = tokens(location)
    first_line = F.split(F.trim(F.coalesce(content, F.lit(""))), "\n")[0]
    named = F.regexp_like(F.coalesce(article, F.lit("")), F.concat(F.lit(r"(?iu)điều\s+"), t["dieu"], F.lit(r"(?![\p{L}\d_])")))
    art = F.when(t["dieu"].isNull(), article).when(first_line.startswith("## "), F.trim(F.substring(first_line, 4, 1 << 30))).when(named, article).otherwise(F.concat(F.lit("Điều "), F.lower(t["dieu"])))
    cl = F.when(t["khoan"].isNull(), F.lit(None).cast("string")).when(first_line.startswith("### "), F.trim(F.substring(first_line, 5, 1 << 30))).otherwise(F.concat(F.lit("Khoản "), F.lower(t["khoan"])))
    return F.struct(art.alias("article"), cl.alias("clause"))
