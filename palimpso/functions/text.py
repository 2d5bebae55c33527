"""Text functions: headings, splitting, quoting, guards and fuzzy spans.

What regular expressions can say is a column expression.  The line-by-line heading grammar, the recursive
splitter and the windowed fuzzy match are Python, wrapped as Arrow-batched pandas UDFs.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- heading grammar -------------------------------------------------------------------------

I = re.IGNORECASE  # noqa: E741
#: Fixed by the drafting rules of the documents.
CHAPTER = re.compile(r"(Chương\s+(?:[IVXLCDM]+|\d+))\s*[:.\-]?\s*(.*)", I)
ARTICLE = re.compile(r"(Điều\s+\d+[a-zđ]?)\s*[.:]?\s*(.*)", I)
CLAUSE = re.compile(r"(\d{1,2})([a-zđ]?)\.\s*(?:\[\d+\]\s*)?(.+)", I)
POINT = re.compile(r"[a-zđ](?:\d+|(?:\.\d+)+)?[.)]\s+.+", I)
APPENDIX = re.compile(r"Phụ\s*lục(?:\s+([IVXLCDM]+|\d+))?(?:[\s:.\-]+(.*))?", I)
SECTION = re.compile(r"([IVXLCDM]+|\d+)\.\s+(.+)")
TABLE_ROW = re.compile(r"\|.*\|")
MAX_CLAUSE = 50


class _Headings:
    """Reads lines in order; knows the kind of the heading it is under and whether a table or a quotation is open."""

    def __init__(self, text: str):
        self.lines = [line.strip() for line in text.split("\n")]
        self.out: list[str] = []
        self.under = ""
        self.table = False
        self.closing = ""

    def title_below(self, at: int, own: str, *not_titles: re.Pattern) -> tuple[str, int]:
        """The title behind a heading, or the next line that isn't blank and isn't a heading itself; the line it is on."""
        if own:
            return own, at
        below = next((k for k in range(at + 1, len(self.lines)) if self.lines[k]), None)
        if below is None or any(p.match(self.lines[below]) for p in not_titles):
            return "", at
        return self.lines[below], below

    def verbatim(self, line: str) -> bool:
        if "<!-- TABLE START -->" in line or "<!-- TABLE END -->" in line:
            self.table = "START" in line
        elif self.table or TABLE_ROW.match(line):
            pass
        elif self.closing:
            ends = "”" in line if self.closing == "”" else line.count('"') % 2 == 1
            self.closing = "" if ends else self.closing
        elif line.startswith("“"):
            self.closing = "" if "”" in line[1:] else "”"
        elif line.startswith('"'):
            self.closing = '"' if line.count('"') % 2 else ""
        else:
            return False
        return True

    def heading(self, at: int) -> tuple[str, int] | None:
        line = self.lines[at]
        if m := APPENDIX.fullmatch(line):
            title, to = self.title_below(at, (m[2] or "").strip(), SECTION, APPENDIX, ARTICLE)
            self.under = "appendix"
            return f"# Phụ lục{' ' + m[1] if m[1] else ''}{': ' + title if title else ''}", to
        if (m := SECTION.fullmatch(line)) and self.under in ("appendix", "section") and not m[1].isdigit():
            self.under = "section"
            return f"## Mục {m[1]}. {m[2].strip()}", at
        if m := CHAPTER.fullmatch(line):
            title, to = self.title_below(at, m[2].strip(), ARTICLE, CHAPTER, re.compile(r"\d+\."))
            self.under = "chapter"
            return f"# {m[1]}{': ' + title if title else ''}", to
        if m := ARTICLE.fullmatch(line):
            title, to = self.title_below(at, m[2].strip(), ARTICLE, CHAPTER, CLAUSE)
            self.under = "article"
            return f"## {m[1]}{'. ' + title if title else ''}", to
        if POINT.fullmatch(line) or self.under != "article":
            return None
        if (m := CLAUSE.fullmatch(line)) and int(m[1]) <= MAX_CLAUSE:
            body = m[3].strip()
            if body and (body[0].isalpha() or ord(body[0]) > 127):
                return f"### Khoản {m[1]}{m[2]}. {body}", at
        return None

    def run(self) -> str:
        at = 0
        while at < len(self.lines):
            line = self.lines[at]
            found = None if not line or self.verbatim(line) else self.heading(at)
            text, at = found if found else (line, at)
            self.out.append(text)
            at += 1
        return "\n".join(self.out)


def to_markdown(text: str | None) -> str | None:
    return None if text is None else _Headings(text).run()


@F.pandas_udf(T.StringType())
def markdown(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(to_markdown, na_action="ignore")


# ---- recursive splitter ----------------------------------------------------------------------

SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def split_text(text: str, size: int = 500, overlap: int = 100, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters that begin with up to ``overlap`` characters of the piece before.

    Text is cut at the first separator it has (kept at the head of the part behind it), parts that are
    too long are cut further, and neighbouring parts are joined as long as they fit.
    """
    level = next(k for k, s in enumerate(separators) if s == "" or s in text)
    mark, finer = separators[level], separators[level + 1 :]
    if mark:
        head, *tail = text.split(mark)
        parts = [p for p in [head, *[mark + x for x in tail]] if p]
    else:
        parts = list(text)
    pieces: list[str] = []
    fitting: list[str] = []
    for part in parts:
        if len(part) < size:
            fitting.append(part)
            continue
        pieces += _join(fitting, size, overlap)
        fitting = []
        pieces += split_text(part, size, overlap, finer) if finer else [part]
    return pieces + _join(fitting, size, overlap)


def _join(parts: list[str], size: int, overlap: int) -> list[str]:
    out: list[str] = []
    held: list[str] = []
    total = 0
    for part in parts:
        if held and total + len(part) > size:
            out.append("".join(held).strip())
            while held and (total > overlap or total + len(part) > size):
                total -= len(held.pop(0))
        held.append(part)
        total += len(part)
    if held:
        out.append("".join(held).strip())
    return [x for x in out if x]


#: texts cut at once, so that a batch's pieces are never all held as Python strings
SPLIT_ROWS = 200


def with_pieces(rows: DataFrame, text: str, pieces: str = "_pieces", size: int = 500, overlap: int = 100) -> DataFrame:
    """Adds a column of the pieces of a text; a text that fits is one piece.  A worker holds a batch as Arrow and the pieces of ``SPLIT_ROWS`` texts."""
    schema = T.StructType([*rows.schema.fields, T.StructField(pieces, T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SPLIT_ROWS):
                part = batch.slice(at, SPLIT_ROWS)
                cut = [None if t is None else [t] if len(t) <= size else split_text(t, size, overlap) for t in part.column(part.schema.get_field_index(text)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cut, pa.list_(pa.string()))], [*part.schema.names, pieces])

    return rows.mapInArrow(run, schema)


# ---- small column expressions ----------------------------------------------------------------


def let(value: Column, use) -> Column:
    """``use(value)``, with the value worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip_quotes(text: Column) -> Column:
    """Without one pair of outer quotation marks, curly or straight, also if a full stop follows."""
    value = F.trim(text)
    inner = F.regexp_extract(value, r"(?s)^(?:“(.*)”|\"(.*)\")\.?$", 0)
    return F.when(inner != "", F.trim(F.regexp_replace(F.regexp_replace(value, r"\.$", ""), "^[“\"]|[”\"]$", ""))).otherwise(value)


def quoted_blocks(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?s)“([^”]*)”"), F.lit(1)), lambda x: F.trim(x))


def verbatim(text: Column) -> Column:
    """For comparisons to the letter: straight quotation marks, single blanks, lower case."""
    return F.lower(collapse(F.translate(text, "“”‘’", "\"\"''")))


def strip_fences(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"^\s*```(?:json)?\s*|\s*```\s*$", ""))


def cited_ids(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(C[1-9][0-9]*)\b"), F.lit(1)))


def numbers_in(text: Column) -> Column:
    """Numbers as they are written, sorted; what is part of a word is none."""
    return F.array_sort(F.regexp_extract_all(text, F.lit(r"(?U)(?<!\w)(\d+(?:[.,]\d+)*)(?!\w)"), F.lit(1)))


#: Fixed words and patterns of the guards over rewritten questions.
CURRENT_TIME_CUES = ("hiện nay", "hiện hành", "hiện tại", "bây giờ", "năm nay", "tháng này")
TIME_RELATIONS = {
    "trước": r"(?U)\btrước\s+(?:ngày|tháng|năm|thời điểm|khi)\b",
    "sau": r"(?U)\bsau\s+(?:ngày|tháng|năm|thời điểm|khi)\b",
    "kể từ": r"(?U)\b(?:kể\s+từ|từ\s+ngày)\b",
    "đến": r"(?U)\b(?:đến|tới)\s+ngày\b",
}
PROTECTED_PHRASES = (
    "cá nhân cư trú", "cá nhân không cư trú", "hộ kinh doanh", "cá nhân kinh doanh", "người lao động", "người nộp thuế", "doanh nghiệp", "nhà cung cấp nước ngoài",
    "tổ chức trả thu nhập", "thuế thu nhập cá nhân", "thuế giá trị gia tăng", "thuế thu nhập doanh nghiệp", "thuế tiêu thụ đặc biệt", "lệ phí môn bài", "tiền chậm nộp",
    "cho thuê nhà", "cho thuê bất động sản", "chuyển nhượng bất động sản", "chuyển nhượng vốn", "chuyển nhượng chứng khoán", "chuyển nhượng nhà", "chuyển nhượng đất",
    "bán hàng online", "bán hàng trực tuyến", "kinh doanh bất động sản", "kinh doanh vàng", "thương mại điện tử",
)
PROTECTED_QUALIFIERS = ("hoàn toàn", "duy nhất", "toàn bộ", "chưa", "chỉ", "tối đa", "ít nhất")
RESIDENT, NON_RESIDENT = "cá nhân cư trú", "cá nhân không cư trú"
CALCULATION_CUES = r"(?U)\b(tính|bao nhiêu|số thuế|thuế phải nộp|nghĩa vụ thuế|chênh lệch|tổng số)\b"
FAILURE_PHRASES = ("không tìm thấy", "chưa có quy định", "không có quy định", "không có thông tin", "không tìm được", "chưa được quy định")
MONEY_WORDS = r"(?:lãi|lương|doanh\s+thu|thu\s+nhập|tiền|giá|trị\s+giá)"
MONEY_FILLERS = r"(?:\s+(?:là|mức|khoảng|tầm|gần|hơn|được|nhận|phát\s+sinh))*"
MONEY_UNITS = r"(?:%|phần\s+trăm\b|đồng\b|nghìn\b|ngàn\b|triệu\b|tỷ\b|usd\b|eur\b)"


def _times(text: Column, phrase: str) -> Column:
    """How often a phrase occurs, without overlaps."""
    return (F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))) / F.lit(len(phrase))


def _any_of(text: Column, phrases: tuple[str, ...]) -> Column:
    return functools.reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in phrases])


def residency_conflict(source: Column, candidate: Column) -> Column:
    """The candidate speaks of residents where the source speaks of non-residents, or the other way round."""
    s, c = F.lower(source), F.lower(candidate)
    has = lambda text, phrase: F.contains(text, F.lit(phrase))
    changed = F.when(has(s, NON_RESIDENT), has(c, RESIDENT) & ~has(c, NON_RESIDENT)).when(has(s, RESIDENT), has(c, NON_RESIDENT))
    return F.coalesce(changed, F.lit(False))


def _lowered(before: Column, after: Column) -> Column:
    return F.struct(F.lower(before).alias("b"), F.lower(after).alias("a"))


def _lost_phrases(b: Column, a: Column, phrases: tuple[str, ...]) -> Column:
    return F.array_compact(F.array(*[F.when(F.contains(b, F.lit(p)) & ~F.contains(a, F.lit(p)), F.lit(p)) for p in phrases]))


def _lost_qualifiers(b: Column, a: Column, words: tuple[str, ...]) -> Column:
    return F.array_compact(F.array(*[F.when(_times(b, w) > _times(a, w), F.lit(w)) for w in words]))


def lost_phrases(before: Column, after: Column, phrases: tuple[str, ...] = PROTECTED_PHRASES) -> Column:
    """Protected names of persons, taxes and activities that a rewritten question no longer has."""
    return let(_lowered(before, after), lambda x: _lost_phrases(x["b"], x["a"], phrases))


def lost_qualifiers(before: Column, after: Column, words: tuple[str, ...] = PROTECTED_QUALIFIERS) -> Column:
    """Quantifiers and negations that a rewritten question has less often."""
    return let(_lowered(before, after), lambda x: _lost_qualifiers(x["b"], x["a"], words))


def _said(text: Column) -> Column:
    """What the guards ask of one text: itself in lower case, numbers, cues of the present time, relations of time."""
    asked = lambda low: F.struct(low.alias("low"), _any_of(low, CURRENT_TIME_CUES).alias("now"), *[low.rlike(r).alias(f"r{k}") for k, r in enumerate(TIME_RELATIONS.values())])
    return F.struct(let(F.lower(text), asked).alias("low"), numbers_in(text).alias("numbers"))


def keeps_query(before: Column, after: Column, context: Column | None = None) -> Column:
    """Names of the guards a rewritten question violates; empty if it is faithful.

    Nothing of the question may be lost, and nothing may be added that neither it nor the ``context`` (the talk
    that led to it, the question included) says: numbers, cues of the present time, relations of time, residency; protected phrases and qualifiers may not be lost.
    Every text is read once for all guards.
    """

    def violated(x: Column) -> Column:
        b, a, k = (x[n]["low"] for n in ("b", "a", "k" if context is not None else "b"))
        nb, na, nk = (x[n]["numbers"] for n in ("b", "a", "k" if context is not None else "b"))
        checks = {
            "numbers": (F.size(F.array_except(nb, na)) > 0) | (F.size(F.array_except(na, nk)) > 0),
            "present": (b["now"] & ~a["now"]) | (~k["now"] & a["now"]),
            **{f"time:{name}": (b[r] & ~a[r]) | (~(b[r] & ~a[r]) & ~k[r] & a[r]) for r, name in ((f"r{n}", name) for n, name in enumerate(TIME_RELATIONS))},
            "residency": residency_conflict(k["low"], a["low"]),
            "phrases": F.size(_lost_phrases(b["low"], a["low"], PROTECTED_PHRASES)) > 0,
            "qualifiers": F.size(_lost_qualifiers(b["low"], a["low"], PROTECTED_QUALIFIERS)) > 0,
        }
        return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]))

    texts = [("b", before), ("a", after), *([("k", context)] if context is not None else [])]
    return let(F.struct(*[_said(t).alias(n) for n, t in texts]), violated)


def guarded_query(before: Column, after: Column, context: Column | None = None) -> Column:
    """The rewritten question if it is faithful, else the one before."""
    return F.when(F.size(keeps_query(before, after, context)) == 0, F.trim(after)).otherwise(before)


def bare_money(text: Column) -> Column:
    """The first number right behind a word of money that no unit follows; null if there is none."""
    pattern = rf"(?iU)\b{MONEY_WORDS}\b{MONEY_FILLERS}\s+((?>\d+(?:[.,]\d+)*+))(?!\s*{MONEY_UNITS})"
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def has_bare_money(text: Column) -> Column:
    return F.coalesce(bare_money(text).isNotNull(), F.lit(False))


def needs_calculation(text: Column) -> Column:
    """A word of reckoning, and a digit."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    return lower.rlike(CALCULATION_CUES) & lower.rlike(r"\d")


def says_failure(text: Column) -> Column:
    return F.coalesce(_any_of(F.lower(text), FAILURE_PHRASES), F.lit(False))


def query_label(query: Column) -> Column:
    """The line behind the first of two prefixes that any line has, or else the first line that isn't blank."""
    lines = F.filter(F.transform(F.split(F.coalesce(query, F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")
    behind = lambda prefix: F.trim(F.substring(F.get(F.filter(lines, lambda x: x.startswith(prefix)), 0), len(prefix) + 1, 1 << 30))
    return F.coalesce(behind("Semantic query:"), behind("SEMANTIC QUERY GỢI Ý:"), F.get(lines, 0), F.lit(""))


def json_object(text: Column, schema: str) -> Column:
    """A JSON object as it comes from a model: fences and thoughts are taken off, and if that is none, what stands between the first and the last brace; null if nothing parses."""
    plain = F.regexp_replace(strip_fences(text), r"^\s+|\s+$", "")
    inner = F.regexp_extract(plain, r"(?s)\{.*\}", 0)
    parse = lambda c: F.when(F.trim(c).startswith("{"), F.from_json(c, schema, {"mode": "PERMISSIVE"}))
    whole = F.try_parse_json(plain).isNotNull()
    return F.when(whole, parse(plain)).when(F.try_parse_json(inner).isNotNull(), parse(inner))


def retry_hint(hint: Column, query: Column, fact: Column) -> Column:
    """The hint if it is safe (three words or more, no candidate ids, no legal reference that question and fact lack), else the fact; 360 characters at most."""
    text, fallback = collapse(hint), collapse(F.coalesce(fact, F.lit("")))
    anchors = F.regexp_extract_all(text, F.lit(r"(?iu)((?<![\p{L}])điều\s+\d+[a-z]?(?![\p{L}\d])|(?:luật|nghị\s+định|thông\s+tư)\s+số|\d{1,4}/\d{4}/[A-ZĐ-]+)"), F.lit(1))
    known = F.lower(F.concat(query, F.lit("\n"), fallback))
    safe = (F.size(F.split(text, " ")) >= 3) & ~text.rlike(r"(?i)\bC[1-9][0-9]*\b") & F.forall(anchors, lambda a: F.contains(known, F.lower(a)))
    return F.when(F.coalesce(safe, F.lit(False)), F.rtrim(F.substring(text, 1, 360))).otherwise(fallback)


def strict_span(span: Column, source: Column) -> Column:
    """The span occurs in the source but for blanks and case, and is no ellipsis."""
    s = F.lower(collapse(span))
    return F.coalesce((s != "") & ~s.contains("...") & ~s.contains("…") & F.contains(F.lower(collapse(source)), s), F.lit(False))


# ---- support spans ---------------------------------------------------------------------------

NUMBER = re.compile(r"(?<!\w)\d+(?:[.,]\d+)*(?:\s*%)?")
NEGATION = re.compile(r"\b(?:không|chưa|chẳng|trừ|ngoại\s+trừ)\b", I)
FUZZY = 0.95
MATCH = T.StructType([T.StructField("support_span", T.StringType()), T.StructField("match_type", T.StringType()), T.StructField("match_score", T.DoubleType())])


class Source:
    """A source's words, joined by single blanks, with running counts of its numbers and negations."""

    def __init__(self, text: str):
        self.text = text
        self.words = list(re.finditer(r"\S+", text))
        self.joined = " ".join(w[0] for w in self.words)
        lengths = np.array([len(w[0]) + 1 for w in self.words], np.int64)
        self.starts = np.cumsum(lengths) - lengths
        self.ends = self.starts + lengths - 1

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and negations that begin before each word (a negation of two words counts by its second)."""
        at = lambda spans: np.bincount(np.searchsorted(self.starts, np.array(spans, np.int64), "right"), minlength=len(self.words) + 1).cumsum()
        return at([m.start() for m in NUMBER.finditer(self.joined)]), at([m.end() - 1 for m in NEGATION.finditer(self.joined)])

    def excerpt(self, lo: int, hi: int) -> str:
        """The source's own text for a range of ``joined``."""
        first, last = (int(np.searchsorted(self.starts, x, "right")) - 1 for x in (lo, hi - 1))
        return self.text[self.words[first].start() + lo - int(self.starts[first]) : self.words[last].start() + hi - int(self.starts[last])]


def _marks(text: str) -> list[str]:
    """What two texts have to agree in: every number and every negation."""
    return sorted("".join(m[0].split()).casefold() for p in (NUMBER, NEGATION) for m in p.finditer(text))


def letter_masks(text: str) -> dict[str, int]:
    """The places of every letter of a text, as bits."""
    masks: dict[str, int] = {}
    for k, c in enumerate(text):
        masks[c] = masks.get(c, 0) | 1 << k
    return masks


def common_letters(masks: dict[str, int], n: int, text: str) -> int:
    """Length of the longest common subsequence of a text and one of ``n`` letters given by its masks (bit-parallel)."""
    ones = (1 << n) - 1
    v = ones
    for c in text:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & ones
    return n - v.bit_count()


def _near(wanted: str, source: Source) -> tuple[str, str, float] | None:
    """The most similar run of words, at ``FUZZY`` or more, that agrees in numbers and negations; the first of equals."""
    folded, n, total = wanted.casefold(), len(wanted.split()), len(source.words)
    slack = max(2, min(8, round(n * 0.15)))
    numbers, negations = source.counts()
    want = len(NUMBER.findall(wanted)), len(NEGATION.findall(wanted))
    runs = []
    for count in range(max(1, n - slack), min(total, n + slack) + 1):
        first = np.arange(total - count + 1)
        size = source.ends[first + count - 1] - source.starts[first]
        # similarity is at most twice the shorter over the sum of both, and numbers and negations are counted before they are read
        fits = (2 * np.minimum(size, len(folded)) >= FUZZY * (size + len(folded))) & (numbers[first + count] - numbers[first] == want[0]) & (negations[first + count] - negations[first] == want[1])
        runs += [(int(k), count) for k in first[fits]]
    marks, best, masks = _marks(wanted), None, letter_masks(folded)
    bounded = []
    for first, count in runs:
        run = source.joined[source.starts[first] : source.ends[first + count - 1]]
        low = run.casefold()
        # matching blocks are a common subsequence, so similarity can't be more than the longest one gives
        most = 2 * common_letters(masks, len(folded), low) / (len(folded) + len(low))
        if most >= FUZZY:
            bounded.append((-most, first, count, run, low))
    for most, first, count, run, low in sorted(bounded):
        if best is not None and -most < -best[0]:
            break
        if _marks(run) == marks and (score := SequenceMatcher(None, folded, low, autojunk=False).ratio()) >= FUZZY:
            best = min(best or (0.0, 0, 0), (-score, first, count))
    if best is None:
        return None
    score, first, count = -best[0], *best[1:]
    return source.text[source.words[first].start() : source.words[first + count - 1].end()], "fuzzy", score


def _find_folded(wanted: str, joined: str, fold) -> tuple[int, int] | None:
    """Where a text says ``wanted`` but for case, in places of the text as it is; letters may become several when folded (ß)."""
    low, sought = fold(joined), fold(wanted)
    lo = low.find(sought)
    if lo < 0:
        return None
    hi = lo + len(sought)
    if len(low) > len(joined):
        ends = np.cumsum([len(fold(c)) for c in joined])
        lo, hi = int(np.searchsorted(ends, lo, "right")), int(np.searchsorted(ends, hi - 1, "right")) + 1
    return lo, hi


def match_span(span: str | None, source: str | None) -> tuple[str, str, float] | None:
    """Where the source says what the span says: to the letter, but for blanks and case, or nearly.

    A near match is a run of about as many words whose similarity is 0.95 or more and whose numbers and
    negations are just the span's; spans under 32 characters or 6 words have none.  The text returned is the source's.
    """
    if not span or not source:
        return None
    if span in source:
        return span, "exact", 1.0
    own, wanted = Source(source), " ".join(span.split())
    if not own.words or not wanted:
        return None
    for fold in (str.lower, str.casefold):
        if at := _find_folded(wanted, own.joined, fold):
            return own.excerpt(*at), "whitespace_normalized", 1.0
    return _near(wanted, own) if len(wanted) >= 32 and len(wanted.split()) >= 6 else None


@F.pandas_udf(MATCH)
def span_match(spans: pd.Series, sources: pd.Series) -> pd.DataFrame:
    found = [match_span(a, b) for a, b in zip(spans, sources, strict=True)]
    return pd.DataFrame([f or (None, None, None) for f in found], columns=["support_span", "match_type", "match_score"])
