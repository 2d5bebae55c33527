"""Versions of provisions: chains, selection by time, and upkeep by amendments.

A version holds from ``valid_from`` until ``valid_to`` (half-open, null: open).  Amending never edits a
row in place: it gives a new snapshot in which old rows are closed and their successors inserted.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import re
from collections.abc import Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import locations, temporal
from ..functions.deploy import ship_code
from ..functions.text import to_markdown
from . import intervals

#: Scopes up to this many rows are sent to every task; more are matched by bins of days.
BROADCAST_SCOPES = 10_000


def chain(rows: DataFrame, key: list[str], order: list[Column], valid_from: Column) -> DataFrame:
    """Numbers the rows of a key from 1 and links neighbours: each version ends where the next begins."""
    w = Window.partitionBy(*key).orderBy(*order)
    name = F.concat_ws("|", *[F.col(k).cast("string") for k in key])
    start = rows.withColumn("valid_from", valid_from)
    numbered = start.withColumns({"version": F.row_number().over(w), "valid_to": F.lead("valid_from").over(w), "provision_key": name})
    ident = locations.version_id(F.col("provision_key"), F.col("version"))
    linked = F.col("version") - 1
    return numbered.withColumns(
        {
            "version_id": ident,
            "is_latest": F.lead("version").over(w).isNull(),
            "previous_version_id": F.when(linked > 0, locations.version_id(F.col("provision_key"), linked)),
            "superseded_by_version_id": F.when(F.lead("version").over(w).isNotNull(), locations.version_id(F.col("provision_key"), F.col("version") + 1)),
        }
    )


def join_scopes(versions: DataFrame, scopes: DataFrame, broadcast_rows: int = BROADCAST_SCOPES) -> DataFrame:
    """Every version with every scope it overlaps; ``scopes`` has ``scope_id``, ``kind``, ``low``, ``high``.

    Few scopes are broadcast (their number is checked).  Many are met by bins that the data size, in which an open end costs no
    more copies than another (see ``intervals``).
    """
    start = temporal.start_of(F.col("valid_from"))
    hit = temporal.overlaps(start, F.col("valid_to"), F.col("low"), F.col("high"))
    if scopes.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return versions.join(F.broadcast(scopes), hit)
    left, right = scope_sides(versions, scopes)
    return intervals.overlap_join(left, right).drop("_from", "_last", "_low", "_high")


def scope_sides(versions: DataFrame, scopes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with their days as numbers; an open version ends on the last day there is."""
    last = F.coalesce(F.date_sub("valid_to", 1), F.lit(temporal.LATEST).cast("date"))
    left = versions.withColumns({"_from": F.unix_date(temporal.start_of(F.col("valid_from"))), "_last": F.unix_date(last)})
    return left, scopes.withColumns({"_low": F.unix_date(F.to_date("low")), "_high": F.unix_date(F.to_date("high"))})


def newest_in_points(rows: DataFrame, scope: str = "scope_id", kind: str = "kind", key: str = "provision_key", version: str = "version") -> DataFrame:
    """In point scopes only the newest version of a key stays, with all of its parts; rows without a key stay, and ranges stay whole."""
    v = F.coalesce(F.col(version), F.lit(1))
    keyed = temporal.is_point(F.col(kind)) & (F.trim(F.coalesce(F.col(key), F.lit(""))) != "")
    top = rows.filter(keyed).groupBy(scope, key).agg(F.max(v).alias("_top"))
    joined = rows.join(top.withColumnsRenamed({scope: "_scope", key: "_key"}), keyed & (F.col(scope) == F.col("_scope")) & (F.col(key) == F.col("_key")), "left")
    return joined.filter(F.col("_top").isNull() | (v == F.col("_top"))).drop("_scope", "_key", "_top")


def select_versions(versions: DataFrame, scopes: DataFrame, temporal_off: bool = False) -> DataFrame:
    """What is in force in each scope; ``temporal_off`` is the ablation that lets every version through."""
    if temporal_off:
        few = scopes.limit(BROADCAST_SCOPES + 1).count() <= BROADCAST_SCOPES
        return versions.crossJoin(F.broadcast(scopes) if few else scopes)
    return newest_in_points(join_scopes(versions, scopes))


def substantive(content: Column, location: Column) -> Column:
    """False for blank content and for an article-level provision that is only its heading."""
    lines = F.filter(F.transform(F.split(content, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    bare = lambda x: F.lower(F.regexp_replace(F.regexp_replace(x, r"^#+\s*", ""), r"[\s.:]+$", ""))
    first, place = bare(F.get(lines, 0)), bare(F.element_at(F.split(location, r"\s*>\s*"), -1))
    heading_only = (F.size(lines) == 1) & (F.startswith(first, place) | F.startswith(place, first) | F.get(lines, 0).startswith("#"))
    return (F.size(lines) > 0) & ~(locations.is_article_level(location, numeric_only=False) & heading_only)


def retrievable(versions: DataFrame, scopes: DataFrame, content: Column, location: Column) -> DataFrame:
    """What is in force in each scope and says something."""
    return select_versions(versions, scopes).filter(substantive(content, location))


def active_only(points: DataFrame, active: DataFrame, key: str = "point_id") -> DataFrame:
    """The points that are active.  No active point at all lets nothing through (to an index, an empty set would be no filter)."""
    return points.join(active.select(key).distinct(), key, "left_semi")


def scope_violations(rows: DataFrame) -> DataFrame:
    """Audit of selected rows: those out of scope, and keys with several versions in a point scope."""
    start = temporal.start_of(F.col("valid_from"))
    outside = rows.filter(~temporal.overlaps(start, F.col("valid_to"), F.col("low"), F.col("high"))).select("scope_id", "provision_key", F.lit("outside").alias("problem"))
    several = (
        rows.filter(temporal.is_point(F.col("kind")))
        .groupBy("scope_id", "provision_key")
        .agg(F.countDistinct("version").alias("n"))
        .filter("n > 1")
        .select("scope_id", "provision_key", F.lit("several").alias("problem"))
    )
    return outside.unionByName(several)


def latest_open(versions: DataFrame) -> DataFrame:
    return versions.filter(F.coalesce(F.col("is_latest"), F.lit(True)) & F.col("valid_to").isNull())


def latest_groups(rows: DataFrame, order: str, key: str = "provision_key", content: str = "provision_content") -> DataFrame:
    """One row a key: its first point, how many there are, and the first point's content; a first point without content is an error."""
    first = rows.groupBy(key).agg(F.min(order).alias(order), F.count(F.lit(1)).alias("n_points"), F.min_by(content, order).alias(content))
    missing = F.raise_error(F.concat(F.lit("no content of "), F.col(key))).cast("string")
    return first.withColumn(content, F.coalesce(F.col(content), missing))


def replay_order(ops: DataFrame, issued: str = "source_issued_date") -> list[Column]:
    late = F.lit(temporal.LATEST).cast("date")
    return [F.coalesce(F.col("effective_date"), late), F.coalesce(F.col(issued), late), F.coalesce(F.col("operation_id"), F.lit(""))]


def not_applied(ops: DataFrame, versions: DataFrame) -> DataFrame:
    """Operations that no version lists."""
    done = versions.select(F.explode("applied_operation_ids").alias("operation_id")).distinct()
    return ops.join(done, "operation_id", "left_anti")


# ---- snapshots -------------------------------------------------------------------------------


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A snapshot with the rows of ``new`` in place of those of the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def patch(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Columns of ``changes`` that aren't null replace those of the row with the same key."""
    names = [c for c in changes.columns if c != key]
    joined = old.join(changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in names]), key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in names else F.col(c) for c in old.columns])


def delete_document(points: DataFrame, documents: list, key: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """A snapshot without the documents, and what it leaves out."""
    hit = F.coalesce(F.col(key).isin(*documents), F.lit(False)) if documents else F.lit(False)
    return points.filter(~hit), points.filter(hit)


def missing_points(expected: DataFrame, existing: DataFrame) -> DataFrame:
    """Expected points of every location that lacks at least one: such locations are rebuilt whole."""
    broken = expected.join(existing.select("point_id"), "point_id", "left_anti").select("document_id", "location_label").distinct()
    return expected.join(broken, ["document_id", "location_label"], "left_semi")


# ---- relations between documents -------------------------------------------------------------


def inverse_effects(documents: DataFrame) -> DataFrame:
    """For each target, the distinct effects other documents have on it, in order of source and date."""
    e = documents.select(F.col("document_id").alias("source_document_id"), F.explode("affects_documents").alias("e"))
    back = F.struct("source_document_id", F.col("e.relation_types").alias("relation_types"), F.col("e.impact_scope").alias("impact_scope"), F.col("e.effective_date").alias("effective_date"), F.col("e.status").alias("status"))
    return e.groupBy(F.col("e.target_document_id").alias("document_id")).agg(F.array_sort(F.collect_set(back)).alias("affected_by_documents"))


def replace_effects(old: Column, new: Column) -> Column:
    """Effects of sources that are stated anew give way to the new ones; no effect occurs twice."""
    ident = lambda x: locations.canonical_document(x["source_document_id"])
    stated = F.transform(new, ident)
    return F.array_distinct(F.concat(F.filter(F.coalesce(old, F.array().cast("array<struct<source_document_id:string,relation_types:array<string>,impact_scope:string,effective_date:date,status:string>>")), lambda x: ~F.array_contains(stated, ident(x))), new))


TERMINAL = ("thay_the", "bai_bo")


def terminal_dates(effects: DataFrame) -> DataFrame:
    """First day on which a document is replaced or repealed as a whole."""
    whole = (F.col("impact_scope") == "whole_document") & F.exists("relation_types", lambda r: r.isin(*TERMINAL)) & F.col("effective_date").isNotNull()
    return effects.groupBy("target_document_id").agg(F.min(F.when(whole, F.col("effective_date"))).alias("ends_on")).filter("ends_on is not null")


def expire(versions: DataFrame, terminal: DataFrame, as_of: Column) -> DataFrame:
    """Open versions of ended documents get an end, even in the future; they are inactive from that day on and stay the latest."""
    joined = versions.join(terminal.withColumnRenamed("target_document_id", "document_id"), "document_id", "left")
    hit = F.col("valid_to").isNull() & F.coalesce(F.col("is_latest"), F.lit(True)) & F.col("ends_on").isNotNull()
    return joined.withColumns({"status": F.when(hit & (F.col("ends_on") <= as_of), F.lit("inactive")).otherwise(F.col("status")), "valid_to": F.when(hit, F.col("ends_on")).otherwise(F.col("valid_to"))}).drop("ends_on")


def affected_points(amendments: DataFrame, points: DataFrame) -> DataFrame:
    """Amendment targets and what stands at or below them in the same document (ids compared in canonical form)."""
    # a place is read once a row, and meets a target only where one of its own runs of segments is the target's: an equality join
    ours = points.withColumns({"_doc": locations.canonical_document(F.col("document_id")), "_place": F.split(locations.canonical(F.col("location_label")), r"\|")})
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("_place")), lambda i: F.transform(F.sequence(i, F.size("_place")), lambda k: F.array_join(F.slice("_place", i, k - i + 1), "|"))))
    ours = ours.withColumn("_target", F.explode(F.array_distinct(runs))).drop("_place")
    theirs = amendments.select(F.col("operation_id"), locations.canonical_document(F.col("target_document_id")).alias("_doc"), F.col("target_location"), locations.canonical(F.col("target_location")).alias("_target"))
    return ours.join(theirs.filter("_target != ''"), ["_doc", "_target"]).drop("_doc", "_target")


# ---- amendments ------------------------------------------------------------------------------

REQUIRED = ("operation_id", "target_document_id", "target_location", "target_level", "change", "effective_date", "source_document_id")
VERSION_FIELDS = ("provision_key", "version", "version_id", "document_id", "location_label", "provision_content", "valid_from", "valid_to", "is_latest", "previous_version_id", "superseded_by_version_id", "applied_operation_ids", "change_type")
VERSIONS = (
    "provision_key string, version int, version_id string, document_id string, location_label string, provision_content string, valid_from date, valid_to date,"
    " is_latest boolean, previous_version_id string, superseded_by_version_id string, applied_operation_ids array<string>, change_type string, error string"
)
ARROW = {"string": pa.string(), "int": pa.int32(), "date": pa.date32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
POINT_HEAD = re.compile(r"(?m)^\s*([a-zđ](?:\d+|(?:\.\d+)+)?)[.)]\s+", re.IGNORECASE)
LETTERS = "a b c d đ e g h i k l m n o p q r s t u v x y".split()


#: rows of a batch that goes back to Spark
OUT_ROWS = 4_096


class AmendmentError(ValueError):
    pass


PLACES = {name: re.compile(pattern.replace("(?iu)", "").replace(r"\p{L}", "^\\W\\d_").replace("(?![^\\W\\d_\\d])", r"(?!\w)"), re.IGNORECASE) for name, pattern in locations.PATTERNS.items()}


@functools.lru_cache(1 << 16)
def place(location: str | None) -> dict[str, str]:
    """The numbers and letters of a location; documents share most locations, so they are kept (and not to be changed)."""
    return {name: m[1].upper() for name, pattern in PLACES.items() if (m := pattern.search(location or ""))}


@functools.lru_cache(1 << 16)
def identity(location: str) -> str:
    p = place(location)
    article = [f"DIEU_{p['dieu']}"] if "dieu" in p else [f"CHUONG_{p['chuong']}"] if "chuong" in p and "phu_luc" not in p else []
    front = [f"{name}_{p[k]}" for k, name in (("phu_luc", "PHU_LUC"), ("muc", "MUC")) if k in p]
    return "|".join(front + article + ([f"KHOAN_{p['khoan']}"] if "khoan" in p else []))


def member_order(row: dict) -> tuple:
    """An article before its clauses, and these in order of identity."""
    key = row["provision_key"]
    return "khoan" in place(row["location_label"]), [int(x) if x.isdigit() else 0 for x in re.split(r"(\d+)", key)], key


def unquoted(text: str | None) -> str:
    value = (text or "").strip()
    for left, right in ("“”", '""'):
        if value.startswith(left) and value.rstrip(".").endswith(right) and len(value) > 1:
            return value.rstrip(".")[1:-1].strip()
    return value


class Points:
    """The lettered points of a provision's text; of two with one label the later counts."""

    def __init__(self, text: str):
        self.text = text
        heads = list(POINT_HEAD.finditer(text))
        ends = [*(m.start() for m in heads[1:]), len(text)] if heads else []
        self.spans = {m[1].lower(): (m.start(), e) for m, e in zip(heads, ends, strict=True)}

    @staticmethod
    def order(label: str) -> tuple:
        base = label[:1]
        return (LETTERS.index(base) if base in LETTERS else len(LETTERS), tuple(int(x) for x in label[1:].split(".") if x), label)

    def block(self, label: str) -> str:
        if label not in self.spans:
            raise AmendmentError(f"there is no point {label}")
        s, e = self.spans[label]
        return self.text[s:e].strip()

    def put(self, label: str, block: str) -> str:
        self.block(label)
        s, e = self.spans[label]
        return (self.text[:s] + block + "\n\n" + self.text[e:].lstrip()).strip()

    def insert(self, label: str, block: str) -> str:
        if label in self.spans:
            raise AmendmentError(f"point {label} is there already")
        behind = sorted((k for k in self.spans if self.order(k) > self.order(label)), key=self.order)
        at = self.spans[behind[0]][0] if behind else len(self.text)
        return "\n\n".join(x for x in (self.text[:at].rstrip(), block, self.text[at:].lstrip()) if x)


class Document:
    """All versions of one document's provisions, and the rules by which operations change them.

    Open provisions are kept by key and by article, and what an operation changes is noted so that it can be taken back: an
    operation's work depends on what it aims at and not on how large the document is.
    """

    def __init__(self, rows: list[dict]):
        self.rows: list[dict] = []
        #: open rows by their places: of several of one key the last counts
        self.by_key: dict[str, list[int]] = {}
        #: keys of open rows, by article
        self.by_article: dict[str | None, dict[str, int]] = {}
        self.applied: set[str] = set()
        #: (place, what the row was; None if it wasn't) of everything the current operation has changed
        self.changed: list[tuple[int, dict | None]] = []
        for r in rows:
            self.add(r | {"applied_operation_ids": list(r["applied_operation_ids"]) if r["applied_operation_ids"] is not None else []})
        self.changed.clear()

    def add(self, row: dict) -> None:
        at = len(self.rows)
        self.rows.append(row)
        self.applied.update(row["applied_operation_ids"])
        self.changed.append((at, None))
        self.index(at)

    def index(self, at: int) -> None:
        row = self.rows[at]
        if row["valid_to"] is None and row["is_latest"] is not False:
            bisect.insort(self.by_key.setdefault(row["provision_key"], []), at)
            keys = self.by_article.setdefault(place(row["location_label"]).get("dieu"), {})
            keys[row["provision_key"]] = keys.get(row["provision_key"], 0) + 1

    def unindex(self, at: int) -> None:
        row = self.rows[at]
        if row["valid_to"] is None and row["is_latest"] is not False:
            key, article = row["provision_key"], place(row["location_label"]).get("dieu")
            self.by_key[key].remove(at)
            self.by_article[article][key] -= 1
            if not self.by_article[article][key]:
                del self.by_article[article][key]

    def undo(self, op: dict) -> None:
        """Takes back what the current operation has changed."""
        for at, before in reversed(self.changed):
            self.unindex(at)
            if before is None:
                self.rows.pop()
            else:
                self.rows[at] = before
                self.index(at)
        if self.changed:
            self.applied.discard(op["operation_id"])

    def current(self, key: str) -> int | None:
        held = self.by_key.get(key)
        return held[-1] if held else None

    def _members(self, op: dict) -> Iterator[dict]:
        article = place(op["target_location"]).get("dieu")
        for key in self.by_article.get(article, ()) if article else ():
            row = self.rows[self.current(key)]
            if place(row["location_label"]).get("dieu") == article:
                yield row

    def members(self, op: dict) -> list[dict]:
        """Open provisions of the target article, the article itself first, then its clauses in order of identity."""
        return sorted(self._members(op), key=member_order)

    def at(self, op: dict, location: str | None = None) -> dict | None:
        found = self.current(f"{op['target_document_id']}|{identity(location or op['target_location'])}")
        return None if found is None else self.rows[found]

    def succeed(self, old: dict, content: str, op: dict) -> dict:
        begin = max(old["valid_from"] or date.min, op["effective_date"])
        version = (old["version"] or 1) + 1
        new = old | {
            "version": version,
            "version_id": f"{old['provision_key']}|V{version}",
            "provision_content": content,
            "valid_from": begin,
            "valid_to": None,
            "is_latest": True,
            "previous_version_id": old["version_id"],
            "superseded_by_version_id": None,
            "applied_operation_ids": list(dict.fromkeys([*old["applied_operation_ids"], op["operation_id"]])),
            "change_type": op["change"],
        }
        self.close(old, begin, new["version_id"])
        self.add(new)
        return new

    def close(self, row: dict, day: date, successor: str | None) -> None:
        at = self.current(row["provision_key"])  # what is closed is what counts for its key
        self.unindex(at)
        self.changed.append((at, self.rows[at]))
        self.rows[at] = row | {"valid_to": day, "is_latest": False, "superseded_by_version_id": successor}
        self.index(at)

    def begin(self, location: str, content: str, op: dict) -> None:
        key = f"{op['target_document_id']}|{identity(location)}"
        self.add(
            dict.fromkeys(VERSION_FIELDS)
            | {"provision_key": key, "version": 1, "version_id": f"{key}|V1", "document_id": op["target_document_id"], "location_label": location, "provision_content": content}
            | {"valid_from": op["effective_date"], "is_latest": True, "applied_operation_ids": [op["operation_id"]], "change_type": op["change"]}
        )

    def apply(self, op: dict) -> None:
        for name in REQUIRED:
            if not op.get(name):
                raise AmendmentError(f"the operation has no {name}")
        component = (op.get("target_component") or "").strip().casefold()
        level, change = op["target_level"], op["change"]
        if component not in ("", "title", "preamble", "all"):
            raise AmendmentError(f"unknown component {component}")
        if component in ("title", "preamble") and (level, change) != ("dieu", "sua_doi"):
            raise AmendmentError("only an article's amendment can aim at its title or preamble")
        if op["operation_id"] in self.applied:
            return
        if change == "sua_doi_cum_tu":
            self.replace_phrase(op)
        elif level == "diem":
            self.change_points(op)
        elif level == "khoan":
            self.change_clause(op)
        elif level == "dieu" and component in ("title", "preamble"):
            self.change_head(op, component)
        elif level == "dieu":
            self.change_article(op)
        else:
            raise AmendmentError(f"no rule for {change} of {level}")

    def replace_phrase(self, op: dict) -> None:
        old, new = op.get("old_text") or "", op.get("new_text") or ""
        if not old:
            raise AmendmentError("no phrase to replace")
        if op["target_level"] == "diem":
            row, labels = self.point_targets(op)
            content = row["provision_content"]
            for label in labels:
                points = Points(content)
                if old not in points.block(label):
                    raise AmendmentError(f"point {label} does not have the phrase")
                s, e = points.spans[label]
                content = (content[:s] + content[s:e].replace(old, new) + content[e:]).strip()
            self.succeed(row, content, op)
            return
        rows = self.members(op) if op["target_level"] == "dieu" else [r for r in [self.at(op)] if r]
        hits = [r for r in rows if old in r["provision_content"]]
        if not hits:
            raise AmendmentError("the phrase does not occur in the target")
        for r in hits:
            self.succeed(r, r["provision_content"].replace(old, new), op)

    def point_targets(self, op: dict) -> tuple[dict, list[str]]:
        targets = [t for t in (op.get("targets") if op.get("targets") is not None else []) if t and t.strip()] or [op["target_location"]]
        labels = [place(t).get("diem", "").lower() for t in targets]
        parents = {identity(t) for t in targets}
        if not all(labels) or len(parents) != 1:
            raise AmendmentError("points of one operation must have one parent")
        row = self.at(op, targets[0])
        if row is None:
            raise AmendmentError("the points' parent is not there")
        return row, labels

    def change_points(self, op: dict) -> None:
        row, labels = self.point_targets(op)
        content, new = row["provision_content"], Points(op.get("replacement_text") or "")
        for label in labels:
            if op["change"] == "bo_sung":
                content = Points(content).insert(label, new.block(label))
            else:
                content = Points(content).put(label, f"{label}) {self.gone(op)}" if op["change"] == "bai_bo" else new.block(label))
        self.succeed(row, content, op)

    @staticmethod
    def gone(op: dict) -> str:
        return f"[Đã bãi bỏ theo {op.get('source_location')} {op['source_document_id']}, hiệu lực từ ngày {op['effective_date']}]."

    def tombstone(self, location: str, op: dict) -> str:
        p = place(location)
        return (f"### Khoản {p['khoan'].lower()}. " if "khoan" in p else f"## Điều {p.get('dieu', '')}. ") + self.gone(op)

    def change_clause(self, op: dict) -> None:
        row, number = self.at(op), place(op["target_location"]).get("khoan")
        if not number:
            raise AmendmentError("the target is no clause")
        if op["change"] == "bo_sung":
            if row:
                raise AmendmentError("the clause is there already")
            if not any(True for _ in self._members(op)):
                raise AmendmentError("the clause's article is not there")
            self.begin(op["target_location"], self.clause_text(op, number), op)
            return
        if row is None:
            raise AmendmentError("the clause is not there")
        if op["change"] not in ("bai_bo", "sua_doi", "thay_the"):
            raise AmendmentError(f"no rule for {op['change']} of a clause")
        self.succeed(row, self.tombstone(op["target_location"], op) if op["change"] == "bai_bo" else self.clause_text(op, number), op)

    @staticmethod
    def clause_text(op: dict, number: str) -> str:
        text = unquoted(op.get("replacement_text"))
        if not text:
            raise AmendmentError("no new text")
        if text.startswith("### "):
            return text
        first, _, rest = text.partition("\n")
        body = re.sub(rf"^(?:Khoản\s+)?{re.escape(number)}\s*[.:]\s*", "", first.strip(), flags=re.IGNORECASE)
        return f"### Khoản {number.lower()}. {body}".rstrip() + ("\n" + rest if rest else "")

    def change_head(self, op: dict, component: str) -> None:
        row = min((r for r in self._members(op) if "khoan" not in place(r["location_label"])), key=member_order, default=None)
        if row is None:
            raise AmendmentError("the article is not there")
        head, _, body = row["provision_content"].partition("\n")
        text = unquoted(op.get("replacement_text"))
        if component == "preamble":
            if not text or not head.startswith("## "):
                raise AmendmentError("no new text or no heading before it")
            self.succeed(row, f"{head.strip()}\n{text}", op)
            return
        title = next((x for x in (re.sub(r"^#{1,3}\s+", "", line.strip()).strip("“”\" ") for line in text.splitlines()) if place(x).get("dieu") == place(op["target_location"])["dieu"] and x.casefold().startswith("điều")), None)
        if title is None:
            raise AmendmentError("no new title")
        self.succeed(row, f"## {title}\n{body}".strip() if head.startswith("## ") else f"## {title}\n{row['provision_content']}", op)

    def change_article(self, op: dict) -> None:
        own = self.members(op)
        if op["change"] == "bo_sung":
            if own:
                raise AmendmentError("the article is there already")
            for location, content in self.parsed(op):
                self.begin(location, content, op)
            return
        if not own:
            raise AmendmentError("the article is not there")
        if op["change"] == "bai_bo":
            new = self.succeed(own[0], self.tombstone(f"Điều {place(op['target_location'])['dieu'].lower()}", op), op)
            for r in own[1:]:
                self.close(r, op["effective_date"], new["version_id"])
            return
        fresh = {f"{op['target_document_id']}|{identity(where)}": (where, text) for where, text in self.parsed(op)}
        for r in own:
            if r["provision_key"] in fresh:
                self.succeed(r, fresh.pop(r["provision_key"])[1], op)
            else:
                self.close(r, op["effective_date"], None)
        for location, content in fresh.values():
            self.begin(location, content, op)

    @staticmethod
    def parsed(op: dict) -> list[tuple[str, str]]:
        text = unquoted(op.get("replacement_text"))
        number = place(op["target_location"]).get("dieu")
        if not text or not number:
            raise AmendmentError("no new text or no article")
        if not re.search(r"(?im)^(?:##\s+)?Điều\s+\d+", text):
            text = f"Điều {number}.\n{text}"
        out, article = [], ""
        for block in re.split(r"(?m)^(?=#{1,3}\s)", to_markdown(text)):
            head = place(block.partition("\n")[0])
            if block.startswith("## ") and "dieu" in head:
                article = f"Điều {head['dieu'].lower()}"
                out.append((article, block.strip()))
            elif block.startswith("### ") and article and "khoan" in head:
                out.append((f"{article} > Khoản {head['khoan'].lower()}", block.strip()))
        if not out:
            raise AmendmentError("the new text has no provision")
        return out


def apply_operations(versions: DataFrame, ops: DataFrame) -> DataFrame:
    """A new snapshot of ``versions`` after ``ops`` in replay order, and one row with ``error`` for each that failed.

    Documents don't touch one another, so the fold runs document by document; a failed operation
    changes nothing and the rest go on, and an operation that is applied already is passed over.
    """
    spark = versions.sparkSession
    ship_code(spark)
    fields = [*VERSION_FIELDS, "error"]
    kinds = {c: ARROW[kind] for c, kind in (f.split() for f in VERSIONS.split(", "))}
    order = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(replay_order(ops))])
    # a document's versions and then its operations, one row each, next to one another: documents stream through a task one at a time
    told = ops.select(F.col("target_document_id").alias("doc"), F.struct("*").alias("op"), order.alias("rank"))
    have = versions.select(F.col("document_id").alias("doc"), F.struct(*VERSION_FIELDS).alias("version"))
    both = have.unionByName(told, allowMissingColumns=True).repartition("doc").sortWithinPartitions("doc", F.col("op").isNotNull(), "rank")

    def fold(doc: str | None, have: list[dict], todo: list[dict]) -> Iterator[dict]:
        document, errors = Document(have), []
        for op in todo:
            document.changed.clear()
            try:
                document.apply(op)
            except AmendmentError as e:
                document.undo(op)
                errors.append(dict.fromkeys(VERSION_FIELDS) | {"document_id": doc, "version_id": op["operation_id"], "error": str(e)})
        for r in document.rows:
            r["error"] = None
            yield r
        yield from errors

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held, doc, have, todo = False, None, [], []
        for batch in batches:
            versions, ops = batch.column("version"), batch.column("op")
            rows = zip(values(batch.column("doc")), records(versions), records(ops), strict=True)
            for own, version, op in rows:
                if held and own != doc:
                    yield from fold(doc, have, todo)
                    have, todo = [], []
                held, doc = True, own
                if op is None:
                    have.append(version)
                else:
                    todo.append(op)
        if held:
            yield from fold(doc, have, todo)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = folded(batches)
        while rows := list(itertools.islice(out, OUT_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[c]) for c in fields], fields)

    return both.select("doc", "version", "op").mapInArrow(run, VERSIONS)


def values(column: pa.Array) -> list:
    """A column as plain Python values."""
    if pa.types.is_string(column.type) or pa.types.is_date32(column.type):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def records(column: pa.StructArray) -> Iterator[dict | None]:
    """A column of structs as dictionaries."""
    names = [f.name for f in column.type]
    for there, *row in zip(column.is_valid().to_pylist(), *[values(column.field(k)) for k in range(len(names))], strict=True):
        yield dict(zip(names, row, strict=True)) if there else None
