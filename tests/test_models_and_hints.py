"""Hosted models, and dictionary hints of any number of entries."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpso.operators import dictionary as D
from palimpso.operators import models as M
from palimpso.sources import artifacts as A

# ---- models --------------------------------------------------------------------------------------


def counting(folder):
    """A loader that leaves a mark for each load, and a model that fails on some texts and on large batches."""

    def load():
        with open(f"{folder}/{os.getpid()}-{len(os.listdir(folder))}", "w"):
            pass

        def model(texts):
            assert len(texts) <= 5
            if any("bad" in t for t in texts):
                raise ValueError("bad text")
            return np.array([[len(t), 1.0] if "odd" not in t else [float("nan"), 1.0] for t in texts])

        return model

    load.key = folder
    return load


def test_a_worker_loads_once_and_bad_texts_get_zeros(spark, tmp_path):
    rows = [(k, "bad" if k % 17 == 0 else "odd" if k % 23 == 0 else "x" * (k % 9)) for k in range(400)] + [(999, None)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(8)
    out = {r.id: r.embedding for r in M.embedded(df, loader=counting(str(tmp_path)), dims=2, batch=5).collect()}
    assert out[999] is None
    assert all(out[k] == ([0.0, 0.0] if t in ("bad", "odd") else [len(t), 1.0]) for k, t in rows[:-1])
    marks = [n.split("-")[0] for n in os.listdir(tmp_path)]
    assert marks and len(marks) == len(set(marks))  # eight tasks, and one load for each worker that ran them


def test_pairs_are_scored_in_batches(spark):
    df = spark.createDataFrame([("a b", "B c"), ("a", None), (None, "x"), ("q q r", "r s q")], "q string, t string")
    assert [r.s for r in df.coalesce(1).select(M.scorer(spark)("q", "t").alias("s")).collect()] == [0.5, 0.0, 0.0, 1.0]


def test_hashed_vectors_are_the_same_everywhere(spark):
    texts = ["thuế thu nhập cá nhân", "thu nhập", "", "  ", "thuế thu nhập của cá nhân"]
    here = M.HashedEmbedder()(texts)
    there = M.embedded(spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)).orderBy("id").collect()
    assert np.allclose(here, [r.embedding for r in there]) and not here[2].any()
    assert here[0] @ here[4] > here[1] @ here[4] > 0.2


def test_fingerprints_tell_repeated_rows_apart(spark):
    mark = lambda rows: A.fingerprint(spark.createDataFrame(rows, "doc_id long, text string"), "m", "doc_id", "text")
    a, b, c = (1, "a"), (2, "b"), (3, "c")
    assert mark([a, a, b]) != mark([c, c, b]) != mark([b]) and mark([a, b, a]) == mark([a, a, b]) != mark([a, b])


# ---- hints ---------------------------------------------------------------------------------------


def brute(questions, entries, dense, lexical):
    import re

    def fold(t):
        t = t.lower()
        for said, meant in D.SPELLINGS.items():
            t = t.replace(said, meant)
        return re.sub(r"[^0-9a-zA-ZÀ-ɏḀ-ỿ]+", " ", t).strip(" ")

    out = set()
    for q, text in questions:
        t, found = fold(text), []
        has = lambda p, t=t: f" {p} " in f" {t} "
        for term, aliases, group, pro, con in entries:
            names = {fold(x) for x in [term, *(aliases or [])]}
            score = D.HIT * any(map(has, names)) + D.SIGNAL * (sum(has(fold(s)) for s in pro or []) - sum(has(fold(s)) for s in con or [])) + D.EXACT * (t in names) + D.LEXICAL * lexical.get((q, term), 0.0) + D.DENSE * dense.get((q, term), 0.0)
            if min(1.0, score) >= D.FLOOR:
                found.append((-min(1.0, score), term, group or term))
        kept, groups = [], {}
        for s, term, g in sorted(found):
            groups[g] = groups.get(g, 0) + 1
            if groups[g] <= D.PER_GROUP:
                kept.append((q, term, round(-s, 9)))
        out |= {(*x, k) for k, x in enumerate(kept[: D.MAX_HINTS], 1)}
    return out


@pytest.mark.parametrize("more", [0, 25_000])
def test_hints_are_the_same_however_many_entries(spark, more):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)]
    some = lambda a, b: " ".join(rng.choice(words, int(rng.integers(a, b))))
    entries = [(f"{some(1, 4)} e{k}" if k % 2 else some(1, 4), [some(1, 5) for _ in range(k % 3)], f"g{k % 5}" if k % 3 else None, [some(1, 2) for _ in range(k % 8)], [some(1, 2)] if k % 4 == 0 else None) for k in range(120)]
    entries = list({e[0]: e for e in entries}.values()) + [("signals alone", None, None, ["z1", "z2", "z3", "z4", "z5", "z6"], None), ("Tik-Tok shoppe", None, None, None, None)]
    others = [(f"other {k} thing", [f"alias {k}"], None, [f"s{k}"], None) for k in range(more)]
    questions = [(k, some(0, 12)) for k in range(50)] + [(100, "z1 z2 z3 z4 z5 z6"), (101, "tiktok   SHOPEE"), (102, entries[0][0]), (103, "!")]
    dense = {(int(q), entries[int(e)][0]): float(s) for q, e, s in zip(rng.integers(0, 50, 60), rng.integers(0, 90, 60), rng.random(60), strict=True)}
    lexical = {(int(q), entries[int(e)][0]): float(s) for q, e, s in zip(rng.integers(0, 50, 60), rng.integers(0, 90, 60), rng.random(60), strict=True)}
    table = lambda d: spark.createDataFrame([(q, t, s) for (q, t), s in d.items()], "question_id long, legal_term string, score double")
    schema = "legal_term string, aliases array<string>, ambiguity_group string, strong_signals array<string>, negative_signals array<string>"
    got = D.hints(spark.createDataFrame(questions, "question_id long, text string"), spark.createDataFrame(entries + others, schema), table(dense), table(lexical)).collect()
    known = brute(questions, entries, dense, lexical)
    assert {(r.question_id, r.legal_term, round(r.score, 9), r["rank"]) for r in got} == known and any(t == "signals alone" for _, t, _, _ in known)
