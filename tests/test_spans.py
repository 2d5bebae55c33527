"""Spans over whole tables against comparing every text with every span."""

import numpy as np
import pytest

from palimpso.functions import text as T
from palimpso.operators import verify


def corpus(seed=0, n=60):
    rng = np.random.default_rng(seed)
    letters = np.array(list("aeioubcdghklmnrst"))
    word = lambda: "".join(rng.choice(letters, int(rng.integers(1, 9))))
    names = [word() for _ in range(300)] + ["không", "12", "3,5", "Đất", "Straße", "10%"]
    some = lambda k: [names[int(i)] for i in rng.integers(0, len(names), k)]
    spans = [(k, " ".join(some(int(rng.integers(4, 30))))) for k in range(40)] + [(100, "a"), (101, "không"), (102, " "), (103, None), (104, "zz zz zz zz zz zz zz zz zz zz zz zz"), (105, names[3] + "\n " + names[4])]
    texts = []
    for d in range(n):
        parts = some(int(rng.integers(0, 60)))
        for _ in range(3):
            own = list(spans[int(rng.integers(0, 40))][1])
            for _ in range(int(rng.integers(0, 4))):  # letters changed, left out and put in, in any word
                at = int(rng.integers(0, len(own)))
                own[at : at + 1] = [[], ["x"], [own[at], "y"], [own[at].upper()]][int(rng.integers(0, 4))]
            place = int(rng.integers(0, len(parts) + 1))
            parts[place:place] = ["".join(own)]
        texts.append((d, str(rng.choice([" ", "  ", "\n"])).join(parts)))
    return texts + [(900, None), (901, ""), (902, " \n"), (903, "zz " * 400)], spans


@pytest.mark.parametrize("block", [1 << 20, 600])
def test_near_spans_are_those_of_all_pairs(spark, block):
    texts, spans = corpus()
    found = verify.matched_spans(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(spans, "item_id long, span string"), block)
    got = {(r.doc_id, r.item_id): (r.support_span, r.match_type, round(r.match_score, 9)) for r in found.collect()}
    known = {(d, i): (m[0], m[1], round(m[2], 9)) for d, t in texts for i, s in spans if s and s.strip() and (m := T.match_span(s, t))}
    kinds = [m[1] for m in known.values()]
    assert min(kinds.count(k) for k in ("exact", "whitespace_normalized", "fuzzy")) > 5
    assert got == known


def test_contained_spans_are_those_of_all_pairs(spark):
    texts, spans = corpus(1)
    spans = [*spans, (106, "x..."), (107, "…")]
    fold = lambda t: " ".join(t.split()).lower()
    known = {(d, i) for d, t in texts if t is not None for i, s in spans if s and fold(s) and "..." not in s and "…" not in s and fold(s) in fold(t)}
    for block in (1 << 20, 300):
        got = verify.contained_spans(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(spans, "item_id long, span string"), block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == known and len(got) == len(known)
