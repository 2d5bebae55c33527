"""What dictionary hints shuffle: runs of words at most, never a question with each of its runs."""

import pytest

from palimpso.operators import dictionary as D


def joins(plan):
    children = plan.children()
    nodes = [children.apply(i) for i in range(children.size())]
    own = [[a.name() for a in [n.output().apply(i) for i in range(n.output().size())]] for n in nodes]
    return ([own] if plan.nodeName() == "Join" else []) + [x for n in nodes for x in joins(n)]


@pytest.mark.parametrize("most", [200_000, 0])
def test_no_question_is_carried_into_a_join(spark, monkeypatch, most):
    monkeypatch.setattr(D, "BROADCAST_PHRASES", most)
    schema = "legal_term string, aliases array<string>, ambiguity_group string, strong_signals array<string>, negative_signals array<string>"
    entries = spark.createDataFrame([("alpha", ["beta gamma"], "g", ["delta"], []), ("omega", [], None, [], [])], schema)
    questions = spark.createDataFrame([(1, "Beta, gamma; delta"), (2, "omega"), (3, None), (4, "nothing here"), (5, "alpha omega alpha")], "question_id long, text string")
    found = D.hints(questions, entries)
    plan = found._jdf.queryExecution()
    sides = joins(plan.optimizedPlan())
    assert sides and all("q" not in names for side in sides for names in side)
    assert ("BroadcastHashJoin" in plan.sparkPlan().toString()) == (most > 0)
    got = sorted((r.question_id, r.legal_term, round(r.score, 6), r["rank"]) for r in found.collect())
    assert got == [(1, "alpha", 0.63, 1), (2, "omega", 0.67, 1), (5, "alpha", 0.55, 1), (5, "omega", 0.55, 2)]
