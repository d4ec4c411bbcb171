import itertools
import os

import pytest

from scrollmill.llm import mix

pytestmark = pytest.mark.skipif(not os.path.exists(mix.VOCABULARY), reason="no vocabulary file")
SCHEMA = "doc_id bigint, text string, source string, n_tokens bigint, digest string"


def frames(spark, docs, targets):
    d = spark.createDataFrame([(i, t, s, 0, "clash") for i, (t, s) in enumerate(docs)], SCHEMA)
    return d, spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_found_and_shares(spark):
    docs = [(f"word{i} and some more of it", ["A ", "a", "B"][i % 3]) for i in range(300)] + [("only one here", "c"), (None, "a"), ("", "b"), ("lost", None), ("word1 and some more of it", "b")]
    d, t = frames(spark, docs, [("a", 0.5, 1), ("b", 0.4, 3), ("c", 0.05, 2), ("none", 0.05, 9)])
    plan = mix.Mix(d, t)
    assert set(plan.unmet()) == {"c", "none"}
    got = {r["source"]: r for r in plan.shares().collect()}
    assert abs(got["a"]["tokens"] - 0.5 * plan.total) < 0.03 * plan.total and abs(got["b"]["tokens"] - 0.4 * plan.total) < 0.03 * plan.total
    assert got["none"]["tokens"] == 0 and not got["none"]["can_be_met"]
    uses = plan.selection().collect()
    cap = {"a": 1, "b": 3, "c": 2}
    assert all(r["repeats"] <= cap[r["source"]] for r in uses) and len({(r["source"], r["doc_id"]) for r in uses}) == len(uses)


def test_empty(spark):
    d, t = frames(spark, [("x", "a")], [("a", 1.0, 1)])
    assert mix.Mix(d.limit(0), t).unmet() == [] and mix.Mix(d, t.limit(0)).unmet() == []
    assert mix.Mix(d.limit(0), t).selection().count() == 0
    d, t = frames(spark, [("", "a"), (None, "a"), ("x", "b")], [("a", 0.5, 2), ("b", 0.5, 0), (None, 0.0, 1)])
    plan = mix.Mix(d, t)
    assert plan.unmet() == ["a", "b"] and plan.selection().count() == 0
    assert [r["is_met"] for r in plan.shares().collect()] == [False, False, True]


def test_repeated_texts_and_errors(spark):
    """Copies count under each id for what can be met, but one text is used no oftener than allowed."""
    docs = [("one text of some length", "a")] * 50 + [(f"other text {i} of the rest", "b") for i in range(1500)]
    d, t = frames(spark, docs, [("A", 0.01, 1), (" b", 0.3, 2), ("a", 0.9, 1)])
    plan = mix.Mix(d, t)
    assert plan.unmet() == ["a"]
    got = plan.shares().collect()
    assert got[0]["can_be_met"] and not got[0]["is_met"] and got[1]["is_met"]
    assert all(abs(r["error"] - (r["actual_share"] - r["target_share"])) < 1e-12 for r in got)


def brute(patterns, quotas, repeats):
    """Most tokens that integer amounts of unit patterns can place."""
    best = 0
    choices = [[c for c in itertools.product(*(range(repeats[s] + 1) for s in p)) if sum(c) <= max(repeats[s] for s in p)] for p in patterns]
    for pick in itertools.product(*choices):
        got = dict.fromkeys(quotas, 0)
        for (p, n), c in zip(patterns.items(), pick):
            for s, k in zip(p, c):
                got[s] += n * k
        best = max(best, sum(min(got[s], q) for s, q in quotas.items()))
    return best


def test_flow_places_as_much_as_brute_force():
    patterns = {("a",): 10, ("a", "b"): 10, ("b", "c"): 10, ("c",): 10}
    repeats = {"a": 2, "b": 1, "c": 1}
    for quotas in ({"a": 30, "b": 10, "c": 20}, {"a": 10, "b": 20, "c": 20}, {"a": 50, "b": 20, "c": 0}):
        flows = mix.route(patterns, quotas, repeats)
        assert sum(flows.values()) == pytest.approx(brute(patterns, quotas, repeats))
        for s, q in quotas.items():
            assert sum(v for (_, x), v in flows.items() if x == s) <= q + 1e-9
