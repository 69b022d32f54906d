import json
import random


from eatlas.llm import tool_calls

CALLS = "conv_id bigint, turn bigint, call_id string, name string, arguments string, after array<string>, status string"
RESULTS = "conv_id bigint, turn bigint, call_id string, content string, level string"
SCHEMAS = {"f": {"n": ("integer", True), "s": ("string", False), "o": ("object", False)}, "g": {"x": ("number", True), "b": ("boolean", False)}}


def run(spark, calls, results):
    left = spark.createDataFrame([(*c, "s") for c in calls], CALLS)
    right = spark.createDataFrame([(*r, "l") for r in results], RESULTS)
    rows = tool_calls.formatted(left, right, SCHEMAS).collect()
    return {(r["conv_id"], r["call_id"]): r for r in rows}, rows


def test_links_orders_and_validates(spark):
    calls = [
        (1, 1, "a", "f", '{"s": "x", "n": 3}', ["c"]),  # waits for a later call
        (1, 3, "b", "f", '{"n": 1.5}', ["a", "a", "missing", None]),
        (1, 5, "c", "g", '{"x": 2, "b": true, "z": 0}', []),
        (1, 5, "c", "g", "repeated id, later text", []),
        (1, 7, "d", "h", "{}", None),
        (1, 9, "e", None, None, ["e"]),  # waits for itself
        (1, 11, None, "g", "[1]", []),
        (2, 1, "a", "f", '{"n": null, "o": {"b": 1, "a": [{"d": 1, "c": "é\\n"}]}}', ["b"]),
        (2, 2, "b", "g", '{"x": "1"}', ["a"]),  # a cycle
        (None, 1, "q", "f", "{}", []),
    ]
    results = [(1, 4, "a", "ok"), (1, 6, "a", "second"), (1, 2, "c", None), (1, 12, "z", "stray"), (1, 13, None, "no id"), (3, 1, "a", "other")]
    got, rows = run(spark, calls, results)
    assert {k: r["status"] for k, r in got.items()} == {
        (1, "a"): "linked",
        (1, "b"): "unanswered",
        (1, "c"): "early",
        (1, "d"): "unanswered",
        (1, "e"): "unanswered",
        (1, "(none) 11 call"): "unanswered",
        (1, "z"): "orphan",
        (1, "(none) 13"): "orphan",
        (2, "a"): "unanswered",
        (2, "b"): "unanswered",
        (3, "a"): "orphan",
    }
    assert [got[1, c]["level"] for c in "abcde"] == [1, 2, 0, 0, None]
    assert got[2, "a"]["level"] is None and got[2, "b"]["level"] is None
    order = [r["call_id"] for r in sorted((r for r in rows if r["conv_id"] == 1), key=lambda r: r["position"])]
    assert order == ["c", "d", "(none) 11 call", "a", "b", "e", "z", "(none) 13"]
    errors = {k: r["errors"] for k, r in got.items()}
    assert errors[1, "a"] == "" and got[1, "a"]["valid"]
    assert errors[1, "b"] == "n is not integer"
    assert errors[1, "d"] == "unknown function"
    assert errors[1, "e"] == "not JSON"
    assert errors[1, "(none) 11 call"] == "not an object"
    assert errors[2, "a"] == "n is missing"
    assert errors[2, "b"] == "x is not number"
    assert errors[1, "z"] is None and got[1, "z"]["valid"] is None
    # Of equal turns the smallest call counts.
    assert errors[1, "c"] in ("z is unknown", "not JSON")
    text = got[2, "a"]["json"]
    assert '"arguments":{"n":null,"o":{"a":[{"c":"é\\n","d":1}],"b":1}}' in text
    for r in rows:
        parsed = json.loads(r["json"])
        assert list(parsed) == sorted(parsed)


def test_a_long_chain_and_a_hot_conversation(spark):
    calls = [(5, i, f"c{i:03}", "f", '{"n": 1}', [f"c{i + 1:03}"] if i < 6 else []) for i in range(200)]
    got, _ = run(spark, calls, [(5, 300 + i, f"c{i:03}", str(i)) for i in range(200)])
    assert [got[5, f"c{i:03}"]["level"] for i in range(8)] == [6, 5, 4, 3, 2, 1, 0, 0]
    assert sorted(r["position"] for r in got.values()) == list(range(1, 201))


def test_levels_of_random_graphs_equal_brute_force(spark):
    rng = random.Random(3)
    calls = []
    for conv in range(8):
        for i in range(30):
            # Mostly chains, some joints, now and then a cycle.
            after = [f"c{rng.choice([i - 1, i - 1, i + 1, rng.randrange(30)])}" for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))]
            calls.append((conv, i, f"c{i}", "f", "{}", [a for a in after if rng.random() < 0.9 and (conv > 2 or int(a[1:]) < i)]))
    needs = {(c, k): {(c, a) for a in after} for c, _, k, _, _, after in calls}
    known = set(needs)
    level = {}
    while True:
        fresh = {k: 1 + max((level[a] for a in n & known), default=-1) for k, n in needs.items() if k not in level and n & known <= set(level)}
        if not fresh:
            break
        level |= fresh
    got, _ = run(spark, calls, [])
    assert {k: r["level"] for k, r in got.items() if r["level"] is not None} == level
    assert 0 < len(level) < len(known)


def test_empty_tables(spark):
    assert run(spark, [], [])[1] == []
    assert len(run(spark, [(1, 1, "a", "f", "{}", [])], [])[1]) == 1
    assert len(run(spark, [], [(1, 1, "a", "x")])[1]) == 1


def test_no_python_on_the_main_path(spark):
    left, right = spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS)
    plan = tool_calls.formatted(left, right, SCHEMAS)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
