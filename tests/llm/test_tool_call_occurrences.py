import json

from eatlas.llm import queries, tool_calls

from .test_tool_calls import CALLS, RESULTS, SCHEMAS


def test_every_call_and_result_has_its_row(spark):
    calls = [
        (1, 1, "call_0", "f", '{"n": 1}', ["call_1"]),  # identifiers used anew
        (1, 2, "call_1", "f", '{"n": 2}', []),
        (1, 5, "call_0", "f", '{"n": "x"}', []),
        (1, 6, "call_1", "f", '{"n": 4}', ["call_0"]),
        (1, 9, "call_1", "f", '{"n": 5}', ["call_0"]),  # waits for the last of fewer
        (1, 11, None, "f", '{"n": 6}', []),
        (1, 11, None, "f", '{"n": 7}', []),
        (None, 1, "q", "f", '{"n": 8}', ["q"]),
    ]
    results = [(1, 3, "call_0", "r1"), (1, 4, "call_1", "r2"), (1, 7, "call_0", "r3"), (1, 8, "call_0", "r4"), (None, 2, "q", "r5")]
    left = spark.createDataFrame([(*c, "s") for c in calls], CALLS)
    right = spark.createDataFrame([(*r, "l") for r in results], RESULTS)
    rows = tool_calls.every_occurrence(left, right, SCHEMAS).collect()
    texts = {(r["conv_id"], r["call_id"], r["occurrence"], r["status"]): json.loads(r["json"]) for r in rows}
    got = {k: (v.get("arguments", {}).get("n"), v.get("content")) for k, v in texts.items()}
    assert len(rows) == len(got) and got == {
        (1, "call_0", 1, "linked"): (1, "r1"),
        (1, "call_1", 1, "linked"): (2, "r2"),
        (1, "call_0", 2, "linked"): ("x", "r3"),
        (1, "call_1", 2, "unanswered"): (4, None),
        (1, "call_1", 3, "unanswered"): (5, None),
        (1, "call_0", 3, "orphan"): (None, "r4"),
        (1, "(none) 11 call", 1, "unanswered"): (6, None),
        (1, "(none) 11 call", 2, "unanswered"): (7, None),
        (None, "q", 1, "unanswered"): (8, None),
        (None, "q", 1, "orphan"): (None, "r5"),
    }
    found = {(r["conv_id"], r["call_id"], r["occurrence"]): (r["level"], r["valid"]) for r in rows if r["status"] != "orphan"}
    assert [found[1, "call_0", n] for n in (1, 2)] == [(1, True), (0, False)]
    assert [found[1, "call_1", n][0] for n in (1, 2, 3)] == [0, 1, 1] and found[None, "q", 1] == (0, True)
    assert sorted(r["position"] for r in rows if r["conv_id"] == 1) == list(range(1, 9))


def test_query_keeps_repeated_turns(spark, tmp_path):
    rows = [(7, 0, "user", "a"), (7, 1, "assistant", "b"), (7, 1, "assistant", "c"), (7, 2, "user", "d"), (7, 2, "user", "e")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    found = queries.QUERIES["op3_tool_call_linking"](spark, str(tmp_path)).collect()
    assert sorted(json.loads(r["json"])["content"] for r in found) == ["d", "e"]
    assert len(found) == 2 and {r["status"] for r in found} == {"linked"}
