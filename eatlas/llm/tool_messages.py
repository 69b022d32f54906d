"""Tool calls and results made from the conversations table.

The table holds plain turns. An assistant turn becomes a call with the whole
text among its arguments, a later user turn the result of the call before it;
arithmetic on conversation and turn gives some of them missing, wrong, unknown
or broken arguments, results without a call, calls that wait for a later call
and calls that wait for each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tool_calls import Schemas

SCHEMAS: Schemas = {
    "search": {"query": ("string", True), "limit": ("integer", True)},
    "translate": {"query": ("string", True), "limit": ("number", False)},
    "rate": {"query": ("string", False), "limit": ("integer", False), "zeta": ("array", False)},
}
_NAMES = ("search", "translate", "rate", "lookup")


def _call_id(turn: Column) -> Column:
    return F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), turn)


def calls(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, call_id, name, arguments, after) of assistant turns."""
    turn, both = F.col("turn"), F.col("conv_id") + F.col("turn")
    query = F.regexp_extract(F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("q"))), r"(?s)^\{\"q\":(.*)\}$", 1)
    limit = F.when(both % 11 == 0, '"many"').otherwise((turn + 1).cast("string"))
    full = F.concat(
        F.lit("{ "),
        F.when((F.col("conv_id") * 3 + turn) % 13 == 0, "").otherwise(F.concat(F.lit('"query": '), query, F.lit(", "))),
        F.lit('"limit": '),
        limit,
        F.when(both % 7 == 1, ', "zeta": [2, {"b": 1, "a": null}]').otherwise(""),
        F.lit(" }"),
    )
    before, behind = _call_id(turn - 2), _call_id(turn + 2)
    after = F.when(F.col("conv_id") % 29 == 3, F.array(before, behind)).when(F.col("conv_id") % 5 == 0, F.array(behind))
    return conversations.where("role = 'assistant'").select(
        "conv_id",
        "turn",
        _call_id(turn).alias("call_id"),
        F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (both % 4 + 1).cast("int")).alias("name"),
        F.when(both % 17 == 2, '{ "query": ').otherwise(full).alias("arguments"),
        after.otherwise(F.array(before)).alias("after"),
    )


def results(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, call_id, content) of user turns after the first."""
    turn = F.col("turn")
    stray = F.concat(F.lit("x"), F.col("conv_id"), F.lit("-"), turn)
    call_id = F.when((F.col("conv_id") + turn) % 19 == 0, stray).otherwise(_call_id(turn - 1))
    return conversations.where("role = 'user' and turn > 0").select("conv_id", "turn", call_id.alias("call_id"), F.col("text").alias("content"))


ORACLE = r"""
    WITH RECURSIVE turns AS (
        SELECT conv_id, turn, role, text, conv_id + turn AS s, 'c' || conv_id || '-' AS c FROM conversations
    ), calls AS (
        SELECT conv_id, turn, c || turn AS call_id, ['search', 'translate', 'rate', 'lookup'][s % 4 + 1] AS name,
               s % 17 = 2 AS broken, s % 11 = 0 AS many, s % 7 = 1 AS zeta, (conv_id * 3 + turn) % 13 = 0 AS bare,
               CASE WHEN s % 11 = 0 THEN '"many"' ELSE (turn + 1)::VARCHAR END AS lim, to_json(coalesce(text, ''))::VARCHAR AS q,
               CASE WHEN conv_id % 29 = 3 THEN [c || (turn - 2), c || (turn + 2)]
                    WHEN conv_id % 5 = 0 THEN [c || (turn + 2)] ELSE [c || (turn - 2)] END AS after
        FROM turns WHERE role = 'assistant'
    ), results AS (
        SELECT conv_id, turn, text AS content,
               CASE WHEN s % 19 = 0 THEN 'x' || conv_id || '-' || turn ELSE c || (turn - 1) END AS call_id
        FROM turns WHERE role = 'user' AND turn > 0
    ), wanted AS (
        SELECT conv_id, call_id, unnest(after) AS needed FROM calls
    ), waits AS (
        SELECT w.* FROM wanted w JOIN calls c ON w.conv_id = c.conv_id AND w.needed = c.call_id
    ), walk AS (
        SELECT conv_id, call_id, 0 AS level FROM calls
        WHERE (conv_id, call_id) NOT IN (SELECT conv_id, call_id FROM waits)
        UNION ALL
        SELECT n.conv_id, n.call_id, w.level + 1 FROM waits n JOIN walk w ON n.conv_id = w.conv_id AND n.needed = w.call_id
    ), levels AS (
        SELECT conv_id, call_id, max(level) AS level FROM walk GROUP BY ALL
    ), linked AS (
        SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id,
               c.turn AS call_turn, r.turn AS result_turn, c.* EXCLUDE (conv_id, call_id, turn), content,
               CASE WHEN r.call_id IS NULL THEN 'unanswered' WHEN c.call_id IS NULL THEN 'orphan'
                    WHEN r.turn < c.turn THEN 'early' ELSE 'linked' END AS status
        FROM calls c FULL JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id
    ), checked AS (
        SELECT *, CASE
            WHEN name IS NULL THEN NULL
            WHEN broken THEN 'not JSON'
            WHEN name = 'lookup' THEN 'unknown function'
            ELSE concat_ws('; ',
                CASE WHEN many AND name IN ('search', 'rate') THEN 'limit is not integer' WHEN many AND name = 'translate' THEN 'limit is not number' END,
                CASE WHEN bare AND name <> 'rate' THEN 'query is missing' END,
                CASE WHEN zeta AND name <> 'rate' THEN 'zeta is unknown' END)
            END AS errors,
            '{"limit":' || lim || CASE WHEN bare THEN '' ELSE ',"query":' || q END
                || CASE WHEN zeta THEN ',"zeta":[2,{"a":null,"b":1}]' ELSE '' END || '}' AS canonical
        FROM linked
    )
    SELECT conv_id, call_id, status, level, errors = '' AS valid, errors,
        row_number() OVER (PARTITION BY conv_id ORDER BY
            CASE WHEN name IS NULL THEN 2 WHEN level IS NULL THEN 1 ELSE 0 END, level, coalesce(call_turn, result_turn), call_id) AS position,
        '{' || concat_ws(',',
            CASE WHEN name IS NULL THEN NULL WHEN broken THEN '"arguments_text":"{ \"query\": "' ELSE '"arguments":' || canonical END,
            '"call_id":"' || call_id || '"', '"call_turn":' || call_turn, '"content":' || to_json(content)::VARCHAR,
            '"name":"' || name || '"', '"result_turn":' || result_turn, '"status":"' || status || '"') || '}' AS json
    FROM checked LEFT JOIN levels USING (conv_id, call_id)
"""
