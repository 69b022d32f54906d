"""Tool calls and their results, linked, ordered, checked and serialised.

DataFrame operations only. Calls and results meet in a hash join by conversation,
identifier and occurrence: the n-th call of an identifier by turn has the n-th
result (``every_occurrence``). ``formatted`` takes the first of each only. The
order inside a conversation comes from dependency levels, computed a level a
round by joins on identifiers; a conversation is never gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import distributed_row_number
from ..operators.skew import materialize

# A schema: parameter -> (type, required). Types are those of JSON schema.
Schemas = dict[str, dict[str, tuple[str, bool]]]

_KINDS = {
    "integer": "^BIGINT$",
    "number": "^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$",
    "string": "^STRING$",
    "boolean": "^BOOLEAN$",
    "array": "^ARRAY<",
    "object": "^OBJECT<",
}
_KEY = ["conv_id", "call_id"]


def _identified(rows: DataFrame) -> DataFrame:
    """A call or result without an identifier gets one that nothing else has, and so links with nothing."""
    own = F.concat(F.lit("(none) "), F.coalesce(F.col("turn").cast("string"), F.lit("")))
    return rows.withColumn("call_id", F.coalesce("call_id", F.when(F.col("role") == "call", F.concat(own, F.lit(" call"))), own))


def linked(calls: DataFrame, results: DataFrame) -> DataFrame:
    """One row per conversation and identifier of ``calls`` (conv_id, turn, call_id,
    name, arguments, after) and ``results`` (conv_id, turn, call_id, content).

    The first call and the first result by turn count; n_calls and n_results
    say how many there were. ``status`` is linked, early (the result stands
    before its call), unanswered or orphan.
    """
    called = _identified(calls.withColumn("role", F.lit("call"))).where("conv_id is not null")
    answered = _identified(results.withColumn("role", F.lit("result"))).where("conv_id is not null")
    first_call = called.groupBy(*_KEY).agg(F.min(F.struct("turn", "name", "arguments", "after")).alias("c"), F.count(F.lit(1)).alias("n_calls"))
    first_result = answered.groupBy(*_KEY).agg(F.min(F.struct("turn", "content")).alias("r"), F.count(F.lit(1)).alias("n_results"))
    status = (
        F.when(F.col("r").isNull(), "unanswered").when(F.col("c").isNull(), "orphan").when(F.col("r.turn") < F.col("c.turn"), "early").otherwise("linked")
    )
    return first_call.join(first_result, _KEY, "full").select(
        *_KEY,
        F.col("c.turn").alias("call_turn"),
        F.col("c.name").alias("name"),
        F.col("c.arguments").alias("arguments"),
        F.col("c.after").alias("after"),
        F.col("r.turn").alias("result_turn"),
        F.col("r.content").alias("content"),
        F.coalesce("n_calls", F.lit(0)).cast("bigint").alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).cast("bigint").alias("n_results"),
        status.alias("status"),
    )


def linked_in_turn(calls: DataFrame, results: DataFrame) -> DataFrame:
    """As ``linked``, but a row for every call and every result: the n-th of an identifier's
    calls by turn with the n-th of its results, n being ``occurrence``. n_calls and n_results
    are 1 or 0. Rows without conv_id link with nothing.
    """
    called = _identified(calls.withColumn("role", F.lit("call")))
    answered = _identified(results.withColumn("role", F.lit("result")))
    by_call = [F.col(c) for c in ("turn", "name", "arguments", "after")]
    nth_call = distributed_row_number(called, _KEY, by_call, "occurrence")
    nth_result = distributed_row_number(answered, _KEY, [F.col("turn"), F.col("content")], "occurrence")
    left = nth_call.select(*_KEY, "occurrence", F.struct("turn", "name", "arguments", "after").alias("c"))
    right = nth_result.select(*_KEY, "occurrence", F.struct("turn", "content").alias("r"))
    status = (
        F.when(F.col("r").isNull(), "unanswered").when(F.col("c").isNull(), "orphan").when(F.col("r.turn") < F.col("c.turn"), "early").otherwise("linked")
    )
    return left.join(right, [*_KEY, "occurrence"], "full").select(
        *_KEY,
        "occurrence",
        F.col("c.turn").alias("call_turn"),
        F.col("c.name").alias("name"),
        F.col("c.arguments").alias("arguments"),
        F.col("c.after").alias("after"),
        F.col("r.turn").alias("result_turn"),
        F.col("r.content").alias("content"),
        F.col("c").isNotNull().cast("bigint").alias("n_calls"),
        F.col("r").isNotNull().cast("bigint").alias("n_results"),
        status.alias("status"),
    )


def levels(links: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): 0 for a call that waits for no other, else one more than the last it waits for.

    Only calls of the same conversation count in ``after``. Calls on a cycle,
    or behind one, have no row. Chains of calls that wait for one call each are
    followed by doubling steps, so a chain takes a logarithm of its length in
    rounds; after that a round is needed only for each call on a path that
    waits for several others.
    """
    calls = links.where("n_calls > 0").select(*_KEY, "after")
    waits = calls.select("conv_id", "call_id", F.explode(F.array_distinct("after")).alias("needed")).where("needed is not null")
    known = calls.select("conv_id", F.col("call_id").alias("needed"))
    return _levels(calls, waits.join(known, ["conv_id", "needed"], "left_semi"))


def levels_in_turn(links: DataFrame) -> DataFrame:
    """(conv_id, call_id, occurrence, level) of the calls of ``linked_in_turn``, as ``levels``.

    The n-th call of an identifier waits for the n-th call of each it names, or the last one if it has fewer.
    """
    node = lambda n: F.concat(n.cast("string"), F.lit(" "), F.col("_id"))
    calls = materialize(
        links.where("n_calls > 0 and conv_id is not null").withColumnRenamed("call_id", "_id").select("conv_id", "_id", "occurrence", node(F.col("occurrence")).alias("call_id"), "after")
    )
    known = calls.groupBy("conv_id", "_id").agg(F.max("occurrence").alias("_last"))
    waits = calls.select("conv_id", "call_id", "occurrence", F.explode(F.array_distinct("after")).alias("_id"))
    needed = waits.join(known, ["conv_id", "_id"]).select(*_KEY, node(F.least("occurrence", "_last")).alias("needed"))
    found = _levels(calls.select(*_KEY), needed)
    return calls.join(found, _KEY).select("conv_id", F.col("_id").alias("call_id"), "occurrence", "level")


def _levels(calls: DataFrame, waits: DataFrame) -> DataFrame:
    """``levels`` of ``calls`` (conv_id, call_id) by ``waits`` (conv_id, call_id, needed), whose ends are all calls."""
    waits = materialize(waits)
    counted = materialize(waits.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("needs"), F.min("needed").alias("to")))
    hops = materialize(counted.where("needs = 1").select(*_KEY, "to", F.lit(1).cast("bigint").alias("far")))
    longest = hops.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(longest.bit_length()):
        further = hops.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("_to"), F.col("far").alias("_far"))
        hops = materialize(
            hops.join(further, ["conv_id", "to"], "left").select(
                *_KEY, F.coalesce("_to", "to").alias("to"), (F.col("far") + F.coalesce("_far", F.lit(0))).alias("far")
            )
        )
    # Calls that wait for several: each wait leads to where its chain ends.
    ends = hops.select("conv_id", F.col("call_id").alias("needed"), F.col("to").alias("_to"), F.col("far").alias("_far"))
    several = waits.join(counted.where("needs > 1"), _KEY, "left_semi")
    open_waits = materialize(
        several.join(ends, ["conv_id", "needed"], "left").select(
            *_KEY, F.coalesce("_to", "needed").alias("end"), (F.coalesce("_far", F.lit(0)) + 1).alias("far")
        )
    )
    placed = materialize(calls.join(counted, _KEY, "left_anti").select(*_KEY, F.lit(0).cast("bigint").alias("level")))
    while True:
        known = placed.select("conv_id", F.col("call_id").alias("end"), "level")
        reached = open_waits.join(known, ["conv_id", "end"], "left").groupBy(*_KEY).agg(
            F.max(F.col("level") + F.col("far")).alias("level"), F.count_if(F.col("level").isNull()).alias("open")
        )
        fresh = materialize(reached.where("open = 0").select(*_KEY, "level"))
        if fresh.isEmpty():
            break
        placed = materialize(placed.unionByName(fresh))
        open_waits = materialize(open_waits.join(fresh, _KEY, "left_anti"))
    chained = hops.join(placed.select("conv_id", F.col("call_id").alias("to"), "level"), ["conv_id", "to"])
    every = placed.unionByName(chained.select(*_KEY, (F.col("level") + F.col("far")).alias("level")))
    return every.withColumn("level", F.col("level").cast("int"))


def errors_of(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """What is wrong with a call's arguments, as an array of texts in a fixed order; empty if nothing."""
    value = F.try_parse_json(arguments)
    broken = F.when(value.isNull(), F.array(F.lit("not JSON"))).when(
        ~F.schema_of_variant(value).startswith("OBJECT<"), F.array(F.lit("not an object"))
    )
    chosen = F.when(F.lit(False), F.array(F.lit("")))
    for function, parameters in schemas.items():
        found = []
        for parameter, (kind, required) in sorted(parameters.items()):
            path = f"$.{parameter}"
            given = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
            absent = given.isNull() | (given == "VOID")
            if required:
                found.append(F.when(absent, F.lit(f"{parameter} is missing")))
            found.append(F.when(~absent & ~given.rlike(_KINDS[kind]), F.lit(f"{parameter} is not {kind}")))
        extra = F.array_sort(F.array_except(F.json_object_keys(arguments), F.array(*[F.lit(p) for p in sorted(parameters)])))
        unknown = F.transform(F.coalesce(extra, F.array().cast("array<string>")), lambda p: F.concat(p, F.lit(" is unknown")))
        chosen = chosen.when(name == function, F.concat(F.array_compact(F.array(*found)), unknown))
    return F.coalesce(broken, chosen, F.array(F.lit("unknown function")))


def canonical(row: dict[str, Column], arguments: Column) -> Column:
    """One JSON object: keys in order at every depth, no blanks, absent fields left out.

    A variant keeps its object keys sorted; arguments that are not JSON stand
    as text in ``arguments_text``.
    """
    value = F.try_parse_json(arguments)
    fields = row | {"arguments": value, "arguments_text": F.when(value.isNull(), arguments)}
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def formatted(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """(conv_id, position, call_id, status, level, valid, errors, json) of each identifier's first call and result.

    ``every_occurrence`` returns all of them. Positions (from 1) order a conversation's identifiers topologically: a call
    comes after all calls it waits for; calls of equal level by turn, then
    identifier. Calls on a cycle follow (level null), then orphan results.
    ``valid`` and ``errors`` are null for orphans. Rows without conv_id are left
    out; a call or result without identifier links with nothing; null names and
    arguments are invalid. Empty tables give no rows. Other columns are ignored.
    """
    links = materialize(
        linked(calls.select("conv_id", "turn", "call_id", "name", "arguments", "after"), results.select("conv_id", "turn", "call_id", "content"))
    )
    return _written(links.join(levels(links), _KEY, "left"), _KEY, schemas)


def every_occurrence(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """As ``formatted``, but with a row for every call and every result, and ``occurrence`` behind call_id.

    See ``linked_in_turn`` and ``levels_in_turn``. Rows without conv_id stay:
    they link with nothing and wait for nothing.
    """
    links = materialize(
        linked_in_turn(calls.select("conv_id", "turn", "call_id", "name", "arguments", "after"), results.select("conv_id", "turn", "call_id", "content"))
    )
    key = [*_KEY, "occurrence"]
    ordered = links.join(levels_in_turn(links), key, "left")
    alone = F.col("conv_id").isNull() & (F.col("n_calls") > 0)
    return _written(ordered.withColumn("level", F.when(alone, 0).otherwise(F.col("level"))), key, schemas)


def _written(ordered: DataFrame, key: list[str], schemas: Schemas) -> DataFrame:
    """Links with their levels checked, serialised and numbered."""
    errors = F.when(F.col("n_calls") > 0, errors_of(F.coalesce("name", F.lit("")), F.coalesce("arguments", F.lit("")), schemas))
    fields = ("call_id", "content", "name", "status", "call_turn", "result_turn")
    checked = ordered.select(
        *key,
        "status",
        "level",
        F.coalesce("call_turn", "result_turn").alias("_turn"),
        (F.size(errors) == 0).alias("valid"),
        F.array_join(errors, "; ").alias("errors"),
        F.when(F.col("n_calls") == 0, 2).when(F.col("level").isNull(), 1).otherwise(0).alias("_class"),
        canonical({f: F.col(f) for f in fields}, F.when(F.col("n_calls") > 0, F.coalesce("arguments", F.lit("")))).alias("json"),
    )
    checked = checked.withColumn("valid", F.when(F.col("_class") < 2, F.col("valid")))
    order = [F.col("_class"), F.col("level"), F.col("_turn"), *[F.col(c) for c in key[1:]]]
    numbered = distributed_row_number(checked, ["conv_id"], order, "position")
    return numbered.select("conv_id", "position", *key[1:], "status", "level", "valid", "errors", "json")
