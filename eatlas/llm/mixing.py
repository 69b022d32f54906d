"""Mixing sources to target weights, block by block.

The words of a source, document after document, are packed into blocks of fixed
length. The mix is a row of slots in output shards, a block each. For every
shard the number of slots of each source is drawn from a multinomial
distribution; the n-th slot of a source takes the block that a pseudorandom
permutation of the source's blocks gives for n, a new permutation for each pass
through the source. Blocks meet their words in a join by source and index.

Drawn totals stray from the targets by chance, so slots beyond a source's
target are handed to the sources that fell short; every source then has exactly
its blocks, and none is taken more than twice.

A source may hold any share of the rows: running sums and row numbers are over
a range partitioning by source and order, and blocks are joined by index.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import LongType

from ..operators.skew import materialize
from .common import packed, text_bytes, unpacked

WEIGHTS = (5, 2, 1)
TOTAL = 1.5
MOST = 2
BLOCK = 128
SHARD_SLOTS = 4096
# Numbers of a range that one row explodes into.
_RANGE = 100_000
SEED = 42

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@F.pandas_udf(LongType())
def word_count(text: pd.Series) -> pd.Series:
    """Words of a text in bytes; bytes.split() parts at the ASCII white space only."""
    return pd.Series([0 if t is None else len(bytes(t).split()) for t in text], dtype="int64")


def running_sums(df: DataFrame, group: list[str], order: list[Column], sums: dict[str, str]) -> DataFrame:
    """For each name in ``sums`` the sum of its column over the earlier rows of the group, by ``order``.

    Rows are range-partitioned by group and order, so a large group spreads over
    many tasks; sums of the earlier partitions are added from a table of one row
    per group and partition. No group column may be null.
    """
    dealt = df.repartitionByRange(*[F.col(g) for g in group], *order).withColumn("_part", F.spark_partition_id())
    stored = materialize(dealt)
    totals = stored.groupBy(*group, "_part").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*group, "_part", *[F.sum(f"_t_{n}").over(before).alias(f"_b_{n}") for n in sums])
    inside = W.partitionBy(*group, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    summed = stored.withColumns({f"_i_{n}": F.sum(c).over(inside) for n, c in sums.items()})
    joined = summed.join(offsets, [*group, "_part"])
    return joined.select(
        *df.columns,
        *[(F.coalesce(f"_i_{n}", F.lit(0)) + F.coalesce(f"_b_{n}", F.lit(0))).alias(n) for n in sums],
    )


def sized(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, _none, _name, size, more): a null source is a source of its own, after all others."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").isNull().alias("_none"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_name"),
        word_count(text_bytes()).alias("size"),
        *more,
    )


# --- targets ---------------------------------------------------------------------------

_SOURCE = ["_none", "_name"]


def source_targets(stored: DataFrame, weights: tuple = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """(_none, _name, source_size, weight, target) of every source in ``stored``.

    Sources by code point, null last, get the weights in turn. Targets share
    ``total`` of all sizes by weight; one that would pass ``most`` times its
    source's size stops there and the rest share the excess. So a target is
    ``min(most * size, level * weight)``. With the sources in order of size per
    weight, the first ones stop; the level is the largest of those that follow
    from stopping the first 0, 1, 2, ... sources.
    """
    by_source = stored.groupBy(*_SOURCE).agg(F.sum("size").alias("source_size"))
    listed = by_source.withColumns({"_all": F.lit(0), "_one": F.lit(1)})
    ranked = running_sums(listed, ["_all"], [F.col(c) for c in _SOURCE], {"_rank": "_one"})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    weighted = ranked.withColumn("weight", weight).withColumn("_ratio", F.col("source_size") / F.col("weight"))
    order = [F.col("_ratio"), *[F.col(c) for c in _SOURCE]]
    filled = materialize(running_sums(weighted, ["_all"], order, {"_stopped": "source_size", "_weight": "weight"}))
    size, weights_sum = filled.agg(F.sum("source_size"), F.sum("weight")).first()
    if size is None:
        return filled.select(*_SOURCE, "source_size", "weight", F.lit(0.0).alias("target"))
    level = (total * size - most * F.col("_stopped")) / (weights_sum - F.col("_weight"))
    top = filled.agg(F.max(level)).first()[0]
    target = F.least(most * F.col("source_size").cast("double"), top * F.col("weight"))
    return filled.select(*_SOURCE, "source_size", "weight", target.alias("target"))


# --- the mix ---------------------------------------------------------------------------


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Image of each index under a pseudorandom permutation of ``range(size)``, chosen by ``key``.

    Four Feistel rounds on the smallest even number of bits that holds ``size``;
    an image beyond ``size`` is sent through again until it falls inside.
    """
    size = size.astype(np.uint64)
    half = np.ones(len(size), np.uint64)
    while (short := (np.uint64(1) << (half * np.uint64(2))) < size).any():
        half += short.astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    value, key = index.astype(np.uint64), key.astype(np.uint64)
    todo = np.arange(len(value))
    while len(todo):
        h, m, k, v = half[todo], low[todo], key[todo], value[todo]
        left, right = v >> h, v & m
        for step in range(4):
            mixed = (right + k + np.uint64(step + 1)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(32)
            left, right = right, left ^ (mixed & m)
        value[todo] = (left << h) | right
        todo = todo[value[todo] >= size[todo]]
    return value.astype(np.int64)


@F.pandas_udf(LongType())
def _permuted(index: pd.Series, size: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(permuted(index.to_numpy(), size.to_numpy(), key.to_numpy().view(np.uint64)))


def _each_of(rows: DataFrame, first: str, last: str, name: str, most: int) -> DataFrame:
    """``rows`` once for each number from ``first`` to ``last``, as ``name``; ``most`` is about how many there are in all.

    Ranges are cut into bounded pieces, which are dealt out before they are exploded.
    """
    begin, end = F.col(first).cast("bigint"), F.col(last).cast("bigint")
    pieces = rows.withColumn("_piece", F.explode(F.sequence(begin, end, F.lit(_RANGE).cast("bigint"))))
    tasks = min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), most // _RANGE + 1)
    dealt = pieces.repartition(tasks, *_SOURCE, "_piece")
    numbers = F.sequence(F.col("_piece"), F.least(F.col("_piece") + F.lit(_RANGE - 1), end))
    return dealt.withColumn(name, F.explode(numbers)).drop("_piece")


def drawn_blocks(targets: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """(_none, _name, shard, pass, block): the block in every slot of the mix.

    A source's slots are its target over the mean length of its blocks.
    """
    spans = targets.where("source_size > 0").withColumn("_blocks", F.ceil(F.col("source_size") / block))
    slots = F.floor(F.col("target") * F.col("_blocks") / F.col("source_size") + 0.5)
    wanted = spans.withColumns({"_slots": slots, "_all": F.lit(0)})
    tickets = materialize(running_sums(wanted, ["_all"], [F.col(c) for c in _SOURCE], {"_ticket": "_slots"}))
    total = tickets.agg(F.sum("_slots")).first()[0] or 0
    spark = targets.sparkSession
    # Each slot draws a ticket; counts by shard and source are multinomial. Spark takes
    # exploded ranges for as small as their sources, hence the hints against a broadcast.
    ticket = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(total, 1))).alias("_ticket")
    draws = spark.range(total).select(F.floor(F.col("id") / shard_slots).alias("shard"), ticket)
    owned = tickets.where("_slots > 0").select(*_SOURCE, F.col("_ticket").alias("_from"), (F.col("_ticket") + F.col("_slots") - 1).alias("_to"))
    owners = _each_of(owned, "_from", "_to", "_ticket", total).select(*_SOURCE, "_ticket")
    counts = draws.join(owners.hint("merge"), "_ticket").groupBy("shard", *_SOURCE).agg(F.count(F.lit(1)).alias("_count"))
    numbered = materialize(running_sums(counts, _SOURCE, [F.col("shard")], {"_first": "_count"}))
    # What a source drew beyond its slots goes to those that drew too few.
    drew = numbered.groupBy(*_SOURCE).agg(F.sum("_count").alias("_drew"))
    balance = tickets.join(drew, _SOURCE, "left").withColumn("_drew", F.coalesce("_drew", F.lit(0)))
    balance = balance.withColumns(
        {"_over": F.greatest(F.col("_drew") - F.col("_slots"), F.lit(0)), "_under": F.greatest(F.col("_slots") - F.col("_drew"), F.lit(0))}
    ).select(*_SOURCE, "_all", "_slots", "_blocks", "_drew", "_over", "_under")
    balance = materialize(running_sums(balance, ["_all"], [F.col(c) for c in _SOURCE], {"_over_before": "_over", "_under_before": "_under"}))
    every = numbered.join(balance.select(*_SOURCE, "_slots", "_blocks", "_over_before"), _SOURCE).select(
        *_SOURCE,
        "shard",
        "_slots",
        "_blocks",
        "_over_before",
        F.explode(F.sequence(F.col("_first").cast("bigint"), (F.col("_first") + F.col("_count") - 1).cast("bigint"))).alias("_n"),
    )
    own = every.where("_n < _slots").select(*_SOURCE, "shard", "_blocks", "_n")
    spare = every.where("_n >= _slots").select("shard", (F.col("_over_before") + F.col("_n") - F.col("_slots")).alias("_e"))
    lacking = balance.where("_under > 0").select(*_SOURCE, "_blocks", "_under_before", "_drew", (F.col("_slots") - 1).alias("_to"))
    short = _each_of(lacking, "_drew", "_to", "_n", total)
    short = short.select(*_SOURCE, "_blocks", "_n", (F.col("_under_before") + F.col("_n") - F.col("_drew")).cast("bigint").alias("_e"))
    given = spare.withColumn("_e", F.col("_e").cast("bigint")).join(short.hint("merge"), "_e").select(*_SOURCE, "shard", "_blocks", "_n")
    slots = own.unionByName(given).withColumn("pass", F.floor(F.col("_n") / F.col("_blocks")))
    key = F.xxhash64("_none", "_name", "pass", F.lit(seed))
    index = _permuted(F.pmod(F.col("_n"), F.col("_blocks")), F.col("_blocks").cast("bigint"), key)
    return slots.select(*_SOURCE, "shard", "pass", index.alias("block"))


def word_pieces(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows of ``placed`` (with _start and size) once for each block they have words in, with _from and _words."""
    first, last = F.floor(F.col("_start") / block), F.floor((F.col("_start") + F.col("size") - 1) / block)
    cut = placed.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("block") * block, F.col("_start"))
    end = F.least((F.col("block") + 1) * block, F.col("_start") + F.col("size"))
    return cut.withColumns({"_from": (begin - F.col("_start")).cast("bigint"), "_words": (end - begin).cast("bigint")})


def _placed(docs: DataFrame, *more: Column, distinct: bool = False) -> tuple[DataFrame, DataFrame]:
    """Sizes of documents, and their first word's place in their source."""
    rows = sized(docs, *more)
    stored = materialize(rows.distinct() if distinct else rows)
    order = [F.col(c) for c in stored.columns if c not in _SOURCE]
    return stored, materialize(running_sums(stored, _SOURCE, order, {"_start": "size"}))


def mix_digest(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of ``docs`` (doc_id, text, source).

    ``taken`` counts the words that the mix takes from the document, repeats
    included. Documents without words (null or blank texts) have size 0 and
    give nothing. A row without doc_id and repeated rows are documents like any
    other. Other columns are ignored.
    """
    stored, placed = _placed(docs)
    targets = materialize(source_targets(stored))
    times = drawn_blocks(targets, block, shard_slots, seed).groupBy(*_SOURCE, "block").agg(F.count(F.lit(1)).alias("_times"))
    pieces = word_pieces(placed, block).join(times.hint("merge"), [*_SOURCE, "block"])
    used = pieces.groupBy(*_SOURCE, "_start").agg(F.sum(F.col("_words") * F.col("_times")).alias("taken"))
    # A document with words is known by its place in its source.
    rows = placed.withColumn("_start", F.when(F.col("size") > 0, F.col("_start"))).join(used, [*_SOURCE, "_start"], "left")
    return rows.join(targets, _SOURCE).select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken")
    )


def spans_of(text: str, ranges: list[tuple[int, int]]) -> str:
    """The stretches of a text from word a to word b of each range, one a line."""
    data = text.encode()
    found = [(m.start(), m.end()) for m in _WORD.finditer(data)]
    return "\n".join(data[found[a][0] : found[b - 1][1]].decode("utf-8", "replace") for a, b in ranges)


def merged_ranges(starts: list[int], lengths: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, n in sorted(zip(starts, lengths, strict=True)):
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], a + n)
        else:
            out.append((a, a + n))
    return out


def mixed_documents(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """The mix as rows of ``docs``: a row for each pass that takes words of a document.

    A pass that takes all of a document's words gives its text as it is;
    otherwise the text is the stretches taken, in order, one a line. Rows that
    agree in doc_id, source and text share one place in the mix.
    """
    version = F.xxhash64("text").alias("_version")
    stored, placed = _placed(docs, version, distinct=True)
    targets = materialize(source_targets(stored))
    slots = drawn_blocks(targets, block, shard_slots, seed)
    pieces = word_pieces(placed, block).join(slots.hint("merge"), [*_SOURCE, "block"])
    # As many ranges as the document has blocks.
    taken = pieces.groupBy("doc_id", "_version", *_SOURCE, "pass", "size").agg(
        F.collect_list("_from").alias("_at"), F.collect_list("_words").alias("_long"), F.sum("_words").alias("_sum")
    )

    @F.pandas_udf("string")
    def cut(text: pd.Series, at: pd.Series, long: pd.Series) -> pd.Series:
        values = [None if t is None else spans_of(t, merged_ranges(list(a), list(n))) for t, a, n in zip(text, at, long, strict=True)]
        return pd.Series(values, dtype=object)

    taken = taken.withColumnsRenamed({c: f"_m_{c}" for c in taken.columns})
    rows = packed(docs, _id=F.col("doc_id").cast("bigint"), _hash=F.xxhash64("text"), _empty=F.col("source").isNull(), _from=F.coalesce(F.col("source").cast("string"), F.lit("")))
    same = (
        F.col("_id").eqNullSafe(F.col("_m_doc_id"))
        & (F.col("_hash") == F.col("_m__version"))
        & (F.col("_empty") == F.col("_m__none"))
        & (F.col("_from") == F.col("_m__name"))
    )
    joined = rows.join(taken.hint("merge"), same)
    part = F.col("_m__sum") < F.col("_m_size")
    text = F.col("_row.text")
    short = joined.withColumn("_cut", cut(F.when(part, text), "_m__at", "_m__long"))
    return unpacked(short, docs.columns, text=F.when(part, F.col("_cut")).otherwise(text))
