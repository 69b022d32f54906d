"""Resumable enrichment: search results are matched as they land.

Each micro-batch appends its outcomes and its ledger entries; the stream's
checkpoint remembers which result files were done, so a stopped run goes on
where it ended.

``enrich_landed_hits`` decides on a place with the first batch that has hits of
it. ``enrich_complete_hits`` keeps the best hit so far of every place as state
and decides when all have landed, in however many files and batches.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schema
from ..functions import fixed_values as V
from ..operators import matching
from ..operators.skew import spread
from ..sources.readers import if_exists

HITS = (
    "restaurant_id string, hit_id string, hit_ord bigint, place_name string, distance string,"
    " category_group_code string, road_address_name string, address_name string, place_url string"
)


def enrich_landed_hits(
    spark: SparkSession,
    hits_path: str,
    places: DataFrame,
    out_path: str,
    checkpoint_path: str,
    checked_at: str,
    policy_version: int = V.MATCH_POLICY_VERSION,
    max_files_per_batch: int = 100,
) -> StreamingQuery:
    """Process all landed result files, then stop.

    A place's results must land in one file. A place the search found nothing
    for lands as a row without ``hit_id``. Writes ``{out}/places`` (one folder
    per batch, replaced when a batch is repeated) and ``{out}/ledger``.
    """
    hits = (
        spark.readStream.schema(HITS).option("maxFilesPerTrigger", max_files_per_batch).json(hits_path)
    )

    def process(batch: DataFrame, batch_id: int) -> None:
        searched = batch.select(F.col("restaurant_id").alias("id")).distinct()
        ledger = _ledger(spark, out_path).where(F.col("batch") != batch_id)
        todo = matching.pending(places.join(searched, "id", "left_semi"), ledger, policy_version)
        found = batch.where(F.col("hit_id").isNotNull())
        done = matching.apply_matches(todo, matching.best_place_hits(todo, found), checked_at)
        done.write.mode("overwrite").parquet(f"{out_path}/places/batch={batch_id}")
        entries = matching.ledger_rows(todo, policy_version, checked_at)
        entries.write.mode("overwrite").parquet(f"{out_path}/ledger/batch={batch_id}")

    return (
        hits.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )


def _ledger(spark: SparkSession, out_path: str) -> DataFrame:
    stored = if_exists(
        lambda: spark.read.schema(f"{schema.LEDGER}, batch bigint").parquet(f"{out_path}/ledger")
    )
    return spark.createDataFrame([], f"{schema.LEDGER}, batch bigint") if stored is None else stored


# What is known of a place: its best hit so far, the rows seen and expected, whether it was decided (once, and by
# this batch), and until when it waits.
_BEST = "struct<inexact: boolean, distance_meters: double, hit_ord: bigint, hit_id: string, place_url: string>"
_KNOWN = f"id string, best {_BEST}, seen bigint, expected bigint, closed boolean, decided boolean, deadline bigint"


def _arrived(judged: DataFrame) -> DataFrame:
    """What one batch tells of each place it has rows of."""
    hit = F.struct((~F.col("exact")).alias("inexact"), "distance_meters", "hit_ord", "hit_id", "place_url")
    return judged.groupBy("id").agg(
        F.min(F.when(F.col("fits"), hit)).alias("_best"),
        F.count("hit_id").alias("_seen"),
        F.max("hit_count").alias("_expected"),
    )


def _advanced(known: DataFrame, arrived: DataFrame, now: int, wait: int) -> DataFrame:
    """What is known of every place after a batch that came at ``now``, times in milliseconds.

    A place is ``decided`` when all its hits have landed, when its time is up,
    and when a later hit is better than the one it was decided on.
    """
    touched, closed = F.col("_seen").isNotNull(), F.coalesce("closed", F.lit(False))
    best, seen = F.least("best", "_best"), F.coalesce("seen", F.lit(0)) + F.coalesce("_seen", F.lit(0))
    expected = F.greatest("expected", "_expected")
    complete = touched & F.coalesce(seen >= expected, F.lit(False))
    late = ~touched & ~closed & (F.col("deadline") < now)
    ended = closed | late | complete
    return known.join(arrived, "id", "full").select(
        "id",
        best.alias("best"),
        seen.alias("seen"),
        expected.alias("expected"),
        ended.alias("closed"),
        F.when(closed, touched & ~best.eqNullSafe(F.col("best"))).otherwise(ended).alias("decided"),
        F.when(~ended, F.when(touched, F.lit(now + wait + 1)).otherwise(F.col("deadline"))).alias("deadline"),
    )


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def enrich_complete_hits(
    spark: SparkSession,
    hits_path: str,
    places: DataFrame,
    out_path: str,
    checkpoint_path: str,
    checked_at: str,
    ledger: DataFrame | None = None,
    policy_version: int = V.MATCH_POLICY_VERSION,
    wait_seconds: float = 600.0,
    max_files_per_batch: int = 100,
) -> StreamingQuery:
    """Match every place once all of its hits have landed; process all landed files, then stop.

    Files have the columns of ``HITS`` and ``hit_count``, the number of hits
    that the search found for the place (zero: one row without ``hit_id``). A
    place is decided when that many have landed, or, where the number is
    unknown, by a timer ``wait_seconds`` after its last hits; timers run by the
    arrival of files, so a landed row without ``restaurant_id`` sets them off
    as well. A hit that comes after that and is better corrects the outcome.
    So the newest outcomes (:func:`outcomes`) are those of all hits at once,
    however they were dealt over files, batches and restarts.

    State is one best hit a place, whatever the number of hits; it is kept for
    corrections until the checkpoint is given up, as with a new
    ``policy_version``. Places that ``ledger`` has under the policy are left
    out. Writes ``{out}/places`` and ``{out}/ledger``, a folder for each batch
    that decided something; a repeated batch replaces its folder. The state
    lies in ``{checkpoint}/known``, written whole by each batch from the one
    before, of which the last two are kept.
    """
    todo = places if ledger is None else matching.pending(places, ledger, policy_version)
    hits = (
        spark.readStream.schema(f"{HITS}, hit_count bigint").option("maxFilesPerTrigger", max_files_per_batch).json(hits_path)
    )
    known_path = f"{checkpoint_path}/known/batch="

    def process(batch: DataFrame, batch_id: int) -> None:
        known = spark.read.schema(_KNOWN).parquet(f"{known_path}{batch_id - 1}") if batch_id else spark.createDataFrame([], _KNOWN)
        arrived = _arrived(matching.judged_hits(spread(todo.select("id", "name", "address")), batch))
        now = int(time.time() * 1000)
        _advanced(known, arrived, now, int(wait_seconds * 1000)).write.mode("overwrite").parquet(f"{known_path}{batch_id}")
        _delete(spark, f"{known_path}{batch_id - 2}")
        found = spark.read.schema(_KNOWN).parquet(f"{known_path}{batch_id}").where("decided").select(
            "id",
            F.col("best.hit_id").alias("hit_id"),
            F.col("best.place_url").alias("hit_url"),
            F.when(F.col("best.inexact"), V.MATCHED_BY_COORDINATES).otherwise(V.MATCHED_BY_ADDRESS).alias("matched_by"),
            F.col("best.distance_meters").alias("distance_meters"),
        )
        if found.isEmpty():
            return
        searched = todo.join(found.select("id"), "id", "left_semi")
        done = matching.apply_matches(searched, found, checked_at)
        done.write.mode("overwrite").parquet(f"{out_path}/places/batch={batch_id}")
        entries = matching.ledger_rows(searched, policy_version, checked_at)
        entries.write.mode("overwrite").parquet(f"{out_path}/ledger/batch={batch_id}")

    return (
        hits.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )


def outcomes(spark: SparkSession, out_path: str) -> DataFrame:
    """The newest outcome of every place that :func:`enrich_complete_hits` decided, in the columns of places."""
    stored = if_exists(lambda: spark.read.parquet(f"{out_path}/places"))
    if stored is None:
        return spark.createDataFrame([], schema.PLACE)
    newest = stored.groupBy("id").agg(F.max("batch").alias("batch"))
    return stored.join(newest, ["id", "batch"]).drop("batch")
