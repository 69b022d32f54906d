"""Readers, tile store, reports, the stream, and the query registry."""

import json
import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from eatlas import schema  # noqa: E402
from eatlas.functions import fixed_values as V  # noqa: E402
from eatlas.operators.quality import QualityError  # noqa: E402
from eatlas.operators.spatial import radius_join  # noqa: E402
from eatlas.plans import serving  # noqa: E402
from eatlas.operators import snapshot  # noqa: E402
from eatlas.sources import readers, reports, snapshots, tiles  # noqa: E402
from eatlas.operators import matching, recommend  # noqa: E402
from eatlas.streaming.enrichment import HITS, enrich_complete_hits, enrich_landed_hits, outcomes  # noqa: E402
from tests.test_operators import CONFIRMED, hit, place, places  # noqa: E402


def test_json_places_keep_their_order(spark, tmp_path):
    rows = [
        {"id": "b", "name": "하나", "category": "한식", "province": "p", "district": "d", "address": "a", "latitude": 37.1, "longitude": 127.0,
         "menus": [{"name": "국밥", "price": 9000}], "kakaoPlaceId": "", "placeVerification": {"provider": "kakao", "status": "unverified", "checkedAt": "t"}},
        {"id": "a", "name": "둘", "category": "한식", "province": "p", "district": "d", "address": "a", "latitude": 37, "longitude": 127, "phone": "1",
         "menus": [], "kakaoPlaceId": "7", "geocoding": {"debug": 1}},
    ]
    path = tmp_path / "places.json"
    path.write_text(json.dumps(rows, ensure_ascii=False, indent=1), encoding="utf8")
    got = readers.read_places_json(spark, str(path)).orderBy("ord").collect()
    assert [(r.ord, r.id, r.place_id, r.phone) for r in got] == [(0, "b", None, None), (1, "a", "7", "1")]
    assert [tuple(m) for m in got[0].menus] == [("국밥", 9000)] and got[0].verification.status == "unverified"
    assert readers.read_places_json(spark, str(tmp_path / "none.json")).isEmpty()
    assert readers.read_places(spark, str(tmp_path / "none")).isEmpty()


def test_csv_with_quoted_cells(spark, tmp_path):
    path = tmp_path / "places.csv"
    path.write_bytes('식당(ID),식당명,모름,도로명주소\r\n"7","하나, ""본점""",x,"길 1\n2층"\r\n8,둘,y,\r\n'.encode())
    got = readers.read_place_file(spark, str(path)).orderBy("ord").collect()
    assert [(r.ord, r.RSTR_NM, r.ROAD_NM_ADDR) for r in got] == [(0, '하나, "본점"', "길 1\n2층"), (1, "둘", None)]
    assert "모름" not in got[0].asDict()


def test_landed_pages(spark, tmp_path):
    def page(folder, n, body):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / f"page-{n}.json").write_text(json.dumps(body, ensure_ascii=False), encoding="utf8")

    page("a", 1, {"data": [{"업소명": "하나", "가격1": 8000}, {"업소명": "둘", "가격1": "9,000"}], "totalCount": 3})
    page("a", 2, {"data": [{"업소명": "셋"}], "totalCount": 3})
    got = readers.read_wide_pages(spark, str(tmp_path / "a")).orderBy("ord").collect()
    assert [(r["업소명"], r["가격1"]) for r in got] == [("하나", "8000"), ("둘", "9,000"), ("셋", None)]
    page("b", 1, {"data": [{"업소명": "하나"}], "totalCount": 3})
    with pytest.raises(QualityError, match="1 of 3"):
        readers.read_wide_pages(spark, str(tmp_path / "b"))
    page("c", 1, {"header": {"resultCode": "00", "totalCount": 1}, "body": [{"RSTR_ID": 5, "MENU_NM": "밥"}]})
    menus = readers.read_body_pages(spark, str(tmp_path / "c"), V.MENU_FILE_HEADERS, "menu_ord").collect()
    assert [(m.RSTR_ID, m.MENU_NM) for m in menus] == [("5", "밥")]
    page("c", 2, {"header": {"resultCode": "30"}, "body": []})
    with pytest.raises(QualityError):
        readers.read_body_pages(spark, str(tmp_path / "c"), V.MENU_FILE_HEADERS, "menu_ord")


def test_build_and_answer(spark, tmp_path):
    root = str(tmp_path / "serving")
    rows = places(
        spark,
        place(1, place_id="1", check=CONFIRMED, lat=37.0, lon=127.0),
        place(2, place_id="1", check=CONFIRMED, lat=37.0, lon=127.0, name="하나 식당"),
        place(3, place_id="3", check=CONFIRMED, lat=37.3, lon=127.0, name="둘식당"),
        place(4, lat=37.0, lon=127.0, name="셋식당"),
    )
    serving.build_tiles(rows, root, "good-price", "1")
    serving.build_tiles(rows, root, "good-price", "2", policy="all")
    manifest = tiles.latest_manifest(spark, root, "good-price")
    row = manifest.first()
    assert (row.build, row.total_count, row.source_total_count, row.deduplicated_count, row.duplicate_group_count) == ("2", 3, 4, 1, 1)
    listed = tiles.manifest_tiles(spark, root, "good-price", "2")
    assert {r.tile: r["count"] for r in listed.collect()} == {"147_507": 2, "148_507": 1}
    tiles.require_manifest(manifest, listed, "good-price")
    with pytest.raises(QualityError):
        tiles.require_manifest(manifest, listed.limit(1), "good-price")
    assert set(tiles.manifest_map(listed).first().tiles) == {"147_507", "148_507"}
    requests = spark.createDataFrame(
        [(1, 37.0, 127.0, "전체", 10000.0, "walking", "10")],
        "request_id bigint, latitude double, longitude double, category string, budget double, travel_mode string, time_limit string")
    found = serving.answer_requests(spark, requests, root, "good-price")
    assert sorted(r.id for r in found.collect()) == ["r1", "r4"]
    # Only the folders of reachable tiles are scanned.
    wanted = recommend.with_limit(recommend.ready(requests))
    scan = tiles.read_tiles(spark, root, "good-price", tiles.required_tiles(wanted))
    assert "dynamicpruning" in scan._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(QualityError):
        serving.build_tiles(rows, root, "elsewhere", "3")
    # A build that was written but never published is not seen.
    tiles.write_tiles(rows, tiles.data_path(root, "good-price", "9"))
    assert tiles.latest_manifest(spark, root, "good-price").first().build == "2"


def test_tiles_over_the_seam_and_at_the_poles(spark):
    asks = [(10.0, 179.99, 9000.0), (10.0, -180.0, 9000.0), (89.98, 10.0, 6000.0), (-89.9, -179.9, 30000.0), (37.0, 127.0, 20000.0), (0.0, 0.0, 2.0e7)]
    rows = spark.createDataFrame([(i, *a) for i, a in enumerate(asks)], "n int, latitude double, longitude double, radius_meters double")
    found = [{r.tile for r in tiles.required_tiles(rows.where(rows.n == i)).collect()} for i in range(len(asks))]
    spots = [(10.0, -179.97), (10.0, 179.97), (10.02, 180.0), (89.97, 170.0), (89.99, -100.0), (90.0, 3.0), (-89.95, 0.0), (-89.99, 180.0), (37.1, 127.1)]
    near = spark.createDataFrame([(i, *s) for i, s in enumerate(spots)], "ord bigint, latitude double, longitude double")
    pairs = radius_join(rows, tiles.with_tiles(near)).collect()
    assert {(p.n, p.ord) for p in pairs} >= {(0, 0), (0, 1), (1, 1), (2, 3), (2, 4), (3, 6), (3, 7), (4, 8)}
    assert all(p.tile in found[p.n] for p in pairs)
    assert len(found[0]) <= 6 and len(found[1]) <= 6 and len(found[4]) <= 9


def test_serving_size(spark):
    rows = places(spark, place(1, url="http://x")).withColumnRenamed("district", "geocoding")
    assert tiles.optimize_for_serving(rows).first().place_url == "https://x"
    assert "geocoding" not in tiles.optimize_for_serving(rows).columns
    stats = tiles.optimize_stats(rows).first()
    assert stats.debug_removed == 1 and stats.bytes_after < stats.bytes_before


def test_stored_snapshots_are_compared_where_they_differ(spark, tmp_path):
    first = places(spark, place(1))
    columns = [c for c in first.columns if c not in ("id", "ord")]
    many = spark.range(2000).join(first.select(*columns).withColumn("_k", F.lit(0)), F.col("id") * 0 == F.col("_k"))
    old = many.select(F.concat(F.lit("r"), "id").alias("id"), F.col("id").alias("ord"), *columns)
    new = old.where("ord not in (7, 900)").withColumn("phone", F.when(F.col("ord").isin(3, 1500), "9").otherwise(F.col("phone")))
    # A field that was null becomes the blank text, two fields trade places, one id comes twice, two are new.
    new = new.withColumn("place_url", F.when(F.col("ord") == 44, "").otherwise(F.col("place_url")))
    more = old.where("ord < 3").withColumn("id", F.when(F.col("ord") < 2, F.concat(F.lit("n"), "ord")).otherwise(F.lit("r55")))
    new = new.unionByName(more.withColumn("ord", F.col("ord") + 5000).withColumn("name", F.lit("다른 집")))
    paths = [str(tmp_path / n) for n in ("old", "new", "small")]
    snapshots.write_snapshot(old, paths[0], rows_per_leaf=10)
    snapshots.write_snapshot(new, paths[1], rows_per_leaf=10)
    changes, compared = snapshots.diff_stored(spark, *paths[:2])
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(changes) == rows(snapshot.diff(old, new).select(*changes.columns))
    assert 0 < compared.count() < 400
    same, none = snapshots.diff_stored(spark, paths[0], paths[0])
    assert same.where("change <> 'unchanged'").count() == 0 and same.count() == 2000 and none.count() == 0
    # Trees of different depth, and an empty snapshot.
    few = old.where("ord < 30")
    snapshots.write_snapshot(few, paths[2], rows_per_leaf=100)
    assert rows(snapshots.diff_stored(spark, paths[2], paths[1])[0]) == rows(snapshot.diff(few, new).select(*changes.columns))
    empty = str(tmp_path / "empty")
    snapshots.write_snapshot(old.limit(0), empty)
    assert rows(snapshots.diff_stored(spark, empty, paths[2])[0]) == rows(snapshot.diff(old.limit(0), few).select(*changes.columns))
    assert snapshots.read_snapshot(spark, paths[2]).columns == old.columns


def test_reports_keep_history(spark, tmp_path):
    for run in ("20260101", "20260102"):
        reports.write_report(spark.createDataFrame([(run, 1)], "name string, n int"), str(tmp_path), "audit", run)
    assert reports.read_reports(spark, str(tmp_path), "audit").count() == 2
    assert reports.latest_report(spark, str(tmp_path), "audit").first().name == "20260102"


def test_stream_resumes(spark, tmp_path):
    rows = places(spark, place(1), place(2), place(3))
    landed, out, check = (str(tmp_path / n) for n in ("landed", "out", "check"))
    land = lambda *hits: spark.createDataFrame(list(hits), HITS).coalesce(1).write.mode("append").json(landed)
    run = lambda: enrich_landed_hits(spark, landed, rows, out, check, "t").awaitTermination(120)
    land(hit("r1", 1), ("r2", None, None, None, None, None, None, None, None))
    run()
    run()  # nothing new
    land(hit("r1", 5, distance="1"), hit("r3", 3))
    run()
    done = {r.id: (r.place_id, r.verification.status) for r in spark.read.schema(schema.PLACE).parquet(f"{out}/places").collect()}
    assert done == {"r1": ("h1", "confirmed"), "r2": (None, "unverified"), "r3": ("h3", "confirmed")}
    assert spark.read.parquet(f"{out}/ledger").count() == 3


def outcome(rows):
    return {r.id: (r.place_id, r.verification.status, r.verification.matched_by, r.verification.distance_meters) for r in rows.collect()}


def nothing(place):
    return (place, *[None] * 8)


def test_stream_waits_for_all_hits_of_a_place(spark, tmp_path):
    rows = places(spark, *[place(n) for n in range(1, 8)])
    landed, out, check = (str(tmp_path / n) for n in ("landed", "out", "check"))

    def land(*hits):
        df = spark.createDataFrame([(*h, n) for h, n in hits], f"{HITS}, hit_count bigint")
        df.coalesce(1).write.mode("append").json(landed)

    def run(wait=0.0):
        stream = enrich_complete_hits(spark, landed, rows, out, check, "t", ledger=done, wait_seconds=wait, max_files_per_batch=1)
        assert stream.awaitTermination(120)

    done = matching.ledger_rows(rows.where("id = 'r7'"))
    # r1 has three hits in two files, the best one last; r2 finds nothing; r3 says nothing of its number;
    # r5 says two and only one lands; r6 has a hit that does not fit; r7 was done before; r9 is no place.
    every = [
        [(hit("r1", 4, distance="90"), 3), (hit("r1", 2, distance="40"), 3), (nothing("r2"), 0), (hit("r3", 8), None)],
        [(hit("r5", 1), 2), (hit("r6", 6, distance="900"), 1), (hit("r7", 1), 1), (hit("r9", 1), 1)],
    ]
    for part in every:
        land(*part)
    run(wait=3600)
    assert outcome(outcomes(spark, out)).keys() == {"r2", "r6"}
    assert outcome(outcomes(spark, out))["r6"][1] == "unverified"
    # A restart, and the rest of r1 in a file of its own: decided by its count.
    land((hit("r1", 3, distance="5"), 3))
    run(wait=3600)
    assert outcome(outcomes(spark, out))["r1"] == ("h3", "confirmed", "name-coordinates", 5.0)
    assert outcome(outcomes(spark, out)).keys() == {"r1", "r2", "r6"}
    # A better hit beyond the count corrects the outcome; r4 waits for a timer, which the next batch sets off.
    land((hit("r1", 9, distance="1"), 3), (hit("r4", 7), None))
    run()
    land((nothing(None), None))
    run()
    assert outcome(outcomes(spark, out)).keys() == {"r1", "r2", "r4", "r6"}
    # However the hits landed, the outcomes are those of all of them at once.
    hits = spark.read.schema(HITS).json(landed).where("hit_id is not null")
    known = rows.join(outcomes(spark, out).select("id"), "id", "left_semi")
    assert outcome(outcomes(spark, out)) == outcome(matching.apply_matches(known, matching.best_place_hits(known, hits), "t"))
    assert outcomes(spark, str(tmp_path / "none")).count() == 0


def test_stream_state_is_kept_by_joins(spark, tmp_path):
    """Hits that only their links tell apart, in two files; a batch that is repeated; no place goes through Python by itself."""
    rows = places(spark, place(1), place(2), place(3))
    landed, out, check = (str(tmp_path / n) for n in ("landed", "out", "check"))

    def land(*hits):
        df = spark.createDataFrame([(*h, n) for h, n in hits], f"{HITS}, hit_count bigint")
        df.coalesce(1).write.mode("append").json(landed)

    def run(wait=0.0):
        stream = enrich_complete_hits(spark, landed, rows, out, check, "t", wait_seconds=wait, max_files_per_batch=1)
        assert stream.awaitTermination(120)
        return stream

    link = lambda h, url: (*h[:-1], url)
    land((link(hit("r1", 4), "http://b"), 2), (hit("r2", 5), None))
    run()
    assert outcome(outcomes(spark, out)) == {}
    land((link(hit("r1", 4), "http://a"), 2), (hit("r3", 6), 1))
    stream = run()
    assert "PandasWithState" not in stream._jsq.explainInternal(False)
    hits = spark.read.schema(HITS).json(landed)
    want = matching.apply_matches(rows, matching.best_place_hits(rows, hits), "t")
    links = lambda df: {(r.id, r.place_id, r.place_url) for r in df.collect()}
    assert links(outcomes(spark, out)) == links(want) and len(links(want)) == 3
    # The last batch again, as if the stream had stopped before it was noted as done.
    for name in ("1", ".1.crc"):
        (tmp_path / "check" / "commits" / name).unlink()
    run()
    assert links(outcomes(spark, out)) == links(want) and outcomes(spark, out).count() == 3


def test_judged_hits_are_the_best_ones(spark):
    rows = places(spark, place(1), place(2))
    hits = spark.createDataFrame(
        [hit("r1", 1, distance="600"), hit("r1", 2, name="other"), hit("r1", 3, distance=""), hit("r2", 4, distance="100"), hit("r2", 5, distance="20")], HITS
    )
    judged = matching.judged_hits(rows, hits)
    assert {r.hit_id for r in judged.where("fits").collect()} == {"h4", "h5"} and judged.count() == 5
    assert matching.best_place_hits(rows, hits).first().hit_id == "h5"


def test_registry_is_consistent():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) >= 60


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables not present")
@pytest.mark.parametrize(
    "name",
    [
        "candidates", "snapshot_changes", "best_place_hits", "classification", "wrapped_clusters", "continued_records", "gates",
        "nearest_places", "serving_size", "landed_body_pages", "map_links",
    ],
)
def test_query_equals_its_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for table in sorted(os.listdir(DATA)):
        db.execute(f"create view {table.split('.')[0]} as select * from '{DATA}/{table}'")
    df = entry.queries()[name](spark, DATA)
    cursor = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(cursor.fetchall(), key=str)
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=str) == want
