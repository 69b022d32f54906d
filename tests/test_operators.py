"""Matching, snapshots, audit, ingest, ranking and quality gates."""

import math
import random

import pytest
from pyspark.sql import functions as F

from eatlas import schema
from eatlas.functions import text
from eatlas.operators import audit, ingest, matching, measurements, quality, ranking, skew, snapshot
from eatlas.plans import auditing, enrichment
from eatlas.plans.refresh import refresh_normalized, refresh_wide
from eatlas.sources import reports

CONFIRMED = ("kakao", "confirmed", "name-address", 1.0, "t1")
UNVERIFIED = ("kakao", "unverified", None, None, "t1")


def place(ord_, id_=None, name="하나식당", category="한식", address="인천 중구 봄로 1", phone=None, lat=37.4, lon=126.6,
          menus=(("국밥", 9000),), place_id=None, url=None, check=None, province="인천광역시", district="중구"):
    return (ord_, id_ or f"r{ord_}", name, category, province, district, phone, address, lat, lon, list(menus), place_id, url, check)


def places(spark, *rows):
    return spark.createDataFrame(list(rows), schema.PLACE)


def hit(restaurant, n, name="하나 식당", distance="10", group="FD6", road=None, address=None, url="http://p/1"):
    return (restaurant, f"h{n}", n, name, distance, group, road, address, url)


HITS = ("restaurant_id string, hit_id string, hit_ord bigint, place_name string, distance string,"
        " category_group_code string, road_address_name string, address_name string, place_url string")


def test_place_hits(spark):
    rows = places(spark, *[place(i, f"r{i}") for i in range(1, 10)])
    own = "인천광역시 중구 봄로 1"
    hits = spark.createDataFrame(
        [
            hit("r1", 1, distance="150"), hit("r2", 2, distance="151"), hit("r3", 3, distance="500", road=own),
            hit("r4", 4, distance="501", address=own), hit("r5", 5, group="CS2", road=own), hit("r6", 6, name="둘식당", road=own),
            hit("r7", 7, distance=""), hit("r8", 8, distance="5"), hit("r8", 9, distance="300", address=own),
            hit("r9", 11, distance="9"), hit("r9", 10, distance="9"),
        ],
        HITS,
    )
    best = {r.id: (r.hit_id, r.matched_by) for r in matching.best_place_hits(rows, hits).collect()}
    assert best == {
        "r1": ("h1", "name-coordinates"), "r3": ("h3", "name-address"),
        "r8": ("h9", "name-address"), "r9": ("h10", "name-coordinates"),
    }
    ledger = spark.createDataFrame([("r1", 2, "t"), ("r2", 1, "t")], schema.LEDGER)
    done = enrichment.enrich(rows, hits, ledger, "t9")
    after = {r.id: r for r in done.places.collect()}
    assert len(after) == 9 and after["r1"].verification is None  # in the ledger already
    assert after["r3"].place_url == "https://p/1" and after["r3"].verification.status == "confirmed"
    assert after["r2"].verification.status == "unverified" and after["r2"].verification.checked_at == "t9"
    assert {r.id for r in done.ledger.collect()} == {f"r{i}" for i in range(2, 10)}
    assert [r.id for r in matching.pending(rows, ledger, limit=2).collect()] == ["r2", "r3"]


LOCAL = ("restaurant_id string, hit_ord bigint, title string, category string, address string, road_address string,"
         " link string, mapx string, mapy string")


def test_cross_check(spark):
    rows = places(spark, *[place(i, f"r{i}") for i in range(1, 6)], place(6, "r6", place_id="k", check=CONFIRMED))
    def local(r, n, title="<b>하나</b>식당", road="인천광역시 중구 봄로 1 2층", x="1266000000", y="374000000"):
        return (r, n, title, "음식", "", road, "l", x, y)
    hits = spark.createDataFrame(
        [local("r1", 1), local("r2", 2, title="둘식당"), local("r3", 3, road="부산 서구 먼길 9"), local("r3", 5, x="1266500000"),
         local("r4", 4, x="abc")], LOCAL)
    check = enrichment.cross_check(rows, hits, sample_size=100)
    got = {r.id: (r.status, r.hit_count, r.probable_rename) for r in check.statuses.collect()}
    assert got == {
        "r1": ("strict-match", 1, False), "r2": ("no-strict-match", 1, True), "r3": ("no-strict-match", 2, False),
        "r4": ("no-strict-match", 1, False), "r5": ("no-result", 0, False),
    }
    row = check.summary.first()
    assert (row.eligible_count, row.strict_match_count, row.no_strict_match_count, row.no_result_count, row.probable_rename_count) == (5, 1, 3, 1, 1)
    ranked = {(r.id, r.hit_ord): r["rank"] for r in check.ranked_hits.collect()}
    assert ranked[("r3", 5)] == 1 and ranked[("r3", 3)] == 2  # the address counts before the distance
    ids = spark.createDataFrame([("r2",), ("r6",)], "id string")
    with pytest.raises(quality.QualityError, match="r6"):
        enrichment.cross_check(rows, hits, ids=ids)


def test_snapshot_diff(spark):
    before = places(
        spark, place(1, "a"), place(2, "b", phone="1"), place(3, "c", place_id="k", check=CONFIRMED), place(4, "gone"),
        place(5, "twice", name="옛"), place(6, "twice", name="새"),
    )
    after = places(
        spark, place(1, "a"), place(2, "b", phone="2", menus=[("국밥", 9500)]),
        place(3, "c", place_id="k", check=("kakao", "confirmed", "name-address", 1.0, "t2")), place(7, "new"), place(8, "twice", name="새"),
    )
    got = {(r.change, r.id): r.changed_fields for r in snapshot.diff(before, after).collect()}
    assert got == {
        ("unchanged", "a"): [], ("changed", "b"): ["phone", "menus"], ("unchanged", "c"): [],
        ("removed", "gone"): None, ("added", "new"): None, ("unchanged", "twice"): [],
    }
    report = {(r.section, r.metric): (r.before, r.after) for r in snapshot.update_report(before, after).collect()}
    assert report[("totals", "total")] == (6, 5) and report[("changes", "changed")] == (None, 1)
    assert report[("verification", "confirmed")] == (1, 1) and report[("operational", "final_candidates")] == (1, 1)


def test_audit_of_an_empty_table(spark):
    row = audit.summary(places(spark)).first()
    assert row.total_places == 0 and row.confirmed_rate == 0 and row.deduplicated == 0


def test_counts_are_ordered(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "k string")
    assert [tuple(r) for r in audit.count_by(df, F.col("k"), "k").collect()] == [("c", 2), ("a", 1), ("b", 1)]


WIDE = "ord bigint, `시도` string, `시군` string, `업종` string, `업소명` string, `연락처` string, `주소` string," + ",".join(
    f"`메뉴{i}` string, `가격{i}` string" for i in range(1, 5))


def wide(ord_, name="하나식당", kind="한식업", phone="1", address="봄로 1", items=(("국밥", "9,000원"),)):
    cells = [c for item in (*items, *[(None, None)] * (4 - len(items))) for c in item]
    return (ord_, "인천광역시", "중구", kind, name, phone, address, *cells)


def test_wide_rows(spark):
    raw = spark.createDataFrame(
        [
            wide(1, items=[("국 밥", "9000"), ("국밥", "9,000"), ("전", "문의"), ("면", "5000")]),
            wide(2, kind="미용업"), wide(3, name=" "), wide(4, items=[("국밥", "문의")]), wide(5, name="ＡＢ식당", phone=""),
        ],
        WIDE,
    )
    got = {r.ord: r for r in ingest.adapt_wide(raw).collect()}
    assert set(got) == {1, 5} and [tuple(m) for m in got[1].menus] == [("국 밥", 9000), ("면", 5000)]
    assert got[5].name == "AB식당" and got[5].phone is None


def test_existing_records_need_an_unambiguous_key(spark):
    old = places(
        spark, place(1, name="가", address="봄로 1"), place(2, name="나", address="봄로 2", phone="7"),
        place(3, name="나", address="봄로 2", phone="8"), place(4, name="다", address="봄로 9"),
        place(5, name="라", address="봄로 5"), place(6, name="라", address="봄로 6"),
    )
    rows = places(
        spark, place(11, name="가", address="봄로 1", district="서구"), place(12, name="나", address="봄로 2", phone="8"),
        place(13, name="다", address="여름로 1"), place(14, name="라", address="여름로 2"), place(15, name="마"),
    )
    got = {r.ord: (r.existing_ord, r.tier) for r in ingest.find_existing(rows, old).collect()}
    assert got == {11: (1, 2), 12: (3, 3), 13: (4, 4)}


def test_wide_refresh(spark):
    previous = places(spark, place(1, "old", name="하나식당", address="봄로 1", place_id="k", check=CONFIRMED))
    raw = spark.createDataFrame(
        [wide(1), wide(2, name="둘식당", address="봄로 2"), wide(3, name="셋식당", address="봄로 3"), wide(4, items=[("면", "7000")])], WIDE)
    cached = ingest.with_source_key(places(spark, place(9, name="둘식당", address="봄로 2", lat=36.9))).drop("ord")
    done = refresh_wide(raw, previous, cached)
    got = {r.name: r for r in done.places.collect()}
    assert set(got) == {"하나식당", "둘식당"}
    one = got["하나식당"]
    assert (one.id, one.place_id, one.ord, [tuple(m) for m in one.menus]) == ("old", "k", 1, [("면", 7000)])
    assert len(got["둘식당"].id) == 20 and got["둘식당"].latitude == 36.9
    counts = done.counts.first()
    assert (counts.fetched, counts.normalized, counts.preserved, counts.geocoded, counts.excluded) == (4, 3, 1, 1, 1)
    many = places(spark, *[place(i, f"o{i}", name=f"옛{i}", address=f"길 {i}") for i in range(20)])
    with pytest.raises(quality.QualityError):
        refresh_wide(raw, many, cached)


RAW_PLACE = ("ord bigint, RSTR_ID string, RSTR_NM string, BRNCH_NM string, ROAD_NM_ADDR string, LOTNO_ADDR string,"
             " RSTR_LAT string, RSTR_LOT string, RSTR_RPRS_TELNO string, BIZ_CRTFCT_BZSTAT_NM string, BIZ_LCPMT_NM string")
RAW_MENU = "menu_ord bigint, RSTR_ID string, MENU_NM string, MENU_PRC string, RGN_NM string"


def test_normalized_refresh(spark):
    raw_places = spark.createDataFrame(
        [
            (1, "10", "하나", "본점", "", "인천 동구 송림동 1", "37.4", "126.6", "", "", ""),
            (2, "20", "둘", "", "길 2", "", "37.4", "126.6", "1", "중국식", ""),
            (3, "30", "셋", "", "길 3", "", "x", "126.6", "", "", ""),
            (4, "40", "넷", "", "길 4", "", "39.0", "126.6", "", "", ""),
            (5, "50", "다섯", "", "길 5", "", "37.4", "126.6", "", "", ""),
        ],
        RAW_PLACE,
    )
    menus = [(1, "10", "파스", "9000", "서구"), (2, "10", "타르", "8000", ""), (3, "10", "파스", "9000", ""), (4, "10", "콜라", "2000", ""),
             (5, "10", "싼것", "900", ""), (1, "20", "밥", "5000", "연수구 어디"), (9, "30", "밥", "5000", ""), (9, "40", "밥", "5000", ""),
             (9, "50", "공기밥", "5000", "")]
    previous = places(spark, place(7, "incheon-20", place_id="k", check=CONFIRMED))
    done = refresh_normalized(raw_places, spark.createDataFrame(menus, RAW_MENU), previous)
    got = {r.id: r for r in done.places.collect()}
    assert set(got) == {"incheon-10", "incheon-20"}
    one, two = got["incheon-10"], got["incheon-20"]
    # "파스" and "타르" meet as "파스타르": the words may span two menus.
    assert (one.name, one.category, one.district) == ("하나 본점", "양식", "동구")
    assert [tuple(m) for m in one.menus] == [("타르", 8000), ("파스", 9000)]
    assert (two.category, two.district, two.place_id, two.verification.status) == ("중식", "연수구", "k", "confirmed")
    assert {r.ord for r in done.rejected.collect()} == {3, 4, 5}


def test_menu_words_span_chunks(spark, monkeypatch):
    monkeypatch.setattr(ingest, "_CHUNK_ROWS", 3)
    rng = random.Random(5)
    rows = [(rid, i, rng.choice(["짜", "장면", "초", "밥", "스테", "이크", "국", "나물무침", "가나다라마"]))
            for rid in ("a", "b", "c", "d", "e", "f") for i in range(rng.randrange(1, 14))]
    df = spark.createDataFrame(rows, "rid string, ord bigint, key string")
    from eatlas.functions import fixed_values as V
    import re
    for r in ingest.menu_words(df).collect():
        whole = "".join(k for rid, _, k in rows if rid == r.rid)
        for label, pattern in V.MENU_KEY_RULES:
            found = r.menu_hits[label] or re.search(pattern, r.menu_text) is not None
            assert found == (re.search(pattern, whole) is not None)


def test_row_numbers_and_even_samples(spark):
    rows = [("hot" if i % 3 else f"k{i}", i, (i * 37) % 101) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint")
    got = ranking.distributed_row_number(df, ["k"], [F.col("v"), F.col("i")], "n").collect()
    groups = {}
    for k, i, v in rows:
        groups.setdefault(k, []).append((v, i))
    assert {(r.k, r.i): r.n for r in got} == {
        (k, i): n for k, members in groups.items() for n, (v, i) in enumerate(sorted(members), 1)
    }
    ten = spark.range(10).withColumnRenamed("id", "ord")
    pick = lambda n: sorted(r.ord for r in ranking.evenly_spaced(ten, "ord", n).collect())
    assert pick(3) == [0, 5, 9] and pick(1) == [5] and pick(0) == [] and pick(12) == list(range(10))


def test_exact_percentiles(spark):
    rng = random.Random(9)
    rows = [("hot", float(int(rng.expovariate(0.01)))) for _ in range(3000)] + [("small", 5.0), ("small", 7.0)]
    df = spark.createDataFrame(rows, "path string, latency double").withColumn("bytes", F.lit(1024 * 1024))
    got = {r.path: r for r in measurements.latency_summary(df, ["path"], 10).collect()}
    hot = sorted(v for p, v in rows if p == "hot")
    for name, ratio in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
        assert got["hot"][name] == hot[math.ceil(len(hot) * ratio) - 1]
    assert (got["small"].p50, got["small"].p99, got["small"].requests_per_second) == (5.0, 7.0, 0.2)
    total = measurements.latency_summary(df, []).first()
    assert total.requests == 3002 and total.p50 == sorted(v for _, v in rows)[1500]


def test_route_summary(spark):
    routes = spark.createDataFrame(
        [("a", 400.0, 480.0, 170.0), ("b", 800.0, 800.0, 60.0), ("c", 4000.0, 6000.0, 300.0), ("d", 400.0, 400.0, 1.0)],
        "id string, straight_meters double, route_meters double, route_seconds double")
    row = measurements.route_summary(measurements.route_samples(routes)).first()
    # errors: -2, 1, 5, 0
    assert (row.sample_count, row.mean_error, row.mean_absolute_error, row.median_absolute_error) == (4, 1.0, 2.0, 1.5)
    assert (row.max_absolute_error, row.underestimated, row.within_two_minutes, row.mean_multiplier) == (5, 1, 3, 1.18)
    empty = measurements.route_summary(measurements.route_samples(routes.limit(0))).first()
    assert empty.sample_count == 0 and empty.median_absolute_error == 0


def test_route_targets(spark):
    rows = [place(i, f"r{i}", lat=37.0 + i * 0.001, lon=127.0, place_id=f"k{i}", check=CONFIRMED) for i in range(6)]
    rows.append(place(9, "near", lat=37.0027, lon=127.0, check=UNVERIFIED))
    df = places(spark, *rows)
    got = [(r.target_meters, r.id) for r in ranking.nearest_to_targets(df, 37.0, 127.0, (300.0, 310.0, 320.0)).collect()]
    assert got == [(300.0, "r3"), (310.0, "r2"), (320.0, "r4")]
    with pytest.raises(Exception, match="too few"):
        ranking.nearest_to_targets(df.limit(2), 37.0, 127.0, (300.0, 310.0, 320.0)).collect()


def test_location_merge(spark):
    columns = "query_id string, rank bigint, id string, name string, address string, latitude double, longitude double"
    spots = spark.createDataFrame(
        [("q", i, f"place-{i % 4}", "n", "a", 37.0 + i, 127.0) for i in range(1, 8)], columns)
    addresses = spark.createDataFrame(
        [("q", 1, "address-1", "n", "a", 38.000001, 127.0), ("q", 2, "address-2", "n", "a", 50.0, 127.0),
         ("q", 3, "address-3", "n", "a", 50.0, 127.0), ("q", 4, "address-4", "n", "a", 51.0, 127.0), ("r", 1, "address-5", "n", "a", 1.0, 1.0)], columns)
    got = ranking.merge_locations(spots, addresses).orderBy("query_id", "position").collect()
    assert [r.id for r in got if r.query_id == "q"] == ["place-1", "place-2", "place-3", "place-0", "address-2"]
    assert [r.id for r in got if r.query_id == "r"] == ["address-5"]
    failures = spark.createDataFrame([("q", "place"), ("r", "place"), ("r", "address")], "query_id string, side string")
    assert [r.query_id for r in ranking.failed_searches(failures).collect()] == ["r"]


def test_schema_checks(spark):
    bad = ("kakao", "confirmed", None, -1.0, "t")
    df = places(
        spark, place(1, check=CONFIRMED, place_id="k"), place(2, check=bad), place(3, menus=()), place(4, category="분식"),
        place(5, name=None), place(6, menus=[(None, 1)]), place(7, check=("naver", "gone", "luck", 1.0, None)), place(8, lat=None),
    )
    good, quarantined = quality.split_valid(df)
    assert [r.ord for r in good.collect()] == [1]
    errors = {r.ord: r._errors for r in quarantined.collect()}
    assert errors[2] == ["verification.matched_by", "verification.distance_meters"]
    assert errors[3] == errors[6] == ["menus"] and errors[4] == ["category"] and errors[5] == ["name"] and errors[8] == ["latitude"]
    assert errors[7] == ["verification.provider", "verification.status", "verification.checked_at", "verification.matched_by"]
    with pytest.raises(quality.QualityError):
        quality.require_valid(df)
    with pytest.raises(quality.QualityError):
        quality.require_located(df)


def test_build_gates(spark):
    tenth = places(spark, place(0, place_id="k", check=CONFIRMED), *[place(i) for i in range(1, 10)])
    with pytest.raises(quality.QualityError, match="10.0%"):
        quality.select_for_build(tenth)
    assert quality.select_for_build(tenth, "all").count() == 10
    assert quality.select_for_build(tenth, min_coverage=0.1).count() == 1
    with pytest.raises(quality.QualityError, match="unknown"):
        quality.select_for_build(tenth, "some")
    assert quality.select_for_build(places(spark)).count() == 0
    quality.require_safe_size(5, 11)
    for size in ((4, 10), (0, 0)):
        with pytest.raises(quality.QualityError):
            quality.require_safe_size(*size)
    with pytest.raises(quality.QualityError):
        quality.require_import_size(menus=tenth)


def test_stored_tables_go_to_the_shared_folder(spark):
    class Conf(dict):
        pass

    class Cluster:
        conf = Conf({"spark.checkpoint.dir": "hdfs://c", "spark.sql.warehouse.dir": "hdfs://w"})

    assert skew.shared_folder(Cluster) == "hdfs://c"
    Cluster.conf = Conf({"spark.sql.warehouse.dir": "hdfs://w"})
    assert skew.shared_folder(Cluster) == "hdfs://w"
    stored = skew.materialize(spark.range(5))
    assert stored.count() == 5 and stored.inputFiles()[0].startswith(f"file://{spark.conf.get('spark.checkpoint.dir')}/eatlas/")


def test_numeric_prices_are_taken_as_numbers(spark):
    numbers = spark.createDataFrame([(12_000_000.0,), (9000.4,)], "p double")
    texts = spark.createDataFrame([("12,000,000원",), ("9000.4",)], "p string")
    for raw in (numbers, texts):
        price = ingest._price(raw, "p", text.clean_text)
        assert sorted(r[0] for r in raw.select(price).collect()) == [9000, 12_000_000]


def test_hits_match_in_any_unicode_form(spark):
    spot = spark.createDataFrame([("p", "CU 1호점", "서울 종로구 길 1")], "id string, name string, address string")
    hits = spark.createDataFrame(
        [("p", "h", 1, "ＣＵ １호점", "10", "FD6", "서울 종로구 길 １", "", "u")],
        "restaurant_id string, hit_id string, hit_ord bigint, place_name string, distance string, category_group_code string, road_address_name string, address_name string, place_url string",
    )
    assert [r.hit_id for r in matching.best_place_hits(spot, hits).collect()] == ["h"]


def test_no_confirmed_place_fails_loudly(spark):
    with pytest.raises(Exception, match="too few confirmed places"):
        ranking.nearest_to_targets(places(spark), 37.0, 127.0).collect()


def test_nearest_places_of_many_requests(spark):
    rng = random.Random(12)
    spots = [(37.0 + rng.random() * 0.2, 127.0 + rng.random() * 0.2) for _ in range(60)]
    spots += [(37.1, 127.1)] * 30 + [(10.0, 179.999), (10.0, -179.998), (89.99, 5.0), (89.98, -170.0), (-45.0, 0.0), (None, 1.0)]
    asks = [(37.0 + rng.random() * 0.2, 127.0 + rng.random() * 0.2) for _ in range(25)]
    asks += [(37.1, 127.1), (10.0, 180.0), (90.0, 0.0), (-60.0, -100.0), (0.0, 0.0), (None, 2.0)]
    rows = spark.createDataFrame([(i, f"p{i:03d}", *s) for i, s in enumerate(spots)], "ord bigint, id string, latitude double, longitude double")
    requests = spark.createDataFrame([(i, *a) for i, a in enumerate(asks)], "request_id bigint, latitude double, longitude double")

    def meters(a, b):
        p, q = math.radians(a[0]), math.radians(b[0])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6_371_000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    for k in (1, 5, 40, 200):
        got = {}
        for r in ranking.k_nearest(requests, rows, k).collect():
            got.setdefault(r.request_id, []).append((r["rank"], r.id))
        located = [(i, s) for i, s in enumerate(spots) if s[0] is not None]
        for n, ask in enumerate(asks):
            if ask[0] is None:
                assert n not in got
                continue
            near = sorted(located, key=lambda x: (round(meters(ask, x[1]), 6), f"p{x[0]:03d}"))[:k]
            assert sorted(got[n]) == [(j + 1, f"p{i:03d}") for j, (i, _) in enumerate(near)]
    with pytest.raises(ValueError):
        ranking.k_nearest(requests, rows, 0)


def test_records_continue_one_to_one(spark):
    columns = "ord bigint, province string, district string, name string, address string, phone string"
    existing = spark.createDataFrame(
        [(100, "p", "d", "가", "길 1", "1"), (101, "p", "d", "나", "길 2", "2"), (102, "p", "d", "다", "길 3", "3"), (103, "p", "e", "다", "길 9", "9")], columns
    )
    rows = spark.createDataFrame(
        [
            (1, "q", "x", "가", "길 1", None),  # name and address: 100, but row 2 has the stronger key
            (2, "p", "d", "가", "길 1", None),
            (3, "p", "d", "가", "길 1", "1"),  # the same strongest key, later
            (4, "p", "d", "나", "길 7", "2"),  # phone: 101
            (5, "p", "d", "나", "길 8", None),  # name and district: 101, taken
            (6, "p", "d", "다", "길 9", None),  # name and address name 103, so not 102
            (7, "p", "d", "다", "길 5", None),
        ],
        columns,
    )
    got = sorted(tuple(r) for r in ingest.continue_one_to_one(rows, existing).collect())
    assert got == [(2, 100, 1), (4, 101, 3), (6, 103, 2), (7, 102, 4)]
    reused = ingest.reused_records(ingest.find_existing(rows, existing))
    assert sorted(tuple(r) for r in reused.collect()) == [(100, 3, 1, 1), (101, 2, 4, 3)]
    assert ingest.continue_one_to_one(rows.limit(0), existing).count() == 0


def test_audits_of_several_sources_in_one_job(spark, tmp_path):
    own = places(spark, place(1), place(2), place(3, check=CONFIRMED, place_id="7"), place(4, check=CONFIRMED, place_id="7"))
    other = places(spark, place(1, name="다른 집"), place(2, place_id="9"), place(5, menus=[("공기밥", 1000), ("국밥", 9000)]))
    sources = {"a": own, "b": other}
    got = {r.source: r.asDict() for r in auditing.audit_sources(sources).collect()}
    for name, rows in sources.items():
        assert got[name] == {"source": name, **audit.summary(rows).first().asDict()}
    root = str(tmp_path / "reports")
    for run in ("20260101", "20260102"):
        kept = auditing.audit_sources(sources, reports_root=root, run=run)
        assert {r.source: r.asDict() for r in kept.collect()} == got
    assert reports.read_reports(spark, root, "audit").count() == 4
    assert reports.latest_report(spark, root, "audit").where("run = '20260102'").count() == 2
    with pytest.raises(Exception, match="exist"):
        auditing.audit_sources(sources, reports_root=root, run="20260101")
