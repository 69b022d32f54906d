"""Radius joins, candidates, easing, cards and draws."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from eatlas.operators import recommend as R
from eatlas.operators import spatial

PLACES = (
    "ord bigint, id string, name string, category string, district string, place_id string, place_url string,"
    " latitude double, longitude double, menus array<struct<name:string,price:bigint>>"
)
REQUESTS = (
    "request_id bigint, latitude double, longitude double, category string, budget double, travel_mode string, time_limit string"
)


def meters(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6_371_000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


@pytest.mark.parametrize("rows_per_block", [10_000, 7])
def test_radius_join_equals_brute_force(spark, rows_per_block):
    rng = random.Random(3)
    # A third of the places share one spot.
    spots = [(37.0, 127.0) if i % 3 == 0 else (36.8 + rng.random() * 0.5, 126.8 + rng.random() * 0.5) for i in range(150)]
    asks = [(36.8 + rng.random() * 0.5, 126.8 + rng.random() * 0.5, rng.choice([0.0, 700.0, 5000.0, 20000.0])) for _ in range(60)]
    asks += [(37.0, 127.0, 0.0), (None, 127.0, 100.0), (37.0, 127.0, None), (89.9, 0.0, 5000.0)]
    # A third of the requests share one spot; the globe's seam, its poles and very wide circles count too.
    asks += [(37.0, 127.0, 900.0)] * 40 + [(10.0, 179.99, 9000.0), (10.0, -180.0, 9000.0), (-89.98, 10.0, 6000.0), (0.0, 0.0, 1.9e7)]
    spots += [(10.0, -179.97), (10.0, 179.97), (10.0, 180.0), (89.95, 170.0), (-89.99, -100.0), (90.0, 3.0), (None, 1.0), (1.0, None)]
    places = spark.createDataFrame([(i, *s) for i, s in enumerate(spots)], "ord bigint, latitude double, longitude double")
    requests = spark.createDataFrame([(i, *a) for i, a in enumerate(asks)], "r bigint, latitude double, longitude double, radius_meters double")
    got = spatial.radius_join(requests, places, rows_per_block=rows_per_block)
    want = {
        (r, p)
        for r, (lat, lon, limit) in enumerate(asks)
        for p, (y, x) in enumerate(spots)
        if None not in (lat, limit, y, x) and meters(lat, lon, y, x) <= limit
    }
    rows = [(g.r, g.ord) for g in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_radius_join_rounds_as_the_exact_distance_does(spark):
    rng = random.Random(12)
    centres = [(37.0, 127.0), (89.999, 10.0), (-90.0, 0.0), (0.0, 180.0), (45.0, 397.0), (10.0, 36_000_127.0)]
    spots = [(y + rng.gauss(0, 0.01), x + rng.gauss(0, 0.01)) for y, x in centres for _ in range(60)] + centres
    # Distances of half a unit of the last decimal, and on the circle.
    spots += [(math.degrees((n + 0.5) / 1000 / 6_371_000), 20.0) for n in range(0, 40)] + [(math.degrees(3000 / 6_371_000), 20.0)]
    asks = [*centres, (0.0, 20.0), (0.3, 20.0)]
    places = spark.createDataFrame([(i, *s) for i, s in enumerate(spots)], "ord bigint, latitude double, longitude double")
    requests = spark.createDataFrame(
        [(i, *a, r) for i, a in enumerate(asks) for r in (0.0, 3000.0, 200_000.0)], "r bigint, latitude double, longitude double, radius_meters double"
    )
    exact = spatial.radius_join(requests, places).select("r", "radius_meters", "ord", F.round("distance_meters", 3))
    rounded = spatial.radius_join(requests, places, decimals=3).select("r", "radius_meters", "ord", "distance_meters")
    got, want = (sorted(map(tuple, df.collect())) for df in (rounded, exact))
    assert got == want and len(want) > 500
    assert {(g[0], g[1], g[2]) for g in got} == {
        (r, limit, p) for r, a in enumerate(asks) for p, s in enumerate(spots) for limit in (0.0, 3000.0, 200_000.0) if meters(*a, *s) <= limit
    }


def test_one_radius_for_all_keeps_the_tasks_of_the_session(spark):
    places = spark.createDataFrame([(i, 37.0 + i / 10, 127.0) for i in range(9)], "ord bigint, latitude double, longitude double")
    requests = places.select(F.col("ord").alias("r"), "latitude", "longitude", F.lit(3000.0).alias("radius_meters"))
    assert spatial.radius_join(requests, places).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def scattered(rng, n):
    """Points everywhere, many of them near the seam, the poles, and edges and corners of the cube."""
    points = [(math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for _ in range(n)]
    for lat, lon in [(0, 180), (50, -180), (90, 0), (-90, 7), (0, 45), (35.26439, 45), (-35.26439, 135), (45, 0), (45, 90), (0, -135)]:
        points += [(max(-90.0, min(90.0, lat + rng.gauss(0, 0.02))), lon + rng.gauss(0, 0.02)) for _ in range(n // 10)]
    return [(lat, lon - 360 if lon > 180 else lon + 360 if lon < -180 else lon) for lat, lon in points]


@pytest.mark.parametrize("across", [1, 7, 1000, 10**6])
def test_circles_cover_the_cells_of_their_points(spark, across):
    rng = random.Random(across)
    rows, step = [], 10_007_543 / across
    for i, (lat, lon) in enumerate(scattered(rng, 100)):
        limit = rng.choice([0.0, step / 9, step, 2.5 * step])
        for _ in range(4):
            bearing, angle = rng.uniform(0, 2 * math.pi), rng.choice([0.0, 0.5, 1.0]) * min(limit, 2.0e7) / 6_371_000
            p = math.radians(lat)
            q = math.asin(max(-1, min(1, math.sin(p) * math.cos(angle) + math.cos(p) * math.sin(angle) * math.cos(bearing))))
            x = math.radians(lon) + math.atan2(
                math.sin(bearing) * math.sin(angle) * math.cos(p), math.cos(angle) - math.sin(p) * math.sin(q)
            )
            rows.append((i, lat, lon, limit * (1 + 1e-12), math.degrees(q), math.degrees(x)))
    df = spark.createDataFrame(rows, "i int, latitude double, longitude double, meters double, y double, x double")
    df = df.withColumn("n", F.monotonically_increasing_id())
    cells = spatial.covering_cells(spatial.with_vector(df), F.col("meters"), F.lit(across)).select("n", *spatial.CELL)
    points = df.select("n", F.col("y").alias("latitude"), F.col("x").alias("longitude"))
    own = spatial.own_cell(spatial.with_vector(points), F.lit(across)).select("n", *spatial.CELL)
    assert own.join(cells, ["n", *spatial.CELL], "left_anti").count() == 0
    # Circles no wider than a cell touch a few.
    few = df.where(F.col("meters") <= step).select("n")
    assert cells.join(few, "n").groupBy("n").count().agg(F.max("count")).first()[0] <= 24


def test_near_pairs_anywhere_equal_brute_force(spark):
    rng = random.Random(6)
    spots = [(0.0, 180.0), (60.0, -180.0), (90.0, 10.0), (-90.0, 0.0), (89.999, 40.0), (35.26439, 45.0), (10.0, 45.0), (37.0, 127.0)]
    points = []
    for lat, lon in spots:
        for _ in range(25):
            away, bearing = rng.uniform(0, 60) / 111_195, rng.uniform(0, 2 * math.pi)
            if abs(lat) > 89.99:
                colat, turn = rng.uniform(0, 60) / 111_195 + (90 - abs(lat)), rng.uniform(-180, 180) if abs(lat) == 90 else lon + rng.gauss(0, 10)
                y, x = math.copysign(90 - colat, lat), turn
            else:
                y, x = lat + away * math.cos(bearing), lon + away * math.sin(bearing) / math.cos(math.radians(lat))
            points.append((y, x - 360 if x > 180 else x + 360 if x < -180 else x))
    nodes = spark.createDataFrame([(i, "k", *p) for i, p in enumerate(points)], "rep bigint, key string, latitude double, longitude double")
    got = spatial.nearby_pairs(nodes, ["key"], 50.0, [])
    assert got.columns == ["key", "rep_l", "latitude_l", "longitude_l", "rep_r", "latitude_r", "longitude_r"]
    want = {(i, j) for i in range(len(points)) for j in range(i + 1, len(points)) if meters(*points[i], *points[j]) <= 50}
    found = [(r.rep_l, r.rep_r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 500


def test_place_just_across_a_tile_edge_is_found(spark):
    places = spark.createDataFrame([(1, 37.45001, 127.1)], "ord bigint, latitude double, longitude double")
    requests = spark.createDataFrame([(1, 37.27025, 127.1, 20000.0)], "r bigint, latitude double, longitude double, radius_meters double")
    assert spatial.radius_join(requests, places).count() == 1


def sample_places(spark):
    def at(ord_, name, category, items, lat=37.0, **more):
        return (ord_, f"p{ord_}", name, category, "중구", more.get("place_id"), None, lat, 127.0, items)

    return spark.createDataFrame(
        [
            at(1, "하나식당", "한식", [("비빔밥", 9000), ("콜라", 2000), ("갈비탕", 14000)]),
            at(2, "둘식당", "중식", [("짬뽕", 9500)]),
            at(3, "셋카페", "한식", [("커피", 3000)]),
            at(4, "우리정육점", "한식", [("국밥", 8000)]),
            at(5, "무엇", "기타요식업", [("나물", 5000)]),
            at(6, "먼식당", "한식", [("백반", 7000)], lat=37.05),
            at(7, "음료집", "한식", [("맥주", 4000)]),
        ],
        PLACES,
    )


def test_all_conditions_hold_together(spark):
    requests = spark.createDataFrame(
        [
            (1, 37.0, 127.0, "전체", 10000.0, "walking", "10"),
            (2, 37.0, 127.0, "한식", math.inf, "driving", "wide"),
            (3, 37.0, 127.0, "중식", 5000.0, "walking", "10"),
            (4, None, 127.0, "전체", 10000.0, "walking", "10"),
            (5, 37.0, 127.0, None, 10000.0, "walking", "10"),
        ],
        REQUESTS,
    )
    classified = R.classify(sample_places(spark))
    found = R.candidates(requests, classified)
    got = {(r.request_id, r.id): [m["name"] for m in r.affordable_menus] for r in found.collect()}
    assert got == {
        (1, "p1"): ["비빔밥"], (1, "p2"): ["짬뽕"], (2, "p1"): ["비빔밥", "갈비탕"], (2, "p6"): ["백반"],
    }
    flags = R.relaxation_flags(requests, found).collect()
    assert [(f.request_id, f.can_reset_category, f.can_lift_budget, f.can_widen_range) for f in flags] == [(3, True, True, True)]
    counts = {r.eased: r.hits for r in R.relaxation_counts(requests, classified, found).collect()}
    assert counts == {"category": 0, "budget": 1, "range": 0}
    cards = {r.id: r for r in R.cards(found.where("request_id = 2")).collect()}
    assert cards["p6"].travel_minutes == 14 and cards["p6"].hidden_menu_count == 0
    assert cards["p1"].map_link.startswith("https://map.kakao.com/?q=")


def test_card_shows_eight_menus(spark):
    menus = [(f"백반 {i}", 1000) for i in range(11)]
    df = spark.createDataFrame([(menus, 10.0, "walking", "u", None, "n", "d")],
                               "affordable_menus array<struct<name:string,price:int>>, distance_meters double, travel_mode string, place_url string, place_id string, name string, district string")
    row = R.cards(df).first()
    assert len(row.visible_menus) == 8 and row.hidden_menu_count == 3 and row.map_link == "u"


def test_pick_position_is_clamped(spark):
    df = spark.createDataFrame([(0.0, 4), (0.99, 4), (1.0, 4), (-3.0, 4), (7.0, 4), (0.5, 0)], "u double, n bigint")
    assert [r.p for r in df.select(R.pick_position(F.col("u"), F.col("n")).alias("p")).collect()] == [1, 4, 4, 1, 4, None]


def test_draws_by_number(spark):
    sizes = {"a": 37, "b": 1, "c": 2, "d": 3, "e": 500, "f": 4}
    draws = {"a": 10_000, "b": 5, "c": 9, "d": 400, "e": 20, "f": 0, "g": 3}
    options = spark.createDataFrame([(s, f"{s}{i}") for s, n in sizes.items() for i in range(n)] + [("a", "a0")], "s string, i string")
    sessions = spark.createDataFrame(list(draws.items()), "s string, draws bigint")
    picked = R.nth_draws(options, sessions, "s", "i", "x")
    got, firsts = {}, set()
    for r in sorted(picked.collect(), key=lambda r: (r.s, r.draw_no)):
        got.setdefault(r.s, []).append(r)
    assert {s: len(rows) for s, rows in got.items()} == {s: n for s, n in draws.items() if n and s in sizes}
    for s, rows in got.items():
        n = sizes[s]
        assert [r.draw_no for r in rows] == list(range(1, draws[s] + 1)) and all(r.cycle == (r.draw_no - 1) // n for r in rows)
        for start in range(0, len(rows), n):
            part = [r.i for r in rows[start : start + n]]
            assert len(part) == len(set(part)) and (len(part) < n or set(part) == {f"{s}{i}" for i in range(n)})
            firsts.add((s, part[0]))
        assert n == 1 or all(a.i != b.i for a, b in zip(rows, rows[1:]))
    # Every option of the longest session leads some cycle.
    assert len([1 for s, _ in firsts if s == "a"]) > 30
    assert picked.where("s = 'a'").count() == 10_000
    again = R.nth_draws(options.repartition(3), sessions, "s", "i", "x")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, picked.collect()))
    assert sorted(map(tuple, R.nth_draws(options, sessions, "s", "i", "y").collect())) != sorted(map(tuple, picked.collect()))


def test_draw_cycles(spark):
    sizes = {"one": 1, "two": 2, "three": 3, "five": 5, "many": 40}
    options = spark.createDataFrame([(s, f"i{k}") for s, n in sizes.items() for k in range(n)], "s string, i string")
    for seed in ("a", "b", "c"):
        rows = R.draw_sequence(options, "s", "i", 11, seed).orderBy("s", "draw_no").collect()
        for session, n in sizes.items():
            picks = [r.i for r in rows if r.s == session]
            assert [r.draw_no for r in rows if r.s == session] == list(range(1, 12))
            for start in range(0, 11, n):
                cycle = picks[start:start + n]
                assert len(set(cycle)) == len(cycle)
            if n > 1:
                assert all(a != b for a, b in zip(picks, picks[1:]))


def test_no_pair_is_joined_again(spark):
    requests = spark.createDataFrame([(1, 37.0, 127.0, "전체", 10000.0, "walking", "10")], REQUESTS)
    found = R.candidates(requests, R.classify(sample_places(spark)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    last = next(line for line in plan.splitlines() if "Join [" in line)
    assert "cell_face" in last


def test_undominated_requests_have_all_options(spark):
    rng = random.Random(5)
    rows = [
        (n, n % 4, 37.0, 127.0, rng.choice(["전체", "한식", None]), rng.choice([7000.0, 9000.0, 15000.0, math.inf]),
         rng.choice(["walking", "driving"]), rng.choice(["10", "20", "wide", "x"]))
        for n in range(120)
    ]
    requests = spark.createDataFrame(rows, REQUESTS.replace("request_id bigint,", "request_id bigint, user_id bigint,"))
    classified = R.classify(sample_places(spark))
    kept = R.undominated(requests, "user_id")
    options = lambda df: {(r.user_id, r.id) for r in R.candidates(df, classified).collect()}
    assert kept.columns == requests.columns and kept.count() <= 4 * 2 * 4
    assert options(kept) == options(requests) != set()


def _sums(rows, *names):
    return sorted((tuple(r[n] for n in names) for r in rows.collect()), key=repr)


def test_requests_of_one_kind_are_joined_once(spark):
    """Rows that travel through the join are kinds of requests, cut into pieces; each request gets its own back."""
    rows = [(i % 7, i, 37.0 + (i % 2) / 100, 127.0, "한식", 10000.0 + (i % 3), "driving", "10") for i in range(60)]
    asked = spark.createDataFrame(
        [*rows, (1, 99, 37.0, 127.0, None, 1.0, "driving", "10")],
        "request_id long, user_id long, latitude double, longitude double, category string, budget double, travel_mode string, time_limit string",
    )
    assert R.alike(asked).count() == 6
    cut = R.alike(asked, members=3)
    assert 6 < cut.count() < 60
    assert _sums(R.each_member(cut), "request_id", "user_id", "latitude", "budget") == sorted([(r[0], r[1], r[2], r[5]) for r in rows], key=repr)


def test_repeated_keys_share_a_kind_only_if_they_want_the_same(spark):
    kind = (37.0, 127.0, "한식", 10000.0, "driving", "10")
    other = (37.0, 127.0, "한식", 20000.0, "driving", "10")
    schema = "request_id long, latitude double, longitude double, category string, budget double, travel_mode string, time_limit string"
    asked = spark.createDataFrame([(1, *kind), (2, *kind), (3, *kind), (3, *other), (4, *other), (4, *kind), (5, *kind), (5, *kind), (None, *kind)], schema)
    wants, named = R.kinds_of(asked, "request_id")
    kinds = {r["request_id"]: r["kind"] for r in named.collect()}
    assert kinds[1] == kinds[2] and kinds[3] == kinds[4] and len(set(kinds.values())) == 3 and set(kinds) == {1, 2, 3, 4, 5}
    assert wants.where(wants.kind == kinds[5]).count() == 2 and wants.count() == 1 + 2 + 2


def test_routes_that_stand_for_several_count_as_often(spark):
    from eatlas.operators import measurements

    rows = [("a", 1000.0, 1500.0, 100.0, 3), ("b", 5000.0, 5500.0, 900.0, 1), ("c", 9000.0, 9900.0, 1500.0, 2)]
    schema = "id string, straight_meters double, route_meters double, route_seconds double, times long"
    once = spark.createDataFrame(rows, schema)
    every = spark.createDataFrame([r for r in rows for _ in range(r[4])], schema)
    short = measurements.route_summary(measurements.route_samples(once, "times"), "times").collect()
    assert short == measurements.route_summary(measurements.route_samples(every)).collect() and short[0]["sample_count"] == 6


def test_violations_with_more_budgets_than_a_row_holds(spark, monkeypatch):
    """Repeated request ids add up, and budgets of one position are cut into pieces."""
    monkeypatch.setattr(R, "_BUDGETS_PER_ROW", 2)
    places = [(i, 37.0 + i / 1000, 127.0, ("한식", "중식")[i % 2], 1000 * i, False, False) for i in range(30)]
    classified = spark.createDataFrame(
        places, "ord long, latitude double, longitude double, display_category string, min_meal_price long, is_cafe boolean, is_retail boolean"
    )
    asked = [(i % 9, 37.0, 127.0, ("한식", "전체")[i % 2], float(2500 * (i % 6)), "walking", ("10", "wide")[i % 3 > 0]) for i in range(20)]
    requests = spark.createDataFrame(
        asked, "request_id long, latitude double, longitude double, category string, budget double, travel_mode string, time_limit string"
    )
    pairs = collections.Counter()
    for request, _, _, category, budget, _, limit in asked:
        for _, latitude, _, kind, price, _, _ in places:
            meters = (latitude - 37.0) * 111194.93
            if meters <= 2000:
                mask = (category not in ("전체", kind)) + 2 * (price > budget) + 4 * (meters > (2000 if limit == "wide" else 4000 / 6))
                pairs[request, mask] += 1
    got = {(r["request_id"], r["mask"]): r["places"] for r in R.violations(requests, classified).collect()}
    assert got == dict(pairs)


@pytest.mark.parametrize("asks_per_row", [1000, 3])
def test_requests_of_one_position_travel_in_one_row(spark, monkeypatch, asks_per_row):
    """Whatever their radii, categories and budgets; the candidates are those of each request by itself."""
    monkeypatch.setattr(R, "_ASKS_PER_ROW", asks_per_row)
    limits = [("walking", "10"), ("walking", "wide"), ("driving", "10"), ("driving", "wide"), ("walking", "x")]
    asked = [
        (i, (37.0, 37.3)[i % 2], 127.0, ("전체", "한식", None)[i % 3], (7000.0, 9000.0, math.inf)[i % 3 - i % 2], *limits[i % 5]) for i in range(40)
    ]
    requests = spark.createDataFrame(asked, REQUESTS)
    rows = R._by_position(R.with_limit(R.ready(requests)).withColumnRenamed("category", "wanted_category"))
    assert rows.count() == 2 if asks_per_row == 1000 else rows.count() > 2
    shops = [(i, f"p{i}", f"식당 {i}", ("한식", "중식")[i % 2], "중구", None, None, 37.0 + i / 200, 127.0, [("백반", 6000 + 500 * (i % 9)), ("국밥", 20000)]) for i in range(40)]
    reach = {"10": {"walking": 4000 / 6, "driving": 4000.0}, "wide": {"walking": 2000.0, "driving": 20000.0}}
    want = {
        (r, f"p{i}"): 1 + (budget > 20000)
        for r, y, x, category, budget, mode, limit in asked
        for i, _, _, kind, _, _, _, lat, lon, items in shops
        if category in ("전체", kind) and items[0][1] <= budget and limit in reach and meters(y, x, lat, lon) <= reach[limit][mode]
    }
    found = R.candidates(requests, R.classify(spark.createDataFrame(shops, PLACES)))
    got = [((r.request_id, r.id), len(r.affordable_menus)) for r in found.collect()]
    assert len(got) == len(dict(got)) and dict(got) == want and len(want) > 50


def test_samples_that_look_alike_are_counted(spark):
    from eatlas.operators import measurements

    rows = [(f"r{i}", 1000.0 + i % 3, 1500.0, 100.0 + 700 * (i % 2), i) for i in range(1, 200)]
    schema = "id string, straight_meters double, route_meters double, route_seconds double, times long"
    samples = measurements.route_samples(spark.createDataFrame(rows, schema), "times")
    few = measurements.sample_counts(samples, "times")
    assert few.count() <= 6 and measurements.route_summary(few, "times").collect() == measurements.route_summary(samples, "times").collect()


def test_rounded_as_round_does(spark):
    from eatlas.functions import geo

    rng = random.Random(8)
    values = [n / 200 for n in range(-50, 50)] + [1.005, 2.675, -0.0, 0.0, 1e8 + 0.125, -1e8 - 0.125, 1e300, math.inf, -math.inf, math.nan, None]
    values += [rng.uniform(-1, 1) * 10 ** rng.randrange(12) for _ in range(500)] + [math.nextafter(n / 2000, s) for n in range(1, 99, 2) for s in (0, 9)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for decimals in (2, 3):
        got = df.select(geo.rounded(F.col("v"), decimals), F.round("v", decimals)).collect()
        assert all(repr(a) == repr(b) for a, b in got)


@pytest.mark.parametrize("n", [0, 3, 8, 9, 40])
def test_values_below_are_counted(spark, n):
    rng = random.Random(n)
    rows = [([rng.choice([1.0, 2.0, 3.5, math.inf, rng.random() * 9]) for _ in range(n)], rng.choice([0.0, 1.0, 3.5, 5.0])) for _ in range(60)]
    df = spark.createDataFrame(rows, "values array<double>, v double")
    got = [r[0] for r in df.select(R._count_below(F.col("values"), F.col("v"))).collect()]
    assert got == [sum(b < v for b in values) for values, v in rows]


def test_places_of_one_number_are_paired_as_before(spark):
    rows = [(1, 37.0, 127.0, "한식", 9000, "a"), (2, 37.1, 127.0, "한식", 9000, "b"), (2, 37.2, 127.0, "중식", 8000, "c"), (None, 37.3, 127.0, "한식", 1, "d")]
    offered = spark.createDataFrame(rows, "ord long, latitude double, longitude double, display_category string, min_meal_price long, id string")
    got = sorted((r.ord, r.latitude, r.display_category, r.id) for r in R._whole(offered).collect())
    assert got == [(1, 37.0, "한식", "a"), *[(2, y, c, i) for y, c in ((37.1, "한식"), (37.2, "중식")) for i in "bc"]]


@pytest.mark.parametrize("spare", [0.1, 4])
def test_draw_options_hold_all_that_can_be_drawn(spark, monkeypatch, spare):
    """Also where the bound lets too few options of a session pass, and where a session finds an option twice."""
    monkeypatch.setattr(R, "_SPARE", spare)
    shops = [(i, f"p{i}", f"식당 {i}", ("한식", "중식")[i % 2], "중구", None, None, 37.0 + i / 2000, 127.0, [("백반", 6000 + 500 * (i % 9))]) for i in range(200)]
    classified = R.classify(spark.createDataFrame(shops, PLACES))
    asked = [(i, i % 4, 37.0 + (i % 2) / 50, 127.0, ("전체", "한식")[i % 2], (7000.0, math.inf)[i // 4 % 2], "walking", ("10", "wide")[i // 8 % 2]) for i in range(24)]
    asked.append((99, None, 37.0, 127.0, "전체", math.inf, "driving", "wide"))
    requests = spark.createDataFrame(asked, REQUESTS.replace("request_id bigint,", "request_id bigint, user_id bigint,"))
    every = R.candidates(requests, classified).select("user_id", "id")
    drawable = R.draw_options(requests, classified, "user_id", "id", 5, "x")
    assert spare < 1 or drawable.count() < every.where("user_id is not null").distinct().count()
    got, want = (sorted(map(tuple, R.draw_sequence(o, "user_id", "id", 5, "x").collect())) for o in (drawable, every))
    assert got == want and len(want) == 20


def test_shuffles_of_a_stored_table_are_deleted(spark):
    from eatlas.operators.skew import materialize

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, statuses = spark.conf.get(key), spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    known = statuses.size()
    assert materialize(spark.range(1000).repartition(7).groupBy((F.col("id") % 10).alias("k")).count()).count() == 10
    assert statuses.size() <= known + 1 and spark.conf.get(key) == before


def asked_and_served(spark, seed):
    """Requests of seven users, some with several spots, and places, some more than one row or of one number."""
    rng = random.Random(seed)
    shops = [
        (i % 110, f"p{i % 120:03}", f"식당 {i}", ("한식", "중식")[i % 2], "중구", None, None, 37.0 + rng.random() / 30, 127.0, [("백반", 6000 + 500 * (i % 9))])
        for i in range(125)
    ]
    asked = [
        (i, i % 7, 37.0 + (i % 7 + (i % 3 if i % 7 > 4 else 0)) / 100, 127.0, ("전체", "한식")[i % 2 if i % 7 > 4 else i % 7 % 2], rng.choice([7000.0, 9000.0, math.inf]),
         rng.choice(["walking", "driving"]), rng.choice(["10", "20", "wide"]))
        for i in range(60)
    ]
    requests = spark.createDataFrame(asked, REQUESTS.replace("request_id bigint,", "request_id bigint, user_id bigint,"))
    return requests, R.classify(spark.createDataFrame(shops, PLACES))


@pytest.mark.parametrize("odd", [True, False])
def test_options_are_found_by_number_as_if_all_were_stored(spark, odd):
    requests, classified = asked_and_served(spark, 4)
    if not odd:
        requests, classified = requests.where("user_id < 5"), classified.where("ord between 20 and 100")
    every = R.candidates(requests, classified).select("user_id", "id")
    want = {}
    for user, item in map(tuple, every.distinct().collect()):
        want.setdefault(user, []).append(item)
    asks = R.undominated(requests, "user_id", above="_above")
    assert asks.count() > requests.select("user_id").distinct().count()
    options = R.CandidateOptions(asks, classified, "user_id", "id", distinct=True)
    assert options.odd is odd
    assert {r.user_id: r._n for r in options.sizes().collect()} == {u: len(items) for u, items in want.items()}
    places = [(u, n, tag) for u, items in want.items() for n in {1, len(items), len(items) // 2 + 1, len(items) + 1} for tag in (0, 1)]
    got = options.at(spark.createDataFrame(places, "user_id long, _place long, tag int")).select("user_id", "_place", "tag", "id")
    assert sorted(map(tuple, got.collect())) == sorted((u, n, tag, sorted(want[u])[n - 1]) for u, n, tag in places if n <= len(want[u]))
    draws = spark.createDataFrame([(u, 9) for u in range(8)], "user_id long, draws long")
    drawn = [sorted(map(tuple, R.nth_draws(o, draws, "user_id", "id", "x").collect())) for o in (options, every)]
    assert drawn[0] == drawn[1] and len(drawn[0]) == 9 * len(want)


def test_one_is_picked_of_candidates_that_are_not_stored(spark):
    requests, classified = asked_and_served(spark, 5)
    kinds, named = R.kinds_of(requests, "request_id")
    randoms = named.withColumn("random", F.col("request_id") / 60)
    every = R.candidates(kinds, classified).select("kind", "id")
    assert every.count() > every.distinct().count()
    got, want = (
        sorted(map(tuple, R.pick_one(o, randoms, "request_id", "id", among="kind").collect()))
        for o in (R.CandidateOptions(kinds, classified, "kind", "id"), every)
    )
    assert got == want and len(want) > 30
