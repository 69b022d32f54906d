"""Scalar expressions: text, prices, coordinates, classifiers, preferences."""

import math

import pytest
from pyspark.sql import functions as F

from eatlas.functions import fixed_values as V
from eatlas.functions import geo, menus, preferences, rules, text


def values(spark, inputs, expression, schema="v string"):
    rows = [(v,) if not isinstance(v, tuple) else v for v in inputs]
    indexed = [(i, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(indexed, "i int, " + schema)
    return [r.out for r in df.select("i", expression.alias("out")).orderBy("i").collect()]


def test_clean_text_and_keys(spark):
    got = values(spark, ["　㈜ Ｃａｆｅ  하나 ", None, "①번가"], text.clean_text(F.col("v")))
    assert got == ["(주) Cafe  하나", "", "1번가"]
    keys = values(spark, ["(주) 하나 식당!", "주식회사둘 A-1", None, "日本 しょくどう"], text.name_key(F.col("v")))
    assert keys == ["하나식당", "둘a1", "", ""]
    assert values(spark, ["인천광역시 남동구 1-2"], text.home_address_key(F.col("v"))) == ["남동구12"]
    assert values(spark, ["a  b\n\tc ", "　x"], text.collapse_spaces(F.col("v"))) == ["a b c", "x"]


def test_region_keys_and_road_core(spark):
    pairs = ["강원특별자치도 원주시 큰길 3", "강원도 원주시 큰길 3", "강원 원주시 큰길 3 (단구동)"]
    assert len(set(values(spark, pairs, text.region_address_key(F.col("v"))))) == 1
    assert values(spark, ["경기도 부천시 소사로 12-3 2층", "부천시 소사본동 55"], text.road_core(F.col("v"))) == ["소사로123", ""]


@pytest.mark.parametrize(
    "left,right,same",
    [
        ("인천광역시 서구 봄로 7 3층", "인천 서구 봄로 7", True),
        ("인천광역시 서구 봄로 7", "인천광역시 중구 봄로 7 101호", True),  # same road core
        ("봄로", "봄로 7", False),  # prefix is too short
        ("서울 중구 명동 12345", "서울 중구 명동 12345 지하", True),  # prefix of 8 or more
        ("인천 서구 봄로 7", "인천 서구 여름로 8", False),
        ("", "인천 서구 봄로 7", False),
    ],
)
def test_compatible_addresses(spark, left, right, same):
    got = values(spark, [(left, right)], text.addresses_compatible(F.col("a"), F.col("b")), "a string, b string")
    assert got == [same]


def test_markup_is_decoded_before_tags_are_dropped(spark):
    cases = ["<b>하나&amp;둘</b>", "&lt;b&gt;굵게&lt;/b&gt;", "&amp;lt;i&amp;gt;x", "A&#66;&#x43; &#39;", None, "&#99999999999;"]
    got = values(spark, cases, text.strip_markup(F.col("v")))
    assert got == ["하나&둘", "굵게", "x", "ABC '", "", "&#99999999999;"]


def test_prices(spark):
    cases = ["8,000원", "약 12000~15000", "7500.5", "0", "0.4", "무료", None, ""]
    assert values(spark, cases, text.parse_price(F.col("v"))) == [8000, 12000, 7501, None, 0, None, None, None]
    numbers = [9000.4, 0.0, -5.0, math.inf, math.nan, None]
    assert values(spark, numbers, text.parse_price(F.col("v"), numeric=True), "v double") == [9000, None, None, None, None, None]


def test_source_categories_and_districts(spark):
    cases = ["한식업", "중식 전문", "기타외식업(분식)", "카페", "카페업", "미용업", None]
    want = ["한식", "중식", "기타요식업", "기타요식업", None, None, None]
    assert values(spark, cases, text.source_category(F.col("v"))) == want
    assert values(spark, ["인천 미추홀구 주안동", "서울 강남", None], text.find_district(F.col("v"))) == ["미추홀구", "인천", "인천"]


def test_search_texts_and_links(spark):
    schema = "n string, p string"
    got = values(spark, [("하나", "인천"), ("하나", ""), ("", None)], text.search_queries(F.col("n"), F.col("p")), schema)
    assert got == [["하나 인천", "하나"], ["하나"], []]
    link = text.map_link(F.col("u"), F.col("pid"), F.col("n"), F.lit("중구"))
    rows = [("https://x", "1", "n"), (None, "7", "n"), (None, None, "a b(c)")]
    assert values(spark, rows, link, "u string, pid string, n string") == [
        "https://x", "https://map.kakao.com/link/map/7",
        "https://map.kakao.com/?q=a%20b(c)%20%EC%A4%91%EA%B5%AC",
    ]


def test_coordinates(spark):
    cases = ["1266401000", "37.38", "", "x", "99999999999999", None]
    got = values(spark, cases, geo.parse_coordinate(F.col("v"), 180.0))
    assert got == [126.6401, 37.38, None, None, None, None]
    inside = values(spark, [(36.8, 124.0), (38.2, 128.0), (36.79, 126.0), (None, 126.0)],
                    geo.in_bounds(F.col("a"), F.col("b")), "a double, b double")
    assert inside == [True, True, False, False]
    assert values(spark, [(37.27, 127.1)], geo.tile_key(F.col("a"), F.col("b")), "a double, b double") == ["148_507"]


def test_distance_and_travel(spark):
    d = geo.distance_meters(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    got = values(spark, [(37.5, 127.0, 37.5, 127.0), (0.0, 0.0, 0.0, 180.0), (37.27025, 127.1, 37.45001, 127.1), (None, 1.0, 1.0, 1.0)],
                 d, "a double, b double, c double, d double")
    assert got[0] == 0 and got[1] == pytest.approx(math.pi * 6_371_000) and got[3] is None
    assert got[2] == pytest.approx(19988.4, abs=0.1)
    limit = geo.travel_limit_meters(F.col("m"), F.col("t"))
    rows = [("walking", "10"), ("driving", "20"), ("walking", "wide"), ("driving", "wide"), ("flying", "10"), ("walking", None)]
    assert values(spark, rows, F.round(limit, 2), "m string, t string") == [666.67, 8000.0, 2000.0, 20000.0, None, None]
    minutes = geo.travel_minutes(F.col("d"), F.col("m"))
    assert values(spark, [(0.0, "walking"), (667.0, "walking"), (800.0, "driving")], minutes, "d double, m string") == [1, 11, 2]


@pytest.mark.parametrize(
    "name,meal",
    [
        ("비빔밥", True), ("공기 밥", False), ("라면사리", False), ("사리", False), ("사리곰탕", True), ("소인", False),
        ("오늘의 메뉴", False), ("3 가지 메뉴", False), ("양념 소스 추가", False), ("소스볶음", True), ("콜라", False),
        ("콜라겐 국수", True), ("저분자콜라겐", True), ("맥주", False), ("맥주 치킨", True), ("수제IPA", False), ("ipad 세트", True), ("  ", False),
    ],
)
def test_meals(spark, name, meal):
    assert values(spark, [name], menus.is_meal_name(F.col("v"))) == [meal]


PLACE = "name string, category string, place_id string, menus array<struct<name:string,price:bigint>>"


def place(name, items, category="기타요식업", place_id=None):
    return (name, category, place_id, [(m, 9000) for m in items])


def test_cafe_retail_and_display_category(spark):
    cases = [
        (place("하늘카페", []), True, False, None),
        (place("빵집카페", ["아메리카노"]), False, False, "베이커리·디저트"),
        (place("온누리", ["커피", "홍차", "주스", "국수"]), True, False, None),
        (place("온누리", ["커피", "홍차", "국수"]), False, False, None),
        (place("하나식당", ["커피", "홍차"]), False, False, None),
        (place("온누리", ["커피", "나물"]), True, False, None),
        (place("우리정육점", ["불고기"]), False, True, "고기·구이"),
        (place("집앞", ["된장", "고추장 500g", "나물"]), False, True, None),
        (place("순대국집", ["순대국"]), False, False, None),
        (place("시장통", ["순대"]), False, False, "분식·간편식"),
        (place("시장통", ["떡갈비"]), False, False, "고기·구이"),
        (place("시장통", ["꿀떡"]), False, False, "베이커리·디저트"),
        (place("모퉁이", ["수제IPA"]), False, False, "주점·안주"),
        (place("포차", ["안주"], category="한식"), False, False, "한식"),
        (place("아무개", ["안주"], category="중식", place_id="16630201"), False, False, "주점·안주"),
        (place("뷔페횟집", ["생선"]), False, False, "뷔페"),
        (place("온누리", ["MAI TAI", "Whisky"]), False, False, "주점·안주"),
    ]
    df = spark.createDataFrame([(i, *c[0]) for i, c in enumerate(cases)], "i int, " + PLACE)
    got = df.select(
        "i",
        menus.is_cafe(F.col("name"), F.col("menus")).alias("cafe"),
        menus.is_retail(F.col("name"), F.col("menus")).alias("retail"),
        menus.display_category(F.col("category"), F.col("name"), F.col("menus"), F.col("place_id")).alias("shown"),
    ).orderBy("i").collect()
    assert [(r.cafe, r.retail, r.shown) for r in got] == [c[1:] for c in cases]


def test_side_menu_reasons(spark):
    rows = [("볶음밥 추가", 3000), ("상차림", 5000), ("반찬 리필", 1000), ("면 변경", 1000), ("볶음밥", 3000), ("볶음밥 추가", 10001)]
    got = values(spark, rows, menus.side_menu_reason(F.col("n"), F.col("p")), "n string, p bigint")
    assert got == ["볶음밥 추가·변경·리필", "상차림 비용", "리필 항목", "메뉴 변경·교체 비용", None, None]


def test_preferences_round_trip(spark):
    good = '{"category":"한식","budget":"unlimited","travelMode":"walking","travelTimeLimit":"wide"}'
    cases = [
        good,
        '{"category":"전체","budget":15000,"travelMode":"driving","travelTimeLimit":10}',
        '{"category":"분식","budget":99000,"travelMode":"flying","travelTimeLimit":999}',
        '{"category":3,"budget":"15000","travelMode":null,"travelTimeLimit":"10"}',
        "not json", "[1]", "", None,
    ]
    got = values(spark, cases, preferences.parse_preferences(F.col("v")))
    empty = (None, None, None, None)
    assert [tuple(g) for g in got] == [
        ("한식", math.inf, "walking", "wide"), ("전체", 15000.0, "driving", "10"), empty, empty, empty, empty, empty, empty,
    ]
    again = preferences.serialize_preferences(F.col("c"), F.col("b"), F.col("m"), F.col("t"))
    saved = values(spark, [tuple(got[0]), tuple(got[1]), empty], again, "c string, b double, m string, t string")
    assert saved[0] == good and saved[1] == cases[1]
    assert saved[2] == '{"category":null,"budget":null,"travelMode":null,"travelTimeLimit":null}'


def test_entities_of_any_page_survive(spark):
    texts = {
        "&#55357;&#56832;": "😀",
        "a&#xD83D;b": "a�b",
        "&#" + "9" * 5000 + ";": "&#" + "9" * 5000 + ";",
        "&#0000000065;&#x41;": "AA",
        "&#1114112;": "&#1114112;",
        "&#١;": "&#١;",
        "plain": "plain",
        None: "",
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.s for r in df.select("i", text.strip_markup(F.col("t")).alias("s")).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())


def test_reasons_ignore_any_white_space_at_the_ends(spark):
    row = spark.createDataFrame([("　상차림\t", 3000)], "name string, price bigint")
    plain = spark.createDataFrame([("상차림", 3000)], "name string, price bigint")
    reason = menus.side_menu_reason(F.col("name"), F.col("price")).alias("r")
    assert row.select(reason).first().r == plain.select(reason).first().r is not None


def test_rules_match_as_one_regular_expression(spark):
    patterns = [value for name, value in vars(V).items() if name.isupper() and isinstance(value, str) and "|" in value]
    for name in ("BUSINESS_NAME_RULES", "MENU_TEXT_RULES", "AUDIT_CATEGORY_RULES", "SIDE_MENU_RULES"):
        patterns += [pattern for _, pattern in getattr(V, name)]
    patterns += ["ab+c|x?yz", r"\bipa\b|(?:p|q\d)+r", "[|(]k|a{2}b", "a.c", "(?:가|나)?다$"]
    texts = [
        "", " ", "콜라", "콜라겐 팩", "콜라겐 콜라", "떡볶이", "떡 떡볶이", "순대국", "순대", "IPA 한 잔", "pipa", "Tart", "whiskEY", "MAI TAI",
        "사리", "라면  사리 추가", "라면사리(대)", "사리곰탕", "김치 (2.5kg", "김치 2KG", "김치", "원두 200 G", "복분", "복분자", "추가 소스", "핫소스 추가x",
        "3 가지 메뉴", "점심 3 가지 메뉴", "2~3", "바다", "바다횟집", "카페　라떼", "식품판매장", "계란", "계란말이", "abbc", "yz", "q1pr", "(K", "|k",
        "aab", "a\nc", "다", "K", "martını", "공기\n밥", None,
    ]
    texts += [word for pattern in patterns for word in rules._split(pattern)[0]]
    rows = spark.createDataFrame([(t,) for t in dict.fromkeys(texts)], "t string").repartition(4).cache()
    patterns = list(dict.fromkeys(patterns))
    for start in range(0, len(patterns), 12):
        some = patterns[start : start + 12]
        plain = [F.coalesce(F.col("t").rlike(rules.java_regex(p)), F.lit(False)) for p in some]
        differs = [(rules.matches(F.col("t"), p) != whole).cast("int") for p, whole in zip(some, plain, strict=True)]
        found = rows.select(*[F.sum(d).alias(str(i)) for i, d in enumerate(differs)]).first()
        assert {p: n for p, n in zip(some, found, strict=True) if n} == {}


def test_words_of_rules_are_no_regular_expressions():
    words, rest, guards = rules._split(V.BEVERAGE_OR_ALCOHOL)
    assert "소주" in words and rest == r"복분자주?|whisk(?:y|ey)|vodka|tequila|martini|mai tai|beer|\bipa\b|콜라(?!겐)"
    assert guards == ["복분자", "whisk", "vodka", "tequila", "martini", "mai tai", "beer", "ipa", "콜라"]
    assert rules._split(V.SUBSTANTIAL_MEAL)[1:] == ("", [])
    assert rules._split(r"\d+|가") == (["가"], r"\d+", None)
