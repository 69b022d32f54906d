"""Word lists, patterns, thresholds and formats.

Every value in this file is part of the data contract: results are only right
if these stay exactly as they are, in this order. Logic lives elsewhere.

Patterns are written in the common subset of regular expressions (ASCII word
boundary ``\\b``, Unicode white space ``\\s``); ``functions.rules.java_regex``
turns them into the Java dialect Spark evaluates.
"""

# --- Vocabularies -----------------------------------------------------------

SOURCE_CATEGORIES = ("한식", "중식", "일식", "양식", "기타요식업")
OTHER_SOURCE_CATEGORY = "기타요식업"
DISPLAY_CATEGORIES = (
    "한식", "중식", "일식", "양식", "분식·간편식", "치킨·피자", "베이커리·디저트",
    "샐러드·브런치", "뷔페", "아시아음식", "해산물·회", "고기·구이", "주점·안주",
)
ALL_CATEGORIES = "전체"

VERIFICATION_PROVIDER = "kakao"
STATUS_CONFIRMED = "confirmed"
STATUS_UNVERIFIED = "unverified"
MATCHED_BY_ADDRESS = "name-address"
MATCHED_BY_COORDINATES = "name-coordinates"

REASON_PLACE_ID = "confirmed-kakao-place-id"
REASON_NAME_ADDRESS = "name-address"
REASON_NEARBY = "name-nearby-coordinates"

FOOD_GROUP_CODES = ("FD6", "CE7")

BUDGET_OPTIONS = (10_000.0, 15_000.0, 20_000.0, float("inf"))
UNLIMITED_BUDGET_TEXT = "unlimited"
TRAVEL_MODES = ("walking", "driving")
TIME_LIMITS_MINUTES = (10, 20)
TIME_LIMIT_WIDE = "wide"

MAP_LINK_PREFIX = "https://map.kakao.com/link/map/"
MAP_SEARCH_PREFIX = "https://map.kakao.com/?q="

SOURCE_NAMES = ("good-price", "incheon-smart-food")

# --- Thresholds -------------------------------------------------------------

EARTH_RADIUS_METERS = 6_371_000.0
WALKING_METERS_PER_MINUTE = 4_000.0 / 60
DRIVING_METERS_PER_MINUTE = 24_000.0 / 60
WALKING_WIDE_METERS = 2_000.0
DRIVING_WIDE_METERS = 20_000.0

TILE_DEGREES = 0.25
TILE_OFFSET = 0.2

NEARBY_DUPLICATE_METERS = 50.0
MIN_NAME_KEY_LENGTH = 2
PLACE_HIT_MAX_METERS = 500.0
PLACE_HIT_NAME_ONLY_METERS = 150.0
LOCAL_HIT_MAX_METERS = 150.0
MIN_PREFIX_ADDRESS_LENGTH = 8
MIN_CONFIRMED_COVERAGE = 0.2
MIN_SNAPSHOT_RATIO = 0.5
MIN_IMPORT_ROWS = 1_000
SIDE_MENU_MAX_PRICE = 10_000
MEAL_PRICE_RANGE = (1_000, 1_000_000)
BOUNDS_LATITUDE = (36.8, 38.2)
BOUNDS_LONGITUDE = (124.0, 128.0)
MATCH_POLICY_VERSION = 2
CARD_MENU_COUNT = 8
CHANGE_LIST_LIMIT = 100
ROUTE_TARGET_METERS = (300.0, 800.0, 1_500.0, 3_000.0, 6_000.0, 10_000.0)
MAX_ROUTE_TARGETS = 10
LOCATION_RESULT_LIMIT = 5
LOCATION_ADDRESS_LIMIT = 3

# --- Text keys --------------------------------------------------------------

COMPANY_MARKS = r"\(주\)|㈜|주식회사"
KEY_DROP = r"[^0-9a-z가-힣]"
HOME_REGION_WORDS = r"인천광역시|인천시|인천"
PARENTHESES = r"\([^)]*\)"
ROAD_CORE = r"([0-9a-z가-힣]+(?:대로|로|길))\s*(\d+(?:-\d+)?)"
DISTRICTS = r"(미추홀구|연수구|남동구|부평구|계양구|강화군|옹진군|중구|동구|서구)"
DEFAULT_DISTRICT = "인천"
HOME_PROVINCE = "인천광역시"
HOME_ID_PREFIX = "incheon-"

REGION_ALIASES = (
    (r"서울특별시|서울시", "서울"),
    (r"부산광역시|부산시", "부산"),
    (r"대구광역시|대구시", "대구"),
    (r"인천광역시|인천시", "인천"),
    (r"광주광역시|광주시", "광주"),
    (r"대전광역시|대전시", "대전"),
    (r"울산광역시|울산시", "울산"),
    (r"세종특별자치시|세종시", "세종"),
    (r"경기도", "경기"),
    (r"강원특별자치도|강원도", "강원"),
    (r"충청북도", "충북"),
    (r"충청남도", "충남"),
    (r"전북특별자치도|전라북도", "전북"),
    (r"전라남도", "전남"),
    (r"경상북도", "경북"),
    (r"경상남도", "경남"),
    (r"제주특별자치도|제주도", "제주"),
)

# Named entities in the order they are decoded; numeric ones come after them.
MARKUP_ENTITIES = (
    (r"(?i)&amp;", "&"),
    (r"(?i)&quot;", '"'),
    (r"(?i)&#39;|&apos;", "'"),
    (r"(?i)&lt;", "<"),
    (r"(?i)&gt;", ">"),
)
MARKUP_TAG = r"<[^>]*>"

# --- Menu and business-name patterns (case is ignored) ----------------------

ACCESSORY_MENU = r"공기\s*밥|추가\s*밥|밥\s*추가|보쌈\s*속|무채|토핑|사리(?:\s*(?:추가|$)|[(/])|(?:라면|우동|쫄면|당면|칼국수|냉면|떡|치즈)\s*사리"
VAGUE_OR_CHILD_MENU = r"유아|미취학|초등학생|소인|^(?:본채|바다|오늘의 메뉴|점심특선메뉴|탕종류|\d+\s*가지 메뉴|\d+\s*~\s*\d+)$"
STANDALONE_SAUCE = r"^(?:추가\s*)?(?:핫|양념|마늘|간장|매운)?\s*소스(?:\s*추가)?$"
BEVERAGE_OR_ALCOHOL = r"소주|맥주|막걸리|동동주|청하|매화수|복분자주?|고량주|와인|하이볼|사케|정종|전통주|백세주|산사춘|담금주|오디뽕주|야관문주|칵테일|위스키|whisk(?:y|ey)|보드카|vodka|양주|데킬라|테킬라|tequila|martini|mai tai|beer|비어|스타우트|에일|\bipa\b|콜라(?!겐)|사이다|환타|탄산|음료|생수|주스|쥬스|에이드|커피|아메리카노|카페라떼|스무디|식혜"
MEAL_SIGNAL = r"정식|백반|밥|국|탕|찌개|전골|면|국수|냉면|라면|우동|파스타|피자|치킨|족발|보쌈|고기|갈비|삼겹|스테이크|버거|김밥|떡볶이|만두|샐러드|볶음|구이|튀김|파전|김치전|해물전|부추전|감자전|빈대떡|찜|죽|덮밥|돈가스|돈까스|회|초밥|스시|카레|쌈|수육"
CAFE_NAME = r"카페|커피숍|커피|다방|찻집|약차|티룸|cafe|coffee|로스터리|로스터스|스타벅스|투썸플레이스|이디야|폴바셋|할리스|탐앤탐스|커피빈|엔제리너스"
BAKERY_NAME = r"베이커리|제과|제빵|빵집|브레드|도넛|bakery|쌀빵"
CAFE_MENU = r"아메리카노|에스프레소|카페\s*라떼|카페\s*모카|카푸치노|마끼아또|마키아또|콜드\s*브루|더치\s*커피|핸드\s*드립|커피|라떼|스무디|에이드|아이스\s*티|허브\s*티|블랙\s*티|캐모마일|페퍼민트|얼그레이|루이보스|녹차|홍차|밀크\s*티|프라푸치노|블렌디드|주스|쥬스|대추차|유자차|생강차|쌍화차|한방차|전통차|오미자차|수제차|미숫가루|식혜|핫초코"
SUBSTANTIAL_MEAL = r"분식|정식|백반|비빔밥|볶음밥|덮밥|국밥|김밥|국수|냉면|라면|우동|파스타|피자|치킨|족발|보쌈|고기|갈비|삼겹|스테이크|버거|떡볶이|만두|샌드위치|샐러드|브런치|찌개|전골|곰탕|설렁탕|칼국수|수제비|돈가스|돈까스|초밥|스시|카레|수육|토스트|핫도그|오믈렛|해물파전|김치전|파전|부추전|감자전|튀김|구이|볶음|찜"
SUBSTANTIAL_BUSINESS_NAME = r"분식|식당|정식|백반|국밥|김밥|국수|냉면|라면|파스타|피자|치킨|족발|보쌈|고깃집|고기집|갈비|스테이크|버거|떡볶이|만두|샌드위치|샐러드|브런치|찌개|전골|칼국수|수제비|돈가스|돈까스|초밥|스시|카레|수육|토스트|핫도그"
SALAD_OR_BRUNCH = r"샐러드|브런치|샌드위치|sandwich|산도"
CHICKEN_OR_PIZZA = r"치킨|통닭|닭강정|피자|햄버거|버거|프라이드치킨"
QUICK_MEAL = r"분식|김밥|떡볶이|순대(?!국)|어묵|오뎅|라볶이|토스트|핫도그|닭꼬치|떡꼬치|만두|브리또|부리또|전복죽|야채죽|소고기죽"
BAKERY_OR_DESSERT = r"베이커리|베이크|베이킹|제과|제빵|과자점|과자|빵집|빵|브레드|bread|베이글|bagel|도넛|도너츠|도너트|bakery|크루아상|크로와상|croissant|꽈배기|찐빵|호떡|붕어빵|고로케|마카롱|케이크|케익|cake|와플|크로플|아이스크림|빙수|젤라또|디저트|쿠키|cookie|휘낭시에|스콘|타르트|tart|카스테라|카스텔라|호두과자|호도|푸딩|츄러스|브라우니|brownie|파이|pie|머핀|muffin|만주|월병|다쿠와즈|모찌|인절미|백설기|절편|개떡|약식|강정|오란다|정과|한과|팥죽|호박죽|떡방|떡집|떡(?!볶이|갈비|만두)"
BUFFET = r"뷔페|부페|buffet"
BUFFET_OR_EVENT = r"호텔|파티하우스|파티|조식|미취학|소인|대인|무한리필"
ASIAN_FOOD = r"쌀국수|마라|샤브|월남쌈|타코|케밥|팟타이|나시고랭|인도커리|똠얌|반미"
JAPANESE_FOOD = r"마제소바|초밥|스시|우동|카레|돈가스|돈까스|돈카츠"
SEAFOOD = r"꼼장어|곰장어|장어|횟집|모듬회|생선회|회덮밥|사시미|광어|우럭|연어|참치|낙지|오징어|주꾸미|쭈꾸미|문어|조개|굴|해물|아귀|복어|대게|꽃게|게장|새우|골뱅이|과메기|생선"
MEAT_OR_GRILL = r"곱창|막창|대창|고깃집|고기집|숯불|직화|삼겹|갈비|불고기|육회|닭갈비|오리|바비큐|바베큐|스테이크|제육|두루치기|돼지껍데기"
PUB_OR_SNACK = r"포차|호프|주점|펍|pub|술집|먹태|노가리|짝태|이자카야|오뎅바|막걸리|칵테일|위스키|whisk(?:y|ey)|보드카|vodka|양주|beer|비어|스타우트|에일|\bipa\b|martini|tequila|안주|빈대떡|모듬전"
BAKERY_OR_DESSERT_BUSINESS = r"베이커리|베이크|베이킹|제과|제빵|과자점|빵집|브레드|베이글|도넛|도너츠|도너트|bakery|파리바게뜨|파리바게트|뚜레쥬르|설빙|떡방|떡집"
ASIAN_FOOD_BUSINESS = r"쌀국수|마라|훠궈|양꼬치|샤브|월남쌈|타코|케밥|팟타이|나시고랭|인도커리|인디아|사이공|똠얌|반미"
PUB_OR_SNACK_BUSINESS = r"포장마차|포차|호프|주점|펍|pub|술집|맥주집|비어|이자카야|오뎅바|주막"
NON_RESTAURANT_BUSINESS = r"축산물|정육점|정육마트|반찬가게|반찬점|식품(?:판매장)?|김치(?:가게|판매|$)|먹을거리|계란$"
RETAIL_PRODUCT = r"고추장|된장|막장|김치\s*\(?\d+(?:\.\d+)?\s*kg|원두\s*\d+\s*g"

# --- Ordered rule tables: (label, pattern), first match wins -----------------

BUSINESS_NAME_RULES = (
    ("뷔페", BUFFET),
    ("베이커리·디저트", BAKERY_OR_DESSERT_BUSINESS),
    ("아시아음식", ASIAN_FOOD_BUSINESS),
    ("일식", JAPANESE_FOOD),
    ("주점·안주", PUB_OR_SNACK_BUSINESS),
    ("해산물·회", SEAFOOD),
    ("샐러드·브런치", SALAD_OR_BRUNCH),
    ("치킨·피자", CHICKEN_OR_PIZZA),
    ("분식·간편식", QUICK_MEAL),
    ("고기·구이", MEAT_OR_GRILL),
)

MENU_TEXT_RULES = (
    ("아시아음식", ASIAN_FOOD),
    ("일식", JAPANESE_FOOD),
    ("샐러드·브런치", SALAD_OR_BRUNCH),
    ("치킨·피자", CHICKEN_OR_PIZZA),
    ("분식·간편식", QUICK_MEAL),
    ("베이커리·디저트", BAKERY_OR_DESSERT),
    ("뷔페", BUFFET),
    ("뷔페", BUFFET_OR_EVENT),
    ("주점·안주", PUB_OR_SNACK),
    ("해산물·회", SEAFOOD),
    ("고기·구이", MEAT_OR_GRILL),
)

# Curated display categories by external place id.
CURATED_CATEGORIES = {
    "1136047260": "베이커리·디저트",
    "10199351": "아시아음식",
    "13657074": "주점·안주",
    "16630201": "주점·안주",
    "24481763": "베이커리·디저트",
    "1422120170": "아시아음식",
}

AUDIT_CATEGORY_RULES = (
    ("샐러드·브런치", r"샐러드|브런치|샌드위치|sandwich|산도"),
    ("치킨·피자", r"치킨|통닭|닭강정|피자|햄버거|버거|프라이드치킨"),
    ("분식·간편식", r"분식|김밥|떡볶이|순대(?!국)|어묵|오뎅|라볶이|토스트|핫도그|닭꼬치|떡꼬치|만두|브리또|부리또"),
    ("베이커리·디저트", r"베이커리|제과|제빵|빵집|브레드|베이글|도넛|크루아상|꽈배기|마카롱|케이크|와플|아이스크림|빙수|젤라또|디저트|쿠키|휘낭시에|스콘|타르트|떡집|떡방"),
    ("뷔페", r"뷔페|부페|buffet"),
    ("아시아음식", r"쌀국수|마라|샤브|월남쌈|타코|케밥|팟타이|나시고랭|인도커리|똠얌|반미"),
    ("중식", r"짜장|자장|짬뽕|탕수육|깐풍|유산슬|양장피|중화요리|중국집"),
    ("일식", r"마제소바|초밥|스시|우동|돈가스|돈까스|돈카츠|라멘|사시미|일식"),
    ("주점·안주", r"포차|호프|주점|펍|pub|술집|먹태|노가리|짝태|이자카야|오뎅바|안주"),
    ("해산물·회", r"꼼장어|곰장어|장어|횟집|모듬회|생선회|회덮밥|사시미|광어|우럭|연어|참치|낙지|오징어|주꾸미|쭈꾸미|문어|조개|굴|해물|아귀|복어|대게|꽃게|게장|새우|생선"),
    ("고기·구이", r"곱창|막창|대창|고깃집|고기집|숯불|직화|삼겹|갈비|불고기|육회|닭갈비|오리|바비큐|바베큐|스테이크|제육|두루치기|돼지껍데기"),
    ("양식", r"파스타|리조또|라자냐|오믈렛|필라프|양식"),
    ("한식", r"한식|백반|국밥|찌개|전골|설렁탕|곰탕|칼국수|수제비|냉면|보쌈|족발|비빔밥"),
)

SIDE_MENU_RULES = (
    ("볶음밥 추가·변경·리필", r"볶음\s*밥.*(?:추가|변경|교체|리필)|(?:추가|후식|마무리|변경|교체|리필).*볶음\s*밥"),
    ("상차림 비용", r"^상차림$|상차림\s*(?:비|비용|별도|가격|대|[(/]?\s*(?:1(?:인|人)|한상|소1(?:인|人)|대1(?:인|人)))|1(?:인|人)\s*상차림"),
    ("리필 항목", r"(?:^|\s)(?:밥|반찬|육수|면|사리|소스)?\s*리필(?:\s*(?:비|가격))?(?:$|\s)"),
    ("메뉴 변경·교체 비용", r"(?:메뉴|사이즈|밥|면|사리|음료)\s*(?:변경|교체)|(?:변경|교체)\s*(?:비|가격)"),
)

# Source B: business-type words, then menu words, then the catch-all category.
BUSINESS_TYPE_RULES = (
    ("한식", r"한식"),
    ("중식", r"중식|중국"),
    ("일식", r"일식|일본"),
    ("양식", r"양식"),
)
MENU_KEY_RULES = (
    ("중식", r"중식|중국|짜장|자장|짬뽕|마라|탕수육|양꼬치"),
    ("일식", r"일식|일본|초밥|스시|사시미|돈카츠|돈까스|라멘|우동"),
    ("양식", r"양식|이탈리|파스타|피자|스테이크|프렌치|브런치"),
    ("한식", r"한식|한정식|국밥|백반|찌개|갈비|삼겹살|냉면|설렁탕|곰탕|보쌈|족발|칼국수"),
)
ADD_ON_OR_DRINK = r"공기밥|사리|추가|곱빼기|곱배기|토핑|소스|음료|콜라|사이다|주류|소주|맥주|막걸리|청하|백세주|산사춘|복분자|고량주|와인"

# Source A: a category key that starts with one of these words is that word.
CATEGORY_PREFIXES = ("한식", "중식", "일식", "양식")
CATEGORY_OTHER_WORDS = ("기타요식", "기타외식")
CATEGORY_OTHER_EXACT = "카페"

# --- Column names of the raw sources ------------------------------------------

WIDE_COLUMNS = {
    "province": "시도", "district": "시군", "category": "업종",
    "name": "업소명", "phone": "연락처", "address": "주소",
}
WIDE_MENU_COUNT = 4
WIDE_MENU_NAME = "메뉴{}"
WIDE_MENU_PRICE = "가격{}"

PLACE_FILE_HEADERS = {
    "식당(ID)": "RSTR_ID",
    "식당명": "RSTR_NM",
    "지점명": "BRNCH_NM",
    "도로명주소": "ROAD_NM_ADDR",
    "지번주소": "LOTNO_ADDR",
    "식당위도": "RSTR_LAT",
    "식당경도": "RSTR_LOT",
    "식당대표전화번호": "RSTR_RPRS_TELNO",
    "영업신고증업태명": "BIZ_CRTFCT_BZSTAT_NM",
    "영업인허가명": "BIZ_LCPMT_NM",
    "식당소개내용": "RSTR_EXPLN_CN",
}
MENU_FILE_HEADERS = {
    "메뉴(ID)": "MENU_ID",
    "메뉴명": "MENU_NM",
    "메뉴가격": "MENU_PRC",
    "지역특산메뉴여부": "SPCLT_MENU_YN",
    "지역특산메뉴명": "SPCLT_MENU_NM",
    "지역특산메뉴출처(URL)": "SPCLT_MENU_SRC_URL",
    "지역명": "RGN_NM",
    "식당(ID)": "RSTR_ID",
    "식당명": "RSTR_NM",
    "지점명": "BRNCH_NM",
}

# Fields two snapshots are compared on, in report order.
COMPARED_FIELDS = (
    "name", "category", "province", "district", "phone", "address",
    "latitude", "longitude", "menus", "kakaoPlaceId", "kakaoPlaceUrl",
    "placeVerification",
)
