"""Results depend on them being exactly these.

Every operator takes them as parameters with these defaults.
"""

# Days around an event at which the price index is read.
HORIZONS = [-30, -21, -14, -10, -7, -5, -3, -1, 0, 1, 2, 3, 5, 7, 10, 14, 21, 30]

# Items whose mean price stands for a sector.
SECTOR_BASKETS = {
    "Honing": ["위대한 명예의 돌파석", "경이로운 명예의 돌파석", "찬란한 명예의 돌파석", "정제된 파괴강석"],
    "Gem": ["10레벨 멸화의 보석", "9레벨 멸화의 보석", "7레벨 멸화의 보석"],
    "Engraving": ["원한 각인서", "예리한 둔기 각인서"],
}

# Score that weights a training row, and score whose effect must not be negative.
WEIGHT_SCORE = {"Honing": "honing_mat_demand", "Gem": "gem_demand", "Engraving": "honing_mat_demand"}
MONOTONE_SCORE = {"Honing": "honing_mat_demand", "Gem": "gem_demand", "Engraving": "gem_demand"}

# Scores that may only raise a sector's index.
RISING_SCORES = {"Honing": ["honing_mat_demand", "content_difficulty"], "Gem": ["gem_demand"], "Engraving": ["gem_demand"]}

SECTOR_FEATURES = ["honing_mat_demand", "gem_demand", "gold_inflation", "content_difficulty"]
FRAME_FEATURES = [
    "honing_mat_demand", "gem_demand", "gold_inflation", "content_difficulty",
    "event_count", "is_event_day", "is_weekend",
    "is_honing_mat", "is_gem", "is_engraving", "is_consumable", "is_other",
]

SCENARIO_FEATURES = [*FRAME_FEATURES, "honing_mat_supply", "gem_supply"]

# Item classes; the first class with a matching substring wins, else "other".
ITEM_CLASSES = [
    ("honing_mat", ["명파", "오레하", "파괴석", "수호석", "돌파석"]),
    ("gem", ["보석", "젬"]),
    ("engraving", ["각인", "서"]),
    ("consumable", ["주머니", "상자"]),
]

ENGRAVING_SUBSTRING = "각인서"

# Items whose reaction to strong demand events is measured.
BETA_ITEMS = [
    "아비도스 융화 재료", "상급 아비도스 융화 재료",
    "오레하 융화 재료", "상급 오레하 융화 재료", "최상급 오레하 융화 재료",
    "운명의 돌파석", "위대한 운명의 돌파석",
    "위대한 명예의 돌파석", "경이로운 명예의 돌파석", "찬란한 명예의 돌파석",
    "빙하의 숨결", "용암의 숨결",
    "태양의 은총", "태양의 축복", "태양의 가호",
    "야금술 : 심화 [13-15]", "재봉술 : 심화 [13-15]",
    "명예의 파편 주머니(소)", "명예의 파편 주머니(중)", "명예의 파편 주머니(대)",
    "운명의 파편 주머니(소)", "운명의 파편 주머니(중)", "운명의 파편 주머니(대)",
    "파괴강석", "정제된 파괴강석", "수호강석", "정제된 수호강석",
    "운명의 파괴석", "운명의 수호석", "운명의 파괴석 결정", "운명의 수호석 결정",
    "(유물)원한 각인서", "(유물)예리한 둔기 각인서", "(유물)돌격대장 각인서",
    "(유물)아드레날린 각인서", "(유물)저주받은 인형 각인서", "(유물)타격의 대가 각인서",
    "(유물)각성 각인서", "(유물)전문의 각인서",
]

# Old item -> current item; None drops the item.
TIER_MAPPING = {
    "오레하 융화 재료": "아비도스 융화 재료",
    "상급 오레하 융화 재료": "상급 아비도스 융화 재료",
    "최상급 오레하 융화 재료": None,
    "명예의 파편 주머니(소)": "운명의 파편 주머니(소)",
    "명예의 파편 주머니(중)": "운명의 파편 주머니(중)",
    "명예의 파편 주머니(대)": "운명의 파편 주머니(대)",
    "위대한 명예의 돌파석": "위대한 운명의 돌파석",
    "경이로운 명예의 돌파석": "운명의 돌파석",
    "찬란한 명예의 돌파석": "위대한 운명의 돌파석",
    "파괴강석": "운명의 파괴석",
    "정제된 파괴강석": "운명의 파괴석 결정",
    "수호강석": "운명의 수호석",
    "정제된 수호강석": "운명의 수호석 결정",
    "태양의 은총": "빙하의 숨결",
    "태양의 축복": "용암의 숨결",
    "태양의 가호": "용암의 숨결",
    "야금술 : 심화 [13-15]": None,
    "재봉술 : 심화 [13-15]": None,
    "10레벨 멸화의 보석": "10레벨 멸화의 보석 (T4 계승)",
    "9레벨 멸화의 보석": "9레벨 멸화의 보석 (T4 계승)",
}

# Keyword flags over event keywords, matched without regard to case.
EVENT_FLAGS = {
    "is_gold_nerf": ["Gold Nerf", "Gold Reduction"],
    "is_new_raid": ["New Raid", "Raid"],
    "is_t4": ["T4", "Tier 4"],
    "is_gem": ["Gem"],
    "is_package": ["Package"],
}
SENTIMENT = {"positive": 1, "neutral": 0, "negative": -1}

# Broadcast notices: any of the first, none of the second.
BROADCAST_WORDS = ["방송", "라이브", "LOA ON", "로아온", "쇼케이스", "프리뷰"]
BROADCAST_VIEW_WORDS = ["방송", "라이브", "LOA ON", "로아온", "쇼케이스", "프리뷰", "편지", "코멘트", "소통"]
BROADCAST_EXCLUDED = ["당첨자", "리샤의 편지", "설정집", "모험가"]

# Post titles need one word of each list; some words earn a bonus.
POST_STREAM_WORDS = [
    "로아온", "방송", "라이브", "디렉터", "쇼케이스", "전재학", "금강선", "특별", "공지",
    "preview", "on air", "기록", "속보", "캠프",
]
POST_TYPE_WORDS = ["요약", "정리", "후기", "내용", "중계", "발표", "텍스트", "스크립트", "모음"]
POST_BONUS = {"로아온": 50, "요약": 30, "on air": 20}

# Notices worth scoring, and the text a failed fetch leaves behind.
SCORED_TYPES = ["Update", "Major Update", "Event", "Official Notice"]
MISSING_CONTENT = "Content not found"

# Words in a notice that force a score of 8, and the audit tags they leave.
SUPPLY_WORDS = ["보상", "지급", "선물", "기념"]
DEMAND_WORDS = ["회수", "조치", "버그 악용", "랭킹"]
SUPPLY_TAG = " | Python_Keyword_Override_Supply"
DEMAND_TAG = " | Python_Keyword_Override_Demand"

# Words that mark an item as not tradeable.
FORBIDDEN_ITEM_WORDS = [
    "카드", "Card", "계승", "쐐기", "눈", "나팔", "관문", "경험치", "실링", "귀속", "캐릭터", "슬롯",
]

ITEM_GRADES = ["일반", "고급", "희귀", "영웅", "전설", "유물", "고대"]

# Shown names of event types.
TYPE_LABELS = {"Roadmap Item": "로드맵 예고", "Stream Summary": "방송 요약"}

# Score fields of an event.
EVENT_SCORES = [
    "honing_mat_supply", "honing_mat_demand", "gem_supply", "gem_demand", "engraving_supply",
    "card_supply", "gold_inflation", "gold_sink", "content_difficulty", "package_volume",
]

# Broadcast time patterns in order of priority.
BROADCAST_TIME_DOTTED = r"(\d{4})\.(\d{1,2})\.(\d{1,2}).*?(\d{1,2}):(\d{2})"
BROADCAST_TIME_KOREAN = r"(?:(\d{4})년\s*)?(\d{1,2})월\s*(\d{1,2})일.*?(오전|오후)?\s*(\d{1,2})시"
BROADCAST_TIME_SLASHED = r"(\d{1,2})/(\d{1,2})\s+(\d{1,2}):(\d{2})"
MORNING, AFTERNOON = "오전", "오후"

# Notice listing patterns.
NOTICE_ROW = r'(?s)<li class="(.*?)">(.*?)</li>'
NOTICE_ID = r'href="/News/Notice/(?:Notice)?Views/(\d+)\?.*?"'
NOTICE_TITLE = r'<span class="list__title">(.*?)</span>'
NOTICE_CATEGORY = r'<span class="icon.*?>(.*?)</span>'
NOTICE_DATE = r'<div class="list__date"[^>]*>(.*?)</div>'
JSON_BLOCK = r"(?s)(\{.*\}|\[.*\])"

# Decision rules as (rule, outcome, confidence).
DECISION_RULES = [
    ("honing_mat_demand > 7 & is_pre_announced == False", "재련 재료 T+7 급등 (Surge)", "95%"),
    ("gem_demand > 8 & content_difficulty > 6", "고레벨 범용 보석 장기 우상향", "92%"),
    ("gold_inflation > 7 & gold_sink < 3", "시장 전반적인 파괴강석/돌파석 명목가 상승", "88%"),
    ("Score == 0 & is_weekend == True", "통상적인 주말 수요 반등 (소폭 상승)", "78%"),
]

# Thresholds.
STRONG_SCORE = 7
WIN_RETURN_PCT = 3.0
SPIKE_FACTOR = 1.5
SPIKE_KEPT_SHARE = 0.25
SELL_FEE = 0.05
UP_INDEX = 101.0
DEFAULT_LEAD_DAYS = 7
MIN_TRAIN = 3
COARSE_FOLD = 50
FINAL_EVENTS = 10
EXCESS_LOW, EXCESS_HIGH = -0.5, 5.0
PRIORITY_BONUS = 9999
MIN_POST_LENGTH = 100
MIN_CONTENT_LENGTH = 50
ALERT_SCORE = 7
