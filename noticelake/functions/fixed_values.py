"""Tables and patterns that results depend on."""

# fixed values: ordered classification rules (category, keywords); the first rule with a keyword in the text wins
CATEGORY_RULES = [
    ("段考考試", ["段考", "期中考", "期末考", "定期考", "補考", "考試範圍", "考試訊息", "模擬考", "學測", "分科測驗", "會考", "英聽", "試場", "考程", "准考證", "重補修"]),
    ("升學", ["升學", "繁星", "申請入學", "分發", "特殊選才", "學習歷程", "志願", "大學營", "科系", "面試", "選填", "四技二專"]),
    ("獎助學金", ["獎學", "獎助", "助學", "就學貸款", "學雜費減免", "補助金", "工讀"]),
    ("榮譽榜", ["榮獲", "恭賀", "恭喜", "得獎名單", "佳績", "獲獎", "金牌", "銀牌", "銅牌", "特優", "冠軍", "亞軍", "季軍", "入選"]),
    ("競賽", ["競賽", "比賽", "初賽", "決賽", "複賽", "奧林匹亞", "科展", "徵文", "徵稿", "盃", "語文競賽", "辯論"]),
    ("社團", ["社團", "社課", "社博", "成果發表", "班聯會", "熱音", "熱舞", "校隊", "迎新", "社慶"]),
    ("研習活動", ["研習", "講座", "營隊", "工作坊", "參訪", "體驗", "博覽會", "宣導", "演講", "活動"]),
    ("招生編班", ["招生", "簡章", "甄選入學", "編班", "新生", "轉學", "報到", "入學"]),
    ("行政公告", ["招標", "採購", "徵才", "代理教師", "教師甄選", "場地", "停車", "系統維護", "停電", "施工", "問卷"]),
]
DEFAULT_CATEGORY = "一般"

# fixed values: category -> topic slug
CATEGORY_SLUGS = {
    "段考考試": "exam",
    "升學": "admission",
    "獎助學金": "scholarship",
    "榮譽榜": "honor",
    "競賽": "contest",
    "社團": "club",
    "研習活動": "event",
    "招生編班": "enroll",
    "行政公告": "admin",
    "一般": "general",
}
DEFAULT_SLUG = "general"

# fixed values: how far a date's provenance is trusted
DATE_SOURCE_RANK = {"first_seen": 0, "list": 1, "persisted": 2, "article_meta": 3, "publication": 4}

# fixed values: patterns (Java regular expressions)
SPACE = r"(?U)[\s\x1c-\x1f]+"
DATE = r"(20(?U:\d){2})[-/.]((?U:\d){1,2})[-/.]((?U:\d){1,2})"
PUBLICATION_DATE = r"(?U)發[佈布]日期\s*[:：]\s*(20\d{2})[-/.](\d{1,2})[-/.](\d{1,2})"
MOJIBAKE = "[\ufffd\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]|[ÃÂ][\\x80-\\xBF]|â[\\x80-\\xBF]{2}|[äæå][\\x80-\\xBF]\\S"
OUTLINE = r"^(\d+(?:-\d+)*)\s*[.、．]\s*(.+)$"
LIST_PAGE = r"/p/403-(\d+)-(\d+)-\d+\.php"
MENU_PAGE = r"/p/412-(\d+)-(\d+)\.php"
ARTICLE_PAGE = r"/p/406-(\d+)-(\d+)(?:,r(\d+))?\.php"
TAB_NUMBER = r"Type=mobile_rcg_mstr&(?:amp;)?Nbr=(\d+)"
MORE_LABELS = ("MORE", "更多")
MENU_KEYWORDS = ("最新消息", "公告", "訊息", "宿舍", "住宿")

# fixed values: limits
DETAIL_PER_SCHOOL = 12
BACKFILL_LIMIT = 80
BACKFILL_HOURS = (7, 11, 15, 19)
COLD_HOURS = 20
MAX_ITEMS = 6000
PUSH_LIMIT = 20
SUMMARY_THRESHOLD = 8
NOTIFIED_KEPT = 500
PAGE_SIZE = 200
COMMON_TITLE_MIN_PAGES = 4
SNIPPET_CHARS = 1000
MAX_CATEGORY_ID = 1500
NO_CATEGORY = 1_000_000_000
