"""Controlled vocabularies.

They are plain parameters: each operator that needs one takes it as an argument and falls back to
the values below, so a graph about something else brings its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: relation types as (label, category, directed) -------------------------------
RELATION_TYPES: dict[str, tuple[str, str, bool]] = {
    "BELONGS_TO": ("归属", "myth", True),
    "PROTOTYPE_IS": ("同一原型", "myth", False),
    "GENDER_SWAP": ("性转", "myth", False),
    "DERIVED_FROM": ("衍生", "myth", True),
    "COMPOSITE_OF": ("复合", "myth", True),
    "PARENT_OF": ("父母", "family", True),
    "SIBLING_OF": ("兄弟姐妹", "family", False),
    "SPOUSE_OF": ("配偶", "family", False),
    "LOVER_OF": ("恋人", "family", False),
    "MASTER_OF": ("主人", "social", True),
    "ALLY_OF": ("盟友", "social", False),
    "ENEMY_OF": ("敌对", "social", False),
    "FOUGHT_WITH": ("交手", "social", False),
    "MENTOR_OF": ("师傅", "social", True),
}

# --- fixed values: types stored the other way round ---------------------------------------------
INVERSE_TYPES: dict[str, str] = {
    "CHILD_OF": "PARENT_OF",
    "SERVANT_OF": "MASTER_OF",
    "STUDENT_OF": "MENTOR_OF",
}

FAMILY_TYPES = ("PARENT_OF", "SIBLING_OF", "SPOUSE_OF", "LOVER_OF")

# --- fixed values: small enums -------------------------------------------------------------------
CONFIDENCES = ("low", "medium", "high", "verified")
ORIGINS = ("manual", "llm", "user", "wiki")
STATUSES = ("approved", "pending", "rejected")

MYTHOLOGIES = (
    "希腊神话", "罗马神话", "北欧神话", "凯尔特神话", "不列颠神话", "埃及神话", "美索不达米亚神话",
    "波斯神话", "印度神话", "中国神话", "日本神话", "阿兹特克神话", "玛雅神话", "非洲神话",
    "斯拉夫神话", "芬兰神话", "基督教", "现代创作", "史实人物", "其他",
)

# Labels that stand in for a missing group.
OTHER_GROUP = "其他"
UNGROUPED = "未归类"

# Entity classes with a special role.
PROTOTYPE_CLASS = "原型"
MYTH_PERSON_CLASS = "神话人物"

# --- fixed values: region keyword -> mythology, first match wins ---------------------------------
REGION_KEYWORDS: dict[str, str] = {
    "希腊": "希腊神话", "罗马": "罗马神话", "北欧": "北欧神话", "凯尔特": "凯尔特神话",
    "不列颠": "不列颠神话", "亚瑟王": "不列颠神话", "埃及": "埃及神话",
    "美索不达米亚": "美索不达米亚神话", "苏美尔": "美索不达米亚神话", "巴比伦": "美索不达米亚神话",
    "波斯": "波斯神话", "印度": "印度神话", "中国": "中国神话", "日本": "日本神话",
    "阿兹特克": "阿兹特克神话", "玛雅": "玛雅神话", "非洲": "非洲神话",
    "斯拉夫": "斯拉夫神话", "芬兰": "芬兰神话", "基督": "基督教",
}
REGION_BLANKS = ("-", "—", "？", "?", "不明", "无", "N/A")

# --- fixed values: prototype keyword -> mythology, first match wins ------------------------------
PROTOTYPE_KEYWORDS: dict[str, str] = {
    "赫拉克勒斯": "希腊神话", "阿喀琉斯": "希腊神话", "美狄亚": "希腊神话",
    "阿塔兰忒": "希腊神话", "俄里翁": "希腊神话", "珀尔修斯": "希腊神话",
    "阿斯忒里翁": "希腊神话", "欧律阿勒": "希腊神话", "忒修斯": "希腊神话",
    "奥德修斯": "希腊神话", "赫克托尔": "希腊神话", "帕里斯": "希腊神话",
    "彭忒西勒亚": "希腊神话", "喀戎": "希腊神话", "阿斯克勒庇俄斯": "希腊神话",
    "俄耳甫斯": "希腊神话", "埃阿斯": "希腊神话", "狄俄斯库里": "希腊神话",
    "卡吕冬": "希腊神话", "阿耳忒弥斯": "希腊神话", "波塞冬": "希腊神话",
    "宙斯": "希腊神话", "哈迪斯": "希腊神话", "德墨忒尔": "希腊神话",
    "珀耳塞福涅": "希腊神话", "赫拉": "希腊神话", "阿佛洛狄忒": "希腊神话",
    "雅典娜": "希腊神话", "阿瑞斯": "希腊神话", "赫菲斯托斯": "希腊神话",
    "赫尔墨斯": "希腊神话", "美杜莎": "希腊神话", "戈耳工": "希腊神话",
    "喀耳刻": "希腊神话", "卡珊德拉": "希腊神话", "伊阿宋": "希腊神话",
    "阿伽门农": "希腊神话", "克吕泰涅斯特拉": "希腊神话", "希波吕忒": "希腊神话",
    "塔罗斯": "希腊神话", "斯芬克斯": "希腊神话", "厄律曼托斯": "希腊神话",
    "涅墨西斯": "希腊神话", "提亚马特": "美索不达米亚神话", "布伦希尔德": "北欧神话",
    "西格尔德": "北欧神话", "斯卡蒂": "北欧神话", "瓦尔基里": "北欧神话",
    "奥丁": "北欧神话", "索尔": "北欧神话", "洛基": "北欧神话",
    "芙蕾雅": "北欧神话", "海姆达尔": "北欧神话", "芬里尔": "北欧神话",
    "耶梦加得": "北欧神话", "尼德霍格": "北欧神话", "史尔特": "北欧神话",
    "齐格鲁德": "北欧神话", "雷金": "北欧神话", "法夫纳": "北欧神话",
    "格里戈里": "北欧神话", "希格德莉法": "北欧神话", "奥菲莉亚": "北欧神话",
    "布拉奇": "北欧神话", "纳普": "北欧神话", "阿尔托莉雅": "不列颠神话",
    "兰斯洛特": "不列颠神话", "高文": "不列颠神话", "特里斯坦": "不列颠神话",
    "莫德雷德": "不列颠神话", "梅林": "不列颠神话", "加拉哈德": "不列颠神话",
    "珀西瓦尔": "不列颠神话", "贝德维尔": "不列颠神话", "崔斯坦": "不列颠神话",
    "阿格规文": "不列颠神话", "加雷斯": "不列颠神话", "摩根": "不列颠神话",
    "薇薇安": "不列颠神话", "尼托克丽丝": "埃及神话", "圆桌": "不列颠神话",
    "亚瑟": "不列颠神话", "吉尔伽美什": "美索不达米亚神话", "恩奇都": "美索不达米亚神话",
    "伊什塔尔": "美索不达米亚神话", "埃列什基伽勒": "美索不达米亚神话", "金古": "美索不达米亚神话",
    "宁松": "美索不达米亚神话", "阿萨基姆": "美索不达米亚神话", "魁扎尔": "阿兹特克神话",
    "迦尔纳": "印度神话", "阿周那": "印度神话", "罗摩": "印度神话",
    "帕尔瓦蒂": "印度神话", "迦梨": "印度神话", "阿斯瓦塔玛": "印度神话",
    "怖军": "印度神话", "坚战": "印度神话", "黑天": "印度神话",
    "释迦": "印度神话", "佛陀": "印度神话", "难敌": "印度神话",
    "酒吞童子": "日本神话", "源赖光": "日本神话", "牛若丸": "日本神话",
    "武藏": "日本神话", "玉藻前": "日本神话", "清姬": "日本神话",
    "卑弥呼": "日本神话", "坂田金时": "日本神话", "茨木童子": "日本神话",
    "镰鼬": "日本神话", "静谧": "日本神话", "望月千代女": "日本神话",
    "宫本武藏": "日本神话", "佐佐木小次郎": "日本神话", "冲田总司": "史实人物",
    "织田信长": "史实人物", "德川家康": "史实人物", "森长可": "史实人物",
    "柳生但马守": "史实人物", "宝藏院胤舜": "史实人物", "葛饰北斋": "史实人物",
    "托马斯·爱迪生": "史实人物", "特斯拉": "史实人物", "拿破仑": "史实人物",
    "始皇帝": "中国神话", "项羽": "中国神话", "虞美人": "中国神话",
    "哪吒": "中国神话", "杨贵妃": "中国神话", "武则天": "史实人物",
    "司马懿": "史实人物", "诸葛亮": "史实人物", "吕布": "史实人物",
    "赤兔马": "中国神话", "貂蝉": "中国神话", "燕青": "史实人物",
    "陈宫": "史实人物", "华佗": "史实人物", "秦良玉": "史实人物",
    "曼荼罗": "印度神话", "库·丘林": "凯尔特神话", "斯卡哈": "凯尔特神话",
    "弗格斯": "凯尔特神话", "迪尔姆德": "凯尔特神话", "梅芙": "凯尔特神话",
    "芬恩": "凯尔特神话", "奥Jack": "凯尔特神话", "贝林": "凯尔特神话",
    "努阿达": "凯尔特神话", "梅尔顿": "凯尔特神话", "康奇厄布王": "凯尔特神话",
    "格罗娅": "凯尔特神话", "尼托克丽": "埃及神话", "克利奥帕特拉": "史实人物",
    "拉美西斯": "埃及神话", "阿努比斯": "埃及神话", "荷鲁斯": "埃及神话",
    "伊西斯": "埃及神话", "奥西里斯": "埃及神话", "塞特": "埃及神话",
    "图坦卡蒙": "埃及神话", "娜芙蒂蒂": "埃及神话", "玛修": "现代创作",
    "藤丸立香": "现代创作", "所长": "现代创作", "达·芬奇": "史实人物",
    "所罗门": "基督教", "大卫": "基督教", "圣乔治": "基督教",
    "玛尔达": "基督教", "贞德": "史实人物", "天草四郎": "史实人物",
    "岩窟王": "史实人物", "克里斯托弗": "史实人物", "阿纳斯塔西娅": "史实人物",
    "伊凡雷帝": "史实人物", "沙皇": "史实人物", "比利小子": "史实人物",
    "杰罗尼莫": "史实人物",
}

# --- fixed values: class names, and the short names used for them in questions -------------------
CLASS_NAMES = (
    "Saber", "Archer", "Lancer", "Rider", "Caster", "Assassin", "Berserker",
    "Ruler", "Avenger", "MoonCancer", "Foreigner", "Pretender", "AlterEgo",
    "Shielder", "Beast",
)
CLASS_SHORT_NAMES: dict[str, str] = {
    "剑阶": "Saber", "弓阶": "Archer", "枪阶": "Lancer", "骑阶": "Rider",
    "术阶": "Caster", "杀阶": "Assassin", "狂阶": "Berserker",
}

# --- fixed values: question keyword -> relation types --------------------------------------------
QUESTION_TYPE_KEYWORDS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("父母", ("PARENT_OF",)), ("父亲", ("PARENT_OF",)), ("母亲", ("PARENT_OF",)),
    ("父子", ("PARENT_OF",)), ("母女", ("PARENT_OF",)), ("家长", ("PARENT_OF",)),
    ("子女", ("PARENT_OF",)), ("孩子", ("PARENT_OF",)), ("儿子", ("PARENT_OF",)),
    ("女儿", ("PARENT_OF",)), ("兄弟", ("SIBLING_OF",)), ("姐妹", ("SIBLING_OF",)),
    ("配偶", ("SPOUSE_OF",)), ("夫妻", ("SPOUSE_OF",)), ("妻子", ("SPOUSE_OF",)),
    ("丈夫", ("SPOUSE_OF",)), ("恋人", ("LOVER_OF",)), ("情侣", ("LOVER_OF",)),
    ("情人", ("LOVER_OF",)), ("主仆", ("MASTER_OF",)), ("主人", ("MASTER_OF",)),
    ("从者", ("MASTER_OF",)), ("盟友", ("ALLY_OF",)), ("同伴", ("ALLY_OF",)),
    ("战友", ("ALLY_OF",)), ("敌对", ("ENEMY_OF",)), ("敌人", ("ENEMY_OF",)),
    ("仇敌", ("ENEMY_OF",)), ("宿敌", ("ENEMY_OF",)), ("战斗", ("FOUGHT_WITH",)),
    ("交手", ("FOUGHT_WITH",)), ("对决", ("FOUGHT_WITH",)), ("师傅", ("MENTOR_OF",)),
    ("师父", ("MENTOR_OF",)), ("师徒", ("MENTOR_OF",)), ("老师", ("MENTOR_OF",)),
    ("性转", ("GENDER_SWAP",)), ("原型", ("PROTOTYPE_IS", "DERIVED_FROM")),
    ("家族", ("PARENT_OF", "SIBLING_OF", "SPOUSE_OF", "LOVER_OF")),
    ("血缘", ("PARENT_OF", "SIBLING_OF", "SPOUSE_OF")), ("亲情", ("PARENT_OF", "SIBLING_OF")),
)
# Question words taken off the parts of a question before they are searched.
QUESTION_STOP_WORDS = (
    "是什么", "的关系", "关系", "怎么样", "如何", "介绍", "说说", "讲讲", "请问", "一下", "告诉",
    "谁是", "谁在", "吗", "呢", "吧", "了", "的", "和谁", "在哪",
)

# --- fixed values: family property -> (relation type, the record's own entity is the source) -----
FAMILY_PROPERTIES: dict[str, tuple[str, bool]] = {
    "P22": ("PARENT_OF", False),
    "P25": ("PARENT_OF", False),
    "P40": ("PARENT_OF", True),
    "P26": ("SPOUSE_OF", True),
    "P3373": ("SIBLING_OF", True),
}

# --- fixed values: work relations kept, and kinds by format or subject number --------------------
WORK_RELATIONS = ("SEQUEL", "PREQUEL", "SPIN_OFF", "ALTERNATIVE", "SIDE_STORY", "PARENT")
FORMAT_KINDS: dict[str, str] = {
    "TV": "anime", "TV_SHORT": "anime", "MOVIE": "film", "SPECIAL": "anime",
    "OVA": "anime", "ONA": "anime", "MUSIC": "other",
    "MANGA": "manga", "NOVEL": "novel", "LIGHT_NOVEL": "novel",
    "ONE_SHOT": "manga", "COMIC": "manga",
}
SUBJECT_KINDS: dict[int, str] = {1: "novel", 2: "anime", 3: "manga", 4: "game", 6: "tv"}

# --- fixed values: trigger words per symmetric type, in order of preference ----------------------
TRIGGER_WORDS: dict[str, tuple[str, ...]] = {
    "SPOUSE_OF": ("wife", "husband", "spouse", "married", "marriage", "妻子", "丈夫", "配偶", "结婚"),
    "LOVER_OF": ("lover", "lovers", "romance", "恋人", "情人", "相爱", "恋情"),
    "SIBLING_OF": ("brother", "sister", "sibling", "twin", "brothers", "sisters",
                   "兄弟", "姐妹", "双胞胎", "兄妹", "姐弟"),
    "ALLY_OF": ("ally", "allies", "friend", "friends", "companion", "comrade", "comrades",
                "served", "together", "alongside", "盟友", "同伴", "战友", "侍从", "部下", "追随"),
    "ENEMY_OF": ("enemy", "enemies", "rival", "rivals", "opponent", "killed", "slain",
                 "defeated", "murdered", "敌对", "宿敌", "对手", "杀死", "击败", "讨伐", "背叛"),
    "FOUGHT_WITH": ("fought", "fight", "battle", "battled", "clash", "clashed", "combat",
                    "duel", "交战", "战斗", "对决", "交手", "讨伐"),
}
TRIGGER_STOP_WORDS = (
    "and", "the", "of", "is", "was", "are", "were", "in", "on", "at", "to",
    "his", "her", "their", "with", "for", "who", "whom", "that", "which",
    "also", "both", "two", "one", "other", "another", "been", "have", "has",
    "had", "not", "but", "she", "they", "them", "him", "about", "after",
    "before", "from", "into", "when", "what", "then", "would", "could",
    "should", "will", "this", "these", "those", "there", "here", "over",
    "under", "out", "asks", "tells", "said", "says", "made", "make", "finds",
    "found", "able", "because", "while", "during", "where", "still", "just",
    "even", "same", "super", "used", "help", "orders", "sends", "meets",
    "reveals", "herself", "himself", "alter", "lily", "face",
    "之后", "以及", "并且", "同时", "一个", "这个", "那个", "自己", "他们",
    "她们", "其中", "因为", "但是", "然后", "所以", "还是", "已经", "正在",
)
# Names that are never tagged as entities.
UNTAGGED_NAMES = (
    "saber", "archer", "lancer", "caster", "rider", "assassin", "berserker",
    "ruler", "avenger", "alterego", "mooncancer", "foreigner", "pretender",
    "beast", "shielder", "saber脸",
)

# --- fixed values: patterns (Java regex, all case-insensitive) -----------------------------------
STRONG_MYTHIC = (
    "(?i)神话|传说中|民间传说|神明|皇帝|国王|女王|王后|法老|天皇|可汗|沙皇|苏丹|将军|武士|骑士|统治者|君主|"
    "海盗|探险家|大王|神話|伝説|英雄|武将|女神|男神|"
    "mytholog|legendary|folklore|deity|god of|goddess|emperor|empress|pharaoh|shogun|samurai|knight|"
    "king of|queen of|tsar|warlord|conqueror|monarch|sovereign|legend|figure in"
)
MYTHIC_CLASS = (
    "(?i)神話|神话|傳說|传说|妖|神$|之神|deity|god$|god of|goddess|mytholog|legendary|"
    "folklore|supernatural|saint|皇帝|国王|君主"
)
GENERIC_CLASS = (
    "(?i)title|country|sovereign state|word|symbol|given name|surname|album|film|television|"
    "video game|manga|anime|novel|series|band|song|下位語|頭銜|國家|头衔|国家|姓氏|名"
)
MYTH_SYSTEM = (
    "(?i)^[a-z]+ mythology$|^mythology$|^神話$|^神话$|religion|宗教|^folklore$|legendary cycle|"
    "傳說集|body of myths"
)
MODERN_OCCUPATION = (
    "(?i)歌手|演员|声优|政治人物|政治家|议员|说唱|音乐|偶像|漫画家|小说家|作家|记者|主持人|足球运动员|"
    "篮球|选手|艺术家|YouTuber|俳優|声優|小説家|音楽家|アイドル|選手|タレント|"
    "singer|rapper|musician|actor|actress|voice actor|politician|mangaka|novelist|writer|journalist|"
    "footballer|basketball|artist|idol|member of|band|pornographic|adult"
)
CHARACTER_CLASS = "(?i)character|角色|虚构|fictional|架空|キャラクター"
MEDIA_CLASS = "(?i)anime|manga|video game|visual novel|light novel|动画|漫画|游戏"
WORK_CLASS = (
    "(?i)anime|manga|video game|visual novel|light novel|novel|film|movie|television|tv series|"
    "comic|webcomic|animated series|anime and manga|"
    "miniseries|fairy tale|literary work|opera|musical|painting|ballet|theatre|"
    "动画|漫画|游戏|小说|电影|电视剧|影集|文學作品|文学作品|童话|音樂劇|音乐剧|畫作|画作|歌剧|戲劇"
)
WORK_KINDS: tuple[tuple[str, str], ...] = (
    ("anime|animated|动画", "anime"),
    ("manga|comic|漫画", "manga"),
    ("video game|visual novel|游戏", "game"),
    ("novel|fairy tale|literary|小说|童话|文學|文学", "literature"),
    ("film|movie|电视电影|电影", "film"),
    ("television|tv series|miniseries|影集|电视剧", "tv"),
    ("opera|musical|ballet|theatre|歌剧|音樂劇|音乐剧|戲劇", "stage"),
    ("painting|畫作|画作", "art"),
)
SKIPPED_SECTIONS = (
    "(?i)references?|external links?|navigation|gallery|categor|see also|"
    "引用|参考|外部链接|导航|分类|注释"
)


def relation_types(spark: SparkSession) -> DataFrame:
    """The relation types as a table: type, label, category, directed."""
    rows = [(t, label, category, directed) for t, (label, category, directed) in RELATION_TYPES.items()]
    return spark.createDataFrame(rows, "type string, label string, category string, directed boolean")

# The evidence that harvested edges carry, with gaps for names and ids.
SEED_EVIDENCE = "FGO 角色 Wikidata 实体 P144/P1074 → %s (%s)"
INCARNATION_EVIDENCE = "wikidata P144/P1074 → %s"
EXACT_NAME_EVIDENCE = "bangumi 精确同名 %s (bg:%s)"
FAMILY_EVIDENCE = "wikidata:%s 结构化家族属性"
