"""Word lists, labels, patterns and defaults that results depend on.

Everything here is data.  Operators take these lists as arguments so that a
corpus in another language brings its own.
"""

# --- fixed values: whitespace as Python's str.strip / str.split see it -----------
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = (
    r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

# --- fixed values: titles --------------------------------------------------------
TITLE_EDGE_PUNCTUATION = ".,，、；;:：!?！？\"'"
TITLE_NOISE_PATTERNS = [
    r"第\s*\d+\s*页\s*/\s*共\s*\d+\s*页",
    r"Page\s*\d+\s*of\s*\d+",
    r"AI\s*全栈极速黑客",
    r"赛题文档",
    r"^\d+\s*$",
    r"^[第\s\d]+页",
]
FRONT_MATTER_TITLES = ["目录", "版权", "前言", "序言", "附录", "参考文献", "索引"]
WHOLE_TEXT_TITLE = "全文"
UNKNOWN_CHAPTER = "章节待识别"
UNRECOGNISED_CHAPTER = "未识别章节"

# --- fixed values: headings ------------------------------------------------------
MARKDOWN_HEADING = r"(?U)^(#{1,4})[\s&&[^\n]]+([^\n]+)"
TEXT_HEADINGS = [
    r"^第[一二三四五六七八九十百零\d]+章\s*",
    r"^第[一二三四五六七八九十百零\d]+节\s*",
    r"^Chapter\s+\d+[\s:。：]",
]
TOC_CHAPTER = r"^(第[一二三四五六七八九十百零\d]+章)\s*"
TOC_SECTION = r"^(第[一二三四五六七八九十百零\d]+节)\s*"
PAGE_CHAPTER = r"第[一二三四五六七八九十百0-9]+[章节]"
HEADING_STYLES_1 = ["Heading 1", "标题 1"]
HEADING_STYLES_2 = ["Heading 2", "标题 2"]

# --- fixed values: file names ----------------------------------------------------
FORMATS = ["pdf", "md", "txt", "docx"]
BOOK_TITLES = {
    "01_局部解剖学.pdf": "局部解剖学",
    "02_组织学与胚胎学.pdf": "组织学与胚胎学",
    "03_生理学.pdf": "生理学",
    "04_医学微生物学.pdf": "医学微生物学",
    "05_病理学.pdf": "病理学",
    "06_传染病学.pdf": "传染病学",
    "07_病理生理学.pdf": "病理生理学",
}

# --- fixed values: keywords ------------------------------------------------------
KEYWORD_PATTERN = r"[\x{4e00}-\x{9fa5}A-Za-z0-9]{2,}"
KEYWORD_STOP = ["什么是", "请问", "解释", "相关", "有哪些", "为什么", "如何", "可以", "一下"]

# --- fixed values: routing -------------------------------------------------------
ROUTE_GREETINGS = ["你好", "hello", "hi", "你是谁", "介绍一下你自己"]
PLAN_GREETINGS = ROUTE_GREETINGS + ["帮我看看你能做什么", "你能做什么"]
REPORT_WORDS = ["报告", "导出"]
GRAPH_WORDS = ["图谱", "知识图谱"]
INTENT_ALIASES = {
    "chat": "greeting",
    "ask": "ask",
    "graph_integrated": "graph_build",
    "graph_single": "graph_build",
    "graph_update": "graph_update",
    "report": "report",
    "greeting": "greeting",
}
INTENTS = ["greeting", "ask", "graph_build", "graph_update", "report", "unknown"]
# rule plans of these kinds are never replaced by a payload
RULE_PLANS = ["greeting", "symptom_question", "non_medical_question"]
PLAN_INTENTS = [
    "greeting",
    "medical_question",
    "symptom_question",
    "study_question",
    "non_medical_question",
    "unknown",
]
DOMAIN_WORDS = [
    "医学", "健康", "疾病", "症状", "诊断", "治疗", "用药", "病理", "生理", "解剖", "组织胚胎",
    "微生物", "病毒", "细菌", "感染", "传染", "免疫", "细胞", "器官", "神经", "心脏", "血液",
    "肿瘤", "炎症", "代谢", "内分泌", "营养", "疫苗", "临床", "肝炎", "休克", "病理生理学",
]
SYMPTOM_WORDS = [
    "疼", "疼痛", "痛", "肿", "肿胀", "发热", "发烧", "咳嗽", "腹泻", "拉肚子", "恶心", "呕吐",
    "头晕", "胸闷", "乏力", "皮疹", "出血", "麻木",
]
EXPANSIONS = {
    "肩膀": ["肩部", "肩关节", "肩胛区"],
    "肿胀": ["水肿", "肿大", "肿块", "局部隆起", "炎性肿胀"],
    "疼痛": ["痛", "疼", "刺痛", "胀痛", "压痛"],
    "发热": ["发烧", "体温升高", "高热", "低热"],
    "咳嗽": ["咳", "干咳", "咳痰"],
    "腹泻": ["拉肚子", "稀便", "水样便"],
    "炎症": ["炎性反应", "渗出", "充血", "水肿"],
    "感染": ["细菌感染", "病毒感染", "病原体"],
    "外伤": ["损伤", "扭伤", "撞击", "挫伤"],
}
EXPANSION_TAIL = ["医学教材", "机制", "病理", "生理"]
# per class: need search, opening reply, answer focus, conversation goal
PLAN_FIELDS = {
    "symptom_question": (
        True,
        "先别太紧张，单凭一句描述不能判断具体疾病，但可以从教材知识中梳理可能相关方向。",
        "不能仅凭一句话判断具体疾病；基于教材解释可能方向；提醒补充持续时间、严重程度、诱因、伴随症状；必要时就医。",
        "安抚用户，提供非诊断性解释和就医边界。",
    ),
    "study_question": (
        True,
        "",
        "围绕教材概念、机制、分类或传播途径给出结构化解释。",
        "帮助用户学习医学教材知识，并给出可追溯引用。",
    ),
    "non_medical_question": (
        False,
        "",
        "简短回答，并提示系统主要面向医学教材问答。",
        "完成普通对话或引导到教材问题。",
    ),
}

# --- fixed values: answers -------------------------------------------------------
SAFETY_NOTE = "本系统仅用于学习与信息辅助理解，不能替代医生诊断和治疗建议。"
NO_EVIDENCE_ANSWER = "当前教材证据不足，暂不能基于教材给出可靠回答。请先构建索引或换一个更具体的教材主题。"
NO_RESULT_ANSWER = "当前知识库中未找到相关信息"
NO_SOURCES = "本次回答未使用教材检索结果。"
UNKNOWN_BOOK = "未知教材"
UNKNOWN_SECTION = "未知章节"
UNKNOWN_PAGE = "未知"

# --- fixed values: retrieval -----------------------------------------------------
LIST_WEIGHTS = {
    "embedding_original": 1.0,
    "embedding_expanded": 0.95,
    "tfidf_original": 0.9,
    "tfidf_expanded": 0.85,
    "tfidf_keywords": 0.8,
}
OTHER_LIST_WEIGHT = 0.75
MAX_FEATURES = 200_000

# --- fixed values: evaluation grid (name, index size/overlap, parent size/overlap) -
STRATEGIES = [
    ("baseline_medium", 700, 80, None, None),
    ("small_only", 300, 50, None, None),
    ("small_to_big", 300, 50, 1200, 150),
]

# --- fixed values: graph ---------------------------------------------------------
CLASS_RULES = [
    ("治疗与干预", ["治疗", "用药", "干预", "处理"]),
    ("诊断依据", ["诊断", "检查", "指标", "标准"]),
    ("并发症", ["并发", "损害", "衰竭"]),
    ("病因与危险因素", ["病因", "危险", "因素", "遗传"]),
    ("发生机制", ["机制", "病理", "生理", "导致"]),
    ("临床表现", ["症状", "表现", "体征"]),
    ("预防管理", ["预防", "控制", "管理"]),
]
DEFAULT_CLASS = "定义"
SEED_CLASSES = ["定义", "病因与危险因素", "发生机制", "临床表现", "诊断依据", "治疗与干预", "并发症", "预防管理"]
TYPE_WORDS = [
    ("mechanism", ["机制", "病理", "生理", "发生", "发展"]),
    ("pathological_change", ["病理变化", "形态", "变质", "渗出", "增生", "水肿"]),
    ("cause", ["原因", "病因", "损伤因子", "致瘤因素"]),
    ("diagnosis", ["诊断", "检查", "指标"]),
    ("treatment", ["治疗", "用药", "处理"]),
    ("complication", ["并发症", "后果"]),
    ("risk_factor", ["危险因素", "因素", "病因"]),
    ("symptom", ["症状", "表现"]),
    ("prevention", ["预防", "控制"]),
]
RELATION_BY_TYPE = {
    "mechanism": "explains",
    "pathological_change": "contains",
    "cause": "causes",
    "diagnosis": "diagnosed_by",
    "treatment": "treated_by",
    "risk_factor": "causes",
    "complication": "complicates",
    "prevention": "prevents",
}
DEFAULT_RELATION = "associated_with"
LABEL_BY_TYPE = {
    "mechanism": "解释",
    "pathological_change": "病变",
    "cause": "导致",
    "diagnosis": "诊断",
    "treatment": "干预",
    "risk_factor": "影响",
    "complication": "并发",
    "prevention": "预防",
}
DEFAULT_LABEL = "相关"
LABEL_BY_RELATION = {
    "causes": "导致",
    "belongs_to": "归属",
    "contains": "包含",
    "is_a": "属于",
    "explains": "解释",
    "diagnosed_by": "诊断",
    "treated_by": "干预",
    "complicates": "并发",
    "prevents": "预防",
    "contrasts_with": "对比",
}
NODE_TYPES = [
    "concept", "mechanism", "disease", "symptom", "diagnosis", "treatment", "risk_factor",
    "complication", "prevention", "book_specific", "pathological_change", "cause",
]
NODE_TYPE_ALIASES = {"definition": "concept", "etiology": "cause", "risk": "risk_factor"}
RELATIONS = [
    "causes", "belongs_to", "associated_with", "diagnosed_by", "treated_by", "complicates",
    "prevents", "explains", "contrasts_with", "contains", "is_a",
]
RELATION_ALIASES = {"include": "contains", "includes": "contains", "part_of": "belongs_to"}
OVERLAP_SHARED = "多个教材均提及该知识点，说明它可能是跨教材共同核心内容。"
OVERLAP_SINGLE = "当前证据主要来自单本教材，跨教材重复证据有限。"
COMPLEMENT_SHARED = "不同教材可从定义、机制、临床表现或病理变化等角度形成互补。"
COMPLEMENT_SINGLE = "当前互补分析证据不足，可继续检索其他教材。"
COMPLEMENT_SUMMARY = "不同教材的片段可互补解释概念定义、机制、病理变化、诊断或防治方向。"
MISSING_SUMMARY = "未检索到证据的分支已标注为证据不足，建议继续补充教材或调整检索主题。"
COMPRESSION_TARGET = 0.3
UNLINKED_TYPE = "未绑定节点"

# --- fixed values: feedback ------------------------------------------------------
SUPPLEMENT_WORDS = ["补充", "增加", "加入", "完善", "缺少", "不完整"]
SUPPLEMENT_NOTE = "已根据教师反馈补充相关教材证据。"
