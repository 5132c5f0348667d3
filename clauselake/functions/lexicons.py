"""Word lists, patterns and limits that decide the results.

They are plain data.  Every operator takes them as parameter defaults, so a
caller can pass another list without touching the code.
"""

# --- fixed values: triage word lists -------------------------------------
HARD_OUT_OF_SCOPE = [
    "商标侵权", "注册商标", "商标被", "抢注",
    "虚开发票", "税务", "个税", "所得税",
    "股东",
    "消费者权益", "假货",
]

REVIEW_ANCHORS = [
    "审查", "审核", "审阅", "霸王条款", "改写", "起草", "漏洞", "有没有问题", "拟定", "修改建议",
]

IN_SCOPE_ANCHORS = [
    "逾期", "货款", "付款", "定金", "保密", "生效", "有效期",
    "不可抗力", "履行", "标的额", "标的", "签字", "盖章", "交付",
    "合同", "买卖",
    "施工", "工程", "运输", "运费", "承运", "托运", "货物", "债权", "欠",
    "违约金",
]

ANAPHORA_MARKERS = [
    "它", "这个", "那个", "上面", "前面", "改成", "再", "继续", "然后", "接着",
    "这次", "那", "其", "前一条", "上一", "刚才", "同样", "还是",
]

CROSS_DOMAIN_WORDS = [
    "离婚", "公司法", "税务", "个税", "劳动法", "商标", "专利", "著作权",
    "继承", "遗嘱", "交通事故", "消费者", "交货",
]

CALC_TRIGGERS = [
    "算", "违约金", "比例", "利息", "赔", "补偿", "扣", "金额", "天数",
    "工龄", "押金", "几倍", "滞纳金", "N+1", "双倍", "三倍", "多少",
    "万分之", "千分之", "日利率", "月利率", "年化",
]

# --- fixed values: calculation routing and parameter extraction -----------
LOAN_WORDS = ["利息", "利率", "借贷", "借款", "贷款", "借了"]
REWRITE_CUES = ["改成", "如果", "变成", "天", "利率", "本金", "金额", "呢"]
PENALTY_CONTEXT = ["违约金", "逾期", "付款", "欠款", "赔", "货款", "本金", "滞纳金"]
PRINCIPAL_CONTEXT = ["欠款", "逾期", "应付", "货款", "本金", "违约金", "房款"]
EXCLUDED_CONTEXT = ["定金", "标的额", "合同标的", "押金", "保证金", "预付款"]
NOT_OVERDUE = ["没逾期", "未逾期", "一天都没"]
CONTEXT_WINDOW = 15
DEFAULT_RATE_PER_MILLE = 0.5
MAX_RATE_PER_MILLE = 100.0
LEGAL_ANNUAL_RATE_CAP = 0.138
LOAN_DAILY_CAP_PER_MILLE = 0.378
PENALTY_RATIO_CAP = 0.30

# --- fixed values: contract review ----------------------------------------
COMPLETENESS_ITEMS = [
    ("合同主体", "甲方|乙方|双方|卖方|买方|供方|需方|承租人|出租人|借款人|出借人|委托方|受托方|服务方|客户|公司|个人"),
    ("合同标的", "标的|货物|商品|产品|服务|技术|设备|材料|作品|劳务|项目"),
    ("数量", "数量|件数|台|套|份|批|米|平方米|公斤|吨|数量为"),
    ("交付时间", "交付时间|交货期|履行期限|期限|之日|日内|工作日|前交付|完成时间"),
    ("价款", "价款|价格|报酬|费用|租金|总价|元|万元|支付|付款"),
    ("违约责任", "违约|违约金|违约责任|赔偿|定金|违约金"),
    ("争议解决", "争议|仲裁|诉讼|起诉|管辖|人民法院|仲裁委员会|和解|调解"),
    ("生效条件", "生效|签字|盖章|签署|成立|之日起"),
]
COMPLETENESS_MIN_CLAUSES = 2
COMPLETENESS_MIN_MISSING = 2
UNNUMBERED_MIN_CHARS = 8
REVIEW_TOP_K = 5
LOW_SCORE = 0.03
REVIEW_POINTS = [("NUMERIC", "数值"), ("SEMANTIC", "语义"), ("FORMAT", "格式"), ("NONE", "无关")]
NO_RISK_PHRASES = ["未发现明显风险", "无明显风险", "不存在风险", "没有风险", "无风险"]
RISK_PHRASES = ["风险点", "违反", "不合理", "显失公平", "无效", "应予调整", "建议修改", "存在风险"]
SECTION_KEYS = ["风险点", "改写建议", "替换条款"]
REVIEW_MARKER = "【已审查条款】"
MAX_REVIEW_ANCHORS = 5
VERDICT_TTL_DAYS = 7

# --- fixed values: clause splitting ---------------------------------------
CLAUSE_DIGITS = "0-9零一二三四五六七八九十百千"
HEADING_BOUNDARY = "　 。；：、，）)"
SUB_MARK = "（[一二三四五六七八九十]+）"
MAX_CLAUSE_LEN = 800
MAX_HEADING_JUMP = 3
INTRO_SUFFIX = "-引言"
WHOLE_SUFFIX = "-全文"

# --- fixed values: retrieval and grading ----------------------------------
RRF_K = 10
RRF_WEIGHT_KNN = 1.0
RRF_WEIGHT_BM25 = 0.3
BM25_K1 = 1.2
BM25_B = 0.75
GRADE_THRESHOLD = 0.6
RECALL_SIZE = 50
MAX_REWRITES = 2
CITE_TOP_K = 3
SINGLE_ROUND_TOP_K = 5
REFUSAL_MARKS = ["无法作答", "未检索到"]
FAILURE_MARKS = ["（检索失败）", "（综合失败）", "（计算失败）"]
REJECT_ANSWER = "知识库里没检索到，无法作答。"
NOTHING_TO_CITE = "（未检索到可引用的条款）"
SINGLE_ROUND_REJECT = "抱歉，知识库中未检索到相关法律条款，无法作答。"
OUT_OF_SCOPE_FALLBACK = "（超出知识库范围，无法作答）"

# --- fixed values: session and profile memory -----------------------------
KEEP_MESSAGES = 8
MAX_MESSAGES = 20
SESSION_TTL_DAYS = 7
PROFILE_TTL_DAYS = 30
EXTRACT_EVERY = 3
RECALL_MAX_CHARS = 500
LIKE_MARK_HOURS = 24

# --- fixed values: contract intake ----------------------------------------
MIN_CONTRACT_CHARS = 10
MAX_CONTRACT_CHARS = 8000
TRUNCATION_SUFFIX = "...（文本过长，已截断）"


def any_of(terms: list[str]) -> str:
    """One alternation pattern for a list of literal terms (valid in Java and RE2)."""
    special = set("\\.^$|?*+()[]{}")
    return "|".join("".join("\\" + ch if ch in special else ch for ch in t) for t in terms)
