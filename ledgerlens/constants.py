"""Headers, verdict words, messages, weights and patterns that results must carry as they are."""

# Input headers, in the order in which missing ones are reported.
ENTRY_HEADERS = {
    "日期": "date",
    "姓名": "name",
    "一级分类": "category",
    "细分": "subcategory",
    "企业名称&官网": "company_raw",
    "环节": "stage",
}
RULE_HEADERS = {
    "一级品类": "level1",
    "二级品类": "level2",
    "三级品类": "level3",
    "模块名称": "module_name",
    "子模块列表": "keyword_text",
}
ENTRY_HEADER_ERROR = "员工录入表缺少表头："
RULE_HEADER_ERROR = "内部分类表缺少表头："

# Verdicts.
CORRECT = "正确"
WRONG = "错误"
DOUBTFUL = "疑似错误"
UNDECIDED = "无法判断"
INCOMPLETE = "信息缺失"

# Error types.
ERROR_INCOMPLETE = "信息缺失"
ERROR_NO_COMPANY = "企业信息缺失"
ERROR_NO_SCOPE = "经营范围缺失"
ERROR_SUBCATEGORY = "细分错误"
ERROR_WEAK_EVIDENCE = "证据不足"

# Reasons.
REASON_MISSING = "必填字段缺失："
REASON_NO_LOOKUP = "未查询到企业信息"
REASON_NO_SCOPE = "企业经营范围为空，无法进行分类匹配"
REASON_BETTER = "经营范围更匹配建议分类："
REASON_PARTIAL = "经营范围与当前分类只有部分匹配，建议人工复核"

# Evidence lines.
HIT_CATEGORY = "分类命中："
HIT_SUBCATEGORY = "细分命中："
HIT_MODULE = "环节模块命中："
HIT_SCOPE = "经营范围关键词："
HIT_STAGE = "录入环节关键词："
LIST_SEPARATOR = "、"
EVIDENCE_SEPARATOR = "；"
EVIDENCE_KEYWORDS = 6

# Score weights, caps and verdict thresholds.
CATEGORY_POINTS = 20
SUBCATEGORY_POINTS = 20
MODULE_POINTS = 5
SCOPE_POINTS, SCOPE_CAP = 12, 45
STAGE_POINTS, STAGE_CAP = 6, 20
SCORE_CAP = 100
CORRECT_FROM = 80
SUGGEST_FROM = 35
KEEP_FROM = 60

# Static lookup and registry responses.
STATIC_SOURCE = "mock"
STATIC_MISS = "mock 数据中未找到该企业"
REGISTRY_SOURCE = "qichacha"
REGISTRY_TRANSPORT = "企查查接口请求失败："
REGISTRY_HTTP = "企查查 HTTP 状态异常："
REGISTRY_NOT_JSON = "企查查响应不是合法 JSON"
REGISTRY_REFUSED = "企查查接口返回失败："
REGISTRY_BAD_RESULT = "企查查响应 Result 字段格式异常"
REGISTRY_NO_SCOPE = "企查查响应中未找到经营范围字段"
SCOPE_KEYS = ("Scope", "BusinessScope", "OperScope", "经营范围")
NAME_KEYS = ("Name", "CompanyName", "EntName", "企业名称")
STATUS_KEYS = ("RegStatus", "Status", "StatusDesc", "经营状态")

# Stored-page evidence.
WEBSITE_SOURCE = "website"
WEBSITE_LABEL = "官网"
WEBSITE_NO_URL = "官网链接缺失"
WEBSITE_UNREACHABLE = "官网无法访问"
WEBSITE_WEAK = "官网证据不足"
HOME_MODULE = "首页"
PAGE_MODULES = {  # in priority order
    "业务领域": ("业务领域",),
    "公司简介": ("公司简介",),
    "经典案例": ("经典案例",),
}
MAX_PAGES = 4
ATTACHMENT_SUFFIXES = (
    "png jpg jpeg gif bmp webp svg ico pdf mp4 avi mov wmv flv mp3 zip rar 7z gz tar doc docx xls xlsx ppt pptx"
).split()

# Output headers.
DETAIL_HEADERS = {
    "row_number": "原始行号",
    "employee_name": "姓名",
    "original_category": "一级分类",
    "original_subcategory": "细分",
    "original_stage": "环节",
    "original_company": "企业名称原文",
    "cleaned_company": "清洗后企业名称",
    "status": "审计结果",
    "confidence": "置信度",
    "company_name": "企查查企业名称",
    "company_status": "经营状态",
    "business_scope": "经营范围",
    "error_type": "错误类型",
    "reason": "错误原因",
    "suggestion": "建议修正",
    "needs_review": "是否需要人工复核",
}
NEUTRAL_SCOPE_HEADER = "外部证据文本"
SOURCE_HEADERS = {"data_source": "数据来源", "website_url": "官网链接"}
FILE_HEADER = {"source_id": "来源文件"}
YES, NO = "是", "否"
SUMMARY_HEADERS = {
    "employee_name": "姓名",
    "entered": "录入数量",
    "complete": "完整数量",
    "correct": "正确数量",
    "wrong": "错误数量",
    "doubtful": "疑似错误数量",
    "undecided": "无法判断数量",
    "accuracy": "正确率",
}

# Progress lines, in order; {n} is the count.
STEP_ENTRIES = "读取员工记录 {n} 条"
STEP_RULES = "读取分类规则 {n} 条"
STEP_COMPANIES = "查询企业 {n} 家"
STEP_REVIEWED = "完成审计 {n} 条"
STEP_SUMMARY = "生成质量汇总"
STEP_EXPORT = "导出审计结果 Excel"
JOB_PREFIX = "审计结果_"
BAD_JOB_ID = "非法文件名"

# The characters Python's str.strip() and re's \s treat as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as the inside of a regular-expression class.
WHITESPACE_CLASS = "\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
URL_PATTERN = rf"https?://[^{WHITESPACE_CLASS}]+|www\.[^{WHITESPACE_CLASS}]+"
COMPANY_EDGE_MARKS = "，,；;。"
KEYWORD_SEPARATORS = r"[、，,;；\n\r]+"
