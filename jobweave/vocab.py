"""Word lists, patterns and weights results depend on.

Every value here has to equal the published behaviour for results to agree.
Larger tables (career taxonomy, company aliases, registries) are parameters.
"""

from __future__ import annotations

# --- fixed values: whitespace and dashes ----------------------------------
OTHER_SPACE = r"\t\n\f\r\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# Runs of whitespace, or one character that is not a plain space already.
SPACE = f"[ {OTHER_SPACE}]{{2,}}|[{OTHER_SPACE}]"
# The same for Spark, several times as fast: the rare wide ones stand behind one range test, and each
# character is tried once (first character; then more of them, or it isn't a plain space).
_WIDE = r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]"
ANY_SPACE = rf"[ \t\n\f\r\x{{000B}}\x{{0085}}\x{{00A0}}{_WIDE}]"
SPACE_FAST = f"{ANY_SPACE}(?:{ANY_SPACE}+|(?<! ))"
DASHES = "‐‑‒–—"
DASHES_FAST = f"[{DASHES[0]}-{DASHES[-1]}]"

# --- fixed values: company legal forms, removed in this order ---------------
LEGAL_FORMS = ["集团", "股份有限公司", "有限公司"]

# --- fixed values: cities ----------------------------------------------------
CITIES = [
    "北京", "上海", "深圳", "广州", "杭州", "南京", "苏州", "成都", "武汉", "西安", "天津", "重庆", "长沙",
    "合肥", "无锡", "厦门", "青岛", "济南", "宁波", "东莞", "珠海", "佛山", "大连", "沈阳", "郑州", "福州",
]
PROFILE_CITIES = [
    "北京", "上海", "深圳", "广州", "杭州", "南京", "成都", "武汉", "西安", "苏州", "天津", "重庆", "长沙", "合肥",
    "无锡", "厦门", "青岛", "济南", "宁波", "东莞", "珠海", "佛山", "大连", "沈阳", "郑州", "福州", "海外", "香港",
]
TITLE_CITIES = [
    "北京", "上海", "深圳", "广州", "杭州", "南京", "成都", "武汉", "西安", "苏州", "天津", "重庆", "长沙", "合肥",
    "无锡", "厦门", "青岛", "济南", "宁波", "东莞",
]
CARD_CITIES = [
    "北京", "上海", "深圳", "广州", "杭州", "南京", "成都", "武汉", "西安", "苏州", "合肥", "无锡", "天津", "重庆",
    "长沙", "厦门", "青岛", "济南", "宁波", "东莞", "珠海", "佛山", "嘉兴", "常州", "保定", "烟台", "全国", "海外",
    "新加坡", "香港", "吉隆坡",
]
CAPITAL = "北京"
FIRST_TIER = ["北京", "上海", "深圳", "广州", "杭州"]

# --- fixed values: signal patterns -----------------------------------------
OVERSEAS = (
    "(?i)海外|美国|加拿大|英国|德国|法国|欧洲|新加坡|日本|韩国|澳大利亚|印度|poland|germany|france|london|new york"
    "|san francisco|singapore|tokyo|india|united states|canada"
)
HOME_COUNTRY = r"(?i)中国|china|\bcn\b"
CAMPUS_FEED = r"(?i)2027|27届|校招|校园招聘|应届|毕业生|实习|实习生|new\s*grad|graduate|campus|intern"
CAMPUS = r"(?i)2027|2028|27届|28届|校招|校园招聘|应届|毕业生|秋招|春招|new\s*grad|graduate|campus"
INTERN = "(?i)实习|intern"
SENIOR = r"(?i)senior|staff|principal|资深|专家|负责人|总监|主管|3\s*[-~至]\s*5年|5年以上|[3-9]\s*年(?:工作)?经验"
SOCIAL = "(?i)社招|社会招聘|experienced|off-campus"
QUICK_CAMPUS = "(?i)2027|27届|校招|校园招聘|应届|实习"
TECH_FEED = (
    "(?i)ai|llm|vlm|vla|大模型|多模态|推理|cuda|gpu|kernel|算子|量化|ptq|编译器|compiler|runtime|npu|芯片|hpc|高性能"
    "|分布式|后端|算法|机器学习|深度学习|计算机视觉|嵌入式|机器人|软件|信息科技|金融科技|网络安全|云计算"
)
COHORT_HINT = "(?i)校招|校园|应届|毕业|秋招|春招|campus|graduate"
COHORT_YEAR = "20(?:2[4-9]|3[0-9])"
TARGET_YEAR = "2027|27届"

# --- fixed values: older scorers' signal patterns ----------------------------
V9_CAMPUS = r"(?i)2027|27届|校招|校园招聘|应届|毕业生|new\s*grad|graduate|campus"
V9_SENIOR = r"(?i)senior|staff|principal|资深|专家|负责人|总监|经理|主管|3-?5年|5年以上|[3-9]\s*年经验"
V7_CAMPUS = r"(?i)校招|校园招聘|应届|毕业生|实习|实习生|new\s*grad|graduate|campus|intern"
V7_TECH = (
    "(?i)ai|llm|vlm|vla|大模型|多模态|推理|serving|cuda|gpu|kernel|算子|量化|ptq|编译器|compiler|runtime|npu|芯片|hpc"
    "|高性能|分布式|后端|算法|机器学习|深度学习|计算机视觉|嵌入式|机器人"
)
V6_EARLY = (
    r"(?i)校招|校园招聘|应届|毕业生|管培|管培生|实习|实习生|初级|助理|培训生|新卒"
    r"|\b(?:intern(?:ship)?|new\s*grad|graduate|campus|entry[ -]?level|junior|early\s*career|apprentice)\b"
    r"|(?:2026|2027|2028)\s*(?:届|graduate|毕业)"
)
V6_SENIOR_TITLE = (
    r"(?i)资深|高级专家|首席|总监|负责人|架构师|技术专家|研究专家"
    r"|\b(?:senior|staff|principal|lead|director|head of|architect|distinguished)\b"
)
V6_SENIOR_TEXT = r"(?i)(?:[5-9]|1[0-9])\s*(?:年|years?)\s*(?:以上|\+|of experience)?"

# --- fixed values: skills too generic to weigh -------------------------------
GENERIC_SKILLS = [
    "python", "matlab", "c++", "java", "linux", "office", "excel", "git", "项目", "研究", "工程", "研发", "分析",
    "设计", "管理", "技术", "系统", "模型", "算法", "实验", "开发",
]
PROFILE_GENERIC = [
    "python", "matlab", "c++", "java", "linux", "office", "excel", "项目", "研究", "工程", "研发", "分析", "设计",
    "管理", "技术", "系统", "模型", "算法", "实验",
]
V9_GENERIC = [
    "python", "c++", "linux", "git", "docker", "pytorch", "transformer", "llm", "ai", "算法", "开发", "系统", "模型",
    "深度学习",
]

# --- fixed values: keyword extraction ---------------------------------------
LATIN_WORD = r"[a-z][a-z0-9+.#/_-]{1,28}"
HAN_RUN = r"[\x{4e00}-\x{9fa5}]{2,9}"
LATIN_STOP = ["and", "the", "with", "from", "using", "for", "of", "to", "in", "on", "or", "is", "as"]
HAN_STOP = [
    "负责", "相关", "项目", "工作", "使用", "进行", "基于", "以及", "通过", "实现", "技术", "能力", "熟悉", "掌握", "经验",
    "优化", "系统", "模型", "算法", "开发", "设计", "支持", "研究", "本科", "硕士", "博士", "北京", "上海", "深圳", "公司",
    "团队", "岗位", "方向", "主要", "参与", "完成", "具有", "良好", "能够", "需求", "业务",
]

# --- fixed values: degree words, rank 4 down to 1 ----------------------------
DEGREES = [("博士", 4), ("phd", 4), ("硕士", 3), ("研究生", 3), ("master", 3), ("本科", 2), ("学士", 2), ("bachelor", 2), ("大专", 1), ("专科", 1)]

# --- fixed values: résumé sections (name, label, weight, header words) -------
SECTIONS = [
    ("skills", "专业技能", 145, "专业技能|技能|技能栈|技术栈|skills?|technical skills?"),
    ("experience", "实习/工作", 135, "实习经历|工作经历|项目实习|实践经历|experience|work experience|internship"),
    ("projects", "项目", 125, "项目经历|项目经验|projects?|project experience"),
    ("research", "科研", 120, "科研经历|研究经历|论文|论文发表|研究成果|科研项目|research|publications?"),
    ("education", "教育", 55, "教育经历|教育背景|学历|education"),
    ("awards", "奖项", 70, "奖项|荣誉|获奖经历|竞赛经历|awards?|honors?"),
    ("summary", "个人总结", 100, "个人总结|个人简介|自我评价|求职意向|summary|profile|objective"),
]
OTHER_SECTION = ("other", "其他", 80)
MAJOR_LINE = "(?i)专业|major|主修|学位|学院|系[:：]|硕士|本科|博士"

# --- fixed values: role words and navigation noise ---------------------------
ROLE_WORD = (
    "(?i)工程师|算法|研发|开发|编译|编译器|软件|芯片|GPU|CUDA|推理|大模型|多模态|VLM|VLA|机器人|强化学习|运动控制|系统|架构"
    "|性能|测试|验证|安全|研究员|研究|实习|产品经理|运营|销售|材料|化学|化工|工艺|质量|可靠性|失效|机械|结构|电气|电力|能源"
    "|制造|生产|土木|建筑|施工|造价|环境|环保|生物|医药|制药|临床|医学|数据|统计|财务|会计|审计|税务|金融|投资|证券|风控"
    "|法务|合规|知识产权|人力|招聘|行政|市场|品牌|商务|供应链|采购|物流|计划|咨询|战略|管培|设计师|交互|视觉|编辑|记者|教师"
    "|教研|地质|油气|采矿|测绘|食品|农业|翻译|国际业务|公共事务|政策|客户经理|分析师|专员|经理|顾问"
)
ROLE_NOISE = (
    "(?i)^(?:校园招聘|社会招聘|实习招聘|加入我们|人才招聘|招聘职位|职位列表|岗位列表|立即申请|申请|详情|查看详情|更多|more"
    "|next|上一页|下一页|首页|返回|校招|社招|实习)$"
)
JOB_FIELD = "(?i)job|position|post|recruit|career|vacan|duty|require|qualif|responsib|description"

# --- fixed values: job page recognition -------------------------------------
DUTY = r"(?i)岗位职责|工作职责|职位职责|职位描述|工作内容|job\s*(?:description|responsibilit)"
QUALIFICATION = "(?i)任职要求|任职资格|职位要求|岗位要求|基本要求|qualifications?|requirements?"
PAGE_YEAR = "(?i)2027|27届|2026[-—–]?2027|校园招聘|校招|应届|毕业生|graduate|campus|intern|实习"
SITE_TAIL = r"(?i)\s*[-|｜].*(招聘|career|公司|官网).*$"
POSITION_LABEL = r"(?:岗位|职位)(?:名称)?\s*[:：]\s*([^,，。；;]{2,80})"
TITLE_LENGTH = (2, 110)
GENERIC_TITLE = (
    r"(?i)^(招聘|招聘职位|职位列表|岗位列表|人才招聘|校园招聘|社会招聘|实习生招聘|加入我们|careers?|jobs?|positions?|join us)"
    r"[\s|｜_-]*$"
)
PLACE_LABEL = r"(?i)(?:工作地点|办公地点|职位地点|地点|location)\s*[:：]\s*([^,，。；;|｜]{2,40})"

# --- fixed values: campaign links --------------------------------------------
CAMPAIGN_NEAR = (
    "(?i)(?:2027|27届).{0,45}(?:校园招聘|校招|秋招|招聘|毕业生|实习)|(?:校园招聘|校招|秋招|招聘|毕业生|实习).{0,45}(?:2027|27届)"
)
CAMPAIGN_WORD = "(?i)招聘|校招|校园|提前批|秋招|实习|探索者|人才计划"
CAMPAIGN_SKIP = "(?i)讲座|课堂|求职|就业指导|教师|博士后|事业单位公开招聘"
APPLY_HOST = "(?i)career|careers|job|jobs|zhaopin|recruit|campus|zhiye|feishu|moka|liepin|51job"
APPLY_LABEL = "(?i)投递|网申|申请|官网|招聘"

# --- fixed values: hosts of the source graph ----------------------------------
EXCLUDED_HOSTS = [
    "github.com", "raw.githubusercontent.com", "job.ncss.cn", "www.ncss.cn", "nowcoder.com", "www.nowcoder.com",
    "bosszhipin.com", "www.zhipin.com", "liepin.com", "www.liepin.com", "51job.com", "www.51job.com", "zhaopin.com",
    "www.zhaopin.com", "offerjack.cn", "www.offerjack.cn", "gitee.com", "mp.weixin.qq.com", "weixin.qq.com",
]
EXCLUDED_SUFFIX = r"\.edu\.cn$|\.gov\.cn$"
CAREER_HINT = "(?i)career|careers|campus|recruit|recruitment|job|jobs|join|talent|zhaopin|hr|招聘|校招"
BOARD_HINT = (
    r"jobs\.feishu\.cn|zhiye\.com|mokahr\.com|mokahr\.com\.cn|hotjob\.cn|smartrecruiters\.com|greenhouse\.io|lever\.co"
    r"|ashbyhq\.com|recruitee\.com"
)
SHARED_BOARD = r"ashbyhq\.com|lever\.co|smartrecruiters\.com|greenhouse\.io"
TRACKING_PARAMS = ["utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term"]
TRACKING_PARAMS_LATER = TRACKING_PARAMS + ["spm", "from"]

# --- fixed values: application stages, in order -------------------------------
STAGES = [
    "discovered", "wishlist", "preparing", "applied", "assessment", "interview1", "interview2", "interview3", "hr",
    "offer", "signed", "rejected",
]
NOT_APPLIED = ["discovered", "wishlist", "preparing"]
INTERVIEW = ["interview1", "interview2", "interview3", "hr"]
OFFERS = ["offer", "signed"]

# --- fixed values: column aliases of heterogeneous records --------------------
RECORD_ALIASES = {
    "company": ["企业名称", "公司名称", "company", "companyName", "company_name", "employer"],
    "role": ["职位", "岗位", "position", "positionName", "job", "jobName", "title"],
    "updated_at": ["updated_at", "updatedAt", "date", "publishDate"],
    "department": ["department", "部门"],
    "location": ["location", "city", "workplace", "工作地点"],
    "salary": ["salary", "薪资"],
    "batch": ["batch", "招聘批次"],
    "company_type": ["company_type", "companyType", "企业性质"],
    "industry": ["industry", "行业"],
    "graduation": ["graduation", "graduateYear", "毕业年份"],
    "education": ["education", "学历"],
    "notice_url": ["notice_url", "noticeUrl", "detailUrl"],
    "apply_url": ["apply_url", "applyUrl", "url", "jobUrl"],
    "jd": ["jd", "description", "职位描述", "岗位描述"],
}
HEADER_ALIASES = {
    "updated_at": ["更新时间", "更新日期", "日期"],
    "company": ["企业名称", "公司名称", "企业", "公司"],
    "batch": ["招聘批次", "批次"],
    "company_type": ["企业性质", "公司性质", "性质"],
    "industry": ["行业"],
    "location": ["工作地点", "地点", "城市"],
    "role": ["职位", "岗位", "招聘岗位"],
    "graduation": ["毕业年份", "届别", "毕业时间"],
    "education": ["学历", "学历要求"],
    "notice_url": ["公告链接", "公告", "详情"],
    "apply_url": ["投递地址", "投递链接", "申请链接", "投递"],
}
TITLE_KEYS = [
    "jobname", "job_name", "jobtitle", "job_title", "positionname", "position_name", "positiontitle", "position_title",
    "postname", "post_name", "posttitle", "post_title", "recruitpostname", "recruit_post_name", "recruitpositionname",
    "recruit_position_name", "title",
]
ID_KEYS = [
    "jobid", "job_id", "jdid", "jd_id", "positionid", "position_id", "postid", "post_id", "recruitpostid",
    "recruit_post_id", "recruitpositionid", "recruit_position_id", "id", "code",
]
URL_KEYS = [
    "applyurl", "apply_url", "detailurl", "detail_url", "joburl", "job_url", "positionurl", "position_url", "posturl",
    "post_url", "shareurl", "share_url", "url", "href",
]
PLACE_KEYS = [
    "location", "locations", "locationname", "location_name", "city", "cities", "cityname", "city_name", "workcity",
    "work_city", "workplace", "work_place", "worklocation", "work_location", "districtlist", "district_list",
]

# --- fixed values: short transport keys, in order -----------------------------
SHORT_KEYS = {
    "i": "id", "c": "company", "r": "role", "l": "location", "u": "apply_url", "n": "notice_url", "d": "jd",
    "t": "updated_at", "b": "batch", "g": "graduation", "e": "education", "p": "salary", "y": "company_type",
    "h": "industry", "m": "department",
}
MERGE_FIELDS = [
    "updated_at", "department", "salary", "batch", "company_type", "industry", "graduation", "education", "notice_url",
    "apply_url", "jd",
]
