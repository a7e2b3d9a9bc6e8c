"""Fixed values of the job-catalog domain.

Everything here is a constant that results depend on: word lists, patterns, vocabularies, lookup tables and
limits, written out in their natural order. Operators take them as default arguments; nothing is computed here.
"""

UNKNOWN = "未知"
COHORT = "2027"
BUSINESS_ZONE = "Asia/Shanghai"
POLICY_VERSION = "humanities-social-business-v1"

# --- fixed values: scope words ------------------------------------------------------------------------
SOCIAL_TERMS = ["社招", "社会招聘", "experienced hire", "experienced", "senior hire"]
CAMPUS_TERMS = ["校招", "校园招聘", "应届", "届毕业生", "campus", "graduate", "trainee", "管培"]
FEED_SOCIAL_WORDS = ["社招", "社会招聘", "experienced", "社会人才"]
FEED_CAMPUS_WORDS = ["校招", "校园", "应届", "毕业生", "graduate", "campus", "trainee", "管培"]
CAMPUS_PATH_WORDS = ["campus", "school", "graduate", "campushire"]

# --- fixed values: places -----------------------------------------------------------------------------
LOCATION_SEPARATORS = "[、/,，;；|]"
REMOTE_WORDS = ["remote", "work from home", "远程", "居家"]
MAINLAND_CITIES = {  # city -> province code
    "北京": "BJ", "上海": "SH", "天津": "TJ", "重庆": "CQ", "武汉": "HB", "广州": "GD", "深圳": "GD", "东莞": "GD",
    "佛山": "GD", "珠海": "GD", "杭州": "ZJ", "宁波": "ZJ", "南京": "JS", "苏州": "JS", "合肥": "AH", "成都": "SC",
    "西安": "SN", "郑州": "HA", "长沙": "HN", "青岛": "SD", "济南": "SD", "厦门": "FJ", "福州": "FJ", "沈阳": "LN",
    "大连": "LN", "哈尔滨": "HLJ", "南昌": "JX", "昆明": "YN",
}
PROVINCES = {
    "北京": "BJ", "上海": "SH", "天津": "TJ", "重庆": "CQ", "湖北": "HB", "广东": "GD", "浙江": "ZJ", "江苏": "JS",
    "安徽": "AH", "四川": "SC", "陕西": "SN", "河南": "HA", "湖南": "HN", "山东": "SD", "福建": "FJ", "辽宁": "LN",
    "黑龙江": "HLJ", "江西": "JX", "云南": "YN", "河北": "HEB", "广西": "GX", "贵州": "GZ", "吉林": "JL", "山西": "SX",
    "内蒙古": "NMG", "新疆": "XJ", "甘肃": "GS", "海南": "HI", "宁夏": "NX", "青海": "QH", "西藏": "XZ",
}
DISTRICTS = {  # district -> (province code, city)
    "嘉定区": ("SH", "上海"), "浦东新区": ("SH", "上海"), "黄浦区": ("SH", "上海"), "海淀区": ("BJ", "北京"),
    "朝阳区": ("BJ", "北京"), "天河区": ("GD", "广州"), "南山区": ("GD", "深圳"), "福田区": ("GD", "深圳"),
    "洪山区": ("HB", "武汉"),
}
OVERSEAS = {  # place -> (country code, country name)
    "新加坡": ("SG", "新加坡"), "东京": ("JP", "日本"), "日本": ("JP", "日本"), "首尔": ("KR", "韩国"),
    "韩国": ("KR", "韩国"), "吉隆坡": ("MY", "马来西亚"), "马来西亚": ("MY", "马来西亚"), "墨尔本": ("AU", "澳大利亚"),
    "悉尼": ("AU", "澳大利亚"), "巴黎": ("FR", "法国"), "伦敦": ("GB", "英国"), "美国": ("US", "美国"),
    "纽约": ("US", "美国"), "旧金山": ("US", "美国"),
}
HK_MO_TW = {"香港": "HK", "澳门": "MO", "台湾": "TW"}
NATIONWIDE = ["全国", "中国大陆", "大陆"]

# --- fixed values: places known to the page view (its own, larger, lists) ---------------------------------
PAGE_CITY_PROVINCE = {
    "北京": "BJ", "上海": "SH", "天津": "TJ", "重庆": "CQ", "广州": "GD", "深圳": "GD", "珠海": "GD", "东莞": "GD",
    "惠州": "GD", "肇庆": "GD", "武汉": "HB", "成都": "SC", "济南": "SD", "青岛": "SD", "德州": "SD", "崂山区": "SD",
    "杭州": "ZJ", "宁波": "ZJ", "南京": "JS", "苏州": "JS", "昆山": "JS", "建邺区": "JS", "合肥": "AH", "郑州": "HA",
    "长沙": "HN", "南昌": "JX", "福州": "FJ", "厦门": "FJ", "泉州": "FJ", "莆田": "FJ", "宁德": "FJ", "南平": "FJ",
    "龙岩": "FJ", "西安": "SN", "昆明": "YN", "太原": "SX", "石家庄": "HEB", "廊坊": "HEB", "固安县": "HEB",
    "沈阳": "LN", "大连": "LN", "长春": "JL", "白城": "JL", "南宁": "GX", "柳州": "GX", "贵阳": "GZ", "兰州": "GS",
    "海口": "HI", "乌鲁木齐": "XJ", "五家渠": "XJ", "头屯河区": "XJ", "呼和浩特": "NMG", "通辽": "NMG", "大同": "SX",
    "房山区": "BJ", "广阳区": "HEB", "嘉定区": "SH",
}
PAGE_CITY_PARENT = {
    "嘉定区": "上海", "浦东新区": "上海", "黄浦区": "上海", "海淀区": "北京", "朝阳区": "北京", "天河区": "广州",
    "南山区": "深圳", "福田区": "深圳", "洪山区": "武汉", "建邺区": "南京", "崂山区": "青岛", "广阳区": "廊坊",
    "房山区": "北京", "头屯河区": "乌鲁木齐", "固安县": "廊坊",
}
PAGE_OVERSEAS = {
    "东京": "JP", "大阪": "JP", "新加坡": "SG", "纽约": "US", "伦敦": "GB", "巴黎": "FR", "悉尼": "AU", "多伦多": "CA",
    "温哥华": "CA", "旧金山": "US", "洛杉矶": "US", "首尔": "KR", "迪拜": "AE", "墨尔本": "AU", "曼谷": "TH",
    "吉隆坡": "MY", "雅加达": "ID", "胡志明": "VN", "马尼拉": "PH", "莫斯科": "RU", "圣保罗": "BR", "波哥大": "CO",
    "布宜诺斯艾利斯": "AR", "华沙": "PL", "鹿特丹": "NL", "马德里": "ES", "慕尼黑": "DE", "西雅图": "US",
    "帕罗奥多": "US", "杜塞尔多夫": "DE",
}
COUNTRY_LABELS = {
    "JP": "日本", "SG": "新加坡", "US": "美国", "GB": "英国", "FR": "法国", "AU": "澳大利亚", "CA": "加拿大",
    "KR": "韩国", "AE": "阿联酋", "TH": "泰国", "MY": "马来西亚", "ID": "印度尼西亚", "VN": "越南", "PH": "菲律宾",
    "RU": "俄罗斯", "BR": "巴西", "CO": "哥伦比亚", "AR": "阿根廷", "PL": "波兰", "NL": "荷兰", "ES": "西班牙",
    "DE": "德国",
}

# --- fixed values: role taxonomy ----------------------------------------------------------------------
ROLE_CATEGORIES = [
    "软件研发", "算法/AI", "数据", "硬件/芯片", "产品", "运营", "市场/品牌", "公关", "销售/商务", "供应链/采购/物流",
    "项目管理", "咨询", "金融/投研", "财务/审计", "人力资源", "法务/合规", "设计", "游戏策划/发行", "生产制造/质量",
    "医药/研发", "职能综合", "其他",
]
OTHER_ROLE = "其他"
ROLE_ALIASES = [
    (["算法", "机器学习", "大模型", "人工智能"], "算法/AI"),
    (["软件", "开发", "研发", "后端", "前端", "客户端", "测试开发", "工程师"], "软件研发"),
    (["芯片", "硬件", "电子", "射频", "嵌入式"], "硬件/芯片"),
    (["生产", "制造", "质量", "工艺"], "生产制造/质量"),
    (["医药", "临床", "药物"], "医药/研发"),
    (["法务", "法律", "合规", "专利"], "法务/合规"),
    (["设计", "美术", "建筑"], "设计"),
    (["市场", "品牌", "营销", "创意"], "市场/品牌"),
    (["公关", "媒介", "传播"], "公关"),
    (["销售", "商务", "客户成功", "客户服务", "服务与支持"], "销售/商务"),
    (["供应链", "采购", "物流", "采销", "仓储"], "供应链/采购/物流"),
    (["财务", "会计", "审计", "税务"], "财务/审计"),
    (["投资", "投研", "证券", "战略"], "金融/投研"),
    (["人力", "招聘", "人才", "hr"], "人力资源"),
    (["咨询"], "咨询"),
    (["项目管理", "项目经理"], "项目管理"),
    (["产品"], "产品"),
    (["运营", "增长", "内容", "社区"], "运营"),
    (["策划", "发行"], "游戏策划/发行"),
    (["管理培训", "管培", "综合", "职能"], "职能综合"),
    (["数据"], "数据"),
]
# "ai" counts only as a word of its own
FEED_ROLE_ALIASES = [
    (["算法", "机器学习", "大模型", "ai"], "算法/AI"),
    (["数据", "商业分析"], "数据"),
    (["芯片", "硬件", "射频", "电子", "fpga"], "硬件/芯片"),
    (["开发", "研发", "软件", "前端", "后端", "客户端", "测试工程"], "软件研发"),
    (["产品"], "产品"),
    (["运营"], "运营"),
    (["市场", "品牌", "营销"], "市场/品牌"),
    (["销售", "商务", "客户经理"], "销售/商务"),
    (["供应链", "采购", "物流", "仓储", "集配", "营业部", "场地", "采销"], "供应链/采购/物流"),
    (["财务", "会计", "审计"], "财务/审计"),
    (["投资", "投研", "证券"], "金融/投研"),
    (["人力", "招聘", "hr"], "人力资源"),
    (["法务", "合规"], "法务/合规"),
    (["设计", "美术"], "设计"),
    (["策划", "发行"], "游戏策划/发行"),
    (["生产", "制造", "质量", "工艺"], "生产制造/质量"),
    (["医药", "临床", "药物"], "医药/研发"),
    (["项目管理", "项目经理"], "项目管理"),
]
BATCH_MARKERS = [
    ("提前批", "提前批"), ("秋招补录", "秋招补录"), ("春招补录", "春招补录"), ("秋季校园招聘", "秋招正式批"),
    ("秋招", "秋招正式批"), ("春季校园招聘", "春招"), ("春招", "春招"), ("实习转正", "实习转正"),
    ("管培", "管培生/专项计划"), ("专项计划", "管培生/专项计划"), ("日常校招", "日常校招"),
]
EDUCATION_MARKERS = [(["博士"], "博士"), (["硕士", "研究生"], "硕士"), (["本科", "学士"], "本科"), (["大专", "专科"], "大专")]

# --- fixed values: audience policy ----------------------------------------------------------------------
BLOCKED_CATEGORIES = [
    ("软件研发", "BLOCKED_TECHNICAL_ROLE"), ("算法/AI", "BLOCKED_TECHNICAL_ROLE"), ("硬件/芯片", "BLOCKED_TECHNICAL_ROLE"),
    ("技术", "BLOCKED_TECHNICAL_ROLE"), ("生产制造/质量", "BLOCKED_TECHNICAL_ROLE"),
    ("医药/研发", "BLOCKED_LEGAL_OR_MEDICAL_ROLE"), ("法务/合规", "BLOCKED_LEGAL_OR_MEDICAL_ROLE"),
    ("设计", "BLOCKED_SPECIALIST_PORTFOLIO"),
]
BLOCKED_TITLE_PATTERNS = [
    (r"算法|机器学习|深度学习|大模型|人工智能|自然语言处理|计算机视觉|机器视觉|数据科学|数据科学家|数据工程|数据工程师|分析工程师|信息安全|网络安全|computer[- ]?science|computer[- ]?engineering|software[- ]?engineering|information[- ]?technology|electrical[- ]?engineering|electronic[- ]?engineering|mechanical[- ]?engineering|civil[- ]?engineering|materials?[- ]?engineering|chemical[- ]?engineering|machine[- ]?learning|deep[- ]?learning|artificial[- ]?intelligence|computer[- ]?vision|machine[- ]?vision|natural[- ]?language|data[- ]?science|data[- ]?scientist|data[- ]?engineering|information[- ]?security|network[- ]?security|large[- ]?language[- ]?models?|multimodal(?:ity)?|multi[- ]?modal|reinforcement[- ]?learning|world[- ]?model|speech[- ]?synthesis|video[- ]?generation|algorithm|(?<![a-z])AI(?![a-z])|(?<![a-z])NLP(?![a-z])|(?<![a-z])LLM(?:s)?(?![a-z])|(?<![a-z])ML(?![a-z])|(?<![a-z])RL(?![a-z])", "BLOCKED_TECHNICAL_ROLE"),
    (r"软件开发|系统开发|应用开发|平台开发|开发工程师|研发|后端|前端|客户端|安卓|Android|iOS|测试开发|测试工程师|软件测试|测试岗|运维|运维工程师|IT运维|DevOps|SRE|数据库管理员|数据库管理|系统管理员|网络管理员|网络工程师|云计算|云平台|平台运维|信息技术|系统架构|架构师|back[- ]?end|front[- ]?end|full[- ]?stack|softwaredevelopment|applicationdevelopment|platformdevelopment", "BLOCKED_TECHNICAL_ROLE"),
    (r"工程师|工程技术|工程研发|工程项目|工程管理|技术开发|技术研发|技术岗|技术专员|技术经理|嵌入式|芯片|硬件|电路|FPGA|结构工程|机械工程|电子工程|自动化工程|车辆工程|工艺工程|电网|电力|输电|变电|配电|电力建设|工程建设|系统设计|结构设计|电驱|动力系统|BMS|机器人|技术运营|技术产品|技术项目|技术支持|技术岗位|技术策划|工程研发|架构师|系统工程|engineer|developer|software|technical|embedded|systemdesign|structuraldesign|powertrain|datascientist|dataengineer|backend|frontend|fullstack|softwaredevelopment|applicationdevelopment|platformdevelopment|database(?:administrator|admin)?|databasemanager|it\s+operations?|itoperations?|researchanddevelopment|research\s*[&+]\s*development|research&development|r&d|engineeringresearch|engineresearch|researchscientist|modelresearcher|technicalresearch|codingllms?|agenticrl|cloudinfrastructure|infrastructureengineer|networkengineer|systems?administrator", "BLOCKED_TECHNICAL_ROLE"),
    (r"量化|精算|实验室|实验研究|科研|quantitative|actuary|scientist|laboratory|researchscientist", "BLOCKED_TECHNICAL_ROLE"),
    (r"医学|临床|药物研发|药理|药剂|医师|护士|clinical|medical|pharma|physician|nurse", "BLOCKED_LEGAL_OR_MEDICAL_ROLE"),
    (r"法务|律师|法律|合规|专利|legal|lawyer|compliance|patent", "BLOCKED_LEGAL_OR_MEDICAL_ROLE"),
    (r"制造工程|生产工艺|质量工程|工艺技术", "BLOCKED_TECHNICAL_ROLE"),
    (r"工业设计|建筑设计|建筑师|视觉设计|UI设计|UX设计|交互设计|产品设计|运营设计|品牌创意设计|设计师|设计岗|设计类|设计方向|美术|原画|插画|体育教练|industrialdesign|architect|visualdesigner|uidesigner|uxdesigner|designer|design", "BLOCKED_SPECIALIST_PORTFOLIO"),
]
NON_TARGET_MAJORS = [
    r"计算机(?:科学与技术|类|相关)?|理工科|工科|理科|工学|理学|computerscience|computerengineering|engineering",
    r"软件工程|softwareengineering",
    r"信息(?:与计算机|安全|工程)?|informationtechnology|informationengineering",
    r"电子(?:信息|工程)?|electricalengineering|electronicengineering",
    r"通信工程?|telecommunication",
    r"自动化",
    r"电气工程|电气",
    r"机械(?:工程)?|mechanicalengineering",
    r"车辆工程|汽车工程|automotiveengineering",
    r"材料(?:科学与工程|工程)?|materialsengineering",
    r"化学(?:工程|类)?|chemicalengineering",
    r"物理(?:学|类)?|physics",
    r"数学(?:与应用数学|类)?|mathematics",
    r"土木(?:工程)?|civilengineering",
    r"建筑(?:学|工程)?|architecture",
    r"测绘|surveying",
    r"能源(?:动力|工程)?|energyengineering",
    r"控制科学|控制工程|controlengineering",
    r"生物(?:工程|医学|科学)?|biologicalengineering|biology",
    r"医学|临床医学|药学|药物制剂|护理|medicine|clinicalmedicine|pharmacy|nursing",
    r"法学|法律|law",
    r"工业设计|艺术设计|视觉传达|产品设计|建筑设计|设计(?:学|类|专业)?|美术(?:学|类|专业)?|建筑(?:学|类|专业)?|industrialdesign|graphicdesign|design",
    r"体育教育|运动训练|体育(?:学|类|专业)?|sportseducation|sportstraining|sports?",
]
TARGET_MAJORS = [
    r"文科|人文|中文|汉语言|历史|哲学|语言文学|外语|英语|日语|翻译|humanities|english|languages?",
    r"新闻传播|广告学|传播学|新闻学|公共关系|communications?|journalism|publicrelations|advertising",
    r"社会学|社会工作|心理学|政治学|公共管理|行政管理|教育学|社会科学|社科|socialsciences?|psychology|publicadministration|education",
    r"经济学|金融学|财务管理|会计学|审计学|工商管理|企业管理|市场营销|国际商务|电子商务|物流管理|供应链管理|经济管理|business|economics|finance|accounting|businessadministration|marketing|management",
    r"商科|管理类|经管类|不限专业|专业不限|无专业限制|anymajor|allmajors|nomajorrestriction",
]
MAJOR_CUES = r"专业|相关|背景|学历|学位|本科|硕士|博士|major|degree|discipline|field|background|stud(?:y|ying)|graduate|require"
MAJOR_CUE_BEFORE = 12
MAJOR_CUE_AFTER = 20
MAJOR_SHARE = 0.45
STRONG_MARKERS = ["仅限", "限招", "限专业", "必须", "须为", "要求专业", "专业要求", "本科专业为", "学历专业", "required", "requires", "must", "mandatory", "needto"]
SOFT_MARKERS = ["优先", "加分", "优先考虑", "熟悉", "了解", "有经验者", "preferred", "preferably", "nicetohave", "aplus"]
UNRESTRICTED_MAJOR = r"不限专业|专业不限|无专业限制|any\s+major|all\s+majors?|no\s+major\s+restriction|open\s+to\s+all\s+majors?"
UNRESTRICTED_TERM = "不限专业"
PORTFOLIO_DEMAND = r"(?:必须|须|要求|需要|需|提交|提供|附上|附带).{0,16}(?:作品集|portfolio)|(?:作品集|portfolio).{0,16}(?:必须|required|must|mandatory)"
PORTFOLIO_OF_BUSINESS = r"portfolio\s+(?:management|strategy|analytics|optimization)|(?:investment|client|sales|product)\s+portfolio"
GENERALIST_TITLES = [
    r"运营|用户增长|内容|社区|活动|市场|品牌|公关|媒介|商务|销售|客户成功|客户服务|operations?|marketing|brand|communications?|sales|businessdevelopment|customersuccess|customerservice|content|community",
    r"人力|招聘|培训|行政|综合管理|管培|管理培训|humanresources?|recruiting|talent|training|administration|managementtrainee",
    r"财务|会计|审计|税务|咨询|投研|投资|采购|供应链|物流|finance|accounting|audit|tax|consulting|investment|procurement|supplychain|logistics",
    r"产品经理|产品运营|项目管理|项目专员|游戏策划|发行|productmanager|productoperations?|projectmanagement|projectcoordinator|gameplanner|gameproducer",
]

# --- fixed values: source gate ------------------------------------------------------------------------
JSON_ADAPTERS = [
    "baidu", "jd", "feishu", "tencent", "tencent_json", "ashby", "ashby_campus", "beisen", "beisen_campus",
    "beisen_modern", "beisen_bsglobal", "beisen_legacy", "beisen_campus_legacy", "italent", "wecruit", "workable",
    "workable_campus", "json", "json_api", "jsonld", "json_ld", "jobposting", "structured_html", "static_html",
    "html_table", "table", "static", "greenhouse", "greenhouse_campus", "lever", "lever_campus", "successfactors_json",
    "smartrecruiters", "smartrecruiters_campus", "personio", "personio_campus", "bamboohr", "bamboohr_campus",
    "breezy", "breezy_campus", "oracle", "oracle_campus", "icims", "icims_campus",
]
FEED_ADAPTERS = ["teamtailor", "recruitee", "successfactors", "personio", "rss", "atom", "xml", "feed"]
DOM_ADAPTERS = ["dom", "html", "dom_campus"]
HTML_ADAPTERS = [
    "dom", "html", "dom_campus", "static_html", "html_table", "table", "static", "icims", "icims_campus",
    "beisen_legacy", "beisen_campus_legacy",
]
JSONLD_ADAPTERS = ["jsonld", "json_ld", "jobposting", "structured_html"]
SITEMAP_ADAPTERS = ["jsonld", "json_ld", "jobposting", "structured_html", "static_html", "html_table", "table", "static"]
RUNNABLE_MODES = ["JSON", "RSS", "XML", "HTML", "JSONLD", "SITEMAP"]
NEVER_AUTOMATIC_ADAPTERS = ["moka", "boss", "boss_zhipin", "manual", "manual_or_ats", "provisional_html"]
EVIDENCE_ADAPTERS = [
    "feishu", "tencent", "tencent_json", "baidu", "jd", "beisen", "beisen_campus", "beisen_modern", "beisen_bsglobal",
    "beisen_legacy", "beisen_campus_legacy", "italent", "wecruit", "workday", "workday_campus", "greenhouse",
    "greenhouse_campus", "lever", "lever_campus", "ashby", "ashby_campus", "workable", "workable_campus", "teamtailor",
    "recruitee", "successfactors", "successfactors_json", "smartrecruiters", "smartrecruiters_campus", "personio",
    "personio_campus", "bamboohr", "bamboohr_campus", "breezy", "breezy_campus", "oracle", "oracle_campus", "icims",
    "icims_campus", "rss", "atom", "xml", "feed", "json", "json_api", "jsonld", "json_ld", "jobposting",
    "structured_html", "static_html", "html_table", "table", "static",
]
EVIDENCE_FLAGS = [
    ("official_reverse_link", "official_reverse_link_missing"),
    ("public_access_no_auth", "public_access_requires_auth"),
    ("robots_terms_allowed", "robots_terms_not_reviewed"),
    ("current_cohort_evidence", "current_cohort_evidence_missing"),
    ("campus_evidence", "campus_evidence_missing"),
    ("company_identity_exact", "company_identity_not_exact"),
    ("apply_domain_verified", "apply_domain_not_verified"),
]
VERIFIED_STATUSES = ["VERIFIED", "AUTO_VERIFIED"]
HEALTHY_STATES = ["healthy", "not_modified"]
LARGE_SCALES = ["500–999", "1000–9999", "10000+"]
REQUIRED_JOB_FIELDS = ["title", "company_name", "city", "role_category", "cohort", "batch", "education", "apply_url", "source_url"]
SUMMARY_DROPPED = [
    "description", "requirements", "source_evidence", "source_job_id", "is_campus", "campaign_name", "campaign_open_date",
    "campaign_deadline", "campaign_official_url", "first_missing_successes", "audience_decision", "audience_reason_codes",
]

# --- fixed values: pages ------------------------------------------------------------------------------
HIDDEN_TAGS = ["script", "style", "noscript", "template", "svg"]
BREAK_TAGS = ["p", "li", "br", "div", "section", "h1", "h2", "h3"]
VENDOR_SIGNATURES = [
    ("FEISHU", ["jobs.feishu.cn", "jobs.bytedance.com", "/api/v1/search/job/posts"]),
    ("MOKA", ["mokahr.com", "moka.hr", "mokacdn.com"]),
    ("BEISEN", ["zhiye.com", "wecruit.com.cn", "italent"]),
    ("GREENHOUSE", ["greenhouse.io", "boards.greenhouse.io", "boards-api.greenhouse.io"]),
    ("LEVER", ["jobs.lever.co", "api.lever.co"]),
    ("ASHBY", ["ashbyhq.com", "jobs.ashbyhq.com", "api.ashbyhq.com"]),
    ("WORKDAY", ["myworkdayjobs.com", "workdayjobs.com", "workday.com"]),
    ("SUCCESSFACTORS", ["successfactors.com", "jobs2web.com", "sapsf.com"]),
    ("TEAMTAILOR", ["teamtailor.com", "teamtailor-cdn.com"]),
    ("RECRUITEE", ["recruitee.com", "api.recruitee.com"]),
    ("WORKABLE", ["apply.workable.com", "workable.com"]),
    ("SMARTRECRUITERS", ["jobs.smartrecruiters.com", "api.smartrecruiters.com", "smartrecruiters.com"]),
    ("PERSONIO", ["jobs.personio.com", "personio.com/xml", "personio.de/xml"]),
    ("BAMBOOHR", ["bamboohr.com/careers", "boards.bamboohr.com"]),
    ("BREEZY", ["breezy.hr", "api.breezy.hr"]),
    ("ORACLE", ["oraclecloud.com", "hcmUI/CandidateExperience"]),
    ("ICIMS", ["icims.com", "icims.com/jobs"]),
    ("BOSS", ["zhipin.com", "boss直聘", "bosszhipin.com"]),
]
CONNECTOR_VENDORS = [
    "FEISHU", "GREENHOUSE", "LEVER", "ASHBY", "BEISEN", "TEAMTAILOR", "RECRUITEE", "SUCCESSFACTORS", "WORKABLE", "WORKDAY",
    "SMARTRECRUITERS", "PERSONIO", "BAMBOOHR", "BREEZY", "ORACLE", "ICIMS", "JSONLD", "STATIC_HTML",
]
FEED_MIME_TYPES = ["application/rss+xml", "application/atom+xml", "application/xml", "text/xml", "application/rdf+xml"]
FEED_PATH_TOKENS = ["/rss", "/feed", ".rss", ".xml", "atom"]
CHALLENGE_MARKERS = [
    "captcha", "验证码", "人机验证", "安全验证", "访问验证", "请完成验证", "verify you are human", "checking your browser",
    "just a moment", "challenge-platform", "cf-chl-", "enable cookies to continue",
]
BLOCKED_HTTP = [401, 403, 405, 429]
JSONLD_REQUIRED = ["title", "url", "description", "jobLocation", "datePosted", "hiringOrganization"]
RECRUITMENT_WORDS = ["招聘", "人才", "加入我们", "校园", "校招", "应届", "career", "careers", "jobs", "job", "campus", "join us", "graduate"]
RECRUITMENT_TEXT_BONUS = ["校园", "校招", "应届", "graduate", "campus"]
RECRUITMENT_PATH_BONUS = ["career", "job", "campus", "recruit", "join", "xiaozhao"]
RECRUITMENT_PAGE_WORDS = ["招聘", "招贤", "校招", "应届", "人才", "career", "recruit", "campus", "graduate", "jobs", "join"]
JOB_LINK_PATH_WORDS = ["job", "recruit", "career", "campus", "position", "vacancy", "zhaopin", "rczp", "xiaozhao"]
JOB_LINK_TITLE_WORDS = ["招聘", "校招", "应届", "岗位", "职位", "graduate", "campus", "recruit"]
TITLE_STOPWORDS = ["招聘岗位", "职位名称", "岗位名称", "职位", "岗位", "招聘信息", "人才招聘", "加入我们", "更多", "详情", "查看详情", "申请职位", "立即申请"]
LINK_STOPWORDS = [
    "首页", "关于我们", "新闻中心", "联系我们", "人才理念", "人才发展", "社会招聘", "校园招聘", "招聘", "人才", "加入我们",
    "了解更多", "查看", "详情", "下载", "登录", "注册",
]
FURNITURE_WORDS = ["版权所有", "ICP备", "Copyright", "隐私政策", "网站地图"]
NAVIGATION_TOKENS = ["nav", "menu", "footer", "header", "topbar", "breadcrumb"]
ROW_CITY_WORDS = ["北京", "上海", "天津", "重庆", "广州", "深圳", "杭州", "南京", "武汉", "成都", "西安", "全国", "远程"]
ROW_REQUIREMENT_WORDS = r"学历|专业|经验|熟悉|负责|能够|具备|要求"
LOCATION_REQUIREMENT_WORDS = r"学历|专业|经验|熟悉|负责|能够|具备|要求|流程|分析|优先"
COMPANY_NAME_WORDS = r"公司|集团|银行|证券|股份|有限|科技|网络|互联网|控股|能源|物流|零售|汽车|电商|信息"
DIRECTORY_HEADER_WORDS = ["公司名称", "证券简称", "股票代码", "Company Name"]
SITEMAP_MARKERS = ["sitemap", "site-map"]
FEED_MARKERS = ["/rss", "/atom", "/feed", ".rss", ".atom", ".xml"]
ATS_URL_TOKENS = ["jobs.feishu.cn", "zhiye.com", "mokahr.com", "myworkdayjobs.com", "greenhouse.io", "lever.co", "successfactors"]
CAMPAIGN_URL_TOKENS = ["/campus", "xiaozhao", "school", "campus-recruit", "校园"]
DIRECTORY_STATUSES = ["DISCOVERED", "ACTIVE_CONFIRMED", "ACTIVE_LEAD", "INACTIVE", "BLOCKED", "STALE"]
ENTRY_TYPES = ["OFFICIAL_CAREER_SITE", "OFFICIAL_ATS", "OFFICIAL_CAMPAIGN_PAGE", "ENTRY_LEAD"]
TWO_LEVEL_SUFFIXES = ["com.cn", "net.cn", "org.cn", "co.uk"]

# --- fixed values: envelopes and field aliases ----------------------------------------------------------
ROW_LIST_KEYS = ["jobs", "jobList", "jobPosts", "positions", "offers", "records", "results", "items", "list", "Posts", "content"]
ROW_LIST_WRAPPERS = ["data", "Data", "d", "result", "payload", "response"]
DIRECTORY_LIST_KEYS = ["companies", "companyList", "items", "results", "list", "rows", "records", "data", "result", "Data", "d", "pageHelp"]
PAGE_META_WRAPPERS = ["pageHelp", "pagination", "meta", "data", "result", "Data", "d"]
PAGE_TOTAL_KEYS = ["total", "totalCount", "count", "recordsTotal"]
PAGE_SIZE_KEYS = ["pageSize", "size", "limit"]
LISTING_TOTAL_KEYS = ["total", "totalCount", "totalNum", "count"]
COMPANY_NAME_KEYS = [
    "name", "companyName", "company_name", "fullName", "enterpriseName", "enterprise_name", "orgName", "org_name",
    "SEC_NAME_CN", "SEC_NAME_FULL", "FULL_NAME", "证券简称", "证券名称", "公司名称", "企业名称", "简称",
]
COMPANY_CODE_KEYS = ["stockCode", "stock_code", "code", "证券代码", "股票代码", "A_STOCK_CODE", "B_STOCK_CODE", "COMPANY_CODE"]
COMPANY_MARKET_KEYS = ["market", "exchange", "listingMarket", "上市市场", "交易所"]
FEED_RECORD_TAGS = ["item", "entry", "job", "position", "posting", "jobpost", "jobposting", "offer"]
WORKBOOK_HEADERS = {
    "stock_code": ["EN_EquityNatureAll.Symbol", "证券代码", "股票代码", "Symbol"],
    "short_name": ["EN_EquityNatureAll.ShortName", "证券简称", "股票简称", "简称"],
    "equity_as_of": ["EN_EquityNatureAll.EndDate", "截止日期"],
    "equity_nature": ["EN_EquityNatureAll.EquityNature", "股权性质"],
    "legal_name": ["STK_LISTEDCOINFOANL.FullName", "中文全称", "法定全称", "公司全称"],
    "homepage": ["STK_LISTEDCOINFOANL.Website", "公司网址", "官网", "网站"],
    "business": ["STK_LISTEDCOINFOANL.MAINBUSSINESS", "主营业务"],
    "listing_state": ["STK_LISTEDCOINFOANL.LISTINGSTATE", "上市状态"],
}
WORKBOOK_FALLBACK_COLUMNS = {
    "stock_code": "A", "short_name": "B", "equity_as_of": "C", "equity_nature": "D", "legal_name": "H", "homepage": "I",
    "business": "J", "listing_state": "K",
}
STATE_OWNED = "国企"
NORMAL_LISTING = "正常上市"
PUBLIC_LEAD_FIELDS = [
    "id", "companyId", "companyName", "title", "officialUrl", "officialUrlVerified", "sourceUrl", "sourcePlatform",
    "sourceAuthorLabel", "publishedAt", "discoveredAt", "verificationStatus", "note",
]
LEAD_PLATFORM = "xiaohongshu"
STAGE_EVENTS = {"SCREENING": "SCREENING", "ASSESSMENT": "ASSESSMENT", "INTERVIEW": "INTERVIEW", "OFFER": "OFFER", "REJECTED": "REJECTED", "APPLIED": "NOTE"}
UNTRACKED_STAGES = ["NOT_APPLIED", "REJECTED", "WITHDRAWN"]
