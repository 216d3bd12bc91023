"""Fixed values of the operators: word lists, weights and patterns. All of them can be replaced by parameters."""

from __future__ import annotations

# ---- fixed values: sentiment lexicon ----

POSITIVE = (
    "好","棒","赞","优秀","漂亮","美丽","好看","好吃","好玩",
    "喜欢","爱","开心","高兴","快乐","幸福","感动","精彩",
    "完美","厉害","牛","强","不错","满意","期待","支持",
    "希望","恭喜","祝贺","感谢","谢谢","伟大","光荣","正确",
    "进步","成功","胜利","健康","安全","先进","丰富","繁荣",
    "美好","善良","真诚","热情","积极","乐观","开朗","温柔",
    "体贴","细心","耐心","勤奋","努力","奋斗","拼搏","勇敢",
    "坚强","镇定","冷静","聪明","智慧","幽默","风趣","可爱",
    "萌","帅","美","酷","时尚","高档","大气","实用","方便",
    "快捷","高效","一流","领先","创新","突破","奇迹","惊艳",
    "经典","传奇","称赞","赞扬","表扬","赞美","赞赏","佩服",
    "崇拜","尊敬","敬重","敬佩","信赖","信任","可靠","稳定",
    "出色","杰出","卓越","非凡","精彩纷呈","激动人心","令人振奋",
    "赏心悦目","心旷神怡","无与伦比","叹为观止","赞不绝口",
    "温柔","暖心","贴心","用心","良心","高质量","高品质",
    "福音","诚意","良心","靠谱","超值","划算","大爱","绝了",
    "宝藏","神仙","心动","种草","回购","好用","细腻","清爽","愉快","舒畅","真好","挺好",
)

NEGATIVE = (
    "差","坏","烂","垃圾","恶心","讨厌","烦","无聊","坑",
    "黑","假","骗","虚假","伪造","糟糕","失败","错误","愚蠢",
    "笨","傻","弱","差劲","可恶","可恨","过分","无耻","卑鄙",
    "丑陋","黑暗","恐怖","可怕","危险","紧张","焦虑","担心",
    "害怕","恐惧","悲伤","伤心","难过","痛苦","悲哀","绝望",
    "愤怒","生气","恼火","气愤","恨","厌恶","鄙视","看不起",
    "嘲笑","讽刺","挖苦","攻击","谩骂","辱骂","侮辱","诽谤",
    "造谣","谣言","欺骗","欺诈","诈骗","陷阱","漏洞","问题",
    "缺陷","毛病","故障","事故","灾难","危机","风险","损失",
    "亏损","下跌","下降","减少","恶化","落后","退步","停滞",
    "衰退","不满","失望","遗憾","可惜","痛心","心疼","担忧",
    "忧虑","惶恐","不安","尴尬","难堪","丢脸","耻辱","羞愧",
    "自责","后悔","懊悔","悔恨","埋怨","抱怨","吐槽","批评",
    "批判","指责","谴责","痛斥","曝光","被坑","被宰","被割",
    "贵","贵得离谱","天价","乱收费","霸王条款","偷工减料",
    "粗制滥造","粗心","离谱","扯淡","忽悠","坑爹","无语","醉了","坑人","不值","卡顿","太差","不太好","不太好用","太贵","太差劲","太糟糕","敷衍","冷落","冷淡","粗暴","恶劣",
    "低效","落后","陈旧","腐烂","腐败","贪污","受贿",
)

#: The factor that the word before gives.
DEGREE = {
    "很": 1.5, "非常": 2.0, "太": 2.0, "极": 2.5, "极其": 2.5,
    "极度": 2.5, "十分": 2.0, "特别": 2.0, "尤其": 1.8,
    "比较": 1.3, "相当": 1.8, "挺": 1.3, "有点": 0.6,
    "有些": 0.6, "稍微": 0.5, "略微": 0.5, "更加": 1.8,
    "更": 1.5, "最": 2.5, "最为": 2.5, "越": 1.5, "愈发": 1.8,
    "颇": 1.5, "甚": 2.0, "极为": 2.5, "万分": 2.5,
    "超级": 2.5, "无比": 2.5, "格外": 2.0, "分外": 2.0,
    "绝": 2.0, "巨": 2.0, "超": 2.0, "老": 1.5,
}

NEGATION = (
    "不","没","别","无","未","莫","勿","毋","甭",
    "不用","不要","没有","不是","不会","不能","不行",
    "不可","不必","不好","不对","不该","不许","禁止","再也","再也不",
)

EMOJI_WEIGHT = {
    "\U0001f600": 2.0, "\U0001f601": 2.0, "\U0001f602": 2.0,
    "\U0001f604": 2.0, "\U0001f60a": 1.5, "\U0001f60d": 2.0,
    "\U0001f618": 2.0, "\U0001f61c": 1.0, "\U0001f60e": 1.5,
    "\U0001f44d": 1.0, "\U0001f44f": 1.0, "\U0001f44c": 1.0,
    "\U0001f4aa": 1.0, "\U0001f389": 2.0, "\U0001f38a": 2.0,
    "\U00002764": 2.0, "\U0001f49c": 1.5,
    "\U0001f622": -2.0, "\U0001f62d": -2.0, "\U0001f621": -2.5,
    "\U0001f624": -2.0, "\U0001f620": -2.0, "\U0001f616": -1.5,
    "\U0001f61e": -1.5, "\U0001f614": -1.5, "\U0001f629": -1.5,
    "\U0001f630": -2.0, "\U0001f631": -2.0, "\U0001f4a9": -2.0,
    "\U0001f44e": -1.5, "\U0001f494": -2.0, "\U0001f4a2": -2.0,
}

EMOTIONS = {
    "喜悦": ("开心","高兴","快乐","幸福","喜悦","欢快",
        "欣喜","欢欣","兴高采烈","喜笑颜开"),
    "愤怒": ("愤怒","生气","恼火","气愤","怒","怒火",
        "暴怒","火大","气死"),
    "悲伤": ("悲伤","伤心","难过","痛苦","悲哀","哀伤",
        "悲痛","心碎","忧伤","沮丧"),
    "焦虑": ("焦虑","担心","忧虑","惶恐","不安","紧张",
        "害怕","恐惧","担忧"),
    "惊讶": ("惊讶","吃惊","震惊","诧异","意外","惊呆",
        "难以置信","不可思议"),
    "厌恶": ("厌恶","讨厌","恶心","反感","憎恶","鄙视",
        "看不起","嫌弃","厌烦"),
}

ASPECTS = {
    "功能": ("功能","性能","配置","参数","规格","速度",
        "反应","流畅"),
    "价格": ("价格","价钱","价位","定价","售价","花费",
        "费用","成本","性价比","折扣","优惠"),
    "质量": ("质量","品质","材质","做工","质感","手感",
        "耐用","寿命"),
    "服务": ("服务","售后","客服","态度","体验","感受",
        "物流","配送","发货"),
    "外观": ("外观","颜值","设计","造型","颜色","款式",
        "样式","外表","样子"),
    "口感": ("口感","味道","口味","美味","好吃","难吃",
        "香甜","鲜美"),
}

# ---- fixed values: entities ----

PRODUCT_SUFFIXES = (
    "手机","电脑","平板","笔记本","电视","冰箱","洗衣机",
    "空调","耳机","音箱","相机","镜头","手表","手环",
    "汽车","电动车","摩托车","自行车","飞机","轮船",
    "系统","软件","APP","应用","游戏","平台","服务",
    "基金","股票","债券","保险","理财",
    "面膜","精华","乳液","面霜","眼霜","口红","香水",
)

WEEKDAYS = (
    "星期一","星期二","星期三","星期四","星期五","星期六","星期日",
    "周一","周二","周三","周四","周五","周六","周日",
    "礼拜一","礼拜二","礼拜三","礼拜四","礼拜五","礼拜六","礼拜日",
)

RELATIVE_TIMES = (
    "今天","明天","昨天","前天","后天",
    "今年","明年","去年","前年","后年",
    "本月","上月","下月","本周","上周","下周",
    "今日","明日","昨日",
    "刚刚","刚才","现在","目前","当前"
)

TIME_PATTERN = (
    r"[0-9]{2,4}\s*[年月](?:\s*[0-9]{1,2}\s*[月日号])?"
    r"|[0-9]{1,2}\s*[：:]\s*[0-9]{2}(?:\s*[：:]\s*[0-9]{2})?"
    r"|[0-9]{4}\s*[年\-/]\s*[0-9]{1,2}\s*[月\-/]\s*[0-9]{1,2}(?:\s*[日号])?(?:\s*[0-9]{1,2}\s*[：:]\s*[0-9]{2}(?:\s*[：:]\s*[0-9]{2})?)?"
)
MONEY_PATTERN = r"[0-9]+(?:\.[0-9]+)?\s*(?:元|块|美元|欧元|英镑|日元|万|亿|万元|亿元|美元|港币|韩元|卢布|澳元|加元|法郎|马克)"
PERCENT_PATTERN = r"[0-9]+(?:\.[0-9]+)?\s*%"

# ---- fixed values: cleaning ----

AD_KEYWORDS = (
    "点击购买", "立即下单", "限时优惠", "免费领取", "加V", "添加微信", "扫码",
    "二维码", "转发抽奖", "关注送", "复制链接", "包邮", "清仓", "跳转",
)
#: What \w and \s cover in the patterns below.
WORD, BLANK = r"\p{L}\p{N}_", r"\p{IsWhite_Space}\x1c-\x1f"
URL_PATTERN = rf"""(?i)https?://[^{BLANK},，。；！!?？】)）\]」』》"'、…—–\-]+"""
MENTION_PATTERN = rf"@[{WORD}\-]+"
HASHTAG_PATTERN = r"#([^#]+)#"
TAG_PATTERN = r"<[^>]+>"
REPEATED_PATTERN = rf"([！!？?。，、；：….,;:{BLANK}]){{2,}}"
NOISE_PATTERN = rf"""[^\x{{4e00}}-\x{{9fff}}\x{{3400}}-\x{{4dbf}}{WORD}{BLANK}.,!?;:\-+#@&$€¥%°~^*()\[\]{{}}/"'、。，！？；：…—·【】（）《》]"""
BOILERPLATE_PATTERNS = (
    rf"收起[{WORD}]?",
    rf"查看[{BLANK}]*(图片|视频|全文|详情)",
    rf"[0O][{BLANK}]*网页[{BLANK}]*链接",
    rf"转发[{BLANK}]*微博",
    rf"我[{BLANK}]*分享[{BLANK}]*了",
    rf"（[{BLANK}]*分享[{BLANK}]*自[{BLANK}]*[^）]*）",
    r"\(分享自[^)]*\)",
)
EMOJI_RANGES = (
    ("1F600", "1F64F"), ("1F300", "1F5FF"), ("1F680", "1F6FF"), ("1F1E0", "1F1FF"), ("1F900", "1F9FF"),
    ("1FA00", "1FA6F"), ("1FA70", "1FAFF"), ("231A", "231B"), ("23E9", "23F3"), ("25AA", "25AB"), ("25B6", "25B6"),
    ("25C0", "25C0"), ("25FB", "25FE"), ("2600", "27BF"), ("2702", "27B0"), ("2934", "2935"), ("2B05", "2B07"),
    ("2B1B", "2B1C"), ("2B50", "2B50"), ("2B55", "2B55"), ("3030", "3030"), ("303D", "303D"), ("3297", "3297"),
    ("3299", "3299"), ("200D", "200D"), ("20E3", "20E3"), ("A9", "A9"), ("AE", "AE"), ("2122", "2122"),
    ("FE00", "FE0F"), ("FEFF", "FEFF"), ("200B", "200E"),
)
EMOJI_PATTERN = "[" + "".join(rf"\x{{{a}}}-\x{{{b}}}" for a, b in EMOJI_RANGES) + "]+"
DROPPED_TOKEN_PATTERN = rf"""^[\p{{Nd}}{BLANK}.,!?;:\-+#@&$%*()\[\]{{}}/'"]+$"""
#: What is used if no stopword file is given.
STOPWORDS = (
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一", "一个", "上", "也",
    "很", "到", "说", "要", "去", "你", "会", "着", "没有", "看", "好", "自己", "这", "他", "她",
    "它", "们", "那", "什么", "怎么", "为什么", "吗", "吧", "啊", "呢", "哦", "哈", "呀", "啦",
)
#: Some traditional characters and their simplified forms; a longer table can be given.
TRADITIONAL = "萬與專業東絲兩嚴個豐臨為麗舉麼義烏樂喬習鄉書買亂爭於雲產畝親億僅從倉儀們價眾優會傘偉傳傷倫偽體餘傭俠侶僑"
SIMPLIFIED = "万与专业东丝两严个丰临为丽举么义乌乐乔习乡书买乱争于云产亩亲亿仅从仓仪们价众优会伞伟传伤伦伪体余佣侠侣侨"

# ---- fixed values: personal data ----

REDACTED = "[PII-REDACTED]"
#: Category, pattern, and whether only the first group counts (it ends the match); earlier ones win ties.
PII_PATTERNS = (
    ("id_card", r"(?<![0-9])[1-9][0-9]{17}(?![0-9])", False),
    ("id_card_x", r"(?<![0-9])[1-9][0-9]{17}[Xx](?![0-9])", False),
    ("id_card_zh", r"身份证号是([幺两二三四五六七八九零一X]{18})", True),
    ("mobile_phone", r"(?<![0-9])1[3-9][0-9][\s.\-]?[0-9]{4}[\s.\-]?[0-9]{4}(?![0-9])", False),
    ("mobile_phone_zh", r"(?:手机(?:号|机)|电话|号码)[是为：:\s]*([幺两二三四五六七八九零一]{11})", True),
    ("bank_card", r"(?<![0-9])[1-9][0-9]{11,18}(?![0-9Xx])", False),
    ("email", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", False),
)
CHINESE_DIGITS, ARABIC_DIGITS = "幺两零一二三四五六七八九", "110123456789"

# ---- fixed values: transcripts ----

HOMOPHONES = {"材": "才", "在": "再", "的": "得", "地": "得", "做": "作", "象": "像", "又": "有", "没": "每", "因": "应", "和": "或", "以": "已", "这": "这么"}
CORRECTIONS = (
    (r"""[，。！？；：、'"“”()（）【】]+""", " "),
    (r" +", " "),
    (r"^ +| +$", ""),
    (rf"([{WORD}]+)$", "$1。"),
    (r"[。！？]{3,}", "。"),
    (r"[,，]{3,}", "，"),
)
PII_HINTS = ("手机", "身份证", "银行卡", "密码", "账户", "地址", "姓名", "号码")
ANOMALY_HINTS = ("噪声", "噪音", "合成", "模糊")
NOISE_LABEL, SYNTHETIC_LABEL, CORRECTED_LABEL = "[强噪声]", "[疑似合成]", "[LLM已纠正]"

# ---- fixed values: events (type: triggers, slots); the first type that lists a trigger owns it ----

EVENT_TYPES = {
    "自然灾害": (("地震", "洪水", "台风", "暴雨", "火灾", "山体滑坡", "泥石流", "海啸", "旱灾", "雪灾", "冰雹", "沙尘暴"), ("时间", "地点", "类型", "结果")),
    "事故灾难": (("车祸", "坠机", "爆炸", "坍塌", "踩踏", "火灾", "矿难", "沉船", "追尾", "连环撞", "泄露"), ("时间", "地点", "类型", "结果")),
    "公共卫生": (("疫情", "病毒", "流感", "食物中毒", "疫苗", "确诊病例", "无症状", "核酸检测", "封控", "隔离"), ("时间", "地点", "类型", "结果")),
    "社会治安": (("抢劫", "凶杀", "绑架", "诈骗", "斗殴", "枪击", "砍人", "遇害", "杀人", "强奸", "盗窃"), ("时间", "地点", "主体", "结果")),
    "执法司法": (("逮捕", "判刑", "起诉", "通缉", "判决", "拘留", "刑事诉讼", "公诉", "定罪"), ("时间", "主体", "事由", "结果")),
    "维权抗议": (("维权", "抗议", "罢工", "示威", "上访", "举报", "投诉", "集体维权", "讨薪"), ("时间", "地点", "主体", "事由")),
    "救援救助": (("救援", "搜救", "救灾", "募捐", "救助", "驰援", "抢险", "抢救", "赈灾"), ("时间", "地点", "主体", "对象")),
    "政策发布": (("发布", "印发", "出台", "实施", "规定", "办法", "条例", "颁布", "施行"), ("时间", "主体", "政策", "内容")),
    "政策调整": (("调整", "放宽", "收紧", "取消", "恢复", "优化", "下调", "上调", "改革"), ("时间", "主体", "政策", "内容")),
    "领导人活动": (("视察", "出席", "讲话", "会见", "访问", "主持", "考察", "调研"), ("时间", "地点", "主体", "活动")),
    "会议召开": (("召开", "举行", "举办", "论坛", "峰会", "大会", "会议", "座谈会"), ("时间", "地点", "主体", "会议")),
    "外交事件": (("会谈", "声明", "谴责", "制裁", "联合公报", "抗议", "交涉", "对话"), ("时间", "主体", "对象", "内容")),
    "反腐倡廉": (("落马", "双开", "调查", "违纪", "受贿", "被查", "审查", "留置", "通报"), ("时间", "主体", "事由", "结果")),
    "产品发布": (("发布", "推出", "上市", "亮相", "首发", "开售", "预售", "登场"), ("时间", "主体", "产品", "地点")),
    "企业动态": (("成立", "更名", "搬迁", "裁员", "扩招", "重组", "架构调整", "关停"), ("时间", "主体", "动作", "内容")),
    "投融资": (("融资", "投资", "收购", "并购", "入股", "上市", "IPO", "募资", "注资"), ("时间", "主体", "对象", "金额")),
    "财报业绩": (("营收", "净利润", "增长", "下滑", "亏损", "财报", "业绩", "盈利"), ("时间", "主体", "金额", "结果")),
    "价格变动": (("涨价", "降价", "上调", "下调", "打折", "促销", "补贴"), ("时间", "主体", "产品", "金额")),
    "产品问题": (("缺陷", "投诉", "故障", "爆炸", "翻车", "失灵", "质量门", "维权"), ("时间", "主体", "产品", "原因")),
    "产品召回": (("召回", "下架", "停售", "退换", "维修"), ("时间", "主体", "产品", "原因")),
    "合同签约": (("签约", "合作", "战略合作", "协议", "达成合作", "签署", "联手"), ("时间", "主体", "合作方", "领域")),
    "破产重组": (("破产", "清算", "重组", "债务违约", "退市", "注销", "倒闭"), ("时间", "主体", "事由", "结果")),
    "市场竞争": (("对标", "超越", "碾压", "反击", "宣战", "竞争", "争夺"), ("时间", "主体", "对象", "领域")),
    "技术突破": (("突破", "首发", "首创", "自主研制", "攻克", "研发", "创新"), ("时间", "主体", "领域", "内容")),
    "科研发布": (("论文", "研究", "发现", "Nature", "Science", "期刊", "成果"), ("时间", "主体", "领域", "内容")),
    "影视上映": (("上映", "播出", "定档", "首播", "开播", "上线", "排片"), ("时间", "作品", "类型", "平台")),
    "综艺动态": (("开播", "收官", "淘汰", "晋级", "总决赛", "录制", "路透"), ("时间", "节目", "内容", "结果")),
    "明星动态": (("官宣", "恋情", "结婚", "离婚", "生子", "生日", "演唱会", "粉丝见面会"), ("时间", "主体", "事件", "内容")),
    "明星丑闻": (("出轨", "家暴", "吸毒", "逃税", "嫖娼", "偷拍", "塌房", "封杀"), ("时间", "主体", "类型", "结果")),
    "粉丝事件": (("撕番", "控评", "刷榜", "网暴", "饭圈", "打榜", "粉丝大战"), ("时间", "主体", "事件", "结果")),
    "游戏动态": (("上线", "更新", "停服", "版号获批", "内测", "公测", "DLC"), ("时间", "产品", "内容", "平台")),
    "比赛结果": (("夺冠", "晋级", "淘汰", "获胜", "失利", "冠军", "金牌", "捧杯", "摘金"), ("时间", "主体", "赛事", "结果")),
    "转会签约": (("转会", "签约", "加盟", "续约", "离队", "自由身"), ("时间", "主体", "对象", "金额")),
    "伤病事件": (("受伤", "骨折", "报销", "退赛", "伤病", "手术", "康复"), ("时间", "主体", "原因", "结果")),
    "禁赛处罚": (("禁赛", "罚款", "停赛", "处罚", "兴奋剂"), ("时间", "主体", "事由", "结果")),
    "纪录突破": (("打破纪录", "刷新", "历史第一", "破纪录", "创纪录"), ("时间", "主体", "成绩", "赛事")),
}
