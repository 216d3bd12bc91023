"""Varied Chinese texts made from the keys of the supplied tables, in Spark and in SQL alike.

The supplied tables hold no Chinese. Each text here is a row of slots, and what fills a slot is drawn
from a list by a digest of the row's key: thousands of different texts that between them use every
word, pattern and branch of the operators. The SQL makes the same texts and derives the answers from
them by its own means.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import events
from ..functions import lexicons as L


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(words) -> str:
    return "[" + ", ".join(map(quoted, words)) + "]"


@dataclass(frozen=True)
class Pick:
    """One of the phrases, by a digest of the key and a salt."""

    salt: str
    phrases: tuple[str, ...]

    def column(self, key: Column) -> Column:
        number = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{self.salt}"))), 1, 6), 16, 10).cast("int")
        return F.get(F.array(*map(F.lit, self.phrases)), number % len(self.phrases))

    def sql(self, key: str) -> str:
        return f"{listed(self.phrases)}[1 + CAST('0x' || substr(md5({key} || ':{self.salt}'), 1, 6) AS BIGINT) % {len(self.phrases)}]"


class Key:
    """The key itself, padded with zeros."""

    def __init__(self, width: int = 1):
        self.width = width

    def column(self, key: Column) -> Column:
        return F.when(F.length(key) >= self.width, key).otherwise(F.lpad(key, self.width, "0"))

    def sql(self, key: str) -> str:
        return f"CASE WHEN len({key}) >= {self.width} THEN {key} ELSE lpad({key}, {self.width}, '0') END"


def column(key: Column, parts: tuple) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.column(key) for p in parts))


def sql(key: str, parts: tuple) -> str:
    return " || ".join(quoted(p) if isinstance(p, str) else f"({p.sql(key)})" for p in parts)


TRADITIONAL = tuple(L.TRADITIONAL[i : i + 4] for i in range(0, len(L.TRADITIONAL), 4))
BOILERPLATE = ("转发微博 ", "转发 微博", "收起d", "收起", "查看图片", "查看 全文", "查看视频", "查看详情", "O 网页 链接", "0网页链接", "我分享了", "我 分享 了", "（分享自 @网易新闻）", "（ 分享 自某处）", "(分享自微博)", "")
ADS = (*L.AD_KEYWORDS, "", "", "", "", "", "", "", "")
FACES = (*L.EMOJI_WEIGHT, "", "", "", "🚀", "☔")

POST = (
    Pick("b1", BOILERPLATE), "#", Pick("topic", ("订单", "突发", "某明星辟谣", "新品 上市")), Key(), "# @", Pick("user", ("店铺_1", "娱乐-小编", "a_b-c", "用户")), Pick("p1", ("，", "！！", "!!!?", "。。。", "  ", "、、，")),
    Pick("trad", TRADITIONAL), Pick("html", ("&lt;b&gt;粗体&lt;/b&gt;", "<p class=\"x\">段落</p>", "a &amp;&amp; b", "&quot;引用&quot;", "&#39;单&#39;", "&nbsp;空&nbsp;", "&amp;lt;", "1 < 2", "&apos;&#x27;")),
    Pick("ad1", ADS), Pick("ad2", ADS), Pick("p2", ("，", "~~", "【】", "※★", "\t\n", "§¶")), Pick("face", FACES), Pick("ad3", ADS),
    Pick("word", L.POSITIVE), Pick("url", (" https://t.cn/A123 ", " http://a-b.com/x?y=1 end", "HTTPS://X.CN/abc，", "", "http://例子.cn/路径。后面")), Pick("b2", BOILERPLATE), Pick("end", ("的的的", "价格12元", " ok ok OK", "12 34", "好", "")),
)

PEOPLE = ("张伟", "李小燕", "王芳")
PLACES = ("上海", "北京市", "广东省", "海南")
ORGANISATIONS = ("华为公司", "某公司", "北京市公安局", "网信办", "东方航空")
TIMES = ("2026年6月12日", "2026-06-12 10:30", "6月12日", "12时30分", "09:45", "8：05：09", "2025/11/3", "25年3月", "2024 年 1 月", "", "", *L.WEEKDAYS, *L.RELATIVE_TIMES)
MONEY = ("3000万元", "12.5亿元", "5元", "5.5%", "20 块", "100美元", "7英镑", "88.8 %", "999日元", "60万", "3法郎", "", "")
TRIGGERS = tuple(events.owners())
CAUSES = ("因电池故障", "由于管理不善", "为了安全", "因为", "因", "因质量，", "经，查。", "", "")

NEWS = (
    Pick("time", TIMES), Pick("s1", ("，", "", " ")), Pick("who", (*ORGANISATIONS, *PEOPLE, "", "")), Pick("where", ("在上海", "在北京市", "于广东省", "从海南", "", "")), Pick("t1", TRIGGERS), Pick("product", tuple(f"{a}{b}" for b in L.PRODUCT_SUFFIXES for a in ("新款", "了"))),
    Pick("s2", ("，", "。", "、")), Pick("who2", (*PEOPLE, *ORGANISATIONS, "", "")), Pick("cause", CAUSES), Pick("t2", TRIGGERS), Pick("s3", ("，", "；", "")), Pick("m1", ("售价", "涉案", "涨幅", "")), Pick("money", MONEY), Pick("t3", (*TRIGGERS, *[""] * len(TRIGGERS))),
    Pick("t4", ("集体", "架构", "打", "战略", "达成", "", "", "")), Pick("t5", TRIGGERS), Pick("gap", ("", "，其余情况仍在进一步了解之中，相关人士没有给出更多的说法，我们会持续关注后来的事态以及各方的反应和看法，", "。")), Pick("time2", TIMES), Pick("t6", TRIGGERS), Pick("tail", ("。", "，损失惨重。", " ", "")),
)

DEGREES = (*L.DEGREE, *L.NEGATION, *[""] * 20)
FEELINGS = (*L.POSITIVE, *L.NEGATIVE)
ASPECT_WORDS = tuple(w for words in L.ASPECTS.values() for w in words)
EMOTION_WORDS = tuple(w for words in L.EMOTIONS.values() for w in words)

REVIEW = (
    Pick("a1", ASPECT_WORDS), Pick("d1", DEGREES), Pick("f1", FEELINGS), Pick("s1", ("，", "。", "？", "；", "！", "\n")), Pick("turn", ("但是", "但", "而且", "", "")), Pick("a2", ASPECT_WORDS), Pick("d2", DEGREES), Pick("f2", FEELINGS),
    Pick("faces", (*FACES, "😡😡😡", "😀👍")), Pick("s2", ("，", ",", "", "。")), Pick("noise", ("@某人 ", "#话题#", "<i>x</i>", "http://t.cn/x ", "abc 12", "", "")), Pick("e1", (*EMOTION_WORDS, *[""] * 20)), Pick("d3", DEGREES), Pick("f3", (*FEELINGS, *[""] * 100)), Pick("s3", ("！", "", "。")),
)

CONTACT = (
    Pick("c1", ("客户", "张先生", "😀用户")), Pick("l1", ("的手机是", "来电", "手机")), Pick("phone", ("138", "199", "173", "120")), Key(8), "，", Pick("l2", ("另一个号 173-4580-1230", "又139 1234 5678", "电话：幺三八零零零零一二三四", "手机号是幺三九两两三三四四五五", "号码 一三八零零零零一二三", "没有别的")), Pick("s1", ("；", "，", "。")),
    Pick("l3", ("邮箱 test@example.com", "信箱a.b+c@x-y.org", "邮箱 a@b", "user_1%x@mail.example.cn", "")), Pick("s2", ("，", "；")), Pick("l4", ("身份证110101199001011234", "身份证 11010119900101123X", "证件110101199001011234X", "证件110101199001011234x", "身份证号是幺幺零一零一一九九零零一零一一二三X", "身份证号是一二三四", "")), "。",
    Pick("l5", ("卡号6222021234567890123", "卡622202123456", "编号62220212345678901234", "编号022202123456789", "卡 6222021234567890", "今天天气很好", "")), Pick("end", ("。", " 完", "")),
)

SPEECH = (
    Pick("w1", tuple(L.HOMOPHONES)), Pick("b", ("开会", "等一下", "这个文件", "明天联系你", "收到", "录音")), Pick("w2", tuple(L.HOMOPHONES)), Pick("p1", ("，", "。。。。", "！", "\"", "（注）", " ", "、、、", "")), Pick("w3", tuple(L.HOMOPHONES)), Pick("hint", (*L.PII_HINTS, *L.ANOMALY_HINTS, *[""] * 14)), Pick("say", ("你好", "再见", "ok", "3 点")),
    Pick("private", ("号码是13812345678", "邮箱 x1@example.com", "卡号622202123456", "", "", "", "", "")), Pick("p2", ("。", "", "？", "…", "】")),
)
