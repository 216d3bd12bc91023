"""Sentences whose words and names are known, made from the tables' keys: to train and to judge with.

Names are put together from characters by digests of the key, so that most names of any row stand in no
other; words come from lists. Spark and SQL make the same words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.entities import ORGANISATION, PERSON, PLACE
from .phrases import Pick
from .phrases import column as joined
from .phrases import sql as joined_sql


@dataclass(frozen=True)
class Word:
    """A word or nothing, and the kind of name that it is; '' for no name."""

    parts: tuple
    kind: str = ""


def _chars(text: str) -> tuple[str, ...]:
    return tuple(text)


def person(salt: str) -> Word:
    given = Pick(f"{salt}2", (*_chars("明丽强华敏静伟芳军洋勇艳杰娟涛超秀霞平刚"), "", "", "", ""))
    return Word((Pick(f"{salt}0", _chars("王李张刘陈杨赵黄周吴徐孙马朱胡郭")), Pick(f"{salt}1", _chars("建国文晓志海春小玉子雪思佳梓俊嘉宇晨雨欣")), given), PERSON)


def place(salt: str) -> Word:
    return Word((Pick(f"{salt}0", _chars("东南西北临长安宁江河清永新平高广青昌")), Pick(f"{salt}1", _chars("州阳山水川城原宁安泉溪湖岭门")), Pick(f"{salt}2", ("市", "县", "区", "镇", "省", "港"))), PLACE)


def organisation(salt: str) -> Word:
    return Word((Pick(f"{salt}0", _chars("华中天金联恒光信星云宏远达盛")), Pick(f"{salt}1", _chars("泰通利源创科瑞丰润德康辉腾")), Pick(f"{salt}2", ("公司", "集团", "银行", "大学", "医院", "研究院", "基金会"))), ORGANISATION)


def word(salt: str, *phrases: str) -> Word:
    return Word((Pick(salt, phrases),))


SENTENCE = (
    word("t", "昨天", "今天", "上周", "近日", "本月", ""), word("m0", "，", ""), word("r", "记者", "经理", "教授", "律师", "", ""), person("a"), word("p", "在", "于", "从", "前往", "来到"), place("b"), word("v", "参观", "访问", "考察", "起诉", "加入", "离开"), organisation("c"), word("m1", "，", "。"),
    word("u", "会见", "感谢", "批评", "采访", "遇到"), word("l", "了", "过", ""), person("d"), word("k", "和", "与", "、"), person("e"), word("m2", "，", "。", "；"),
    organisation("f"), word("w", "宣布", "表示", "认为", "承认", "发现"), word("n", "产品", "手机", "汽车", "价格", "服务", "项目", "工程"), word("x", "将", "已", "会", "不再", ""), word("y", "进入", "供应", "支持", "覆盖"), place("g"), word("o", "市场", "居民", "用户", "地区", ""), word("m3", "。", "！"),
)


def words(key: Column) -> Column:
    return F.filter(F.array(*(joined(key, w.parts) for w in SENTENCE)), lambda w: w != "")


def names(key: Column) -> Column:
    """(text, kind, start, stop) of each name, in order; offsets from 0."""
    said = [F.struct(joined(key, w.parts).alias("text"), F.lit(w.kind).alias("kind")) for w in SENTENCE]
    grown = F.aggregate(
        F.array(*said),
        F.struct(F.lit(0).alias("at"), F.lit(None).cast("array<struct<text:string,kind:string,start:int,stop:int>>").alias("found")),
        lambda s, w: F.struct(
            (s["at"] + F.length(w["text"])).alias("at"),
            F.when(w["kind"] == "", s["found"]).otherwise(F.concat(F.coalesce(s["found"], F.array().cast("array<struct<text:string,kind:string,start:int,stop:int>>")), F.array(F.struct(w["text"].alias("text"), w["kind"].alias("kind"), s["at"].alias("start"), (s["at"] + F.length(w["text"])).alias("stop"))))).alias("found"),
        ),
    )
    return grown["found"]


def words_sql(key: str) -> str:
    return f"list_filter([{', '.join(joined_sql(key, w.parts) for w in SENTENCE)}], lambda w: w <> '')"
