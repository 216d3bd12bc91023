"""Row-local operators against values worked out by hand."""

import html

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexaudit.functions import cleaning, entities, events, pii, sentiment, spans, tokens, transcripts


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize("text,want", [
    ("see http://a-b.com/x?y=1 end", "see -b.com/x?y1 end"), ("#突发#！！某地暴雨太大了！！！详情见 http://xxx.com", "突发！某地暴雨太大了！详情见"), (None, ""), ("  \n ", ""),
    ("&lt;b&gt;粗体&lt;/b&gt;", "粗体"), ("转发微博 你好 查看图片", "你好"), ("@用户_名-a 你好😀", "你好"),
])
def test_clean(spark, text, want):
    assert one(spark, text, cleaning.clean) == want


def test_unescape(spark):
    assert one(spark, "&amp;lt;x&gt;", cleaning.unescape) == "&lt;x>"
    rare = "&#20320;&eacute;&amp;amp;"
    assert one(spark, rare, cleaning.unescape_exact) == html.unescape(rare)


def test_ads(spark):
    assert one(spark, "限时优惠！添加微信xxxxx免费领取大礼包，点击链接购买", cleaning.clean_post) == ""
    assert one(spark, "加V 扫码", cleaning.is_ad) is False


def test_tokens(spark):
    assert one(spark, "今天天气真好", lambda t: tokens.lexicon_tokens(t, {"今天", "天气", "真好"})) == ["今天", "天气", "真好"]
    assert one(spark, "a b b c b", lambda t: tokens.drop_repeats(F.split(t, " "))) == ["a", "b", "c", "b"]
    assert one(spark, "好 a bb 12 的 x1", lambda t: tokens.keep_content(F.split(t, " "), ("的",))) == ["好", "bb", "x1"]
    assert one(spark, "a!b?c.d，e", tokens.split_clauses) == ["a!b", "c.d", "e"]
    assert one(spark, "今天很好。abc def ghi。短。明天再见吧", tokens.split_sentences) == ["今天很好", "明天再见吧"]


@pytest.mark.parametrize("text,want", [
    ("我的号码是13812345678，请联系我。", [("mobile_phone", "13812345678")]), ("身份证号 110101199001011234 用于验证。", [("id_card", "110101199001011234")]),
    ("银行卡号 6222021234567890123 绑定成功。", [("bank_card", "6222021234567890123")]), ("手机13812345678，邮箱 a@b.com，身份证 110101199001011234。", [("mobile_phone", "13812345678"), ("email", "a@b.com"), ("id_card", "110101199001011234")]),
    ("今天天气很好，适合出门散步。", []), ("173-4580-1230", [("mobile_phone", "173-4580-1230")]), ("11010119900101123X", []), ("110101199001011234X", [("id_card_x", "110101199001011234X")]),
    ("622202123456", [("bank_card", "622202123456")]), ("62220212345678901234", []), ("电话：幺三八零零零零一二三四", [("mobile_phone", "13800001234")]), (None, []),
])
def test_pii(spark, text, want):
    assert [(r.category, r.original) for r in one(spark, text, pii.records)] == want


def test_redaction(spark):
    assert one(spark, "😀电13812345678，a@b.com完", pii.redact) == "😀电[PII-REDACTED]，[PII-REDACTED]完"
    assert one(spark, "13812345678 a@b.com", lambda t: pii.redact(t, ["email", "nonsense"])) == "13812345678 [PII-REDACTED]"
    assert one(spark, "11010119900101123X", lambda t: pii.redact(t, None, (pii.STRICT_ID,))) == "[PII-REDACTED]"


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab1😀3 8@.com，", max_size=30), min_size=1, max_size=20))
def test_spans_lie_where_they_say(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", spans.find_spans(F.col("t"), "[0-9]+|a+", "x").alias("s"), pii.redact(F.col("t")).alias("r"))
    again = rows.withColumn("rr", pii.redact(F.col("r"))).collect()
    for r in again:
        assert all(r.t[s.start : s.end] == s.text for s in r.s) and r.r == r.rr
        assert all(a.end <= b.start for a, b in zip(r.s, r.s[1:], strict=False))


@pytest.mark.parametrize("text,want", [("2026年6月12日", ["2026年6月"]), ("2026-06-12 10:30", ["2026-06-12 10:30"]), ("6月12日", []), ("星期一和今天", ["星期一", "今天"])])
def test_times(spark, text, want):
    found = [e.text for e in one(spark, text, entities.times)]
    assert found == want


@pytest.mark.parametrize("text,want", [("3000万元", ["3000万"]), ("12.5亿元", ["12.5亿"]), ("5元", ["5元"]), ("涨5.5%", ["5.5%"])])
def test_money(spark, text, want):
    assert [e.text for e in one(spark, text, entities.money)] == want


def test_entities_are_unique_and_absorbed_by_the_longest(spark):
    found = one(spark, "上海新款手机在上海，上海", lambda t: entities.recognise(t, places=("上海",)))
    assert [(e.text, e.type, e.start) for e in found] == [("海新款手机", "产品名", 1)]  # the name's first place is absorbed
    text = "华为在今天，今天"
    assert [(e.text, e.start) for e in one(spark, text, lambda t: entities.recognise(t, organisations=("华为",)))] == [("华为", 0), ("今天", 3)]
    assert one(spark, text, lambda t: entities.show(entities.recognise(t), t)) == "  [时间] 今天  ...华为在【今天】，今天..."
    assert one(spark, "", lambda t: entities.show(entities.recognise(t), t)) == "(无实体)"


def test_events(spark):
    text = "2026年6月，某公司在上海发布新款手机。某品牌因产品质量问题发布召回公告。"
    found = one(spark, text, lambda t: events.extract(t, entities.recognise(t, places=("上海",), organisations=("某公司",))))
    assert [(e.type, e.trigger) for e in found] == [("政策发布", "发布"), ("政策发布", "发布"), ("产品召回", "召回")]
    assert found[0].slots["时间"] == "2026年6月" and found[0].slots["主体"] == "某公司"
    assert found[2].slots["原因"].startswith("产品质量问题")
    assert one(spark, "集体维权", lambda t: F.transform(events.triggers(t), lambda s: s["text"])) == ["集体维权"]
    assert events.owners()["火灾"] == "自然灾害"


def test_sentiment(spark):
    good = one(spark, "今天天气真好，心情特别愉快！", sentiment.analyse)
    assert good.sentiment == "正面" and good.score > 0.1 and good.positive_words == ["真好", "愉快"]
    turned = one(spark, "这个产品功能不错，但是价格太离谱了", sentiment.analyse)
    a, b = turned.clause_scores
    assert turned.score == pytest.approx((a + 2 * b) / 3, abs=1e-3) and turned.negative_words == ["离谱"]
    angry = one(spark, "😡😡😡服务质量太差了，再也不会来了！", sentiment.analyse)
    assert angry.sentiment == "负面" and angry.score < -0.3
    blank = one(spark, None, sentiment.analyse)
    assert (blank.sentiment, blank.score, blank.positive_words, blank.num_clauses) == ("中性", 0.0, [], 0)
    assert one(spark, "不好", lambda t: sentiment.token_weights(F.array(F.lit("不"), F.lit("好")))) == [0.0, -1.0]
    found = one(spark, "价格太贵了，服务很棒", sentiment.aspects)
    assert {a.aspect: a.sentiment for a in found}["价格"] in ("负面", "中性", "正面") and all(len(a.evidence) <= 50 for a in found)


@pytest.mark.parametrize("text,want", [("我材在开会 等一下", "我才再开会 等一下。"), ("这个文件要做的很好", "这么个文件要作得很好。"), ("明天在联系你", "明天再联系你。"), ("", "")])
def test_corrections(spark, text, want):
    assert one(spark, text, transcripts.correct) == want


def test_gate_and_summary(spark):
    kept = one(spark, "材料", lambda t: transcripts.corrected(t, F.lit(0.95), 0.75))
    assert kept.text == "材料" and kept.corrections == []
    changed = one(spark, "材料", lambda t: transcripts.corrected(t, F.lit(0.6), 0.75))
    assert changed.text == "才料。" and len(changed.corrections) == 1
    assert one(spark, "手机噪声", transcripts.security_summary) == "检测到敏感信息暴露风险；音频存在异常特征"


def test_every_entity_is_decoded_in_the_jvm(spark):
    """All named forms, alone and in a sentence; numbers at every limit."""
    import html.entities

    texts = [f"a &{n} b" for n in html.entities.html5] + [f"&{n}x;" for n in list(html.entities.html5)[::7]]
    numbers = [*range(0, 0x120), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDD0, 0xFDEF, 0xFFFE, 0xFFFF, 0x10000, 0x1FFFE, 0x10FFFD, 0x10FFFF, 0x110000, 10**7, 10**8, 10**25]
    texts += [f"&#{n};" for n in numbers] + [f"x&#x{n:X}y" for n in numbers] + [f"&#000{n}z" for n in numbers]
    texts += ["&#;", "&#x;", "&", "&&amp;&", "&amp;amp;", "no entity", "", "&lt&gt", "&ampere;"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", cleaning.unescape_exact(F.col("t")).alias("t"))
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
    assert [r.t for r in rows.orderBy("i").collect()] == [html.unescape(t) for t in texts]


def test_phrases_go_before_characters(spark, tmp_path):
    from lexaudit.sources import posts

    (tmp_path / "p.txt").write_text("乾坤\t乾坤\n頭髮\t头发 頭发\n#x\ty\nbad line\n\n頭髮油\t发油\n", encoding="utf-8")
    known = posts.read_phrases(spark, str(tmp_path / "p.txt"))
    assert known == {"乾坤": "乾坤", "頭髮": "头发", "頭髮油": "发油"}
    rows = spark.createDataFrame([(0, "乾乾坤頭髮頭髮油a"), (1, ""), (2, None)], "i int, t string")
    assert [r.t for r in rows.select("i", cleaning.simplify_phrases(F.col("t"), known, "乾頭", "干头").alias("t")).orderBy("i").collect()] == ["干乾坤头发发油a", "", None]
