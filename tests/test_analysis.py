"""Whole analyses: what every module finds is in the report, and kernels over many rows give what those over one do."""

from pyspark.sql import functions as F

from lexaudit.plans import analysis

TEXT = "某公司今天发布新款手机，价格太高，服务很差，非常失望。请致电13812345678。"


def test_every_module_changes_the_report(spark):
    df = spark.createDataFrame([(1, TEXT), (2, None)], "doc_id long, text string")
    o = analysis.Options(organisations=("某公司",), keyword_method="textrank")
    whole = analysis.post_report(analysis.analyse(df, analysis.MODULES, o))
    told = {r.doc_id: r.report for r in whole.collect()}
    assert "方面：价格 负面" in told[1] and "隐私：mobile_phone[30-41]" in told[1] and told[1].endswith("请致电[PII-REDACTED]。") and "失望" in told[1].split("负面词：")[1].split("\n")[0]
    assert "发布(" in told[1] and "主体=某公司" in told[1].split("事件：")[1] and "方面：\n" in told[2]
    assert "13812345678" not in told[1]
    for some in ({"aspects"}, {"pii"}, {"entities", "events"}):
        left = analysis.post_report(analysis.analyse(df, set(analysis.MODULES) - some, o)).where("doc_id = 1").first().report
        assert left != told[1], some


def test_reports_tell_trained_probabilities(spark):
    df = spark.createDataFrame([(1, "价", {"价": 0.75, "案": 0.25}), (2, None, None)], "doc_id long, label string, probabilities map<string,double>")
    assert {r.doc_id: r.report for r in analysis.post_report(df).collect()} == {1: "分类：价\n分类概率：0.75", 2: ""}


def test_many_graphs_are_ranked_together(monkeypatch):
    import random

    import numpy as np

    from lexaudit.operators import keywords

    r = random.Random(3)
    lists = [[r.choice("abcdefghijklmnop"[: 1 + i % 16]) for _ in range(r.randint(0, 60))] for i in range(300)] + [[], ["a"], ["a", "a"], ["a", "b"]]
    want = [keywords.rank_tokens(x, 3, 0.85, 100, 1e-4) for x in lists]
    for groups in ([lists], [[x] for x in lists], [[]]):
        got = [y for g in groups for y in keywords.rank_lists(g)]
        assert not got or all(a[0] == b[0] and np.array_equal(a[1], b[1]) for a, b in zip(want, got, strict=True))
    monkeypatch.setattr(keywords, "TOGETHER", 100)
    groups = list(keywords._together(lists))
    assert [x for g in groups for x in g] == lists and all(len(g) == 1 or sum(map(len, g)) <= 100 for g in groups)


def test_words_are_cut_as_by_their_pattern():
    import random
    import re

    from lexaudit.functions import kernels, tokens

    r = random.Random(6)
    for words in (tuple(sorted(tokens.sentiment_words())), ("a", "ab1", " x", "很不", "不好", "好满")):
        pattern = re.compile("|".join([*map(re.escape, sorted(words, key=lambda w: (-len(w), w))), "[A-Za-z0-9]+", "."]), re.DOTALL)
        for _ in range(500):
            text = "".join(r.choice(["很", "不", "好", "满", "意", "ab1", "C", "2", " ", "\n", "\x1c", "é", "，", "x", "😀", *words[:9]]) for _ in range(r.randint(0, 20)))
            assert kernels.lexicon(words).cut(text) == [t for t in pattern.findall(text) if t not in kernels.BLANKS]


def test_modules_share_a_pass_and_the_report_is_made_once(spark):
    rows = spark.createDataFrame([(1, TEXT), (2, None)], "doc_id long, text string")
    o = analysis.Options(people=("张伟",), organisations=("某公司",), keyword_method="textrank")
    analysed = analysis.analyse(rows, analysis.MODULES, o)
    both = analysed.join(analysis.analyse(rows, {"entities"}, o).select("doc_id", F.col("entities").alias("e")), "doc_id").collect()
    assert all(r.entities == r.e for r in both)
    plan = analysis.post_report(analysed)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("关键词：") == 1
