"""Training decodes many texts at once and moves weights as one after another does."""

import numpy as np

from lexaudit.functions import tagging
from lexaudit.operators import tagger


def one_by_one(texts, gold, features, follow, mean, steps):
    at = 0
    for text in texts:
        buckets, start = tagging.windows([text])
        truth, at = gold[at : at + len(text)], at + len(text)
        said = tagging.decode(buckets, start, features, follow)
        steps += 1
        if (said != truth).any():
            tagger._move(buckets, truth, said, features, follow, mean, steps)
    return steps


def test_texts_are_decoded_ahead(monkeypatch):
    texts = ["" if i == 7 else "在王小明说"[i % 2 :] + "东州市" * (i % 3) + "。" for i in range(700)]
    gold = tagger.marked(texts, [[{"kind": "人名", "start": t.find("王"), "stop": t.find("王") + 3}] if "王" in t else [] for t in texts], ("人名", "地名"))
    new = lambda: (np.zeros((1 << tagging.BITS, 5)), np.zeros((5, 5)), (np.zeros((1 << tagging.BITS, 5)), np.zeros((5, 5))))
    a, b, calls = new(), new(), []
    steps = one_by_one(texts, gold, *a, 0)
    real = tagger.decode
    monkeypatch.setattr(tagger, "decode", lambda *x: calls.append(1) or real(*x))
    assert tagger.learn(texts, gold, *b, 0) == steps == 700
    assert all(np.array_equal(x, y) for x, y in zip((a[0], a[1], *a[2]), (b[0], b[1], *b[2]), strict=True)) and a[0].any()
    assert 3 <= len(calls) < 100


def test_the_best_sequence_of_all():
    r = np.random.default_rng(4)
    texts = ["", "甲", "甲乙丙", "", "乙乙丁甲"]
    buckets, start = tagging.windows(texts)
    for features in (r.normal(size=(1 << tagging.BITS, 5)), r.integers(-1, 2, (1 << tagging.BITS, 5)).astype(float)):
        follow = r.integers(-1, 2, (5, 5)).astype(float)
        got, may = tagging.decode(buckets, start, features, follow), follow + tagging.allowed(5)
        shown = features[buckets].sum(axis=1)
        for lo, hi in zip(start[:-1], start[1:], strict=True):
            worth = {y: shown[range(lo, hi), y].sum() + may[y[:-1], y[1:]].sum() for y in (tuple(int(x) for x in np.unravel_index(i, (5,) * (hi - lo))) for i in range(5 ** (hi - lo))) if not y or y[0] in (0, 1, 3)} if hi > lo else {}
            assert not worth or np.isclose(worth[tuple(got[lo:hi].tolist())], max(worth.values()))


def test_names_are_found_in_the_pass_of_the_other_entities(spark):
    from pyspark.sql import functions as F

    from lexaudit.functions import entities
    from lexaudit.plans import words

    weights = np.random.default_rng(1).normal(size=(1 << tagging.BITS, 7)).astype(np.float32)
    model = tagging.Tagger(words.KINDS, weights, np.zeros((7, 7)))
    rows = spark.createDataFrame([("昨天王建国在东州市参观华泰公司，售价5元。" * i,) for i in range(4)] + [(None,)], "text string")
    text = F.col("text")
    got = rows.select(entities.recognise(text, more=tagging.finder(model)).alias("a"), entities.recognise(text, extra=tagging.names(text, model)).alias("b")).collect()
    assert all(r.a == r.b for r in got) and len(got[1].a) > 2 and got[4].a == []
