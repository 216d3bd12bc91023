"""Segmentation and names: all paths, all label sequences, and held-out rows."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexaudit.functions import entities, segment, tagging
from lexaudit.operators import dictionary, reduction, tagger
from lexaudit.plans import words


def ways(text):
    """Every way to cut a text."""
    if not text:
        yield []
    for i in range(1, len(text) + 1):
        for rest in ways(text[i:]):
            yield [text[:i], *rest]


def test_best_path_against_all_paths():
    r = random.Random(1)
    counts = {"".join(r.choice("甲乙丙丁") for _ in range(r.randint(1, 4))): r.randint(1, 50) for _ in range(60)}
    d = segment.Dictionary(counts, sum(counts.values()))
    for _ in range(120):
        text = "".join(r.choice("甲乙丙丁戊") for _ in range(r.randint(1, 8)))
        value = lambda path: sum(d.weights.get(w, d.unknown if len(w) == 1 else -(10**12)) for w in path)
        assert value(d.best_path(text)) == max(map(value, ways(text)))
        assert "".join(d.best_path(text)) == text


def test_shapes_against_all_states(spark):
    rows = spark.createDataFrame([(["甲乙", "丙", "丁甲乙"],), (["丙丙", "", "甲"],), ([],), (None,), (["乙", None, "甲乙丙丁"],)], "words array<string>")
    shapes = dictionary.shapes(rows)
    assert math.isclose(sum(math.exp(v) for (p, _), v in shapes.follow.items() if p == "B"), 1)
    assert math.isclose(math.exp(shapes.follow["B", "M"]), (2 + 1) / (4 + 2))  # two of the four words of several characters go on
    show = lambda s, c: shapes.shown.get((s, c), shapes.unseen[s])
    for run in ("甲", "甲乙", "乙丙丁", "丁丁甲乙", "戊甲乙丙丁"):
        best, found = -math.inf, None
        for states in itertools.product("BMES", repeat=len(run)):
            if states[0] in "BS" and states[-1] in "ES" and all(b in segment.NEXT[a] for a, b in zip(states, states[1:], strict=False)):
                p = shapes.first[states[0]] + sum(show(s, c) for s, c in zip(states, run, strict=True)) + sum(shapes.follow[x] for x in zip(states, states[1:], strict=False))
                if p > best:
                    best, found = p, states
        cut, word = [], ""
        for c, s in zip(run, found, strict=True):
            word += c
            if s in "ES":
                cut, word = [*cut, word], ""
        assert shapes.cut(run) == cut
    assert dictionary.shapes(rows.where("false")) is None


def test_segment_of_odd_texts(spark):
    d = segment.Dictionary({"北京": 5, "大学": 4, "北京大学": 3, "生": 2}, 20)
    rows = spark.createDataFrame([("北京大学生 abc12，好_x\n",), ("",), (None,), ("语" * 5000,)], "text string").select(segment.segment(F.col("text"), d).alias("w")).collect()
    assert rows[0].w == ["北京大学", "生", " ", "abc12", "，", "好", "_", "x", "\n"] and rows[1].w == rows[2].w == [] and rows[3].w == ["语"] * 5000
    empty = dictionary.dictionary(spark.createDataFrame([], "words array<string>"))
    assert empty.cut("北京") == ["北", "京"]
    few = dictionary.dictionary(spark.createDataFrame([(["a", "b", "b", "c"],)], "words array<string>"), most=2)
    assert few.counts == {"b": 2, "a": 1} and few.total == 4


def test_unknown_words_are_found(spark, data):
    """Held-out rows: words by the dictionary alone, and with the model of words."""
    truth = {r.o_orderkey: r.w for r in words.sentences(spark, data, False).select("o_orderkey", words.tagged.words(F.col("key")).alias("w")).collect()}

    def f1(rows):
        right = said = meant = 0
        for r in rows:
            cut = lambda ws: set(zip(itertools.accumulate(map(len, ws), initial=0), ws, strict=False))
            a, b = cut(r.words.split(" ")), cut(truth[r.o_orderkey])
            right, said, meant = right + len(a & b), said + len(a), meant + len(b)
        return 2 * right / (said + meant)

    plain, more = f1(words.segment_words(spark, data).collect()), f1(words.segment_unknown(spark, data).collect())
    print("segmentation", plain, more)
    assert more > plain and more > 0.9


@pytest.fixture(scope="module")
def model(spark, data):
    return words.trained(spark, data)


def test_decode_against_all_sequences():
    r = np.random.default_rng(2)
    features, follow = r.normal(0, 1, (1 << tagging.BITS, 5)), r.normal(0, 1, (5, 5))
    texts = ["", "甲", "甲乙", "丙丁戊", "", "己庚辛壬", "甲甲甲甲甲"]
    buckets, start = tagging.windows(texts)
    got = tagging.decode(buckets, start, features, follow)
    may = follow + tagging.allowed(5)
    for d, text in enumerate(texts):
        shown = features[buckets[start[d] : start[d + 1]]].sum(axis=1)
        score = lambda s: sum(shown[i, x] for i, x in enumerate(s)) + sum(may[a, b] for a, b in zip(s, s[1:], strict=False)) + (-np.inf if s and s[0] in (2, 4) else 0)  # noqa: B023, E731
        best = max(itertools.product(range(5), repeat=len(text)), key=score)
        assert tuple(got[start[d] : start[d + 1]]) == best


def test_windows_do_not_see_other_texts():
    one, _ = tagging.windows(["甲乙"])
    many, start = tagging.windows(["丙丙丙", "甲乙", "", "丁"])
    assert (many[start[1] : start[2]] == one).all() and len(tagging.windows([])[0]) == 0


def test_labels_of_marked_names():
    x = lambda kind, a, b: {"kind": kind, "start": a, "stop": b}
    labels = tagger.marked(["甲乙丙丁", "", "甲乙"], [[x("人名", 0, 2), x("人名", 1, 3), x("地名", 3, 4), x("别的", 2, 3)], None, [x("地名", 0, 5)]], ("人名", "地名"))
    assert labels.tolist() == [1, 2, 0, 3, 0, 0]
    assert tagging.spans_of(labels, np.array([0, 4, 4, 6])) == [(0, 0, 0, 2), (0, 1, 3, 4)]
    assert tagging.spans_of(np.array([1, 1, 2, 3, 4, 0]), np.array([0, 1, 6])) == [(0, 0, 0, 1), (1, 0, 0, 2), (1, 1, 2, 4)]


def test_names_held_out(spark, data, model):
    """Names of rows that were not learnt from; most of them stand in no row that was."""
    rows = words.marked(spark, data, by_hand=False).withColumn("found", tagging.names(F.col("text"), model)).collect()
    seen = {n.text for r in words.marked(spark, data).select("names").collect() for n in r.names}
    right = said = meant = new = 0
    for r in rows:
        truth = {(n.kind, n.start, n.stop) for n in r.names}
        found = {(e.type, e.start, e.end) for e in r.found}
        assert all(r.text[e.start : e.end] == e.text for e in r.found)
        right, said, meant = right + len(truth & found), said + len(found), meant + len(truth)
        new += sum(n.text not in seen for n in r.names)
    print("names", 2 * right / (said + meant), "new", new / meant)
    assert 2 * right / (said + meant) > 0.95 and new > 0.3 * meant


def test_names_of_odd_texts(spark, model):
    rows = spark.createDataFrame([(None,), ("",), ("abc",), ("昨天王建国在东州市参观华泰公司。" * 300,)], "text string").select(tagging.names(F.col("text"), model).alias("n"), entities.recognise(F.col("text"), extra=tagging.names(F.col("text"), model)).alias("e")).collect()
    assert rows[0].n == rows[1].n == rows[2].n == [] and len(rows[3].n) == 900
    assert [(e.text, e.type) for e in rows[3].e] == [("昨天", "时间"), ("王建国", "人名"), ("东州市", "地名"), ("华泰公司", "机构名")]
    none = tagger.train(spark.createDataFrame([], "text string, names array<struct<kind:string,start:int,stop:int>>"), ("人名",))
    assert not none.features.any()


def test_sums_of_vectors(spark):
    def leave(batches):
        for batch in batches:
            pass
        yield reduction.pieces(np.arange(40_000, dtype=float))

    assert np.allclose(reduction.summed(spark.range(100, numPartitions=70).mapInArrow(leave, reduction.SCHEMA)), 70.0 * np.arange(40_000))
    assert reduction.summed(spark.createDataFrame([], reduction.SCHEMA)) is None
