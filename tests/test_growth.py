"""What must not grow with the input: values computed again, shuffles of all words, Python objects of whole batches."""

import html
import html.entities
import random
import re

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lexaudit.functions import cleaning, events, kernels
from lexaudit.operators import classify, duplicates, gibbs, keywords, summaries
from lexaudit.plans import analysis, catalog, chinese

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_opened_arrays_are_computed_once(spark):
    for query in (chinese.entity_type_counts, chinese.event_slots, chinese.event_triggers, chinese.chinese_tokens, chinese.trace_steps):
        assert plan(query(spark, SF)).count("ArrowEvalPython") == 1, query.__name__


def test_words_are_counted_in_their_rows(spark):
    docs = spark.createDataFrame([(1, ["b", "a", None, "b"]), (2, []), (3, None), (4, ["c"])], "doc_id long, tokens array<string>")
    counts = keywords.term_counts(docs)
    assert "Exchange" not in physical(counts)
    assert sorted(tuple(r) for r in counts.collect()) == [(1, "a", 1, 1, 4), (1, "b", 2, 0, 4), (4, "c", 1, 0, 1)]
    assert "Exchange hashpartitioning" not in physical(classify.count_vectors(docs, classify.fit_vocabulary(docs))).split("BroadcastExchange")[0]


def test_batches_are_worked_in_slices():
    seen = []
    texts = pa.array(["x"] * (kernels.SLICE + 1))
    out = kernels._sliced(lambda some: seen.append(len(some)) or some, texts)
    assert seen == [kernels.SLICE, 1] and out.equals(texts)
    assert kernels.span_lists([[], [("a", "T", 0, 1, 2)], []]).to_pylist() == [[], [{"text": "a", "type": "T", "start": 0, "end": 1, "rank": 2}], []]
    assert summaries.SLICE <= 1024 and keywords.SLICE <= 1024


def test_time_features_hold_no_whole_wave(spark):
    assert "array_repeat" not in plan(catalog.wave_time_features(spark, SF))


def test_analyses_by_row_join_nothing(spark):
    posts = spark.createDataFrame([(1, "华为公司发布了新款手机，用户都说很好。价格上涨。"), (2, None)], "doc_id long, text string")
    analysed = analysis.analyse(posts, analysis.MODULES, analysis.Options(keyword_method="textrank"))
    assert "Join" not in plan(analysed)
    first, second = analysed.orderBy("doc_id").collect()
    assert first.keywords[0].rank == 1 and first.summary and second.keywords is None and second.summary == []


def test_greedy_forms_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "BLOCK", 16)
    monkeypatch.setattr(duplicates, "similar_signatures", None)  # it was what the driver's memory went to
    r = random.Random(5)
    texts = ["".join(r.sample("abcdefghijkl", r.randint(1, 12))) for _ in range(150)] + ["", "a"]
    kept = []
    for i, t in enumerate(map(set, texts)):
        if t and all(len(t & k) / len(t | k) < 0.7 for _, k in kept):
            kept.append((i, t))
    got = duplicates.greedy(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 0.7)
    assert sorted(x.doc_id for x in got.collect()) == [i for i, _ in kept] and len(kept) > 32


def test_blocks_of_topics_are_read_singly_and_words_move_packed(spark):
    held = gibbs._kept(spark.range(0, 40, 1, 1).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(32768)), lambda i: F.md5(F.concat_ws("-", "id", i))), "").cast("binary").alias("at")))  # 1 MB each
    assert max(pq.ParquetFile(f.removeprefix("file://")).metadata.row_group(0).num_rows for f in held.inputFiles()) <= 20
    docs = spark.createDataFrame([(i, [f"w{j % 997}" for j in range(i, i + 200)]) for i in range(100)], "doc_id long, tokens array<string>").coalesce(1)
    model = gibbs.GibbsModel(docs, 3, sweeps=2, inner=1, block_tokens=10_000)
    parts = gibbs._parts(model.blocks, 3, model._bits(model.blocks))
    assert model.blocks.count() == 2 and parts.count() <= 4 and model.counts.count() == 297 and sum(sum(r.total) for r in model.counts.collect()) == 19_998


def test_entities_are_found_by_a_trie_and_looked_up_by_digest(spark):
    names, buckets, _ = cleaning._entities()
    assert max(b.count("\x01") for b in buckets.split("\x03")) <= 6
    assert all(re.match(names, n).end() == len(n) for n in html.entities.html5)
    texts = ["&" * 50, "a&b&c", "&amp&&#65;&", "x" * 9000 + "&notit;\n" + "é" * 3, "&ACY", "&Acy;&#38;lt;", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", cleaning.unescape_exact(F.col("t")).alias("t"))
    assert plan(rows).count("#[0-9]+;?|") == 1  # split() compiles its pattern for every row
    assert [r.t for r in rows.orderBy("i").collect()] == [t and html.unescape(t) for t in texts]


def test_events_are_put_together_by_columns():
    found = [[], [("T", "w", 1, 2, [("a", "b"), ("c", "")]), ("U", "v", 3, 4, [])], []]
    assert events._array(found).type == pa.list_(events.EVENT)
    assert events._array(found).to_pylist()[1][0] == {"type": "T", "trigger": "w", "start": 1, "end": 2, "slots": [("a", "b"), ("c", "")]}
    assert events._array([[], []]).to_pylist() == [[], []]
