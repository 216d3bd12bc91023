"""Operators on frames, sources, plans and streams."""

import json
import math
import wave
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexaudit.functions import events
from lexaudit.functions import lexicons as L
from lexaudit.operators import classify, duplicates, keywords, signal, summaries, timeline, topics
from lexaudit.plans import analysis
from lexaudit.sources import media, posts
from lexaudit.streaming import live


@pytest.fixture(scope="module")
def small(spark):
    rows = [(1, ["a", "b", "a", "c"]), (2, ["b", "b"]), (3, []), (4, ["c", "d", "a"])]
    return spark.createDataFrame(rows, "doc_id long, tokens array<string>")


def test_idf_and_scores(small):
    idf = {r.word: r.idf for r in keywords.fit_idf(small).collect()}
    assert idf == {w: pytest.approx(math.log(4 / (n + 1)) + 1) for w, n in (("a", 2), ("b", 2), ("c", 2), ("d", 1))}
    top = [(r.doc_id, r.word) for r in keywords.tfidf(small, 1).orderBy("doc_id").collect()]
    assert top == [(1, "a"), (2, "b"), (4, "d")]
    assert {r.word for r in keywords.fit_idf(small, 2).collect()} == {"a", "b"}


def test_graph_ranking_matches_the_edges(small):
    tokens = "x y z x w y y v x".split()
    words, score = keywords.rank_tokens(tokens, 2, 0.85, 200, 1e-12)
    n, w = len(words), np.zeros((len(words), len(words)))
    for i, a in enumerate(tokens):
        for b in tokens[i + 1 : i + 3]:
            if a != b:
                w[words.index(a), words.index(b)] += 1
                w[words.index(b), words.index(a)] += 1
    want = np.linalg.solve(np.eye(n) - 0.85 * (w / w.sum(axis=1, keepdims=True)).T, np.full(n, 0.15))
    assert score == pytest.approx(want, abs=1e-6)
    assert keywords.rank_tokens(["q", "q"], 3, 0.85, 10, 1e-4)[1].tolist() == [1.0]
    edges = keywords.cooccurrence(small, 3).where("doc_id = 1").collect()
    assert {(r.src, r.dst): r.weight for r in edges}[("a", "c")] == 2
    assert keywords.textrank(small, 5).where("doc_id = 3").count() == 0
    with pytest.raises(ValueError):
        keywords.keywords(small, "other")


def test_summaries(spark):
    tokens = [["a", "b", "c", "d", "e"], ["a", "b", "c", "d", "e"], ["x", "y"], ["a", "f", "g", "h", "i", "j"], ["k", "l", "m", "n", "o"]]
    chosen = summaries.choose_by_tfidf(tokens, 2)
    assert len(chosen) == 2 and chosen == sorted(chosen) and not {0, 1} <= set(chosen)
    assert summaries.choose_by_rank(tokens, 5) == [0, 1, 2, 3, 4]
    assert not {0, 1} <= set(summaries.choose_by_rank(tokens, 2))
    df = spark.createDataFrame([(1, ["s0", "s1"], [["a"], ["b"]]), (2, [], [])], "doc_id long, sentences array<string>, sentence_tokens array<array<string>>")
    assert {r.doc_id: r.summary for r in summaries.as_text(summaries.summarise(df)).collect()} == {1: "s0。s1。", 2: "。"}


def test_bayes_and_report(spark):
    rows = [(1, ["a", "a", "b"], "x"), (2, ["b", "c"], "y"), (3, ["a"], "x"), (4, ["c", "c"], "y")]
    df = spark.createDataFrame(rows, "doc_id long, tokens array<string>, label string")
    vocabulary = classify.fit_vocabulary(df)
    priors, conditionals = classify.fit_bayes(df, vocabulary)
    assert {(r.label, r.word): r.log_prob for r in conditionals.collect()}[("x", "c")] == pytest.approx(math.log(1 / 7))
    guessed = classify.predict(classify.bayes_scores(df, vocabulary, priors, conditionals)).withColumnRenamed("label", "predicted")
    pairs = df.select("doc_id", F.col("label").alias("truth")).join(guessed, "doc_id")
    assert {r.label: (r.precision, r.recall, r.support, r.accuracy) for r in classify.report(pairs).collect()} == {"x": (1, 1, 2, 1), "y": (1, 1, 2, 1)}
    assert sum(r.n for r in classify.confusion(pairs).collect()) == 4
    vectors = classify.tfidf_vectors(df, vocabulary, 4)
    model = classify.fit_logistic(vectors.select("doc_id", "idx", "value"), df.select("doc_id", "label"), 3, rate=1.0, epochs=30)
    best = classify.predict(classify.logistic_scores(vectors, df, model)).collect()
    assert {r.doc_id: r.label for r in best} == {1: "x", 2: "y", 3: "x", 4: "y"}
    assert {r.fold for r in classify.cross_validate(df, 2, 1).collect()} == {0, 1}
    labels = spark.createDataFrame([("ab",), ("b",), ("z",), (None,)], "t string").select(classify.rule_label(F.col("t"), {"A": ("a",), "B": ("b",)}).alias("l"))
    assert [r.l for r in labels.collect()] == ["A", "B", "其他", "其他"]


def test_topics(spark):
    rows = [(i, ["cat", "dog", "cat"] if i % 2 else ["sun", "moon", "sun"]) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    words, ids, theta, phi = topics.lda_exact(df, 2, sweeps=60, seed=3)
    assert phi.sum(axis=1) == pytest.approx([1, 1]) and theta.sum(axis=1) == pytest.approx(np.ones(12))
    assert len({int(theta[i].argmax()) for i in ids if i % 2}) == 1
    assert sum(t[3] for t in topics.describe_topics(words, theta, phi)) == pytest.approx(1, abs=1e-3)
    new = topics.lda_fold_in(spark.createDataFrame([(1, ["cat"] * 5), (2, ["none"])], "doc_id long, tokens array<string>"), words, phi).collect()
    assert new[1].theta == [0.5, 0.5] and max(new[0].theta) > 0.8
    assert {r.word: r.total for r in topics.topic_vocabulary(df).collect()} == {"cat": 12, "dog": 6, "sun": 12, "moon": 6}
    made = topics.text_vectors(df, ["cat", "moon"]).orderBy("doc_id").collect()
    assert made[1].v == pytest.approx([2 / 3, 0]) and made[0].v == pytest.approx([0, 1 / 3])
    v = spark.createDataFrame([(i, [1.0, 0.1 * i] if i < 5 else [0.1 * i, -1.0]) for i in range(10)] + [(10, [0.0, 0.0])], "id long, v array<double>")
    found, centres = topics.kmeans(v, np.array([[1.0, 0.0], [0.0, -1.0]]))
    got = {r.id: (r.cluster, r.distance) for r in found.collect()}
    assert got[0][0] == 0 and got[9][0] == 1 and got[10] == (0, 1.0)


def test_lda_uses_every_document_and_word(spark):
    rows = [(i, [f"w{i}"] * 1000) for i in range(14)] + [(14, ["once"])]
    theta, described = topics.lda_large(spark.createDataFrame(rows, "doc_id long, tokens array<string>").repartition(2), 2)
    found = described.collect()
    assert theta.count() == 15 and all(set(r.words) == {f"w{i}" for i in range(14)} for r in found)
    share = {w: max(s / max(r.scores) for r in found for v, s in zip(r.words, r.scores, strict=True) if v == w) for w in found[0].words}
    assert min(share.values()) > 0.05  # a document that is never drawn leaves its word thousands of times behind


def test_waves_are_whole(spark, tmp_path):
    from lexaudit.plans import catalog

    events = spark.range(151).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts", "if(id < 150, 1L, 2L) AS user_id", "CAST(id * 37 % 101 AS DOUBLE) AS value")
    events.write.parquet(f"{tmp_path}/events.parquet")
    assert {r.media_id: len(r.samples) for r in catalog.waves(spark, str(tmp_path)).collect()} == {"1": 150 * 120, "2": 120}
    got = {(r.media_id, r.feature): r.frames for r in catalog.QUERIES["wave_features"](spark, str(tmp_path)).collect()}
    spectra = (150 * 120 - 1024) // 512 + 1
    short = -(-(150 * 120 - 256) // 128)
    # a wave shorter than a spectrum is one frame of it; one shorter than a frame has no other features
    assert got == {("1", "zcr"): short, ("1", "rms_energy"): short, ("1", "spectral_centroid"): spectra, ("1", "spectral_entropy"): spectra, ("2", "spectral_centroid"): 1, ("2", "spectral_entropy"): 1}
    assert catalog.QUERIES["wave_anomalies"](spark, str(tmp_path)).where("media_id = '2'").count() == 0


def test_duplicates(spark):
    texts = ["abcdefgh", "abcdefgi", "hgfedcba", "abcdefij", "zzz", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r.doc_id for r in duplicates.greedy(df, 0.7).collect())
    want = []
    for i, t in enumerate(texts):
        if t and not any(len(set(t) & set(texts[j])) / len(set(t) | set(texts[j])) >= 0.7 for j in want):
            want.append(i)
    assert kept == want


def test_timeline(spark):
    seg = spark.createDataFrame([("m", 0, 0.0, 2.0, "我材在开会 等一下", 0.72), ("m", 1, 2.0, 4.0, "电话13812345678", 0.68), ("m", 2, 4.0, 6.0, "明天在联系你", 0.7)], "media_id string, seg_idx int, start double, end double, text string, confidence double")
    odd = spark.createDataFrame([("m", 1.5, 3.5, L.NOISE_LABEL, 0.82), ("m", 3.95, 3.96, L.SYNTHETIC_LABEL, 0.2)], "media_id string, start double, end double, label string, confidence double")
    hits = {(r.seg_idx, r.label) for r in timeline.overlaps(seg, odd).collect()}
    assert hits == {(0, L.NOISE_LABEL), (1, L.NOISE_LABEL), (1, L.SYNTHETIC_LABEL), (2, L.SYNTHETIC_LABEL)}
    r = timeline.reports(seg, odd).first()
    assert r.display_text.split("\n") == ["[0.00s → 2.00s] [强噪声] 我材在开会 等一下", "[2.00s → 4.00s] [PII-REDACTED] [强噪声] 电话[PII-REDACTED]", "[4.00s → 6.00s] 明天在联系你"]
    assert r.summary == "检测到 1 处敏感信息（已脱敏）；音频异常：[强噪声] 1 次；共 3 个转写片段" and r.anomaly_events == 2
    fixed = analysis.audit(seg, odd, correct=True, threshold=0.75).first()
    assert "13812345678" not in fixed.display_text and "[LLM已纠正]" in fixed.display_text
    text = timeline.full_report(timeline.reports(seg, odd), timeline.redactions(seg), odd, "now").first().report
    assert "六、脱敏详情" in text and "七、音频异常记录" in text and "置信度：82%" in text and "四、" not in text
    empty = timeline.reports(seg.where("false"), odd.where("false"), None, seg).first()
    assert empty.display_text == "（无转写结果）" and empty.total_segments == 0


def test_signals(spark):
    assert signal.runs(np.array([0, 0, 1, 1, 1, 0, 1, 0], dtype=bool)) == [(2, 5), (6, 7)]
    t = np.arange(16000) / 16000
    sine, noise = 0.5 * np.sin(2 * np.pi * 440 * t), np.random.default_rng(0).normal(size=32000) * 0.5
    assert signal.zero_crossings(sine).mean() < 0.1 and signal.zero_crossings(noise).mean() > 0.2
    assert 200 < np.median(signal.centroid(sine, 16000)) < 800 and signal.entropy(sine, 16000).mean() > 0
    assert signal.energy(np.zeros(1000)).max() == 0 and len(signal.zero_crossings(np.zeros(100))) == 0
    assert len(signal.subtract_noise(sine)) == len(sine)
    waves = spark.createDataFrame([("n", 16000, noise.tolist()), ("s", 16000, sine.tolist()), ("e", 16000, [])], "media_id string, sr int, samples array<float>")
    found = signal.find_anomalies(waves).collect()
    assert {(r.media_id, r.label) for r in found} >= {("n", L.NOISE_LABEL)} and not any(r.media_id == "s" and r.label == L.NOISE_LABEL for r in found)
    assert signal.features(waves).where("media_id = 'e'").count() == 0
    rows = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate([1, 5, 6, 1, 7])], "k string, i int, v double")
    assert [(r.first_row, r.last_row) for r in signal.islands(rows, "k", ["i"], F.col("v") > 4).orderBy("first_row").collect()] == [(1, 2), (4, 4)]
    assert [r["mean"] for r in signal.rolling_mean(rows, "k", ["i"], "v", 3).orderBy("i").collect()] == pytest.approx([4, 4, 14 / 3])


def test_sources(spark, tmp_path):
    lines = [{"doc_id": 1, "topic": {"word": "w"}, "selection": {"selected_post": {"text": "hi"}}}, {"doc_id": 2}, {"doc_id": 3, "selection": {"selected_post": {"text": " "}}}]
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    assert [tuple(r) for r in posts.read_posts(spark, str(tmp_path / "p.jsonl")).collect()] == [(1, "w", "hi")]
    (tmp_path / "w.txt").write_text("# no\n的\n 了 \n\n的\n")
    assert posts.read_words(spark, str(tmp_path / "w.txt")) == ["了", "的"]
    assert posts.first_path(spark, str(tmp_path / "none"), str(tmp_path)) == str(tmp_path)
    (tmp_path / "c.json").write_text('{"a": 1}')
    assert posts.read_config(str(tmp_path / "c.json")) == {"a": 1}
    with pytest.raises(FileNotFoundError):
        posts.read_config(str(tmp_path / "no.json"))
    with pytest.raises(ValueError):
        posts.read_config(str(tmp_path / "w.txt"))
    posts.write_text(spark.createDataFrame([("x",), (" ",)], "t string"), "t", str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["x"]


def test_media(spark, tmp_path):
    folder = tmp_path / "media"
    folder.mkdir()
    with wave.open(str(folder / "a.wav"), "wb") as f:
        f.setnchannels(2)
        f.setsampwidth(2)
        f.setframerate(8000)
        f.writeframes(np.repeat((np.sin(np.arange(8000) / 10) * 9000).astype("<i2"), 2).tobytes())
    (folder / "b.wav").write_bytes(b"x" * 10)
    (folder / "c.txt").write_bytes(b"x" * 100)
    (folder / "d.mp3").write_bytes(b"x" * 100)
    got = {r.media_id.rsplit("/", 1)[1]: r for r in media.load(media.scan(spark, str(folder))).collect()}
    assert got["a.wav"].error is None and len(got["a.wav"].samples) == 16000 and got["a.wav"].seconds == 1
    assert got["b.wav"].error == "file too small" and got["c.txt"].error == "unsupported format" and got["d.mp3"].error.startswith("cannot be decoded")
    (tmp_path / "t.jsonl").write_text(json.dumps({"media_id": "m", "seg_idx": 0, "start": 0, "end": 1, "text": " 测试 ", "avg_logprob": -0.1}))
    r = media.read_transcripts(spark, str(tmp_path / "t.jsonl")).first()
    assert r.text == "测试" and r.confidence == pytest.approx(math.exp(-0.1))


def test_analysis(spark, tmp_path):
    df = spark.createDataFrame([(1, "今天某公司发布新款手机，非常好。大家都很满意。服务不错。价格合理的产品。"), (2, None)], "doc_id long, text string")
    got = analysis.analyse(df, o=analysis.Options(organisations=("某公司",), categories=(("科技", ("手机",)),)))
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[1].label == "科技" and rows[1].sentiment.sentiment == "正面" and len(rows[1].summary) == 3 and rows[1].keywords
    assert rows[2].tokens == [] and rows[2].entities == [] and rows[2].summary == []
    assert analysis.post_report(got).count() == 2
    with pytest.raises(ValueError):
        analysis.analyse(df, ("nonsense",))
    told = {t.name: t.value for t in analysis.trace(df.where("doc_id = 1")).first().trace}
    assert told["original"].startswith("今天") and told["advertisement"] == "no" and told["final"] == " ".join(rows[1].tokens)
    models = analysis.fit_models(df, topics_=2, sweeps=20)
    assert models.classifier.priors.count() == 1 and models.idf.count() == models.classifier.vocabulary.count() > 5
    again = analysis.analyse(df, o=analysis.Options(keywords=2), models=models)
    told = {r.doc_id: r for r in again.collect()}
    assert told[1].label == "其他" and told[1].probabilities == {"其他": 1.0} and len(told[1].keywords) == 2
    assert sum(t.probability for t in told[1].topics) > 0.9 and told[2].topics is None
    report = analysis.post_report(again)
    assert "主题：" in report.where("doc_id = 1").first().report
    posts.write_markdown(report, str(tmp_path / "md"))
    assert any(r.value == "## 1" for r in spark.read.text(str(tmp_path / "md")).collect())


def test_topic_discoverer(spark, tmp_path):
    rows = [(i, ["cat", "dog", "cat"] if i % 2 else ["sun", "moon", "sun"]) for i in range(20)] + [(20, [])]
    df = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    found = topics.TopicDiscoverer("lda", 2, seed=3).fit(df)
    told = found.get_topics(2).collect()
    assert len(told) == 2 and sum(t.weight for t in told) == pytest.approx(1, abs=1e-3) and all(len(t.words) == 2 for t in told)
    assert {r.doc_id: max(r.theta) > 0.5 for r in found.transform(df.where("doc_id < 2")).collect()} == {0: True, 1: True}
    posts.write_topics(found.get_topics(), str(tmp_path / "topics"))
    assert spark.read.json(str(tmp_path / "topics")).count() == 2
    groups = topics.TopicDiscoverer("kmeans", 2).fit(df)
    assert {r.topic_id for r in groups.get_topics(5).collect()} <= {0, 1} and groups.clusters.count() == 20
    with pytest.raises(NotImplementedError):
        groups.transform(df)
    with pytest.raises(ValueError):
        topics.TopicDiscoverer("other")


def test_logistic_steps_against_plain_gradients(spark):
    """All tasks together take the steps of a plain loop."""
    r = np.random.default_rng(1)
    x = np.round(r.normal(size=(20, 6)) * (r.random((20, 6)) < 0.5), 3)
    labels = [["p", "q", "r"][i % 3] for i in range(20)]
    vectors = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(20) for j in range(6) if x[i, j]], "doc_id long, idx int, value double")
    frame = spark.createDataFrame(list(enumerate(labels)), "doc_id long, label string")
    models = [classify.fit_logistic(vectors.repartition(n), frame.repartition(n), 6, epochs=12) for n in (1, 5)]
    for name in "pqr":
        w, b, y = np.zeros(6), 0.0, np.array([v == name for v in labels], float)
        for _ in range(12):
            off = 1 / (1 + np.exp(-(x @ w + b))) - y
            w, b = w - 0.1 * (x.T @ off + 0.01 * w) / 20, b - 0.1 * off.sum() / 20
        for m in models:
            assert m[name][0] == pytest.approx(w) and m[name][1] == pytest.approx(b)


def test_logistic_query_against_numpy(spark, data):
    """The query's labels from a dense matrix and plain steps."""
    from lexaudit.plans import catalog

    rows = catalog.labelled(spark, data)
    vocabulary = classify.fit_vocabulary(rows)
    truth = {r.doc_id: r.label for r in rows.select("doc_id", "label").collect()}
    at = {d: i for i, d in enumerate(sorted(truth))}
    x = np.zeros((len(at), 5000))
    for r in classify.tfidf_vectors(rows, vocabulary, rows.count()).collect():
        x[at[r.doc_id], r.idx] = r.value
    scores = []
    for name in sorted(set(truth.values())):
        w, b, y = np.zeros(5000), 0.0, np.array([truth[d] == name for d in sorted(truth)], float)
        for _ in range(100):
            off = 1 / (1 + np.exp(-(x @ w + b))) - y
            w, b = w - 0.1 * (x.T @ off + 0.01 * w) / len(at), b - 0.1 * off.sum() / len(at)
        scores.append(1 / (1 + np.exp(-(x @ w + b))))
    p = np.stack(scores, axis=1) / np.sum(scores, axis=0)[:, None]
    said = [sorted(set(truth.values()))[k] for k in np.round(p, 9).argmax(axis=1)]
    assert {r.doc_id: r.label for r in catalog.logistic_predict(spark, data).select("doc_id", "label").collect()} == dict(zip(sorted(truth), said, strict=True))


def test_subtraction_takes_steady_noise_away():
    rng = np.random.default_rng(3)
    t = np.arange(32000) / 16000
    hum, voice = 0.2 * np.sin(2 * np.pi * 50 * t), np.where(t > 1, 0.5 * np.sin(2 * np.pi * 700 * t), 0.0)
    cleaned = signal.subtract_noise(hum + voice + rng.normal(0, 1e-3, len(t)))
    power = lambda w, f: np.abs(np.exp(-2j * np.pi * f * t[17000:31000]) @ w[17000:31000])
    assert power(cleaned, 50) < 0.2 * power(hum + voice, 50) and power(cleaned, 700) > 0.7 * power(hum + voice, 700)


def test_spectra_against_direct_sums():
    """Centroid and entropy of a short wave from the sums of the transform's definition."""
    wave_ = np.random.default_rng(2).normal(size=64)
    window = signal._tukey(64)
    power = []
    for f in range(33):
        c = sum(wave_[n] * window[n] * np.exp(-2j * np.pi * f * n / 64) for n in range(64))
        power.append(abs(c) ** 2 / (8000 * (window**2).sum()) * (1 if f in (0, 32) else 2))
    power = np.array(power)
    assert signal.centroid(wave_, 8000)[0] == pytest.approx((power * np.arange(33) * 125).sum() / power.sum())
    p = power / power.sum()
    assert signal.entropy(wave_, 8000)[0] == pytest.approx(-(p * np.log2(p)).sum())


def test_scopes_free_tables(spark):
    import os

    from lexaudit.operators.scratch import discard, scope, stored

    there = lambda df: os.path.exists(df.inputFiles()[0].removeprefix("file://"))
    with scope(spark) as outer:
        a = stored(spark.range(3), "a")
        with scope(spark) as inner:
            b, c = stored(spark.range(3), "b"), inner.keep(stored(spark.range(4), "c"))
            file_b = b.inputFiles()[0].removeprefix("file://")
        assert there(a) and not os.path.exists(file_b) and c.count() == 4
        discard(a, spark.range(1))
        d = outer.keep(stored(spark.range(5), "d"))
        file_c = c.inputFiles()[0].removeprefix("file://")
    assert not os.path.exists(file_c) and d.count() == 5
    discard(d)


def test_events_of_shared_triggers(spark):
    """The first type that lists a trigger owns it; a longer trigger takes the place of a shorter one that it overlaps."""
    texts = ["球队晋级", "选手淘汰", "新剧开播", "游戏上线", "首发", "抗议", "战略合作", "架构调整", "打破纪录", "刑事诉讼", "粉丝见面会", "IPO与DLC", "Nature论文"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", F.transform(events.triggers(F.col("t")), lambda s: F.concat_ws(":", s["type"], s["text"])).alias("x"))
    assert [r.x for r in rows.orderBy("i").collect()] == [
        ["综艺动态:晋级"], ["综艺动态:淘汰"], ["影视上映:开播"], ["影视上映:上线"], ["产品发布:首发"], ["维权抗议:抗议"], ["合同签约:战略合作"], ["企业动态:架构调整"], ["纪录突破:打破纪录"], ["执法司法:刑事诉讼"], ["明星动态:粉丝见面会"],
        ["投融资:IPO", "游戏动态:DLC"], ["科研发布:Nature", "科研发布:论文"],
    ]
    assert len(L.EVENT_TYPES) == 36


def test_streams(spark, tmp_path):
    schema = "doc_id long, ts timestamp, text string"
    rows = [(i, f"2024-01-01 00:{i:02d}:00", ["手机13812345678", "很好"][i % 2]) for i in range(8)]
    spark.createDataFrame(rows, "doc_id long, ts string, text string").select("doc_id", F.col("ts").cast("timestamp").alias("ts"), "text").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    found = run(live.analyse_stream(stream(), ("pii", "sentiment")), "analysed")
    batch = analysis.row_modules(spark.read.parquet(str(tmp_path / "in")), ("pii", "sentiment")).collect()
    assert sorted((r.doc_id, r.redacted, r.sentiment) for r in found) == sorted((r.doc_id, r.redacted, r.sentiment) for r in batch)
    assert len(run(live.drop_copies(stream(), "ts"), "copies")) == 2
    assert sum(r.n for r in run(live.counts(stream(), "ts", "text", "4 minutes"), "counted", "complete")) == 8
    assert sum(r.n for r in run(live.bursts(stream(), "ts", "text", "3 minutes"), "bursts", "complete")) == 8


#: Queries that take little time; the others are held against their SQL on larger tables.
SHORT = (
    "strip_html", "stopword_filter", "tfidf_top", "nb_predict", "timeline_overlap", "islands", "clean_steps", "trace_steps", "chinese_tokens", "sentence_split", "ner_time", "ner_money", "ner_product", "entity_lines", "event_triggers",
    "event_slots", "event_lines", "event_summaries", "emoji_sentiment", "fine_grained", "aspect_sentiment", "pii_spans", "pii_redact", "pii_allowed", "rule_correct", "low_conf_gate", "security_summary", "audit_reports", "full_reports", "summary_tfidf", "cooc_edges",
)


def test_queries_agree_with_their_sql(spark, data):
    duckdb = pytest.importorskip("duckdb")
    from lexaudit.plans import catalog

    db = duckdb.connect()
    for name in ("documents", "labels", "orders", "events", "pages", "conversations", "lineitem", "customer", "embeddings"):
        db.execute(f"create view {name} as select * from '{data}/{name}.parquet'")

    def plain(x):
        return round(float(x), 6) + 0.0 if isinstance(x, (float, Decimal)) else [plain(y) for y in x] if isinstance(x, (list, tuple)) else x

    for name in SHORT:
        got = catalog.QUERIES[name](spark, data)
        want = db.sql(f"select {', '.join(got.columns)} from ({catalog.SQL[name]})").fetchall()
        assert sorted(repr(plain(tuple(r))) for r in got.collect()) == sorted(repr(plain(r)) for r in want), name


def test_emoji_are_asked_for_within_few_ranges_and_advertisements_told_by_compiled_code(spark, data):
    from lexaudit.functions import cleaning
    from lexaudit.functions import lexicons as L
    from lexaudit.plans import chinese

    edges = sorted({n + d for a, b in L.EMOJI_RANGES for n in (int(a, 16), int(b, 16)) for d in (-1, 0, 1)})
    rows = spark.createDataFrame([(f"a中{chr(n)}{chr(n)}b",) for n in edges], "text string")
    got = rows.select(cleaning.strip_emoji(F.col("text")).alias("got"), F.regexp_replace("text", L.EMOJI_PATTERN, "").alias("want"))
    assert got.where("got <> want").count() == 0
    assert cleaning._EMOJI.split("&&")[0].count("-") < 6
    plan = chinese.clean_steps(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan


def test_an_epoch_makes_no_python_object_of_a_label():
    import pyarrow as pa

    said = pa.array(["b", None, "a", "b"])
    assert classify._truth(said, ["a", "b"]).tolist() == [[0, 0, 1, 0], [1, 0, 0, 1]]
    assert classify._truth(said, [None]).tolist() == [[0, 1, 0, 0]] and classify._truth(said.slice(0, 0), ["a"]).shape == (1, 0)
    assert "to_pylist" not in classify.fit_logistic.__code__.co_names + sum((c.co_names for c in classify.fit_logistic.__code__.co_consts if hasattr(c, "co_names")), ())
