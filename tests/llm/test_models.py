"""Classifiers: the mathematics, held-out accuracy on the supplied tables, and odd inputs."""

import numpy as np
from pyspark.sql import functions as F

from lexaudit.llm import language, quality, queries


def test_prior_and_fit_recover_a_planted_class():
    r = np.random.default_rng(1)
    n = 4000
    good = r.random(n) < 0.7
    found = np.zeros((n, len(quality.FEATURES)), dtype=np.uint8)
    found[:, 6] = np.where(good, 0, r.integers(3, 6, n))
    x = quality.design(found)
    positive = x[good][:800]
    p, u = positive.T @ positive, x.T @ x
    prior = quality.estimated_prior(p, u)
    assert abs(prior - 0.7) < 0.05
    score = np.clip((x @ quality.fit(p, u, prior) + 1) / 2, 0, 1)
    assert ((score >= 0.3) == good).mean() > 0.99


def test_the_fit_is_no_worse_than_the_unbiased_minimum():
    """Few rows and many bins: the unbiased risk can be driven below nothing, the non-negative one cannot."""
    r = np.random.default_rng(2)
    found = r.integers(0, 3, (60, len(quality.FEATURES))).astype(np.uint8)
    x = quality.design(found)
    p, u = x[:20].T @ x[:20] / 20, x.T @ x / 60

    def risk(w, prior=0.9, ridge=1e-4):
        part = lambda m, sign: (1 - 2 * sign * m[-1] @ w + w @ m @ w) / 4
        return prior * part(p, 1) + max(0, part(u, -1) - prior * part(p, -1)) + ridge * w @ w / 4

    unbiased = np.linalg.solve(u + 1e-4 * np.eye(len(u)), 1.8 * p[-1] - u[-1])
    fitted = quality.fit(20 * p, 60 * u, 0.9)
    assert risk(fitted) < 0.9 * risk(unbiased)
    assert risk(fitted) >= 0


def test_quality_held_out(spark, data):
    got = queries.op1_quality(spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id")
    rows = got.where("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.85


def test_quality_of_odd_rows(spark, docs, rows, nothing):
    labels = spark.createDataFrame([(7, 1), (14, 1), (14, 0), (None, 1), (21, None)], "doc_id long, quality int")
    got = quality.score_documents(docs, labels, F.col("doc_id") % 5 == 0)
    assert got.count() == len(rows)
    assert got.where("score is null or held_out is null or predicted is null").count() == 0
    assert quality.score_documents(nothing, labels, F.lit(False)).count() == 0
    none = quality.score_documents(docs, labels.where("false"), F.lit(False))
    assert {r.score for r in none.collect()} == {0.5}


def test_language_held_out(spark, data):
    got = queries.op3_language(spark, data).join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_rows(spark, docs, rows, nothing):
    got = language.identify(docs, F.col("doc_id") % 2 == 0)
    assert got.count() == len(rows)
    assert got.where("lang_pred is null or score is null or held_out is null").count() == 0
    letters = {d: t is not None and any(c.isalpha() for c in t) for d, t, *_ in rows if d is not None}
    for r in got.where("doc_id is not null").collect():
        assert (r.lang_pred != "und") == letters[r.doc_id]
    assert language.identify(nothing, F.lit(False)).count() == 0
    assert {r.lang_pred for r in language.identify(docs, F.lit(True)).collect()} == {"und"}


def test_model_is_sparse_and_calibrated():
    s = language.Settings(sample=400)
    r = np.random.default_rng(3)
    say = {"x": "abc abd acb", "y": "xyz xzy yxz"}
    examples = [(*language.buckets(" ".join(r.choice(say[n].split(), 12)), s), n) for n in r.choice(["x", "y"], 300)]
    model = language.train(examples, np.ones(1 << s.bits), s)
    assert model.names == ["x", "y"] and 0 < np.count_nonzero(model.weights) < 0.2 * model.weights.size
    assert all(model.names[int(model.logits(a, c).argmax())] == n for a, c, n in examples)
    assert language.buckets("12 - !", s) is None


def test_pair_counts_against_all_documents(spark, docs, rows):
    """The matrices that the risk is made of, and the risk itself, from the documents one by one."""
    held = quality.features(docs, "doc_id", "text").collect()
    x = np.stack([quality.design(np.frombuffer(r.bins, np.uint8)[None])[0] for r in held])
    assert len(held) == len(rows) and (x.sum(axis=1) == len(quality.FEATURES) + 1).all()
    got = quality.pair_counts(quality.features(docs, "doc_id", "text"))
    assert (got == sum(np.outer(v, v) for v in x)).all()
    good, prior, w = x[: len(x) // 2], 0.7, np.random.default_rng(3).normal(0, 0.1, quality.SIZE)
    loss = lambda z: (1 - z) ** 2 / 4
    one_by_one = prior * loss(good @ w).mean() + max(0, loss(-(x @ w)).mean() - prior * loss(-(good @ w)).mean())
    p, u = good.T @ good / len(good), got / len(x)
    part = lambda m, sign: (1 - 2 * sign * m[-1] @ w + w @ m @ w) / 4
    assert np.isclose(one_by_one, prior * part(p, 1) + max(0, part(u, -1) - prior * part(p, -1)))
    steps = quality.score_counts(quality.features(docs, "doc_id", "text"), w)
    assert (steps == np.bincount(np.minimum((quality.scores(np.stack([np.frombuffer(r.bins, np.uint8) for r in held]), w) * quality.STEPS).astype(int), quality.STEPS - 1), minlength=quality.STEPS)).all()


def test_prior_from_scores():
    r = np.random.default_rng(4)
    good, bad = r.normal(0.8, 0.1, 60_000), r.normal(0.2, 0.1, 20_000)
    count = lambda x: np.bincount(np.clip((x * quality.STEPS).astype(int), 0, quality.STEPS - 1), minlength=quality.STEPS)
    assert abs(quality.refined_prior(count(good[:20_000]), count(np.append(good, bad)), 0.95) - 0.75) < 0.01
    assert quality.refined_prior(np.zeros(3), np.ones(3), 0.4) == 0.4


def test_language_training_against_a_plain_loop():
    """FTRL-Proximal with L1 and L2, a coordinate at a time, and TF-IDF weights by their formula."""
    s = language.Settings(bits=6, epochs=2, kept_apart=0.0)
    r = np.random.default_rng(5)
    idf = r.uniform(1, 3, 64)
    examples = []
    for i in range(30):
        at = np.sort(r.choice(64, 8, replace=False))
        examples.append((at, r.integers(1, 5, 8), ["a", "b", "c"][i % 3]))
    model = language.train(examples, idf, s)
    z, n = np.zeros((65, 3)), np.zeros((65, 3))

    def weight(j, k):
        l1, l2 = (s.l1, s.l2) if j < 64 else (0.0, 0.0)
        return 0.0 if abs(z[j, k]) <= l1 else -(z[j, k] - np.sign(z[j, k]) * l1) / ((s.beta + np.sqrt(n[j, k])) / s.alpha + l2)

    for _ in range(s.epochs):
        for at, counts, name in examples:
            value = {int(j): (1 + np.log(c)) * idf[j] for j, c in zip(at, counts, strict=True)}
            length = np.sqrt(sum(v * v for v in value.values()))
            x = {j: v / length for j, v in value.items()} | {64: 1.0}
            w = {(j, k): weight(j, k) for j in x for k in range(3)}
            e = np.exp([sum(w[j, k] * v for j, v in x.items()) for k in range(3)])
            wrong = e / e.sum() - np.eye(3)["abc".index(name)]
            for j, v in x.items():
                for k in range(3):
                    g = v * wrong[k]
                    z[j, k] += g - (np.sqrt(n[j, k] + g * g) - np.sqrt(n[j, k])) / s.alpha * w[j, k]
                    n[j, k] += g * g
    want = np.array([[weight(j, k) for k in range(3)] for j in range(65)])
    assert np.allclose(model.weights, want[:-1]) and np.allclose(model.bias, want[-1])


def test_clashing_columns_of_predictions(spark, docs):
    model = language.fit(docs, F.lit(True))
    plain = language.predict(docs, model, ["doc_id", "text"])
    assert plain.columns == ["doc_id", "text", "lang_pred", "score"] and plain.count() == docs.count()
