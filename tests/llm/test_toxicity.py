"""Toxicity: the decoder against all paths, held-out accuracy, disguised words, and odd inputs."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexaudit.llm import queries, toxicity

WORDS = ["idiot", "moron", "loser", "stupid", "pathetic", "worthless", "trash", "scum", "clown", "disgusting"]


@pytest.fixture(scope="module")
def lm(spark, data):
    return toxicity.model(toxicity.count_characters(spark.read.parquet(f"{data}/documents.parquet").select("text")))


def paths(span):
    """Every reading of a lattice with its cost; letters in pieces, a break as a space."""
    ways = []
    for found, a_break, nothing in toxicity.offers(span):
        way = [(c * n, price) for c, n, price in found]
        way += [(" ", a_break)] if a_break is not None else []
        way += [("", nothing)] if nothing is not None else []
        ways.append(way)
    for path in itertools.product(*ways):
        yield "".join(x for x, _ in path), sum(price for _, price in path)


def likelihood(text, lm):
    total, words = 0.0, text.split()
    for word in words:
        codes = [0, 0, *(toxicity._code(c) for c in word), 0]
        total += sum(float(lm[codes[i], codes[i + 1], codes[i + 2]]) for i in range(len(codes) - 2))
    return total


def test_decoder_against_all_paths(lm):
    r = random.Random(4)
    spans = ["1d10t", "m0r0n!!", "i d i o t", "l.o.s.e.r", "sssooo", "$tup1d", "a1-b", "éé3", "9", "1 2 3", "x" * 7]
    spans += ["".join(r.choice("ab10$ .-eeo!é") for _ in range(r.randint(1, 7))) for _ in range(150)]
    for span, got in zip(spans, toxicity.decode(spans, lm), strict=True):
        best = max(likelihood(text, lm) - price for text, price in paths(span))
        mine = max((likelihood(text, lm) - price for text, price in paths(span) if text.split() == got.split()), default=-math.inf)
        assert mine >= best - 1e-3, (span, got)


def test_character_model(lm):
    assert np.allclose(np.exp(lm.astype(float)).sum(axis=2), 1, atol=1e-4)
    text = "Ab, é!  x"
    back = lambda n: (n >> 12, (n >> 6) & 63, n & 63)
    e = 27 + ord("é") - 0xDF
    assert [back(int(n)) for n in toxicity.trigrams(text)] == [(0, 0, 1), (0, 1, 2), (1, 2, 0), (2, 0, 0), (0, 0, e), (0, e, 0), (e, 0, 0), (0, 0, 24), (0, 24, 0), (24, 0, 0)]


def test_restored_text(lm):
    restore = lambda t: toxicity.Restorer(lm).restore([t])[0]
    clean = "Is and retitioning, ouen the of 2019 (nterti) thorreou ndernt.\nA b."
    assert restore(clean) == clean.lower()
    assert restore("so i d i o t is") == "so idiot is" and restore("so iiidiooot is") == "so idiot is"
    assert restore("so w0rthl3ss is") == "so worthless is" and restore("so l_o_s_e_r is") == "so loser is"
    assert restore("") == "" and toxicity.Restorer(lm).restore([None]) == [""]


def test_held_out(spark, data):
    got = queries.op12_toxicity(spark, data.replace("sf0.001", "sf0.1"))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(spark.read.parquet(f"{data.replace('sf0.001', 'sf0.1')}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    toxic, clean = [r.predicted for r in rows if r.toxic == 1], [r.predicted for r in rows if r.toxic == 0]
    print("caught", np.mean(toxic), "of", len(toxic), "wrongly", np.mean(clean), "of", len(clean))
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.03


def disguised(word, r):
    alike = {"o": "0", "i": "1", "e": "3", "a": "@", "s": "$", "t": "7"}
    way = r.randrange(3)
    if way == 0:
        return "".join(alike.get(c, c) if r.random() < 0.5 else c for c in word)
    if way == 1:
        return r.choice(" .-").join(word)
    return "".join(c * (r.randint(3, 5) if r.random() < 0.4 else 1) for c in word)


def test_disguised_words_score_like_plain_ones(spark):
    """Words learnt plain are found disguised in documents that were not labelled."""
    r = random.Random(9)
    plain = ["".join(r.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(r.randint(1, 4))) for _ in range(400)]

    def text(words):
        out = r.choices(plain, k=60)
        for w in words:
            out.insert(r.randrange(len(out)), w)
        return " ".join(out)

    pick = lambda: r.choices(WORDS, k=4)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        rows.append((i, text(pick() if toxic else [])))
        labels.append((i, int(toxic)))
    hidden = [(1000 + i, text([disguised(w, r) for w in pick()])) for i in range(60)]
    clean = [(2000 + i, text(["1999", "b2b", "a.b", "zzz", "10%"])) for i in range(60)]
    docs = spark.createDataFrame(rows + hidden + clean, "doc_id long, text string")
    got = {x.doc_id: x.predicted for x in toxicity.score_documents(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(False)).collect()}
    assert np.mean([got[i] for i, _ in hidden]) > 0.9 and np.mean([got[i] for i, _ in clean]) < 0.05
    assert np.mean([got[i] == y for i, y in labels]) > 0.99


def test_toxicity_of_odd_rows(spark, docs, rows, nothing):
    labels = spark.createDataFrame([(7, 1), (14, 1), (14, 0), (None, 1), (21, None), (28, 0), (35, 1)], "doc_id long, toxic int")
    got = toxicity.score_documents(docs, labels, F.col("doc_id") % 5 == 0)
    assert got.count() == len(rows)
    assert got.where("score is null or held_out is null or predicted is null or score < 0 or score > 1").count() == 0
    assert toxicity.score_documents(nothing, labels, F.lit(False)).count() == 0
    none = toxicity.score_documents(docs, labels.where("false"), F.lit(False))
    assert none.count() == len(rows) and {r.score for r in none.collect()} == {0.0}
    assert toxicity.restored(docs).count() == len(rows)


def test_features_and_counts_against_documents_one_by_one(spark, docs, rows, lm):
    s = toxicity.Settings(bits=12)
    labelled = spark.createDataFrame([(t, i % 2) for i, (_, t, *_) in enumerate(rows)], "text string, toxic int")
    shared = spark.sparkContext.broadcast(lm)
    got = toxicity._count_features(labelled, shared, s)
    want = np.zeros_like(got)
    for i, (_, t, *_) in enumerate(rows):
        low = toxicity.Restorer(lm).restore([t])
        half = toxicity.half_of([t or ""])[0]
        owner, word, bucket = toxicity.word_features(low, s)
        assert (owner == 0).all()
        want[half, i % 2, np.unique(bucket)] += 1
        want[half, i % 2, -1] += 1
    assert (got == want).all()


def test_same_words_have_the_same_features_in_any_text():
    s = toxicity.Settings()
    one = toxicity.word_features(["abcdef xyz"], s)
    other = toxicity.word_features(["q", "", "xyz (abcdef)"], s)
    of = lambda f, d: {b for o, b in zip(f[0], f[2], strict=True) if o == d}
    assert of(one, 0) == of(other, 2) and len(of(one, 0)) == (1 + 4) + (1 + 1)


def test_the_driver_gets_one_vector_however_many_tasks_count(spark, lm, monkeypatch):
    docs = spark.createDataFrame([("an example of words", i % 2) for i in range(64)], "text string, toxic int").repartition(8)
    got, collect = [], type(docs).collect

    def watched(self):
        found = collect(self)
        got.append(sum(len(x) for r in found for x in r if isinstance(x, bytes | bytearray)))
        return found

    monkeypatch.setattr(type(docs), "collect", watched)
    counts = toxicity._count_features(docs, spark.sparkContext.broadcast(lm), toxicity.Settings(bits=12))
    assert toxicity.count_characters(docs.select("text")).sum() == 64 * len(toxicity.trigrams("an example of words"))
    assert got == [counts.nbytes, 8 * toxicity.SIZE**3] and counts[:, :, -1].sum() == 64
