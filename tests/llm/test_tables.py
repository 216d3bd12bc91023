"""Sharding, URL reputation, top-k, mixing, components and the pipeline."""

import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexaudit.llm import mixing, queries, reputation, sharding, topk
from lexaudit.llm.graph import components


def slow_jump(key: int, n: int) -> int:
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump():
    keys = np.random.default_rng(1).integers(0, 1 << 60, 500)
    for n in (1, 2, 24, 25, 1000):
        assert sharding.jump(keys, n).tolist() == [slow_jump(int(k), n) for k in keys]


def test_shards(docs, rows, nothing):
    got = sharding.assign(docs, 24, chunk=2).collect()
    sizes = collections.Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == sizes
    by_shard = collections.defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 24) and 0 <= r.shard < 24 and r.law == "key"
    assert all(sorted(x) == list(range(len(x))) for x in by_shard.values())
    assert len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})
    assert sharding.assign(nothing, 24).count() == 0


def test_urls(spark):
    urls = ["http://A.Example.NET/en/1", "x://example.com/de/", "https://example.com/de", "ftp://sub.org/fr/x?y#z", "http://notexample.net", "http://notexample.net/", None, "no scheme", "a://b://c/d", "http://h\n/p?q", "http://example.net:80/en/", "://?x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in reputation.judge(pages, spark.createDataFrame([], "url string, bad int"), queries.URL_RULES).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(len(urls))] == [
        ("a.example.net", "/en/1", "example.net/en/", "allow"), ("example.com", "/de/", "example.com/de/", "block"), ("example.com", "/de", None, "allow"), ("sub.org", "/fr/x", "org/fr/", "allow"),
        ("notexample.net", "", None, "allow"), ("notexample.net", "/", "net/", "block"), ("", "", None, "allow"), ("", "", None, "allow"), ("b:", "//c/d", None, "allow"), ("h\n", "/p", None, "allow"), ("example.net:80", "/en/", None, "allow"), ("", "", None, "allow"),
    ]
    assert reputation.judge(pages.where("false"), spark.createDataFrame([], "url string, bad int"), queries.URL_RULES).count() == 0


def test_reputation_shrinks_and_blocks(spark):
    seen = [("http://good.a.com/", 0)] * 60 + [("http://bad.b.com/", 1)] * 50 + [("http://bad.b.com/", 0)] * 3 + [("http://one.c.org/", 1)] + [("http://d.org/", None)]
    outcomes = spark.createDataFrame(seen, "url string, bad int")
    pages = spark.createDataFrame([(1, "http://good.a.com/x"), (2, "http://bad.b.com/x"), (3, "http://one.c.org/"), (4, "http://new.b.com/"), (5, "http://new.zz/")], "page_id long, url string")
    got = {r.page_id: r for r in reputation.judge(pages, outcomes, []).collect()}
    assert got[2].verdict == "block" and got[1].verdict == "allow" and got[3].bad_bound < got[2].bad_bound - 0.2
    assert got[1].bad_mean < got[5].bad_mean < got[2].bad_mean and got[4].bad_mean > got[5].bad_mean
    assert all(r.bad_bound < r.bad_mean for r in got.values())


def test_verdicts_where_hosts_differ_match_sql(spark, tmp_path):
    """Hosts of every kind (bad, good, bad domain without outcomes of its own, repeated and null rows): both verdicts, as the SQL has them."""
    import random

    import duckdb

    r = random.Random(8)
    share = {"bad.one.org": 0.9, "worse.one.org": 0.8, "fine.two.org": 0.05, "good.two.org": 0.1, "a.three.com": 0.15, "b.three.com": 0.2, "c.three.com": 0.85, "x.four.com": 0.1}
    pages, labels = [], []
    for i in range(800):
        host = r.choice(list(share))
        pages.append((i, f"https://{host}/x/{i}"))
        if i % 3:
            labels.append((i, 0 if r.random() < share[host] else 1, 0))
    pages += [pages[0], (None, pages[1][1]), (900, None), (901, "https://new.one.org/x"), (902, "https://new.two.org/x"), (903, "https://elsewhere.zz/"), (904, "https://bad.one.org/fr/7777")]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = queries.op6_url_reputation(spark, str(tmp_path)).collect()
    base = duckdb.connect()
    for name in ("pages", "labels"):
        base.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = base.execute(f"SELECT page_id, host, path, rule, verdict FROM ({queries.oracle_sql()['op6_url_reputation']})").fetchall()
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    said = {x.host: x.verdict for x in got if x.rule is None}
    assert {h for h, v in said.items() if v == "block"} >= {"bad.one.org", "worse.one.org", "c.three.com"}
    assert all(said[h] == "allow" for h in ("fine.two.org", "good.two.org", "a.three.com", "x.four.com", "elsewhere.zz", "new.two.org", ""))
    assert [x.verdict for x in got if x.page_id == 904] == ["allow"]  # a rule goes first


def brute_top(ids, x, is_query, k):
    out = []
    for i in np.flatnonzero(is_query):
        score = x @ x[i]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:k]
        out += [(int(ids[i]), n, int(ids[j]), int(score[j])) for n, j in enumerate(order, 1)]
    return sorted(out)


@pytest.mark.parametrize("n,spread", [(5, 0.1), (300, 0.1), (300, 3000.0), (300, 0.0)])
def test_top_k(spark, n, spread):
    r = np.random.default_rng(n)
    v = r.normal(0, spread, (n, 16)).astype(np.float32)
    v[n // 2 :] = v[: n - n // 2]  # ties
    frame = spark.createDataFrame([(i, v[i].tolist(), "x") for i in range(n)], "vec_id long, embedding array<float>, score string")
    odd = spark.createDataFrame([(9000, None, ""), (9020, [None] * 16, ""), (9040, [float("nan")] * 16, ""), (9060, [float("inf")] * 16, ""), (None, [0.5] * 16, "")], frame.schema)
    x = np.floor(64 * v.astype(np.float64)).astype(np.int64)
    want = brute_top(np.arange(n), x, np.arange(n) % 20 == 0, 20)
    for sizes in ({"row_block": 100}, {"row_block": 30, "query_unit": 7, "first_wave": 1}):
        got = topk.top_k(frame.unionByName(odd), F.col("vec_id") % 20 == 0, **sizes)
        assert sorted(tuple(r) for r in got.collect()) == want


def test_top_k_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(none, F.lit(True)).count() == 0
    some = spark.createDataFrame([(1, [1.0])], none.schema)
    assert topk.top_k(some, F.lit(False)).columns == topk.top_k(some, F.lit(True)).columns and topk.top_k(some, F.lit(True)).count() == 0


def test_top_k_of_vectors_of_unequal_width_and_repeated_ids(spark):
    vectors = [(0, [1.0, 2.0, 0.5]), (1, [1.0]), (2, []), (3, [0.0, 1.0]), (3, [0.0, -1.0]), (4, [3.0, 3.0, 3.0, 3.0])]
    got = topk.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=4, scale=2, row_block=2)
    assert [tuple(r)[1:] for r in got.orderBy("rank").collect()] == [(1, 4, 42), (2, 1, 4), (3, 2, 0), (4, 3, -8)]


def test_scores_beyond_64_bits_are_an_error():
    x = np.array([[1 << 40, 1], [3, 1 << 39]])
    with pytest.raises(OverflowError):
        topk.Index(np.arange(2), x).search(np.arange(2), x, 1)
    x = np.array([[(1 << 30) + 1, 3], [5, 1 << 29]])  # beyond exact floating-point sums
    assert [s.tolist() for _, s in topk.Index(np.arange(2), x).search(np.arange(2), x, 1)] == [[int(x[0] @ x[1])]] * 2


@pytest.mark.parametrize("row_block", [1, 2, 3, 7])
def test_scores_that_doubles_do_not_hold(spark, row_block):
    """Scores between 2**53 and 2**63 that differ by one, in blocks whose floors come from others."""
    big = 1 << 30
    vectors = [(1000, [big, 1]), (1, [big, 0]), (2, [big, 1]), (3, [big, 1]), (4, [big - 1, 9]), (5, [big, 3]), (6, [-big, 1]), (7, [big, 2])]
    frame = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in vectors], "vec_id long, embedding array<double>")
    ids, x = np.array([i for i, _ in vectors]), np.array([v for _, v in vectors])
    for k in (1, 2, 4):
        got = topk.top_k(frame, F.col("vec_id") == 1000, k=k, scale=1, row_block=row_block, first_wave=1)
        assert sorted(tuple(r) for r in got.collect()) == brute_top(ids, x, ids == 1000, k)


def test_waves_of_blocks_grow():
    assert topk.waves(1, 8) == [(0, 1)] and topk.waves(20, 3) == [(0, 3), (3, 15), (15, 20)]


def test_segments_rule_rows_out_only_with_proof():
    r = np.random.default_rng(7)
    x = np.floor(r.normal(0, 8, (5000, 32))).astype(np.int64)
    index = topk.Index.load(topk.Index(np.arange(5000), x).dump())
    want = [[j for j in np.lexsort((np.arange(5000), -(x @ x[i]))) if j != i][:20] for i in range(8)]
    read = []
    for share in (0.0, 0.02, 0.5):
        for i, (ids, score) in enumerate(index.search(np.arange(8), x[:8], 20, share)):
            assert ids.tolist() == want[i] and score.tolist() == (x @ x[i])[want[i]].tolist()
        read.append(index.reads.sum())
    assert read[0] > read[1] > read[2] and index.reads.max() < index.levels  # some postings are never read
    best = [(x @ x[i])[want[i][9]] for i in range(8)]
    for i, (ids, _) in enumerate(index.search(np.arange(8), x[:8], 20, floors=np.array(best, np.int64), floor_ids=np.array([w[9] for w in want]))):
        assert ids.tolist() == want[i][:9]


def test_budgets():
    weight = lambda p: {"a": 0.5, "b": 0.5, "x": 1, "y": 3, "z": 0}.get(p[-1], 1)
    supply = {("a", "x", "s"): 100, ("a", "y", "s"): 10, ("b", "x", "s"): 1000, ("b", "z", "s"): 50}
    got = mixing.budgets(supply, 200, weight)
    assert got == {("a", "x", "s"): 90, ("a", "y", "s"): 10, ("b", "x", "s"): 100, ("b", "z", "s"): 0}  # the sibling takes y's shortage
    assert mixing.budgets(supply, 400, weight) == {("a", "x", "s"): 100, ("a", "y", "s"): 10, ("b", "x", "s"): 290, ("b", "z", "s"): 0}  # then the ancestor's sibling
    assert sum(mixing.budgets(supply, 10**6, weight, 2).values()) == 2220
    assert mixing.share_out(10, {"p": 100, "q": 100, "r": 100}, {"p": 1, "q": 1, "r": 1}) == {"p": 4, "q": 3, "r": 3}


def test_mix_is_a_prefix_of_each_leaf(docs, rows, nothing):
    import hashlib

    domain = F.when(F.col("source") == "src1", "u").otherwise("v")
    weight = lambda p: 1.0
    plan, told = mixing.plan_mix(docs, domain, weight, 0.4, seed=3)
    got = collections.Counter((r.doc.doc_id, r.doc.text, tuple(r.leaf)) for r in mixing.select_mix(docs, domain, plan, seed=3).collect())
    leaves = collections.defaultdict(collections.Counter)
    for d, t, lang, source, _ in rows:
        key = f"{'null' if d is None else d}:{hashlib.sha256((t or '').encode()).hexdigest()}"
        leaves["u" if source == "src1" else "v", lang or "?", source or "?"][hashlib.md5(f"3:0:{key}".encode()).hexdigest(), d, t] += 1
    want = collections.Counter()
    for leaf, members in leaves.items():
        _, budget = told[leaf]
        used = 0
        for (_, d, t), n in sorted(members.items(), key=lambda x: x[0][0]):
            used += n * len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
            if used > budget:
                break
            if budget:
                want[d, t, leaf] += n
    assert got == want
    plan, told = mixing.plan_mix(nothing, domain, weight, 0.4)
    assert plan == [] and told == {} and mixing.select_mix(nothing, domain, plan).count() == 0


def test_epochs_repeat_documents(docs):
    plan, told = mixing.plan_mix(docs, F.lit("one"), lambda p: 1.0, 1.5, epochs=2)
    got = mixing.select_mix(docs, F.lit("one"), plan).groupBy("epoch").count().collect()
    assert {r.epoch for r in got} == {0, 1}
    assert sum(b for _, b in told.values()) == int(1.5 * sum(s for s, _ in told.values()))


def test_components(spark):
    r = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, None)]
    root = {x: x for e in edges for x in e if x is not None}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        if b is not None and a != b:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    linked = {x for a, b in edges if b is not None and a != b for x in (a, b)}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


CLASHES = ("score", "lang_pred", "__text", "epoch", "_key", "key", "leaf", "doc", "text_key", "kept", "block", "rows", "id", "k", "last", "c0", "hash", "component_id", "n", "first", "m1", "a.b", "a`b", "doc.text", "with space", "crawl-date")


def with_clashes(df, value):
    """Further columns of the operators' own names, of names that need quotes, and of nested ones that do."""
    for c in CLASHES:
        df = df.withColumn(c, value)
    nested = F.struct(value.alias("a b"), value.alias("crawl-date"), value.alias("x.y"), F.array(F.struct(value.alias("c`d"))).alias("list"))
    return df.withColumn("nested", nested)


def test_mix_of_clashing_columns(spark, docs):
    odd = docs.select("doc_id", "text", "lang", "source", *(F.lit("x").alias(c) for c in ("key", "leaf", "doc", "epoch", "last", "_key", "_leaf", "_last", "tokens", "budget", "bin", "order")))
    plan, _ = mixing.plan_mix(odd, F.lit("one"), lambda p: 1.0, 0.5)
    plain = mixing.select_mix(docs, F.lit("one"), plan).select("doc.doc_id").collect()
    got = mixing.select_mix(odd, F.lit("one"), plan).select("doc.*")
    assert got.columns == odd.columns and sorted(map(str, got.select("doc_id").collect())) == sorted(map(str, plain)) and plain


def plain_pipeline(rows, model):
    """Stages 3, 10, 8 and 9 by plain Python, with the given language model; rows: (doc_id, text, lang, source)."""
    import hashlib

    from lexaudit.llm import language

    from .test_text import WORD, brute_groups, shingles

    kept = []
    for row in rows:
        found = language.buckets(row[1], language.Settings()) if row[1] else None
        if found is not None and language._softmax(model.logits(*found) / model.temperature).max() >= 0.5:
            kept.append(row)
    root = brute_groups([(r[0], shingles(r[1])) for r in kept])
    kept = [r for r in kept if root[r[0]] == r[0]]
    least: dict = {}
    for d, t, *_ in kept:
        w = WORD.findall(t)
        for i in range(len(w) - 49):
            least[tuple(w[i : i + 50])] = min(d, least.get(tuple(w[i : i + 50]), d))
    cut = []
    for d, t, lang, source in kept:
        w, gone = WORD.findall(t), set()
        for i in range(len(w) - 49):
            if least[tuple(w[i : i + 50])] < d:
                gone.update(range(i, i + 50))
        left = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else t
        if left:
            cut.append((d, left, lang, source))
    leaves = collections.defaultdict(list)
    for d, t, lang, source in cut:
        domain = "press" if (source or "")[-1:] in set("13579") else "forum"
        key = f"{d}:{hashlib.sha256(t.encode()).hexdigest()}"
        leaves[domain, lang or "?", source or "?"].append((hashlib.md5(f"7:0:{key}".encode()).hexdigest(), d, t, len(WORD.findall(t))))
    supply = {k: sum(x[3] for x in v) for k, v in leaves.items()}
    got = mixing.budgets(supply, int(0.8 * sum(supply.values())), queries.mix_weight, 1)
    out = []
    for leaf, members in leaves.items():
        used = 0
        for _, d, t, n in sorted(members):
            used += n
            if used > got[leaf]:
                break
            if got[leaf]:
                out.append((d, t))
    return sorted(out)


def test_pipeline_against_plain_python(spark, tmp_path, data):
    """Every stage's decisions on the supplied documents, beside extra columns with the operators' own names."""
    import hashlib

    from tokenizers import Tokenizer

    import corpus_pipeline
    from lexaudit.llm import language

    docs = spark.read.parquet(f"{data}/documents.parquet")
    docs = with_clashes(docs, F.lit("x"))
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    want = plain_pipeline(rows, language.fit(docs, F.lit(True)))
    assert 20 < len(want) < len(rows)
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, before, data).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "mix_sources":
            assert sorted((r.doc_id, r.text) for r in docs.collect()) == want
        if name != "bpe_round_trip":
            assert docs.columns == before.columns and 0 < docs.count() <= before.count()
    library = Tokenizer.from_file(queries.tokenizer_path())
    ids = [library.encode(t, add_special_tokens=False).ids for _, t in want]
    coded = [(d, len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for (d, _), x in zip(want, ids, strict=True)]
    assert sorted(tuple(r)[:3] for r in docs.collect()) == sorted(coded)
    again = corpus_pipeline.run(spark, data)
    assert sorted(tuple(r)[:3] for r in again.collect()) == sorted(coded)


def test_pipeline_on_odd_rows_and_none(spark, rows, tmp_path):
    import corpus_pipeline

    from .conftest import SCHEMA

    odd = spark.createDataFrame(rows, SCHEMA)
    odd = with_clashes(odd, F.lit(None).cast("double"))
    for i, frame in enumerate((odd, spark.createDataFrame([], SCHEMA))):
        frame.write.parquet(str(tmp_path / str(i) / "documents.parquet"))
        assert corpus_pipeline.run(spark, str(tmp_path / str(i))).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
