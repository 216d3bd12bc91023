"""Hard negatives against every pair scored."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexaudit.llm import negatives, queries


def vectors(seed=5, n=400, width=8, labels=4):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 1, (labels, width))
    rows = []
    for i in range(n):
        label = int(r.integers(labels))
        rows.append([i, [float(x) for x in centres[label] + r.normal(0, 0.7, width)], label])
    for i in range(100, 180):  # a very common vector, under two labels
        rows[i][1] = list(rows[100][1])
    for i, bad in ((7, None), (13, [None] * width), (14, [float("nan")] * width), (15, [float("inf")] + [0.0] * (width - 1)), (16, [0.0] * width), (17, [])):
        rows[i][1] = bad
    rows[21][2] = None
    return rows + [[None, [1.0] * width, 1], [30, [9.0] * width, 2], rows[31]]


def brute(rows, every, positives=5, k=10, scale=256):
    held = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        x = ([int(np.floor(scale * c)) for c in v], label)
        held[i] = min(held.get(i, x), x)
    width = max(len(v) for v, _ in held.values())
    full = {i: (v + [0] * (width - len(v)), label) for i, (v, label) in held.items()}
    dot = lambda a, b: sum(x * y for x, y in zip(full[a][0], full[b][0], strict=True))
    out = set()
    for a in (i for i in full if i % every == 0):
        near = sorted((i for i in full if i != a and full[i][1] == full[a][1]), key=lambda i: (-dot(a, i), i))[:positives]
        for p in near:
            fits = [i for i in full if full[i][1] != full[a][1] and 30 * dot(a, p) <= 100 * dot(a, i) <= 90 * dot(a, p)]
            for rank, i in enumerate(sorted(fits, key=lambda i: (-dot(a, i), i))[:k]):
                out.add((a, p, rank + 1, i, dot(a, p), dot(a, i)))
    return out


@pytest.mark.parametrize("unit, first, anchors", [(1000, None, 2048), (60, 1, 7)])
def test_mine_against_all_pairs(spark, unit, first, anchors):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for name in ("id", "v", "unit", "window", "score", "rank", "blob", "asked", "floors"):
        df = df.withColumn(name, F.lit("x"))
    got = negatives.mine(df, F.col("vec_id") % 10 == 0, row_unit=unit, first_wave=first, anchor_unit=anchors)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows, 10)


def test_mine_without_rows(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.mine(none, F.lit(True)).count() == 0
    one = spark.createDataFrame([(100, [1.0], 3)], "vec_id long, embedding array<float>, label int")
    assert negatives.mine(one, F.lit(True)).count() == 0
    assert negatives.mine(one, F.lit(False)).count() == 0


def test_mine_beyond_doubles(spark):
    """Scores between 2**53 and 2**63 that differ by one, as positives and at both ends of the window; larger ones are an error."""
    big = 1 << 30
    rows = [(100, [big, 1], 1), (1, [big, 3], 1), (2, [big, 2], 1), (3, [big - 1, 7], 2), (4, [big * 9 // 10, 0], 2), (5, [big * 9 // 10, 1], 2), (6, [big * 9 // 10, 2], 2), (7, [big * 9 // 10, 4], 2), (8, [big * 3 // 10, 0], 2), (9, [big * 3 // 10 + 1, 0], 2)]
    as_floats = [(i, [float(x) for x in v], label) for i, v, label in rows]
    got = negatives.mine(spark.createDataFrame(as_floats, "vec_id long, embedding array<double>, label int"), F.col("vec_id") == 100, scale=1, row_unit=2, first_wave=1)
    assert {tuple(r) for r in got.collect()} == brute(as_floats, 100, scale=1)
    wide = spark.createDataFrame([(0, [2.0**32], 1), (1, [2.0**32], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="64 bits"):
        negatives.mine(wide, F.lit(True), scale=1).collect()


def test_bounds_hold_and_rule_rows_out():
    r = np.random.default_rng(2)
    rows = np.floor(256 * r.normal(0, 0.3, (3000, 32))).astype(np.int64)
    labels = r.integers(0, 2, 3000)
    index = negatives.Approximation.load(negatives.Approximation(np.arange(3000), labels, rows).dump())
    for query in rows[:5]:
        below, above = index.bounds(query, 0, 3000)
        exact = index.rows.astype(np.int64) @ query
        assert (below <= exact).all() and (exact <= above).all()
        index.search(-1, 1, query, True, np.array([negatives._LEAST]), np.array([negatives._MOST]), 5)
        assert index.scored < 300


def test_query_against_all_pairs(spark, data):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 and r.label is not None else r.label) for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert {tuple(r) for r in queries.op11_negatives(spark, data).collect()} == brute(rows, 100)
