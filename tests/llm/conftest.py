import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed: int = 1) -> list[tuple]:
    """Small documents with copies, near copies, shared passages, repeated rows, nulls, empty and long texts, clashing words."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("aeiouns") for _ in range(r.randint(1, 6))) for _ in range(300)]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage = words(70)
    texts: list = [" ".join(words(r.randint(1, 160))) for _ in range(40)]
    texts += [texts[i] for i in (0, 1, 2, 3, 3, 3)]
    for i in range(12):
        base = texts[i].split()
        for _ in range(max(1, len(base) // 25)):
            base[r.randrange(len(base))] = r.choice(vocabulary)
        texts.append(" ".join(base))
    texts += [" ".join(words(20) + passage + words(r.randint(0, 60))) for _ in range(8)]
    texts += [" ".join(words(n)) for n in (2, 3, 4, 5, 5, 6, 7)]
    texts += ["a b c d", "a b c d e", "A B C D", "a", "a", "", " \n\t", None, None, "x" * 5000, " ".join(["la"] * 300), "\u2003wide\u00a0space é É", "it's <|endoftext|> done", "日本 語 🙂🙂 \x1c x"]
    texts.append(" ".join(words(3000)))
    rows = [(7 * i % 1000, t, ["en", "fr", None][i % 3], f"src{i % 4}" if i % 9 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, texts[5], "en", None, 3)]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in ("id", "block", "key", "n", "k", "hash", "score", "words", "component", "slot"):
        df = df.withColumn(name, F.lit(1))
    return df


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
