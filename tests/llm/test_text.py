"""Encoding, substring removal, near duplicates and quality rules against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from lexaudit.llm import bpe, divergence, neardup, substrings
from lexaudit.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {i: i + 32 for i in range(65, 91)}
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_codec_splits_and_decodes_like_the_library(library):
    codec = bpe.load(tokenizer_path())
    texts = ["".join(map(chr, [*range(1, 0x250)])), "a'S b's  c\u00a0\u2003d", "  x\n\n y ", "<|endoftext|>a<|endoftext|>", "Ünïcödé 123½ ²", "\x1c\x1d a\x85b"]
    r = random.Random(3)
    texts += ["".join(chr(r.randrange(1, 0x250)) for _ in range(40)) for _ in range(300)] + ["".join(r.choice("ab '1!\n\t\u00a0語🙂") for _ in range(30)) for _ in range(300)]
    for t in texts:
        ids = np.frombuffer(b"".join(codec.encode_words(codec.words(t))), codec.kind).tolist()
        assert ids == library.encode(t, add_special_tokens=False).ids
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_round_trip(docs, rows, nothing, library):
    got = collections.Counter(tuple(r) for r in bpe.round_trip(docs, tokenizer_path()).collect())
    want = collections.Counter()
    for d, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[d, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))] += 1
    assert got == want
    assert bpe.round_trip(nothing, tokenizer_path()).count() == 0


def test_small_blocks_and_joins_give_the_same(docs, rows, monkeypatch):
    """Words that many blocks share are encoded once and go back to each; documents longer than what is joined at once."""
    docs = docs.repartition(25)
    whole = collections.Counter(tuple(r) for r in bpe.round_trip(docs.coalesce(1), tokenizer_path()).collect())
    assert collections.Counter(tuple(r) for r in bpe.round_trip(docs, tokenizer_path(), block_bytes=500).collect()) == whole
    held = bpe.blocks(docs.selectExpr("doc_id AS id", "text"), tokenizer_path(), 500)
    assert held.count() > 20 and held.selectExpr("sum(size(words)) AS n").first().n == bpe.encoded_words(held, tokenizer_path()).count()
    codec = bpe.load(tokenizer_path())
    known = bpe._from_strings(bpe._strings([b"", b"a" * 300, "é".encode()]))
    assert known[0].tolist() == [0, 300, 2] and known[1] == b"a" * 300 + "é".encode()
    numbers = np.array([0, 1, 255, 256, 70_000, 2**31])
    assert (bpe._from_planes(bpe._planes(numbers)) == numbers).all()
    numbers = np.append(numbers[:-1], np.random.default_rng(1).integers(0, 1 << np.arange(1, 32), (50, 31)).ravel())
    assert (bpe._from_by_length(bpe._by_length(numbers)) == numbers).all() and len(bpe._from_by_length(bpe._by_length(numbers[:0]))) == 0
    ids = np.array([0, 5, 50256, 7])
    assert bpe.joined(codec.piece_column, ids, np.array([0, 3, 3, 4])) == [b"", b"".join(codec.pieces[i] for i in (0, 5, 50256)), b"", codec.pieces[7]]


def test_settings_that_are_not_followed_are_refused(tmp_path):
    import json

    import public_tokenizers

    with pytest.raises(ValueError, match="normalizer"):
        bpe.Codec(public_tokenizers.path("word_bpe_49k.json"))
    plain = json.load(open(tokenizer_path(), encoding="utf-8"))
    plain["pre_tokenizer"]["add_prefix_space"] = True
    plain["added_tokens"][0]["lstrip"] = True
    (tmp_path / "t.json").write_text(json.dumps(plain))
    with pytest.raises(ValueError, match="pre_tokenizer, added token"):
        bpe.Codec(str(tmp_path / "t.json"))


def test_encode_decode(docs, rows):
    back = bpe.decode(bpe.encode(docs, tokenizer_path()), tokenizer_path())
    assert collections.Counter((r.doc_id, r.text) for r in back.collect()) == collections.Counter((d, t or "") for d, t, *_ in rows)


def brute_repeats(rows, window=50):
    least = {}
    for d, t, *_ in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - window + 1) if d is not None else ():
            least[tuple(w[i : i + window])] = min(d, least.get(tuple(w[i : i + window]), d))
    out = collections.Counter()
    for d, t, *_ in rows:
        w, gone = WORD.findall(t or ""), set()
        for i in range(len(w) - window + 1) if d is not None else ():
            if least[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out[d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))] += 1
    return out


def test_repeats(docs, rows, nothing):
    found = substrings.repeats(docs)
    assert collections.Counter(tuple(r) for r in found.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == brute_repeats(rows)
    assert found.where("n_removed > 0").count() > 8
    assert substrings.repeats(nothing).count() == 0


def test_cover_is_a_difference_cover():
    differences = {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER}
    assert differences == set(range(substrings.PERIOD))


def shingles(text, n=2):
    w = WORD.findall((text or "").translate(FOLD))
    return set(zip(*(w[i:] for i in range(n)), strict=False)) if len(w) >= n else ({tuple(w)} if w else set())


def brute_groups(pairs, percent=80):
    """pairs: (id, set); the smallest id reachable of each id."""
    ids = sorted({d for d, s in pairs})
    root = {d: d for d in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, (a, x) in enumerate(pairs):
        for b, y in pairs[:i]:
            shared = len(x & y)
            if x and y and 100 * shared >= percent * (len(x) + len(y) - shared):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: find(d) for d in ids}


@pytest.mark.parametrize("n", [2, 5])
def test_groups(docs, rows, nothing, n):
    sets = [(d, shingles(t, n)) for d, t, *_ in rows if d is not None]
    want = brute_groups(sets)
    got = neardup.groups(docs, n).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter((d, len(shingles(t, n))) for d, t, *_ in rows)
    assert collections.Counter((r.doc_id, r.n_shingles) for r in got) == sizes
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
        assert r.kept == (r.doc_id is None or want[r.doc_id] == r.doc_id)
    assert sum(d != c for d, c in want.items()) > 8
    assert neardup.groups(nothing, n).count() == 0


def test_small_sets_share_a_list():
    """Every pair of small sets that is alike by 0.8 gets a key in common, whatever the order of hashes."""
    r = np.random.default_rng(5)
    for _ in range(3000):
        union = np.sort(r.integers(1, 1 << 63, r.integers(5, 30), dtype=np.uint64))
        lost = r.permutation(len(union))[: len(union) // 5]
        side = r.random(len(lost)) < 0.5
        sets = [np.delete(union, lost[side]), np.delete(union, lost[~side])]
        keys = [set(neardup.run_keys(x, np.array([0, len(x)]), neardup.K)[0].tolist()) for x in sets]
        shared = len(keys[0] & keys[1])
        if len(sets[0]) != len(sets[1]) or (sets[0] != sets[1]).any():
            assert shared >= 1 + (len(union) >= neardup.SMALL_SET), (sets, shared)


def test_links_within_finds_the_same_groups_as_all_pairs():
    r = np.random.default_rng(2)
    base = [np.sort(r.integers(1, 1 << 63, 150, dtype=np.uint64)) for _ in range(6)]
    sets = []
    for i in range(150):
        keep = r.random(150) > r.choice([0.02, 0.08, 0.15])
        sets.append(np.unique(np.concatenate([base[i % 6][keep], r.integers(1, 1 << 63, int((~keep).sum()), dtype=np.uint64)])))
    bounds = np.append(0, np.cumsum([len(x) for x in sets]))
    want = brute_groups([(i, set(x.tolist())) for i, x in enumerate(sets)])
    root = list(range(150))
    for a, b in neardup.links_within(np.arange(150), np.concatenate(sets), bounds, 80):
        lo, hi = sorted((root[a], root[b]))
        root = [lo if x == hi else x for x in root]
    least = {x: min(i for i in range(150) if root[i] == x) for x in set(root)}
    assert [least[x] for x in root] == [want[i] for i in range(150)]


def test_long_lists_and_many_parts(spark):
    """Lists beyond LONG_LIST and components of several parts give the same groups."""
    r = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(r.choice([0, 2, 5, 9])):
            words[r.randrange(120)] = f"x{r.random()}"
        rows.append((i, " ".join(words)))
    words = list(base)
    for i in range(90, 190):  # a chain of links away from the first text, and texts half like it
        for _ in range(5):
            words[r.randrange(120)] = f"y{r.random()}"
        rows.append((i, " ".join(words)))
    for i in range(190, 230):
        rows.append((i, " ".join(base[:60] + [f"z{r.random()}" if r.random() < 0.2 else f"q{j}" for j in range(60)])))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_groups([(d, shingles(t)) for d, t in rows])
    assert len(set(want.values())) > 5
    for part in (16, 4096):
        assert {r.doc_id: r.component_id for r in neardup.groups(df, part=part).collect()} == want


def test_stars_link_hubs_with_their_like():
    a = np.arange(10, 110, dtype=np.uint64)
    sets = [a, np.append(a[:90], a[:10] + np.uint64(1000)), a[:79], a[:80], a + np.uint64(500)]
    held = [(5, 5, sets[0]), (1, 5, sets[1]), (2, 5, sets[2]), (3, 5, sets[3]), (4, 9, sets[4]), (9, 9, sets[4]), (7, 8, sets[0])]
    bounds = np.append(0, np.cumsum([len(x) for *_, x in held]))
    got = neardup.star_links(np.array([h[0] for h in held]), np.array([h[1] for h in held]), np.concatenate([h[2] for h in held]), bounds, 80)
    assert sorted(got) == [(5, 1), (5, 3), (9, 4)]


def brute_rules(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    twice = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(twice), len(w) < 10 or 100 * len(twice) > 20 * len(w)


def test_rules(spark, docs, rows, nothing):
    extra = [(5000, "a b c d e f a b c d e f\nx\nx\n \n \nx", "en", "s", 1), (5001, "#*$ % & | <> a-b\nc\rd\x0be", "en", "s", 1), (5002, "q w e r t y u i o p a s d f g h\n" * 3, "en", "s", 1)]
    df = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(extra, docs.select("doc_id", "text", "lang", "source", "n_chars").schema))
    got = divergence.judge(df)
    base = got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert collections.Counter(tuple(r) for r in base.collect()) == collections.Counter((d, *brute_rules(t)) for d, t, *_ in [*rows, *extra])
    assert got.where("base_failed and kept").count() == 0
    assert divergence.judge(nothing).count() == 0


def test_distance_is_jensen_shannon(spark):
    from pyspark.sql import functions as F

    p, q = np.array([5, 0, 3, 2]), [1, 4, 0, 5]
    a, b = p / p.sum(), np.array(q) / sum(q)
    m = (a + b) / 2
    kl = lambda x: sum(u * np.log2(u / v) for u, v in zip(x, m, strict=True) if u)
    df = spark.createDataFrame([(p.tolist(), int(p.sum()))], "c array<long>, t long")
    got = df.select(divergence.distance(F.col("c"), F.col("t"), q)).first()[0]
    assert got == pytest.approx(np.sqrt((kl(a) + kl(b)) / 2))


def test_rules_reject_what_is_far_from_every_language(spark):
    clean = "the people of this town and their friends walk to the market in the morning for bread and milk that is fresh "
    shouted = clean.upper()
    rows = [(i, " ".join(random.Random(i).sample(clean.split() * 8, 120)), "en") for i in range(30)] + [(99, " ".join(random.Random(99).sample(shouted.split() * 8, 120)), None)]
    got = {r.doc_id: r.kept for r in divergence.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i] for i in range(30)) and not got[99]


def test_a_language_without_reference_is_not_judged_by_distance(spark):
    """Common words are listed for four languages; text in a fifth fails by the base rules alone."""
    english = "the people of this town and their friends walk to the market in the morning for bread and milk that is fresh ".split()
    italian = "gli abitanti della città camminano ogni mattina verso il mercato dove comprano pane fresco latte frutta e poi tornano insieme alle loro case ".split()
    mixed = lambda words, i: " ".join(random.Random(i).sample(words * 8, 150))
    rows = [(i, mixed(english, i), "en") for i in range(30)] + [(90, mixed(italian, 90), "it"), (91, mixed(italian, 91), None), (92, "tre parole sole", "it"), (93, "uno due " * 80, "it")]
    got = {r.doc_id: r for r in divergence.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].kept for i in range(30)) and got[90].kept and got[90].word_distance > 0.26
    assert not got[91].kept and not got[92].kept and not got[93].kept


def test_rules_reject_long_texts_with_few_common_words(spark):
    """Guarded by the words of a text, not by the common ones found: none at all is the farthest case."""
    draw = lambda seed, n, common: " ".join(r.choice(("the", "of", "and", "to", "in", "is")) if r.random() < common else "".join(r.choice("bdeilmnorst") for _ in range(6)) for r in [random.Random(seed)] for _ in range(n))
    rows = [(i, draw(i, 200, 0.4), "en") for i in range(30)] + [(90, draw(90, 300, 0.0), None), (91, draw(91, 300, 0.05), None), (92, draw(92, 60, 0.0), None)]
    got = {r.doc_id: r for r in divergence.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].kept for i in range(30)) and got[92].kept
    assert not got[90].kept and not got[91].kept and got[90].word_distance > got[91].word_distance > 0.26


def test_a_row_that_shares_its_id_with_a_copy_is_judged_on_its_own_text(spark):
    one, two, tail = (" ".join(f"{p}{i}" for i in range(60)) for p in "abc")
    rows = [(1, one), (2, two), (3, one), (3, f"{two} {tail}"), (4, tail)]
    got = {(r.doc_id, r.n_words): r.n_removed for r in substrings.repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert got == {(1, 60): 0, (2, 60): 0, (3, 60): 60, (3, 120): 60, (4, 60): 60}


@pytest.mark.parametrize("shared", [0, 3])
def test_blocks_of_which_nothing_repeats(spark, shared):
    """shared: so many rows of the first block hold one passage; no row of the second holds any of it."""
    import corpus_pipeline

    draw = lambda seed, n: " ".join(str(random.Random(f"{seed} {i}").randrange(10**9)) for i in range(n))
    rows = [(i, f"{draw('all', 70)} {draw(i, 30)}" if i < shared else draw(i, 100)) for i in range(5)] + [(i, t) for i, t in enumerate([draw(8, 120), "too short", "", None, draw(9, 50)], 5)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "doc_id long, text string")
    found = substrings.repeats(docs)
    assert collections.Counter(tuple(r) for r in found.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == brute_repeats(rows)
    assert found.where("n_removed > 0").count() == max(shared - 1, 0)
    left = {r.doc_id: r.text for r in corpus_pipeline.substring_dedup(spark, docs, "").collect()}
    assert left == {d: t if not 0 < d < shared else draw(d, 30) for d, t in rows}


def test_packing_numbers_takes_little_memory_beside_them():
    import tracemalloc

    for some in (np.zeros(0, np.int64), np.array([0, 1, 2, 3, 70000, 2**31 - 1]), np.random.default_rng(3).integers(0, 1 << 17, 200_003)):
        assert (bpe._from_by_length(bpe._by_length(some)) == some).all()
    x = np.random.default_rng(1).integers(0, 1 << 17, 1_000_000)
    tracemalloc.start()
    told = bpe._by_length(x)
    packing = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    bpe._from_by_length(told)
    unpacking = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert packing < 40 << 20 and unpacking < 60 << 20, (packing >> 20, unpacking >> 20)
