"""Alignment of tokenizers against groups cut at common byte offsets."""

import collections
import hashlib

import public_tokenizers
import pytest

from lexaudit.llm import alignment
from lexaudit.llm.queries import tokenizer_path

PATHS = tokenizer_path(), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def brute_groups(text, libraries):
    """Groups of ids between offsets where tokens of both sides end."""
    a, b = libraries
    if not text:
        return []
    said = a.encode(" " + text, add_special_tokens=False)
    decode = lambda ids: a.decode(ids, skip_special_tokens=False)
    if decode(said.ids) != " " + text:
        return []
    byte = alignment.byte_characters()
    left = [(i, bytes(byte[c] for c in t)) for i, t in zip(said.ids, said.tokens, strict=True)]
    right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    if b"".join(x for _, x in left) != b"".join(x for _, x in right):
        return []
    ends = []
    for side in (left, right):
        at, found = 0, {}
        for k, (_, x) in enumerate(side):
            at += len(x)
            found[at] = k + 1
        ends.append(found)
    out, i, j = [], 0, 0
    for at in sorted(ends[0].keys() & ends[1].keys()):
        m, n = ends[0][at], ends[1][at]
        out.append(([x for x, _ in left[i:m]], [x for x, _ in right[j:n]]))
        i, j = m, n
    return out


def brute(rows, libraries):
    found = [(d, brute_groups(t, libraries)) for d, t, *_ in rows]
    count = collections.Counter((a[-1], b[-1]) for _, g in found for a, b in g)
    highest = collections.Counter()
    for (_, b), n in count.items():
        highest[b] = max(highest[b], n)
    out = collections.Counter()
    for d, g in found:
        links = [(a[-1], b[-1]) for a, b in g]
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        out[d, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(count[x] == highest[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if g else ""] += 1
    return out


ODD = ["<|endoftext|> <s> <unk> <0x41>", "a▁b", "  two  spaces ", "tab\tnew\n\nline", "日本語 \U0001f642\U0001f642é́", "\x00nul", " ", "1234567 $$$ it's", "ไทย नमस्ते"]


def test_summaries_against_offsets(spark, docs, rows, nothing, libraries):
    odd = [(900 + i, t, None, None, None) for i, t in enumerate(ODD)]
    more = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    got = alignment.summaries(more, *PATHS, block_bytes=3000)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = brute(rows + odd, libraries)
    assert collections.Counter(tuple(r) for r in got.collect()) == want
    assert sum(1 for x in want if x[0] and x[0] >= 900 and x[1] == 0) == 1  # U+2581 is written as a space
    assert alignment.summaries(nothing, *PATHS).count() == 0


def test_groups(docs, rows, libraries):
    got = collections.Counter((r.doc_id, str([(g.a, g.b) for g in r.groups])) for r in alignment.groups(docs, *PATHS).collect())
    assert got == collections.Counter((d, str(brute_groups(t, libraries))) for d, t, *_ in rows)


def test_transducer_refuses_other_bytes():
    t = alignment.Transducer([b"ab", b"c", b"abc"], [b"a", b"bc", b"d"])
    assert t.ends([0, 1], [0, 1]) == ([2], [2])
    assert t.ends([2, 0, 1], [0, 1, 0, 1]) == ([1, 3], [2, 4])
    assert t.ends([0, 1], [0, 2]) is None and t.ends([0], [0]) is None and t.ends([0, 1], [0, 1, 0]) is None
    assert t.ends([], []) == ([], [])
    moves = dict(t.moves)
    assert t.ends([0, 1], [0, 1]) == ([2], [2]) and t.moves == moves  # remembered


def test_a_forgetful_transducer_gives_the_same(monkeypatch, libraries):
    pair = alignment.Pair(*PATHS)
    texts = ["some words here", "other words there", "some words here"]
    want = list(pair.align(texts))
    monkeypatch.setattr(alignment, "MOST_REMEMBERED", 3)
    assert list(pair.align(texts)) == want and len(pair.transducer.moves) > 0
