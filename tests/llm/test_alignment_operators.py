"""Token alignment against brute force over whole texts, whatever the ranges, and the monoid's law."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from turnloom.llm import token_alignment as A
from turnloom.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, row long, a string, chunk long"
ODD = [
    None, "", " ", "a", "two  spaces and   three", " leading", "trailing ", "tab\there", "line\nfeed\n\nand more,\nand.\nThe", "<|endoftext|> </s> <s> <unk>", "▁lower block", "café   nbsp  x", "。你好, 世界 \U0001f600\U0001f468‍\U0001f469",
    "é ñ it's they'll 12345 3.14, x.", "\x00\x01﻿", "!!!,,, ... a,b a, b. c", "same text", "same text", " em space  x", "CamelCase_and-dashes/slashes  \n  x",
]


@pytest.fixture(scope="module")
def vocabularies():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t, SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))


def groups_of(vocabularies, text):
    first, second = vocabularies
    if not text:
        return []
    level = A._bytes_of_level()
    a = [(i, bytes(level[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()) for i in second.encode(text)]
    whole = (" " + text).encode()
    if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
        return []
    ends = lambda tokens: np.cumsum([len(x) for _, x in tokens]).tolist()
    ea, eb = ends(a), ends(b)
    met = sorted(set(ea) & set(eb))
    out = [([], []) for _ in met]
    for side, tokens, e in ((0, a, ea), (1, b, eb)):
        for (i, _), at in zip(tokens, e, strict=True):
            out[int(np.searchsorted(met, at))][side].append(i)
    return out


def brute(vocabularies, docs):
    groups = [groups_of(vocabularies, t) for _, t in docs]
    links = [Counter((a, b) for x, y in g for a in x for b in y) for g in groups]
    n_docs = Counter(p for c in links for p in c)
    best = defaultdict(int)
    for (a, _), n in n_docs.items():
        best[a] = max(best[a], n)
    rows = []
    for (key, _), g, c in zip(docs, groups, links, strict=True):
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g)
        rows.append((
            key, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(c.values()), sum(n for p, n in c.items() if n_docs[p] == best[p[0]]), sum(n * n_docs[p] for p, n in c.items()), hashlib.sha256(said.encode()).hexdigest() if g else "",
        ))
    return sorted(rows, key=str), {p: (n, n == best[p[0]]) for p, n in n_docs.items()}


def texts():
    rng = random.Random(5)
    words = [*"the cat Sat, on a mat. and; DOG's über été don't 2024 你好 \U0001f600 foo_bar http://x.example/a?b=1".split(), "\n", "  ", " ", "ab\ncd", "x,\ny", " "]
    made = [" ".join(rng.choices(words, k=rng.randint(1, 120))) for _ in range(40)]
    return [*ODD, *made, "long " * 3000 + "end.", "nospaceatall" * 400, " ".join(rng.choices(words, k=4000)), "你好\U0001f600" * 500, "bad ▁ " + "x y " * 2000]


@pytest.mark.parametrize(("chunk", "head"), [(A.CHUNK, A.HEAD), (97, 20)])
def test_alignment_equals_brute_force(spark, vocabularies, chunk, head):
    docs = [(i % 60 if i else None, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], SCHEMA)
    aligned = A.align(df, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), chunk=chunk)
    pairs = A.pair_counts(aligned)
    rows, counts = brute(vocabularies, docs)
    assert {(r.a_id, r.b_id): (r.n_docs, r.best) for r in pairs.collect()} == counts
    got = sorted((tuple(r) for r in A.link_statistics(aligned, pairs, head).collect()), key=str)
    assert got == rows


def test_empty_table(spark):
    aligned = A.align(spark.createDataFrame([], SCHEMA), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    assert A.link_statistics(aligned, A.pair_counts(aligned)).count() == 0


def test_composing_is_associative_and_equals_the_whole(vocabularies):
    pair, rng = A.Pair(vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")), random.Random(2)
    for text in texts():
        if not text or not groups_of(vocabularies, text):
            continue
        t = b" " + text.encode()
        (a,), (b,), _ = pair.encode([t])
        at = sorted({0, len(t), *(rng.randint(0, len(t)) for _ in range(9))})
        parts = [A.fragment(pair, a, b, lo, hi) for lo, hi in zip(at, at[1:])]
        k = rng.randint(1, len(parts))
        right = A.compose([A.compose(parts[:k]), *([A.compose(parts[k:])] if parts[k:] else [])])
        for one in (A.compose(parts), right):
            whole = A.closed(one)
            assert [len(x) for x in groups_of(vocabularies, text)] == [2] * len(whole["na"])
            sa, sb = np.cumsum(whole["na"]), np.cumsum(whole["nb"])
            assert [(x.tolist(), y.tolist()) for x, y in zip(np.split(whole["a"], sa[:-1]), np.split(whole["b"], sb[:-1]), strict=True)] == groups_of(vocabularies, text)


def test_large_groups_are_counted_by_distinct_ids(monkeypatch):
    rng = np.random.default_rng(1)
    na, nb = np.array([30, 1, 25]), np.array([20, 2, 40])
    a, b, doc = rng.integers(0, 9, na.sum()), rng.integers(0, 9, nb.sum()), np.array([0, 0, 1])
    want = A._links(a, b, na, nb, doc)
    monkeypatch.setattr(A, "LARGE", 10)
    assert all((x == y).all() for x, y in zip(A._links(a, b, na, nb, doc), want, strict=True))


def test_links_by_one_sort_are_those_of_every_group(monkeypatch):
    """Ids that fit one number with their document are sorted once, and never made unique twice; wider ones give the same."""
    rng = np.random.default_rng(3)
    for most, groups in ((9, 0), (9, 200), (50_000, 300), (1 << 31, 300)):
        na, nb, doc = rng.integers(1, 5, groups), rng.integers(1, 5, groups), np.sort(rng.integers(0, 7, groups))
        a, b = rng.integers(0, most, na.sum()), rng.integers(0, most, nb.sum())
        want, i, j = {}, 0, 0
        for d, m, n in zip(doc.tolist(), na.tolist(), nb.tolist(), strict=True):
            for x in a[i : i + m].tolist():
                for y in b[j : j + n].tolist():
                    want[d, x << 32 | y] = want.get((d, x << 32 | y), 0) + 1
            i, j = i + m, j + n
        with monkeypatch.context() as m:
            if most < 1 << 31:
                m.setattr(A.np, "unique", lambda *a, **b: pytest.fail("not sorted once"))
            got = list(zip(*(x.tolist() for x in A._links(a, b, na, nb, doc)), strict=True))
        assert got == [(*k, n) for k, n in sorted(want.items())]
