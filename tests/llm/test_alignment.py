"""Alignment of two tokenizers against a plain computation with the libraries themselves."""

from __future__ import annotations

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fairline.llm import op12_alignment as ali

A_PATH, B_PATH = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def files():
    return ali.Files.read(A_PATH, B_PATH)


@pytest.fixture(scope="module")
def aligner(files):
    return ali.Aligner(files.a, files.b)


@pytest.fixture(scope="module")
def plain():
    a, b = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a.encode_special_tokens = True
    # the usual table of byte-level letters, by its rule
    shown = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174]
    letters = {chr(x): x for x in shown}
    for n, x in enumerate(x for x in range(256) if x not in shown):
        letters[chr(256 + n)] = x
    a_entry = lambda i: bytes(letters[c] for c in a.id_to_token(i))

    def b_entry(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()

    def tokens(text):
        if not text:
            return [], []
        x, y = [(i, a_entry(i)) for i in a.encode(" " + text, add_special_tokens=False).ids], [(i, b_entry(i)) for i in b.encode(text)]
        whole = (" " + text).encode()
        return (x, y) if b"".join(t for _, t in x) == whole == b"".join(t for _, t in y) else ([], [])

    return tokens


def ranges(tokens):
    at, out = 0, []
    for i, t in tokens:
        out.append((i, at, at + len(t)))
        at += len(t)
    return out


def brute(texts, tokens):
    """Per text (n_a, n_b, n_groups, n_links, groups, n_best, count_sum) by comparing neighbours one by one."""
    rows, held = [], Counter()
    for text in texts:
        x, y = map(ranges, tokens(text))
        links, j0 = [], 0
        for i, s, e in x:
            while j0 < len(y) and y[j0][2] <= s:
                j0 += 1
            j = j0
            while j < len(y) and y[j][1] < e:
                links.append((i, y[j][0]))
                j += 1
        shared = sorted({e for *_, e in x} & {e for *_, e in y})
        parts, low = [], 0
        for end in shared:
            parts.append("|".join(",".join(str(i) for i, _, e in side if low < e <= end) for side in (x, y)) if len(shared) < 400 else None)
            low = end
        rows.append((len(x), len(y), len(shared), links, ";".join(parts) if None not in parts else None))
        held.update(set(links))
    best = {}
    for (i, _), n in held.items():
        best[i] = max(best.get(i, 0), n)
    return [(a, b, g, len(k), t, sum(held[p] == best[p[0]] for p in k), sum(held[p] for p in k)) for a, b, g, k, t in rows]


ODD = [None, "", " ", "a", "  two  spaces ", "tab\tand\nline\r\n", "<|endoftext|> and </s> <s> <unk> <0x41>", "▁ marked ▁▁", "naïve café Übergröße ñandú", "日本語 テキスト", "Русский текст", "😀 emoji 👩‍👩‍👧", "\x00\x01 control", "é combining", "​﻿", "don't they'll I'm", "12345 67,890.12", "x" * 3000, " " * 700 + "end", "A B", "ſtraße K"]


def words(seed, n):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice("abcdeéßñ ,.'\n1") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("piece", [1, 2, 7, 64, ali.PIECE])
def test_pieces_equal_plain(aligner, plain, piece):
    texts = ODD + words(3, 12)
    got = aligner.align(texts, piece)
    want = brute(texts, plain)
    assert list(zip(*(n.tolist() for n in got.numbers()), strict=True)) == [w[:4] for w in want]
    told = got.group_texts(aligner.told, len(aligner.a_bytes))
    assert all(w[4] is None or t == w[4] for t, w in zip(told, want, strict=True))


@given(st.lists(st.integers(1, 5), max_size=40), st.lists(st.integers(1, 5), max_size=40), st.integers(1, 9))
@settings(max_examples=300, deadline=None)
def test_diagonals(a, b, piece):
    more = sum(b) - sum(a)
    a, b = np.cumsum(a + [more + 1] if more >= 0 else a + [1]), np.cumsum(b + [1] if more >= 0 else b + [1 - more])
    at = ali.cuts(a, b, piece)
    assert at[0] == (0, 0) and at[-1] == (len(a), len(b)) and all(0 <= sum(y) - sum(x) <= piece for x, y in zip(at, at[1:], strict=False))
    parts = [ali.overlaps(a, b, x, y) for x, y in zip(at, at[1:], strict=False)]
    links = sorted(zip(*(np.concatenate([p[k] for p in parts]).tolist() for k in (0, 1)), strict=True))
    low = lambda e, i: int(e[i - 1]) if i else 0
    assert links == [(i, j) for i in range(len(a)) for j in range(len(b)) if low(a, i) < b[j] and low(b, j) < a[i]]
    assert sorted(int(a[i]) for p in parts for i in p[2]) == sorted(set(a.tolist()) & set(b.tolist()))


def test_faster_library_gives_the_same_ids(aligner):
    texts = [" " + t for t in ODD if t] + [" " + t for t in words(5, 200)]
    assert aligner.fast is not None
    assert [aligner.encode_a(t) for t in texts] == [aligner.a.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("most_pairs", [1, 300, ali.BLOCK_PAIRS])
def test_documents_equal_plain(spark, files, plain, most_pairs):
    texts = ODD + words(9, 25) + words(9, 5) + ["long text " * 40_000]
    rows = [(None if i == 4 else i // 2, t, i, i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block long, pair long").repartition(3)
    held = ali.blocks(df, files, most_pairs=most_pairs)
    got = sorted([tuple(r) for r in ali.scored(held, ali.pair_counts(held, ali.entries(files))).collect()], key=str)
    want = []
    for (key, *_), w in zip(rows, brute(texts, plain), strict=True):
        want.append((key, *w[:4], w[5], w[6], "" if not w[0] else None if w[4] is None else sha256(w[4].encode()).hexdigest()))
    want.sort(key=lambda r: str(r))
    assert sorted(g[:7] for g in map(tuple, got) if g[0] is not None) == sorted(w[:7] for w in want if w[0] is not None)
    known = {w[7] for w in want} - {None}
    assert known <= {g[7] for g in got} and len(got) == len(rows)
    told = {r["groups"] for r in ali.groups(df, files).collect()}
    assert {sha256(t.encode()).hexdigest() if t else "" for t in told} == {g[7] for g in got}


def test_empty(spark, files):
    held = ali.blocks(spark.createDataFrame([], "doc_id long, text string"), files)
    assert ali.scored(held, ali.pair_counts(held, ali.entries(files))).count() == 0
