"""Decontamination, Jaccard groups and embeddings against brute force, with the odd cases."""

from __future__ import annotations

import random

import numpy as np
import pytest

from fairline.llm import op1_decontaminate as leak
from fairline.llm import op3_jaccard as jac
from fairline.llm import op7_embeddings as emb
from fairline.llm.common import components, shingle_hashes, word_hashes

DOCS = "doc_id long, text string, n int, set_id string, item string, token string, comp int"


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, 1, "x", "y", "z", 2) for i, t in rows], DOCS)


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def groups(rows):
    sets = {i: shingles(t) for i, t in rows}
    low = {i: i for i in sets}
    while True:
        before = dict(low)
        for a in sets:
            for b in sets:
                inter = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * inter >= 80 * (len(sets[a]) + len(sets[b]) - inter):
                    low[a] = low[b] = min(low[a], low[b])
        if low == before:
            return {i: (len(sets[i]), low[i]) for i in sets}


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 90))) for _ in range(12)]
    rows = []
    for i in range(n):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        text = " ".join(words)
        rows.append((i * 3 + 1, text + (" " + passage if rng.random() < 0.3 else "")))
    return rows + [(1000, ""), (1001, None), (1002, " \t\n"), (1003, "One two"), (1004, "one  TWO"), (1005, "one"), (1006, passage)]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_groups_equal_brute_force(spark, seed):
    rows = corpus(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jac.jaccard_groups(frame(spark, rows), block_rows=8).collect()}
    assert got == groups(rows)


def test_jaccard_odd_rows(spark):
    text = "a b c d e f g"
    out = sorted(map(str, jac.jaccard_groups(frame(spark, [(5, text), (5, text), (None, text), (2, text), (None, None), (9, None)])).select("doc_id", "n_shingles", "component_id").collect()))
    want = [(5, 3, 2), (5, 3, 2), (None, 3, None), (2, 3, 2), (None, 0, None), (9, 0, 9)]
    assert out == sorted(f"Row(doc_id={a}, n_shingles={b}, component_id={c})" for a, b, c in want)
    assert jac.jaccard_groups(frame(spark, [])).count() == 0


def test_copy_without_id_before_near_copies(spark):
    words = [f"w{i}" for i in range(60)]
    text, near = " ".join(words), " ".join([*words[:-1], "other"])
    rows = [(None, text), (7, text), (3, near)]
    out = jac.jaccard_groups(frame(spark, rows).coalesce(1)).collect()
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in out) == [("3", 3), ("7", 3), ("None", None)]


def test_hot_ngrams_are_salted_and_still_found(spark):
    """All documents nearly equal: every prefix n-gram is frequent, all are one group."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(300):
        w = list(base)
        w[rng.randrange(100)] = f"x{i}"
        rows.append((i, " ".join(w)))
    assert {r["component_id"] for r in jac.jaccard_groups(frame(spark, rows)).collect()} == {0}


def test_a_pair_leaves_once_however_many_ngrams_it_shares(spark):
    rng = random.Random(6)
    alike = {i: (set(range(300)), i, 100) for i in range(20)}  # all share all n-grams, each in a component of its own
    mixed = {100 + i: (set(rng.sample(range(1000, 1040), 12)), i % 5, rng.choice([50, 60, 90])) for i in range(30)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for sets, block_rows in ((alike, 2048), (alike, 6), (mixed, 2048), (mixed, 6)):
            rows = spark.createDataFrame([(t, i, c) for i, (ts, c, _) in sets.items() for t in ts], "token long, set_id long, comp long")
            nodes = spark.createDataFrame([(i, n, bytearray(64)) for i, (_, _, n) in sets.items()], "set_id long, n long, fold binary")
            got = [(r["a"], r["b"]) for r in jac._pairs(rows, nodes, 80, block_rows).collect()]
            want = {(i, j) for i, (x, c, n) in sets.items() for j, (y, d, m) in sets.items() if i < j and x & y and c != d and 100 * min(n, m) >= 80 * max(n, m)}
            assert set(got) == want and want
            if sets is alike:
                assert len(got) == len(want)  # before, once a task
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_long_text_hashes_equal_short_pieces():
    text = "ab cd\tef\x0bgh " * 700_000  # over one piece
    assert len(word_hashes(text)) == 4 * 700_000 and len(shingle_hashes(text)) == 4
    assert len(word_hashes("x" * 5_000_000)) == 1 and len(shingle_hashes("a b c")) == 1


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(500, 560)] + [(700, b) for b in range(701, 760)]
    low = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in low.items() if any(k in e and e[0] != e[1] for e in edges)}


def test_containment_equals_brute_force(spark):
    rows = corpus(7)
    rng = random.Random(8)
    items = []
    for j in range(40):
        w = (rng.choice(rows[:100])[1]).split()
        a = rng.randrange(max(1, len(w) - 12))
        cut = w[a : a + rng.randint(1, 40)]
        if j % 3 == 0:
            cut[rng.randrange(len(cut))] = "other"
        items.append((j, " ".join(cut).upper() if j % 4 == 0 else "  " + "\n".join(cut)))
    items += [(90, None), (91, ""), (92, "  "), (0, items[0][1]), (None, items[1][1])]
    got = sorted(map(str, ((r["doc_id"], r["item_id"], r["n_shingles"], r["n_shared"]) for r in leak.contained(frame(spark, rows + [rows[0], (None, rows[1][1])]), spark.createDataFrame(items, "item_id long, text string"), most_broadcast=10**6).collect())))
    want = []
    for d, t in rows + [rows[0], (None, rows[1][1])]:
        for i, u in items:
            a, b = shingles(t), shingles(u)
            if b and a and 100 * len(a & b) >= 80 * len(b):
                want.append(str((d, i, len(b), len(a & b))))
    assert got == sorted(want)


def test_containment_without_broadcast_and_empty(spark):
    rows = corpus(7)[:40]
    items = spark.createDataFrame([(j, t) for j, (_, t) in enumerate(rows[:10])], "item_id long, text string")
    a = leak.contained(frame(spark, rows), items).collect()
    assert sorted(map(str, a)) == sorted(map(str, leak.contained(frame(spark, rows), items, most_broadcast=0).collect())) and len(a) >= 10
    assert leak.contained(frame(spark, []), items).count() == 0
    assert leak.contained(frame(spark, rows), items.limit(0)).count() == 0


def vectors(seed=1, n=600, dim=24):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(0, n // 2):
        j = rng.integers(n // 2, n)
        x[i] = x[j] + rng.normal(size=dim) * rng.choice([0.1, 0.3, 0.45])
    return x.astype(np.float32)


def test_embedding_recall_and_no_false_link(spark):
    x = vectors()
    rows = [(i, [float(v) for v in r], 0, "c") for i, r in enumerate(x)]
    got = {r["vec_id"]: r for r in emb.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, node int, code string")).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    link = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    found = sum(r["n_links"] for r in got.values())
    assert all(got[i]["n_links"] <= link[i].sum() for i in range(len(x))) and found >= 0.9 * link.sum() > 100
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_embedding_odd_rows_and_hot_copies(spark):
    v, w = [1.0, 2.0, 3.0], [3.0, -1.0, 0.5]
    rows = [(i, v) for i in range(10, 60)] + [(60, [2.0, 4.0, 6.0]), (61, w), (62, None), (63, []), (64, [0.0, 0.0, 0.0]), (65, [1.0, None, 2.0]), (66, [1.0, float("nan"), 2.0]), (67, [float("inf"), 1.0, 1.0]), (None, v), (61, w), (68, [1.0, 2.0])]
    got = emb.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block_rows=4).collect()
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    assert len(got) == len(rows) and by[10] == [(50, 10, True)] and by[60] == [(50, 10, False)] and by[61] == [(1, 61, True)] * 2
    assert all(by[i] == [(0, i, True)] for i in range(62, 69)) and by[None] == [(0, None, False)]
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert emb.near_duplicates(empty).count() == 0


def test_vectors_of_each_length_link_among_themselves(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(60)] + [(100, [1.0, 0.0]), (101, [2.0, 0.0]), (102, [0.0, 1.0]), (103, [3.0]), (104, [-3.0])]
    rows += [(200 + i, (np.eye(5)[i % 5] + rng.normal(size=5) * 0.05).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block_rows in (16, 1024):
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in emb.near_duplicates(df, block_rows=block_rows).collect()}
        cos = lambda x, y: np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)
        links = {i: sum(j != i and len(x) == len(y) and cos(x, y) >= 0.9 for j, y in rows) for i, x in rows}
        assert got[100] == (1, 100) and got[101] == (1, 100) and got[103] == (0, 103)
        if block_rows == 1024:
            assert {i: n for i, (n, _) in got.items()} == links
        assert sum(n for n, _ in got.values()) >= 0.9 * sum(links.values())


def test_tables_go_after_their_last_reader(spark, tmp_path, monkeypatch):
    from fairline.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "more"])), (3, " ".join(words)), (4, "of its own"), (None, " ".join(words)), (5, None)]
    out = jac.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r["component_id"] for r in out.collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, None: None, 5: 5}
    left = {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()}
    assert "jaccard-nodes" in left and not left & {"jaccard-sketch", "jaccard-sets", "jaccard-shared", "jaccard-hubs", "jaccard-weights"}
    assert sum(p.name.startswith("cc-") for p in tmp_path.iterdir()) == 2  # the last round of either call
