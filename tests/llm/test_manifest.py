"""The manifest against a level-by-level computation, its log against a sequential append, odd rows."""

from __future__ import annotations

from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from fairline.llm import op13_manifest as man

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, idx int, chunk int, digest string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, add=0):
    doc_id, source, lang, n_chars, text = row
    values = (doc_id, source, lang, None if n_chars is None else n_chars + add, text)
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    """All levels; a proof per leaf."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    proofs = [[lv[(i >> k) ^ 1] if (i >> k) ^ 1 < len(lv) else None for k, lv in enumerate(levels[:-1])] for i in range(len(nodes))]
    return levels[-1][0], proofs


def fold(node, i, proof):
    for s in proof:
        node = h(node) if s is None else h(s, node) if i & 1 else h(node, s)
        i >>= 1
    return node


def brute(rows, tampered):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    low = {g: tree([leaf(r) for r in groups[g]]) for g in order}
    root, tops = tree([low[g][0] for g in order])
    out = []
    for k, g in enumerate(order):
        sub, proofs = low[g]
        for i, r in enumerate(groups[g]):
            start = leaf(r, 1 if tampered(r) else 0)
            top = fold(fold(start, i, proofs[i]), k, tops[k])
            out.append((r[0], leaf(r), sub, root, "".join(s for s in proofs[i] + tops[k] if s), top))
    return sorted(out, key=str)


def run(spark, rows, height):
    df = spark.createDataFrame([(*r, "t", 1, 2, "d") for r in rows], SCHEMA).repartition(3)
    out = man.manifest(df, altered={"n_chars": F.col("n_chars") + 1}, tampered=F.col("doc_id") % 3 == 0, height=height)
    x = lambda b: bytes(b).hex()
    return sorted([(r["doc_id"], x(r["leaf"]), x(r["subroot"]), x(r["root"]), x(r["proof"]), x(r["folded"])) for r in out.collect()], key=str)


@pytest.mark.parametrize(("height", "count"), [(1, 13), (2, 37), (12, 30)])
def test_manifest_equals_level_by_level(spark, height, count):
    rows = [(i * 7 % 101, f"s{i % 3}", ("en", "de", None, "en", "z")[i * i % 5], None if i % 11 == 0 else i, "é" * i) for i in range(count)]
    got = run(spark, rows, height)
    assert got == brute(rows, lambda r: r[0] % 3 == 0 and r[3] is not None)
    changed = {r[0] for r in rows if r[0] % 3 == 0 and r[3] is not None}
    assert {g[0] for g in got if g[5] != g[3]} == changed


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (5, "", "", 0, ""), (5, "", "", 0, ""), (5, "a", "", 0, "b"), (6, "x", "\U0001f600", -3, "y" * 2_000_000)]
    assert run(spark, rows, 1) == brute(rows, lambda r: r[0] is not None and r[0] % 3 == 0 and r[3] is not None)
    assert run(spark, rows[5:], 2) == brute(rows[5:], lambda r: True)
    assert run(spark, [(9, "b", "only", 1, "t")] * 9, 1) == brute([(9, "b", "only", 1, "t")] * 9, lambda r: True)
    assert run(spark, [], 2) == []


def test_a_group_per_row(spark):
    rows = [(i, "s", f"g{i}", i, "t") for i in range(19)]
    assert run(spark, rows, 1) == brute(rows, lambda r: r[0] % 3 == 0)


@pytest.mark.parametrize(("n", "height"), [(1, 1), (13, 1), (27, 2), (13, 5)])
def test_log_positions(spark, n, height):
    digests = [sha256(bytes([i])).digest() for i in range(n)]
    entries = spark.createDataFrame([("t", i, n, bytearray(d)) for i, d in enumerate(digests)], "tree string, idx long, n long, digest binary")
    rounds = man.build(entries, height, "test-log")
    log = {r["position"]: bytes(r["digest"]) for r in man.append_log(rounds, height).collect()}
    assert [log[i] for i in range(len(log))] == man.grown(digests, man.levels(n))
    for i in range(n):  # a proof straight from the log, by position
        way = b"".join(side + (log[at] if at >= 0 else b"") for side, at in man.siblings(i, n, man.levels(n)))
        assert man.folded(digests[i], way) == bytes(man.roots(rounds, height).first()["digest"])
