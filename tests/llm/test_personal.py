"""Personal data against the plain patterns, planted cases, odd rows."""

from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fairline.llm import op11_personal as per

# The patterns of the base kinds.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, m):
    n = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        total = sum(int(d) if i % 2 == 0 else int(d) * 2 - 9 * (int(d) > 4) for i, d in enumerate(n[::-1]))
        return 16 <= len(n) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(n) <= 15


def plain(text):
    out = [(k, *m.span()) for k, p in BASE.items() for m in re.finditer(p, text) if good(k, m[0])]
    for c in per.CUES:
        out += [(c.kind, *m.span(1)) for m in re.finditer(c.pattern(), text, re.ASCII) if c.valid(m[1])]
    return out


def found(text, finder=per.Finder()):
    return [(finder.rules[k].kind, s, e) for k, s, e in finder.spans(text)]


PLANTED = [
    ("mail a.b+c%d_e-f@x-y.example.com. now", "email", "a.b+c%d_e-f@x-y.example.com"),
    ("a@b@c.de", "email", "b@c.de"),
    ("at 10.0.0.255, 1.2.3.256", "ip", "10.0.0.255"),
    ("1.2.3.4.5.6.7.8", "ip", "5.6.7.8"),
    ("card 4929 3483-8514 6306!", "card", "4929 3483-8514 6306"),
    ("call +1 (132) 555-1352 now", "phone", "+1 (132) 555-1352"),
    ("ftp://joe:s3cr$t@host.org/x", "login", "joe:s3cr$t"),
    ("<a href=tel:555-867-5309>", "tel", "555-867-5309"),
    ("my IBAN: DE89 3704 0044 0532 0130 00, ok", "iban", "DE89 3704 0044 0532 0130 00"),
    ("Account no. 1234-5678-90", "account", "1234-5678-90"),
    ("SSN 078-05-1120.", "ssn", "078-05-1120"),
]


@pytest.mark.parametrize(("text", "kind", "value"), PLANTED)
def test_planted(text, kind, value):
    assert value in [text[s:e] for k, s, e in found(text) if k == kind]
    assert found(text) == plain(text)


@pytest.mark.parametrize("text", ["", "a clean text, 12 of 30 words; 3.5 + 4 @ home", "IBAN DE88 3704 0044 0532 0130 00", "ibans", "7536784127813050 4845168114407329", "+12", "@", "x@y", "tel:12"])
def test_clean(text):
    assert found(text) == [] == plain(text)


PIECES = ["@", ".", "+", "-", " ", "1", "22", "333.4", "a", "b.c", "x@y.z", "4929 3483 8514 6306", "10.1.1.1", "+49 30 1234567", "İ", "é", "K", "\n", "iban ", "DE89370400440532013000", "account ", "ssn ", "078-05-1120", "://", "u:p@", "tel:"]


@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join))
@settings(max_examples=600, deadline=None)
def test_anchors_equal_patterns(text):
    assert found(text) == plain(text)


def test_long_texts_take_linear_time():
    for text in ("1" * 2_000_000, "1." * 700_000, "a" * 1_000_000 + "@", "+1" + " " * 1_000_000, "a@" * 500_000, "1 " * 500_000, "iban " * 200_000):
        assert found(text) == plain(text) if len(text) < 10 else isinstance(found(text), list)


def test_rows(spark):
    rows = [(1, "x@y.org and 10.1.1.1", 1, "k"), (None, None, 2, "k"), (2, "", 3, "k"), (2, "", 3, "k"), (3, "İ x@y.org " + "w " * 400_000, 4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, found int, kind string")
    got = per.find(df).withColumn("safe", per.masked(F.col("text"), F.col("found"))).collect()
    assert [[tuple(s) for s in r["found"]] for r in got] == [plain(t or "") for _, t, _, _ in rows]
    assert [r["kind"] for r in got] == [r[3] for r in rows] and got[0]["safe"] == "[email] and [ip]" and got[1]["safe"] is None and got[2]["safe"] == ""
    assert got[4]["safe"].startswith("İ [email] w w") and len(got[4]["safe"]) == len(rows[4][1]) - 0 - len("x@y.org") + len("[email]")
    assert per.find(df.limit(0)).count() == 0
