"""Storage clauses against a slow character-by-character count."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from estatelens.functions.storage_clause import strip_one, strip_storage_clauses

WORDS = ["DISTRIBUTION", "HEAP", "CLUSTERED", "COLUMNSTORE", "PARTITION"]


def slow(text):
    """Try every place a clause could start, count parentheses, look for a word."""
    removed, out, at = 0, "", 0
    while at < len(text):
        opening = re.compile(r"\bWITH\b\s*\(", re.I).match(text, at)
        if opening:
            depth, end = 1, opening.end()
            while end < len(text) and depth:
                depth += {"(": 1, ")": -1}.get(text[end], 0)
                end += 1
            body = text[opening.end() : end - 1 if not depth else end]
            if any(re.search(rf"\b{w}\b", body, re.I) for w in WORDS):
                removed, at = removed + 1, end
                continue
        out, at = out + text[at], at + 1
    return out, removed


pieces = st.sampled_from(["WITH ", "with", "(", ")", "HEAP", "x", " ", "\n", "PARTITION", "clustered", "_", ",", "Ü"])


@settings(max_examples=1500, deadline=None)
@given(st.lists(pieces, max_size=30).map("".join))
def test_like_the_slow_count(text):
    assert strip_one(text) == slow(text)


def test_known_clauses():
    assert strip_one("A WITH (DISTRIBUTION = HASH(a), HEAP) B") == ("A  B", 1)
    assert strip_one("WITH (x) AS (SELECT 1)") == ("WITH (x) AS (SELECT 1)", 0)
    assert strip_one("FROM t WITH (NOLOCK)") == ("FROM t WITH (NOLOCK)", 0)
    assert strip_one("A WITH (HEAP, (b") == ("A ", 1)
    assert strip_one("WITH (y (WITH (HEAP)))") == ("", 1)


def test_column(frame):
    rows = frame([(1, "t WITH (HEAP)"), (2, "t WITH (NOLOCK)"), (3, None)], "i int, t string")
    got = rows.select("i", strip_storage_clauses(F.col("t")).alias("s")).orderBy("i").collect()
    assert got[0].s.text == "t " and got[0].s.removed == 1
    assert got[1].s is None and got[2].s is None
