"""Benchmark decontamination beside a plain search for every window."""

import random
import re

import pytest
from pyspark.sql import functions as F

from estatelens.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text, items, window):
    """(n_words, n_hit, sorted ids of items met)."""
    w, hit, met = words(text), set(), set()
    for item, item_text in items:
        v = words(item_text)
        k = min(window, len(v))
        for j in range(len(v) - k + 1 if k else 0):
            for i in range(len(w) - k + 1):
                if w[i : i + k] == v[j : j + k]:
                    hit.update(range(i, i + k))
                    met.add(item)
    return len(w), len(hit), sorted(str(m) for m in met if m is not None)


def rows_of(seed, docs, items, letters="abc"):
    rng = random.Random(seed)

    def text(most):
        return "".join(rng.choice(letters + "É") + rng.choice([" ", " ", ", ", "\n", "_"]) for _ in range(rng.randint(0, most)))

    tests = [(i, text(14)) for i in range(items)]
    made = []
    for i in range(docs):
        parts = [text(20)]
        if rng.random() < 0.5:
            parts.append(rng.choice(tests)[1].upper())
        made.append((i, " ".join([*parts, text(9)])))
    return made, tests


@pytest.fixture
def tables(spark):
    def make(docs, items):
        a = spark.createDataFrame(docs, "doc_id long, text string").withColumns(
            {c: F.lit("x") for c in ("found", "found_", "text_digest", "found_items", "digest", "item_id")}
        )
        b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("y"))
        return a.repartition(3), b

    return make


@pytest.mark.parametrize("block_words", [dc.BLOCK_WORDS, 60])
def test_finds(tables, block_words):
    docs, items = rows_of(1, 60, 25)
    docs += [(3, docs[3][1]), (3, "other a b c"), (None, items[4][1]), (900, None), (901, ""), (902, " \n.,_ ")]
    docs += [(903, "a b c a " * 3000 + items[2][1])]
    items += [(70, None), (71, ""), (72, "b"), (73, "b"), (7, items[7][1]), (7, "É a"), (None, "a c É b"), (74, "..")]
    window = 4
    got = dc.find_contamination(*tables(docs, items), window=window, block_words=block_words).collect()
    want = sorted((str(d), *plain(t, items, window)) for d, t in docs if d != 903)
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in got if r.doc_id != 903) == want
    for r in got:
        assert sum(s["end"] - s["first"] for s in r.spans) == r.n_hit
        assert all(a["end"] < b["first"] for a, b in zip(r.spans, r.spans[1:]) if block_words == 60) or block_words > 60
    assert any(r.n_hit for r in got) and len(got) == len(docs)


def test_long_items_are_cut_in_overlapping_pieces(tables, monkeypatch):
    monkeypatch.setattr(dc, "PIECE_WORDS", 7)
    docs, _ = rows_of(2, 10, 1, letters="abcdefgh")
    long = " ".join(f"w{i}" for i in range(100))
    docs += [(50 + i, "x " + " ".join(f"w{j}" for j in range(i, i + 12)) + " y") for i in range(0, 88, 3)]
    items = [(1, long), (2, "w5 w6 w7")]
    got = dc.find_contamination(*tables(docs, items), window=5, block_words=40).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got) == sorted((d, *plain(t, items, 5)) for d, t in docs)


def test_longest_match_is_tracked(tables):
    item = " ".join(f"w{i}" for i in range(30))
    docs = [(1, "x " + item + " y"), (2, " ".join(f"w{i}" for i in range(4, 16))), (3, "w0 w1 w2 w4 w5")]
    got = {r.doc_id: r.longest for r in dc.find_contamination(*tables(docs, [(1, item)]), window=10).collect()}
    assert got == {1: 30, 2: 12, 3: 0}


@pytest.mark.parametrize("block_words", [dc.BLOCK_WORDS, 30])
def test_removal(tables, block_words):
    item = " ".join(f"W{i}" for i in range(12))
    clean = "one, two. three four\nfive six  seven eight é nine ten eleven twelve thirteen fourteen"
    docs = [
        (1, clean), (2, f"{clean}\n{item.lower()}! {clean}"), (3, f"a {item} b"), (4, None), (5, ""), (6, f"{clean} {item}"),
        (7, f"{clean} short item {clean}"), (8, f"{item[:-4]}. {clean} {clean} 12"),
    ]
    items = [(1, item), (2, "Short, item"), (3, "q " * 40)]
    df, tests = tables(docs, items)
    got = {r.doc_id: r.text for r in dc.decontaminate(df, tests, block_words=block_words).collect()}
    assert dc.decontaminate(df, tests, block_words=block_words).columns == df.columns
    assert got == {
        1: clean, 2: f"{clean}\n! {clean}", 4: None, 5: "", 6: f"{clean} ", 7: f"{clean}  {clean}", 8: f". {clean} {clean} 12",
    }
    longer = dc.Limits(length=12, coverage_percent=90)
    got = {r.doc_id: r.text for r in dc.decontaminate(df, tests, longer, block_words=block_words).collect()}
    assert got[8] == docs[7][1] and got[3] == "a  b" and got[7] == f"{clean}  {clean}"


def test_empty_tables(tables):
    docs, items = rows_of(3, 5, 4)
    df, tests = tables(docs, items)
    assert dc.find_contamination(df.where("doc_id < 0"), tests).count() == 0
    got = dc.find_contamination(df, tests.where("item_id < 0")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"], r.spans) for r in got) == [(d, len(words(t)), 0, [], []) for d, t in docs]
    assert dc.decontaminate(df, tests.where("item_id < 0")).count() == len(docs)


def test_long_texts_are_streamed(monkeypatch):
    monkeypatch.setattr(dc, "STRETCH", 5)
    rng = random.Random(5)
    items = [(i, " ".join(rng.choices("abc", k=rng.randint(1, 9)))) for i in range(12)]
    pieces = [(str(i), len(t.split()) < 4, t.encode().split()) for i, t in items]
    scanner = dc.Scanner(dc.automaton(pieces, 4), 4)
    for _ in range(50):
        text = " ".join(rng.choices(["a", "b", "c", "long"], k=60))
        n, met, spans = scanner.scan(text.encode())
        assert (n, sum(e - f for f, e, *_ in spans), met) == plain(text, items, 4)
