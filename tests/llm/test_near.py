"""Near-duplicates and components beside all pairs and a plain search."""

import random

import pytest

from estatelens.llm.components import connected_components
from estatelens.llm.minhash import Near, near_duplicates, without_near_duplicates
from tests.llm.brute import near_groups


def family(rng, n, words, edits):
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(edits):
            own[rng.randrange(words)] = f"e{rng.randint(0, 10**6)}"
        out.append(" ".join(own))
    return out


def corpus(seed):
    rng = random.Random(seed)
    texts = [None, "", " \n ", "one", "One", "one two", "two one"]
    texts += family(rng, 30, 120, 1) + family(rng, 25, 120, 3) + family(rng, 25, 60, 2) + family(rng, 20, 200, 6)
    texts += [texts[10]] * 20 + ["A b C d e F"] * 3 + ["a B c D e f"] * 2
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [f"{a} {passage} {b}" for a, b in zip(family(rng, 20, 8, 8), family(rng, 20, 8, 8))]
    texts.append(" ".join(f"long{rng.randint(0, 99)}" for _ in range(20_000)))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("near", [Near(3, 85), Near(5, 80)])
def test_groups(documents, near):
    rows = corpus(near.words)
    want = near_groups(rows, near.words, near.percent)
    got = near_duplicates(documents([*rows, (None, "one two")]), near).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    no_id = [r for r in got if r.doc_id is None]
    assert len(no_id) == 1 and no_id[0].kept and no_id[0].component_id is None


def test_what_stays(documents):
    rows = [(5, "a b c d e f"), (2, "A b c d e f"), (9, "x"), (9, "x"), (None, None), (7, None)]
    df = documents(rows)
    left = without_near_duplicates(df)
    assert left.columns == df.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["2", "7", "9", "9", "None"]
    assert without_near_duplicates(df.where("doc_id > 100")).count() == 0


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 560)]
    pairs += [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(7, 7), (3, None), (4, 4)]
    rng.shuffle(pairs)
    links = {}
    for a, b in pairs:
        if b is not None and a != b:
            links.setdefault(a, set()).add(b)
            links.setdefault(b, set()).add(a)
    want = {}
    for start in sorted(links):
        if start not in want:
            open_ = [start]
            while open_:
                x = open_.pop()
                if x not in want:
                    want[x] = start
                    open_ += links[x]
    df = spark.createDataFrame(pairs, "a long, b long")
    assert {r.node: r.component for r in connected_components(df).collect()} == want
    assert connected_components(df.where("a > 9999")).count() == 0


def test_settings():
    near = Near(3, 85)
    assert (near.bands, near.hashes) == (24, 120) and near.agreeing < 0.85 * near.hashes
    assert (1 - 0.85**near.rows) ** near.bands < 1e-6
