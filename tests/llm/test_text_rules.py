"""Secrets, line dedup and quality rules beside their plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from estatelens.llm import line_dedup
from estatelens.llm.line_dedup import Alike, dedup_lines, line_report
from estatelens.llm.quality import Rules, good_documents, quality
from estatelens.llm.secrets import find_secrets, redact
from tests.llm import brute

HEX = "0123456789abcdef"


def secret_rows():
    rng = random.Random(4)
    pool = ["".join(rng.choices(HEX, k=40)) for _ in range(6)]
    texts = [
        None, "", "token = short", "token: api_key: abcdefgh1", "PassWord='Hunter2.Hunter2' x", "🙂é token=\"" + pool[0] + "\" z",
        "AKIA" + "B7" * 8, "AKIAB7 AKIA" + "C9" * 8 + "é", "secret==" + "a" * 20, "x" + pool[1] + "G" + pool[1],
        "AKIA" + "Z" * 6 + "123456" + pool[2], f"api-key apikey : {pool[3]} token={pool[3]}", "a" * 31, "a" * 32,
    ]
    rows = [(i, t, f"s{i % 3}", "en") for i, t in enumerate(texts)]
    rows += [(100 + i, f"pre {i} token = \"{pool[4]}\" post", f"s{i}", "fr") for i in range(30)]
    rows += [(200 + i, f"pre {i} token = \"{pool[5]}\" post", "s1", "fr") for i in range(30)]
    rows += [(5, texts[5], "s2", "en"), (None, f"token={pool[0]}", None, None)]
    rows.append((300, "word " * 20_000 + "token=" + "Q8x_" * 9, "s1", "en"))
    return rows


def test_secrets(documents):
    rows = secret_rows()
    want = []
    for doc, base, added in brute.secrets([(d, s, l, t) for d, t, s, l in rows]):
        n = [sum(s[2] == k for s in base) for k in ("assign", "access", "hex")]
        want.append((str(doc), *n, brute.sha(brute.said(base)), brute.said(sorted(base + added))))
    got = find_secrets(documents(rows)).collect()
    assert sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in got) == sorted(want)
    assert all(any(kind in w[-1] for w in want) for kind in brute.ADDED)
    assert find_secrets(documents(rows).where("doc_id > 9999")).count() == 0


def test_redaction(documents):
    rows = secret_rows()
    found = brute.secrets([(d, s, l, t) for d, t, s, l in rows])
    want = sorted(
        (str(d), None if t is None else brute.masked(t, added)) for (d, t, _, _), (_, _, added) in zip(rows, found)
    )
    df = documents(rows)
    left = redact(df)
    assert left.columns == df.columns
    assert sorted(((str(r.doc_id), r.text) for r in left.collect()), key=str) == sorted(want, key=str)


def test_owners_and_repositories(documents):
    def spread(value, places):
        return [(f"text {i} token={value}", *place) for i, place in enumerate(places)]

    def key(n):
        return f"{n}Zx9k2Qw7Lm4Vb{n}Rt"

    def kind(places, copies=1, value=key(1)):
        rows = [(i, *r) for i, r in enumerate(spread(value, places) * copies)]
        return {r.spans.split(",")[1].split(":")[0] for r in find_secrets(documents(rows)).collect()}

    one_owner = [("a", f"r{i}") for i in range(9)]
    assert kind(one_owner) == {"live"}  # one owner's, in nine of their repositories
    assert kind([("a", "r"), ("b", "r")]) == {"live"}
    assert kind([("a", f"r{i}") for i in range(3)] + [("b", "r")]) == {"live"}
    assert kind([("a", f"r{i}") for i in range(4)] + [("b", "r")]) == {"copied"}
    assert kind([("a", "r"), ("b", "r"), (None, None)]) == {"copied"}
    assert kind([("a", "r")], value="changeme99") == {"unlikely"}
    copies = [(i, f"one text token={key(2)}", f"s{i}", "r") for i in range(5)]  # a text and its copies
    assert {r.n_live for r in find_secrets(documents(copies)).collect()} == {1}


def line_rows():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    base = rng.sample(vocabulary, 30)
    rows = []
    for doc in range(60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            kind = rng.random()
            if kind < 0.3:
                line = list(base)
                for _ in range(rng.randint(0, 8)):
                    line[rng.randrange(30)] = rng.choice(vocabulary)
            elif kind < 0.5:
                line = "the of and to in that is was for on".split()[: rng.randint(4, 10)]
                rng.shuffle(line)
            else:
                line = rng.choices(vocabulary, k=rng.randint(0, 40))
            lines.append(rng.choice([" ", "  ", "\t"]).join(line))
        rows.append((doc, "\n".join(lines)))
    rows += [(900, None), (901, ""), (902, "\n\n"), (903, " ".join(vocabulary * 20))]
    rng.shuffle(rows)
    return rows


def test_line_dedup(documents):
    rows = line_rows()
    want = brute.line_dedup(rows)
    df = documents([*rows, (None, rows[0][1])])
    left = dedup_lines(df)
    assert left.columns == df.columns
    got = left.collect()
    assert {r.doc_id: r.text for r in got if r.doc_id is not None} == want
    assert [r.text for r in got if r.doc_id is None] == [rows[0][1]]
    assert any(want[d] != t for d, t in rows)


def test_line_report(documents):
    rows = [(1, "a b c d e\nq"), (2, "a b c d e f\n\nx y"), (2, "a b c d e f\n\nx y"), (3, None), (4, "e d c b a")]
    got = sorted((r.doc_id, r.n_lines, r.n_removed, r.text) for r in line_report(documents(rows)).collect() if r.doc_id != 3)
    assert got == [(1, 2, 0, "a b c d e\nq"), (2, 3, 1, "\nx y"), (2, 3, 1, "\nx y"), (4, 1, 1, "")]
    assert line_report(documents(rows).where("doc_id > 10"), Alike()).count() == 0


def test_equal_lines_meet_in_one_shuffle(spark):
    rows = [(d, i, 5, 7 if d % 2 else 100 + d * 3 + i, [1], d, 0) for d in range(40, 0, -1) for i in range(3)]
    rows += [(50, 0, 5, 103, [1], 1, 0), (2, 0, 5, 106, [1], 2, 0), (1, 0, 5, 7, [1], 1, 0)]
    slim = spark.createDataFrame(rows, "doc_id long, line int, n int, set long, prefix array<long>, low long, high long")
    placed = line_dedup._with_first(slim)
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(set") == 1 and "SortAggregate" not in plan
    found = placed.collect()
    # the set 7 is held by most lines: some deals of it, each with a first line that meets the others later
    firsts = [r for r in found if not r.again]
    assert sum(r.set == 7 for r in firsts) > 1 and all(r.dealt for r in firsts if r.set == 7)
    assert min((r.doc_id, r.line) for r in firsts if r.set == 7) == (1, 0)
    at = [(r.doc_id, r.line) for r in found]
    assert len(at) == len(set(at)) and set(at) == {r[:2] for r in rows}


def test_many_copies_of_a_line(documents):
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rows = [(d, " ".join(words[d % 8 :] + words[: d % 8]) + f"\nown{d} line{d} of{d} the{d}") for d in range(90)]
    rows += [(200, " ".join([*words, "iota"])), (201, " ".join(words[:4]))]
    assert {r.doc_id: r.text for r in line_report(documents(rows)).collect()} == brute.line_dedup(rows)


def test_codes_put_rare_words_first(documents):
    rows = [(d, "often often now") for d in range(9)] + [(10, "now seldom often")]
    docs = documents(rows)
    turns = line_dedup.rarity(docs)
    coded = docs.where("doc_id = 10").select(line_dedup._codes(F.col("text"), turns).alias("codes"))
    # the rank takes one xor, nothing is shifted or masked word by word
    assert "shiftleft" not in coded._jdf.queryExecution().analyzed().toString()
    hashes = {w: v for w, v in docs.sparkSession.sql(
        "select w, xxhash64(w) & 281474976710655 from values ('seldom'), ('now'), ('often') v(w)").collect()}
    assert [c & ((1 << 48) - 1) for c in coded.first().codes] == [hashes[w] for w in ("seldom", "now", "often")]


def quality_rows():
    rng = random.Random(8)

    def text(n):
        return "\n".join(" ".join(f"v{rng.randint(0, 999)}" for _ in range(12)) for _ in range(n))

    rows = [(i, text(rng.randint(1, 9)), f"h{i % 2}") for i in range(60)]
    rows = [(d, t + "\nSubscribe to   our LETTER today" if d % 3 else t, h) for d, t, h in rows]
    rows += [(100 + i, rows[5][1], "h1") for i in range(40)]  # copies are one document
    heavy = "\n".join(" ".join(f"Heavy{i}x{j}" for j in range(12)) for i in range(8))
    rows += [(200 + i, f"{heavy}\nown words {i} here", "h0") for i in range(25)]
    rows += [(300, None, "h0"), (301, "", None), (302, " \n\t", "h1"), (303, "a b c " * 40, "h1"), (304, "x# *y|<z>", None)]
    rows += [(None, text(8), "h1"), (7, rows[7][1], rows[7][2]), (305, text(3000), "h1")]
    return rows


def test_quality(documents):
    rows = quality_rows()
    want = brute.quality([(d, h, t) for d, t, h in rows])
    got = quality(documents(rows)).collect()
    assert sorted(
        (str(r.doc_id), (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words), r.base_failed, r.kept, r.n_removed_words)
        for r in got
    ) == sorted((str(d), *w) for d, *w, _ in want)
    assert any(not failed and not kept for _, _, failed, kept, _, _ in want)
    assert all(kept for d, _, failed, kept, _, _ in want if d is not None and 100 <= d < 200 and not failed)
    assert quality(documents(rows).where("doc_id > 9999"), Rules()).count() == 0


@pytest.mark.parametrize("n", [2, 3, 19, 20, 1000])
def test_lines_of_hosts_of_every_size(documents, n):
    own = [" ".join(f"own{d}x{j}" for j in range(60)) for d in range(n)]
    rows = [(d, f"{own[d]}\nall of us SAY this", "h", "en") for d in range(n)]
    left = {r.text for r in good_documents(documents(rows)).collect()}
    assert left == (set(own) if n > 2 else {r[1] for r in rows})
    just = n // 10  # a tenth of the texts is within the limit
    rows = [(d, own[d] + "\nsaid here" * (d < just), "h", "en") for d in range(n)]
    assert {r.text for r in good_documents(documents(rows)).collect()} == {r[1] for r in rows}


def test_good_documents(documents):
    rows = quality_rows()
    want = brute.quality([(d, h, t) for d, t, h in rows])
    df = documents(rows)
    left = good_documents(df)
    assert left.columns == df.columns
    assert sorted((str(r.doc_id), r.text) for r in left.collect()) == sorted((str(d), t) for d, _, _, kept, _, t in want if kept)
