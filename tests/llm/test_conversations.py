"""Conversation repair beside a search through all repairs."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from estatelens.llm.conversations import Costs, Search, audit_conversations, damage, repair_conversations

SHAPE = re.compile("(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string"


def faults(rows):
    """Rows of (turn, role, text) in order -> their faults."""
    out, seen = [], set()
    for _, role, text in rows:
        last = re.sub("[\x20\x09-\x0d]", "", text)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else None if last in ".!?" else "truncated")
        seen.add((role, text))
    return out


def repairs(rows, found, costs, most_inserts=2):
    """All well-formed repairs as (cost, edits, rows), by trying every edit of every row."""
    choices = []
    for (_, role, text), fault in zip(rows, found):
        extra = costs.truncated if fault == "truncated" else 0
        some = [(costs.delete, "D", [])]
        if fault not in ("blank", "duplicate"):
            some.append((extra, "K", [(role, text)]))
            some += [(extra + costs.rerole, "R", [(r, text)]) for r in ("user", "assistant")]
        choices.append(some)
    inserts = [
        (costs.insert * n, "I" * n, [(r, "") for r in roles])
        for n in range(most_inserts + 1)
        for roles in itertools.product(("user", "assistant"), repeat=n)
    ]
    slots = [inserts]
    for some in choices:
        slots += [some, inserts]
    for picks in itertools.product(*slots):
        made = [r for p in picks for r in p[2]]
        if SHAPE.fullmatch("".join(r[:1] or "-" for r, _ in made)):
            yield sum(p[0] for p in picks), "".join(p[1] for p in picks), made


def searched(rows, found, costs):
    edits = []
    carry = lambda carried, role, text: (*carried, (role, text))
    search = Search(costs, lambda edit, at: edits.append(edit), (), carry)
    widest = 0
    for (_, role, text), fault in zip(rows, found):
        search.row(role, text, fault)
        widest = max(widest, search.undecided())
    cost, made = search.finish()
    return (cost, "".join(edits), list(made)), widest


def walked(rows, found, costs):
    """The cheapest repair with whole lists kept in every state, for conversations of any length."""
    kept = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    coming = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def grown(best):
        for _ in range(3):
            for state, (cost, edits, made) in list(best.items()):
                to = coming[state]
                new = (cost + costs.insert, edits + "I", [*made, (names[to], "")])
                best[to] = min(best.get(to, new), new, key=lambda b: b[:2])
        return best

    best = grown({"": (0, "", [])})
    for (_, role, text), fault in zip(rows, found):
        now = {}
        extra = costs.truncated if fault == "truncated" else 0

        def offer(to, new):
            now[to] = min(now.get(to, new), new, key=lambda b: b[:2])

        for state, (cost, edits, made) in best.items():
            offer(state, (cost + costs.delete, edits + "D", made))
            if fault in ("blank", "duplicate"):
                continue
            if (state, role[:1]) in kept:
                offer(kept[state, role[:1]], (cost + extra, edits + "K", [*made, (role, text)]))
            to = coming[state]
            offer(to, (cost + extra + costs.rerole, edits + "R", [*made, (names[to], text)]))
        best = grown(now)
    return min((best[s] for s in ("", "a") if s in best), key=lambda b: b[:2])


def conversation(rng, n):
    roles = ["user", "assistant", "system", " ", "u", "tool"]
    texts = ["Yes.", "No!", "so", " ", "", "Why?\n", "end…", "a"]
    return [(i, rng.choice(roles[: rng.choice([2, 3, 6])]), rng.choice(texts)) for i in range(n)]


@pytest.mark.parametrize("costs", [Costs(), Costs(1, 3, 1, 2), Costs(0, 1, 1, 0), Costs(2, 2, 2, 2)])
def test_cheapest_repair_of_all(costs):
    rng = random.Random(8)
    for _ in range(60):
        rows = conversation(rng, rng.randint(0, 3))
        found = faults(rows)
        want = min(repairs(rows, found, costs), key=lambda r: r[:2])
        got, _ = searched(rows, found, costs)
        assert got == want


@pytest.mark.parametrize("costs", [Costs(), Costs(1, 3, 1, 2), Costs(0, 1, 1, 0), Costs(2, 2, 2, 2)])
def test_long_conversations(costs):
    rng = random.Random(9)
    for _ in range(60):
        rows = conversation(rng, rng.randint(5, 60))
        found = [f if rng.random() < 0.5 else None for f in faults(rows)]
        got, _ = searched(rows, found, costs)
        assert got == walked(rows, found, costs)


def test_only_undecided_edits_stay():
    rows = [(i, ("user", "assistant")[i % 2], f"text {i}.") for i in range(3000)]
    (cost, edits, _), widest = searched(rows, [None] * 3000, Costs())
    assert (cost, edits) == (0, "K" * 3000) and widest < 10
    # rows without a usable role tie from the first one on: all of it stays undecided, and is still right
    rows = [(i, " ", f"text {i}.") for i in range(301)]
    (cost, edits, _), _ = searched(rows, [None] * 301, Costs())
    assert (cost, edits) == (302, "D" + "R" * 300)


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        mine = out.setdefault(conv, [])
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        mine += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def told(rows, costs=Costs()):
    found = faults(rows)
    turns = sorted({t for t, _, _ in rows if t is not None})
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, edits, made = walked(rows, found, costs)
    text = "\n".join(f"{r}:{t}" for r, t in made)
    gaps = turns[-1] - turns[0] + 1 - len(turns) if turns else 0
    counts = [found.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, edits, hashlib.sha256(text.encode()).hexdigest())


def table(rng):
    rows = []
    for conv in range(60):
        rows += [(conv, t + t // 5, r, x) for t, r, x in conversation(rng, rng.randint(1, 9))]
    rows += [(200, t, ("user", "assistant")[t % 2], "Same.") for t in range(300)]
    rows += [(201, None, "user", "Hm."), (201, None, None, None), (201, 4, "assistant", "x" * 300_000 + ".")]
    rows += [(None, 1, "user", "A."), (None, 2, "assistant", "B."), (202, 3, "user", "A."), (202, 3, "user", "A."), (202, 3, "a", "A.")]
    rows += [(203, t, r, "I see.") for t, r in ((2, "user"), (5, "assistant"))]
    return rows


def test_audit(spark):
    rows = table(random.Random(10))
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("conv", "digest", "rank", "at", "fault", "there", "_salt")})
    got = audit_conversations(damage(df.repartition(3)), there_col="there").collect()
    want = {c: told(r) for c, r in damaged(rows).items()}
    assert {r.conv_id: tuple(r)[1:] for r in got} == want and len(got) == len(want)
    assert damage(df.where("turn < 0")).count() == 0
    assert audit_conversations(df.where("turn < 0")).count() == 0


def test_repaired_rows(spark):
    rows = table(random.Random(11))
    got = {}
    for r in sorted(repair_conversations(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect(), key=lambda r: (str(r.conv_id), r.step)):
        got.setdefault(r.conv_id, []).append((r.role, r.text))
        assert r.step == len(got[r.conv_id]) - 1
    for conv in {r[0] for r in rows}:
        mine = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        mine.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        assert got.get(conv, []) == walked(mine, faults(mine), Costs())[2]


def test_costs_that_make_no_sense():
    with pytest.raises(ValueError):
        Costs(insert=0)
