"""Hard negatives beside all products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from estatelens.llm import hard_negatives as hn
from estatelens.llm.hard_negatives import Mining, mine_hard_negatives

SCHEMA = "vec_id long, label int, embedding array<float>"


def whole(vec, scale):
    return [math.floor(scale * float(np.float32(x))) for x in vec]


def plain(rows, every, m=Mining()):
    seen, used = set(), []
    for vec_id, label, vec in rows:
        if vec_id is None or label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        row = (vec_id, label, tuple(whole(vec, m.scale)))
        if row not in seen:
            seen.add(row)
            used.append(row)
    out = []
    for a, label, x in used:
        if a % every:
            continue
        scores = [(-sum(p * q for p, q in zip(x, y)), b, other) for b, other, y in used if len(x) == len(y)]
        positives = sorted((s, b) for s, b, other in scores if other == label and b != a)[: m.positives]
        for s, p in positives:
            s = -s
            band = sorted(
                (t, b) for t, b, other in scores if other != label and m.low_percent * s <= -100 * t <= m.high_percent * s
            )
            out += [(a, p, i, b, s, -t) for i, (t, b) in enumerate(band[: m.negatives], 1)]
    return sorted(out)


def mined(spark, rows, every, m=Mining()):
    rows = [(i, n, v if v is None else [x if x is None else float(x) for x in v]) for i, n, v in rows]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("id", "vec", "block", "_salt", "dim", "anchor", "square")})
    return sorted(tuple(r) for r in mine_hard_negatives(df.repartition(3), F.col("vec_id") % every == 0, m).collect())


def vectors(seed, n, dim, labels=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) * rng.choice([0.2, 1, 1, 5], size=(n, 1))
    return [(i, int(rng.integers(labels)), [float(v) for v in x[i]]) for i in range(n)]


def odd_rows():
    nan, inf = float("nan"), float("inf")
    rows = vectors(2, 60, 3)
    rows += [(100, None, [1.0, 1, 1]), (101, 1, None), (102, 1, [nan, 1, 1]), (103, 1, [inf, 0, 0]), (104, 1, [None, 0, 0]), (None, 1, [1.0, 2, 3])]
    rows += [(110, 1, [0.0, 0, 0]), (111, 0, [0.0, 0, 0]), (120, 1, []), (121, 2, []), (122, 1, []), (130, 1, [2.0, 1]), (131, 1, [1.0, 1]), (132, 2, [1.0, 1])]
    rows += [rows[5], rows[5], (rows[5][0], rows[5][1], [3.0, 3, 3]), (140, 2, [1.0, 2, 3]), (141, 2, [1.0, 2, 3]), (142, 1, [1.0, 2, 3])]
    rows += [(150, 1, [1e30, 0, 0]), (151, 1, [-(2.0**20), 3, 2.0**21])]
    return rows


def test_all_products(spark):
    for seed, n, dim in ((1, 300, 8), (3, 200, 2)):
        rows = vectors(seed, n, dim)
        assert mined(spark, rows, 10) == plain(rows, 10) != []


def test_odd_rows(spark):
    rows = odd_rows()
    want = plain([r for r in rows if r[0] != 150], 5)
    assert mined(spark, rows, 5) == want != []
    assert mined(spark, [(1, 1, None)], 1) == []
    assert mined(spark, rows[:1], 1) == []


def test_many_blocks_slabs_and_chunks(spark, monkeypatch):
    for name, value in {"SLAB_ROWS": 16, "BLOCK_VALUES": 256, "CHUNK_ANCHORS": 7}.items():
        monkeypatch.setattr(hn, name, value)
    rows = vectors(4, 500, 6) + [(1000 + i, 1, [1.0, 0.5, 0, 0, 0, 0.25]) for i in range(300)]
    m = Mining(positives=3, negatives=4, low_percent=20, high_percent=95)
    assert mined(spark, rows, 20, m) == plain(rows, 20, m) != []


def test_ranges_let_nothing_slip():
    rng = np.random.default_rng(6)
    for _ in range(200):
        q = rng.normal(size=(1, 5))
        x = rng.normal(size=(50, 5)) * rng.choice([0.01, 1, 30])
        unit = x / np.linalg.norm(x, axis=1)[:, None]
        q /= np.linalg.norm(q)
        cosine = (unit @ q.T)[:, 0]
        least, most = np.sort(rng.uniform(-1, 1, 2))
        begin, end = hn.feasible(q, np.array([least]), np.array([most]))
        inside = ((unit >= begin) & (unit <= end)).all(axis=1)
        assert inside[(cosine >= least) & (cosine <= most)].all()
    # and a narrow band cuts most rows out
    q = np.array([[1.0, 0, 0, 0, 0]])
    begin, end = hn.feasible(q, np.array([0.95]), np.array([1.0]))
    unit = rng.normal(size=(1000, 5))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    assert ((unit >= begin) & (unit <= end)).all(axis=1).mean() < 0.1


def test_slabs_out_of_reach_are_left_out(monkeypatch):
    monkeypatch.setattr(hn, "SLAB_ROWS", 8)
    n = 64
    matrix = np.ones((n, 4), dtype=np.int64) * np.arange(n, 0, -1)[:, None]
    lengths = np.sqrt((matrix.astype(float) ** 2).sum(axis=1))
    slabs = [np.argsort(matrix[a : a + 8] / lengths[a : a + 8, None], axis=0, kind="stable").T.astype(np.uint16) for a in range(0, n, 8)]
    block = hn._Block(hn.pickle.dumps((np.arange(n), ["x"] * n, lengths, matrix, slabs)))
    looked = []
    monkeypatch.setattr(hn, "_products", lambda a, b: looked.append(len(b)) or (a @ b.T))
    low = np.array([4 * 50])
    queries = hn._Queries(np.array([-1]), ["x"], np.ones((1, 4), np.int64), np.array([0]), low, np.array([1 << 62]), True, 3)
    query, ids, scores = block.search(queries)
    assert list(scores) == [256, 252, 248] and list(ids) == [0, 1, 2] and looked == [8]


def test_exact_products_beyond_floating_point():
    rng = random.Random(3)
    a = np.array([[rng.randrange(-(1 << 30), 1 << 30) for _ in range(4)] for _ in range(3)])
    want = [[sum(int(p) * int(q) for p, q in zip(x, y)) for y in a] for x in a]
    assert hn._products(a, a).tolist() == want


@pytest.mark.parametrize("score", [7, 100, 1 << 61, 0, -9])
def test_bands(spark, score):
    s = F.col("s").cast("decimal(20,0)")
    row = spark.range(1).select(F.lit(score).cast("long").alias("s")).select(
        F.ceil(s * 30 / 100).cast("long").alias("a"), F.floor(s * 90 / 100).cast("long").alias("b")
    ).first()
    assert (row.a, row.b) == (-(-score * 30 // 100), score * 90 // 100)
