"""Hard-negative mining with coordinate pruning in length buckets.

For an anchor, its positives are the rows of its label with the largest inner products. For each positive,
hard negatives are rows of other labels whose inner product with the anchor lies in a band below that of
the positive. Both are searches for large inner products above a threshold, in the manner of LEMP
(Teflioudi, Gemulla, Mykytiuk 2015):

* Rows are dealt into length buckets, whose longest and shortest vectors differ by a tenth at most, large
  ones over several blocks by a hash. A block keeps its rows by falling length in slabs; each slab has for
  every coordinate of its unit vectors the list of rows sorted by that coordinate.
* A threshold on the inner product and the slab's lengths bound the cosine. Along the anchor's largest, its
  *focus* coordinates, the bound leaves a range of feasible values: a unit vector at angle ``f`` to the axis
  can only be within ``g`` of an anchor at angle ``a`` to it if ``|f - a| <= g``. The range is cut out of the
  sorted list by two binary searches, and the rows in the ranges of all focus coordinates are the candidates.
* Candidates are verified with exact integer inner products. What is found raises the threshold for the
  slabs that follow; a slab whose longest vector cannot reach it is left out as a whole.

Components are whole numbers, ``floor(scale * x)``; all scores are exact. Anchors travel in chunks of fixed
size and meet every block once, as a query set against all rows, in blocks: a task holds one block and one
chunk, and gives at most ``k`` rows for each query, which a ranked window merges.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatelens.operators.skew import spread_join
from estatelens.session import durable

#: Numbers in a block, so that its size does not depend on the length of vectors.
BLOCK_VALUES = 1 << 20
SLAB_ROWS = 1024
CHUNK_ANCHORS = 256
FOCUS = 4
#: Squared length from which on scores might not fit 64 bits.
LONGEST = 2.0**62
#: Slack of the feasible ranges, far above rounding errors of unit vectors; it only lets more rows in.
SLACK = 1e-6


@dataclass(frozen=True)
class Mining:
    """How many positives and negatives, and the band of negatives in percent of the positive's score."""

    positives: int = 5
    negatives: int = 10
    low_percent: int = 30
    high_percent: int = 90
    scale: int = 256


# --- rows, blocks and chunks ------------------------------------------------------------------------------


def _usable(vectors: DataFrame, id_col: str, label_col: str, vector_col: str, anchor: Column, scale: int) -> DataFrame:
    """(id, label, vec, square, dim, is_anchor) of the rows that take part, equal rows once."""
    x = F.col("x")
    whole = F.transform("x", lambda v: F.floor(v * scale))
    square = F.aggregate("vec", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (
        vectors.select(
            F.col(f"`{id_col}`").cast("long").alias("id"),
            F.col(f"`{label_col}`").cast("string").alias("label"),
            F.col(f"`{vector_col}`").cast("array<double>").alias("x"),
            F.coalesce(anchor, F.lit(False)).alias("is_anchor"),
        )
        .where(F.col("id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & finite)
        .select("id", "label", whole.alias("vec"), "is_anchor")
        .withColumn("square", square)
        .where(F.col("square") < LONGEST)
        .withColumn("dim", F.size("vec"))
        .dropDuplicates(["id", "label", "vec", "is_anchor"])
    )


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` with ``block``, numbered from 0 within their dimension, and ``blocks``, how many there are.

    The table of buckets has a few hundred rows a dimension, however many rows there are.
    """
    # lengths in steps of 10 %, that is squares in steps of 21 %
    bucket = F.when(F.col("square") > 0, -F.floor(F.log("square") / F.log(F.lit(1.21)))).otherwise(F.lit(1 << 20))
    rows = rows.withColumn("bucket", bucket.cast("int"))
    most = F.greatest(F.lit(SLAB_ROWS), F.floor(F.lit(BLOCK_VALUES) / F.greatest("dim", F.lit(1))))
    counts = rows.groupBy("dim", "bucket").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / most))
    by_dim = Window.partitionBy("dim")
    placed = counts.select(
        "dim",
        "bucket",
        "parts",
        (F.sum("parts").over(by_dim.orderBy("bucket")) - F.col("parts")).alias("first"),
        F.sum("parts").over(by_dim).alias("blocks"),
    )
    part = F.pmod(F.xxhash64("id", "label", "vec"), F.col("parts"))
    joined = spread_join(rows, durable(placed), ["dim", "bucket"])
    return joined.withColumn("block", (F.col("first") + part).cast("long")).drop("bucket", "parts", "first")


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    parts = [chunk.flatten().to_numpy(zero_copy_only=False) for chunk in column.chunks]
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return flat.reshape(len(column), dim)


def _unit(matrix: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return matrix / np.where(lengths > 0, lengths, 1.0)[:, None]


def _pack_block(key: tuple, table: pa.Table) -> pa.Table:
    """One row with everything about a block: rows by falling length, and each slab's sorted coordinates."""
    dim, block = (k.as_py() for k in key)
    matrix = _matrix(table.column("vec"), dim)
    ids = table.column("id").to_numpy()
    labels = np.array(table.column("label").to_pylist(), dtype=object)
    lengths = np.sqrt(table.column("square").to_numpy())
    order = np.lexsort((ids, -lengths))
    matrix, ids, labels, lengths = matrix[order], ids[order], labels[order], lengths[order]
    unit = _unit(matrix, lengths)
    slabs = [
        np.argsort(unit[at : at + SLAB_ROWS], axis=0, kind="stable").T.astype(np.uint16)
        for at in range(0, len(ids), SLAB_ROWS)
    ]
    small = np.abs(matrix).max(initial=0) < 1 << 31
    data = pickle.dumps((ids, labels.tolist(), lengths, matrix.astype(np.int32) if small else matrix, slabs), 5)
    return pa.table({"dim": pa.array([dim], pa.int32()), "block": pa.array([block], pa.int64()), "data": pa.array([data], pa.binary())})


# --- the search -------------------------------------------------------------------------------------------


@dataclass
class _Queries:
    """Anchors of one chunk, and what is looked for: query ``j`` belongs to anchor ``of[j]``.

    Its scores have to reach ``low[j]`` and must not exceed ``high[j]``.
    """

    ids: np.ndarray
    labels: list
    matrix: np.ndarray
    of: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same_label: bool
    k: int


def feasible(q: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of a unit vector along an axis on which the anchor has ``q``.

    ``least`` and ``most`` bound the cosine between the two; ``q`` may have further axes behind theirs.
    """
    shape = (-1,) + (1,) * (q.ndim - 1)
    a = np.arccos(np.clip(q, -1, 1))
    near = np.arccos(np.clip(least, -1, 1)).reshape(shape)
    far = np.arccos(np.clip(most, -1, 1)).reshape(shape)
    widest = np.minimum(np.minimum(np.pi, a + near), np.minimum(np.pi, 2 * np.pi - far - a))
    narrowest = np.maximum(np.maximum(0, a - near), np.maximum(0, far - a))
    return np.cos(widest) - SLACK, np.cos(narrowest) + SLACK


def _bounds(low, high, lengths, shortest, longest):
    """Bounds of the cosine of vectors of the slab whose product lies in ``low`` … ``high``; none for zero vectors."""
    with np.errstate(divide="ignore", invalid="ignore"):
        least = np.where(low > 0, low / (lengths * longest), low / (lengths * shortest))
        most = np.where(high > 0, high / (lengths * shortest), high / (lengths * longest))
    open_ = (lengths == 0) | (shortest == 0)
    return np.where(open_ | np.isnan(least), -1.0, least), np.where(open_ | np.isnan(most), 1.0, most)


class _Block:
    def __init__(self, data: bytes):
        self.ids, labels, self.lengths, self.matrix, self.slabs = pickle.loads(data)
        self.names = {name: code for code, name in enumerate(sorted(set(labels)))}
        self.codes = np.array([self.names[name] for name in labels], dtype=np.int64)

    def search(self, queries: _Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of the first ``k`` rows of each query in this block."""
        anchors = queries.matrix
        lengths = np.sqrt((anchors.astype(np.float64) ** 2).sum(axis=1))
        unit = _unit(anchors, lengths)
        focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
        along = np.take_along_axis(unit, focus, axis=1)
        mine = np.array([self.names.get(name, -1) for name in queries.labels], dtype=np.int64)
        least = queries.low.copy()
        pool = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        for number, lists in enumerate(self.slabs):
            rows = slice(number * SLAB_ROWS, number * SLAB_ROWS + lists.shape[1])
            pool = self._slab(queries, rows, lists, lengths, focus, along, mine, least, pool)
        return pool

    def _slab(self, queries, rows, lists, lengths, focus, along, mine, least, pool):
        longest, shortest = self.lengths[rows.start], self.lengths[rows.stop - 1]
        low = np.full(len(lengths), np.inf)
        np.minimum.at(low, queries.of, least.astype(np.float64))
        high = np.full(len(lengths), -np.inf)
        np.maximum.at(high, queries.of, queries.high.astype(np.float64))
        reach = lengths * longest * (1 + SLACK)
        wanted = np.flatnonzero((reach >= low) & (-reach <= high))
        if not len(wanted):
            return pool
        floor, ceiling = _bounds(low[wanted], high[wanted], lengths[wanted], shortest, longest)
        begin, end = feasible(along[wanted], floor, ceiling)
        candidates = self._candidates(rows, lists, focus[wanted], begin, end)
        scores = _products(queries.matrix[wanted], self.matrix[rows])
        place = np.full(len(lengths), -1)
        place[wanted] = np.arange(len(wanted))
        at = np.flatnonzero(place[queries.of] >= 0)
        anchor = queries.of[at]
        score = scores[place[anchor]]
        fits = candidates[place[anchor]] & (score >= least[at, None]) & (score <= queries.high[at, None])
        same = self.codes[rows][None, :] == mine[anchor][:, None]
        if queries.same_label:
            fits &= same & (self.ids[rows][None, :] != queries.ids[anchor][:, None])
        else:
            fits &= ~same
        q, r = np.nonzero(fits)
        found = (at[q], self.ids[rows][r], score[q, r])
        pool = tuple(np.concatenate(pair) for pair in zip(pool, found))
        return _first(pool, queries.k, least)

    def _candidates(self, rows, lists, focus, begin, end) -> np.ndarray:
        """Rows of the slab that lie in the feasible ranges of all focus coordinates, by anchor."""
        unit = _unit(self.matrix[rows], self.lengths[rows])
        in_order = np.take_along_axis(unit.T, lists.astype(np.int64), axis=1)
        out = np.zeros((len(focus), lists.shape[1]), dtype=bool)
        for i, axes in enumerate(focus):
            ranges = []
            for axis, a, b in zip(axes, begin[i], end[i]):
                first, last = np.searchsorted(in_order[axis], (a, b))
                ranges.append((last - first, axis, first, last))
            ranges.sort()
            if not ranges or ranges[0][0] == lists.shape[1]:
                out[i] = True
                continue
            _, axis, first, last = ranges[0]
            out[i, lists[axis, first:last]] = True
            for size, axis, first, last in ranges[1:]:
                if size < lists.shape[1]:
                    out[i, lists[axis, :first]] = False
                    out[i, lists[axis, last:]] = False
        return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers; in floating point where that is exact, being quicker."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if top < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _first(pool, k: int, least: np.ndarray):
    """The first ``k`` of each query: larger scores, then smaller ids. Raises ``least`` to the last of k."""
    query, ids, scores = pool
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    starts = np.searchsorted(query, query)
    nth = np.arange(len(query)) - starts
    full = nth == k - 1
    least[query[full]] = np.maximum(least[query[full]], scores[full])
    kept = nth < k
    return query[kept], ids[kept], scores[kept]


FOUND = "anchor long, query long, id long, score long"


def _search(blocks: DataFrame, chunks: DataFrame, mining: Mining, same_label: bool) -> DataFrame:
    """(anchor, query, id, score): candidates of every block for every query, ``chunks`` holding the queries."""

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * 4
        if left.num_rows and right.num_rows:
            keys, ids, labels, matrix, of, tags, low, high = pickle.loads(right.column("data")[0].as_py())
            k = mining.positives if same_label else mining.negatives
            queries = _Queries(ids, labels, matrix, of, low, high, same_label, k)
            query, found, score = _Block(left.column("data")[0].as_py()).search(queries)
            out = [keys[of[query]], tags[query], found, score]
        names = ["anchor", "query", "id", "score"]
        return pa.table({name: pa.array(column, pa.int64()) for name, column in zip(names, out)})

    keys = ["dim", "block", "chunk"]
    left = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).select(*keys, "data")
    right = chunks.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(*keys, "data")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, FOUND)


def _pack_chunk(key: tuple, table: pa.Table) -> pa.Table:
    """One row with all queries of a chunk of anchors; ``wanted`` lists (tag, low, high) of an anchor's queries."""
    dim, chunk, blocks = (k.as_py() for k in key)
    wanted = table.column("wanted").to_pylist()
    of = np.array([i for i, some in enumerate(wanted) for _ in some], dtype=np.int64)
    flat = [w for some in wanted for w in some]
    tags, low, high = (np.array([w[name] for w in flat], dtype=np.int64) for name in ("tag", "low", "high"))
    data = pickle.dumps(
        (
            table.column("anchor").to_numpy(),
            table.column("id").to_numpy(),
            table.column("label").to_pylist(),
            _matrix(table.column("vec"), dim),
            of,
            tags,
            low,
            high,
        ),
        5,
    )
    return pa.table({
        "dim": pa.array([dim], pa.int32()), "chunk": pa.array([chunk], pa.int64()),
        "blocks": pa.array([blocks], pa.int64()), "data": pa.array([data], pa.binary()),
    })


def _chunks(anchors: DataFrame) -> DataFrame:
    """Packed chunks of ``anchors(anchor, id, label, vec, dim, chunk, blocks, wanted)``."""
    kind = "dim int, chunk long, blocks long, data binary"
    return durable(anchors.groupBy("dim", "chunk", "blocks").applyInArrow(_pack_chunk, kind))


_ANY = 1 << 62


def mine_hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    mining: Mining = Mining(),
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), ``rank`` from 1.

    ``is_anchor`` is a condition on the columns of ``vectors``. Ties go by the smaller id. Rows with a null id,
    label or vector, or with a component that is null or not finite, take no part, nor do vectors so long that
    a score might not fit 64 bits (2^31 times the scale's unit). Vectors are only compared with vectors of as
    many components. Equal rows count once; rows of one id with different vectors are different rows, but never
    each other's positives. Empty and zero vectors have the score 0 with all. Anchors without positives, and
    positives without rows in their band, give no rows, and neither does an empty table. Further columns, of any
    name, are not looked at.
    """
    rows = durable(_usable(vectors, id_col, label_col, vector_col, is_anchor, mining.scale))
    dealt = _dealt(rows)
    packed = durable(dealt.groupBy("dim", "block").applyInArrow(_pack_block, "dim int, block long, data binary"))
    numbers = packed.groupBy("dim").agg((F.max("block") + 1).alias("blocks"))
    anchors = rows.where("is_anchor").withColumn("anchor", F.xxhash64("id", "label", "vec"))
    chunks_of = anchors.groupBy("dim").agg(F.ceil(F.count("*") / CHUNK_ANCHORS).alias("chunks"))
    sizes = durable(numbers.join(chunks_of, "dim"))
    blocks = spread_join(packed, sizes.select("dim", "chunks"), ["dim"])
    placed = durable(
        spread_join(anchors.drop("square", "is_anchor"), sizes, ["dim"])
        .withColumn("chunk", F.pmod("anchor", F.col("chunks")))
        .drop("chunks")
    )

    all_rows = F.array(F.struct(F.lit(0).cast("long").alias("tag"), F.lit(-_ANY).alias("low"), F.lit(_ANY).alias("high")))
    found = _search(blocks, _chunks(placed.withColumn("wanted", all_rows)), mining, same_label=True)
    by_score = [F.col("score").desc(), F.col("id")]
    nth = F.row_number().over(Window.partitionBy("anchor").orderBy(*by_score))
    positives = durable(found.withColumn("nth", nth).where(F.col("nth") <= mining.positives))

    # whole numbers in the band low % ... high % of the positive's score
    score = F.col("score").cast("decimal(20,0)")
    low = F.ceil(score * mining.low_percent / 100).cast("long")
    high = F.floor(score * mining.high_percent / 100).cast("long")
    bands = positives.withColumns({"low": low, "high": high}).where("low <= high")
    # at most as many queries as positives for one anchor
    wanted = bands.groupBy("anchor").agg(
        F.collect_list(F.struct(F.col("nth").cast("long").alias("tag"), "low", "high")).alias("wanted")
    )
    found = _search(blocks, _chunks(placed.join(wanted, "anchor")), mining, same_label=False)
    rank = F.row_number().over(Window.partitionBy("anchor", "query").orderBy(*by_score))
    negatives = found.withColumn("rank", rank).where(F.col("rank") <= mining.negatives)
    chosen = positives.select("anchor", F.col("nth").cast("long").alias("query"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = placed.select("anchor", F.col("id").alias("anchor_id"))
    return (
        negatives.join(chosen, ["anchor", "query"])
        .join(named, "anchor")
        .select(
            "anchor_id",
            "positive_id",
            F.col("rank").cast("int").alias("rank"),
            F.col("id").alias("negative_id"),
            "positive_score",
            F.col("score").alias("negative_score"),
        )
    )
