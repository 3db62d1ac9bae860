"""Approximate nearest neighbours: a forest of random-projection trees behind one priority queue.

Each tree halves the vectors again and again by hyperplanes between two of them. Trees are fitted on a
sample of fixed size and are small; every vector of the table is then put into its leaf of every tree.
A query walks all trees at once: branches it did not take wait in one queue, those whose hyperplanes are
closest first, and leaves are visited until they hold as many rows as ``share`` of the table. In each leaf the queries
that visit it are ranked exactly against its vectors, in double precision; the best of all leaves are
merged.

Equal vectors are one entry that keeps its k + 1 smallest ids. A query excludes no id but its own and
ties go to smaller ids, so no other id of an entry can be among its k nearest: nothing is lost, and a
vector that fills a third of the table is one row of a leaf.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from estatelens.operators.skew import spread_join
from estatelens.session import durable


@dataclass(frozen=True)
class Forest:
    """Trees, different vectors they are fitted on (about so many, picked by hash), rows a leaf should hold at most, least depth, share of
    all rows a query visits and rows it visits at least (a row counts for every tree), and queries
    ranked together in a leaf."""

    trees: int = 16
    sample: int = 8192
    leaf_rows: int = 4096
    least_depth: int = 7
    share: float = 1.0
    least_rows: int = 4000
    together: int = 20_000

    def depth(self, rows: int) -> int:
        wanted = max(self.least_depth, math.ceil(math.log2(max(rows, 1) / self.leaf_rows)))
        return max(1, min(wanted, int(math.log2(self.sample)) - 2))


class Trees:
    """Hyperplanes of all trees; node 0 is a root, node i has children 2i + 1 and 2i + 2."""

    def __init__(self, planes: np.ndarray, edges: np.ndarray):
        self.planes, self.edges = planes, edges
        self.trees, self.depth = len(planes), int(math.log2(planes.shape[1] + 1))

    @classmethod
    def fitted(cls, vectors: np.ndarray, trees: int, depth: int) -> Trees:
        """Trees whose hyperplanes stand between two rows and halve the rows of a node."""
        nodes, dims = (1 << depth) - 1, vectors.shape[1]
        planes, edges = np.zeros((trees, nodes, dims)), np.zeros((trees, nodes))
        for tree in range(trees):
            random = np.random.default_rng(tree)
            parts = [np.arange(len(vectors))]
            for node in range(nodes):
                rows = parts[node]
                plane = random.standard_normal(dims)
                if len(rows) > 1:
                    a, b = random.choice(rows, 2, replace=False)
                    if not np.array_equal(vectors[a], vectors[b]):
                        plane = vectors[a] - vectors[b]
                length = np.sqrt(np.sum(plane * plane))
                plane = plane / length
                along = vectors[rows] @ plane
                edge = float(np.median(along)) if len(rows) else 0.0
                planes[tree, node], edges[tree, node] = plane, edge
                parts += [rows[along <= edge], rows[along > edge]]
        return cls(planes, edges)

    def margins(self, vectors: np.ndarray) -> np.ndarray:
        """How far each vector lies above each hyperplane: (vectors, trees, nodes)."""
        flat = self.planes.reshape(-1, self.planes.shape[2])
        return (vectors @ flat.T - self.edges.ravel()).reshape(len(vectors), self.trees, -1)

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree."""
        above = self.margins(vectors) > 0
        node = np.zeros((len(vectors), self.trees), dtype=np.int64)
        for _ in range(self.depth):
            step = np.take_along_axis(above, node[:, :, None], axis=2)[:, :, 0]
            node = 2 * node + 1 + step
        return (node - ((1 << self.depth) - 1)).astype(np.int32)

    def visit(self, margins: np.ndarray, sizes: np.ndarray, rows: float) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of the shared queue, until the leaves hold ``rows`` rows."""
        first_leaf = (1 << self.depth) - 1
        queue = [(0.0, tree, 0) for tree in range(self.trees)]
        found, held = [], 0
        while queue and held < rows:
            worst, tree, node = heapq.heappop(queue)
            while node < first_leaf:
                margin = margins[tree, node]
                near = 2 * node + 1 + int(margin > 0)
                heapq.heappush(queue, (max(worst, abs(margin)), tree, 4 * node + 3 - near))
                node = near
            size = sizes[tree, node - first_leaf]
            if size:
                found.append((tree, node - first_leaf))
                held += size
        return found


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Binary vectors as a matrix of doubles."""
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), dtype=kind).reshape(len(parts), -1).astype(np.float64)


def _best(q: np.ndarray, v: np.ndarray, entry: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of v, score) of the ``n`` best of each row of q; ties go to the smaller entry."""
    near = q @ v.T
    best = min(n, len(v))
    least = np.partition(near, len(v) - best, axis=1)[:, len(v) - best]
    # scores are rounded differently here, so all within the rounding of the last place go on
    sizes = np.sqrt(np.einsum("ij,ij->i", q, q) * np.einsum("ij,ij->i", v, v).max())
    slack = 4 * np.finfo(np.float64).eps * q.shape[1] * sizes
    row, column = np.nonzero(near >= (least - slack)[:, None])
    score = np.concatenate(
        [
            np.einsum("ij,ij->i", q[row[i : i + 16384]], v[column[i : i + 16384]])
            for i in range(0, len(row), 16384)
        ]
    )
    order = np.lexsort((entry[column], -score, row))
    row, column, score = row[order], column[order], score[order]
    keep = np.arange(len(row)) - np.searchsorted(row, np.arange(len(q)))[row] < best
    return row[keep], column[keep], score[keep]


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    forest: Forest = Forest(),
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row of ``queries``.

    Nearness is the inner product in double precision; ties go to the smaller id; a query never finds
    its own id. Vectors that are null, zero, hold null or non-finite components, or have another length
    than most (of equally frequent ones the smallest counts), take no part on either side, nor do rows
    without an id. Rows that
    repeat an id and vector count once. Fewer than ``k`` candidates give fewer rows; no usable vectors or
    queries give none. Other columns are not read.
    """
    spark = vectors.sparkSession
    given = vectors.schema[vector_col].dataType
    single = isinstance(given, T.ArrayType) and isinstance(given.elementType, T.FloatType)
    kind, element = ("<f4", "float") if single else ("<f8", "double")

    def usable(df: DataFrame) -> DataFrame:
        finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
        slim = df.select(
            F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{element}>").alias("v")
        )
        return slim.where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0").where(
            finite & F.exists("v", lambda x: x != 0)
        )

    rows = usable(vectors)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = rows.groupBy(F.size("v").alias("dims")).count()
    most = lengths.orderBy(F.desc("count"), "dims").first()
    if most is None:
        return empty
    dims = most["dims"]
    rows = rows.where(F.size("v") == dims)
    rows = rows.dropDuplicates(["id", "v"])
    by_vector = Window.partitionBy("v").orderBy("id")
    entries = (
        rows.withColumn("at", F.row_number().over(by_vector))
        .where(F.col("at") <= k + 1)
        .groupBy("v")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .select(F.col("ids")[0].alias("entry"), "ids", "v")
    )
    entries = durable(entries)
    total = entries.count()
    # different vectors, chosen by their hashes alone: about ``sample`` of them come here, each once
    bound = math.ceil(forest.sample / max(total, 1) * (1 << 31))
    sample = entries.where(F.pmod(F.xxhash64("v"), F.lit(1 << 31)) < bound).select("v").collect() or entries.select("v").take(1)
    fitted = np.unique(np.array([r["v"] for r in sample], dtype=np.float64), axis=0)
    trees = Trees.fitted(fitted, forest.trees, forest.depth(total))
    # trees * 2^depth hyperplanes, whatever the table holds; plain arrays, which workers can read without the package
    shared = spark.sparkContext.broadcast((trees.planes, trees.edges))

    def put(batches):
        trees = Trees(*shared.value)
        for batch in batches:
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(kind)
            matrix = flat.reshape(batch.num_rows, dims)
            leaves = trees.leaves(matrix.astype(np.float64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("entry"),
                    pa.array([row.tobytes() for row in matrix], type=pa.binary()),
                    pa.array(list(leaves), type=pa.list_(pa.int32())),
                ],
                names=["entry", "vector", "leaves"],
            )

    placed = durable(
        entries.select("entry", "v").mapInArrow(put, "entry long, vector binary, leaves array<int>")
    )
    in_leaf = placed.select("entry", "vector", F.posexplode("leaves").alias("tree", "leaf"))
    sizes = np.zeros((forest.trees, 1 << trees.depth), dtype=np.int64)
    for r in in_leaf.groupBy("tree", "leaf").count().collect():  # one row per leaf
        sizes[r["tree"], r["leaf"]] = r["count"]

    asked = durable(
        spread_join(
            usable(queries).where(F.size("v") == dims).distinct(), entries.select("entry", "v"), ["v"]
        ).select(F.col("id").alias("query_id"), "entry")
    )
    seeking = asked.select("entry").distinct().join(placed.select("entry", "vector"), "entry")
    blocks = max(1, math.ceil(asked.count() / forest.together))
    budget = max(forest.share * total, forest.least_rows)

    def search(batches):
        trees = Trees(*shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                margins = trees.margins(_matrix(part.column("vector"), kind))
                at, tree, leaf = [], [], []
                for i, own in enumerate(margins):
                    found = trees.visit(own, sizes, budget)
                    at += [i] * len(found)
                    tree += [t for t, _ in found]
                    leaf += [x for _, x in found]
                own = part.take(pa.array(at, type=pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(tree, type=pa.int32()),
                        pa.array(leaf, type=pa.int32()),
                        own.column("entry"),
                        own.column("vector"),
                    ],
                    names=["tree", "leaf", "query", "vector"],
                )

    visits = seeking.mapInArrow(search, "tree int, leaf int, query long, vector binary").withColumn(
        "block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")
    )
    offered = in_leaf.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["tree", "leaf", "block"]

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query", "entry", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        q = _matrix(left.column("vector").combine_chunks(), kind)
        v = _matrix(right.column("vector").combine_chunks(), kind)
        ids, entry = left.column("query").to_numpy(), right.column("entry").to_numpy()
        found = [[], [], []]
        for start in range(0, len(q), 512):
            row, column, score = _best(q[start : start + 512], v, entry, k + 1)
            found[0].append(ids[start : start + 512][row])
            found[1].append(entry[column])
            found[2].append(score)
        return pa.table([pa.array(np.concatenate(f)) for f in found], names=names)

    hits = (
        visits.groupBy(*keys)
        .cogroup(offered.groupBy(*keys))
        .applyInArrow(rank, "query long, entry long, score double")
        .groupBy("query", "entry")
        .agg(F.max("score").alias("score"))
    )
    best = Window.partitionBy("query").orderBy(F.desc("score"), "entry")
    top = (
        hits.withColumn("at", F.row_number().over(best))
        .where(F.col("at") <= k + 1)
        .join(entries.select("entry", "ids"), "entry")
        .select("query", F.explode("ids").alias("vec_id"), "score")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        asked.withColumnRenamed("entry", "query")
        .join(top, "query")
        .where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
