"""Near-duplicate documents: MinHash signatures, banding, verification and components.

1. One pass over the texts makes a narrow table: the size of each document's shingle set, a digest of
   the set, minima of many universal hashes, and a key for each band of them. Documents with equal sets
   are one class; only its smallest id goes on.
2. Documents that share a band key are a bucket. Every member is tied to the smallest of its bucket, and
   of those ties each document first tries the one that shares most bands. Ties that the signatures and
   then the full sets confirm are links; components of these take in nearly all of a large group.
3. What is left are buckets that hold members of more than one component. Only there, members of
   different components are compared with each other: inside the join by their odd sketches, then by
   signature, then on the full sets. An odd sketch has one bit per bucket of shingles, set if the bucket
   holds an odd number of them; the bits in which two sketches differ are never more than the shingles
   in which the sets differ, so this drops no link. A bucket of copies costs one comparison a member, a
   bucket of texts below the threshold emits next to no pairs, and no two members that could be linked
   stay uncompared.
4. Components of all links; their smallest id is the document that stays.

The number of bands is worked out from the threshold so that a pair just at it is missed by all bands
with a chance below ``MISS``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatelens.llm.components import connected_components
from estatelens.llm.words import mixed, shingle_sets
from estatelens.llm.workers import slices
from estatelens.operators.skew import spread_join
from estatelens.session import durable

#: Chance that a pair at the threshold shares no band, and that its signatures look too far apart.
MISS = 1e-6
#: 64-bit words of an odd sketch.
SKETCH = 16
#: Standard deviations a signature may fall short of the threshold.
SLACK = 5.0
ROWS = 5


@dataclass(frozen=True)
class Near:
    """What counts as near: shingles of ``words`` words, ``percent`` of all shingles in common."""

    words: int = 5
    percent: int = 80
    rows: int = ROWS

    @property
    def bands(self) -> int:
        return math.ceil(math.log(MISS) / math.log1p(-((self.percent / 100) ** self.rows)))

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    @property
    def agreeing(self) -> int:
        """Minima that have to agree for a pair to be looked at in full."""
        t = self.percent / 100
        return max(1, math.floor(self.hashes * t - SLACK * math.sqrt(self.hashes * t * (1 - t))))

    def similar(self, common, union):
        return 100 * common >= self.percent * union


class Signer:
    """Minima of universal hashes ``a * x + b`` modulo 2^32, with odd ``a``."""

    def __init__(self, near: Near):
        self.near = near
        numbers = mixed(np.arange(1, 2 * near.hashes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.a = ((numbers[: near.hashes] >> np.uint64(32)) | np.uint64(1)).astype(np.uint32)[:, None]
        self.b = (numbers[near.hashes :] >> np.uint64(32)).astype(np.uint32)[:, None]

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        blocks = [
            (self.a * x[i : i + 2048] + self.b).min(axis=1) for i in range(0, len(x), 2048)
        ]
        return reduce(np.minimum, blocks)

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        key = np.arange(1, self.near.bands + 1, dtype=np.uint64)
        for row in minima.reshape(self.near.bands, self.near.rows).T.astype(np.uint64):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + row + np.uint64(1))
        return key.view(np.int64)


def signatures(docs: DataFrame, near: Near) -> DataFrame:
    """(doc_id, n_shingles, digest, bands, minima, odd) per row of ``docs(doc_id, text)``.

    Minima are kept as 16 bits each, ``odd`` is the odd sketch.
    """

    def sign(batches):
        signer = Signer(near)
        for batch in slices(batches, 1):
            sets = shingle_sets(batch.column(1).fill_null(""), near.words)
            digests, bands, minima, odd = [], [], [], []
            for s in sets:
                found = len(s) > 0
                values = signer.minima(s) if found else None
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if found else None)
                bands.append(signer.band_keys(values) if found else None)
                minima.append(values.astype("<u2").tobytes() if found else None)
                odd.append(odd_sketch(s) if found else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], type=pa.int64()),
                    pa.array(digests, type=pa.binary()),
                    pa.array(bands, type=pa.list_(pa.int64())),
                    pa.array(minima, type=pa.binary()),
                    pa.array(odd, type=pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "digest", "bands", "minima", "odd"],
            )

    return docs.mapInArrow(
        sign,
        "doc_id long, n_shingles long, digest binary, bands array<long>, minima binary, odd array<long>",
    )


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """One bit per bucket of shingles: is their number odd?"""
    bits = np.bincount((shingles & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH)
    return np.packbits((bits & 1).astype(np.uint8)).view(np.int64)


def _may_be_similar(near: Near) -> Column:
    """Do the odd sketches of a and b leave room for a link?

    Sets of n and m shingles at the threshold t differ in (1 - t) / (1 + t) * (n + m) at most.
    """
    apart = reduce(
        lambda x, y: x + y,
        [F.bit_count(F.get("odd_a", F.lit(i)).bitwiseXOR(F.get("odd_b", F.lit(i)))) for i in range(SKETCH)],
    )
    return apart * (100 + near.percent) <= (F.col("n_shingles_a") + F.col("n_shingles_b")) * (
        100 - near.percent
    )


def _by_signature(pairs: DataFrame, signed: DataFrame, near: Near) -> DataFrame:
    """The pairs whose minima agree in enough places."""
    least = near.agreeing
    width = near.hashes

    @F.pandas_udf("boolean")
    def agree(x, y):
        import pandas as pd

        if not len(x):
            return pd.Series([], dtype=bool)
        left = np.frombuffer(b"".join(x), dtype="<u2").reshape(-1, width)
        right = np.frombuffer(b"".join(y), dtype="<u2").reshape(-1, width)
        return pd.Series((left == right).sum(axis=1) >= least)

    minima = signed.where("minima IS NOT NULL").select("doc_id", "minima")
    return (
        pairs.join(minima.withColumnsRenamed({"doc_id": "a", "minima": "minima_a"}), "a")
        .join(minima.withColumnsRenamed({"doc_id": "b", "minima": "minima_b"}), "b")
        .where(agree("minima_a", "minima_b"))
        .select("a", "b")
        .distinct()
    )


def _by_sets(pairs: DataFrame, texts: DataFrame, near: Near) -> DataFrame:
    """The pairs whose full shingle sets are similar."""

    def confirm(batches):
        for batch in slices(slices(batches, 2), 3):
            left = shingle_sets(batch.column(2), near.words)
            right = shingle_sets(batch.column(3), near.words)
            keep = []
            for x, y in zip(left, right):
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common > 0 and near.similar(common, len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, type=pa.bool_()))

    return (
        pairs.join(texts.withColumnsRenamed({"doc_id": "a", "text": "text_a"}), "a")
        .join(texts.withColumnsRenamed({"doc_id": "b", "text": "text_b"}), "b")
        .select("a", "b", "text_a", "text_b")
        .mapInArrow(confirm, "a long, b long")
        .distinct()
    )


def near_duplicates(
    docs: DataFrame, near: Near = Near(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept.

    A document's component is the smallest id it reaches over links, itself included; it is kept if that
    is its own. Documents without words (null and empty texts among them) have no shingles and are linked
    with nothing. A row without an id is its own: component null, kept. Rows that repeat an id are one
    document: each gives a row, with the same component; their texts' links all count. An empty table
    gives none. Columns other than the two named are not read.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = durable(signatures(slim, near))
    known = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")

    # documents with equal sets: one goes on, the others are tied to it; an id with several texts goes on
    # with those of its sets that no smaller id has
    sets = known.groupBy("digest").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last")
    )
    several = sets.where("first <> last").select("digest", "first")
    copies = durable(
        spread_join(known.select("doc_id", "digest"), several, ["digest"])
        .where("doc_id <> first")
        .select("doc_id", F.xxhash64("digest").alias("set"), "first")
        .distinct()
    )
    singles = known.select("doc_id", F.xxhash64("digest").alias("set"), "n_shingles", "bands").join(
        copies.select("doc_id", "set"), ["doc_id", "set"], "left_anti"
    )

    # buckets of two and more
    banded = singles.select("doc_id", "set", "n_shingles", F.explode("bands").alias("key"))
    buckets = (
        banded.groupBy("key")
        .agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last"))
        .where("lead <> last")
        .select("key", "lead")
    )
    members = durable(spread_join(banded, buckets, ["key"]))
    texts = durable(
        slim.join(members.select("doc_id").distinct(), "doc_id", "left_semi").where("text IS NOT NULL")
    )

    # each member and the smallest of the bucket with which it shares most bands
    ties = (
        members.where("doc_id <> lead")
        .groupBy("doc_id", "lead")
        .agg(F.count("*").alias("shared"))
    )
    best = Window.partitionBy("doc_id").orderBy(F.desc("shared"), "lead")
    first = (
        ties.withColumn("at", F.row_number().over(best))
        .where("at = 1")
        .select(F.col("lead").alias("a"), F.col("doc_id").alias("b"))
    )
    near_first = durable(_by_signature(first, signed, near))
    links = durable(_by_sets(near_first, texts, near))

    # buckets that still hold members of several components
    found = connected_components(links)
    placed = members.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "key", "doc_id", "set", "n_shingles", F.coalesce("component", "doc_id").alias("component")
    )
    placed = durable(placed)
    sketched = (
        signed.where("odd IS NOT NULL")
        .select("doc_id", F.xxhash64("digest").alias("set"), "odd")
        .dropDuplicates(["doc_id", "set"])
    )
    mixed_keys = (
        placed.groupBy("key")
        .agg(F.min("component").alias("least"), F.max("component").alias("most"))
        .where("least <> most")
        .select("key")
    )
    open_ = durable(placed.join(mixed_keys, "key", "left_semi").join(sketched, ["doc_id", "set"]))
    names = ("doc_id", "n_shingles", "component", "odd")
    x = open_.select("key", *[F.col(c).alias(f"{c}_a") for c in names])
    y = open_.select("key", *[F.col(c).alias(f"{c}_b") for c in names])
    smaller = F.least("n_shingles_a", "n_shingles_b")
    larger = F.greatest("n_shingles_a", "n_shingles_b")
    rest = (
        x.join(y, "key")
        .where("component_a < component_b")
        .where(100 * smaller >= near.percent * larger)
        .where(_may_be_similar(near))
        .select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b"))
        .distinct()
    )
    near_rest = durable(_by_signature(durable(rest), signed, near))
    more = _by_sets(near_rest, texts, near)

    same = copies.select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    components = connected_components(
        found.select(F.col("component").alias("a"), F.col("node").alias("b")).union(more).union(same)
    ).withColumnRenamed("node", "doc_id")
    mine = F.coalesce("component", "doc_id")
    return signed.select("doc_id", "n_shingles").join(components, "doc_id", "left").select(
        "doc_id",
        "n_shingles",
        mine.alias("component_id"),
        F.coalesce(mine == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def without_near_duplicates(
    docs: DataFrame, near: Near = Near(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with one document of each group, all columns as they were."""
    result = near_duplicates(docs, near, id_col, text_col)
    gone = durable(result.where("NOT kept").select(F.col("doc_id").alias(id_col)).distinct())
    return docs.join(gone, id_col, "left_anti")
