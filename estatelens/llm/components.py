"""Connected components by alternating large-star and small-star.

Large-star ties every larger neighbour of a node to the smallest node around it, small-star does so for
the smaller neighbours and the node itself. Both keep components as they are; when nothing changes any
more, every node is tied to the smallest of its component (Kiveris et al., 2014). Each half is two
shuffles of the links. Links of a node that holds many are dealt out by ``spread_join``, and minima are
combined before their shuffle, so a hub needs no task of its own. Every half is written to the
checkpoint folder; the driver sees a count and a checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatelens.operators.skew import spread_join
from estatelens.session import durable


def _links(df: DataFrame) -> DataFrame:
    return df.where("hi <> lo").distinct()


def large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
        links.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    larger = both.where("v > u")
    return _links(spread_join(larger, least, ["u"]).select(F.col("v").alias("hi"), F.col("m").alias("lo")))


def small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("hi").agg(F.min("lo").alias("m"))
    smaller = spread_join(links, least, ["hi"]).where("lo <> m")
    return _links(
        smaller.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(
            least.select("hi", F.col("m").alias("lo"))
        )
    )


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def connected_components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node in a pair; component is its smallest node.

    Nulls, pairs of a node with itself and repeated pairs say nothing and are left out: a node that has
    no other pair is not in the result. No pairs give no rows.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    links = durable(_links(pairs.select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo")).where(x.isNotNull() & y.isNotNull())))
    state = _state(links)
    while True:
        links = durable(small_star(durable(large_star(links))))
        now = _state(links)
        if now == state:
            break
        state = now
    nodes = links.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return nodes.union(links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
