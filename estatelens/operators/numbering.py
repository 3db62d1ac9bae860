"""Row numbers that neither gather everything in one task nor choke on a hot group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 8192
PARTS = 256


def newest_numbered(df: DataFrame, order: Sequence[Column], n: int, out: str = "rn") -> DataFrame:
    """The first ``n`` rows in ``order``, numbered from 1.

    The top rows are taken first and only they are numbered. Numbering first would sort the whole
    input in one task for the same answer.
    """
    return df.orderBy(*order).limit(n).withColumn(out, F.row_number().over(Window.orderBy(*order)))


def hot_cuts(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    sample: int = SAMPLE,
    parts: int = PARTS,
) -> DataFrame:
    """One row with a map: hash of a hot group -> values of the first order column that cut it.

    A group is hot when it holds more than one ``parts``-th of the rows, and its cuts make pieces of
    about that size. Both are read off the ``sample`` rows with the smallest hash: an even sample of
    fixed size, the same one on every run, so the map has at most ``parts`` groups and cuts.
    """
    each = max(1, sample // parts)
    few = (
        df.select(
            F.xxhash64(*group).alias("g"),
            F.col(order[0]).alias("k"),
            F.xxhash64(*group, *order).alias("h"),
        )
        .orderBy("h", "g", "k")
        .limit(sample)
    )
    seen = few.groupBy("g").agg(F.array_sort(F.collect_list("k")).alias("ks"))
    places = F.sequence(F.lit(each), F.size("ks") - 1, F.lit(each))
    cuts = F.array_distinct(F.transform(places, lambda i: F.get("ks", i)))
    return seen.filter(F.size("ks") > each).agg(
        F.map_from_entries(F.collect_list(F.struct("g", cuts)))
    )


def occurrence_number(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    out: str = "occurrence",
    sample: int = SAMPLE,
    parts: int = PARTS,
) -> DataFrame:
    """The n-th occurrence of ``group`` in ``order``, also when one group holds most rows.

    A hot group is cut into ranges of the first order column, numbered range by range, and shifted by
    the number of its rows in earlier ranges; all other groups are numbered as they are. The numbers
    are exact whatever the cuts are; cuts only decide how evenly a hot group spreads.

    Cuts and sizes need passes over ``df`` of their own, so hand in a stored relation when the rows
    are costly to make.
    """
    first, key = F.col(order[0]), F.struct(*[F.col(g) for g in group])
    cuts = F.try_element_at(
        hot_cuts(df, group, order, sample, parts).scalar(), F.xxhash64(*[F.col(g) for g in group])
    )
    # a column of its own: a subquery may not stand inside a higher-order function
    marked = df.withColumn("_cuts", cuts)
    place = F.size(F.filter("_cuts", lambda c: c <= first)) + 1
    shifts = part_shifts(marked.filter("_cuts IS NOT NULL").select(key.alias("g"), place.alias("p")))

    cut = marked.withColumn("_part", F.when(F.col("_cuts").isNotNull(), place).otherwise(0))
    within = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order))
    shift = F.get(F.try_element_at(shifts.scalar(), key), F.col("_part") - 1)
    number = F.col("_within") + F.when(F.col("_part") > 0, shift).otherwise(0)
    return (
        cut.drop("_cuts")
        .withColumn("_within", within)
        .withColumn(out, number.cast("bigint"))
        .drop("_part", "_within")
    )


def part_shifts(rows: DataFrame) -> DataFrame:
    """One row with a map: hot group ``g`` -> for each part ``p``, its rows in all parts before it."""
    sizes = rows.groupBy("g", "p").agg(F.count("*").alias("n"))
    per_group = sizes.groupBy("g").agg(F.collect_list(F.struct("p", "n")).alias("parts"))
    before = F.transform(
        F.sequence(F.lit(1), F.array_max("parts.p")),
        lambda p: F.aggregate(
            F.filter("parts", lambda x: x["p"] < p),
            F.lit(0).cast("bigint"),
            lambda total, x: total + x["n"],
        ),
    )
    return per_group.agg(F.map_from_entries(F.collect_list(F.struct("g", before))))
