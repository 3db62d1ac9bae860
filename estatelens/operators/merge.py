"""Row-level changes as pure functions: the new state of a table from its old state.

Tables without row-level operations (parquet) get their new state written as a whole or by partition;
see ``sinks.tables``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.operators.skew import spread_join
from estatelens.session import durable


def has_null(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])


def one_per_key(df: DataFrame, keys: Sequence[str], payload: str = "_row") -> DataFrame:
    """One row per key with all columns in a struct; raises where a key occurs twice.

    The check is part of the aggregation the rows go through anyway. It combines before the shuffle,
    so not even a key that holds most rows gathers in one task, and the result is already partitioned
    by the keys a join needs.
    """
    message = F.concat(
        F.lit("source has several rows for key "),
        F.to_json(F.struct(*[F.col(k) for k in keys])),
    )
    grouped = df.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.first(F.struct(*df.columns)).alias("_first")
    )
    checked = F.when(F.col("_n") > 1, F.raise_error(message).cast(df.schema))
    return grouped.select(*keys, checked.otherwise(F.col("_first")).alias(payload))


def merge(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    update: Sequence[str] | None = None,
    insert: Sequence[str] | None = None,
) -> DataFrame:
    """Upsert: matched rows take ``update`` columns from the source, unmatched source rows are inserted.

    By default all columns are updated and inserted; a column left out of ``insert`` is null in new
    rows. A key that occurs twice in the source raises. A null key matches nothing.

    The source is checked and stored once, and so is what the target's join with it gives: a left join that
    spreads hot target keys, which a full outer join cannot. Rows to insert are the source keys that this join
    did not meet, so neither side is read again for them.
    """
    columns = target.columns
    update = [c for c in columns if c not in keys] if update is None else list(update)
    insert = columns if insert is None else list(insert)
    types = {f.name: f.dataType for f in target.schema.fields}
    keyed = durable(one_per_key(source.filter(~has_null(keys)), keys, "_new"))
    new = F.col("_new")

    def added(rows: DataFrame, value) -> DataFrame:
        return rows.select(
            *[(value(c) if c in insert else F.lit(None)).cast(types[c]).alias(c) for c in columns]
        )

    joined = durable(
        spread_join(target, keyed, keys, "left").select(
            *[
                F.when(new.isNotNull(), new[c].cast(types[c])).otherwise(F.col(c)).alias(c)
                if c in update
                else F.col(c)
                for c in columns
            ],
            new.isNotNull().alias("_met"),
        )
    )
    met = joined.where("_met").select(*keys).distinct()
    inserted = added(keyed.join(met, list(keys), "left_anti"), lambda c: new[c])
    keyless = added(source.filter(has_null(keys)), F.col)
    return joined.drop("_met").unionByName(inserted).unionByName(keyless)


def update_from(
    target: DataFrame, source: DataFrame, keys: Sequence[str], assign: dict[str, str]
) -> DataFrame:
    """``UPDATE … FROM``: matched target rows take ``assign`` (target column: source column).

    Rows without a match stay as they are. A key that occurs twice in the source raises.
    """
    right = one_per_key(source.filter(~has_null(keys)), keys, "_new")
    new = F.col("_new")
    types = {f.name: f.dataType for f in target.schema.fields}
    return spread_join(target, right, keys, "left").select(
        *[
            F.when(new.isNotNull(), new[assign[c]].cast(types[c])).otherwise(F.col(c)).alias(c)
            if c in assign
            else F.col(c)
            for c in target.columns
        ]
    )


def replace_where(target: DataFrame, rows: DataFrame, predicate: Column) -> DataFrame:
    """Delete the target rows where ``predicate`` is true, then insert ``rows``."""
    kept = target.filter(~F.coalesce(predicate, F.lit(False)))
    types = {f.name: f.dataType for f in target.schema.fields}
    return kept.unionByName(rows.select(*[F.col(c).cast(types[c]) for c in target.columns]))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that break a primary key: null parts, or more than one row."""
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("rows"))
        .filter((F.col("rows") > 1) | has_null(keys))
    )


def changed(old: Column, new: Column, null_safe: bool = False) -> Column:
    """Did a value change? Plain comparison: null on either side means no; ``null_safe`` sees nulls."""
    if null_safe:
        return ~old.eqNullSafe(new)
    return F.coalesce(old != new, F.lit(False))


# -- slowly changing dimensions, type 2


def scd2_changed(
    dimension: DataFrame, source: DataFrame, key: str, tracked: Sequence[str], null_safe: bool = False
) -> DataFrame:
    """Source rows that are new, or differ from the current version in a tracked column."""
    current = dimension.filter(F.col("is_current") == 1).select(
        F.col(key), F.lit(1).alias("_known"), *[F.col(c).alias(f"_was_{c}") for c in tracked]
    )
    differs = reduce(
        lambda a, b: a | b,
        [changed(F.col(f"_was_{c}"), F.col(c), null_safe) for c in tracked],
    )
    return (
        source.join(current, key, "left")
        .filter(F.col("_known").isNull() | differs)
        .select(*source.columns)
    )


def scd2_expire(
    dimension: DataFrame,
    source: DataFrame,
    key: str,
    tracked: Sequence[str],
    as_of: Column,
    null_safe: bool = False,
) -> DataFrame:
    """The dimension with changed current versions closed; nothing is inserted."""
    current = dimension.filter(_open(key))
    differs = reduce(
        lambda a, b: a | b,
        [changed(F.col(f"d.{c}"), F.col(f"s.{c}"), null_safe) for c in tracked],
    )
    hit = (
        current.alias("d")
        .join(source.alias("s"), (F.col(f"d.{key}") == F.col(f"s.{key}")) & differs, "left_semi")
        .select(key)
        .distinct()
        .withColumn("_hit", F.lit(True))
    )
    now = current.join(hit, key, "left")
    closed = F.coalesce("_hit", F.lit(False))
    end_type = dimension.schema["end_date"].dataType
    expired = now.select(
        *[
            F.when(closed, 0).otherwise(F.col(c)).cast(dimension.schema[c].dataType).alias(c)
            if c == "is_current"
            else F.when(closed, as_of.cast(end_type)).otherwise(F.col(c)).alias(c)
            if c == "end_date"
            else F.col(c)
            for c in dimension.columns
        ]
    )
    return expired.unionByName(dimension.filter(~_open(key)))


def _open(key: str) -> Column:
    """Current versions with a key: the rows a load can touch."""
    return F.coalesce(F.col("is_current") == 1, F.lit(False)) & F.col(key).isNotNull()


def scd2_apply(
    dimension: DataFrame,
    source: DataFrame,
    key: str,
    tracked: Sequence[str],
    as_of: Column,
    null_safe: bool = False,
) -> DataFrame:
    """The dimension after one load: changed versions closed, new versions added.

    Every key is classed from the state before the load in one full outer join of the current
    versions with the source; a changed key gives two rows. Closed versions, however many a key has,
    are passed on without a shuffle.
    """
    current = dimension.filter(_open(key))
    types = {f.name: f.dataType for f in dimension.schema.fields}
    old, new = F.col("_old"), F.col("_new")
    joined = current.select(key, F.struct(*dimension.columns).alias("_old")).join(
        one_per_key(source.filter(F.col(key).isNotNull()), [key], "_new"), key, "full_outer"
    )
    differs = new.isNotNull() & reduce(
        lambda a, b: a | b, [changed(old[c], new[c], null_safe) for c in tracked]
    )

    def kept(c: str) -> Column:
        value = old[c]
        if c == "is_current":
            value = F.when(differs, 0).otherwise(value)
        elif c == "end_date":
            value = F.when(differs, as_of.cast(types[c])).otherwise(value)
        return value.cast(types[c]).alias(c)

    def added(c: str) -> Column:
        if c == "is_current":
            value = F.lit(1)
        elif c == "end_date" or c not in source.columns:
            value = F.lit(None)
        else:
            value = new[c]
        return value.cast(types[c]).alias(c)

    versions = F.array(
        F.when(old.isNotNull(), F.struct(*[kept(c) for c in dimension.columns])),
        F.when(old.isNull() | differs, F.struct(*[added(c) for c in dimension.columns])),
    )
    rows = joined.select(F.explode(F.array_compact(versions)).alias("v")).select("v.*")
    without_key = source.filter(F.col(key).isNull()).select(
        *[
            (F.lit(1) if c == "is_current" else F.col(c) if c in source.columns and c != "end_date" else F.lit(None))
            .cast(types[c])
            .alias(c)
            for c in dimension.columns
        ]
    )
    return rows.unionByName(dimension.filter(~_open(key))).unionByName(without_key)
