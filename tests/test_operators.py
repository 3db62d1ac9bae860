"""Numbering, spread joins, merges, dimensions, quality, data flow: against brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from estatelens.operators import dataflow as D
from estatelens.operators import merge as M
from estatelens.operators import quality as Q
from estatelens.operators import skew
from estatelens.operators import warehouse as W
from estatelens.operators.numbering import hot_cuts, newest_numbered, occurrence_number


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# -- numbering


@pytest.mark.parametrize("sample,parts", [(8192, 256), (100, 10), (50, 50), (8192, 1)])
def test_occurrences_with_a_hot_and_a_null_group(frame, sample, parts):
    rng = random.Random(parts)
    data = [
        (rng.choice(["hot", "hot", "hot", "a", "b", None]), f"p{rng.randint(0, 400):03}", i)
        for i in range(3000)
    ]
    got = occurrence_number(
        frame(data, "g string, o string, i int"), ["g"], ["o", "i"], sample=sample, parts=parts
    )
    seen, want = Counter(), []
    for g, o, i in sorted(data, key=lambda r: (r[1], r[2])):
        seen[g] += 1
        want.append((g, o, i, seen[g]))
    assert rows(got) == sorted(want, key=repr)


def test_hot_group_is_cut_and_others_are_not(frame):
    """A hot group gets even pieces of its own; a rare one stays whole."""
    data = [("hot", f"p{i:05}", i) for i in range(9000)] + [(f"g{i}", f"q{i}", i) for i in range(900)]
    df = frame(data, "g string, o string, i int")
    cuts = hot_cuts(df, ["g"], ["o", "i"], sample=1000, parts=50).first()[0]
    assert len(cuts) == 1
    (points,) = cuts.values()
    part = F.array_position(F.sort_array(F.array_append(F.lit(points), F.col("o"))), F.col("o"))
    sizes = [r[0] for r in df.filter("g = 'hot'").groupBy(part).count().select("count").collect()]
    assert 30 <= len(sizes) <= 50 and max(sizes) < 3 * 9900 / 50


def test_newest_numbered_sorts_before_numbering(frame):
    df = frame([(i, i % 10) for i in range(100)], "id int, d int")
    got = newest_numbered(df, [F.col("d").desc(), F.col("id").desc()], 5)
    assert rows(got) == [(59, 9, 5), (69, 9, 4), (79, 9, 3), (89, 9, 2), (99, 9, 1)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


# -- joins


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_is_the_plain_join(frame, how):
    rng = random.Random(1)
    left = frame(
        [(rng.choice([1, 1, 1, 1, None, rng.randint(2, 500)]), rng.randint(0, 5), i) for i in range(4000)],
        "k int, j int, v int",
    )
    right = frame([(k, j, f"{k}/{j}") for k in range(1, 300, 2) for j in range(4)] + [(None, 1, "n")], "k int, j int, w string")
    want = left.join(right, ["k", "j"], how)
    got = skew.spread_join(left, right, ["k", "j"], how, salts=8, salted=True)
    assert got.columns == want.columns
    assert rows(got) == rows(want)


def test_hot_keys_are_found(frame):
    df = frame([(7 if i % 3 else i, i) for i in range(9000)], "k int, v int")
    hot = skew.hot_keys(df, ["k"], ["k", "v"]).first()[0]
    seven = frame([(7,)], "k int").select(F.xxhash64("k")).first()[0]
    assert hot == [seven]


def test_spread_join_rejects_outer_joins(frame):
    one = frame([(1,)], "k int")
    with pytest.raises(ValueError):
        skew.spread_join(one, one, ["k"], "full_outer")


# -- merges

SCHEMA = "k int, j string, a string, b int"


def brute_merge(target, source, update, insert):
    names = ["k", "j", "a", "b"]
    new = {r[:2]: dict(zip(names, r)) for r in source if None not in r[:2]}
    out, hit = [], set()
    for r in target:
        row = dict(zip(names, r))
        match = new.get(r[:2]) if None not in r[:2] else None
        if match:
            hit.add(r[:2])
            row.update({c: match[c] for c in update})
        out.append(tuple(row.values()))
    for r in source:
        if r[:2] not in hit:
            out.append(tuple(v if c in insert else None for c, v in zip(names, r)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("update,insert", [(None, None), (["b"], ["k", "j", "b"]), ([], ["k", "j", "a", "b"])])
def test_merge_like_brute_force(frame, update, insert):
    rng = random.Random(3)
    target = [(rng.choice([1, 1, 1, rng.randint(2, 60), None]), rng.choice("xyz"), f"t{i}", i) for i in range(500)]
    source = [(k, j, f"s{k}{j}", -k) for k in range(1, 80, 3) for j in "xy"] + [(None, "x", "n1", 0), (None, "x", "n2", 0), (5, None, "n3", 1)]
    got = M.merge(frame(target, SCHEMA), frame(source, SCHEMA), ["k", "j"], update, insert)
    want = brute_merge(target, source, update if update is not None else ["a", "b"], insert or ["k", "j", "a", "b"])
    assert rows(got) == want


def test_merge_twice_changes_nothing_more(frame):
    target = frame([(1, "x", "a", 1), (2, "x", "b", 2)], SCHEMA)
    source = frame([(2, "x", "c", 3), (3, "y", "d", 4)], SCHEMA)
    once = M.merge(target, source, ["k", "j"])
    assert rows(M.merge(once, source, ["k", "j"])) == rows(once)


def test_merge_refuses_a_key_that_occurs_twice(frame):
    target = frame([(1, "x", "a", 1)], SCHEMA)
    source = frame([(2, "x", "c", 3), (2, "x", "d", 4)], SCHEMA)
    with pytest.raises(Exception, match="several rows for key"):
        M.merge(target, source, ["k", "j"]).collect()


def test_update_from(frame):
    target = frame([(1, "x", "a", 1), (1, "y", "b", 2), (2, "x", "c", 3), (None, "x", "d", 4)], SCHEMA)
    source = frame([(1, 10), (3, 30), (None, 99)], "k int, v int")
    got = M.update_from(target, source, ["k"], {"b": "v"})
    assert rows(got) == sorted([(1, "x", "a", 10), (1, "y", "b", 10), (2, "x", "c", 3), (None, "x", "d", 4)], key=repr)


def test_replace_where_keeps_rows_the_predicate_does_not_cover(frame):
    target = frame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    got = M.replace_where(target, frame([(9, "z")], "k int, v string"), F.col("k") == 1)
    assert rows(got) == sorted([(2, "b"), (None, "c"), (9, "z")], key=repr)


def test_duplicate_keys(frame):
    df = frame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, v string")
    assert rows(M.duplicate_keys(df, ["k"])) == sorted([(1, 2), (None, 1)], key=repr)


# -- dimensions

DIM = "id int, name string, price double, is_current int, end_date date"


def dimension(frame):
    return frame(
        [(1, "a", 1.0, 1, None), (2, "b", 2.0, 1, None), (3, "c", None, 1, None), (2, "b", 1.5, 0, None)], DIM
    )


def products(frame):
    return frame([(1, "a", 1.0), (2, "b2", 2.5), (3, "c", 3.0), (4, "d", 4.0)], "id int, name string, price double")


def test_scd2_load(frame):
    day = F.lit("2001-08-01").cast("date")
    after = M.scd2_apply(dimension(frame), products(frame), "id", ["price"], day)
    got = sorted((r.id, r.name, r.price, r.is_current, str(r.end_date)) for r in after.na.fill(-1.0).collect())
    assert got == [
        (1, "a", 1.0, 1, "None"),
        (2, "b", 1.5, 0, "None"),
        (2, "b", 2.0, 0, "2001-08-01"),
        (2, "b2", 2.5, 1, "None"),
        (3, "c", -1.0, 1, "None"),
        (4, "d", 4.0, 1, "None"),
    ]
    current = after.filter("is_current = 1").groupBy("id").count()
    assert current.filter("count <> 1").count() == 0
    again = M.scd2_apply(after, products(frame), "id", ["price"], day)
    assert rows(again) == rows(after)


def test_scd2_null_safe_sees_a_null_price(frame):
    changed = M.scd2_changed(dimension(frame), products(frame), "id", ["price"], null_safe=True)
    assert {r.id for r in changed.collect()} == {2, 3, 4}
    plain = M.scd2_changed(dimension(frame), products(frame), "id", ["price"])
    assert {r.id for r in plain.collect()} == {2, 4}


def test_scd2_changed_set_is_the_same_after_expiring(frame):
    """Expiring first must not hide or add rows to the selection of new versions."""
    day = F.lit("2001-08-01").cast("date")
    expired = M.scd2_expire(dimension(frame), products(frame), "id", ["price"], day)
    assert rows(M.scd2_changed(expired, products(frame), "id", ["price"])) == rows(
        M.scd2_changed(dimension(frame), products(frame), "id", ["price"])
    )
    assert expired.count() == dimension(frame).count()


# -- quality


def test_quarantine_and_valid_make_up_the_input(frame):
    rng = random.Random(5)
    df = frame([(i, rng.choice([None, "m"]), rng.choice([None, -1.0, 1.0])) for i in range(500)], "i int, mail string, amount double")
    rules = {"null_mail": F.col("mail").isNull(), "negative": F.col("amount") < 0}
    bad, good = Q.quarantine(df, rules), Q.valid(df, rules)
    assert rows(bad.drop("dq_reason").union(good)) == rows(df)
    assert all(r.dq_reason == ("null_mail" if r.mail is None else "negative") for r in bad.collect())
    counts = {r.rule: r.failed_rows for r in Q.rule_counts(df, rules).collect()}
    assert counts == {
        "null_mail": df.filter("mail is null").count(),
        "negative": df.filter("amount < 0").count(),
    }


# -- load patterns


def test_metrics_drop_customers_without_recent_orders(frame):
    customers = frame([(1,), (2,), (3,)], "customer_id int")
    orders = frame(
        [(1, "2001-07-30", 5.0), (1, "2001-07-01", 7.0), (2, "2001-01-01", 9.0), (9, "2001-07-31", 1.0)],
        "customer_id int, d string, total double",
    ).select("customer_id", F.col("d").cast("timestamp_ntz").alias("order_date"), F.col("total").cast("decimal(18,2)").alias("total_due"))
    got = W.customer_metrics(customers, orders, "2001-08-01 23:00:00").collect()
    assert [(r.customer_id, r.total_orders, float(r.total_spend), r.days_since_last_order) for r in got] == [(1, 1, 5.0, 2)]
    wide = W.customer_metrics(customers, orders, "2001-08-01", lookback_days=400).collect()
    assert {r.customer_id for r in wide} == {1, 2}


def test_stock_and_log(frame):
    stock = frame([(1, 0, 10), (1, 1, 20), (2, 0, 30)], "product_id int, warehouse_id int, quantity_on_hand bigint")
    moves = frame([(1, 0, 3), (1, 0, 4), (9, 9, 1)], "product_id int, warehouse_id int, quantity bigint")
    got = {(r.product_id, r.warehouse_id): (r.quantity_on_hand, r.last_modified is not None) for r in W.update_inventory(stock, moves, "2001-08-01").collect()}
    assert got == {(1, 0): (3, True), (1, 1): (20, False), (2, 0): (30, False)}
    assert sorted(r.quantity_change for r in W.inventory_log(moves, "2001-08-01").collect()) == [-4, -3, -1]


# -- data flow


def test_conditional_split_first_match_wins(frame):
    df = frame([(1,), (5,), (None,), (10,)], "a int")
    out = D.conditional_split(df, {"big": "a > 4", "huge": "a > 9"})
    assert {n: rows(f) for n, f in out.items()} == {"big": [(10,), (5,)], "huge": [], "default": [(1,), (None,)]}


def test_lookup_outputs_cover_the_input_once(frame):
    df = frame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, v string")
    ref = frame([(1, "z"), (1, "y"), (3, "x"), (None, "n")], "k int, w string")
    out = D.lookup(df, ref, ["k"], ["w"])
    assert rows(out["match"]) == [(1, "a", "y"), (1, "b", "y")]
    assert rows(out["nomatch"]) == [(2, "c"), (None, "d")]


def test_data_convert_error_output(frame):
    out = D.data_convert(frame([("1",), ("x",), (None,)], "a string"), {"a": "int"})
    assert rows(out["output"]) == [(1,), (None,)] and rows(out["error"]) == [("x",)]


def test_sort_orders_and_removes_duplicates(frame):
    df = frame([(1, "b"), (2, "a"), (1, "a")], "k int, v string")
    assert [tuple(r) for r in D.sort(df, "-k").collect()] == [(2, "a"), (1, "a"), (1, "b")]
    assert [tuple(r) for r in D.sort(df, "k", remove_duplicates=True).collect()] == [(1, "a"), (2, "a")]


def test_sampling_is_repeatable_and_over_the_whole(frame):
    df = frame([(i,) for i in range(1000)], "k int")
    first, second = rows(D.row_sampling(df, 50, "k")), rows(D.row_sampling(df.repartition(7), 50, "k"))
    assert first == second and len(first) == 50 and max(k for k, in first) > 500


def test_row_count_observes(frame, tmp_path):
    df, seen = D.row_count(frame([(i,) for i in range(17)], "k int"))
    df.write.parquet(str(tmp_path / "out"))
    assert seen.get["rows"] == 17


def test_command_keeps_the_last_row(frame):
    target = frame([(1, 0), (2, 0)], "k int, v int")
    updates = frame([(1, 1, 5), (1, 2, 6), (1, 3, 4)], "k int, t int, v int")
    assert rows(D.command_as_update(target, updates, ["k"], {"v": "v"}, ["t"])) == [(1, 4), (2, 0)]


def test_for_each_keeps_elements_without_rows(frame):
    got = D.for_each(frame([("a",), ("b",)], "g string"), frame([("a", 1), ("a", 2)], "g string, v int"), ["g"], n="count(*)", s="sum(v)")
    assert rows(got) == [("a", 2, 3), ("b", None, None)]


def test_merge_join_kinds(frame):
    a, b = frame([(1, "x")], "k int, v string"), frame([(2, "y")], "k int, w string")
    assert D.merge_join(a, b, ["k"]).count() == 0
    assert D.merge_join(a, b, ["k"], "left").count() == 1
    assert D.merge_join(a, b, ["k"], "full").count() == 2
    with pytest.raises(ValueError):
        D.merge_join(a, b, ["k"], "cross")


def test_full_merge_join_deals_hot_keys_out(spark, monkeypatch):
    monkeypatch.setattr(skew, "will_broadcast", lambda df: False)
    left = spark.range(9000).selectExpr("if(id % 3 = 0, 7, id % 500) AS k", "id AS a").unionByName(
        spark.createDataFrame([(None, -1)], "k long, a long")
    )
    right = spark.range(900).selectExpr("if(id % 3 = 0, 499, id + 300) AS k", "id AS b").where("k <> 7").unionByName(
        spark.createDataFrame([(7, -7), (None, -2)], "k long, b long")
    )
    got = D.merge_join(left, right, ["k"], "full")
    assert rows(got) == rows(left.join(right, "k", "full").select("k", "a", "b"))
    # the hot key's 3,000 rows are dealt out over many tasks
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        dealt = D.merge_join(left, right, ["k"], "full").where("k = 7").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(dealt) > 8 and max(r["count"] for r in dealt) < 1000


def test_brute_force_helper_counts():
    """Guard for the checks above: the helper itself tells matched from inserted."""
    out = brute_merge([(1, "x", "a", 1)], [(1, "x", "s", 2), (2, "x", "n", 3)], ["a"], ["k", "j"])
    assert out == [(1, "x", "s", 1), (2, "x", None, None)]
