"""Plan shapes that have to hold whatever the size of the tables."""

import os
import re

import pytest

from estatelens.cases.catalog import all_cases

SF = "/root/testdata/sf0.001"
QUERIES = all_cases().queries
# storage clauses need balanced parentheses; the script component runs the user's own code
PYTHON = {
    "corp_strip_with",
    "corp_pdw_clean",
    "corp_pdw_stats",
    "corp_pdw_flat",
    "corp_pdw_route",
    "corp_objects",
    "corp_regroup_files",
    "flow_script_udf",
}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not there")


def plan(spark, name):
    df = QUERIES[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_shape(spark, name):
    text = plan(spark, name)
    assert "NestedLoopJoin" not in text and "CartesianProduct" not in text
    python = re.findall(r"ArrowEvalPython|MapInArrow|BatchEvalPython|FlatMapGroups\w+|MapInPandas", text)
    assert bool(python) == (name in PYTHON)
    for window in text.split(" Window [")[1:]:
        below = re.search(r"Exchange \w+|TakeOrderedAndProject", window)
        assert below and below[0] != "Exchange SinglePartition", "a window over one partition"


def test_numbering_takes_the_top_first(spark):
    text = plan(spark, "etl_incremental_extract")
    assert text.index("Window [") < text.index("TakeOrderedAndProject")
    assert "Exchange SinglePartition" not in text


@pytest.mark.parametrize(
    "name,pushed",
    [
        ("etl_finance_extract", "GreaterThanOrEqual(o_orderdate"),
        ("etl_daily_stage", "GreaterThanOrEqual(l_shipdate"),
        ("flow_source_query", "GreaterThanOrEqual(c_acctbal"),
        ("etl_param_query", "GreaterThanOrEqual(o_orderdate"),
    ],
)
def test_predicates_reach_the_scan(spark, name, pushed):
    assert pushed in plan(spark, name)


@pytest.mark.parametrize("name", ["eff_with_effort", "met_kpi_sheet", "met_assessment_total"])
def test_texts_are_not_read_for_figures(spark, name):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, name))
    assert schemas and not any("text" in s for s in schemas)


def test_the_card_is_broadcast_by_its_size(spark):
    text = plan(spark, "eff_with_effort")
    assert "BroadcastHashJoin" in text and "LocalTableScan" in text


@pytest.mark.parametrize("name", ["eff_estimate", "dash_planning_detail", "met_effort_by_dim", "met_kpi_sheet"])
def test_inventory_and_outcomes_meet_once(spark, name, monkeypatch):
    from estatelens.plans import effort

    stored, store = [], effort.durable
    monkeypatch.setattr(effort, "durable", lambda df: stored.append(df) or store(df))
    last = QUERIES[name](spark, SF)
    texts = [df._jdf.queryExecution().executedPlan().toString() for df in [*stored, last]]
    assert len(stored) == (name != "met_kpi_sheet")
    # sizes are read for the inventory only, labels for the outcomes only
    for column in ("n_chars", "quality"):
        assert sum(len(re.findall(rf"FileScan parquet \[[^\]]*{column}#", text)) for text in texts) == 1


def test_distinct_counts_need_no_expand(spark):
    text = plan(spark, "met_files_by_platform_complexity")
    assert "Expand" not in text and "partial_max" in text


def test_no_query_asks_for_a_broadcast_by_hand():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(os.path.join(root, "estatelens")):
        if os.path.basename(folder) == "llm":
            continue
        for file in files:
            if file.endswith(".py"):
                with open(os.path.join(folder, file), encoding="utf-8") as source:
                    text = source.read()
                assert not re.search(r"F\.broadcast|import broadcast|crossJoin|localCheckpoint|\.toPandas\(|\.rdd\b", text), file
