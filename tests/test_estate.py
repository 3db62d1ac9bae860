"""Packages, outcomes, metrics and effort on small made relations."""

import random

import pytest
from pyspark.sql import functions as F

from estatelens.plans import dashboard, effort, inventory, metrics, outcomes, packages
from estatelens.sources.literals import overhead_card, rate_card

PKG = (
    '<?xml version="1.0"?>\n<DTS:Executable DTS:refId="Package" DTS:ExecutableType="Microsoft.Package">'
    '<DTS:Executables><DTS:Executable DTS:refId="Package\\A" DTS:ExecutableType="Microsoft.ExecuteSQLTask" DTS:ObjectName="Load &amp; go">'
    '<SQLTask:SqlTaskData\n  SQLTask:SqlStatementSource="SELECT 1&#xA;WHERE a &lt; 5 AND b > 3 AND c = &quot;x&amp;lt;&quot;">'
    '<SQLTask:ParameterBinding SQLTask:ParameterName="0" SQLTask:DtsVariableName="$P::N" SQLTask:ParameterDirection="Input"/></SQLTask:SqlTaskData></DTS:Executable>'
    '<DTS:Executable DTS:ExecutableType="Microsoft.SendMailTask" DTS:ObjectName="Mail"/>'
    '<DTS:Executable DTS:ExecutableType="Microsoft.FtpTask"/><DTS:Executable DTS:ExecutableType="Microsoft.FtpTask"/>'
    '<DTS:Executable DTS:ExecutableType="Microsoft.Pipeline"><component name="Src" componentClassID="Microsoft.OLEDBSource">'
    '<property name="SqlCommand">SELECT k FROM t WHERE a &gt; 1</property></component>'
    '<path startId="Src.out" name="a > b" endId="Dst.in"/></DTS:Executable></DTS:Executables>'
    '<DTS:PrecedenceConstraint DTS:From="A" DTS:To="B"/><DTS:PrecedenceConstraint\n DTS:From="B" DTS:To="C"/>'
    '<DTS:PrecedenceConstraint DTS:From="C" DTS:To="A"/></DTS:Executable>'
)


@pytest.fixture
def pkgs(frame):
    return frame([("d/p.dtsx", PKG), ("broken.dtsx", '<DTS:Executable DTS:ExecutableType="Microsoft.XMLTask" <<<'), ("empty.dtsx", "")], "path string, xml string")


def test_components_and_nodes(pkgs):
    got = {r.path: (r.nodes, r.complexity) for r in packages.complexity(pkgs).collect()}
    assert got == {"d/p.dtsx": (6, "LOW"), "broken.dtsx": (1, "LOW"), "empty.dtsx": (0, "LOW")}
    types = [r.component_type for r in packages.components(pkgs).filter("path = 'd/p.dtsx'").orderBy("pos").collect()]
    assert types == ["ExecuteSQLTask", "SendMailTask", "FtpTask", "FtpTask", "Pipeline", "OLEDBSource"]
    flagged = {r.path: r.unsupported for r in packages.unsupported(pkgs).collect()}
    assert flagged == {"d/p.dtsx": "FtpTask, SendMailTask", "broken.dtsx": "XMLTask", "empty.dtsx": ""}


def test_two_policies(spark, pkgs):
    def supported(policy):
        df = packages.transformations(pkgs, packages.support_policy(spark, policy))
        return {r.transformation_type: (r.occurrences, r.jobs_count, r.supported, r.component_level) for r in df.collect()}

    documented, converter = supported("documented"), supported("converter")
    assert documented["FtpTask"] == (2, 1, "UNKNOWN", "Control Flow")
    assert converter["FtpTask"] == (2, 1, "NO", "Control Flow")
    assert documented["OLEDBSource"] == converter["OLEDBSource"] == (1, 1, "YES", "Data Flow")
    loops = packages.support_policy(spark, "converter").filter("transformation_type = 'ForEachLoop'")
    assert loops.first().is_supported
    with pytest.raises(ValueError):
        packages.support_policy(spark, "other")


def test_embedded_sql_and_parameters(pkgs):
    sql = {r.node: (r.sql_text, r.length, r.connection_type) for r in packages.embedded_sql(pkgs).collect()}
    task = 'SELECT 1\nWHERE a < 5 AND b > 3 AND c = "x&lt;"'
    assert sql == {
        "Load & go": (task, len(task), "ExecuteSQLTask"),
        "Src": ("SELECT k FROM t WHERE a > 1", 27, "OLEDBSource"),
    }
    assert [tuple(r) for r in packages.parameters(pkgs).collect()] == [("d/p.dtsx", "Load & go", 0, "0", "$P::N", "Input")]


def test_character_references(frame):
    from estatelens.functions import xml

    texts = {
        "a &#39;b&#x27; &#60;&#x1F600;&#xa;": "a 'b' <\U0001f600\n",
        "&amp;#39; &#38;lt; &amp;lt;&#9;": "&#39; &lt; &lt;\t",
        "&#0; &#xD800; &#x110000; &#; &#12": "&#0; &#xD800; &#x110000; &#; &#12",
        "&#xA": "&#xA",
        "": "",
        "&lt;&gt;&apos;&quot;": "<>'\"",
    }
    df = frame([(t,) for t in texts], "t string")
    assert {r.t: r.u for r in df.select("t", xml.unescape(F.col("t")).alias("u")).collect()} == texts


def test_edges_and_reach(pkgs):
    assert [(r.src, r.dst) for r in packages.data_flow_edges(pkgs).collect()] == [("Src.out", "Dst.in")]
    edges = packages.precedence_edges(pkgs)
    assert [(r.src, r.dst) for r in edges.orderBy("pos").collect()] == [("A", "B"), ("B", "C"), ("C", "A")]
    reach = {(r.src, r.dst): r.hops for r in packages.precedence_reach(edges).collect()}
    assert len(reach) == 9 and reach[("A", "C")] == 2 and reach[("A", "A")] == 3


def test_reach_has_no_limit(frame):
    chain = [("p", i, f"t{i:02}", f"t{i + 1:02}") for i in range(12)] + [("q", 0, "t00", "t12"), ("q", 1, None, "x")]
    edges = frame(chain, "path string, pos int, src string, dst string")
    reach = {(r.path, r.src, r.dst): r.hops for r in packages.precedence_reach(edges).collect()}
    assert len(reach) == 12 * 13 // 2 + 1
    assert reach[("p", "t00", "t12")] == 12 and reach[("q", "t00", "t12")] == 1
    assert packages.precedence_reach(edges.limit(0)).count() == 0


def test_long_chains_take_few_rounds(frame, monkeypatch):
    rounds = []
    monkeypatch.setattr(packages, "durable", lambda df, keep=packages.durable: rounds.append(1) or keep(df))
    n = 1000
    chain = [("p", 0, f"t{i}", f"t{i + 1}") for i in range(n)]
    ring = [("r", 0, f"t{i}", f"t{(i + 1) % 7}") for i in range(7)] + [("r", 0, "t0", "t3")]
    reach = packages.precedence_reach(frame(chain + ring, "path string, pos int, src string, dst string"))
    p = reach.where("path = 'p'").selectExpr("int(substr(src, 2)) a", "int(substr(dst, 2)) b", "hops")
    assert p.count() == n * (n + 1) // 2 and p.where("hops <> b - a").count() == 0
    # the edges, ten rounds that double 1 to 1,024, and one that finds nothing
    assert len(rounds) <= 12
    hops = {(r.src, r.dst): r.hops for r in reach.where("path = 'r'").collect()}
    assert len(hops) == 49 and hops[("t0", "t3")] == 1 and hops[("t6", "t4")] == 3 and hops[("t4", "t4")] == 5


@pytest.mark.parametrize("at_once", [0, 9, 500])
def test_reach_is_the_same_walked_and_joined(frame, at_once):
    ring = [("r", 0, f"t{i}", f"t{(i + 1) % 9}") for i in range(9)]
    cross = [("x", 0, a, b) for a, b in ["ab", "ab", "bc", "cb", "ad", "dc", "ce", "ee", "fa"]]
    rows = ring + cross + [("s", 0, "a", "a"), ("n", 0, None, "b"), ("n", 0, "a", None), (None, 0, "a", "b")]
    want = {}
    for path, _, a, b in rows:
        if path and a and b:
            want[path, a, b] = 1
    for _ in range(9):
        for (p, a, b), n in list(want.items()):
            for (q, c, d), m in list(want.items()):
                if p == q and b == c:
                    want[p, a, d] = min(n + m, want.get((p, a, d), n + m))
    reach = packages.precedence_reach(frame(rows, "path string, pos int, src string, dst string"), at_once)
    assert reach.schema.simpleString() == "struct<path:string,src:string,dst:string,hops:int>"
    got = reach.collect()
    assert len(got) == len(want) and {(r.path, r.src, r.dst): r.hops for r in got} == want


def test_small_packages_are_stored_once_and_never_joined(frame, monkeypatch):
    stored = []
    monkeypatch.setattr(packages, "durable", lambda df, keep=packages.durable: stored.append(1) or keep(df))
    rings = [(f"p{k}", 0, f"t{i}", f"t{(i + 1) % 40}") for k in range(3) for i in range(40)]
    assert packages.precedence_reach(frame(rings, "path string, pos int, src string, dst string")).count() == 3 * 1600
    assert len(stored) == 2


def test_package_outcomes(frame):
    clean = '<c componentClassID="Microsoft.OLEDBSource"/>'
    mail = '<c ExecutableType="Microsoft.SendMailTask"/>'
    pk = frame([("ok", clean), ("mail", mail), ("none", clean), ("msg", clean), ("both", mail), ("dry", clean)], "path string, xml string")
    out = frame([("ok", "b.py", "spark.sql( spark.sql("), ("ok", "a.py", "spark.sql("), ("mail", "m.py", "spark.sql("), ("msg", "g.py", "spark.sql("), ("dry", "d.py", "x")], "path string, output_file string, code string")
    diag = frame([("msg", 1, "first\nsecond line"), ("msg", 2, "other"), ("both", 1, "bad")], "path string, ord int, message string")
    got = {r.file_name: r for r in outcomes.package_outcomes(pk, out, diag).collect()}
    assert (got["ok"].transpiled, got["ok"].failure_reason, got["ok"].success_count, got["ok"].output_file) == (True, None, 3, "a.py, b.py")
    assert got["ok"].transpilation_scope == "Converted — 3 Spark SQL cell(s)"
    assert got["mail"].failure_reason == "Components requiring manual rewrite (not converted): SendMailTask"
    assert got["mail"].transpilation_scope == "Partial — 1 cell(s) converted; manual review required"
    assert got["none"].failure_reason == got["dry"].failure_reason == "No Spark SQL emitted — review manually"
    assert got["none"].transpilation_scope == "Not converted — manual review required"
    assert (got["msg"].failure_reason, got["msg"].error_count) == ("first; other", 2)
    assert got["both"].failure_reason == "bad; Components requiring manual rewrite (not converted): SendMailTask"


def test_object_outcomes(frame):
    attempts = frame(
        [("a", "T", "e", 2, [], None, None), ("b", "T", "e", 1, ["x", "y"], None, None), ("c", "T", "e", 5, [], "Err", "l" * 300 + "\nmore"), ("d", "T", "e", None, [], "Err", "")],
        "file_name string, file_type string, engine string, success_count bigint, errors array<string>, exception_type string, exception_message string",
    )
    got = {r.file_name: r for r in outcomes.object_outcomes(attempts).collect()}
    assert (got["a"].transpiled, got["a"].failure_reason, got["a"].error_count) == (True, None, 0)
    assert (got["b"].transpiled, got["b"].failure_reason, got["b"].error_count) == (False, "x; y", 2)
    assert (got["c"].success_count, got["c"].error_count, got["c"].failure_reason) == (0, 1, "Err: " + "l" * 300)
    assert got["d"].failure_reason == "Err: " and got["a"].transpilation_scope == "Object"
    rate = outcomes.success_rate(outcomes.object_outcomes(attempts)).first()
    assert (rate.objects, rate.converted, rate.percent) == (4, 1, 25)
    nothing = outcomes.success_rate(outcomes.object_outcomes(attempts.limit(0))).first()
    assert (nothing.objects, nothing.converted, nothing.percent) == (0, 0, 0)


INV = "platform string, file_name string, job_type string, categorization string, number_of_nodes bigint, included string"
OUT = "file_name string, engine string, model string, success_count bigint, transpiled boolean, failure_reason string"


def estate(frame, n=400):
    rng = random.Random(2)
    inv = [(rng.choice(["SSIS", "MS SQL Server"]), f"f{rng.randint(0, n // 2)}", "T", rng.choice(["LOW", "MEDIUM", "HIGH"]), rng.choice([None, i]), "YES") for i in range(n)]
    out = [(f"f{i}", "e", None, i, rng.choice([True, False, None]), None) for i in range(0, n // 2, 2)]
    return inv, out, frame(inv, INV), frame(out, OUT)


def test_measures_against_plain_counting(frame):
    inv, out, inv_df, out_df = estate(frame)
    ok = {r[0]: r[4] for r in out}
    view = metrics.assessment_metrics(inv_df, out_df)
    names = ["Total Files", "Transpilable Files", "Not Transpilable Files", "Low Complexity Files", "Avg Nodes per File", "Transpilability Rate"]
    got = {r["Platform"]: r for r in view.query(names, by=["Platform"]).collect()}
    for platform in ("SSIS", "MS SQL Server"):
        mine = [r for r in inv if r[0] == platform]
        good = {r[1] for r in mine if ok.get(r[1]) is not False}
        every = {r[1] for r in mine}
        nodes = [r[4] for r in mine if r[4] is not None]
        row = got[platform]
        assert row["Total Files"] == len(every)
        assert row["Transpilable Files"] == len(good)
        assert row["Not Transpilable Files"] == len(every - good)
        assert row["Low Complexity Files"] == len({r[1] for r in mine if r[3] == "LOW"})
        assert row["Avg Nodes per File"] == pytest.approx(sum(nodes) / len(nodes))
        assert row["Transpilability Rate"] == pytest.approx(100 * len(good) / len(every))
    everything = view.query(["Total Files"]).first()["Total Files"]
    assert everything == len({r[1] for r in inv}) < sum(r["Total Files"] for r in got.values())


def test_measures_of_nothing(frame):
    view = metrics.assessment_metrics(frame([], INV), frame([], OUT))
    row = view.query(["Total Files", "Transpilable Files", "Transpilability Rate", "Avg Nodes per File"]).first()
    assert tuple(row) == (0, 0, None, None)
    assert view.query(["Total Files"], by=["Platform"]).count() == 0


def test_where_is_applied_before_measuring(frame):
    inv, _, inv_df, out_df = estate(frame)
    got = metrics.assessment_metrics(inv_df, out_df).query(["Total Files"], where=F.col("categorization") == "LOW")
    assert got.first()[0] == len({r[1] for r in inv if r[3] == "LOW"})


def test_effort(spark, frame):
    inv = frame(
        [("SSIS", "a.dtsx", "Package", "HIGH", 1, "YES"), ("SSIS", "b.dtsx", "Package", "LOW", 1, "YES"), ("MS SQL Server", "t:x", "T", "MEDIUM", 1, "YES"), ("MS SQL Server", "t:y", "T", "ODD", 1, "YES"), ("MS SQL Server", "t:z", "T", "LOW", 1, "YES")],
        INV,
    )
    out = frame([("a.dtsx", "e", None, 1, True, None), ("b.dtsx", "e", None, 1, False, None), ("t:x", "e", None, 1, True, None), ("t:z", "e", None, 1, None, None)], OUT)
    card, over = rate_card(spark), overhead_card(spark)
    rows = {r.object_name: r.effort_md for r in effort.effort_estimate(inv, out, card, over).filter("platform is not null").collect()}
    assert rows == {"a.dtsx": 0.5, "b.dtsx": 0.75, "t:x": 1.5, "t:z": 0.6}
    objs = effort.file_effort(inv, out)
    assert [r.object_name for r in effort.unpriced(objs, card).collect()] == ["t:y"]
    extra = {r.profile: r.effort_md for r in effort.overhead(effort.with_effort(objs, card), over).collect()}
    assert extra == {"Data Architect": 0.34, "QA Engineer": 0.67}  # of 3.35, half up
    total = dashboard.effort_by(effort.effort_estimate(inv, out, card, over)).first()[0]
    assert total == pytest.approx(3.35 + 0.34 + 0.67)


def test_rate_card_display(spark):
    got = dashboard.rate_card_dataset(rate_card(spark), overhead_card(spark)).collect()
    assert len(got) == 14 and [r.sort_key for r in got] == [1] * 12 + [2] * 2
    assert got[0]["Object Type"] == "SQL Statement" and got[0]["Complexity"] == "HIGH"
    assert got[12]["Notes"] == "10% of dev total — Design, technical governance, code review"
    cut = overhead_card(spark, [("X", 0.29, "n")]).select(dashboard.percent_note("rate", "notes"))
    assert cut.first()[0] == "28% of dev total — n"


def test_job_report(frame):
    raw = frame([("x/y/p", "f", "s", "YES", "Package", "LOW", "12.0", "r"), ("q.dtsx", "f", "s", "YES", "Package", "LOW", "bad", "r"), (None,) * 8], "`File Name` string, a string, b string, c string, d string, e string, `# Nodes` string, z string")
    got = {r.file_name: r.number_of_nodes for r in inventory.job_details(raw, "SSIS").collect()}
    assert got == {"p.dtsx": 12, "q.dtsx": 0}
    plain = {r.file_name for r in inventory.job_details(raw, "MS SQL Server").collect()}
    assert plain == {"p", "q.dtsx"}


def test_measures_in_any_order(frame):
    view = metrics.assessment_metrics(frame([], INV), frame([], OUT))
    names = list(view.measures)
    for first in range(len(names)):
        turned = names[first:] + names[:first]
        assert view.query(turned).columns == turned
    assert len(view.query(["Avg Nodes per File", "Total Files"], by=["Platform"]).columns) == 3
