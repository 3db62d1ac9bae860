"""A whole assessment over a small folder, twice."""

import pytest
from pyspark.sql import functions as F

from estatelens.operators.chain import run_chain
from estatelens.plans import dashboard, metrics, run
from estatelens.sinks import tables
from estatelens.sources import corpus

SCRIPT = """USE db
GO
CREATE TABLE dbo.T (a varchar(-1)) WITH (HEAP);
CREATE VIEW dbo.V AS SELECT a FROM dbo.S;
GO
CREATE PROCEDURE dbo.P AS BEGIN DELETE FROM dbo.T; INSERT INTO dbo.T SELECT ISNULL(a, 0) FROM dbo.V; END
"""
PACKAGE = '<DTS:Executable DTS:ExecutableType="Microsoft.Package"><DTS:Executable DTS:ExecutableType="Microsoft.ExecuteSQLTask" DTS:ObjectName="L"><T SqlStatementSource="SELECT 1"/></DTS:Executable></DTS:Executable>'


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.dsql").write_text(SCRIPT)
    (tmp_path / "in" / "sub" / "a.sql").write_text("CREATE TABLE dbo.T (b int);")
    (tmp_path / "in" / "sub" / "p.dtsx").write_text(PACKAGE)
    return tmp_path


def attempts(objects):
    failed = F.col("object_type") == "CREATE PROCEDURE"
    return objects.select(
        F.col("object_id").alias("file_name"),
        F.col("object_type").alias("file_type"),
        F.lit("sql_rules").alias("engine"),
        F.lit(1).cast("bigint").alias("success_count"),
        F.when(failed, F.array(F.lit("no"))).otherwise(F.array().cast("array<string>")).alias("errors"),
        F.lit(None).cast("string").alias("exception_type"),
        F.lit(None).cast("string").alias("exception_message"),
    )


def test_assessment_from_folder_to_figures(spark, folder):
    db = "assess_db"
    for _ in range(2):
        stored = run.assess(spark, str(folder / "in"), db)
        details = {r.file_name: r.job_type for r in stored["job_details"].collect()}
        assert details == {
            "table:dbo.T": "CREATE TABLE",
            "view:dbo.V": "CREATE VIEW",
            "procedure:dbo.P": "CREATE PROCEDURE",
            "table:dbo.T#2": "CREATE TABLE",
            "sub/p.dtsx": "Package",
        }
        assert "ISNULL" in {r.function_name for r in stored["functions"].collect()}
        assert stored["sql_statements"].first().sql_text == "SELECT 1"
        first = stored["objects"].filter("object_id = 'table:dbo.T'").first()
        assert first.source == "CREATE TABLE dbo.T (a varchar(max))"

        pkgs = corpus.packages_of(corpus.scan(spark, str(folder / "in")))
        outputs = spark.createDataFrame([("sub/p.dtsx", "p.py", "spark.sql(1)")], "path string, output_file string, code string")
        none = spark.createDataFrame([], "path string, ord int, message string")
        results = run.record_outcomes(spark, db, attempts(stored["objects"]), pkgs, outputs, none)
        assert {r.file_name for r in results.filter("not transpiled").collect()} == {"procedure:dbo.P"}

        run.stage_failing(spark, db, str(folder / "staged"))
        staged = corpus.scan(spark, str(folder / "staged"), "*.txt").collect()
        assert [r.path.split("/")[0] for r in staged] == ["staged_as=procedure_dbo.P.sql"]
        assert staged[0].text.startswith("CREATE PROCEDURE")

        views = run.metric_views(spark, db)
        row = views["assessment_metrics"].query(["Total Files", "Transpilable Files"]).first()
        assert tuple(row) == (5, 4)
        sheet = {r.metric: r.value for r in run.kpi_sheet(spark, db).collect()}
        assert views["effort_metrics"].query(["Effort (MD)"]).first()[0] == 1.89
        # three low SQL objects at 0.2, one rewrite at 0.6, one orchestration at 0.25; 30 % overhead
        assert sheet == {"Total files": "5", "Transpilability %": "80.0", "Total effort (MD)": "1.89"}
        summary = dashboard.migration_summary(tables.read(spark, f"{db}.job_details"), results)
        assert dashboard.objects_by(summary, "Platform").count() == 2


def test_converted_texts_are_written_and_read_back(spark, tmp_path):
    rows = [("d/a.sql", 1, "B"), ("d/a.sql", 0, "A\n\nA"), ("d/a.dsql", 0, "é"), ("d/a#2.sql", 0, "own"), ("x.sql", 0, "")]
    written = run.write_converted(spark.createDataFrame(rows, "path string, pos int, code string"), str(tmp_path / "out"))
    names = {r.path: r.output_file for r in written.collect()}
    back = spark.read.text(str(tmp_path / "out"), wholetext=True)
    got = {r.output_file: r.value.removesuffix("\n") for r in back.collect()}
    assert got == {names["d/a.sql"]: "A\n\nA\n\n;\n\nB", names["d/a.dsql"]: "é", names["d/a#2.sql"]: "own"}


def test_assessment_of_scripts_only(spark, tmp_path):
    (tmp_path / "x.sql").write_text("SELECT 1;")
    stored = run.assess(spark, str(tmp_path), "assess_small")
    assert stored["transformations"].count() == 0 and stored["sql_statements"].count() == 0
    assert [r.file_name for r in stored["job_details"].collect()] == ["select:x"]


def test_chain_runs_in_order_and_names_the_failing_step(spark):
    def stage(state):
        return {"stage": spark.range(5)}

    def fact(state):
        return {"rows": state["stage"].count() + state["start"]}

    assert run_chain([("stage", stage), ("fact", fact)], {"start": 1})["rows"] == 6
    with pytest.raises(RuntimeError, match="'fact'"):
        run_chain([("fact", fact), ("stage", stage)])


def test_stored_chain_goes_on_where_it_stopped(spark, tmp_path):
    runs, broken = [], [True]

    def stage(state):
        runs.append("stage")
        return {"stage": spark.range(5), "none": spark.range(0)}

    def fact(state):
        runs.append("fact")
        state["stage"].write.mode("overwrite").parquet(f"{tmp_path}/chain/fact/fact")  # written in part
        if broken:
            raise OSError(broken.pop())
        return {"fact": state["stage"].selectExpr("id + 1 AS id")}

    steps, store = [("stage", stage), ("fact", fact)], f"{tmp_path}/chain"
    with pytest.raises(RuntimeError, match="'fact'"):
        run_chain(steps, store=store, spark=spark)
    for _ in range(2):
        got = run_chain(steps, store=store, spark=spark)
        assert sorted(r.id for r in got["fact"].collect()) == [1, 2, 3, 4, 5] and got["none"].count() == 0
    assert runs == ["stage", "fact", "fact"]
    with pytest.raises(RuntimeError, match="'n'"):
        run_chain([("n", lambda s: {"n": 1})], store=store, spark=spark)
    with pytest.raises(ValueError):
        run_chain([steps[0], steps[0]], store=store, spark=spark)


def test_durable_folders_can_be_released(spark):
    from estatelens.session import durable, release, written

    before = len(written())
    kept, dropped = durable(spark.range(3)), durable(spark.range(4))
    mine = written()[before:]
    assert release(spark, mine, still_read=kept) == [mine[1]]
    assert written()[before:] == [mine[0]] and kept.count() == 3
    assert release(spark, mine) == [mine[0]] and len(written()) == before
