"""Files and tables: scanning, reports, writes and their repetition."""

import pytest
from pyspark.sql import functions as F

from estatelens import schemas, session
from estatelens.sinks import files, tables
from estatelens.sources import corpus, reports
from estatelens.sources.literals import overhead_card, rate_card

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def table(spark):
    made = []

    def name(stem):
        made.append(stem)
        tables.drop(spark, stem)
        return stem

    yield name
    for stem in made:
        tables.drop(spark, stem)


# -- sources


def test_scan_reads_subfolders_and_bad_bytes(spark, tmp_path):
    content = {
        "a.sql": b"SELECT 1;\r\nSELECT 2;",
        "deep/er/b c%20.sql": b"bad \xff byte",
        "x+y.dsql": "Größe".encode(),
        "p.dtsx": b"<x/>",
        "skip.txt": b"no",
    }
    for name, data in content.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    got = {r.path: r.text for r in corpus.scan(spark, str(tmp_path)).collect()}
    assert got == {
        "a.sql": "SELECT 1;\nSELECT 2;",
        "deep/er/b c%20.sql": "bad � byte",
        "x+y.dsql": "Größe",
        "p.dtsx": "<x/>",
    }
    everything = corpus.scan(spark, f"file://{tmp_path}/")
    assert {r.path for r in corpus.packages_of(everything).collect()} == {"p.dtsx"}
    assert corpus.scripts_of(everything).count() == 3


BIG = "".join(
    f"{'go' if i % 7 == 3 else ' GO ; ' if i % 7 == 5 else f'SELECT {i} /* Größe {i} */;'}{end}"
    for i, end in enumerate(["\r\n", "\n", "\n", "\r"] * 60)
)


@pytest.fixture
def mixed(tmp_path):
    """A folder of small and big scripts, and a package that is big too."""
    content = {
        "small.sql": b"SELECT 1;\r\nGO\nSELECT 2;",
        "deep/b c%20+y.sql": BIG.encode(),
        "deep/one.dsql": b"CREATE VIEW v AS\n" + b"SELECT '\xff' AS x, \n" * 50 + b"1\nGO\n  \nGO\n",
        "blank.sql": b"\nGO\n" * 100,
        "p.dtsx": b"<x>" + b"GO\n" * 200 + b"</x>",
        "empty.sql": b"",
    }
    for name, data in content.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return str(tmp_path)


def _statements(scripts):
    place = [c for c in ("piece", "pos") if c in scripts.columns]
    found = {}
    for r in sorted(scripts.collect(), key=lambda r: (r.path, *[r[c] for c in place])):
        found.setdefault(r.path, []).append(r.statement.strip())
    return found


@pytest.mark.parametrize("range_bytes", [37, 400, 1 << 20])
def test_big_scripts_read_by_ranges_give_the_same_statements(spark, mixed, range_bytes):
    from estatelens.plans.corpus import statements

    whole = corpus.scan(spark, mixed)
    want = _statements(statements(corpus.scripts_of(whole)))
    package = corpus.packages_of(whole).first().xml
    # one row per file is refused above the package's size now, and ranges are tiny
    names = {"spark.sql.files.maxPartitionBytes": str(range_bytes), "spark.sql.sources.binaryFile.maxLength": "700"}
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        pieces = corpus.scan_pieces(spark, mixed, whole_bytes=100)
        assert _statements(statements(corpus.scripts_of(pieces))) == want
        assert [r.xml for r in corpus.packages_of(pieces).collect()] == [package]
        batches = corpus.scan_batches(spark, mixed)
        assert _statements(statements(batches)) == want
        with pytest.raises(Exception, match="(?i)length|exceed"):
            corpus.scan(spark, mixed).select("text").collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_objects_of_pieces_keep_their_keys(spark, mixed):
    from estatelens.plans import corpus as plans

    def keyed(scripts):
        return rows(plans.keyed_objects(scripts).select("path", "object_id", "object_type", "nodes"))

    whole = corpus.scripts_of(corpus.scan(spark, mixed))
    pieces = corpus.scripts_of(corpus.scan_pieces(spark, mixed, whole_bytes=100))
    assert keyed(pieces) == keyed(whole)
    none = corpus.scan_pieces(spark, mixed, "*.nothing")
    assert none.count() == 0 and none.columns == ["path", "piece", "text"]


def test_reports(spark, tmp_path):
    sheet = tmp_path / "jobs.csv"
    sheet.write_text("Function Name , Call-Count,other\nf,3,x\n,,\ng,n/a,\n,7,y\n")
    got = reports.read_sheet(spark, str(sheet), schemas.FUNCTIONS)
    assert got.schema == schemas.FUNCTIONS
    assert reports.tidy(spark.read.option("header", True).csv(str(sheet))).columns == ["function_name", "call_count", "other"]
    sheet.write_text("name,count\nf,3.0\ng,n/a\n")
    read = reports.read_sheet(spark, str(sheet), schemas.FUNCTIONS.__class__(schemas.FUNCTIONS.fields[:2]))
    assert sorted(rows(read)) == [("f", 3), ("g", 0)]
    with pytest.raises(ValueError, match="columns"):
        reports.read_sheet(spark, str(sheet), schemas.JOB_DETAILS)
    missing = reports.read_sheet(spark, str(tmp_path / "none.csv"), schemas.JOB_DETAILS)
    assert missing.count() == 0 and missing.schema == schemas.JOB_DETAILS
    from estatelens.plans.inventory import function_report

    raw = spark.read.option("header", True).csv(str(sheet))
    assert rows(function_report(raw)) == [("f", 3, "MS SQL Server"), ("g", 0, "MS SQL Server")]


def test_rate_card_values(spark):
    card = rate_card(spark)
    assert card.schema == schemas.EFFORT_HYPOTHESIS and card.count() == 12
    pairs = card.groupBy("object_type", "complexity_level").pivot(
        "transpilability_status", ["transpilable", "not_transpilable"]
    ).agg(F.first("effort_md_per_unit"))
    assert {round(r.not_transpilable / r.transpilable, 9) for r in pairs.collect()} == {3.0}
    assert rows(overhead_card(spark).select("profile", "rate")) == [("Data Architect", 0.1), ("QA Engineer", 0.2)]


# -- tables


def test_overwrite_with_nothing_empties_the_table(spark, table):
    name = table("t_over")
    tables.overwrite(spark.range(3), name)
    tables.overwrite(spark.range(0), name)
    assert spark.table(name).count() == 0
    tables.append(spark.range(2), name)
    assert spark.table(name).count() == 2


def test_all_null_column_keeps_its_type(spark, table):
    name = table("t_void")
    tables.replace_conformed(spark.range(2).selectExpr("cast(id as string) file_name", "null AS model"), name, schemas.CONVERSION_RESULTS)
    assert spark.table(name).schema == schemas.CONVERSION_RESULTS
    assert spark.table(name).filter("model is null and transpiled is null").count() == 2


def test_a_table_can_be_replaced_by_its_own_result(spark, table):
    name = table("t_self")
    tables.overwrite(spark.range(5), name)
    tables.overwrite_in_place(spark.table(name).withColumn("id", F.col("id") * 10), name)
    assert rows(spark.table(name)) == [(0,), (10,), (20,), (30,), (40,)]


def test_replacing_a_partition_leaves_the_others(spark, table):
    name = table("t_part")
    tables.create(spark, name, "v INT, d DATE", partition_by="d")
    day = lambda v, d: spark.sql(f"SELECT {v} AS v, DATE '{d}' AS d")
    tables.insert_select(day(1, "2001-07-01"), name)
    tables.insert_select(day(2, "2001-08-01"), name)
    for _ in range(2):
        tables.replace_partition(day(3, "2001-08-01"), name, "d", "2001-08-01")
        assert {(r.v, str(r.d)) for r in spark.table(name).collect()} == {(1, "2001-07-01"), (3, "2001-08-01")}
    tables.replace_partition(day(3, "2001-08-01").limit(0), name, "d", "2001-08-01")
    assert {r.v for r in spark.table(name).collect()} == {1}


def test_defaults_and_bound_values(spark, table):
    name = table("t_default")
    tables.create(spark, name, "id INT NOT NULL, active BOOLEAN DEFAULT true, note STRING DEFAULT 'n/a'")
    tables.insert_values(spark, name, {"id": 1, "note": "it's"})
    tables.insert_select(spark.sql("SELECT 2 AS id"), name)
    assert rows(spark.table(name)) == [(1, True, "it's"), (2, True, "n/a")]


def test_truncate_load_and_count(spark, table):
    name = table("t_stage")
    assert tables.identifier("[dw].[dim customer]") == "`dw`.`dim customer`"
    assert tables.identifier("dw.x") == "`dw`.`x`"
    tables.create(spark, name, "id BIGINT")
    assert tables.load(spark.range(4), f"[{name}]") == 4
    assert tables.truncate_load(spark.range(7), f"[{name}]") == 7
    assert tables.read(spark, name).count() == 7


def test_a_stage_can_be_loaded_from_itself(spark, table):
    name = table("stage_self")
    tables.overwrite(spark.range(5), name)
    assert tables.truncate_load(tables.read(spark, name).where("id > 2"), name) == 2
    assert rows(tables.read(spark, name)) == [(3,), (4,)]
    broken = spark.range(3).select(F.raise_error(F.lit("no rows")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no rows"):
        tables.truncate_load(broken, name)
    assert rows(tables.read(spark, name)) == [(3,), (4,)]


def state_of(folder):
    return {(p.parent.name, p.name): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_merge_into_a_stored_table(spark, table, frame, tmp_path):
    name = table("merged")
    old = frame([(i, f"a{i}", i % 5) for i in range(50)] + [(3, "twice", 3), (None, "none", 1), (90, "no day", None)], "k int, v string, day int")
    old.write.option("path", str(tmp_path)).partitionBy("day").saveAsTable(name)
    before = state_of(tmp_path)
    new = frame([(3, "b3", 3), (13, "b13", 3), (100, "new", 7), (None, "n2", 3), (48, "moved", 4)], "k int, v string, day int")
    assert tables.merge_into(new, name, ["k"], "day") == [3, 4, 7]
    after = state_of(tmp_path)
    untouched = {key for key in before if key[0] not in ("day=3", "day=4")}
    assert untouched and all(after[key] == before[key] for key in untouched)
    assert not {key for key in before if key not in untouched} & set(after)
    want = [(i, f"a{i}", i % 5) for i in range(50) if i not in (3, 13, 48)]
    want += [(3, "b3", 3), (3, "b3", 3), (13, "b13", 3), (48, "moved", 4), (100, "new", 7), (None, "n2", 3), (None, "none", 1), (90, "no day", None)]
    assert rows(tables.read(spark, name)) == sorted(want, key=repr)
    # once more changes nothing but adds the row without a key again
    tables.merge_into(new.where("k IS NOT NULL"), name, ["k"], "day")
    assert rows(tables.read(spark, name)) == sorted(want, key=repr)
    # a row that moves leaves its partition, here as the last one of it
    assert tables.merge_into(frame([(100, "moved", 0)], "k int, v string, day int"), name, ["k"], "day") == [0, 7]
    got = {r.k: (r.v, r.day) for r in tables.read(spark, name).where("k IN (90, 100)").collect()}
    assert got == {90: ("no day", None), 100: ("moved", 0)} and tables.read(spark, name).count() == len(want)
    for row in ((90, "day", 2), (1, "no day", None)):
        with pytest.raises(ValueError, match="without a day"):
            tables.merge_into(frame([row], "k int, v string, day int"), name, ["k"], "day")
    with pytest.raises(Exception, match="several rows"):
        tables.merge_into(frame([(1, "x", 1), (1, "y", 1)], "k int, v string, day int"), name, ["k"], "day")
    assert tables.merge_into(new.limit(0), name, ["k"], "day") == []
    assert tables.read(spark, name).count() == len(want)


def test_schema_and_views(spark):
    tables.ensure_schema(spark, "extra_schema")
    tables.ensure_schema(spark, "extra_schema")
    assert "extra_schema" in {r[0] for r in spark.sql("SHOW SCHEMAS").collect()}
    tables.register_view(spark.range(2), "v_two")
    assert tables.read(spark, "v_two").count() == 2
    tables.drop(spark, "no_such_table")


# -- files


def test_texts_come_back_as_written(spark, tmp_path):
    df = spark.createDataFrame([("a.sql", "x\n\n;\n\ny"), ("b_1.sql", "z")], "output_file string, text string")
    files.write_texts(df, str(tmp_path / "out"))
    back = corpus.scan(spark, str(tmp_path / "out"), "*.txt")
    got = {r.path.split("/")[0]: r.text for r in back.collect()}
    assert got == {"output_file=a.sql": "x\n\n;\n\ny\n", "output_file=b_1.sql": "z\n"}


def test_flat_file(spark, tmp_path):
    files.write_flat_file(spark.range(3), str(tmp_path / "flat"), delimiter="|")
    back = spark.read.option("header", True).schema("id bigint").csv(str(tmp_path / "flat"))
    assert rows(back) == [(0,), (1,), (2,)]


# -- durable cut points


def test_durable_uses_the_named_folder(spark):
    cut = session.durable(spark.range(3))
    assert cut.count() == 3
    assert spark.sparkContext.getCheckpointDir()
    folder = spark.sparkContext.getCheckpointDir()
    assert cut.inputFiles() and all(folder.split("/")[-1] in name for name in cut.inputFiles())
    assert session.durable(spark.range(0)).count() == 0


def test_outcome_table_life_cycle(spark, table):
    from estatelens.plans import outcomes

    name = table("t_outcomes")

    def row(key, ok):
        return spark.createDataFrame([(key, ok)], "file_name string, transpiled boolean")

    for _ in range(2):  # a second run gives the same table
        tables.replace_conformed(row("table:a", True).union(row("table:b", False)), name, schemas.CONVERSION_RESULTS)
        merged = outcomes.merge_outcomes(spark.table(name), row("p.dtsx", True).union(row("table:b", True)))
        tables.overwrite_in_place(merged, name)
        got = {r.file_name: r.transpiled for r in spark.table(name).collect()}
        assert got == {"table:a": True, "table:b": True, "p.dtsx": True}
