"""Script text functions on edge texts, and against a plain character scanner."""

import random
import re

import pytest
from pyspark.sql import functions as F

from estatelens import fixed_values as V
from estatelens.functions import text as X
from estatelens.plans import corpus


def run(frame, texts, column):
    rows = frame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    out = rows.select("i", column(F.col("text")).alias("r")).collect()
    return [r["r"] for r in sorted(out, key=lambda r: r["i"])]


def scan(batch):
    """Statements of a batch by walking over its characters."""
    out, start, i, n = [], 0, 0, len(batch)
    while i < n:
        two = batch[i : i + 2]
        if batch[i] in "'\"":
            quote = batch[i]
            i += 1
            while True:
                if i >= n:
                    return [s for s in batch.split(";") if s.strip()]
                if batch[i] == quote and batch[i : i + 2] != quote * 2:
                    break
                i += 2 if batch[i] == quote else 1
            i += 1
        elif two == "--":
            while i < n and batch[i] != "\n":
                i += 1
        elif two == "/*":
            depth, i = 1, i + 2
            while i < n and depth:
                two = batch[i : i + 2]
                depth += {"/*": 1, "*/": -1}.get(two, 0)
                i += 2 if two in ("/*", "*/") else 1
        elif batch[i] == ";":
            out.append(batch[start:i])
            start = i = i + 1
        else:
            i += 1
    out.append(batch[start:])
    return [s for s in out if s.strip()]


def test_split_semicolons_like_a_scanner(frame):
    rng = random.Random(7)
    parts = ["'", '"', ";", "--", "/*", "*/", "\n", "a", " ", "''", "-", "/", "*", "GO", "(", "é"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(3000)]
    got = run(frame, texts, X.split_semicolons)
    for text, pieces in zip(texts, got):
        assert pieces == scan(text), text


def test_nothing_but_separators_is_lost(frame):
    texts = ["a;b;;c", "x 'y;z' ; -- t;u\n v", "'open ; quote; here", ";;;"]
    for text, pieces in zip(texts, run(frame, texts, X.split_semicolons)):
        assert "".join(pieces).replace(";", "").split() == text.replace(";", "").split()


@pytest.mark.parametrize(
    "text",
    [
        "a\nGO\nb",
        "a\n go ; \nb\nGo\n",
        "a GO\nb",
        "GOTO x\nGO\n",
        "a\n\tGO\t\nb",
        "GO",
        "x\nGO -- no\ny",
    ],
)
def test_batches_are_cut_at_go_lines(frame, text):
    want = re.split(r"(?im)^[ \t]*GO[ \t]*;?[ \t]*$", text)
    assert run(frame, [text], X.batches) == [want]


def test_routines_stay_whole(frame):
    routine = "CREATE OR ALTER PROC p AS BEGIN SELECT 1; SELECT 2; END"
    hidden = "-- CREATE PROC x\nSELECT 1; SELECT 2"
    got = run(frame, [f"USE a;\nGO\n{routine}\nGO\nSELECT 3;", hidden], X.split_statements)
    assert [s.strip() for s in got[0]] == ["USE a", routine, "SELECT 3"]
    assert len(got[1]) == 2


KINDS = [
    ("CREATE TABLE a (b int)", "CREATE TABLE"),
    ("create or alter view v as select 1", "CREATE VIEW"),
    ("CREATE VIEW v AS SELECT * FROM BigTable", "CREATE TABLE"),
    ("CREATE PROCEDURE p AS SELECT 1", "CREATE PROCEDURE"),
    ("CREATE FUNCTION f() RETURNS INT", "CREATE FUNCTION"),
    ("CREATE SCHEMA s", "CREATE SCHEMA"),
    ("CREATE TRIGGER t ON x", "CREATE TRIGGER"),
    ("CREATE UNIQUE INDEX i ON t (a)", "CREATE (other)"),
    ("CREATE LOGIN joe", "CREATE (other)"),
    ("alter table t add c int", "ALTER"),
    ("DROP TABLE t", "DROP"),
    ("TRUNCATE TABLE t", "TRUNCATE"),
    ("insert into t select 1", "INSERT"),
    ("UPDATE t SET a = 1", "UPDATE"),
    ("DELETE FROM t", "DELETE"),
    ("MERGE t USING s ON 1=1", "MERGE"),
    ("SELECT 1", "SELECT"),
    ("WITH c AS (SELECT 1) SELECT * FROM c", "SELECT"),
    ("EXEC p 1", "EXEC"),
    ("print 'x'", "PRINT"),
    ("-- note\nSELECT 1", "SELECT"),
    ("/* a */ /* b\n */\n-- c\nDROP VIEW v", "DROP"),
    ("-- a\n  -- b\nSELECT 1", "--"),
    ("   ", "OTHER"),
    ("-- " + "x" * 100 + "\n" + "CREATE TABLE t", "CREATE TABLE"),
    ("CREATE " + " " * 60 + "TABLE t", "CREATE (other)"),
]


def test_kinds(frame):
    got = run(frame, [t for t, _ in KINDS], X.classify)
    assert got == [k for _, k in KINDS]


def test_strict_kind_looks_at_the_next_word_only(frame):
    text = [
        "CREATE VIEW v AS SELECT * FROM BigTable", "CREATE OR ALTER PROC p AS SELECT 1", "create" + " " * 5000 + "view v_TableX as select 1",
        "CREATE /* a */ OR\n-- b\nALTER\n\n" + "\t" * 90 + "FUNCTION f()", "-- x\n/* y */ " + "LONG" * 40 + " 1", "INSERT\nINTO t", "",
    ]
    got = run(frame, text, lambda c: X.classify(c, strict=True))
    assert got == ["CREATE VIEW", "CREATE PROCEDURE", "CREATE VIEW", "CREATE FUNCTION", "LONG" * 40, "INSERT", "OTHER"]


def test_names(frame):
    texts = {
        "CREATE TABLE [dbo].[My_T] (a int)": "dbo.My_T",
        "create or alter proc dbo.p as select 1": "dbo.p",
        "/* CREATE TABLE no */ CREATE VIEW v AS SELECT 1": "v",
        "CREATE TABLE #tmp (a int)": "#tmp",
        "CREATE TABLE a.b.c (x int)": "a.b",
        "CREATE VIEW Größe AS SELECT 1": "Größe",
        "SELECT 1": None,
    }
    assert run(frame, list(texts), X.object_name) == list(texts.values())


def test_size_and_buckets(frame):
    got = run(frame, ["SELECT a, 'x y' FROM t -- no", "/* only */\n\n"], X.size_score)
    assert got == [6, 3]
    sizes = frame([(n,) for n in (60, 61, 400, 401)], "n int")
    assert [r[0] for r in sizes.select(X.size_bucket(F.col("n"))).collect()] == ["LOW", "MEDIUM", "MEDIUM", "HIGH"]
    nodes = frame([(n,) for n in (9, 10, 19, 20)], "n int")
    assert [r[0] for r in nodes.select(X.package_bucket(F.col("n"))).collect()] == ["LOW", "MEDIUM", "MEDIUM", "HIGH"]


def test_decode_like_python(spark):
    raw = [b"ok", b"a\xffb", b"\xc3(", b"\xe2\x82", b"\xf0\x9f\x98", b"x\r\ny\rz\n", "ü€😀".encode(), b"\xed\xa0\x80"]
    rows = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(raw)], "i int, b binary")
    got = {r["i"]: r["t"] for r in rows.select("i", X.decode(F.col("b")).alias("t")).collect()}
    for i, b in enumerate(raw):
        want = b.decode("utf-8", errors="replace").replace("\r\n", "\n").replace("\r", "\n")
        assert got[i] == want, b


def test_very_long_texts(frame):
    """Megabytes of statements, one long literal, long comments: no stack overflow, nothing lost."""
    many = "SELECT 'a;b', \"c\" /* d; */ FROM t; -- e\n" * 40_000
    literal = "SELECT '" + "x;''" * 300_000 + "' AS a; SELECT 2"
    comments = "-- line\n" * 100_000 + "SELECT 1"
    nested = "/*" * 8 + " ; " + "*/" * 8 + "SELECT 1; SELECT 2"
    got = run(frame, [many, literal, comments, nested], X.split_statements)
    assert [len(s) for s in got] == [40_001, 2, 1, 2]
    assert run(frame, [comments], X.classify) == ["SELECT"]


@pytest.mark.parametrize("depth", [2, 9, 10, 60, 1000])
def test_comments_nested_at_any_depth(frame, depth):
    nested = "/*'" * depth + " ; \x00b " + "*/" * depth
    text = f"SELECT 1 {nested}; SELECT '/*'; {nested} SELECT 2*/*;*/3 -- /* ;\n; SELECT 4 /* /* ; */ ;"
    assert run(frame, [text], X.split_semicolons) == [scan(text)]
    assert len(scan(text)) == 4


def test_usual_nested_comments_go_by_a_pattern(frame, monkeypatch):
    """Mark by mark only where a comment is left open or nested deeper than the pattern goes."""
    by_marks = X._split_nested
    monkeypatch.setattr(X, "_split_nested", lambda batch: F.transform(by_marks(batch), lambda p: F.concat(F.lit("!"), p)))
    rng = random.Random(11)
    parts = ["/*", "/*", "*/", "*/", ";", "'", '"', "--", "\n", "a", "*", "/"]
    texts = ["".join(rng.choices(parts, k=rng.randint(4, 40))) for _ in range(2000)]
    deep = X._PATTERN_DEPTH
    texts += ["a; " + "/* ; " * d + "*/" * d + " b; c" for d in (2, deep, deep + 1)] + ["/* /* */ ; a", "/* /* */ */ ' ; b"]
    got = run(frame, texts, X.split_semicolons)
    for text, pieces in zip(texts, got):
        assert [p.removeprefix("!") for p in pieces if p.removeprefix("!").strip()] == scan(text), text
    assert [any(p.startswith("!") for p in pieces) for pieces in got[-5:]] == [False, False, True, True, False]


def test_cleaning_looks_once_for_each_start(frame):
    scripts = frame([("a.sql", "x"), ("b.sql", None)], "path string, text string")
    plan = corpus.clean_scripts(scripts)._jdf.queryExecution().optimizedPlan().toString()
    # the pattern alone, not the one that goes on to the semicolon
    assert [plan.count(start + ")") for start in (V.CREATE_STATISTICS, V.CREATE_INDEX)] == [1, 1]


@pytest.mark.parametrize(
    "pattern,plain",
    [
        (V.ROUTINE, r"(?isU)\bCREATE\s+(?:OR\s+ALTER\s+)?(?:PROC|PROCEDURE|FUNCTION|TRIGGER)\b"),
        (V.CREATE_STATISTICS, r"(?isU)\bCREATE\s+STATISTICS\b"),
        (V.CREATE_INDEX, r"(?isU)\bCREATE\s+(?:UNIQUE\s+)?(?:(?:NON)?CLUSTERED\s+)?INDEX\b"),
        (V.VARCHAR_MINUS_ONE, r"(?iU)\b(n?varchar|n?char|varbinary)\s*\(\s*-1\s*\)"),
        (V.WAREHOUSE_MARK, r"(?iU)\bDISTRIBUTION\s*=|\bCREATE\s+STATISTICS\b"),
        (rf"(?iU){V.STORAGE_WORD}", r"(?iU)\b(?:DISTRIBUTION|HEAP|CLUSTERED|COLUMNSTORE|PARTITION)\b"),
        (rf"(?iU){V.WITH_OPEN}", r"(?iU)\bWITH\b\s*\("),
    ],
)
def test_a_letter_before_a_word_boundary_changes_nothing(frame, pattern, plain):
    rng = random.Random(5)
    words = "create CREATE Create statistics STATI\u017fTICS unique index proc TRIGGER nvarchar NCHAR varbinary distribution "
    words += "heap Clustered PARTITION\u0301 with _with \u00e9create xcreate 9heap = ( -1 ) (-1) \u0130NDEX \u212aheap"
    texts = ["".join(w + rng.choice(["", " ", "\n", "\u00a0"]) for w in rng.choices(words.split(), k=8)) for _ in range(1500)]
    got = run(frame, texts, lambda c: F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))
    assert got == run(frame, texts, lambda c: F.regexp_extract_all(c, F.lit(plain), F.lit(0)))


def test_block_comments_end_at_the_first_mark(frame):
    texts = ["a/*/b*/c*/d", "/***/x/**/", "/* * / **/y/*", "a/*\n*\n*/b", "*//*/", "/*" + "*" * 100_000 + "/z"]
    want = [re.sub(r"(?s)/\*.*?\*/", "", t) for t in texts]
    assert run(frame, texts, X.strip_comments) == want


def test_many_nested_comments(frame):
    """A semicolon and a nested comment two hundred thousand times, marks that touch, and an open end."""
    one = "SELECT 1 /* a /* ; */ b */ ;"
    texts = [one * 100_000, "/*" * 300_000 + ";", "/*/*" + "*/" * 300_000 + "a;b", "/*/**/ ' " * 50_000 + ";", "/* /* */ '"]
    texts += ["a /*/**/*/ ; 'x /*;' ; b", "a; /* /* */ */ ' ; b", ""]
    got = run(frame, texts, X.split_semicolons)
    assert len(got[0]) == 100_000 and set(got[0]) == {one[:-1]}
    assert got[1:] == [scan(t) for t in texts[1:]]


def test_objects_and_ids(frame):
    scripts = frame(
        [
            ("a/x.sql", "CREATE TABLE t (i int);\n-- only a comment\n;USE db;"),
            ("a-b/x.sql", "CREATE TABLE t (j int); SELECT 1; SELECT 2;"),
            ("b.sql", "SET NOCOUNT ON; SELECT 3; create table T (k int)"),
        ],
        "path string, text string",
    )
    objs = corpus.objects(scripts)
    ids = {(r.path, r.pos): r.object_id for r in corpus.object_ids(objs).collect()}
    # folders sort by their parts: a/… before a-b/…
    assert ids == {
        ("a/x.sql", 0): "table:t",
        ("a-b/x.sql", 0): "table:t#2",
        ("a-b/x.sql", 1): "select:x",
        ("a-b/x.sql", 2): "select:x#2",
        ("b.sql", 1): "select:b",
        ("b.sql", 2): "table:T",
    }
    lower = {(r.path, r.pos): r.object_id for r in corpus.object_ids(objs, lower=True).collect()}
    assert lower[("b.sql", 2)] == "table:t#3"
    keyed = {(r.path, r.pos): r.object_id for r in corpus.keyed_objects(scripts).collect()}
    assert keyed == ids


def test_empty_corpus_gives_empty_tables(frame):
    scripts = frame([], "path string, text string")
    assert corpus.object_ids(corpus.objects(scripts)).count() == 0
    assert corpus.is_warehouse_export(scripts).collect() == [(False,)]
    assert corpus.cleaning_totals(corpus.clean_scripts(scripts)).collect() == [(0, 0, 0, 0, 0)]
    assert corpus.route_scripts(scripts).count() == 0


def test_sniffing(frame):
    def flag(rows):
        return corpus.is_warehouse_export(frame(rows, "path string, text string")).first()[0]

    mark = "CREATE TABLE t (a int) WITH (distribution = HASH(a))"
    assert flag([("a.dsql", "SELECT 1")])
    assert flag([("a.sql", mark)])
    assert not flag([("a.dtsx", mark)])
    assert not flag([("a.sql", "SELECT 1")])
    assert flag([("a.sql", "x" * 300_000 + " " + mark)])
    many = [(f"{i:03}.sql", "SELECT 1") for i in range(30)] + [("999.sql", mark)]
    assert flag(many)


def test_cleaning(frame):
    text = (
        "CREATE TABLE t (a nvarchar(-1), b VARBINARY ( -1 ))\nWITH (DISTRIBUTION = HASH(a), HEAP)\n;\n"
        "CREATE STATISTICS s ON t (a);\n\n\n\nCREATE UNIQUE CLUSTERED INDEX i ON t (a);\nSELECT 1 OPTION (LABEL = 'x');"
    )
    row = corpus.clean_scripts(frame([("d/a.dsql", text)], "path string, text string")).first()
    assert row.text == "CREATE TABLE t (a nvarchar(max), b VARBINARY(max));\n\nSELECT 1 OPTION (LABEL = 'x');"
    assert (row.with_clauses, row.statistics, row.indexes, row.varchar_max) == (1, 1, 1, 2)


def test_routing_leaves_other_sources_alone(frame):
    rows = [("a.sql", "CREATE TABLE t (a varchar(-1));")]
    assert corpus.route_scripts(frame(rows, "path string, text string")).first().text == rows[0][1]
    export = rows + [("b/c.dsql", "SELECT 1")]
    got = {r.path: r.text for r in corpus.route_scripts(frame(export, "path string, text string")).collect()}
    assert got == {"a.sql": "CREATE TABLE t (a varchar(max));", "b/c.sql": "SELECT 1"}


def test_flat_copy_keeps_the_last_file_of_a_name(frame):
    rows = [("a/x.sql", "1"), ("b/x.dsql", "2"), ("b/y.sql", "3")]
    got = corpus.flatten_files(frame(rows, "path string, text string")).collect()
    assert {r.path: r.text for r in got} == {"x.sql": "2", "y.sql": "3"}


def test_blocks_are_made_once_for_texts_and_names(frame):
    """The plan below the numbered names holds the costly blocks once, also for copies and odd paths."""
    rows = [("d/a.x", 1, "2"), ("d/a.x", 0, "1"), ("d/a.y", 0, "3"), ("e/a.x", 0, "4"), ("d/b.x", 0, ""), (None, 0, "5")]
    made = frame(rows, "path string, pos int, code string").withColumn("code", F.reverse(F.reverse("code")))
    files = corpus.regroup_files(made)
    assert files._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    got = {(r.path, r.output_file): r.text.replace(V.BLOCK_SEPARATOR, "|") for r in files.collect()}
    assert got == {
        ("d/a.x", "d/converted_a.sql"): "1|2", ("d/a.y", "d/converted_a#2.sql"): "3", ("e/a.x", "e/converted_a.sql"): "4"
    }


def test_regrouped_files_keep_order(frame):
    rows = [("d/a.sql", 2, "C"), ("d/a.sql", 0, "A"), ("d/a.sql", 1, ""), ("e/a.sql", 0, "Z"), ("f.sql", 0, None), ("d/a.dsql", 0, "B")]
    got = corpus.regroup_files(frame(rows, "path string, pos int, code string")).collect()
    assert {(r.path, r.output_file): r.text for r in got} == {
        ("d/a.dsql", "d/converted_a.sql"): "B",
        ("d/a.sql", "d/converted_a#2.sql"): "A\n\n;\n\nC",
        ("e/a.sql", "e/converted_a.sql"): "Z",
    }


def test_no_converted_name_is_made_twice(frame):
    stems = ["a", "a#2", "a##2", "a#", "a#3", "a##", "b"]
    paths = [f"d/{stem}.{suffix}" for stem in stems for suffix in ("sql", "dsql", "SQL")] + ["a.sql", "e/a.sql"]
    rows = [(p, 0, p) for p in paths]
    got = corpus.regroup_files(frame(rows, "path string, pos int, code string")).collect()
    names = [r.output_file for r in got]
    assert len(set(names)) == len(names) == len(paths) and all(r.path == r.text for r in got)


def test_function_calls(frame):
    text = "SELECT ISNULL(SUM(x), 0), 'f(x)', dbo.g (1) -- h(2)"
    assert run(frame, [text], X.function_calls) == [["ISNULL", "SUM", "G"]]


HOSTILE = {
    "open comments": "/* x " * 60_000,
    "comment ends only": "*/ " * 60_000,
    "statistics without an end": "CREATE STATISTICS s ON t (a)\nGO\n" * 40_000,
    "index without an end": "CREATE INDEX i ON t (a)\nGO\n" * 40_000,
    "hints": "SELECT 1 FROM t WITH (NOLOCK) " * 40_000,
    "open storage clauses": "WITH (HEAP " * 40_000,
    "open clauses": "WITH ( x " * 40_000 + "HEAP",
    "one long word": "a" * 1_000_000,
    "blank lines after a bracket": ")" + "\n" * 50_000 + "x",
    "open quotes": "' \" " * 60_000 + "'",
    "dashes": "-" * 500_000 + "\n" + "/" * 500_000,
}


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_hostile_texts_take_linear_time(frame, name):
    """Each would take many minutes if a pattern searched on to the end from every place."""
    import time

    started = time.time()
    scripts = frame([("a.dsql", HOSTILE[name])], "path string, text string")
    corpus.objects(corpus.route_scripts(scripts)).count()
    scripts.select(X.function_calls(F.col("text")), X.size_score(F.col("text"))).collect()
    assert time.time() - started < 60


def test_comment_stripping_like_python(frame):
    rng = random.Random(11)
    parts = ["/*", "*/", "--", "\n", "a", "*", "/", " "]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(3000)]
    for text, got in zip(texts, run(frame, texts, X.strip_comments)):
        want = re.sub(r"--[^\n]*", "", re.sub(r"/\*.*?\*/", "", text, flags=re.S))
        assert got == want, text


def test_lenient_numbers(frame):
    from estatelens.functions import scalars as S

    texts = ["12", " 12.9 ", "-3.5", "1e3", "", "x", None, "12d", "inf", "NaN", "1e300", "0x10"]
    got = run(frame, texts, S.to_number)
    assert got == [12, 12, -3, 1000, 0, 0, 0, 0, 0, 0, 0, 0]
