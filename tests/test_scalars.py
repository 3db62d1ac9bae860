"""Scalars with traps: midnights, months' ends, nulls, stems."""

import pathlib

import pytest
from pyspark.sql import functions as F

from estatelens.functions import scalars as S


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_day_difference_counts_midnights(spark):
    assert one(spark, S.datediff_day(S.as_of("2024-01-01 23:00:00"), S.as_of("2024-01-02 01:00:00"))) == 1
    assert one(spark, S.datediff_day(S.as_of("2024-01-02"), S.as_of("2024-01-01 23:59:59"))) == -1
    assert one(spark, S.datediff_month(S.as_of("2024-01-31"), S.as_of("2024-02-01"))) == 1


def test_adding_months_keeps_to_the_month_end(spark):
    assert str(one(spark, S.dateadd("MONTH", -3, S.as_of("2024-05-31")))) == "2024-02-29 00:00:00"
    assert str(one(spark, S.dateadd("DAY", -7, S.as_of("2024-03-05 10:30:00")))) == "2024-02-27 10:30:00"
    with pytest.raises(ValueError):
        S.dateadd("HOUR", 1, F.lit(None))


def test_texts_of_moments(spark):
    moment = S.as_of("2024-03-05 10:30:05")
    assert one(spark, S.convert_120(moment)) == "2024-03-05 10:30:05"
    assert one(spark, S.convert_120(moment, 10)) == "2024-03-05"
    assert one(spark, S.utc_stamp(moment)) == "20240305103005"
    assert one(spark, S.as_of(None)) is not None


def test_nulls(spark):
    assert one(spark, S.plus(F.lit("a"), F.lit(None).cast("string"))) is None
    assert one(spark, S.isnull(F.lit(None).cast("string"), "N/A")) == "N/A"


@pytest.mark.parametrize("path", ["a/b/x.sql", "x", "a/.hidden", "a.b/c.tar.gz", "q/x.", "ü/é.dsql"])
def test_stem_and_base_name(spark, path):
    assert one(spark, S.base_name(F.lit(path))) == pathlib.PurePosixPath(path).name
    if not path.endswith("."):
        assert one(spark, S.stem(F.lit(path))) == pathlib.PurePosixPath(path).stem


@pytest.mark.parametrize(
    "name,want",
    [(" File Name ", "file_name"), ("a--b", "a_b"), ("_x_", "x"), ("Größe (cm)", "größe_cm"), ("½ x", "½_x"), ("", "")],
)
def test_names(spark, name, want):
    assert S.normalize_header(name) == want
    assert one(spark, S.normalize_name(F.lit(name))) == want


def test_lines(spark):
    assert one(spark, S.line_count(F.lit("a\nb\n"))) == 3
    assert one(spark, S.first_line(F.lit("ab\x85cd"), 9)) == "ab"
    assert one(spark, S.first_line(F.lit("abc\ndef"), 2)) == "ab"
