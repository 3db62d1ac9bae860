"""Folders of scripts and packages as relations, one row per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from estatelens import fixed_values as V
from estatelens.functions.text import decode, decode_bytes, is_batch_line

#: Scripts above this size come batch by batch, so that no task needs room for a whole one.
WHOLE_BYTES = 64 * 1024 * 1024


def scan(spark: SparkSession, folder: str, glob: str = V.CORPUS_GLOB) -> DataFrame:
    """All matching files under ``folder``, subfolders included, as ``(path, text)``.

    ``path`` is relative to ``folder``. One row is one file; Spark packs small files into one task and
    refuses files over 2 GB; see ``scan_pieces`` for those.
    """
    files = _files(spark, "binaryFile", folder, glob)
    return files.select(
        _relative(spark, folder, F.col("path")).alias("path"), decode(F.col("content")).alias("text")
    )


def scan_pieces(
    spark: SparkSession, folder: str, glob: str = V.CORPUS_GLOB, whole_bytes: int = WHOLE_BYTES
) -> DataFrame:
    """All matching files as ``(path, piece, text)``: small ones and packages whole, big scripts by batch.

    ``piece`` is 0 for a whole file and the number of the batch, blank ones counted, for a big script.
    Which files are read which way is decided while they are listed. Batches come without the line ends
    beside their ``GO`` lines, and blank ones are left out; packages stay whole, as XML has no such line.
    """
    whole = (F.col("_metadata.file_size") <= whole_bytes) | _package_name()
    files = _files(spark, "binaryFile", folder, glob).filter(whole)
    small = files.select(
        _relative(spark, folder, F.col("path")).alias("path"),
        F.lit(0).cast("bigint").alias("piece"),
        decode(F.col("content")).alias("text"),
    )
    return small.unionByName(scan_batches(spark, folder, glob, whole_bytes))


def scan_batches(
    spark: SparkSession, folder: str, glob: str = V.CORPUS_GLOB, over_bytes: int = 0
) -> DataFrame:
    """Batches of the scripts above ``over_bytes`` as ``(path, piece, text)``, read by byte ranges.

    Spark's line reader cuts a file into ranges at line ends. Each range counts its own ``GO`` lines and
    puts the lines between them together; the number of a batch is that count plus the counts of the
    ranges before, and parts of a batch that runs over ranges meet under that number. A task holds a range or
    a batch, never a file; one batch is one row. A byte order mark at the start of a file is not kept.
    """
    lines = (
        _files(spark, "text", folder, glob)
        .filter((F.col("_metadata.file_size") > over_bytes) & ~_package_name())
        .select(
            _relative(spark, folder, _unescaped(F.col("_metadata.file_path"))).alias("path"),
            F.col("_metadata.file_block_start").alias("start"),
            # within a range the lines of a file keep their order; across ranges only ``start`` counts
            F.monotonically_increasing_id().alias("at"),
            decode_bytes(F.col("value")).alias("line"),
        )
        .withColumn("ends", is_batch_line(F.col("line")).cast("bigint"))
    )
    of_range = Window.partitionBy("path", "start")
    so_far = of_range.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    parts = (
        lines.withColumns({"local": F.sum("ends").over(so_far), "all": F.sum("ends").over(of_range)})
        .filter(F.col("ends") == 0)
        .groupBy("path", "start", "local", "all")
        .agg(_joined(F.collect_list(F.struct("at", "line")), "line").alias("part"))
    )
    # one row per range of a file
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        lines.groupBy("path", "start")
        .agg(F.sum("ends").alias("ends"))
        .select("path", "start", F.coalesce(F.sum("ends").over(earlier), F.lit(0)).alias("before"))
    )
    piece = (F.col("before") + F.col("local")).alias("piece")
    # a part between two GO lines of its range is a batch already; only parts at the ends of ranges meet others
    inside = (F.col("local") > 0) & (F.col("local") < F.col("all"))
    batches = parts.filter(inside).join(ranges, ["path", "start"]).select("path", piece, F.col("part").alias("text"))
    across = (
        parts.filter(~inside)
        .join(ranges, ["path", "start"])
        .groupBy("path", piece)
        .agg(_joined(F.collect_list(F.struct("start", "part")), "part").alias("text"))
    )
    return batches.unionByName(across).filter(F.rlike("text", F.lit(r"\S")))


def _files(spark: SparkSession, format: str, folder: str, glob: str) -> DataFrame:
    reader = spark.read.format(format).option("recursiveFileLookup", True)
    return reader.option("pathGlobFilter", glob).load(folder)


def _joined(rows: Column, text: str) -> Column:
    """Texts of collected rows in the order of the field before them, a line end between two."""
    return F.array_join(F.array_sort(rows)[text], "\n")


def _package_name() -> Column:
    return F.col("_metadata.file_name").endswith(V.PACKAGE_SUFFIX)


def _relative(spark: SparkSession, folder: str, path: Column) -> Column:
    prefix = len(_qualified(spark, folder).rstrip("/")) + 1
    return F.substring(path, prefix + 1, F.lit(2**31 - 1))


def _unescaped(uri: Column) -> Column:
    """The path in a URI; a plus sign stands for itself there."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder as the file system spells it, the way paths of its files begin."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    file_system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return file_system.makeQualified(path).toString()


def scripts_of(corpus: DataFrame) -> DataFrame:
    """The script files of a scan."""
    return corpus.filter(~F.col("path").endswith(V.PACKAGE_SUFFIX))


def packages_of(corpus: DataFrame) -> DataFrame:
    """The package files of a scan as ``(path, xml)``."""
    return corpus.filter(F.col("path").endswith(V.PACKAGE_SUFFIX)).withColumnRenamed("text", "xml")
