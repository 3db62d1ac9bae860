"""From script files to objects: clean, split, classify, size, key.

Every step is DataFrame to DataFrame over ``(path, text)``, so the work spreads by file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatelens import fixed_values as V
from estatelens.functions import scalars as S
from estatelens.functions import text as X
from estatelens.functions.storage_clause import strip_storage_clauses
from estatelens.operators.numbering import occurrence_number
from estatelens.session import durable

COUNTERS = ["with_clauses", "statistics", "indexes", "varchar_max"]


# -- cleaning


def is_warehouse_export(scripts: DataFrame) -> DataFrame:
    """One row, one boolean: do the scripts come from the parallel warehouse product?

    True if any file ends in ``.dsql`` or any text shows its DDL; all files are read whole.
    """
    by_name = F.col("path").endswith(".dsql")
    by_text = F.col("path").endswith(".sql") & F.rlike("text", F.lit(V.WAREHOUSE_MARK))
    flag = F.coalesce(F.bool_or(F.col("hit")), F.lit(False)).alias("is_export")
    return scripts.select((by_name | by_text).alias("hit")).agg(flag)


def _clean(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``text`` cleaned in place and the four counters beside it."""
    c = F.col(text)

    def count(frame: DataFrame, counter: str, before: str, after: str, pattern: str) -> DataFrame:
        # most texts hold no match, and then need no second search
        found = F.regexp_count(before, F.lit(pattern)).cast("bigint")
        changed = F.col(before) != F.col(after)
        return frame.withColumn(counter, F.when(changed, found).when(c.isNotNull(), 0).cast("bigint"))

    def remove(frame: DataFrame, start: str, counter: str) -> DataFrame:
        # most texts have no such statement and are only looked through once; where there is one, it
        # ends in a semicolon, so the text after the last semicolon is not searched
        pattern = start + V.TO_SEMICOLON
        head, rest = X.up_to_last(F.col("_found"), ";")
        found = frame.withColumn("_found", F.when(F.rlike(c, F.lit(start)), c))
        cut = found.withColumns({"_head": head, "_rest": rest}).drop("_found")
        done = cut.withColumn("_done", F.regexp_replace("_head", pattern, ""))
        counted = count(done, counter, "_head", "_done", pattern)
        cleaned = F.coalesce(F.concat("_done", "_rest"), c)
        return counted.withColumn(text, cleaned).drop("_head", "_rest", "_done")

    stripped = df.withColumn("_stripped", strip_storage_clauses(c)).withColumns(
        {
            "with_clauses": F.when(c.isNotNull(), F.coalesce("_stripped.removed", F.lit(0))),
            text: F.coalesce("_stripped.text", c),
        }
    )
    out = stripped.drop("_stripped")
    out = remove(out, V.CREATE_STATISTICS, "statistics")
    out = remove(out, V.CREATE_INDEX, "indexes")
    out = out.withColumn("_done", F.regexp_replace(c, V.VARCHAR_MINUS_ONE, "$1(max)"))
    out = count(out, "varchar_max", text, "_done", V.VARCHAR_MINUS_ONE)
    out = out.withColumn(text, F.col("_done")).drop("_done")
    out = out.withColumn(text, F.regexp_replace(c, V.CLOSE_THEN_SEMICOLON, ");"))
    return out.withColumn(text, F.regexp_replace(c, V.BLANK_LINES, "\n\n"))


def clean_scripts(scripts: DataFrame) -> DataFrame:
    """Scripts without product-only DDL, with what was removed per file."""
    return _clean(scripts, "text")


def cleaned_path(c: str | Column) -> Column:
    """A cleaned file keeps its folder and is always a ``.sql`` file."""
    return F.regexp_replace(c, r"\.d?sql$", ".sql")


def cleaning_totals(cleaned: DataFrame) -> DataFrame:
    """Files and removals over a cleaned corpus."""
    return cleaned.agg(
        F.count("*").alias("files"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in COUNTERS],
    )


def flatten_files(cleaned: DataFrame) -> DataFrame:
    """A flat folder: one file per stem, the last in path order wins, as a plain copy would do."""
    row = F.struct(path_order("path").alias("o"), "text")
    return (
        cleaned.groupBy(F.concat(S.stem("path"), F.lit(".sql")).alias("path"))
        .agg(F.max(row).alias("last"))
        .select("path", F.col("last.text").alias("text"))
    )


def route_scripts(scripts: DataFrame) -> DataFrame:
    """Scripts cleaned if the corpus is a warehouse export, else as they are; never a driver branch.

    Where the flag is false the cleaning sees nulls and costs nothing.
    """
    flag = is_warehouse_export(scripts).scalar()
    gated = scripts.withColumns({"_flag": flag, "_text": F.when(flag, F.col("text"))})
    cleaned = _clean(gated, "_text")
    return cleaned.select(
        *[c for c in scripts.columns if c not in ("path", "text")],
        F.when(F.col("_flag"), cleaned_path("path")).otherwise(F.col("path")).alias("path"),
        F.coalesce("_text", "text").alias("text"),
    )


# -- objects


def path_order(c: str | Column) -> Column:
    """A text that sorts like the path's parts, folder by folder."""
    return F.translate(c, "/", "\x01")


def batch_rows(scripts: DataFrame) -> DataFrame:
    """One row per batch, blank ones included: ``(path, pos, batch)``."""
    return scripts.select("path", F.posexplode(X.batches(F.col("text"))).alias("pos", "batch"))


def statements(scripts: DataFrame) -> DataFrame:
    """One row per statement: ``(path, pos, statement)``, with ``piece`` where scripts come in pieces."""
    return scripts.select(
        *_place(scripts), F.posexplode(X.split_statements(F.col("text"))).alias("pos", "statement")
    )


def objects(
    scripts: DataFrame,
    strict: bool = False,
    low_max: int = V.OBJECT_LOW_MAX,
    medium_max: int = V.OBJECT_MEDIUM_MAX,
) -> DataFrame:
    """One row per object to migrate. Comment-only and auxiliary statements are left out.

    Where scripts come in pieces (``sources.corpus.scan_pieces``), ``pos`` counts within the piece.
    """
    place = _place(scripts)
    statement, bare = F.col("statement"), F.col("bare")
    name = F.coalesce(X.name_in(bare), S.stem("path"))
    return (
        scripts.select(*place, F.posexplode(X.statement_records(F.col("text"), strict)).alias("pos", "r"))
        .select(*place, "pos", "r.*")
        .filter(~X.is_blank(bare))
        .withColumn("object_type", X.kind_of(F.col("head"), strict))
        .filter(~F.col("object_type").isin(*V.SKIPPED_STATEMENTS))
        .withColumn("nodes", X.size_of(bare, statement))
        .select(
            *place,
            "pos",
            name.alias("name"),
            "object_type",
            "nodes",
            X.size_bucket(F.col("nodes"), low_max, medium_max).alias("complexity"),
            X.strip(statement).alias("source"),
            S.base_name("path").alias("source_file"),
        )
    )


def _place(rows: DataFrame) -> list[str]:
    """The columns that say where in the corpus a text stands."""
    return ["path", "piece"] if "piece" in rows.columns else ["path"]


def base_key(lower: bool = False) -> Column:
    """``<last word of the type>:<name>``; ``lower`` treats names that differ in case as one."""
    name = F.lower("name") if lower else F.col("name")
    return F.concat(F.lower(F.substring_index("object_type", " ", -1)), F.lit(":"), name)


def object_ids(objs: DataFrame, lower: bool = False, **spreading: int) -> DataFrame:
    """Objects with ``object_id``: the base key, and ``#n`` from its second occurrence on.

    Occurrences count in path order, then statement order. See ``keyed_objects`` for a whole corpus.
    """
    # the piece is part of the first order column, by which hot groups are cut
    pieces = [F.lpad(F.col(c).cast("string"), 19, "0") for c in _place(objs)[1:]]
    order = F.concat_ws("\0", path_order("path"), *pieces)
    keyed = objs.select("*", base_key(lower).alias("_base"), order.alias("_order"))
    numbered = occurrence_number(keyed, ["_base"], ["_order", "pos"], out="_n", **spreading)
    suffix = F.when(F.col("_n") > 1, F.concat(F.lit("#"), F.col("_n").cast("string"))).otherwise("")
    return numbered.withColumn("object_id", F.concat("_base", suffix)).drop("_base", "_order", "_n")


def keyed_objects(scripts: DataFrame, **options) -> DataFrame:
    """Objects of a corpus with their keys, without their text.

    The slim rows are stored in the checkpoint folder first: numbering reads them twice, and splitting
    every script twice would cost far more than writing a few short columns once.
    """
    slim = durable(objects(scripts, **options).drop("source"))
    return object_ids(slim)


def to_inventory(objs_with_ids: DataFrame) -> DataFrame:
    """Objects as inventory rows."""
    return objs_with_ids.select(
        F.lit(V.PLATFORM_SQL).alias("platform"),
        F.col("object_id").alias("file_name"),
        F.col("object_type").alias("job_type"),
        F.col("complexity").alias("categorization"),
        F.col("nodes").cast("bigint").alias("number_of_nodes"),
        F.lit("YES").alias("included"),
    )


# -- texts back to files


def regroup_files(code: DataFrame) -> DataFrame:
    """Converted blocks ``(path, pos, code)``, also with ``piece``, put together again, one row per source file.

    A group is one file: it holds no more than the file it was split from. Files are told apart by
    their whole path and written beside each other as in their folders; where two files of a folder
    differ in their suffix only, the later path gets a number behind a ``#``, and each ``#`` of a file's own
    name is doubled, so that no name is made twice. Names are numbered without their texts. Empty blocks are
    left out.
    """
    blocks = F.array_sort(F.collect_list(F.struct(*_place(code)[1:], "pos", "code")))
    folder = F.regexp_extract("path", r"(?s)^.*/", 0)
    own = F.replace(S.stem("path"), F.lit("#"), F.lit("##"))
    name = F.concat(folder, F.lit("converted_"), own, F.lit(".sql"))
    full = code.filter((F.coalesce(F.col("code"), F.lit("")) != "") & F.col("path").isNotNull())
    named = full.withColumn("output_file", name).repartition("output_file")
    texts = named.groupBy("output_file", "path").agg(F.array_join(blocks["code"], V.BLOCK_SEPARATOR).alias("text"))
    return _numbered_names(texts, "output_file", "path").select("path", "output_file", "text")


def _numbered_names(files: DataFrame, name: str, order: str) -> DataFrame:
    """File names made unique: the n-th of a name, by ``order``, ends in ``#n.sql`` from the second on."""
    nth = F.row_number().over(Window.partitionBy(name).orderBy(order))
    numbered = F.concat(F.regexp_replace(name, r"\.sql$", "#"), F.col("_nth").cast("string"), F.lit(".sql"))
    return (
        files.withColumn("_nth", nth)
        .withColumn(name, F.when(F.col("_nth") > 1, numbered).otherwise(F.col(name)))
        .drop("_nth")
    )


def stage_failing(outcomes: DataFrame, sources: DataFrame) -> DataFrame:
    """Procedures that did not convert, with the file name they are staged under.

    ``sources`` is ``(file_name, source)``; an outcome without a source is skipped.
    """
    failing = outcomes.filter(~F.col("transpiled") & (F.col("file_type") == "CREATE PROCEDURE"))
    staged = F.regexp_replace("file_name", V.STAGED_NAME_BAD, "_")
    found = failing.select("file_name").join(sources.select("file_name", "source"), "file_name")
    named = found.select("file_name", F.concat(staged, F.lit(".sql")).alias("staged_as"), "source")
    return _numbered_names(named, "staged_as", "file_name")
