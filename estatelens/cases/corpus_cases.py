"""Script corpus: cleaning, splitting, objects, keys, files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from estatelens.cases.base import Cases
from estatelens.functions import text as X
from estatelens.functions.storage_clause import strip_storage_clauses
from estatelens.operators.partitioning import spread
from estatelens.plans import corpus
from estatelens.session import ensure_checkpoint_dir
from estatelens.sources import corpus as corpus_files

cases = Cases()

# -- the same texts once more in the dialect of the check (its patterns know no look-around)
NO_COMMENTS = r"regexp_replace(regexp_replace({0}, '/\*(?s:.*?)\*/', '', 'g'), '--[^\n]*', '', 'g')"
IN_PARENS = r"(?:[^()]|\([^()]*\))*"
STORAGE = rf"(?is)\bWITH\b\s*\({IN_PARENS}\b(?:DISTRIBUTION|HEAP|CLUSTERED|COLUMNSTORE|PARTITION)\b{IN_PARENS}\)"
STATISTICS = r"(?is)\bCREATE\s+STATISTICS\b.*?;"
INDEXES = r"(?is)\bCREATE\s+(?:UNIQUE\s+)?(?:(?:NON)?CLUSTERED\s+)?INDEX\b.*?;"
VARCHAR = r"(?i)\b(n?varchar|n?char|varbinary)\s*\(\s*-1\s*\)"
GO_LINE = r"(?im)^[ \t]*GO[ \t]*;?[ \t]*$"
ROUTINE = r"(?is)\bCREATE\s+(?:OR\s+ALTER\s+)?(?:PROC|PROCEDURE|FUNCTION|TRIGGER)\b"
PIECE = r"""(?:''[^'']*''|"[^"]*"|--[^\n]*|/\*(?:[^*]|\*+[^*/])*\*+/|[^;''"/-]|/|-)+"""
NAME = (
    r"(?is)\bCREATE\s+(?:OR\s+ALTER\s+)?(?:PROC(?:EDURE)?|FUNCTION|VIEW|TABLE|TRIGGER|SCHEMA)\s+"
    r"(\[?[\pL\pN_#]+\]?(?:\.\[?[\pL\pN_#]+\]?)?)"
)
TOKEN = r"''[^'']*''|[\pL\pN_@#$]+|[^\s\pL\pN_@#$]"


def _esc(text: str) -> str:
    return text.replace("{", "{{").replace("}", "}}")


CLEANED = _esc(
    rf"""
c1 AS (SELECT path, text, regexp_replace(text, '{STORAGE}', '', 'g') AS t1, len(regexp_extract_all(text, '{STORAGE}')) AS with_clauses FROM [scripts]),
c2 AS (SELECT *, regexp_replace(t1, '{STATISTICS}', '', 'g') AS t2, len(regexp_extract_all(t1, '{STATISTICS}')) AS statistics FROM c1),
c3 AS (SELECT *, regexp_replace(t2, '{INDEXES}', '', 'g') AS t3, len(regexp_extract_all(t2, '{INDEXES}')) AS indexes FROM c2),
c4 AS (SELECT *, regexp_replace(t3, '{VARCHAR}', '\1(max)', 'g') AS t4, len(regexp_extract_all(t3, '{VARCHAR}')) AS varchar_max FROM c3),
cleaned AS (SELECT path, regexp_replace(regexp_replace(t4, '\)\s*\n\s*;', ');', 'g'), '\n[ \t]*\n[ \t]*\n+', chr(10) || chr(10), 'g') AS text,
  CAST(with_clauses AS BIGINT) AS with_clauses, CAST(statistics AS BIGINT) AS statistics, CAST(indexes AS BIGINT) AS indexes, CAST(varchar_max AS BIGINT) AS varchar_max FROM c4),
routed AS (SELECT regexp_replace(path, '\.d?sql$', '.sql') AS path, text FROM cleaned)
"""
).replace("[scripts]", "{scripts}")


def _split(source: str) -> str:
    return _esc(
        rf"""
batches AS (SELECT path, unnest(range(len(b))) AS bpos, unnest(b) AS batch FROM (SELECT path, string_split_regex(text, '{GO_LINE}') AS b FROM [{source}])),
kept AS (SELECT * FROM batches WHERE NOT regexp_full_match(batch, '\s*')),
pieces AS (SELECT path, bpos, CASE WHEN regexp_matches({NO_COMMENTS.format("batch")}, '{ROUTINE}') THEN [batch]
  ELSE list_filter(regexp_extract_all(batch, '{PIECE}'), lambda p: NOT regexp_full_match(p, '\s*')) END AS p FROM kept),
numbered AS (SELECT path, bpos, unnest(range(len(p))) AS spos, unnest(p) AS statement FROM pieces),
statements AS (SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY bpos, spos) - 1 AS INT) AS pos, statement FROM numbered)
"""
    ).replace(f"[{source}]", "{" + source + "}" if source == "scripts" else source)


OBJECTS = _esc(
    rf"""
headed AS (SELECT *, upper(left(ltrim(regexp_replace(statement, '(?s)^\s*(?:--[^\n]*\n|/\*.*?\*/\s*)+', ''), ' ' || chr(9) || chr(10) || chr(13)), 60)) AS h,
    {NO_COMMENTS.format("statement")} AS bare FROM statements),
classed AS (SELECT *, CASE
    WHEN starts_with(h, 'CREATE') THEN CASE WHEN contains(h, 'TABLE') THEN 'CREATE TABLE' WHEN contains(h, 'VIEW') THEN 'CREATE VIEW'
      WHEN contains(h, 'PROC') THEN 'CREATE PROCEDURE' WHEN contains(h, 'FUNCTION') THEN 'CREATE FUNCTION'
      WHEN contains(h, 'SCHEMA') THEN 'CREATE SCHEMA' WHEN contains(h, 'TRIGGER') THEN 'CREATE TRIGGER' ELSE 'CREATE (other)' END
    WHEN regexp_matches(h, '^(ALTER|DROP|TRUNCATE|INSERT|UPDATE|DELETE|MERGE)') THEN regexp_extract(h, '^(ALTER|DROP|TRUNCATE|INSERT|UPDATE|DELETE|MERGE)')
    WHEN regexp_matches(h, '^(SELECT|WITH)') THEN 'SELECT'
    WHEN regexp_extract(h, '\S+') = '' THEN 'OTHER' ELSE regexp_extract(h, '\S+') END AS object_type
  FROM headed WHERE NOT regexp_full_match(bare, '\s*')),
objects AS (SELECT path, pos, coalesce(nullif(replace(replace(regexp_extract(bare, '{NAME}', 1), '[', ''), ']', ''), ''),
      regexp_extract(path, '([^/]*)\.[^./]*$', 1)) AS name, object_type,
    CAST(len(regexp_extract_all(bare, '{TOKEN}')) AS BIGINT) AS nodes, trim(statement, ' ' || chr(9) || chr(10) || chr(13)) AS source,
    regexp_extract(path, '[^/]*$') AS source_file
  FROM classed WHERE object_type NOT IN ('USE', 'SET', 'PRINT', 'GO', 'OTHER', 'DECLARE', 'IF', 'BEGIN', 'END')),
sized AS (SELECT *, CASE WHEN nodes <= 60 THEN 'LOW' WHEN nodes <= 400 THEN 'MEDIUM' ELSE 'HIGH' END AS complexity FROM objects)
"""
)
IDS = """
keyed AS (SELECT *, lower(regexp_extract(object_type, '[^ ]*$')) || ':' || name AS base FROM sized),
counted AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY replace(path, '/', chr(1)), pos) AS n FROM keyed),
ided AS (SELECT * EXCLUDE (base, n), CASE WHEN n > 1 THEN base || '#' || CAST(n AS VARCHAR) ELSE base END AS object_id FROM counted)
"""
RAW_OBJECTS = f"{_split('scripts')}, {OBJECTS}"
CLEAN_OBJECTS = f"{CLEANED}, {_split('routed')}, {OBJECTS}"


def _scripts(t):
    return spread(t["scripts"].select("path", "text"), "path")


def _routed(t):
    return corpus.route_scripts(_scripts(t))


def _documents(t):
    return spread(t["documents"], "doc_id")


@cases.add(
    "corp_scan",
    r"""SELECT 'source=' || source || '/lang=' || lang AS folder, CAST(sum(length(regexp_replace(text, '\r\n?', chr(10), 'g')) + 1) AS BIGINT) AS chars,
  CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS lines FROM {documents} GROUP BY source, lang""",
)
def corp_scan(t):
    """All documents written as text files by source and language, and scanned back from the folders."""
    folder = f"{ensure_checkpoint_dir(t.spark)}/scan-{uuid.uuid4().hex}"
    texts = t["documents"].select("source", "lang", "text")
    texts.write.partitionBy("source", "lang").option("maxRecordsPerFile", 20_000).text(folder)
    text = F.col("text")
    return (
        corpus_files.scan(t.spark, folder, "*.txt")
        .groupBy(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"))
        .agg(
            F.sum(F.length(text)).alias("chars"),
            F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).alias("lines"),
        )
    )


@cases.add(
    "corp_scan_batches",
    _esc(
        rf"""WITH b AS (SELECT unnest(string_split_regex(regexp_replace('-- ' || doc_id || chr(10) || text, '\r\n?', chr(10), 'g'), '{GO_LINE}')) AS batch FROM [documents]),
trimmed AS (SELECT trim(batch, ' ' || chr(9) || chr(10) || chr(13)) AS batch FROM b)
SELECT CAST(nullif(regexp_extract(batch, '^-- (\d+)', 1), '') AS BIGINT) AS doc_id, CAST(length(batch) AS BIGINT) AS chars, md5(batch) AS hash FROM trimmed WHERE batch <> ''"""
    ).replace("[documents]", "{documents}"),
)
def corp_scan_batches(t):
    """All documents as batches of a few long scripts, read back from byte ranges of those."""
    folder = f"{ensure_checkpoint_dir(t.spark)}/batches-{uuid.uuid4().hex}"
    script = F.concat(F.lit("-- "), F.col("doc_id").cast("string"), F.lit("\n"), F.col("text"), F.lit("\nGO"))
    t["documents"].select("source", script.alias("script")).write.partitionBy("source").text(folder)
    batch = F.btrim("text", F.lit(" \t\n\r"))
    found = corpus_files.scan_batches(t.spark, folder, "*.txt").select(batch.alias("batch"))
    return found.filter("batch <> ''").select(
        F.nullif(F.regexp_extract("batch", r"^-- (\d+)", 1), F.lit("")).cast("bigint").alias("doc_id"),
        F.length("batch").cast("bigint").alias("chars"),
        F.md5("batch").alias("hash"),
    )


@cases.add(
    "corp_decode",
    r"""SELECT doc_id, regexp_replace(concat(text, chr(65533), chr(13), chr(10), lang, chr(65533), '('), '\r\n?', chr(10), 'g') AS text FROM {documents}""",
)
def corp_decode(t):
    """Whole texts with stray bytes and foreign line ends back to clean text."""
    stray = F.concat(
        F.encode("text", "UTF-8"),
        F.unhex(F.lit("FF0D0A")),
        F.encode("lang", "UTF-8"),
        F.unhex(F.lit("C328")),
    )
    return _documents(t).select("doc_id", X.decode(stray).alias("text"))


@cases.add(
    "corp_pdw_detect",
    r"""SELECT coalesce(bool_or(path LIKE '%.dsql' OR (path LIKE '%.sql' AND regexp_matches(text, '(?i)\bDISTRIBUTION\s*=|\bCREATE\s+STATISTICS\b'))), FALSE) AS is_export FROM {scripts}""",
)
def corp_pdw_detect(t):
    return corpus.is_warehouse_export(t["scripts"])


@cases.add("corp_pdw_route", f"WITH {CLEANED} SELECT * FROM routed")
def corp_pdw_route(t):
    return _routed(t)


@cases.add("corp_pdw_clean", f"WITH {CLEANED} SELECT * FROM cleaned")
def corp_pdw_clean(t):
    return corpus.clean_scripts(_scripts(t))


@cases.add(
    "corp_pdw_stats",
    f"""WITH {CLEANED} SELECT count(*) AS files, CAST(sum(with_clauses) AS BIGINT) AS with_clauses, CAST(sum(statistics) AS BIGINT) AS statistics,
  CAST(sum(indexes) AS BIGINT) AS indexes, CAST(sum(varchar_max) AS BIGINT) AS varchar_max FROM cleaned""",
)
def corp_pdw_stats(t):
    return corpus.cleaning_totals(corpus.clean_scripts(_scripts(t)))


@cases.add(
    "corp_pdw_flat",
    f"""WITH {CLEANED} SELECT regexp_extract(path, '([^/]*)\\.[^./]*$', 1) || '.sql' AS path, arg_max(text, replace(path, '/', chr(1))) AS text FROM cleaned GROUP BY 1""",
)
def corp_pdw_flat(t):
    return corpus.flatten_files(corpus.clean_scripts(_scripts(t)))


@cases.add(
    "corp_strip_with",
    _esc(
        f"""SELECT path, regexp_replace(text, '{STORAGE}', '', 'g') AS text, CAST(len(regexp_extract_all(text, '{STORAGE}')) AS BIGINT) AS removed FROM [scripts]"""
    ).replace("[scripts]", "{scripts}"),
)
def corp_strip_with(t):
    stripped = strip_storage_clauses(F.col("text"))
    return (
        t["scripts"]
        .select("path", "text", stripped.alias("s"))
        .select(
            "path",
            F.coalesce("s.text", "text").alias("text"),
            F.coalesce("s.removed", F.lit(0)).alias("removed"),
        )
    )


@cases.add(
    "corp_strip_comments",
    f"SELECT path, {NO_COMMENTS.format('text')} AS text FROM {{scripts}}",
)
def corp_strip_comments(t):
    return t["scripts"].select("path", X.strip_comments(F.col("text")).alias("text"))


@cases.add(
    "corp_strip_comments_documents",
    f"SELECT doc_id, {NO_COMMENTS.format('text')} AS text FROM {{documents}}",
)
def corp_strip_comments_documents(t):
    """The same over free text, whole documents."""
    return _documents(t).select("doc_id", X.strip_comments(F.col("text")).alias("text"))


@cases.add(
    "corp_split_go",
    f"WITH {_split('scripts')} SELECT path, CAST(bpos AS INT) AS pos, batch FROM batches",
)
def corp_split_go(t):
    return corpus.batch_rows(_scripts(t))


@cases.add("corp_split", f"WITH {_split('scripts')} SELECT * FROM statements")
def corp_split(t):
    return corpus.statements(_scripts(t))


#: Comments nested 2 to 20 deep, some 1,000, with quotes and semicolons inside.
_DEPTH = "CASE WHEN o_orderkey % 997 = 0 THEN 1000 ELSE CAST(2 + o_orderkey % 19 AS INT) END"
_NESTED = f"concat(repeat('/* a \" b; ', {_DEPTH}), ' ; ', repeat('*/', {_DEPTH}))"


@cases.add(
    "corp_split_nested",
    f"""
SELECT o_orderkey, unnest([0, 1, 2]) AS pos, unnest([concat('SELECT a ', {_NESTED}, ' b'), ' SELECT 2*/*;*/3 ',
  concat(' ', {_NESTED}, ' SELECT 4')]) AS statement FROM {{orders}}""",
)
def corp_split_nested(t):
    """Statements between comments that hold comments."""
    nested = F.expr(_NESTED)
    text = F.concat(F.lit("SELECT a "), nested, F.lit(" b; SELECT 2*/*;*/3 ; "), nested, F.lit(" SELECT 4"))
    scripts = spread(t["orders"].select("o_orderkey"), "o_orderkey").select("o_orderkey", text.alias("text"))
    return scripts.select("o_orderkey", F.posexplode(X.split_statements(F.col("text"))).alias("pos", "statement"))


@cases.add(
    "corp_classify",
    f"WITH {RAW_OBJECTS} SELECT path, pos, object_type FROM classed",
)
def corp_classify(t):
    statement = F.col("statement")
    return (
        corpus.statements(_scripts(t))
        .filter(~X.is_blank(X.strip_comments(statement)))
        .select("path", "pos", X.classify(statement).alias("object_type"))
    )


@cases.add("corp_object_name", f"WITH {RAW_OBJECTS} SELECT path, pos, name FROM objects")
def corp_object_name(t):
    return corpus.objects(_scripts(t)).select("path", "pos", "name")


@cases.add("corp_size_score", f"WITH {RAW_OBJECTS} SELECT path, pos, nodes FROM objects")
def corp_size_score(t):
    return corpus.objects(_scripts(t)).select("path", "pos", "nodes")


@cases.add(
    "corp_complexity",
    f"""WITH {RAW_OBJECTS} SELECT object_type, CASE WHEN nodes <= 12 THEN 'LOW' WHEN nodes <= 25 THEN 'MEDIUM' ELSE 'HIGH' END AS complexity,
  count(*) AS objects FROM objects GROUP BY ALL""",
)
def corp_complexity(t):
    """Size buckets with thresholds set for short scripts."""
    objs = corpus.objects(_scripts(t), low_max=12, medium_max=25)
    return objs.groupBy("object_type", "complexity").agg(F.count("*").alias("objects"))


@cases.add(
    "corp_document_size",
    _esc(
        rf"""SELECT doc_id, greatest(CAST(len(regexp_extract_all({NO_COMMENTS.format("text")}, '{TOKEN}')) AS BIGINT), 1) AS nodes,
  CASE WHEN len(regexp_extract_all({NO_COMMENTS.format("text")}, '{TOKEN}')) <= 60 THEN 'LOW' WHEN len(regexp_extract_all({NO_COMMENTS.format("text")}, '{TOKEN}')) <= 400 THEN 'MEDIUM' ELSE 'HIGH' END AS complexity FROM [documents]"""
    ).replace("[documents]", "{documents}"),
)
def corp_document_size(t):
    """Size and bucket of long free texts, all three buckets in use."""
    return (
        _documents(t)
        .select("doc_id", X.size_score(F.col("text")).alias("nodes"))
        .withColumn("complexity", X.size_bucket(F.col("nodes")))
    )


@cases.add("corp_objects", f"WITH {CLEAN_OBJECTS} SELECT * FROM sized")
def corp_objects(t):
    return corpus.objects(_routed(t))


@cases.add("corp_object_id", f"WITH {CLEAN_OBJECTS}, {IDS} SELECT path, pos, object_id FROM ided")
def corp_object_id(t):
    return corpus.keyed_objects(_routed(t)).select("path", "pos", "object_id")


@cases.add(
    "corp_to_inventory",
    f"""WITH {CLEAN_OBJECTS}, {IDS} SELECT 'MS SQL Server' AS platform, object_id AS file_name, object_type AS job_type,
  complexity AS categorization, nodes AS number_of_nodes, 'YES' AS included FROM ided""",
)
def corp_to_inventory(t):
    return corpus.to_inventory(corpus.keyed_objects(_routed(t)))


@cases.add(
    "corp_regroup_files",
    f"""WITH {CLEAN_OBJECTS}, files AS (SELECT path, regexp_extract(path, '^.*/') || 'converted_' || replace(regexp_extract(path, '([^/]*)\\.[^./]*$', 1), '#', '##') AS name,
  string_agg(source, chr(10) || chr(10) || ';' || chr(10) || chr(10) ORDER BY pos) AS text FROM sized GROUP BY path),
nth AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY path) AS n FROM files)
SELECT path, name || CASE WHEN n > 1 THEN '#' || n ELSE '' END || '.sql' AS output_file, text FROM nth""",
)
def corp_regroup_files(t):
    objs = corpus.objects(_routed(t))
    return corpus.regroup_files(objs.select("path", "pos", F.col("source").alias("code")))


@cases.add(
    "corp_stage_failing",
    """WITH named AS (SELECT o.file_name, regexp_replace(o.file_name, '[^0-9A-Za-z_.]', '_', 'g') AS name, d.text AS source
FROM {outcomes} o JOIN {documents} d ON o.file_name = 'doc_' || CAST(d.doc_id AS VARCHAR) || CASE WHEN d.doc_id % 3 = 0 THEN '.dtsx' ELSE '.sql' END
WHERE NOT o.transpiled AND o.file_type = 'CREATE PROCEDURE'),
nth AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY file_name) AS n FROM named)
SELECT file_name, name || CASE WHEN n > 1 THEN '#' || n ELSE '' END || '.sql' AS staged_as, source FROM nth""",
)
def corp_stage_failing(t):
    sources = t.sql(
        """SELECT concat('doc_', CAST(doc_id AS STRING), CASE WHEN doc_id % 3 = 0 THEN '.dtsx' ELSE '.sql' END) AS file_name, text AS source
FROM {documents}"""
    )
    return corpus.stage_failing(t["outcomes"], sources)
