"""Inventory, packages, outcomes and the outcome table's life cycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from estatelens import fixed_values as V
from estatelens import schemas
from estatelens.cases.base import Cases
from estatelens.cases.corpus_cases import NO_COMMENTS, TOKEN, _esc, _scripts
from estatelens.operators.partitioning import spread
from estatelens.plans import inventory, outcomes, packages

cases = Cases()

UNSUPPORTED = ", ".join(f"'{t}'" for t in V.UNSUPPORTED_COMPONENTS)
TYPES = r"""regexp_extract_all(xml, '(?:componentClassID|ExecutableType)="([^"]+)"', 1)"""
FLAGGED = f"""array_to_string(list_sort(list_distinct(list_transform(list_filter({TYPES}, lambda t: t IN ({UNSUPPORTED})), lambda t: replace(t, 'Microsoft.', '')))), ', ')"""


def _packages(t, name="packages"):
    return spread(t[name].select("path", "xml"), "path")


# -- inventory


@cases.add(
    "inv_report_clean",
    """SELECT " File Name " AS file_name, "Folder/Path" AS folder, "Source  File" AS source_file, "Included?" AS included,
  "Job-Type" AS job_type, "Categorization" AS categorization, "Number of Nodes" AS number_of_nodes
FROM {raw_report} WHERE " File Name " IS NOT NULL""",
)
def inv_report_clean(t):
    return inventory.report_rows(t["raw_report"])


@cases.add(
    "inv_job_details",
    r"""WITH named AS (SELECT *, regexp_extract(" File Name ", '[^/]*$') AS n FROM {raw_report} WHERE " File Name " IS NOT NULL)
SELECT "Remark" AS platform, CASE WHEN "Remark" = 'SSIS' AND n NOT LIKE '%.dtsx' THEN n || '.dtsx' ELSE n END AS file_name,
  "Job-Type" AS job_type, "Categorization" AS categorization, coalesce(CAST(trunc(TRY_CAST("Number of Nodes" AS DOUBLE)) AS BIGINT), 0) AS number_of_nodes, "Included?" AS included
FROM named""",
)
def inv_job_details(t):
    raw = t["raw_report"]
    return inventory.combine(
        [
            inventory.job_details(raw.filter(F.col("Remark") == platform), platform)
            for platform in (V.PLATFORM_SQL, V.PLATFORM_PACKAGE)
        ]
    )


@cases.add(
    "inv_type_complexity",
    "SELECT job_type, categorization, count(*) AS objects FROM {inventory} GROUP BY job_type, categorization",
)
def inv_type_complexity(t):
    return inventory.by_type_and_size(t["inventory"])


@cases.add(
    "inv_platforms_present",
    """WITH files AS (SELECT path FROM {scripts} UNION ALL SELECT path FROM {packages})
SELECT bool_or(path NOT LIKE '%.dtsx') AS has_scripts, bool_or(path LIKE '%.dtsx') AS has_packages FROM files""",
)
def inv_platforms_present(t):
    return inventory.technologies(t["scripts"].select("path").union(t["packages"].select("path")))


@cases.add(
    "inv_functions",
    _esc(
        rf"""WITH calls AS (SELECT unnest(regexp_extract_all(regexp_replace({NO_COMMENTS.format("text")}, '''[^'']*''', '''''', 'g'), '([\pL_][\pL\pN_]*)[ \t\n]*\(', 1)) AS f FROM [scripts])
SELECT upper(f) AS function_name, count(*) AS call_count, 'MS SQL Server' AS platform FROM calls GROUP BY 1"""
    ).replace("[scripts]", "{scripts}"),
)
def inv_functions(t):
    return inventory.function_counts(_scripts(t))


# -- packages


@cases.add(
    "pkg_components",
    f"""WITH found AS (SELECT path, list_filter(list_transform({TYPES}, lambda t: replace(t, 'Microsoft.', '')), lambda t: t <> 'Package') AS l FROM {{packages}})
SELECT path, CAST(unnest(range(len(l))) AS INT) AS pos, unnest(l) AS component_type FROM found""",
)
def pkg_components(t):
    return packages.components(_packages(t))


@cases.add(
    "pkg_complexity",
    f"""WITH n AS (SELECT path, CAST(len(list_filter({TYPES}, lambda t: t <> 'Microsoft.Package')) AS BIGINT) AS nodes FROM {{packages}})
SELECT path, nodes, CASE WHEN nodes < 10 THEN 'LOW' WHEN nodes < 20 THEN 'MEDIUM' ELSE 'HIGH' END AS complexity FROM n""",
)
def pkg_complexity(t):
    return packages.complexity(_packages(t))


@cases.add("pkg_unsupported", f"SELECT path, {FLAGGED} AS unsupported FROM {{packages}}")
def pkg_unsupported(t):
    return packages.unsupported(_packages(t))


LEVELLED = """found AS (
  SELECT path, replace(unnest(regexp_extract_all(xml, 'ExecutableType="([^"]+)"', 1)), 'Microsoft.', '') AS transformation_type, 'Control Flow' AS component_level FROM {packages}
  UNION ALL SELECT path, replace(unnest(regexp_extract_all(xml, 'componentClassID="([^"]+)"', 1)), 'Microsoft.', ''), 'Data Flow' FROM {packages}),
counted AS (SELECT transformation_type, component_level, count(*) AS occurrences, count(DISTINCT path) AS jobs_count FROM found WHERE transformation_type <> 'Package' GROUP BY ALL)"""


def _in(names):
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


@cases.add(
    "pkg_transformations",
    f"""WITH {LEVELLED} SELECT *, CASE WHEN transformation_type IN {_in(V.SUPPORTED_TYPES)} THEN 'YES' WHEN transformation_type IN {_in(V.NOT_SUPPORTED_TYPES)} THEN 'NO' ELSE 'UNKNOWN' END AS supported FROM counted""",
)
def pkg_transformations(t):
    return packages.transformations(_packages(t), packages.support_policy(t.spark))


@cases.add(
    "pkg_support_policy",
    f"""WITH {LEVELLED} SELECT *, CASE WHEN transformation_type IN {_in(V.SUPPORTED_TYPES + V.NOT_SUPPORTED_TYPES[1:])} THEN 'YES'
  WHEN 'Microsoft.' || transformation_type IN {_in(V.UNSUPPORTED_COMPONENTS)} THEN 'NO' ELSE 'UNKNOWN' END AS supported FROM counted""",
)
def pkg_support_policy(t):
    """The same with the converter's reading of what is supported."""
    return packages.transformations(_packages(t), packages.support_policy(t.spark, "converter"))


UNESCAPED = "replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#xA;', chr(10)), '&amp;', '&')"


@cases.add(
    "pkg_embedded_sql",
    _esc(
        rf"""WITH p AS (SELECT path, xml FROM [packages] UNION ALL SELECT path, xml FROM [flow_packages]),
tasks AS (SELECT path, unnest(regexp_extract_all(xml, '<DTS:Executable [^>]*ExecutableType="Microsoft.ExecuteSQLTask"[^>]*>(?:<SQLTask:SqlTaskData|<T) [^>]*>')) AS chunk FROM p),
sources AS (SELECT path, unnest(regexp_extract_all(xml, '<component [^>]*>(?:<properties><property name="AccessMode">2</property>)?<property name="SqlCommand">[^<]*<')) AS chunk FROM p),
found AS (
  SELECT path, coalesce(nullif(regexp_extract(chunk, 'DTS:ObjectName="([^"]*)"', 1), ''), 'ExecuteSQLTask') AS node, regexp_extract(chunk, 'Connection="([^"]*)"', 1) AS c, 'ExecuteSQLTask' AS ty,
    regexp_extract(chunk, 'SqlStatementSource="([^"]*)"', 1) AS raw FROM tasks
  UNION ALL
  SELECT path, coalesce(nullif(regexp_extract(chunk, ' name="([^"]*)"[^>]*>', 1), ''), 'OLEDBSource'), '', 'OLEDBSource', regexp_extract(chunk, 'name="SqlCommand">([^<]*)<', 1) FROM sources),
texts AS (SELECT path, CASE WHEN node IN ('AccessMode', 'SqlCommand') THEN ty ELSE node END AS node, c, ty, {UNESCAPED.format("raw")} AS sql_text FROM found)
SELECT regexp_extract(path, '[^/]*$') AS package_name, node, CASE WHEN len(regexp_extract_all(sql_text, '{TOKEN}')) <= 60 THEN 'LOW' ELSE 'MEDIUM' END AS complexity,
  CASE WHEN c <> '' THEN c ELSE ty END AS connection_type, CAST(length(sql_text) AS BIGINT) AS length, sql_text FROM texts"""
    )
    .replace("[packages]", "{packages}")
    .replace("[flow_packages]", "{flow_packages}"),
)
def pkg_embedded_sql(t):
    both = _packages(t).unionByName(_packages(t, "flow_packages"))
    return packages.embedded_sql(both)


@cases.add(
    "pkg_edges",
    r"""WITH p AS (SELECT path, xml FROM {packages} UNION ALL SELECT path, xml FROM {flow_packages}),
tags AS (SELECT path, regexp_extract_all(xml, '<path [^>]*>') AS l FROM p),
tag AS (SELECT path, CAST(unnest(range(len(l))) AS INT) AS pos, unnest(l) AS x FROM tags)
SELECT path, pos, regexp_extract(x, 'startId="([^"]*)"', 1) AS src, regexp_extract(x, 'endId="([^"]*)"', 1) AS dst FROM tag""",
)
def pkg_edges(t):
    both = _packages(t).unionByName(_packages(t, "flow_packages"))
    return packages.data_flow_edges(both)


PRECEDENCE = r"""
tags AS (SELECT path, regexp_extract_all(xml, '<DTS:PrecedenceConstraint [^>]*>') AS l FROM {flow_packages}),
tag AS (SELECT path, CAST(unnest(range(len(l))) AS INT) AS pos, unnest(l) AS x FROM tags),
edges AS (SELECT path, pos, regexp_extract(x, 'DTS:From="([^"]*)"', 1) AS src, regexp_extract(x, 'DTS:To="([^"]*)"', 1) AS dst FROM tag)
"""


@cases.add("pkg_precedence", f"WITH {PRECEDENCE} SELECT * FROM edges")
def pkg_precedence(t):
    return packages.precedence_edges(_packages(t, "flow_packages"))


@cases.add(
    "pkg_precedence_reach",
    f"""WITH RECURSIVE {PRECEDENCE}, longest AS (SELECT max(n) AS n FROM (SELECT count(*) AS n FROM edges GROUP BY path)),
hops AS (SELECT path, src, dst, 1 AS hops FROM edges
  UNION SELECT a.path, a.src, b.dst, a.hops + 1 FROM hops a JOIN edges b ON a.path = b.path AND a.dst = b.src
  WHERE a.hops < (SELECT n FROM longest))
SELECT path, src, dst, CAST(min(hops) AS INT) AS hops FROM hops GROUP BY path, src, dst""",
)
def pkg_precedence_reach(t):
    return packages.precedence_reach(packages.precedence_edges(_packages(t, "flow_packages")))


@cases.add(
    "pkg_parameters",
    r"""WITH task AS (SELECT path, regexp_extract(xml, '(?s)Microsoft.ExecuteSQLTask" DTS:ObjectName="([^"]*)"', 1) AS node, regexp_extract_all(xml, '<SQLTask:ParameterBinding [^>]*>') AS l FROM {flow_packages}),
tag AS (SELECT path, node, CAST(unnest(range(len(l))) AS INT) AS pos, unnest(l) AS x FROM task)
SELECT path, node, pos, regexp_extract(x, 'ParameterName="([^"]*)"', 1) AS parameter, regexp_extract(x, 'DtsVariableName="([^"]*)"', 1) AS variable,
  regexp_extract(x, 'ParameterDirection="([^"]*)"', 1) AS direction FROM tag""",
)
def pkg_parameters(t):
    return packages.parameters(_packages(t, "flow_packages"))


@cases.add(
    "pkg_inventory",
    f"""WITH n AS (SELECT path, CAST(len(list_filter({TYPES}, lambda t: t <> 'Microsoft.Package')) AS BIGINT) AS nodes FROM {{packages}})
SELECT 'SSIS' AS platform, path AS file_name, 'Package' AS job_type, CASE WHEN nodes < 10 THEN 'LOW' WHEN nodes < 20 THEN 'MEDIUM' ELSE 'HIGH' END AS categorization,
  nodes AS number_of_nodes, 'YES' AS included FROM n""",
)
def pkg_inventory(t):
    return packages.to_inventory(_packages(t))


CELLS = r"""cells AS (SELECT path, CAST(sum(len(regexp_extract_all(code, 'spark\.sql\('))) AS BIGINT) AS sql_cells, string_agg(output_file, ', ' ORDER BY output_file) AS output_files
  FROM {package_outputs} GROUP BY path)"""


@cases.add("pkg_literal_count", f"WITH {CELLS} SELECT * FROM cells")
def pkg_literal_count(t):
    return packages.count_cells(t["package_outputs"])


# -- outcomes

FIRST_LINE = r"regexp_extract({0}, '^[^\n\r\x0B\f\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]*')"
SQL_OUTCOMES = f"""sql_outcomes AS (
  SELECT file_name, file_type, engine, CAST(NULL AS VARCHAR) AS model,
    CASE WHEN exception_type IS NULL THEN success_count ELSE 0 END AS success_count,
    CAST(CASE WHEN exception_type IS NULL THEN len(errors) ELSE 1 END AS BIGINT) AS error_count,
    (exception_type IS NULL AND len(errors) = 0) AS transpiled,
    CASE WHEN exception_type IS NOT NULL THEN exception_type || ': ' || {FIRST_LINE.format("exception_message").replace("{", "{{").replace("}", "}}")}
         WHEN len(errors) > 0 THEN array_to_string(errors, '; ') END AS failure_reason,
    'Object' AS transpilation_scope, CAST(NULL AS VARCHAR) AS output_file
  FROM {{attempts}})"""
PKG_OUTCOMES = f"""{CELLS},
messages AS (SELECT path, list(split_part(message, chr(10), 1) ORDER BY ord) AS l FROM {{package_diagnostics}} GROUP BY path),
facts AS (SELECT p.path, c.output_files, coalesce(c.sql_cells, 0) AS cells, coalesce(m.l, CAST([] AS VARCHAR[])) AS l, {FLAGGED} AS u
  FROM {{packages}} p LEFT JOIN cells c ON c.path = p.path LEFT JOIN messages m ON m.path = p.path),
pkg_outcomes AS (
  SELECT path AS file_name, 'SSIS Package' AS file_type, 'package_rules' AS engine, CAST(NULL AS VARCHAR) AS model, cells AS success_count, CAST(len(l) AS BIGINT) AS error_count,
    (output_files IS NOT NULL AND len(l) = 0 AND cells > 0 AND u = '') AS transpiled,
    CASE WHEN u <> '' THEN array_to_string(list_append(l, 'Components requiring manual rewrite (not converted): ' || u), '; ')
         WHEN len(l) > 0 THEN array_to_string(l, '; ')
         WHEN NOT (output_files IS NOT NULL AND cells > 0) THEN 'No Spark SQL emitted — review manually' END AS failure_reason,
    CASE WHEN output_files IS NOT NULL AND len(l) = 0 AND cells > 0 AND u = '' THEN 'Converted — ' || CAST(cells AS VARCHAR) || ' Spark SQL cell(s)'
         WHEN cells > 0 THEN 'Partial — ' || CAST(cells AS VARCHAR) || ' cell(s) converted; manual review required'
         ELSE 'Not converted — manual review required' END AS transpilation_scope,
    output_files AS output_file
  FROM facts)"""


def _package_outcomes(t):
    return outcomes.package_outcomes(
        _packages(t), t["package_outputs"], t["package_diagnostics"]
    )


@cases.add("out_sql_outcomes", f"WITH {SQL_OUTCOMES} SELECT * FROM sql_outcomes")
def out_sql_outcomes(t):
    return outcomes.object_outcomes(t["attempts"])


@cases.add(
    "out_failure_reason",
    f"SELECT doc_id, 'ParseError: ' || {FIRST_LINE.format('text').replace('{', '{{').replace('}', '}}')} AS failure_reason FROM {{documents}}",
)
def out_failure_reason(t):
    reason = outcomes.failure_reason(F.lit("ParseError"), F.col("text"))
    return t["documents"].select("doc_id", reason.alias("failure_reason"))


@cases.add("out_pkg_outcomes", f"WITH {PKG_OUTCOMES} SELECT * FROM pkg_outcomes")
def out_pkg_outcomes(t):
    return _package_outcomes(t)


@cases.add(
    "out_rate_floor",
    f"""WITH {SQL_OUTCOMES} SELECT count(*) AS objects, CAST(sum(CASE WHEN transpiled THEN 1 ELSE 0 END) AS BIGINT) AS converted,
  CAST(sum(CASE WHEN transpiled THEN 1 ELSE 0 END) * 100 // greatest(count(*), 1) AS BIGINT) AS percent FROM sql_outcomes""",
)
def out_rate_floor(t):
    return outcomes.success_rate(outcomes.object_outcomes(t["attempts"]))


# -- the outcome table

ALL = "file_name, file_type, engine, model, success_count, error_count, transpiled, failure_reason, transpilation_scope, output_file"


@cases.add(
    "sink_conform_schema",
    """SELECT file_name, file_type, engine, CAST(NULL AS VARCHAR) AS model, success_count, error_count, transpiled, failure_reason,
  CAST(NULL AS VARCHAR) AS transpilation_scope, CAST(NULL AS VARCHAR) AS output_file FROM {outcomes}""",
)
def sink_conform_schema(t):
    return schemas.conform(t["outcomes"].drop("model"), schemas.CONVERSION_RESULTS)


STORED = f"stored AS (SELECT {ALL.replace('transpilation_scope, output_file', 'CAST(NULL AS VARCHAR) AS transpilation_scope, CAST(NULL AS VARCHAR) AS output_file')} FROM {{outcomes}})"


@cases.add(
    "sink_merge_outcomes",
    f"""WITH {STORED}, {SQL_OUTCOMES} SELECT {ALL} FROM sql_outcomes
UNION ALL SELECT {ALL} FROM stored WHERE file_name NOT IN (SELECT file_name FROM sql_outcomes)""",
)
def sink_merge_outcomes(t):
    """Earlier outcomes with a new run merged in."""
    return outcomes.merge_outcomes(t["outcomes"], outcomes.object_outcomes(t["attempts"]))


@cases.add(
    "sink_outcomes_lifecycle",
    f"""WITH {SQL_OUTCOMES}, {PKG_OUTCOMES} SELECT {ALL} FROM sql_outcomes UNION ALL SELECT {ALL} FROM pkg_outcomes""",
)
def sink_outcomes_lifecycle(t):
    return outcomes.outcomes_lifecycle(
        outcomes.object_outcomes(t["attempts"]), _package_outcomes(t)
    )
