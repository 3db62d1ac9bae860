"""Derived views: the star-schema and text tables seen as a code estate and as ETL tables.

One ANSI text per view serves Spark and the SQL check alike; ``{name}`` marks a table or another
view. Where the two dialects differ a view holds a (Spark text, ANSI text) pair.
"""

from __future__ import annotations

import re
from string import Formatter

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2001-08-01"

VIEWS: dict[str, str | tuple[str, str]] = {
    "inventory": """
SELECT
  CASE WHEN doc_id % 3 = 0 THEN 'SSIS' ELSE 'MS SQL Server' END AS platform,
  concat('doc_', CAST(doc_id AS VARCHAR(20)), CASE WHEN doc_id % 3 = 0 THEN '.dtsx' ELSE '.sql' END) AS file_name,
  concat(source, '/', lang, '/doc_', CAST(doc_id AS VARCHAR(20)), CASE WHEN doc_id % 6 = 0 THEN '' WHEN doc_id % 3 = 0 THEN '.dtsx' ELSE '.sql' END) AS raw_path,
  CASE WHEN doc_id % 3 = 0 THEN 'Package' WHEN lang = 'en' THEN 'CREATE PROCEDURE' WHEN lang = 'fr' THEN 'CREATE VIEW' ELSE 'CREATE TABLE' END AS job_type,
  CASE WHEN doc_id % 97 = 0 THEN 'UNKNOWN' WHEN n_chars <= 1000 THEN 'LOW' WHEN n_chars <= 2500 THEN 'MEDIUM' ELSE 'HIGH' END AS categorization,
  n_chars AS number_of_nodes,
  'YES' AS included
FROM {documents}
""",
    "outcomes": """
SELECT
  concat('doc_', CAST(l.doc_id AS VARCHAR(20)), CASE WHEN l.doc_id % 3 = 0 THEN '.dtsx' ELSE '.sql' END) AS file_name,
  CASE WHEN l.doc_id % 3 = 0 THEN 'SSIS Package' WHEN d.lang = 'en' THEN 'CREATE PROCEDURE' ELSE 'CREATE VIEW' END AS file_type,
  CASE WHEN l.doc_id % 3 = 0 THEN 'package_rules' ELSE 'sql_rules' END AS engine,
  CAST(NULL AS VARCHAR(20)) AS model,
  CAST(l.quality AS BIGINT) AS success_count,
  CAST(1 - l.quality + l.toxic AS BIGINT) AS error_count,
  (l.quality = 1 AND l.toxic = 0) AS transpiled,
  CASE WHEN l.quality = 1 AND l.toxic = 0 THEN NULL
       WHEN l.quality = 0 AND l.toxic = 1 THEN 'ParseError: unexpected token; UnsupportedError: dynamic SQL'
       WHEN l.toxic = 1 THEN 'UnsupportedError: dynamic SQL'
       ELSE 'ParseError: unexpected token' END AS failure_reason
FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id
""",
    "unit_rates": """
SELECT * FROM (VALUES
  ('SQL Statement','LOW','transpilable',CAST(0.2 AS DOUBLE),'Senior Data Engineer'),
  ('SQL Statement','MEDIUM','transpilable',CAST(1.5 AS DOUBLE),'Senior Data Engineer'),
  ('SQL Statement','HIGH','transpilable',CAST(3.0 AS DOUBLE),'Senior Data Engineer'),
  ('T-SQL Function','STANDARD','transpilable',CAST(0.25 AS DOUBLE),'Senior Data Engineer'),
  ('SSIS Component','Orchestration','transpilable',CAST(0.25 AS DOUBLE),'ETL Specialist'),
  ('SSIS Component','Transformation','transpilable',CAST(0.5 AS DOUBLE),'ETL Specialist'),
  ('SQL Statement','LOW','not_transpilable',CAST(0.6 AS DOUBLE),'Senior Data Engineer'),
  ('SQL Statement','MEDIUM','not_transpilable',CAST(4.5 AS DOUBLE),'Senior Data Engineer'),
  ('SQL Statement','HIGH','not_transpilable',CAST(9.0 AS DOUBLE),'Senior Data Engineer'),
  ('T-SQL Function','STANDARD','not_transpilable',CAST(0.75 AS DOUBLE),'Senior Data Engineer'),
  ('SSIS Component','Orchestration','not_transpilable',CAST(0.75 AS DOUBLE),'ETL Specialist'),
  ('SSIS Component','Transformation','not_transpilable',CAST(1.5 AS DOUBLE),'ETL Specialist')
) AS t(object_type, complexity_level, transpilability_status, effort_md_per_unit, profile)
""",
    "overhead_rates": """
SELECT * FROM (VALUES
  ('Data Architect', CAST(0.10 AS DOUBLE), 'Design, technical governance, code review'),
  ('QA Engineer',    CAST(0.20 AS DOUBLE), 'Unit tests, integration tests, UAT support')
) AS t(profile, rate, notes)
""",
    "scripts": """
SELECT o_orderkey AS script_id,
  concat('dir', CAST(o_custkey % 4 AS VARCHAR(20)), '/obj_', CAST(o_orderkey AS VARCHAR(20)),
         CASE WHEN o_orderkey % 16 = 0 THEN '.dsql' ELSE '.sql' END) AS path,
  CASE o_orderkey % 8
   WHEN 0 THEN concat('-- table', chr(10), 'CREATE TABLE dbo.T', CAST(o_orderkey % 50 AS VARCHAR(20)),
     ' (', chr(10), '  Id INT NOT NULL,', chr(10), '  Note VARCHAR(-1)', chr(10), ')', chr(10),
     'WITH (DISTRIBUTION = HASH(Id), CLUSTERED COLUMNSTORE INDEX)', chr(10), ';', chr(10),
     'CREATE STATISTICS st1 ON dbo.T (Id);', chr(10), 'CREATE NONCLUSTERED INDEX ix1 ON dbo.T (Id);', chr(10))
   WHEN 1 THEN concat('CREATE VIEW [dbo].[V', CAST(o_orderkey % 50 AS VARCHAR(20)), '] AS', chr(10),
     'SELECT a, ''x;y'' AS lit FROM s.t /* not; a split */ WHERE a > ', CAST(o_custkey AS VARCHAR(20)), ';', chr(10))
   WHEN 2 THEN concat('USE db1', chr(10), 'GO', chr(10), 'CREATE PROCEDURE dbo.P', CAST(o_orderkey AS VARCHAR(20)),
     ' @d INT AS BEGIN', chr(10), '  DELETE FROM dbo.M WHERE d = @d;', chr(10),
     '  INSERT INTO dbo.M SELECT COUNT(*), ISNULL(SUM(x), 0) FROM dbo.S;', chr(10), 'END', chr(10), 'go', chr(10),
     'CREATE OR ALTER FUNCTION dbo.F', CAST(o_orderkey % 50 AS VARCHAR(20)), '() RETURNS INT AS BEGIN RETURN 1; END', chr(10))
   WHEN 3 THEN concat('SELECT TOP 10 a FROM dbo.A; -- tail; comment', chr(10), 'INSERT INTO dbo.B SELECT 1;', chr(10), '/* only a comment; */')
   WHEN 4 THEN concat('MERGE INTO dw.f t USING st.f s ON t.k = s.k WHEN MATCHED THEN UPDATE SET t.v = s.v;', chr(10), 'TRUNCATE TABLE st.f;')
   WHEN 5 THEN concat('CREATE TABLE #tmp (a INT, b VARBINARY ( -1 ));', chr(10), 'DECLARE @x INT;', chr(10), 'UPDATE #tmp SET a = 1;')
   WHEN 6 THEN concat('WITH (x) AS (SELECT 1) SELECT * FROM x;', chr(10), 'DROP TABLE dbo.Old;', chr(10), ' GO ;', chr(10), 'ALTER TABLE dbo.N ADD c INT')
   ELSE concat('CREATE SCHEMA rpt;', chr(10), 'EXEC dbo.P1 ''a;b'';', chr(10), 'CREATE TRIGGER tr', CAST(o_orderkey AS VARCHAR(20)), ' ON dbo.A AS SELECT 1')
  END AS text
FROM {orders}
""",
    "packages": """
SELECT p_partkey AS package_id,
  concat('pkg_', CAST(p_partkey AS VARCHAR(20)), '.dtsx') AS path,
  concat('<?xml version="1.0"?><DTS:Executable xmlns:DTS="urn:dts" DTS:ExecutableType="Microsoft.Package" DTS:ObjectName="E', CAST(p_partkey AS VARCHAR(20)), '">',
   CASE WHEN p_partkey % 5 = 0 THEN concat('<DTS:Executable DTS:refId="Package', chr(92), 'A" DTS:ExecutableType="Microsoft.SendMailTask"/>') ELSE '' END,
   CASE WHEN p_partkey % 7 = 0 THEN concat('<DTS:Executable DTS:refId="Package', chr(92), 'B" DTS:ExecutableType="Microsoft.FtpTask"/>') ELSE '' END,
   repeat('<DTS:Executable DTS:ExecutableType="Microsoft.ExecuteSQLTask"><T SQLTask:SqlStatementSource="SELECT a FROM t WHERE a &lt; 5 AND b = &quot;x&quot;;"/></DTS:Executable>', CAST(p_partkey % 25 AS INT)),
   '<DTS:Executable DTS:ExecutableType="Microsoft.Pipeline"><component componentClassID="Microsoft.OLEDBSource"><property name="SqlCommand">SELECT a FROM s WHERE a &gt; 1</property></component>',
   CASE WHEN p_partkey % 3 = 0 THEN '<component componentClassID="Microsoft.Lookup"/>' ELSE '<component componentClassID="Microsoft.DerivedColumn"/>' END,
   '<component componentClassID="Microsoft.OLEDBDestination"/><path startId="S.out" endId="D.in"/></DTS:Executable></DTS:Executable>') AS xml
FROM {part}
""",
    "etl_customer": """
SELECT c.c_custkey AS customer_id, c.c_name AS customer_code, c.c_mktsegment AS first_name,
  CASE WHEN c.c_custkey % 4 = 0 THEN NULL ELSE concat('M', CAST(c.c_custkey % 7 AS VARCHAR(20))) END AS middle_name,
  CASE WHEN c.c_custkey % 9 = 0 THEN NULL ELSE c.c_name END AS last_name,
  CASE WHEN c.c_custkey % 13 = 0 THEN NULL ELSE concat('u', CAST(c.c_custkey AS VARCHAR(20)), '@example.com') END AS email,
  (c.c_acctbal >= 0) AS is_active, o.created_date, o.updated_date
FROM {customer} c LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS created_date, max(o_orderdate) AS updated_date FROM {orders} GROUP BY o_custkey) o
  ON o.o_custkey = c.c_custkey
""",
    "etl_order_header": """
SELECT o_orderkey AS sales_order_id, o_custkey AS customer_id, o_orderdate AS order_date,
  CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE 3 END AS status, CAST(o_totalprice AS DECIMAL(18,2)) AS total_due
FROM {orders}
""",
    "etl_inventory": (
        """
SELECT p_partkey AS product_id, explode(array(0L, 1L, 2L)) AS warehouse_id, CAST(p_size * 100 AS BIGINT) AS quantity_on_hand
FROM {part}
""",
        """
SELECT p_partkey AS product_id, unnest([0::BIGINT, 1::BIGINT, 2::BIGINT]) AS warehouse_id, CAST(p_size * 100 AS BIGINT) AS quantity_on_hand
FROM {part}
""",
    ),
    "etl_movements": """
SELECT l_partkey AS product_id, l_suppkey % 3 AS warehouse_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity
FROM {lineitem} WHERE l_shipdate >= TIMESTAMP '2001-07-01 00:00:00' GROUP BY l_partkey, l_suppkey % 3
""",
    "etl_stage_finance": """
SELECT concat('ACC', CAST(n.n_nationkey AS VARCHAR(20))) AS account_code, n.n_name AS account_name,
  CAST(o.o_orderdate AS DATE) AS posting_date, CAST(sum(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey JOIN {nation} n ON n.n_nationkey = c.c_nationkey
WHERE o.o_orderdate >= TIMESTAMP '2001-06-01 00:00:00'
GROUP BY n.n_nationkey, n.n_name, CAST(o.o_orderdate AS DATE)
""",
    "etl_fact_finance": """
SELECT concat('ACC', CAST(n.n_nationkey AS VARCHAR(20))) AS account_code, n.n_name AS account_name,
  CAST(o.o_orderdate AS DATE) AS posting_date,
  CAST(sum(CAST(o.o_totalprice AS DECIMAL(18,2))) + CASE WHEN n.n_nationkey % 2 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS amount
FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey JOIN {nation} n ON n.n_nationkey = c.c_nationkey
WHERE o.o_orderdate >= TIMESTAMP '2001-04-01 00:00:00' AND o.o_orderdate < TIMESTAMP '2001-07-01 00:00:00'
GROUP BY n.n_nationkey, n.n_name, CAST(o.o_orderdate AS DATE)
""",
    "etl_order_detail": """
SELECT l.l_orderkey AS order_id, o.o_custkey AS customer_id, l.l_quantity AS quantity,
  CAST(l.l_partkey % 100 AS DOUBLE) AS unit_price, CAST(l.l_shipdate AS DATE) AS ship_date
FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey
""",
    "etl_segment": """
SELECT c_custkey AS customer_id, c_mktsegment AS segment_name FROM {customer} WHERE c_mktsegment <> 'BUILDING'
""",
    "etl_sales": """
SELECT l_orderkey AS sales_id, l_partkey AS product_id, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, CAST(l_shipdate AS DATE) AS sale_date
FROM {lineitem} WHERE l_shipdate >= TIMESTAMP '2001-07-01 00:00:00'
""",
    "etl_product": """
SELECT p_partkey AS product_id, p_name AS product_name, p_retailprice AS list_price, p_type AS category FROM {part}
""",
    "etl_dim_product": """
SELECT p_partkey AS product_id, p_name AS product_name,
  CASE WHEN p_partkey % 7 = 0 THEN p_retailprice - 5 ELSE p_retailprice END AS list_price, p_type AS category,
  1 AS is_current, CAST(NULL AS DATE) AS end_date
FROM {part} WHERE p_size <= 45
UNION ALL
SELECT p_partkey, p_name, p_retailprice - 50, p_type, 0, DATE '2001-01-01' FROM {part} WHERE p_size <= 5
""",
    "etl_raw_orders": """
SELECT o.o_orderkey AS record_id,
  CASE WHEN o.o_custkey % 13 = 0 THEN NULL ELSE concat('u', CAST(o.o_custkey AS VARCHAR(20)), '@example.com') END AS customer_email,
  c.c_acctbal AS order_amount
FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey
""",
    # the finance source tables before the join
    "etl_account": """
SELECT c.c_custkey AS account_id, concat('ACC', CAST(c.c_nationkey AS VARCHAR(20))) AS account_code, c.c_name AS account_name
FROM {customer} c
""",
    "etl_ledger": """
SELECT o_custkey AS account_id, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, o_orderdate AS posting_date FROM {orders}
""",
    # metrics kept from an earlier run: one older day, and stale rows of the run date itself
    "etl_metrics_state": """
SELECT o_custkey AS customer_id, DATE '2001-07-01' AS snapshot_date, max(o_orderdate) AS last_order_date,
  count(*) AS total_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_spend, CAST(0 AS BIGINT) AS days_since_last_order
FROM {orders} WHERE o_orderdate < TIMESTAMP '2001-07-01 00:00:00' GROUP BY o_custkey
UNION ALL
SELECT o_custkey, DATE '2001-08-01', min(o_orderdate), CAST(1 AS BIGINT), CAST(0 AS DOUBLE), CAST(99 AS BIGINT)
FROM {orders} GROUP BY o_custkey
""",
    # control rows, one per clerk priority, standing for named batches
    "etl_control": """
SELECT o_orderpriority AS batch_name, max(o_orderdate) AS last_run, CAST(0 AS BIGINT) AS rows_loaded
FROM {orders} GROUP BY o_orderpriority
""",
    # per-object conversion attempts: success count, error texts, and an exception for some
    "attempts": (
        """
SELECT concat('doc_', CAST(d.doc_id AS VARCHAR(20)), '.sql') AS file_name,
  CASE WHEN d.lang = 'en' THEN 'CREATE PROCEDURE' WHEN d.lang = 'fr' THEN 'CREATE VIEW' ELSE 'CREATE TABLE' END AS file_type,
  'sql_rules' AS engine, CAST(l.quality AS BIGINT) AS success_count,
  CASE WHEN l.quality = 0 AND l.toxic = 1 THEN array('ParseError: unexpected token', 'UnsupportedError: dynamic SQL')
       WHEN l.toxic = 1 THEN array('UnsupportedError: dynamic SQL')
       WHEN l.quality = 0 THEN array('ParseError: unexpected token') ELSE array() END AS errors,
  CASE WHEN l.doc_id IS NULL THEN 'ValueError' END AS exception_type,
  CASE WHEN l.doc_id IS NULL THEN d.text END AS exception_message
FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id
""",
        """
SELECT concat('doc_', CAST(d.doc_id AS VARCHAR(20)), '.sql') AS file_name,
  CASE WHEN d.lang = 'en' THEN 'CREATE PROCEDURE' WHEN d.lang = 'fr' THEN 'CREATE VIEW' ELSE 'CREATE TABLE' END AS file_type,
  'sql_rules' AS engine, CAST(l.quality AS BIGINT) AS success_count,
  CASE WHEN l.quality = 0 AND l.toxic = 1 THEN ['ParseError: unexpected token', 'UnsupportedError: dynamic SQL']
       WHEN l.toxic = 1 THEN ['UnsupportedError: dynamic SQL']
       WHEN l.quality = 0 THEN ['ParseError: unexpected token'] ELSE CAST([] AS VARCHAR[]) END AS errors,
  CASE WHEN l.doc_id IS NULL THEN 'ValueError' END AS exception_type,
  CASE WHEN l.doc_id IS NULL THEN d.text END AS exception_message
FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id
""",
    ),
    # files written by the package converter, zero to two per package, with their code
    "package_outputs": """
SELECT concat('pkg_', CAST(p_partkey AS VARCHAR(20)), '.dtsx') AS path, concat('pkg_', CAST(p_partkey AS VARCHAR(20)), '.py') AS output_file,
  concat('# ', p_name, chr(10), repeat('spark.sql("SELECT 1")', CAST(p_size % 4 AS INT))) AS code
FROM {part} WHERE p_size > 3
UNION ALL
SELECT concat('pkg_', CAST(p_partkey AS VARCHAR(20)), '.dtsx'), concat('pkg_', CAST(p_partkey AS VARCHAR(20)), '_extra.py'),
  concat('x = 1', chr(10), repeat('spark.sql("SELECT 2")', CAST(p_size % 3 AS INT))) AS code
FROM {part} WHERE p_size > 40
""",
    # converter diagnostics: one row per message
    "package_diagnostics": """
SELECT concat('pkg_', CAST(p_partkey AS VARCHAR(20)), '.dtsx') AS path, 1 AS ord, concat('ParseError near ', p_type, chr(10), 'at line 3') AS message
FROM {part} WHERE p_size = 7 OR p_size = 8
UNION ALL
SELECT concat('pkg_', CAST(p_partkey AS VARCHAR(20)), '.dtsx'), 2, 'second message' FROM {part} WHERE p_size = 8
""",
    # packages with control flow: named tasks, precedence constraints, parameter bindings, wired components
    "flow_packages": """
SELECT concat('flow_', CAST(p_partkey AS VARCHAR(20)), '.dtsx') AS path,
  concat('<?xml version="1.0"?>', chr(10), '<DTS:Executable xmlns:DTS="urn:dts" DTS:refId="Package" DTS:ExecutableType="Microsoft.Package" DTS:ObjectName="', p_name, '">',
   '<DTS:Executables>',
   '<DTS:Executable DTS:refId="Package', chr(92), 'Load" DTS:ExecutableType="Microsoft.ExecuteSQLTask" DTS:ObjectName="Load ', p_brand, '">',
   '<SQLTask:SqlTaskData SQLTask:Connection="{{C', CAST(p_size AS VARCHAR(20)), '}}" SQLTask:SqlStatementSource="INSERT INTO t (k)&#xA;SELECT ? AS k FROM s WHERE n &gt;= ', CAST(p_size AS VARCHAR(20)), ' AND m = &quot;', p_type, '&quot;;">',
   repeat('<SQLTask:ParameterBinding SQLTask:ParameterName="0" SQLTask:DtsVariableName="$Package::ProcessName" SQLTask:ParameterDirection="Input" SQLTask:DataType="130"/>', CAST(p_size % 3 AS INT)),
   '</SQLTask:SqlTaskData></DTS:Executable>',
   '<DTS:Executable DTS:refId="Package', chr(92), 'Move" DTS:ExecutableType="Microsoft.Pipeline" DTS:ObjectName="Move"><DTS:ObjectData><pipeline><components>',
   '<component refId="Package', chr(92), 'Move', chr(92), 'Src" name="Src ', p_brand, '" componentClassID="Microsoft.OLEDBSource"><properties><property name="AccessMode">2</property><property name="SqlCommand">SELECT k FROM t WHERE a &lt;&gt; ''x&amp;y'' AND b > ', CAST(p_size AS VARCHAR(20)), '</property></properties></component>',
   '<component refId="Package', chr(92), 'Move', chr(92), 'Dst" name="Dst" componentClassID="Microsoft.OLEDBDestination"><properties><property name="OpenRowset">[dw].[t]</property></properties></component>',
   '</components><paths>',
   '<path refId="P1" name="src2dst" startId="Package', chr(92), 'Move', chr(92), 'Src.Outputs[out]" endId="Package', chr(92), 'Move', chr(92), 'Dst.Inputs[in]"/>',
   '</paths></pipeline></DTS:ObjectData></DTS:Executable>',
   repeat(concat('<DTS:Executable DTS:refId="Package', chr(92), 'Notify" DTS:ExecutableType="Microsoft.SendMailTask" DTS:ObjectName="Notify"><DTS:ObjectData/></DTS:Executable>'), CAST(p_size % 2 AS INT)),
   '</DTS:Executables><DTS:PrecedenceConstraints>',
   '<DTS:PrecedenceConstraint DTS:refId="c0" DTS:From="Package', chr(92), 'Load" DTS:LogicalAnd="True" DTS:To="Package', chr(92), 'Move" DTS:Value="0"/>',
   repeat(concat('<DTS:PrecedenceConstraint DTS:refId="c1" DTS:From="Package', chr(92), 'Move" DTS:LogicalAnd="True" DTS:To="Package', chr(92), 'Notify" DTS:Value="0"/>'), CAST(p_size % 2 AS INT)),
   repeat('<DTS:PrecedenceConstraint DTS:refId="s0" DTS:From="Step0" DTS:LogicalAnd="True" DTS:To="Step1" DTS:Value="0"/>', CAST(p_size % 3 AS INT)),
   repeat('<DTS:PrecedenceConstraint DTS:refId="s1" DTS:From="Step1" DTS:LogicalAnd="True" DTS:To="Step2" DTS:Value="0"/>', CAST(p_size % 3 AS INT)),
   repeat('<DTS:PrecedenceConstraint DTS:refId="s2" DTS:From="Step2" DTS:LogicalAnd="True" DTS:To="Step3" DTS:Value="0"/>', CAST(p_size % 3 AS INT)),
   repeat('<DTS:PrecedenceConstraint DTS:refId="s3" DTS:From="Step3" DTS:LogicalAnd="True" DTS:To="Step4" DTS:Value="0"/>', CAST(p_size % 3 AS INT)),
   repeat('<DTS:PrecedenceConstraint DTS:refId="s4" DTS:From="Step4" DTS:LogicalAnd="True" DTS:To="Step5" DTS:Value="0"/>', CAST(p_size % 3 AS INT)),
   repeat('<DTS:PrecedenceConstraint DTS:refId="s5" DTS:From="Step5" DTS:LogicalAnd="True" DTS:To="Step6" DTS:Value="0"/>', CAST(p_size % 3 AS INT)),
   repeat('<DTS:PrecedenceConstraint DTS:refId="s6" DTS:From="Step6" DTS:LogicalAnd="True" DTS:To="Step7" DTS:Value="0"/>', CAST(p_size % 3 AS INT)),
   repeat('<DTS:PrecedenceConstraint DTS:refId="s7" DTS:From="Step7" DTS:LogicalAnd="True" DTS:To="Step8" DTS:Value="0"/>', CAST(p_size % 3 AS INT)),
   repeat('<DTS:PrecedenceConstraint DTS:refId="s8" DTS:From="Step8" DTS:LogicalAnd="True" DTS:To="Step0" DTS:Value="0"/>', CAST(p_size % 2 AS INT)),
   '</DTS:PrecedenceConstraints></DTS:Executable>') AS xml
FROM {part}
""",
    # an analyser report with untidy headers, number texts and blank rows
    "raw_report": """
SELECT raw_path AS " File Name ", 'folder' AS "Folder/Path", raw_path AS "Source  File", included AS "Included?", job_type AS "Job-Type",
  categorization AS "Categorization", CASE WHEN number_of_nodes % 10 = 0 THEN 'n/a' WHEN number_of_nodes % 2 = 0 THEN concat(CAST(number_of_nodes AS VARCHAR(20)), '.0') ELSE CAST(number_of_nodes AS VARCHAR(20)) END AS "Number of Nodes", platform AS "Remark"
FROM {inventory}
UNION ALL
SELECT CAST(NULL AS VARCHAR(9)), CAST(NULL AS VARCHAR(9)), CAST(NULL AS VARCHAR(9)), CAST(NULL AS VARCHAR(9)), CAST(NULL AS VARCHAR(9)), CAST(NULL AS VARCHAR(9)), CAST(NULL AS VARCHAR(9)), CAST(NULL AS VARCHAR(9))
FROM {labels}
""",
}

TABLES = [
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
]


def _names(text: str) -> list[str]:
    """The placeholders of a text in order of appearance, each once."""
    return list(dict.fromkeys(name for _, name, _, _ in Formatter().parse(text) if name))


def _text(name: str, dialect: int) -> str:
    text = VIEWS[name]
    return text if isinstance(text, str) else text[dialect]


class Inputs:
    """The given tables of one folder, and the views derived from them, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._known: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._known:
            if name in VIEWS:
                self._known[name] = self.sql(_text(name, 0))
            else:
                self._known[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._known[name]

    def sql(self, text: str) -> DataFrame:
        # the files hold timestamps without zone: compare them with literals of their own type, so
        # that no cast sits on the column and the predicate reaches the scan; quoted names are
        # back-ticked here
        text = text.replace("TIMESTAMP '", "TIMESTAMP_NTZ '")
        text = re.sub(r'AS "([^"]+)"', r"AS `\1`", text)
        return self.spark.sql(text, **{name: self[name] for name in _names(text)})


def ansi(text: str) -> str:
    """The ANSI text of a check, with every view it needs prepended as a CTE."""
    order: list[str] = []

    def visit(body: str) -> None:
        for name in _names(body):
            if name in VIEWS and name not in order:
                visit(_text(name, 1))
                order.append(name)

    visit(text)
    every = {name: name for name in [*VIEWS, *TABLES]}
    ctes = [f"{name} AS ({_text(name, 1).strip().format(**every)})" for name in order]
    body = text.strip().format(**every)
    if not ctes:
        return body
    own = re.match(r"(?i)with\s+(recursive\s+)?", body)
    if own:
        return f"WITH {own[1] or ''}" + ",\n".join(ctes) + ",\n" + body[own.end() :]
    return "WITH " + ",\n".join(ctes) + "\n" + body
