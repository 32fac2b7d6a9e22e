"""Facts, pages and claims made from the driver's tables, since no documents with claims are at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Runs on Spark and DuckDB alike. Duplicate (order, line) pairs are told apart by rank within the pair, so no window spans the table.
FACTS = """
SELECT concat(lpad(CAST(l_orderkey AS STRING), 10, '0'), '-', CAST(l_linenumber AS STRING), '-', lpad(CAST(rn AS STRING), 3, '0')) AS fact_id,
  concat('doc_', CAST(l_suppkey % 3 AS STRING)) AS doc_id, CAST(l_linenumber AS INT) AS page_no,
  concat('p', CAST(l_partkey AS STRING)) AS entity_id, l_returnflag AS attribute_family,
  concat(CASE CAST(q AS INT) % 4 WHEN 0 THEN 'Our Company' WHEN 1 THEN 'Part ' WHEN 2 THEN 'part-' ELSE 'PART ' END, CASE WHEN CAST(q AS INT) % 4 = 0 THEN '' ELSE CAST(l_partkey % 40 AS STRING) END, CASE CAST(q AS INT) % 3 WHEN 0 THEN ' Limited' WHEN 1 THEN ' Ltd.' ELSE '' END) AS subject_raw,
  concat(CASE l_returnflag WHEN 'A' THEN 'Net revenue' WHEN 'N' THEN 'revenue growth' ELSE 'Total stock' END, CASE CAST(q AS INT) % 5 WHEN 0 THEN ' (reported)' WHEN 1 THEN ' from parts' ELSE '' END) AS attribute_raw,
  CASE WHEN l_linenumber = 7 THEN 'text' ELSE 'number' END AS value_kind,
  CASE l_linenumber WHEN 1 THEN concat('(', q, ')') WHEN 2 THEN concat('>', q) WHEN 3 THEN concat(q, '%') WHEN 4 THEN concat(q, ' Cr') WHEN 5 THEN concat('₹', q, '0 mn') WHEN 7 THEN concat('state ', q) ELSE concat(q, '00') END AS value_raw,
  CASE WHEN l_linenumber = 6 AND CAST(q AS INT) % 7 = 0 THEN 'lakh' WHEN l_linenumber = 6 AND CAST(q AS INT) % 7 = 1 THEN 'percent' ELSE NULL END AS unit,
  CASE WHEN l_linenumber = 2 AND CAST(q AS INT) % 2 = 0 THEN 'USD' ELSE NULL END AS currency,
  CASE WHEN l_linenumber = 7 THEN concat('State ', q) ELSE NULL END AS value_text,
  CASE WHEN l_linestatus = 'F' THEN CASE CAST(q AS INT) % 4 WHEN 0 THEN concat('year ended 31 March ', y) WHEN 1 THEN concat('Q', CAST(CAST(q AS INT) % 3 + 1 AS STRING), ' FY', substr(y, 3, 2)) WHEN 2 THEN concat('FY ', y) ELSE concat('six months ended September 30, ', y) END ELSE NULL END AS period_raw,
  CASE WHEN l_linestatus = 'F' THEN NULL WHEN CAST(q AS INT) % 2 = 0 THEN concat('March ', y) ELSE concat('31-12-', y) END AS as_of_raw,
  CASE CAST(q AS INT) % 6 WHEN 0 THEN 'excluding the captive fleet, group level' WHEN 1 THEN 'for the group fleet' WHEN 2 THEN 'Standalone – café operations' ELSE NULL END AS scope_raw,
  CASE WHEN l_tax < 0.02 THEN CAST(0.5 AS DOUBLE) WHEN l_tax < 0.05 THEN CAST(0.75 AS DOUBLE) WHEN l_tax < 0.07 THEN CAST(0.9 AS DOUBLE) ELSE NULL END AS confidence,
  l_discount < 0.09 AS grounded, l_discount < 0.07 AS value_in_evidence
FROM (SELECT *, CAST(CAST(l_quantity AS INT) AS STRING) AS q, CAST(year(l_shipdate) AS STRING) AS y,
  row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn FROM lineitem) x
"""


#: Pages of one document each; {map} is the dialect's map of footnotes.
PAGES = """
SELECT concat('doc_', CAST(doc_id AS STRING)) AS doc_id, 1 AS page_no,
  concat(CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), concat(chr(10), chr(10))) ELSE text END,
    CASE WHEN doc_id % 5 = 0 THEN concat(chr(10), chr(10), '[TABLES ON THIS PAGE]', chr(10), 'TABLE 1', chr(10), 'Name | Value', chr(10), 'Equity | ', CAST(n_chars AS STRING), ' (1)') ELSE '' END,
    CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN concat(chr(10), chr(10), '[FOOTNOTES ON THIS PAGE]', chr(10), '(1) note one', chr(10), '(5) note five') ELSE '' END) AS raw_text,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS section_heading, {map} AS footnotes
FROM documents
"""
SPARK_NOTES, DUCKDB_NOTES = "map('5', 'note five', '1', 'note one', '*', 'applies to all')", "MAP {'5': 'note five', '1': 'note one', '*': 'applies to all'}"
#: Claims on pages of one document each; the passage is the page's second half, and some evidence stands in the first.
CLAIMS = """
SELECT concat('f', CAST(doc_id AS STRING)) AS fact_id, concat('doc_', CAST(doc_id AS STRING)) AS doc_id, 1 AS page_no,
  CASE doc_id % 6 WHEN 0 THEN substr(text, h + 20, 60) WHEN 1 THEN concat(' ', replace(substr(text, h + 20, 60), ' ', '  '), ' ') WHEN 2 THEN substr(text, CAST(floor(h / 2.0) AS INT), 50) WHEN 3 THEN replace(substr(text, CAST(floor(h / 2.0) AS INT), 50), ' ', chr(10)) WHEN 4 THEN 'no such words 1,008' ELSE ' x ' END AS evidence_text,
  CASE WHEN doc_id % 6 = 4 THEN '1008' ELSE substr(text, h + 30, 6) END AS value_raw, substr(text, h + 1) AS chunk_text, h AS chunk_char_start, text AS page_text
FROM (SELECT doc_id, text, CAST(floor(length(text) / 2.0) AS INT) AS h FROM documents) x
"""
LINE_DOCUMENT, SPARSE_DOCUMENT = "concat('d', CAST(l_orderkey % 60 AS STRING)) AS doc_id", "concat('o', CAST(CAST(floor(l_orderkey / 12.0) AS BIGINT) AS STRING)) AS doc_id"
LINES = f"""
SELECT {LINE_DOCUMENT}, CAST(l_linenumber AS INT) AS page_no,
  concat(lpad(CAST(l_orderkey AS STRING), 10, '0'), '-', lpad(CAST(rn AS STRING), 3, '0')) AS line_id,
  CASE CAST(l_partkey AS INT) % 9 WHEN 0 THEN concat('(', CAST(q % 5 + 1 AS STRING), ') note on ', CAST(q AS STRING)) WHEN 1 THEN concat('* applies to ', CAST(q AS STRING)) WHEN 2 THEN concat('Value ', CAST(q AS STRING), ' (1, ', CAST(q % 5 + 1 AS STRING), ') [2]')
    WHEN 3 THEN concat('Heading ', CAST(q AS STRING)) WHEN 4 THEN concat('Cell ', CAST(q AS STRING)) ELSE concat('line ', CAST(l_partkey AS STRING), ' of text') END AS text,
  CAST((l_partkey * 37 + q) % 540 AS DOUBLE) AS "left", CAST((l_suppkey * 53 + l_orderkey * 7 + q * 11) % 780 AS DOUBLE) AS top,
  CAST((l_partkey * 37 + q) % 540 + 20 + (q * 7) % 150 AS DOUBLE) AS "right", CAST((l_suppkey * 53 + l_orderkey * 7 + q * 11) % 780 + CASE WHEN l_partkey % 9 = 3 THEN 24 WHEN l_partkey % 9 < 2 THEN 8 ELSE 10 END AS DOUBLE) AS bottom,
  CAST(CASE WHEN l_partkey % 9 = 3 THEN 24 WHEN l_partkey % 9 < 2 THEN 8 ELSE 10 + q % 3 END AS DOUBLE) AS font_size, CAST(612 AS DOUBLE) AS page_width, CAST(792 AS DOUBLE) AS page_height
FROM (SELECT *, CAST(l_quantity AS INT) AS q, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn FROM lineitem) x
"""
#: Raw table rows; {array} is the dialect's constructor.
TABLES = """
SELECT concat('d', CAST(o_orderkey % 60 AS STRING)) AS doc_id, CAST(o_orderkey % 7 + 1 AS INT) AS page_no, CAST(o_custkey % 3 + 1 AS INT) AS table_no, CAST(o_orderkey AS INT) AS row_no,
  {array}(CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE concat(' Cell  ', CAST(o_custkey % 50 AS STRING), ' ') END, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END) AS cells
FROM orders
"""
#: A model's answers, one claim each; some wrapped, some broken.
ANSWERS = """
SELECT concat('r', CAST(event_id AS STRING)) AS request_id, 'doc_0' AS doc_id,
  CASE WHEN event_id % 13 = 0 THEN '{"facts": [' WHEN event_id % 10 = 0 THEN concat('{"facts": ', body, '}') ELSE body END AS answer
FROM (SELECT event_id, concat('[{"chunk_id": "c', CAST(event_id % 50 AS STRING), '", "subject": "  user ', CAST(user_id AS STRING), ' ", "attribute": "', event_type, '", "value_raw": "', CASE WHEN event_id % 17 = 0 THEN ' ' ELSE concat(CAST(event_id AS STRING), ' mn') END,
  '", "value_kind": "', CASE user_id % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'date' WHEN 2 THEN 'number' ELSE CASE WHEN event_id % 7 = 0 THEN 'amount' ELSE 'number' END END, '", "unit": "', CASE WHEN event_id % 2 = 0 THEN 'N/A' ELSE ' mn ' END, '", "period_text": ', CASE WHEN user_id % 3 = 0 THEN '"FY 2020"' ELSE 'null' END, ', "as_of_text": "', CASE WHEN event_id % 3 = 1 THEN 'March 2020' ELSE 'n/a' END, '", "scope": "', CASE WHEN event_id % 4 = 0 THEN 'standalone' ELSE 'not stated' END, '", "source_kind": "', CASE WHEN event_id % 19 = 0 THEN 'picture' ELSE 'prose' END, '", "evidence": "e ', CAST(event_id AS STRING), '"}]') AS body FROM events) x
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _from(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    return spark.sql(sql.replace(f"FROM {name}", "FROM {src}").replace('"left"', "`left`").replace('"right"', "`right`"), src=table(spark, sf_dir, name))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw facts from lineitem."""
    return _from(spark, sf_dir, FACTS, "lineitem")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from(spark, sf_dir, PAGES.replace("{map}", SPARK_NOTES), "documents")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from(spark, sf_dir, CLAIMS, "documents")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from(spark, sf_dir, LINES, "lineitem")


def sparse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines on many more pages of few lines each, as gutters need room."""
    return _from(spark, sf_dir, LINES.replace(LINE_DOCUMENT, SPARSE_DOCUMENT), "lineitem")


def raw_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from(spark, sf_dir, TABLES.replace("{array}", "array"), "orders")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "event_type").transform(lambda df: spark.sql(ANSWERS.replace("{", "{{").replace("}", "}}").replace("FROM events", "FROM {src}"), src=df))
