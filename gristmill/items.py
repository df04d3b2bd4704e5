"""Requirement items made from the order tables, for queries and benchmarks: every rule has rows that it hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TEMPLATES = [
    ("The system must support PXE boot over the management port and IPMI watchdog timers", ""),
    ("CRU: Customer Replaceable Unit", "GLOSSARY/DEFINITION"),
    ("The power supply unit can be replaced by the operator without any tool", ""),
    ("CRU: fan tray with hot-swap handle and rail", ""),
    ("Warranty shall be 36 months and pricing in USD with payment terms and a discount", ""),
    ("5/5/2026", ""),
    ("Vendor should provide vibration, shock and humidity test reports for 2.5 kg units", ""),
    ("info@example.com", ""),
    ("8GB", ""),
    ("Front bezel LED color is common with the current platform", ""),
    ("a) two ports", ""),
    ("TPM 2.0 is required | FIPS 140-2 Level 2 certification shall be held | UL listed", ""),
    ("Nora Field", ""),
    ("The chassis may optionally include a third redundant fan module for cooling", "RFP_PROCESS"),
    ("Delivery lead time penalty of 2% applies to each late shipment", ""),
    ("HOST 36 NVMe storage with RAID 5 and SATA backup at 10 Gbps", "[ROW_ID=HOST-36]"),
    ("Source code escrow and license rights to redistribute are needed", ""),
    ("Roadmap with 7-year availability and EOL notice", ""),
    ("high definition video output at 60 Hz", ""),
    ("status updated by owner", ""),
    ("N/A", ""),
    ("REQ-123 DDR4 memory channel with 12 DIMM slots per CPU", ""),
    ("Operating temperature from 5 to 40 degrees at an altitude of 3000 m", ""),
    ("Price", "note for reference"),
]

IDS = "CASE o_orderkey % 9 WHEN 0 THEN concat('HOST-', CAST(o_custkey % 50 AS STRING)) WHEN 1 THEN concat('RFQ-HOST-', CAST(o_custkey % 50 AS STRING)) WHEN 2 THEN '' WHEN 3 THEN concat('AUTO-x-', CAST(o_orderkey % 7 AS STRING)) WHEN 4 THEN CAST(o_custkey % 2000 AS STRING) WHEN 5 THEN concat('BIOS-', CAST(o_custkey % 50 AS STRING)) WHEN 6 THEN concat('RFQ-', CAST(o_custkey % 2000 AS STRING)) WHEN 7 THEN concat('AI-', CAST(o_custkey % 900 AS STRING)) ELSE concat('ROW_ID=', CAST(o_custkey % 50 AS STRING)) END"


def _literal(s: str) -> str:
    return "'" + s + "'"


#: SQL that Spark and DuckDB both run, over the table orders.
ITEMS_SQL = f"""
SELECT concat('case', CAST(o_custkey % 3 AS STRING)) AS case_id, o_orderkey AS pos, {IDS} AS req_id,
  concat(t.text, CASE WHEN o_orderkey % 5 < 3 THEN '' ELSE concat(' no. ', CAST(o_custkey % 40 AS STRING)) END) AS requirement, t.notes AS notes,
  CASE o_custkey % 8 WHEN 7 THEN '<file>' ELSE concat('AUTO-spec_', CAST(o_custkey % 7 AS STRING), CASE o_custkey % 2 WHEN 0 THEN '.docx' ELSE '.xlsx' END) END AS file,
  CAST(o_orderkey % 40 AS STRING) AS chunk, CASE WHEN o_custkey % 2 = 1 AND o_orderkey % 3 = 0 THEN 'Main' END AS sheet,
  CASE WHEN o_custkey % 2 = 1 AND o_orderkey % 6 = 0 THEN CAST(o_orderkey % 100 AS INT) END AS row,
  CASE WHEN o_custkey % 2 = 0 AND o_orderkey % 3 = 0 THEN CAST(o_orderkey % 9 AS INT) END AS "table",
  CASE WHEN o_custkey % 2 = 0 AND o_orderkey % 3 = 0 THEN CAST(o_orderkey % 30 AS INT) END AS table_row,
  CASE WHEN o_orderkey % 11 = 1 THEN CAST(o_orderkey % 20 AS INT) END AS page,
  o_orderkey % 17 = 3 AS derived, CASE WHEN o_orderkey % 17 = 3 THEN 'Storage' END AS spec_category,
  CASE o_orderkey % 13 WHEN 1 THEN 'SHOULD' WHEN 2 THEN 'bogus' END AS must_level,
  CASE WHEN o_orderkey % 23 = 0 THEN 'BMC 4' END AS row_name, CASE WHEN o_orderkey % 29 = 0 THEN 'BIOS Requirements' END AS table_name
FROM orders JOIN (SELECT * FROM (VALUES {", ".join(f"({k}, {_literal(t)}, {_literal(n)})" for k, (t, n) in enumerate(TEMPLATES))}) AS v(k, text, notes)) t ON o_orderkey % {len(TEMPLATES)} = t.k
"""

RESPONSES_SQL = """
SELECT concat('case', CAST(o_custkey % 3 AS STRING)) AS case_id, concat('Q', CAST(o_orderkey AS STRING)) AS req_id,
  CASE o_orderstatus WHEN 'F' THEN 'COMPLIANT' WHEN 'O' THEN 'PARTIAL' WHEN 'P' THEN CASE o_orderkey % 2 WHEN 0 THEN 'NON-COMPLIANT' ELSE 'DRAFT' END END AS status,
  CASE WHEN o_orderkey % 3 = 0 THEN 'We comply' ELSE '' END AS vendor_comment, CASE WHEN o_orderkey % 4 = 0 THEN 'small gap' ELSE '' END AS gap, '' AS ai_draft,
  CASE WHEN o_orderkey % 10 = 0 THEN 'Edited text' ELSE ' ' END AS final_requirement, o_orderkey % 15 = 0 AS exclude_from_matrix,
  CASE WHEN o_orderkey % 30 = 0 THEN 'out of scope' ELSE '' END AS exclude_reason
FROM orders WHERE o_orderkey % 5 = 0
"""

CLEAN_SQL = """
SELECT concat('case', CAST(o_custkey % 3 AS STRING)) AS case_id, o_orderkey AS pos, concat('Q', CAST(o_orderkey - CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END AS STRING)) AS req_id,
  CASE o_orderkey % 8 WHEN 0 THEN 'note' WHEN 1 THEN 'glossary' WHEN 2 THEN 'junk' ELSE 'requirement' END AS type,
  CASE o_custkey % 5 WHEN 0 THEN 'MUST' WHEN 1 THEN 'SHOULD' WHEN 2 THEN 'MAY' WHEN 3 THEN 'INFO' END AS must_level,
  CASE o_custkey % 7 WHEN 0 THEN 'BIOS' WHEN 1 THEN 'Compliance, Security' WHEN 2 THEN 'Thermal' WHEN 3 THEN '' WHEN 4 THEN 'PCIe' WHEN 5 THEN 'General' ELSE 'bezel' END AS category,
  CASE o_custkey % 6 WHEN 0 THEN 'QA' WHEN 1 THEN 'pm' WHEN 2 THEN 'EE/Platform' WHEN 3 THEN ' ' WHEN 4 THEN 'BIOS' ELSE 'Legal' END AS owner,
  CASE o_orderkey % 7 WHEN 0 THEN 'NEED_REVIEW' WHEN 1 THEN 'NEW' WHEN 2 THEN 'AUTO_SKIP' WHEN 3 THEN 'CLOSED' WHEN 4 THEN 'pending' WHEN 5 THEN 'PENDING' ELSE '' END AS status,
  concat('Requirement text ', CAST(o_custkey AS STRING)) AS requirement, concat('spec_', CAST(o_custkey % 4 AS STRING), ' — Table 1, Row ', CAST(o_orderkey % 9 AS STRING)) AS source,
  CASE WHEN o_orderkey % 4 = 0 THEN array_one ELSE array_none END AS risk_tags,
  CASE WHEN o_orderkey % 6 = 0 THEN concat('Normal ', CAST(o_custkey % 10 AS STRING)) ELSE '' END AS normalized_requirement,
  CASE o_orderkey % 6 WHEN 0 THEN 'fragment_to_standalone' WHEN 1 THEN 'already_complete' ELSE '' END AS rewrite_reason,
  CAST(o_custkey % 100 AS DOUBLE) / 100.0 AS rewrite_confidence, o_orderkey % 12 = 0 AS needs_rewrite_review
FROM orders
"""
_ARRAYS = {"spark": ("array('CERT')", "CAST(array() AS ARRAY<STRING>)"), "duckdb": ("['CERT']", "CAST([] AS VARCHAR[])")}


def sql_of(text: str, engine: str) -> str:
    one, none = _ARRAYS[engine]
    text = text.replace("array_one", one).replace("array_none", none)
    return text.replace('"table"', "`table`") if engine == "spark" else text


def _view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return spark.sql(sql_of(text, "spark").replace("FROM orders", "FROM {orders}"), orders=orders)


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, ITEMS_SQL)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, RESPONSES_SQL)


def clean_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, CLEAN_SQL)
