"""Views that give the given tables the shape of listings, versions, manifests, journals and call logs.

One text serves Spark and DuckDB; the few functions that differ are put in by `dialect`."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")
#: In an order in which each view comes after those that it reads.
VIEWS = {
    "f1_inventory": """SELECT doc_id, 'bkt' AS bucket,
  source || '/' || lang || '/' || CASE WHEN doc_id % 29 = 0 THEN 'bad|' ELSE '' END || 'doc_' || CAST(doc_id AS STRING) AS key,
  CASE WHEN doc_id % 37 = 0 THEN upper(md5(body)) WHEN doc_id % 5 = 0 THEN '"' || md5(body) || '"' ELSE md5(body) END AS etag_raw,
  CAST(BYTES(body) AS BIGINT) AS size,
  CASE WHEN doc_id % 17 = 0 THEN '' WHEN doc_id % 19 = 0 THEN 'a/b' WHEN doc_id % 23 = 0 THEN '..' ELSE 'owner_' || CAST(doc_id % 5 AS STRING) END AS owner_id, body
FROM (SELECT doc_id, source, lang,
  CASE WHEN doc_id % 7 = 0 THEN '1000;chunk-signature=' || md5(text) || md5(text) || chr(13) || chr(10) || text
       WHEN doc_id % 11 = 0 THEN text || chr(13) || chr(10) || 'x-amz-checksum-crc32:AAAAAA==' || chr(13) || chr(10)
       WHEN doc_id % 13 = 0 THEN substring(text, 1, 400) || chr(10) || 'ff;chunk-signature=' || md5(text) || md5(text) || chr(10) || substring(text, 401)
       WHEN doc_id % 31 = 0 THEN '' ELSE text END AS body FROM documents) d""",
    "f2_parts": """SELECT key, l_orderkey, part_no, part_size,
  CAST(sum(part_size) OVER (PARTITION BY l_orderkey ORDER BY part_no ROWS UNBOUNDED PRECEDING) - part_size AS BIGINT) AS off,
  md5(key || ':' || CAST(part_no AS STRING)) AS part_md5
FROM (SELECT 'mp/' || CAST(l_orderkey AS STRING) AS key, l_orderkey, CAST(l_quantity AS BIGINT) * 1000 + 64 AS part_size,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_tax, l_discount) AS part_no FROM lineitem) p""",
    "f2_uploads": """SELECT key, l_orderkey, n, CASE WHEN l_orderkey % 7 = 4 THEN greatest(last_off - 1, 0) ELSE total END AS size,
  CASE l_orderkey % 7 WHEN 0 THEN h || '-' || CAST(n AS STRING) WHEN 2 THEN h || '-' || CAST(n + 1 AS STRING) || '-' || offs
       WHEN 3 THEN upper(h) || '-' || CAST(n AS STRING) || '-' || offs WHEN 5 THEN h || '-' || CAST(n AS STRING) || '-1' || offs
       ELSE h || '-' || CAST(n AS STRING) || '-' || offs END AS etag
FROM (SELECT key, l_orderkey, CAST(count(*) AS BIGINT) AS n, CAST(sum(part_size) AS BIGINT) AS total, max(off) AS last_off, md5(key) AS h,
  JOIN_ORDERED(CAST(off AS STRING), '|', part_no) AS offs FROM f2_parts GROUP BY key, l_orderkey) u""",
    "f3_versions": """SELECT 'bkt' AS bucket,
  'c' || CAST(o_custkey % 10 AS STRING) || '/' || CASE WHEN o_custkey % 211 = 0 THEN 'x' || chr(31) ELSE '' END || 'k_' || CAST(o_custkey AS STRING) AS key,
  CASE WHEN o_orderkey % 97 = 0 THEN 'null' ELSE 'v' || CAST(o_orderkey AS STRING) END AS version_id,
  o_orderstatus = 'F' AS is_delete_marker, o_orderdate AS last_modified, o_orderkey FROM orders""",
    "f4_journal": """SELECT event_id AS line_no,
  CASE WHEN event_type = 'signup' THEN 'discovered|u' || CAST(user_id AS STRING) || '/' WHEN event_type = 'purchase' THEN 'done|u' || CAST(user_id AS STRING) || '/'
       ELSE 'cursor|u' || CAST(user_id AS STRING) || CASE WHEN user_id % 9 = 0 THEN '|p' ELSE '' END || '/|t' || CAST(event_id AS STRING) END AS line FROM events""",
    "f4_pages": """SELECT 's' || CAST(l_suppkey AS STRING) || '/' AS prefix, CAST(l_linenumber - 1 AS INT) AS seq, CAST(count(*) AS BIGINT) AS obj_count,
  CASE WHEN l_linenumber = 7 THEN '' ELSE 'T' || CAST(l_linenumber AS STRING) END AS next_token FROM lineitem GROUP BY l_suppkey, l_linenumber""",
    "f4_terminals": """SELECT 's' || CAST(l_suppkey AS STRING) || '/' AS prefix, CAST(l_linenumber - 1 AS INT) AS seq, l_orderkey, l_partkey
FROM lineitem WHERE NOT (l_linenumber > l_suppkey % 9 AND l_returnflag = 'R')""",
    "f5_calls": """SELECT event_id AS call_id, ts, user_id % 8 AS worker, user_id % 3 AS node, value AS latency_ms,
  CASE WHEN event_type = 'signup' THEN 'list' WHEN event_type = 'view' THEN 'head' ELSE 'get' END AS op,
  CASE WHEN event_type <> 'error' THEN 200 WHEN event_id % 6 = 0 THEN 500 WHEN event_id % 6 = 1 THEN 404 WHEN event_id % 6 = 2 THEN 501
       WHEN event_id % 6 = 3 THEN 405 WHEN event_id % 6 = 4 THEN 403 ELSE 0 END AS http_code,
  CASE WHEN event_type <> 'error' THEN '' WHEN event_id % 6 = 1 THEN 'NoSuchKey' WHEN event_id % 6 = 4 THEN 'AccessDenied' ELSE '' END AS s3_code,
  CASE WHEN event_type = 'error' AND event_id % 6 = 5 THEN CASE WHEN user_id % 2 = 0 THEN 'dial tcp 10.0.0.1:9000: connection refused' ELSE 'bad digest' END
       WHEN event_type = 'error' THEN 'request body read timeout' ELSE '' END AS err,
  event_type = 'error' AND event_id % 6 = 3 AND user_id % 2 = 0 AS delete_marker_header FROM events""",
    "f6_lines": """SELECT o_orderkey AS line_no,
  CASE o_orderkey % 13 WHEN 0 THEN 'bkt|' || k WHEN 1 THEN 'bkt|' || k || '|2|0|' || CAST(o_custkey + 1 AS STRING)
    WHEN 2 THEN 'other|' || k WHEN 3 THEN 'bkt|' || k || '|3|0|5' WHEN 4 THEN 'bkt|' || k || '|2|0|0' WHEN 5 THEN 'bkt|' || k || '|x|0'
    WHEN 6 THEN '   ' WHEN 7 THEN 'bkt| ' WHEN 8 THEN 'bkt|' || k || '|0' WHEN 9 THEN 'bkt|' || k || '|1|7'
    WHEN 10 THEN 'bkt|' || k || '|2|0|-5' WHEN 11 THEN 'bkt|' || k || '|2|0| 5' ELSE 'bkt' END AS line
FROM (SELECT o_orderkey, o_custkey, 'k/' || CAST(o_custkey AS STRING) AS k FROM orders) o""",
    "f7_head": """SELECT key, CASE WHEN doc_id % 24 = 0 THEN COMPOSITE(body) WHEN doc_id % 6 = 0 THEN md5(body) || '-2' ELSE md5(body) END AS etag, size FROM f1_inventory WHERE doc_id % 10 <> 9""",
    "f7_target": """SELECT CASE WHEN doc_id % 10 = 3 THEN 'copy/' || key ELSE key END AS key, CASE WHEN doc_id % 6 = 0 THEN md5(body) || '-2' ELSE md5(body) END AS etag,
  CASE WHEN doc_id % 14 = 5 THEN size + 1 ELSE size END AS size FROM f1_inventory WHERE doc_id % 10 <> 9""",
    "f7_declared": """SELECT key, doc_id % 4 = 0 AS is_multipart, doc_id FROM f1_inventory""",
    "f8_trees": """SELECT s_suppkey AS tree, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'data' || CAST(s_suppkey AS STRING) || CASE WHEN s_suppkey % 3 = 1 THEN '/' ELSE '' END END AS prefix,
  CAST(s_suppkey % 4 + 1 AS INT) AS depth, CAST(s_nationkey % 5 + 1 AS INT) AS width, CAST(s_suppkey % 11 + 1 AS INT) AS files FROM supplier""",
    "f9_access": """SELECT page_id, CASE WHEN page_id % 5 = 4 THEN 'HEAD' ELSE 'GET' END AS method,
  CASE WHEN page_id % 3 = 0 THEN '/bkt' WHEN page_id % 3 = 1 THEN '/' ELSE '/bkt/a/key' || CAST(page_id AS STRING) END AS path,
  CASE page_id % 7 WHEN 0 THEN 'list-type=2&prefix=a' WHEN 1 THEN 'prefix=a&marker=b' WHEN 2 THEN 'location=' WHEN 3 THEN ''
    WHEN 4 THEN 'versionId=v1' WHEN 5 THEN 'delimiter=%2F&encoding-type=url&prefix=' ELSE 'uploads' END AS query, url FROM pages""",
}


def dialect(sql: str, spark: bool) -> str:
    """BYTES, JOIN_ORDERED and COMPOSITE (the ETag of a text stored in two halves) in the words of one engine."""
    half = "CAST(2 * floor(BYTES({0}) / 2) AS INT)"
    composite = "md5(unhex(md5(unhex(substring(HEX({0}), 1, " + half + "))) || md5(unhex(substring(HEX({0}), " + half + " + 1))))) || '-2'"
    sql = re.sub(r"COMPOSITE\((\w+)\)", lambda m: composite.format(m[1]), sql)
    sql = re.sub(r"HEX\((\w+)\)", r"hex(\1)" if spark else r"hex(encode(\1))", sql)
    sql = re.sub(r"BYTES\((\w+)\)", r"octet_length(\1)" if spark else r"strlen(\1)", sql)
    ordered = r"listagg(\1, \2) WITHIN GROUP (ORDER BY \3)" if spark else r"string_agg(\1, \2 ORDER BY \3)"
    return re.sub(r"JOIN_ORDERED\((CAST\(\w+ AS STRING\)|\w+), ('[^']*'), (\w+)\)", ordered, sql)


def needed(name: str) -> list[str]:
    """The views that a view reads, and itself, in order."""
    out: list[str] = []
    for other in VIEWS:
        if other != name and re.search(rf"\b{other}\b", VIEWS[name]):
            out += [x for x in needed(other) if x not in out]
    return [*out, name]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    chain = needed(name)
    text = "WITH " + ", ".join(f"{v} AS ({dialect(VIEWS[v], True)})" for v in chain) + f" SELECT * FROM {name}"
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE if re.search(rf"FROM {t}\b", text)}
    for t in used:
        text = re.sub(rf"FROM {t}\b", f"FROM {{{t}}}", text)
    return spark.sql(text, **used)


def oracle(sql: str) -> str:
    """DuckDB text over the views."""
    read = [v for v in VIEWS if any(v in needed(o) for o in VIEWS if re.search(rf"\b{o}\b", sql))]
    chain = ",\n".join(f"{v} AS ({dialect(VIEWS[v], False)})" for v in read)
    sql = dialect(sql, False)
    return f"WITH RECURSIVE {chain}\n{sql}" if chain else f"WITH RECURSIVE {sql.lstrip()[1:]}" if sql.lstrip().startswith(",") else sql
