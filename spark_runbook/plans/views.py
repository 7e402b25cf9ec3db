"""Event-stream and bookkeeping views over the given tables, each from one text that Spark SQL and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: The fixed "now" of all time rules: books and events.
BOOKS_NOW, EVENTS_NOW = "TIMESTAMP '2001-08-05 00:00:00'", "TIMESTAMP '2024-01-31 00:00:00'"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "daq_events": """SELECT event_id AS event_number, 100000 + CAST(day(ts) AS BIGINT) AS run_number, 1 + CAST(hour(ts) AS BIGINT) AS lumi_section,
        CASE WHEN event_type = 'error' THEN 'ERROR_EVENT' ELSE 'EVENT' END AS message_code,
        CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 0 END AS output_module_id,
        CASE event_type WHEN 'view' THEN 'hltOutputA' WHEN 'click' THEN 'hltOutputB' WHEN 'purchase' THEN 'PhysicsOModule' WHEN 'signup' THEN 'hltOutputDQM' ELSE 'none' END AS output_module_label,
        CAST(event_id % 4 AS INT) AS s_a, CAST(floor(event_id / 3) % 4 AS INT) AS s_b, CAST(floor(event_id / 5) % 4 AS INT) AS s_c, CAST(floor(event_id / 7) % 4 AS INT) AS s_d,
        CAST(floor(event_id / 9) % 4 AS INT) AS s_e, CAST(floor(event_id / 11) % 4 AS INT) AS s_f, CAST(floor(event_id / 13) % 4 AS INT) AS s_g, CAST(floor(event_id / 15) % 4 AS INT) AS s_h,
        CAST(floor(event_id / 17) % 4 AS INT) AS s_i, CAST(round(value * 1000) AS BIGINT) AS data_size, user_id % 8 AS broker_id, user_id AS filter_unit, user_id % 4 AS instance, ts AS creation_time FROM events""",
    "fragments": """SELECT 1 AS code, 100000 + l_orderkey % 10 AS run_number, l_orderkey AS event_number, l_orderkey % 4 AS secondary_id, l_orderkey % 50 AS originator_pid,
        l_orderkey % 7 AS originator_guid, CAST(l_linenumber - 1 AS INT) AS frame_index, CAST(2 + l_orderkey % 3 AS INT) AS num_frames, CAST(l_quantity AS BIGINT) AS data_size, l_shipdate AS arrival
        FROM lineitem WHERE l_linenumber <= 2 + l_orderkey % 3""",
    "files_created": """SELECT concat('Data.', lpad(CAST(100000 + o_custkey % 30 AS STRING), 8, '0'), '.', lpad(CAST(1 + o_orderkey % 24 AS STRING), 4, '0'), '.logger.', lpad(CAST(o_custkey % 16 AS STRING), 2, '0'), '.', lpad(CAST(o_orderkey AS STRING), 8, '0'), '.dat') AS filename,
        concat('srv-C2C0', CAST(6 + o_custkey % 2 AS STRING), '-', lpad(CAST(12 + o_custkey % 16 AS STRING), 2, '0')) AS hostname, CASE WHEN o_custkey % 30 = 7 THEN 'TransferTest' ELSE 'Data' END AS setuplabel,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'A' WHEN '2-HIGH' THEN 'Express' WHEN '3-MEDIUM' THEN 'Calibration' WHEN '4-NOT SPECIFIED' THEN 'A_NoRepack' ELSE 'Error' END AS stream,
        CASE WHEN o_orderkey % 97 = 0 THEN 'Other' ELSE 'Logger' END AS producer, 100000 + o_custkey % 30 AS runnumber, 1 + o_orderkey % 24 AS lumisection, o_custkey % 16 AS instance, o_orderkey AS file_key,
        o_orderdate AS ctime FROM orders""",
    "files_injected": """SELECT o_orderkey AS file_key, 1 + o_orderkey % 500 AS nevents, CAST(round(o_totalprice * 100) AS BIGINT) AS filesize, o_orderdate + INTERVAL 1 DAY AS itime,
        concat('HLTKEY=key', CAST(o_custkey % 3 AS STRING)) AS comment_str FROM orders WHERE o_orderkey % 10 > 0""",
    "files_trans_new": "SELECT o_orderkey AS file_key, o_orderdate + INTERVAL 2 DAY AS itime FROM orders WHERE o_orderkey % 10 > 1",
    "files_trans_copied": "SELECT o_orderkey AS file_key, o_orderdate + INTERVAL 3 DAY AS itime FROM orders WHERE o_orderkey % 10 > 2",
    "files_trans_checked": "SELECT o_orderkey AS file_key, o_orderdate + INTERVAL 4 DAY AS itime FROM orders WHERE o_orderkey % 10 > 3",
    "files_trans_repacked": "SELECT o_orderkey AS file_key, o_orderdate + INTERVAL 5 DAY AS itime FROM orders WHERE o_orderkey % 10 > 4 AND o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')",
    "files_trans_inserted": "SELECT o_orderkey AS file_key, o_orderdate + INTERVAL 6 DAY AS itime FROM orders WHERE o_orderkey % 10 > 5",
    "files_deleted": "SELECT o_orderkey AS file_key, o_orderdate + INTERVAL 7 DAY AS dtime FROM orders WHERE o_orderkey % 10 > 6",
    "disk_inventory": """SELECT o_orderkey AS file_key, 100000 + o_custkey % 30 AS runnumber, o_custkey % 16 AS instance, CAST(round(o_totalprice * 100) AS BIGINT) - CASE WHEN o_orderkey % 50 = 0 THEN 100 ELSE 0 END AS disk_size
        FROM orders WHERE o_orderkey % 10 <= 6 AND o_orderkey % 13 > 0""",
    "dqm_objects": """SELECT 100000 + l_suppkey % 5 AS run_number, 1 + l_partkey % 10 AS lumi_section, l_returnflag AS top_folder, l_linestatus AS folder, concat('me', CAST(l_linenumber AS STRING)) AS object_name,
        CASE WHEN l_linenumber <= 3 THEN 'TH1' WHEN l_linenumber <= 5 THEN 'TProfile' WHEN l_linenumber = 6 THEN 'int' ELSE 'string' END AS kind, l_suppkey AS sender, l_orderkey AS update_number, l_partkey % 8 AS bin,
        CAST(l_quantity AS BIGINT) AS content, CASE WHEN l_quantity > 2 THEN CAST(l_quantity AS BIGINT) ELSE 0 END AS entries, l_shipdate AS arrival FROM lineitem""",
    "dqm_bins": """SELECT 100000 + l_suppkey % 5 AS run_number, 1 + l_partkey % 10 AS lumi_section, l_returnflag AS top_folder, l_linestatus AS folder, concat('me', CAST(l_linenumber AS STRING)) AS object_name,
        CASE WHEN l_linenumber <= 3 THEN 'TH1' ELSE 'TProfile' END AS kind, l_suppkey AS sender, l_orderkey AS update_number, l_partkey % 8 + 3 * k AS bin, CAST(l_quantity AS BIGINT) + k AS content,
        CASE WHEN l_quantity > 20 AND k < 2 THEN CAST(l_quantity AS BIGINT) ELSE 0 END AS entries, CAST(l_quantity AS BIGINT) % 5 + k AS w, (CAST(l_quantity AS BIGINT) % 5 + k) * (l_partkey % 11) AS wy,
        (CAST(l_quantity AS BIGINT) % 5 + k) * (l_partkey % 11) * (l_partkey % 11) AS wyy, l_shipdate AS arrival FROM lineitem CROSS JOIN (VALUES (0), (1), (2)) AS b(k) WHERE l_linenumber <= 5""",
    "registrations": """SELECT concat('c', CAST(c_custkey AS STRING)) AS name, c_custkey AS seq, c_custkey % 3 <> 0 AS is_unique, CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE concat('hltOutput', CAST(c_nationkey % 4 AS STRING)) END AS module,
        CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment ELSE '' END AS expression, c_mktsegment AS paths, 1 + c_custkey % 4 AS prescale, 10 AS queue FROM customer""",
    "init_messages": """SELECT * FROM (VALUES (1, 'hltOutputA'), (2, 'hltOutputB'), (3, 'PhysicsOModule'), (4, 'hltOutputDQM')) AS t(output_module_id, label)""",
    "senders": """SELECT DISTINCT user_id % 8 AS broker_id, 2 AS expected FROM events""",
}


def _tables_of(sql: str) -> list[str]:
    return [t for t in TABLES if re.search(rf"\bFROM {t}\b", sql)]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over the Parquet tables of sf_dir; Spark prunes its columns and pushes its filters to the scan."""
    sql = VIEWS[name]
    used = _tables_of(sql)
    for t in used:
        sql = re.sub(rf"\bFROM {t}\b", f"FROM {{{t}}}", sql)
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def with_views(body: str) -> str:
    """The SQL for DuckDB: body, with the views that it names in front."""
    named = [n for n in VIEWS if re.search(rf"\b{n}\b", body)]
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].replace(' AS STRING', ' AS VARCHAR')})" for n in named)
    if not named:
        return body
    body = body.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    return f"WITH {ctes},\n{body[5:]}" if body[:5].upper() == "WITH " else f"WITH {ctes}\n{body}"
