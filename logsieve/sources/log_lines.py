"""A deterministic log corpus rendered from the events table: one line shape for each event_id modulo 16."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logsieve.sources.tables import spread

_TEMPLATE = """
SELECT event_id, ts, user_id, event_id % 16 AS k,
  CASE WHEN event_id % 16 IN (9,10,15) THEN 'journal' ELSE 'docker' END AS source_type,
  CASE WHEN event_id % 16 IN (9,10) THEN 'sshd' WHEN event_id % 16 = 15 THEN 'sudo'
       WHEN event_id % 16 IN (8,11,12) THEN 'api-backend' WHEN event_id % 16 = 14 THEN 'my-postgres-db'
       ELSE 'demo-nginx' END AS source_name,
  CASE WHEN event_id % 16 IN (9,10) THEN 'ssh.service' ELSE '' END AS unit,
  method, path, CAST(status AS INT) AS status, bytes, ip,
  CASE event_id % 16
    WHEN 8  THEN concat('GET /api/keys/', cast(event_id AS STRING), ' 200 0.563 ms - ', cast(1000 + user_id AS STRING))
    WHEN 9  THEN concat('Invalid user u', cast(user_id AS STRING), ' from ', ip, ' port ', cast(20000 + event_id % 9000 AS STRING))
    WHEN 10 THEN concat('Accepted password for deploy from ', ip, ' port ', cast(20000 + event_id % 9000 AS STRING), ' ssh2')
    WHEN 11 THEN '    at handleRequest (/app/server.js:275:35)'
    WHEN 12 THEN concat('dump ', cast(event_id AS STRING), ' root:x:0:0:root:/root:/bin/bash')
    WHEN 13 THEN concat({ymd}, ' [error] 31#31: *', cast(event_id AS STRING), ' open() "/usr/share/nginx/html/x', cast(user_id % 5 AS STRING), '.php" failed (2: No such file or directory), client: ', ip, ', server: localhost, request: "GET /x.php HTTP/1.1"')
    WHEN 14 THEN concat({iso}, '.123 UTC [', cast(1000 + user_id AS STRING), '] app@db LOG:  duration: ', cast(event_id % 97 AS STRING), '.5 ms  statement: SELECT * FROM t WHERE id = ', cast(event_id AS STRING))
    WHEN 15 THEN concat('user', cast(user_id AS STRING), ' : user NOT in sudoers ; TTY=pts/0')
    ELSE concat(ip, ' - - [', {clf}, ' +0000] "', method, ' ', path, ' HTTP/1.1" ', cast(status AS STRING), ' ', cast(bytes AS STRING), ' "-" "curl/8.5.0" "-"')
  END AS line
FROM (SELECT event_id, ts, user_id,
  concat('10.', cast(user_id % 4 AS STRING), '.', cast(event_id % 8 AS STRING), '.', cast(1 + user_id % 200 AS STRING)) AS ip,
  CASE WHEN event_id % 16 = 5 THEN 'POST' ELSE 'GET' END AS method,
  CASE event_id % 16 WHEN 0 THEN '/' WHEN 1 THEN '/.env' WHEN 2 THEN concat('/api/orders/', cast(100000 + event_id AS STRING), '?ts=1700000000')
    WHEN 3 THEN '/?q=UNION+SELECT+1,2,3' WHEN 4 THEN '/admin' WHEN 5 THEN '/login' WHEN 6 THEN '/actuator/env' ELSE '/bad' END AS path,
  CASE event_id % 16 WHEN 1 THEN 404 WHEN 4 THEN 401 WHEN 5 THEN 405 WHEN 6 THEN 403 WHEN 7 THEN 400 ELSE 200 END AS status,
  200 + (event_id * 7) % 3000 AS bytes
  FROM {src}) t
"""


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines of the events under ``sf_dir``; the event's time as a UTC instant."""
    events = spread(spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "CAST(ts AS TIMESTAMP) AS ts", "user_id"), "event_id")
    form = {"ymd": "yyyy/MM/dd HH:mm:ss", "iso": "yyyy-MM-dd HH:mm:ss", "clf": "dd/MMM/yyyy:HH:mm:ss"}
    sql = _TEMPLATE.format(src="{events}", **{k: f"date_format(ts, '{v}')" for k, v in form.items()})
    return spark.sql(sql, events=events)


def sql() -> str:
    """The same as a DuckDB query over the events view."""
    form = {"ymd": "%Y/%m/%d %H:%M:%S", "iso": "%Y-%m-%d %H:%M:%S", "clf": "%d/%b/%Y:%H:%M:%S"}
    return _TEMPLATE.format(src="events", **{k: f"strftime(ts, '{v}')" for k, v in form.items()}).replace("STRING", "VARCHAR")
