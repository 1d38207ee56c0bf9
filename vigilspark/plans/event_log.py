"""The access log that the registered queries read: derived from the table events, with places by a formula."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: One text for Spark and DuckDB (FIXTURES.md).
TEST_LOG_SQL = """
WITH e AS (
  SELECT *, cast(regexp_extract(props, '[0-9]+', 0) AS int) AS k FROM events
),
g AS (
  SELECT *, CASE WHEN k % 20 = 3 THEN (user_id + k) % 15 ELSE user_id % 15 END AS place FROM e
)
SELECT
  lpad(cast(event_id AS string), 10, '0') AS event_id,
  concat(CASE WHEN user_id % 20 < 13 THEN 'user::' WHEN user_id % 20 < 16 THEN 'svc::' ELSE 'dev::' END,
         lpad(cast(user_id AS string), 8, '0')) AS entity_id,
  CASE WHEN user_id % 20 < 13 THEN 'user' WHEN user_id % 20 < 16 THEN 'service_account'
       ELSE 'edge_device' END AS entity_type,
  cast(ts AS timestamp) AS timestamp,
  concat('10.0.', cast(k % 4 AS string), '.', cast((user_id + k) % 50 AS string)) AS source_ip,
  cast(place * 37 % 120 - 60 AS double) + 0.25 AS geo_lat,
  cast(place * 101 % 340 - 170 AS double) + 0.5 AS geo_lon,
  concat('place ', cast(place AS string)) AS geo_location,
  concat('/', event_type, '/', cast(k % 18 AS string)) AS resource_accessed,
  CASE user_id % 5 WHEN 0 THEN 'password' WHEN 1 THEN 'token' WHEN 2 THEN 'certificate'
                   WHEN 3 THEN 'biometric' ELSE 'sso' END AS auth_method,
  event_type <> 'error' AS auth_success,
  value AS session_duration_min,
  concat('[', CASE WHEN k % 5 = 0 THEN ''
                   ELSE concat('"ls"', repeat(',"cat"', cast(k % 5 - 1 AS int))) END, ']') AS command_sequence,
  concat('os', cast(user_id % 5 AS string)) AS device_os,
  CASE WHEN k = 7 THEN concat('spoof', cast(event_id % 3 AS string))
       ELSE concat('mac', cast(user_id AS string)) END AS device_mac,
  CASE user_id % 3 WHEN 0 THEN 'HTTPS' WHEN 1 THEN 'SSH2' ELSE 'MQTT' END AS protocol,
  CASE WHEN k = 7 THEN 'device_spoofing'
       WHEN k % 20 = 3 AND event_type = 'purchase' THEN 'impossible_travel'
       WHEN event_type = 'error' AND k >= 95 THEN 'brute_force'
       ELSE 'normal' END AS label
FROM g
"""


def log_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The access log derived from the test table events."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.sql(TEST_LOG_SQL.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
