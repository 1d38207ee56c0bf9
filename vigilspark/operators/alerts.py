"""Alert queue, profiles and analyst views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DETAILS = ("timestamp", "source_ip", "geo_location", "resource_accessed", "auth_method", "device_os", "label")
HISTORY = ("timestamp", "resource_accessed", "geo_location", "auth_success", "session_duration_min", "label")


#: More alerts than this are not broadcast.
MANY = 100_000


def top_alerts(scored: DataFrame, n: int = 150) -> DataFrame:
    return scored.orderBy(F.desc("risk_score"), "event_id").limit(n)


def attach_details(top: DataFrame, log: DataFrame) -> DataFrame:
    """The alerts with the raw columns that they lack; the log is only filtered, by a broadcast of the alerts if few."""
    details = [c for c in DETAILS if c not in top.columns]
    few = F.broadcast if top.limit(MANY + 1).count() <= MANY else (lambda df: df)
    found = log.join(few(top.select("event_id")), "event_id", "left_semi").select("event_id", *details)
    return top.join(few(found), "event_id", "left")


def alert_queue(scored: DataFrame, log: DataFrame, n: int = 150) -> DataFrame:
    """Alert rows; scored needs risk_score and predicted_category, and may have reasons and cold_start."""
    top = attach_details(top_alerts(scored, n), log)
    have = lambda c, other: F.col(c) if c in top.columns else other.alias(c)
    return top.select(
        "event_id", "entity_id", "entity_type", "timestamp", F.round("risk_score", 1).alias("risk_score"), "predicted_category", F.col("label").alias("ground_truth_label"),
        have("reasons", F.array().cast("array<string>")), "source_ip", "geo_location", "resource_accessed", "auth_method", "device_os", have("cold_start", F.lit(None)).cast("boolean").alias("cold_start"),
    )


def alert_summary(alerts: DataFrame, scored: DataFrame) -> DataFrame:
    by = alerts.groupBy("predicted_category").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("predicted_category", "n")))).alias("category_breakdown"))
    shown = alerts.agg(F.count("*").alias("alerts_shown"), F.coalesce(F.sum((F.col("ground_truth_label") != "normal").cast("long")), F.lit(0)).alias("true_anomalies_in_queue"))
    precision = F.when(F.col("alerts_shown") > 0, F.round(F.col("true_anomalies_in_queue") / F.col("alerts_shown"), 3)).otherwise(0.0)
    return scored.agg(F.count("*").alias("total_events_scored")).crossJoin(shown).crossJoin(by).withColumn("precision_in_queue", precision)


def entity_history(alerts: DataFrame, log: DataFrame, n: int = 15) -> DataFrame:
    """For each entity in the queue its last n events, ascending, as one array."""
    few = F.broadcast if alerts.limit(MANY + 1).count() <= MANY else (lambda df: df)
    own = log.join(few(alerts.select("entity_id").distinct()), "entity_id", "left_semi")
    k = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("timestamp"), F.desc("event_id")))
    last = own.withColumn("_k", k).where(F.col("_k") <= n)
    rows = F.sort_array(F.collect_list(F.struct(F.col("timestamp"), F.col("event_id"), *[c for c in HISTORY if c != "timestamp"])))
    return last.groupBy("entity_id").agg(F.transform(rows, lambda r: F.struct(*[r[c].alias(c) for c in HISTORY])).alias("history"))


def review_queue(alerts: DataFrame, category: str | None = None) -> DataFrame:
    verdict = F.when(F.col("predicted_category") == F.col("ground_truth_label"), "matched").when(F.col("ground_truth_label") != "normal", "true anomaly, category differs").otherwise("false positive")
    out = alerts.withColumn("verdict", verdict)
    return out if category is None else out.where(F.col("predicted_category") == category)


def entity_profiles(log: DataFrame) -> DataFrame:
    hour = F.hour("timestamp") + F.minute("timestamp") / 60.0
    return log.groupBy("entity_id").agg(
        F.min_by("entity_type", F.struct("timestamp", "event_id")).alias("entity_type"), F.count("*").alias("n_events_observed"), F.round(F.avg(hour), 2).alias("mean_login_hour"),
        F.round(F.avg("session_duration_min"), 2).alias("mean_session_duration_min"), F.countDistinct("resource_accessed").alias("distinct_resources_ever"),
        F.countDistinct(F.struct("device_os", "device_mac")).alias("distinct_device_fingerprints_ever"), (F.count("*") < 5).alias("cold_start"),
    )


def recent_top(scored: DataFrame, arrival: str = "event_id", last: int = 500, n: int = 20) -> DataFrame:
    """Of the last scored events the n highest."""
    return scored.orderBy(F.desc(arrival)).limit(last).orderBy(F.desc("risk_score"), "event_id").limit(n)


def counters(log: DataFrame, since: str | None = None) -> DataFrame:
    late = F.lit(True) if since is None else F.col("timestamp") >= F.lit(since).cast("timestamp")
    return log.agg(F.countDistinct("entity_id").alias("entities_known"), F.sum(late.cast("long")).alias("events_since_start"))
