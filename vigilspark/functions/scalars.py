"""Column functions of the feature and sequence operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM, MIN_STD = 6371.0, 1e-6

FEATURES = (
    "hour_zscore", "dur_zscore", "is_new_resource", "distinct_resources_recent20", "geo_distance_km", "geo_velocity_kmh",
    "fingerprint_mismatch", "auth_success", "n_commands", "session_duration_min", "time_since_last_s", "rolling_fail_5",
    "ip_distinct_entities_recent", "cold_start", "seq_transition_score",
)

#: What a reader sees for each model feature.
REASONS = {
    "hour_zscore": "active at an unusual hour", "dur_zscore": "unusual session length", "is_new_resource": "first access to this resource",
    "distinct_resources_recent20": "many different resources of late", "geo_distance_km": "far from the last position",
    "geo_velocity_kmh": "moved faster than travel allows", "fingerprint_mismatch": "unknown device", "auth_success": "outcome of the login",
    "n_commands": "unusual number of commands", "session_duration_min": "session length", "time_since_last_s": "unusual gap since the last event",
    "rolling_fail_5": "recent failed logins", "ip_distinct_entities_recent": "address shared by many entities", "cold_start": "little history",
    "seq_transition_score": "unlikely sequence of resources",
}


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts) + F.minute(ts) / 60.0


def n_commands(commands: Column) -> Column:
    return F.coalesce(F.size(F.from_json(commands, "array<string>")), F.lit(0)).cast("long")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; null if a coordinate is null."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.when(a.isNotNull(), 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0)))))


def zscore(value: Column, mean: Column, std: Column, circular: bool = False) -> Column:
    """Distance from the mean in floored standard deviations; on the 24-hour circle if circular; null std stays null."""
    d = F.abs(value - mean)
    d = F.least(d, 24 - d) if circular else d
    return F.when(std.isNotNull(), d / F.greatest(std, F.lit(MIN_STD)))


def transition_probability(edge: Column, node: Column, pop_edge: Column, pop_node: Column, alpha: float = 2.0) -> Column:
    pop = F.when(pop_node > 0, (pop_edge + 1) / (pop_node + 50.0)).otherwise(1e-3)
    return (edge + alpha * pop) / (node + alpha)


def marginal_probability(count: Column, total: Column, distinct: Column) -> Column:
    return F.when(total == 0, 1.0).otherwise((count + 1) / (total + distinct + 1.0))


def model_matrix(df: DataFrame, columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """Nulls of the model features, or of those in columns, as 0."""
    return df.na.fill(0, list(columns))


def reasons(contributions: Column, predicted: Column | None = None, top_k: int = 3) -> Column:
    """Reader texts of the top_k strongest contributions that are positive, else of the strongest alone; none for a
    `normal` prediction if predicted is given. contributions: array<struct<name, value>>."""
    by_size = F.array_sort(contributions, lambda a, b: F.when(F.abs(a["value"]) > F.abs(b["value"]), -1).when(F.abs(a["value"]) < F.abs(b["value"]), 1).otherwise(F.when(a["name"] < b["name"], -1).otherwise(1)))
    top = F.slice(by_size, 1, top_k)
    up = F.filter(top, lambda c: c["value"] > 0)
    chosen = F.when(F.size(up) > 0, up).otherwise(F.slice(top, 1, 1))
    table = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    texts = F.transform(chosen, lambda c: F.coalesce(F.element_at(table, c["name"]), c["name"]))
    return texts if predicted is None else F.when(predicted == "normal", F.array().cast("array<string>")).otherwise(texts)
