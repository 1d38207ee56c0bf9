"""Behavioural features: how far an event is from its own entity's past.

All entity windows share one shuffle by entity_id, the address window takes one by source_ip, and columns are carried
along, through the population's counts too, instead of joined back; entities and addresses with very many rows go in
pieces (segments). Every feature but rolling_fail_5 and ip_distinct_entities_recent leaves the event out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalars import FEATURES, MIN_STD, haversine_km, hour_of_day, n_commands, zscore
from ..sources.shared import written
from . import segments, sequence
from .ranking import exact_quantile, percent_ranks

MIN_HISTORY = 5


def by_entity(*more: str) -> WindowSpec:
    return Window.partitionBy("entity_id", *more).orderBy("timestamp", "event_id")


def with_basics(df: DataFrame) -> DataFrame:
    return df.withColumns({"hour_of_day": hour_of_day(F.col("timestamp")), "n_commands": n_commands(F.col("command_sequence"))})


def population_priors(df: DataFrame) -> DataFrame:
    """Mean and sample standard deviation (floored) of hour and duration per entity type, over the whole log."""
    std = lambda c: F.when(F.stddev_samp(c).isNotNull(), F.greatest(F.stddev_samp(c), F.lit(MIN_STD)))
    df = df.withColumn("hour_of_day", hour_of_day(F.col("timestamp")))
    return df.groupBy("entity_type").agg(
        F.avg("hour_of_day").alias("hour_mean"), std("hour_of_day").alias("hour_std"), F.avg("session_duration_min").alias("dur_mean"), std("session_duration_min").alias("dur_std")
    )


def own_past(df: DataFrame, moves: bool = False) -> DataFrame:
    """What windows over whole entities say of each event: its number, the moments before it, what is new, the steps back;
    with moves also the entity's own counts of the edge and its start."""
    prior = by_entity().rowsBetween(Window.unboundedPreceding, -1)
    seen = lambda *c: F.row_number().over(by_entity(*c)) > 1
    df = with_steps(df, by_entity()).withColumns({
        "_type": F.first("entity_type").over(by_entity()), "_number": F.row_number().over(by_entity()),
        "own_hour_mean": F.avg("hour_of_day").over(prior), "own_hour_std": F.stddev_pop("hour_of_day").over(prior),
        "own_dur_mean": F.avg("session_duration_min").over(prior), "own_dur_std": F.stddev_pop("session_duration_min").over(prior),
        "_new": ~seen("resource_accessed"), "_newdev": ~seen("device_os", "device_mac"),
    })
    return df.withColumns(sequence.own_counts("prev_resource", "resource_accessed")) if moves else df


def with_steps(df: DataFrame, w: WindowSpec) -> DataFrame:
    """The features that need a few rows before the event only."""
    first = F.lag("event_id").over(w).isNull()
    km = F.when(first, 0.0).otherwise(haversine_km(F.lag("geo_lat").over(w), F.lag("geo_lon").over(w), F.col("geo_lat"), F.col("geo_lon")))
    return df.withColumns({
        "_gap": F.unix_micros("timestamp") - F.unix_micros(F.lag("timestamp").over(w)), "geo_distance_km": km,
        "distinct_resources_recent20": F.size(F.collect_set("resource_accessed").over(w.rowsBetween(-20, -1))).cast("long"),
        "rolling_fail_5": F.sum((~F.col("auth_success")).cast("long")).over(w.rowsBetween(-4, 0)), "prev_resource": F.lag("resource_accessed").over(w),
    })


def own_past_in_pieces(df: DataFrame, moves: bool = False) -> DataFrame:
    """The same for hot entities: windows over pieces with a halo of 20 rows, moments and numbers carried from piece to
    piece, what is new by minima over the entity."""
    cut = segments.pieces(df, "entity_id")
    types = segments.few(cut.groupBy("entity_id").agg(F.min_by("entity_type", F.struct(*segments.ORDER)).alias("_type")))
    past = segments.few(segments.moments(cut, "entity_id", {"h": "hour_of_day", "d": "session_duration_min"}))
    flag = lambda new, dev: [F.lit(new).alias("_new"), F.lit(dev).alias("_newdev")]
    new = segments.firsts(cut, "entity_id", "resource_accessed").select("event_id", *flag(True, False))
    new = new.unionByName(segments.firsts(cut, "entity_id", "device_os", "device_mac").select("event_id", *flag(False, True)))
    new = new.groupBy("event_id").agg(F.max("_new").alias("_new"), F.max("_newdev").alias("_newdev"))
    w = segments.in_piece("entity_id")
    prior = w.rowsBetween(Window.unboundedPreceding, -1)
    own = lambda c: F.when(~F.col("_halo"), c)
    before = {"_in": F.count(own(F.lit(1))).over(prior)}
    for name, c in (("h", "hour_of_day"), ("d", "session_duration_min")):
        v = own(F.col(c))
        before |= {f"_in{name}": F.count(v).over(prior), f"_im{name}": F.avg(v).over(prior), f"_iq{name}": F.var_pop(v).over(prior) * F.count(v).over(prior)}
    out = with_steps(segments.with_halo(cut, "entity_id", 20), w).withColumns(before).where("not _halo").drop("_halo")
    out = out.join(past, ["entity_id", "_seg"], "left").join(types, "entity_id").join(new, "event_id", "left")
    out = out.withColumns({"_number": F.coalesce("_rows", F.lit(0)) + F.col("_in") + 1, "_new": F.coalesce("_new", F.lit(False)), "_newdev": F.coalesce("_newdev", F.lit(False))})
    for name, kind in (("h", "hour"), ("d", "dur")):
        mean, std = segments.merged_moments(name, F.col(f"_in{name}"), F.col(f"_im{name}"), F.col(f"_iq{name}"))
        out = out.withColumns({f"own_{kind}_mean": mean, f"own_{kind}_std": std})
    if moves:
        steps = sequence.transitions_in_pieces(cut.select("event_id", "entity_id", "entity_type", "timestamp", "_seg", F.col("resource_accessed").alias("cur")))
        out = out.join(steps.select("event_id", "entity_edge", "entity_node"), "event_id")
    return out.select(*own_past(df, moves).columns)


def entity_windows(df: DataFrame, priors: DataFrame, min_history: int = MIN_HISTORY) -> DataFrame:
    """All features that look at the entity's own past, and rolling_fail_5. event_id is a key of df."""
    ordinary, hot = segments.split(with_basics(df), "entity_id")
    past = own_past(ordinary)
    if hot is not None:
        past = past.unionByName(own_past_in_pieces(hot))
    return compared(past, priors, min_history).drop("_type")


def dealt_windows(df: DataFrame, priors: DataFrame) -> tuple[DataFrame, int | None]:
    """(entity_windows of df, a written table with basics, and _type, entity_edge and entity_node; written, number of buckets).

    Entities are dealt by ranges of entity_id to tasks of about so many events as the population counts take, so without
    hot entities the tasks are these counts' buckets in entity order already (_bucket); otherwise the number is None."""
    ordinary, hot = segments.split(df, "entity_id")
    buckets = max(1, -(-df.count() // sequence.ROWS))
    past = own_past(ordinary.repartitionByRange(buckets, "entity_id"), moves=True)
    if hot is not None:
        past = past.unionByName(own_past_in_pieces(hot, moves=True))
    out = compared(past, priors, MIN_HISTORY).drop("geo_lat", "geo_lon", "device_os", "device_mac", *[c for c in past.columns if c.startswith("own_")])
    return written(out if hot is not None else out.withColumn("_bucket", F.spark_partition_id()), "windows"), None if hot is not None else buckets


def compared(df: DataFrame, priors: DataFrame, min_history: int) -> DataFrame:
    """own_past's rows with the features that compare an event with the entity's past or, while that is short, with priors."""
    df = df.join(F.broadcast(priors.withColumnRenamed("entity_type", "_type")), "_type", "left")  # an entity's prior is that of its first row's type
    df = df.withColumn("_cold", F.col("_number") <= min_history)
    pick = lambda c: F.when(F.col("_cold"), F.col(c)).otherwise(F.col(f"own_{c}"))
    return df.withColumns({
        "hour_zscore": zscore(F.col("hour_of_day"), pick("hour_mean"), pick("hour_std"), circular=True),
        "dur_zscore": zscore(F.col("session_duration_min"), pick("dur_mean"), pick("dur_std")),
        "is_new_resource": (F.col("_new") & ~F.col("_cold")).cast("long"), "fingerprint_mismatch": (F.col("_newdev") & ~F.col("_cold")).cast("long"),
        "cold_start": F.col("_cold").cast("long"), "time_since_last_s": F.col("_gap") / 1e6,
        "geo_velocity_kmh": F.when(F.col("_gap").isNull(), 0.0).otherwise(F.col("geo_distance_km") / F.greatest(F.col("_gap") / 3.6e9, F.lit(1e-4))),
    }).drop("_number", "_cold", "_new", "_newdev", "_gap", "hour_mean", "hour_std", "dur_mean", "dur_std")


def ip_distinct_entities(df: DataFrame, window: int = 20) -> DataFrame:
    """Different entities among the address's last `window` events, this one included; 0 for a null address, whose
    rows are spread by event. Hot addresses go in pieces with a halo."""
    different = lambda w: F.size(F.collect_set("entity_id").over(w.rowsBetween(1 - window, 0))).cast("long")
    ordinary, hot = segments.split(df, "source_ip")
    key = F.coalesce("source_ip", F.concat(F.lit("event "), "event_id"))
    n = F.when(F.col("source_ip").isNull(), F.lit(0)).otherwise(different(Window.partitionBy(key).orderBy(*segments.ORDER))).cast("long")
    out = ordinary.withColumn("ip_distinct_entities_recent", n)
    if hot is None:
        return out
    rows = segments.with_halo(segments.pieces(hot, "source_ip"), "source_ip", window - 1)
    rows = rows.withColumn("ip_distinct_entities_recent", different(segments.in_piece("source_ip"))).where("not _halo")
    return out.unionByName(rows.select(*out.columns))


def fill_median(df: DataFrame, column: str, rows: DataFrame | None = None) -> DataFrame:
    """Nulls of column become its exact global median; rows, if given, is a written table with the same values."""
    median = exact_quantile((df if rows is None else rows).select(column), column, 0.5, "_median")
    return df.crossJoin(F.broadcast(median)).withColumn(column, F.coalesce(column, "_median")).drop("_median")


def build_features(df: DataFrame, pop_order: str = "entity") -> DataFrame:
    """One row per event: ids, label, hour_of_day and the 15 model features."""
    df = df if "label" in df.columns else df.withColumn("label", F.lit(None).cast("string"))
    carry = ["label", "hour_of_day", *[c for c in FEATURES if c != "seq_transition_score"]]
    kept = ["event_id", "entity_id", "entity_type", "timestamp", "label", "geo_lat", "geo_lon", "resource_accessed", "auth_success", "session_duration_min", "device_os", "device_mac", "hour_of_day", "n_commands"]
    log = written(ip_distinct_entities(with_basics(df)).select(*kept, "ip_distinct_entities_recent"), "log")
    windows, buckets = dealt_windows(log, population_priors(log))
    moves = windows.withColumnsRenamed({"entity_type": "_own_type", "_type": "entity_type", "resource_accessed": "cur", "prev_resource": "prev"})
    dealt = buckets if pop_order == "entity" else None
    counts = sequence.population_counts(moves, pop_order, ("_own_type", *carry), dealt, stored=True)
    rows = written(counts.select("event_id", "entity_id", F.col("_own_type").alias("entity_type"), *carry, sequence.neg_log_prob().alias("seq_neg_log_prob")), "transitions")
    out = fill_median(percent_ranks(rows, "seq_neg_log_prob", "seq_transition_score"), "time_since_last_s", rows)
    out = out.withColumn("auth_success", F.col("auth_success").cast("long"))
    return out.select("event_id", "entity_id", "entity_type", "label", "hour_of_day", *FEATURES)


def feature_summary(features: DataFrame) -> DataFrame:
    """mean, std, min and max, one row per feature."""
    stats = [F.struct(F.lit(c).alias("feature"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")) for c in FEATURES]
    return features.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def label_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.count("*").alias("n"))
