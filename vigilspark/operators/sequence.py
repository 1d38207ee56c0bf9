"""Transition graph: how unlikely is it that this entity goes from one resource to the next?

Population counts before an event are running sums over the events in entity order (all events of lower entities first)
or in time order, dealt by ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import marginal_probability, transition_probability
from ..sources.shared import written
from . import segments
from .ranking import percent_ranks

#: Population counts run inside buckets of about so many events.
ROWS = 100_000


def before(*keys: str) -> object:
    return Window.partitionBy(*keys).orderBy("timestamp", "event_id").rowsBetween(Window.unboundedPreceding, -1)


def own_counts(prev: str, cur: str) -> dict[str, Column]:
    """The entity's own earlier counts of an event's edge and of its start; null without a previous resource."""
    count = lambda *k: F.when(F.col(prev).isNotNull(), F.count(F.lit(1)).over(before(*k)))
    return {"entity_edge": count("entity_id", prev, cur), "entity_node": count("entity_id", prev)}


def entity_transitions(df: DataFrame) -> DataFrame:
    """Each event with its previous resource and the entity's own earlier counts of the edge and of its start."""
    df = df.select("event_id", "entity_id", "entity_type", "timestamp", F.col("resource_accessed").alias("cur"))
    ordinary, hot = segments.split(df, "entity_id")
    own = Window.partitionBy("entity_id").orderBy("timestamp", "event_id")
    out = ordinary.withColumns({"entity_type": F.first("entity_type").over(own), "prev": F.lag("cur").over(own)})
    out = out.withColumns(own_counts("prev", "cur"))
    return out if hot is None else out.unionByName(transitions_in_pieces(segments.pieces(hot, "entity_id")).select(*out.columns))


def transitions_in_pieces(cut: DataFrame) -> DataFrame:
    """The same for the pieces of hot entities: counts inside a piece, and what earlier pieces of the entity counted."""
    types = segments.few(cut.groupBy("entity_id").agg(F.min_by("entity_type", F.struct(*segments.ORDER)).alias("entity_type")))
    moves = segments.with_halo(cut, "entity_id", 1).withColumn("prev", F.lag("cur").over(segments.in_piece("entity_id"))).where("not _halo")
    moves = written(moves.drop("_halo", "entity_type").join(types, "entity_id"), "moves-in-pieces")
    for name, keys in (("entity_edge", ("prev", "cur")), ("entity_node", ("prev",))):
        each = moves.where("prev is not null").groupBy("entity_id", *keys, "_seg").agg(F.count("*").alias("_n"))
        earlier = F.sum("_n").over(Window.partitionBy("entity_id", *keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1))
        each = each.select("entity_id", *keys, "_seg", F.coalesce(earlier, F.lit(0)).alias("_earlier"))
        inside = F.count(F.lit(1)).over(before("entity_id", "_seg", *keys))
        moves = moves.withColumn(name, inside).join(each, ["entity_id", "_seg", *keys], "left").withColumn(name, F.when(F.col("prev").isNotNull(), F.col(name) + F.col("_earlier"))).drop("_earlier")
    return moves


COUNTED = ["event_id", "entity_id", "entity_type", "cur", "prev", "entity_edge", "entity_node"]


def population_counts(moves: DataFrame, order: str = "entity", carry: tuple[str, ...] = (), dealt: int | None = None, stored: bool = False) -> DataFrame:
    """moves with the population's counts before each event: pop_edge, pop_node; for an entity's first event also the
    resource's count, the total and the number of different resources with the current one. order is `entity` (all
    events of lower entities first) or `time`. The columns carry come along. stored: moves is a written table; dealt: it
    is dealt already, and its _bucket, below that number, ascends with the order."""
    by = ("entity_id", "timestamp", "event_id") if order == "entity" else ("timestamp", "event_id")
    counts = counted_before(moves, by, dealt, stored)
    started = F.col("prev").isNull()
    pick = lambda c, when: F.when(when, F.col(c)).alias(c)
    different = F.when(started, F.col("different") + (F.col("resource_count") == 0).cast("long")).alias("different")
    return counts.select(*COUNTED, *carry, *[pick(c, ~started) for c in ("pop_edge", "pop_node")], *[pick(c, started) for c in ("resource_count", "total")], different)


def carried(cut: DataFrame, keys: tuple[str, ...], n: Column, out: str) -> DataFrame:
    """For each bucket of cut and keys met in it: the sum of n over lower buckets."""
    each = cut.groupBy("_bucket", *keys).agg(F.sum(n).alias("_n"))
    lower = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return each.select("_bucket", *keys, F.sum("_n").over(lower).alias(out)).where(F.col(out) > 0)


def counted_before(moves: DataFrame, by: tuple[str, ...], dealt: int | None = None, stored: bool = False) -> DataFrame:
    """moves with resource_count, total, different, pop_node and pop_edge over all earlier events of the order by.

    Events are dealt once by ranges of the order. What lower buckets counted comes into a bucket as rows in front of its
    own, so each count is one running sum inside a bucket: nothing is joined, no key is one task, null keys count too."""
    moves = moves if stored else written(moves, "moves")
    buckets = -(-moves.count() // ROWS) if dealt is None else dealt
    keys, kind = ("entity_type", "prev", "cur"), ("entity_type",)
    one, linked = F.lit(1), F.col("prev").isNotNull().cast("int")
    counted = {"_one": one, "_each": one, "_node": linked, "_edge": linked}
    if buckets <= 1:
        rows = moves.withColumns({"_bucket": F.lit(0), "_own": F.lit(True), "_fresh": F.lit(0), **counted})
    else:
        cut = moves if dealt is not None else written(moves.repartitionByRange(buckets, *by).withColumn("_bucket", F.spark_partition_id()), "dealt")
        fresh = cut.groupBy("entity_type", "cur").agg(F.min("_bucket").alias("_bucket")).withColumn("_n", F.lit(1))
        fresh = fresh.select("_bucket", "entity_type", "_n").unionByName(cut.select("_bucket", "entity_type", F.lit(0).alias("_n")))
        before = [
            carried(cut, kind, one, "_one"), carried(fresh, kind, F.col("_n"), "_fresh"), carried(cut, ("entity_type", "cur"), one, "_each"),
            carried(cut.where("prev is not null"), ("entity_type", "prev"), one, "_node"), carried(cut.where("prev is not null"), keys, one, "_edge"),
        ]
        rows = cut.withColumns({"_own": F.lit(True), "_fresh": F.lit(0), **counted})
        for b in before:
            rows = rows.unionByName(b.withColumn("_own", F.lit(False)), allowMissingColumns=True)
        rows = rows.repartition(buckets, "_bucket")

    def upto(c: str, *keys: str) -> Column:
        return F.coalesce(F.sum(c).over(Window.partitionBy("_bucket", *keys).orderBy("_own", *by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    rows = rows.withColumn("resource_count", upto("_each", "entity_type", "cur"))
    rows = rows.withColumn("_fresh", F.when(F.col("_own"), (F.col("resource_count") == 0).cast("long")).otherwise(F.col("_fresh")))
    rows = rows.withColumns({"total": upto("_one", *kind), "different": upto("_fresh", *kind)})
    rows = rows.withColumn("pop_node", upto("_node", "entity_type", "prev")).withColumn("pop_edge", upto("_edge", *keys))
    return rows.where("_own")


def neg_log_prob() -> Column:
    """Of population_counts' columns: how unlikely the event's resource is after the one before it."""
    p = F.when(F.col("prev").isNull(), marginal_probability(F.col("resource_count"), F.col("total"), F.col("different"))).otherwise(transition_probability(F.col("entity_edge"), F.col("entity_node"), F.col("pop_edge"), F.col("pop_node")))
    return F.round(-F.ln(F.greatest(p, F.lit(1e-9))), 9) + 0.0


def transition_scores(df: DataFrame, pop_order: str = "entity") -> DataFrame:
    """event_id, prev_resource, seq_neg_log_prob, and its percentile rank over the log, seq_transition_score."""
    c = population_counts(entity_transitions(df), pop_order)
    out = c.select("event_id", F.col("prev").alias("prev_resource"), neg_log_prob().alias("seq_neg_log_prob"))
    return percent_ranks(written(out, "transitions"), "seq_neg_log_prob", "seq_transition_score").select("event_id", "prev_resource", "seq_neg_log_prob", "seq_transition_score")


def mean_score_by_label(scores: DataFrame, df: DataFrame) -> DataFrame:
    return scores.join(df.select("event_id", "label"), "event_id").groupBy("label").agg(F.avg("seq_transition_score").alias("mean_score")).orderBy(F.desc("mean_score"))


def transition_graph(df: DataFrame, level: str = "entity") -> DataFrame:
    """Edge list with counts, per entity or per entity_type."""
    keys = ["entity_type", "entity_id"] if level == "entity" else ["entity_type"]
    return entity_transitions(df).where("prev is not null").groupBy(*keys, "prev", "cur").agg(F.count("*").alias("n"))
