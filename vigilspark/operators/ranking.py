"""Global ranks, running totals and exact quantiles without a one-task window.

Rows are dealt by ranges of their values to buckets of about ROWS, summed inside each bucket by a window and shifted by
the totals of the buckets before. The number of buckets follows the number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

ROWS = 200_000
#: Tables of values up to so many rows of a few numbers are broadcast.
BROADCAST_ROWS = 1_000_000
#: A value is hot if it has more than one in so many of the rows; hence there are fewer hot values than that.
HOT_SHARE = 1000


def running_totals(values: DataFrame, value: str, *sums: str, descending: bool = False, by: tuple[str, ...] = (), rows: int | None = None) -> DataFrame:
    """values with, for each column of sums, before_<column>: its sum over lower (descending: higher) values, among rows
    that share the columns by. values is a written table, as it is read several times, unless rows, their number, is
    given; its values differ within by."""
    order = F.desc(value) if descending else F.asc(value)
    earlier = lambda *keys: Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    frame = (Window.unboundedPreceding, -1)
    buckets = -(-(values.count() if rows is None else rows) // ROWS)
    if buckets <= 1:
        w = earlier(*by).orderBy(order).rowsBetween(*frame)
        return values.select("*", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"before_{c}") for c in sums])
    cut = written(values.repartitionByRange(buckets, *by, order).withColumn("_bucket", F.spark_partition_id()), "buckets")
    totals = cut.groupBy(*by, "_bucket").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    over = earlier(*by).orderBy("_bucket").rowsBetween(*frame)
    shifts = totals.select(*[F.col(c).alias(f"_k_{c}") for c in (*by, "_bucket")], *[F.coalesce(F.sum(f"_t_{c}").over(over), F.lit(0)).alias(f"_s_{c}") for c in sums])
    w = Window.partitionBy("_bucket", *by).orderBy(order).rowsBetween(*frame)
    same = F.col("_bucket") == F.col("_k__bucket")
    for c in by:  # rows with a null key are a group too
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    out = cut.join(shifts if by else F.broadcast(shifts), same)
    return out.select(*values.columns, *[(F.coalesce(F.sum(c).over(w), F.lit(0)) + F.col(f"_s_{c}")).alias(f"before_{c}") for c in sums])


def totals_by(rows: DataFrame, order: str, *steps: tuple[tuple[str, ...], dict[str, str]]) -> DataFrame:
    """rows (written) with several running totals: each step names the columns by, and for each column summed the name of
    its total. Few rows pass all steps in one job; of many, each step is written and dealt by ranges."""
    n = rows.count()
    for k, (by, names) in enumerate(steps):
        rows = written(rows, "totals") if k and n > ROWS else rows
        rows = running_totals(rows, order, *names, by=by, rows=n).withColumnsRenamed({f"before_{c}": out for c, out in names.items()})
    return rows


def counted(df: DataFrame, value: str) -> DataFrame:
    return written(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n")), "counts")


def average_ranks(df: DataFrame, value: str) -> DataFrame:
    """(value, n, rank, total): average rank of each different non-null value, ties sharing theirs, and the row count."""
    counts = counted(df, value)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    ranked = running_totals(counts, value, "n").select(value, "n", (F.col("before_n") + (F.col("n") + 1) / 2).alias("rank"))
    return ranked.crossJoin(F.broadcast(total))


def percent_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """df (a written table) with out = 100 * average rank / rows, to 2 decimals half-even on the float; null for nulls.

    Few values are broadcast. Of many, those that fill whole tasks are, and the others are shuffled; rows that need no
    second look then go to any task."""
    ranks = written(average_ranks(df, value).select(F.col(value).alias("_v"), "n", "total", (F.rint(F.col("rank") / F.col("total") * 100 * 100) / 100).alias(out)), "ranks")
    if ranks.count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(ranks.select("_v", out)), F.col(value) == F.col("_v"), "left").drop("_v")
    hot = F.col("n") > F.col("total") / HOT_SHARE
    met = df.join(F.broadcast(ranks.where(hot).select(F.col("_v").alias("_h"), F.col(out).alias("_hot"))), F.col(value) == F.col("_h"), "left")
    met = met.withColumn("_spread", F.when(F.col("_hot").isNull() & F.col(value).isNotNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*df.columns), F.lit(100_000)).cast("int")))
    rest = ranks.where(~hot).select("_v", out, F.lit(0).alias("_zero"))
    found = met.join(rest, (F.col(value) == F.col("_v")) & (F.col("_spread") == F.col("_zero")), "left")
    return found.withColumn(out, F.coalesce("_hot", out)).select(*df.columns, out)


def exact_quantile(df: DataFrame, value: str, q: float, out: str = "quantile") -> DataFrame:
    """One row: the linearly interpolated quantile of the non-null values (null if there are none)."""
    counts = counted(df, value)
    total = counts.agg(F.sum("n").alias("total"))
    placed = running_totals(counts, value, "n").crossJoin(F.broadcast(total)).withColumn("at", q * (F.col("total") - 1))
    pick = lambda k: F.min(F.when((F.col("before_n") <= k) & (k < F.col("before_n") + F.col("n")), F.col(value)))
    ends = placed.agg(pick(F.floor("at")).alias("lo"), pick(F.ceil("at")).alias("hi"), F.max("at").alias("at"))
    return ends.select((F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("at") - F.floor("at"))).alias(out))
