"""Windows over keys with very many rows: pieces of bounded size, with what they need of the rows before them.

A key with more than ROWS rows is hot. Its rows are dealt by ranges of (key, timestamp, event_id) to pieces of about ROWS,
so each piece is a stretch of one key's time. A window over a piece needs two things from before it: the last few rows
(its halo: copied into the piece, marked, and dropped after the window) and sums over all earlier pieces (carried:
running totals over one row for each piece). Keys with fewer rows stay whole and take part in none of this.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.shared import written

#: One task takes about so many rows of a key at most.
ROWS = 200_000
ORDER = ("timestamp", "event_id")
#: More rows than this, one for each piece or hot key, are not broadcast.
BROADCAST_ROWS = 100_000


def few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def split(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary keys, rows of hot keys: None if there are none)."""
    hot = written(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > ROWS), "hot-keys")
    if hot.isEmpty():
        return df, None
    df, hot = written(df, "split"), few(hot.select(key))  # both parts are read on, so what df derives is derived once
    return df.join(hot, key, "left_anti"), df.join(hot, key, "left_semi")


def pieces(df: DataFrame, key: str) -> DataFrame:
    """df (rows of hot keys), written, with _seg: within a key, later rows are in the same or a higher piece."""
    df = written(df, "hot-rows")
    n = max(1, -(-df.count() // ROWS))
    return written(df.repartitionByRange(n, key, *ORDER).withColumn("_seg", F.spark_partition_id()), "pieces")


def in_piece(key: str, *more: str) -> WindowSpec:
    return Window.partitionBy(key, "_seg", *more).orderBy(*ORDER)


def with_halo(cut: DataFrame, key: str, last: int) -> DataFrame:
    """cut (written pieces) with _halo: false in its own rows, true in copies of the `last` rows of the key before a piece.
    Pieces may hold fewer rows than that: a halo then reaches back over several."""
    back = F.row_number().over(Window.partitionBy(key, "_seg").orderBy(*[F.desc(c) for c in ORDER]))
    tails = cut.withColumn("_back", back).where(F.col("_back") <= last)
    row = F.struct(*[c for c in cut.columns if c not in (key, "_seg")])
    by = Window.partitionBy(key).orderBy("_seg", *ORDER)
    first = F.row_number().over(Window.partitionBy(key, "_seg").orderBy(*ORDER)) == 1
    starts = tails.withColumns({"_rows": F.collect_list(row).over(by.rowsBetween(-last, -1)), "_first": first}).where("_first")
    halo = starts.select(key, "_seg", F.explode("_rows").alias("_r")).select(key, "_seg", "_r.*", F.lit(True).alias("_halo"))
    return cut.withColumn("_halo", F.lit(False)).unionByName(halo)


def carried(cut: DataFrame, key: str, sums: dict[str, Column]) -> DataFrame:
    """One row for each piece but a key's first: the sums over all earlier pieces of its key."""
    by = Window.partitionBy(key).orderBy("_seg")
    each = cut.groupBy(key, "_seg").agg(*[c.alias(f"_own_{name}") for name, c in sums.items()])
    before = each.select(key, "_seg", *[F.sum(f"_own_{name}").over(by.rowsBetween(Window.unboundedPreceding, -1)).alias(name) for name in sums], F.row_number().over(by).alias("_k"))
    return before.where("_k > 1").drop("_k")


def moments(cut: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """One row for each piece but a key's first: rows before it (_rows), and for each column, by its short name, the number
    of its values before (_n_), their mean (_m_) and sum of squared differences from it (_q_).

    Pieces are merged by Chan's rule around the key's own mean, so that nothing large is subtracted from something large."""
    by = Window.partitionBy(key)
    stats = [F.count("*").alias("_own_rows")]
    for name, c in columns.items():
        stats += [F.count(c).alias(f"_n{name}"), F.avg(c).alias(f"_a{name}"), (F.var_pop(c) * F.count(c)).alias(f"_v{name}")]
    each = cut.groupBy(key, "_seg").agg(*stats)
    for name in columns:
        n, mean = F.col(f"_n{name}"), F.col(f"_a{name}")
        each = each.withColumn(f"_c{name}", F.sum(n * mean).over(by) / F.sum(n).over(by))
    upto = by.orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    out = [key, "_seg", F.sum("_own_rows").over(upto).alias("_rows"), F.row_number().over(by.orderBy("_seg")).alias("_k")]
    for name in columns:
        n, centre = F.col(f"_n{name}"), F.col(f"_c{name}")
        off = F.coalesce(F.col(f"_a{name}") - centre, F.lit(0.0))
        total, shift = F.sum(n).over(upto), F.sum(n * off).over(upto)
        spread = F.sum(F.coalesce(F.col(f"_v{name}"), F.lit(0.0)) + n * off * off).over(upto)
        out += [total.alias(f"_n_{name}"), (centre + shift / total).alias(f"_m_{name}"), (spread - shift * shift / total).alias(f"_q_{name}")]
    return each.select(*out).where("_k > 1").drop("_k")


def merged_moments(name: str, n: Column, mean: Column, q: Column) -> tuple[Column, Column]:
    """(mean, population standard deviation) of the values carried under name together with n values of that mean and sum of
    squared differences; null for no values."""
    n0, zero = F.coalesce(F.col(f"_n_{name}"), F.lit(0)), F.lit(0.0)
    m0, q0 = F.coalesce(F.col(f"_m_{name}"), mean), F.coalesce(F.col(f"_q_{name}"), zero)
    mean, q, total = F.coalesce(mean, m0), F.coalesce(q, zero), n0 + n
    delta = mean - m0
    both = q0 + q + delta * delta * n0 * n / total
    return F.when(total > 0, m0 + delta * n / total), F.when(total > 0, F.sqrt(F.greatest(both, zero) / total))


def firsts(cut: DataFrame, key: str, *what: str) -> DataFrame:
    """event_id of the first row of each different (key, what): minima, so no window holds a key."""
    return cut.groupBy(key, *what).agg(F.min(F.struct(*ORDER)).alias("_first")).select(F.col("_first.event_id").alias("event_id"))
