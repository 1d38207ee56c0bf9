"""Evaluation of risk scores and predicted categories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .ranking import average_ranks, exact_quantile, running_totals


def positive() -> Column:
    return F.when(F.col("label") != "normal", 1).otherwise(0)


def flag_at_percentile(scored: DataFrame, pct: float = 95) -> DataFrame:
    """scored with the linear percentile of risk_score as threshold_value, and flagged = at or over it."""
    bar = exact_quantile(scored.select("risk_score"), "risk_score", pct / 100, "threshold_value")
    return scored.crossJoin(F.broadcast(bar)).withColumn("flagged", F.col("risk_score") >= F.col("threshold_value"))


def ratio(a, b):
    return F.when(b > 0, a / b).otherwise(0.0)


def evaluate_detection(scored: DataFrame, pct: float = 95) -> DataFrame:
    """One row: threshold, confusion counts, precision, recall, totals."""
    n = lambda flag, pos: F.coalesce(F.sum(((F.col("flagged") == flag) & (positive() == pos)).cast("long")), F.lit(0))
    c = flag_at_percentile(scored, pct).agg(F.max("threshold_value").alias("threshold_value"), n(False, 0).alias("tn"), n(True, 0).alias("fp"), n(False, 1).alias("fn"), n(True, 1).alias("tp"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(F.lit(int(pct)).alias("threshold_percentile"), "threshold_value", ratio(tp, tp + fp).alias("precision_at_threshold"), ratio(tp, tp + fn).alias("recall_at_threshold"), "tn", "fp", "fn", "tp",
                    (tp + fp).alias("n_flagged"), (tp + fn).alias("n_true_anomalies"), (tp + fp + fn + F.col("tn")).alias("n_total"))


def roc_auc(scored: DataFrame) -> DataFrame:
    """Rank-based, ties averaged."""
    pos = scored.groupBy("risk_score").agg(F.sum(positive()).alias("p"))
    j = pos.join(average_ranks(scored, "risk_score").drop("n"), "risk_score").agg(F.sum(F.col("p") * F.col("rank")).alias("s"), F.sum("p").alias("p"), F.max("total").alias("n"))
    p, n = F.col("p"), F.col("n") - F.col("p")
    return j.select(((F.col("s") - p * (p + 1) / 2) / (p * n)).alias("roc_auc"))


def average_precision(scored: DataFrame) -> DataFrame:
    """Sum of precision times the step in recall over the different thresholds, highest first."""
    by = written(scored.where("risk_score is not null").groupBy("risk_score").agg(F.count("*").alias("n"), F.sum(positive()).alias("p")), "scores")
    run = running_totals(by, "risk_score", "n", "p", descending=True)
    precision = (F.col("before_p") + F.col("p")) / (F.col("before_n") + F.col("n"))
    return run.agg((F.sum(precision * F.col("p")) / F.sum("p")).alias("average_precision"))


def classification_report(pred: DataFrame) -> DataFrame:
    """class, precision, recall, f1, support: one row per class, then accuracy, macro avg and weighted avg."""
    pairs = pred.groupBy("label", "predicted_category").agg(F.count("*").alias("n"))
    side = lambda c, out: pairs.groupBy(F.col(c).alias("class")).agg(F.sum("n").alias(out))
    hits = pairs.where("label = predicted_category").select(F.col("label").alias("class"), F.col("n").alias("tp"))
    c = side("label", "support").join(side("predicted_category", "made"), "class", "full").join(hits, "class", "left").na.fill(0)
    c = c.withColumns({"precision": ratio(F.col("tp"), F.col("made")), "recall": ratio(F.col("tp"), F.col("support"))})
    c = c.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    names, total = ("precision", "recall", "f1"), F.sum("support")
    rows = [c.select("class", *names, F.col("support").cast("double").alias("support"))]
    accuracy = F.sum("tp") / total
    rows.append(c.agg(*[accuracy.alias(x) for x in names], total.cast("double").alias("support")).select(F.lit("accuracy").alias("class"), *names, "support"))
    rows.append(c.agg(*[F.avg(x).alias(x) for x in names], total.cast("double").alias("support")).select(F.lit("macro avg").alias("class"), *names, "support"))
    rows.append(c.agg(*[(F.sum(F.col(x) * F.col("support")) / total).alias(x) for x in names], total.cast("double").alias("support")).select(F.lit("weighted avg").alias("class"), *names, "support"))
    return reduce(DataFrame.unionByName, rows)
