"""URL filters (operator 7): host and path rules, and logistic regression on hashed character n-grams.

Everything is DataFrame functions: a url's features are the different hashed n-grams of host and path (kept apart), a
weight vector of fixed length and an intercept are fitted by a fixed number of full-batch steps over a small labelled
table, each one aggregate; a url's score is the sum of its slots' weights, which go along as one literal.

Defined cases: null urls and urls without `://` have empty host and path, fit no rule and are judged by the intercept
and no n-grams; a labelled table without rows, or with one verdict only, gives weights of 0 and an intercept for that
verdict (allow if empty); a probability of exactly 0.5 is block; of rules that fit the longest wins; a url of any length
is judged whole; repeated rows are judged each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, scratch, stash

#: Verdict by rule, host and path joined.
RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}

SLOTS = 4096
GRAMS = (3, 4)
STEPS = 24
#: Weight of the squared weights in the loss.
DECAY = 0.01
#: At most about so many different urls make the labelled table.
LABELLED = 2000


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty where it is null or has no ://."""
    after = F.when(F.coalesce(F.locate("://", url), F.lit(0)) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise(F.lit(""))
    host = lower_ascii(F.regexp_extract(after, r"^[^/?#]*", 0))
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_of(host: Column, path: Column, rules: dict[str, str] = RULES) -> Column:
    """The longest rule that fits host and path, or null."""
    fits = []
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        h, slash, p = rule.partition("/")
        fits.append(F.when(((host == h) | host.endswith("." + h)) & path.startswith(slash + p), F.lit(rule)))
    return F.coalesce(*fits)


def slots(host: Column, path: Column, n_slots: int = SLOTS) -> Column:
    """The different slots of the character n-grams of host and path, each with a mark at both ends."""

    def grams(text: Column, mark: str, n: int) -> Column:
        marked = F.concat(F.lit("^"), text, F.lit("$"))
        starts = F.when(F.length(text) + 2 >= n, F.sequence(F.lit(1), F.length(text) + 3 - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(mark), F.substring(marked, i, F.lit(n))), F.lit(n_slots)).cast("int"))

    parts = [grams(text, mark, n) for text, mark in ((host, "h"), (path, "p")) for n in GRAMS]
    return F.array_distinct(F.concat(*parts))


def margin(s: Column, weights: list[float], intercept: float) -> Column:
    """The log odds of block of the slots s; the weights go along as one literal."""
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    return F.aggregate(s, F.lit(0.0), lambda a, k: a + F.element_at(table, k + 1)) / root(s) + intercept


def root(s: Column) -> Column:
    return F.sqrt(F.greatest(F.size(s), F.lit(1)))


def fit(labelled: DataFrame, steps: int = STEPS) -> tuple[list[float], float]:
    """The weights of all slots (0 for those not met) and the intercept of P(block), from (url, blocked 0/1).

    Every step is one aggregate over the labelled urls, of which SLOTS + 1 numbers at most come to the driver: a gradient
    step from an extrapolated point (Nesterov's), scaled for each slot by a bound of the curvature there, so it cannot
    overshoot. The intercept is slot -1 and is fitted along."""
    host, path = split_url(F.col("url"))
    rows = labelled.where("blocked is not null").select(F.col("blocked").cast("double").alias("y"), slots(host, path).alias("s"))
    rows = stash(rows, "labelled-urls")
    n, blocked = rows.agg(F.count("*"), F.sum("y")).first()
    start = log((blocked + 0.5) / (n - blocked + 0.5)) if n else -1.0
    if not n or blocked in (0, n):
        return [0.0] * SLOTS, start

    def sums(value: Column) -> dict[int, float]:
        """The sum of value times the slot's own part, by slot."""
        x = rows.select(value.alias("e"), root(F.col("s")).alias("r"), F.explode(F.concat("s", F.array(F.lit(-1)))).alias("slot"))
        part = F.when(F.col("slot") < 0, 1.0).otherwise(1 / F.col("r"))
        return dict(map(tuple, x.groupBy("slot").agg(F.sum(F.col("e") * part)).collect()))

    bound = sums((root(F.col("s")) + 1) / 4)
    now = dict.fromkeys(bound, 0.0) | {-1: start}
    last = now
    for k in range(steps):
        ahead = {j: w + k / (k + 3) * (w - last[j]) for j, w in now.items()}
        z = margin(F.col("s"), [ahead.get(j, 0.0) for j in range(SLOTS)], ahead[-1])
        gradient = sums(F.col("y") - 1 / (1 + F.exp(-z)))
        decay = dict.fromkeys(ahead, DECAY) | {-1: 0.0}
        now, last = {j: w + (gradient[j] - decay[j] * w) / (bound[j] + decay[j]) for j, w in ahead.items()}, now
    return [now.get(j, 0.0) for j in range(SLOTS)], now[-1]


def decided(pages: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """(url, blocked 0/1), the different urls of pages that a rule decides."""
    host, path = split_url(F.col("url"))
    verdict = F.create_map(*[F.lit(x) for kv in rules.items() for x in kv])
    out = pages.select("url", rule_of(host, path, rules).alias("rule")).where("rule is not null")
    return out.select("url", (F.element_at(verdict, F.col("rule")) == "block").cast("int").alias("blocked")).distinct()


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules: dict[str, str] = RULES) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, and the model's probability of block.

    labelled holds (url, blocked). If it is not given, about LABELLED of the different urls that a rule decides, chosen by
    their hash, serve as labelled table, with the rule's verdict as label."""
    host, path = split_url(F.col("url"))
    out = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"))
    out = out.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by_rule = reduce(lambda c, r: F.when(F.col("rule") == r, F.lit(rules[r])).otherwise(c), rules, F.lit(None).cast("string"))
    with scratch(pages.sparkSession):
        if labelled is None:
            every = stash(decided(pages, rules), "decided-urls")
            share = min(1.0, LABELLED / max(1, every.count()))
            labelled = every.where(F.pmod(F.xxhash64("url", F.lit(3)), F.lit(1 << 20)) < share * (1 << 20))
        weights, intercept = fit(labelled)
    out = out.withColumn("s", slots(F.col("host"), F.col("path")))
    p = 1 / (1 + F.exp(-margin(F.col("s"), weights, intercept)))
    verdict = F.coalesce(by_rule, F.when(p >= 0.5, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), p.alias("p_block"))
