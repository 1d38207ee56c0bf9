"""Language identification with language-bitmask n-gram filters (operator 3).

A bit-sliced Bloom filter holds one word of language bits per slot: ANDing the words at an n-gram's slots returns, at
once, every language that contains the n-gram. A text's language is the one whose bit is set for most of the text's
n-grams, after each count is corrected for that language's own false positives (its share of set slots to the power
of the number of hash functions).

Training: a bounded sample of labelled rows (at most about `sample` documents per language, chosen by a hash of the
id); n-grams are counted by Spark over the sampled texts, and an n-gram belongs to a language if its share there is at
least `rate` and at least `contrast` times its highest share in any language. So a language has at most 1 / rate
n-grams of each length, and the filter has a fixed size; both are small enough for the driver and for a broadcast.

Defined cases: null text or text without a letter is `und` with score 0; letters but no known n-gram: the language
with the most training rows, score 0; without any training row everything is `und`; null ids are neither learned from
nor held out; ties go to the first language in alphabetical order; a text of any length is judged whole; repeated rows
are judged each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, lean, row_key, stash
from .near_dedup import mixed

ORDERS = (2, 3, 4)
SLOTS = 1 << 18
FUNCTIONS = 3
SAMPLE = 3000
RATE = 2e-5
CONTRAST = 0.2

NOT_LETTERS = re.compile(r"[\W\d_]+")


def grams(text: str) -> tuple[np.ndarray, ...]:
    """Hashes of all character n-grams of the text's letters in lower case, words apart by one space; per length."""
    clean = NOT_LETTERS.sub(" ", text.lower()).strip()
    if not any(map(str.isalpha, clean)):  # such as ½, which is a word character but no letter
        return ()
    c = np.frombuffer(f" {clean} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    h, out = c, []
    for n in range(2, max(ORDERS) + 1):
        h = h[: len(c) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :]
        if n in ORDERS:
            out.append(mixed(h + np.uint64(n)))
    return tuple(out)


def remainder(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4, F.lit(-1))


class Filter:
    """The bit-sliced Bloom filter; words of 64 languages each."""

    def __init__(self, langs: list[str], table: pd.DataFrame, fallback: str | None):
        self.langs, self.fallback, width = langs, fallback, max(1, -(-len(langs) // 64))
        self.kind = np.uint8 if len(langs) <= 8 else np.uint64
        self.words = np.zeros((width, SLOTS), self.kind)
        number = {x: k for k, x in enumerate(langs)}
        for lang, part in table.groupby("lang"):
            k = number[lang]
            for slots in self.slots(part["gram"].to_numpy(np.int64).view(np.uint64)):
                self.words[k // 64, slots] |= self.kind(1 << (k % 64))
        share = np.array([((self.words[k // 64] >> self.kind(k % 64)) & self.kind(1)).mean() for k in range(len(langs))])
        self.false = share**FUNCTIONS

    @staticmethod
    def slots(h: np.ndarray):
        for k in range(FUNCTIONS):
            yield ((h >> np.uint64(20 * k)) & np.uint64(SLOTS - 1)).astype(np.int32)

    def shares(self, text: str | None) -> np.ndarray | None:
        """The corrected share of the text's n-grams that each language has; None without a letter or a language."""
        found = grams(text) if text and self.langs else ()
        if not found:
            return None
        h = np.concatenate(found)
        hits = np.zeros(len(self.langs))
        for w, row in enumerate(self.words):
            first, *rest = (row[s] for s in self.slots(h))
            mask = first
            for m in rest:
                mask = mask & m
            if self.kind is np.uint8:
                sets = np.bincount(mask, minlength=256)
                hits[:] = [sets[BITS[k]].sum() for k in range(len(hits))]
            else:
                for k in range(w * 64, min(len(hits), w * 64 + 64)):
                    hits[k] = ((mask >> np.uint64(k % 64)) & np.uint64(1)).sum()
        return np.maximum(hits / len(h) - self.false, 0) / np.maximum(1 - self.false, 1e-9)

    def decide(self, text: str | None) -> tuple[str, float]:
        true = self.shares(text)
        if true is None:
            return "und", 0.0
        if not true.any():
            return self.fallback, 0.0
        return self.langs[int(true.argmax())], float(true.max() / true.sum())

    def known(self, text: str | None) -> float | None:
        """The share of the language that has most of the text's n-grams; None for a text without a letter, and 1 where
        no n-gram of any language was learned."""
        if not self.words.any():
            return 1.0 if text and grams(text) else None
        true = self.shares(text)
        return None if true is None else float(true.max())


BITS = [np.flatnonzero(np.arange(256) >> k & 1) for k in range(8)]


def train(docs: DataFrame, sample: int = SAMPLE, rate: float = RATE, contrast: float = CONTRAST) -> Filter:
    """Learn from text and lang of the rows that are not held out."""
    rows = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & remainder().isin(0, 1, 3))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Filter([], pd.DataFrame({"lang": [], "gram": []}), None)
    bar = F.lit(0.0)
    for lang, n in sorted(sizes.items()):
        bar = F.when(F.col("lang") == lang, min(1.0, sample / n)).otherwise(bar)
    chosen = rows.withColumn("row", row_key()).where(F.pmod("row", F.lit(1 << 20)) < bar * (1 << 20)).where("text is not null")

    def count(batches):
        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                for n, arrays in zip(ORDERS, zip(*(g for g in map(grams, part["text"]) if g)), strict=False):
                    gram, times = np.unique(np.concatenate(arrays), return_counts=True)
                    yield pd.DataFrame({"lang": lang, "n": n, "gram": gram.view(np.int64), "times": times})

    counted = chosen.select("text", "lang").mapInPandas(lean(count), "lang string, n int, gram long, times long")
    counted = stash(counted.groupBy("lang", "n", "gram").agg(F.sum("times").alias("times")), "grams")
    totals = counted.groupBy("lang", "n").agg(F.sum("times").alias("total"))
    shares = counted.join(F.broadcast(totals), ["lang", "n"]).select("lang", "n", "gram", (F.col("times") / F.col("total")).alias("share")).where(F.col("share") >= rate)
    top = shares.groupBy("gram").agg(F.max("share").alias("top"))
    table = shares.join(top, "gram").where(F.col("share") >= contrast * F.col("top")).select("lang", "gram").toPandas()
    return Filter(sorted(sizes), table, max(sorted(sizes), key=sizes.__getitem__))


def identify(docs: DataFrame, model: Filter, *keep: Column) -> DataFrame:
    """The columns `keep` of docs, and lang_pred and score of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def judge(text: pd.Series) -> pd.DataFrame:
        m = shared.value
        return pd.DataFrame([m.decide(t) for t in text], columns=["lang_pred", "score"])

    out = in_small_batches(docs).select(*keep, judge(F.col("text")).alias("_judged"))
    return out.select(*[c for c in out.columns if c != "_judged"], "_judged.lang_pred", "_judged.score")


def predictions(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score; learned from the rows that are not held out."""
    return identify(docs, train(docs), F.col("doc_id").cast("long").alias("doc_id"), (remainder() == 2).alias("held_out"))


def with_known(docs: DataFrame, model: Filter, *keep: Column) -> DataFrame:
    """The columns `keep` of docs, and _known: the share of each text's n-grams that its best language has (Filter.known)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def known(text: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series([m.known(t) for t in text], dtype="float64")

    return in_small_batches(docs).select(*keep, known(F.col("text")).alias("_known"))


def least_known(docs: DataFrame, model: Filter) -> float:
    """The share of known n-grams below which a text is in no learned language: half of the median of the labelled rows that
    were not learned from, but no more than what 99 of 100 of them reach (so of a few rows, the least). All of them count;
    where no row was held out, the learned ones do."""
    rows = docs.where(F.col("lang").cast("string").isin(model.langs) & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    for part in (rows.where(remainder() == 2), rows):
        middle, low = with_known(part, model).where("_known > 0").agg(F.percentile_approx("_known", 0.5, 100000), F.percentile_approx("_known", 0.01, 100000)).first()
        if middle is not None:
            return min(middle / 2, low)
    return 0.0
