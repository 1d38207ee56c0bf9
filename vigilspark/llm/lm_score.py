"""Cross-entropy difference scoring (operator 9).

Tokens are characters; n-grams of 1 to 4 tokens of both models share one vocabulary, the n-grams of all documents. The
target model counts the documents labelled good, the background model counts all documents; the background is matched to
the target's mass, so both are smoothed alike. Each order is smoothed towards the next shorter one, and single characters towards even shares of the vocabulary, so
either model's probabilities of what follows a context add up to 1. A document's score
is the mean over its tokens of -log p_target + log p_background: the lower, the more like the target.

N-grams are told apart by their characters, never by a hash, and their counts are Spark tables. As every token ends just
one 4-gram, a table of 4-grams has it all: shorter n-grams and contexts are its sums. Each task turns its documents, a
batch at a time, into one row per batch and 4-gram that holds which documents of the batch have it and how often. These
rows are counted for the models, then joined to the 4-grams' log probabilities and grouped by batch, where the sums of
the documents are taken. A 4-gram that every document has is one row per batch, so no key is hot.

Defined cases: null or empty text has no tokens and null scores; without a target row both models are the background
and all differences are 0; repeated rows count and are scored each; null ids have no label; labels that repeat count
once; a text of any length is scored whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, scratch, small, stash

ORDER = 4
#: Fills the early contexts; not a character.
START = 0x110000
#: Weight of the shorter context's estimate, in counts.
PRIOR = 4.0
#: Each character of the shared vocabulary counts as seen so often more.
FLOOR = 0.1
#: The n-gram of no tokens, counted once a token.
SLOTS = b""
#: Documents and characters of a batch.
DOCS, CHARACTERS = 3000, 8_000_000
#: The largest count of an entry.
MOST = 255

ROWS = "batch string, gram binary, good long, total long, who binary, times binary, ids array<long>"


def characters(text: str) -> np.ndarray:
    return np.concatenate([np.full(ORDER - 1, START, "<u4"), np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")])


def slots(text: str) -> list[list[bytes]]:
    """For each order 1..ORDER the n-gram that ends at each token."""
    c = characters(text)
    return [[c[at - k : at + 1].tobytes() for at in range(ORDER - 1, len(c))] for k in range(ORDER)]


def keys(c: np.ndarray) -> np.ndarray:
    """A number for the ORDER characters from each place of c on; equal exactly for equal characters."""
    seen = np.zeros(START + 1, bool)
    seen[c] = True
    if np.count_nonzero(seen) <= 1 << 16:
        code = (np.cumsum(seen) - 1)[c].astype(np.uint64)
        return code[:-3] << np.uint64(48) | code[1:-2] << np.uint64(32) | code[2:-1] << np.uint64(16) | code[3:]
    c = c.astype(np.uint64)
    pair = np.unique(c[:-1] << np.uint64(21) | c[1:], return_inverse=True)[1].astype(np.uint64)
    return pair[:-2] << np.uint64(32) | pair[2:]


def batch_grams(texts: list[str], target: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, list[bytes], list[bytes]]:
    """The 4-grams of the texts: their characters, their counts in target texts and in all, and for each the numbers
    (uint16) of the texts that have it and how often (uint8; more than MOST in several entries)."""
    c = [characters(t) for t in texts]
    ends = np.cumsum([len(x) for x in c])
    c = np.concatenate(c)
    key, own, place, times = keys(c), [], [], []
    for k, end in enumerate(ends):
        start = end - len(texts[k]) - (ORDER - 1)
        _, first, n = np.unique(key[start : end - (ORDER - 1)], return_index=True, return_counts=True)
        own.append(np.full(len(n), k, np.int32))
        place.append(first + start)
        times.append(n.astype(np.int32))
    own, place, times = np.concatenate(own), np.concatenate(place), np.concatenate(times)
    order = np.argsort(key[place], kind="stable")
    own, place, times = own[order], place[order], times[order]
    parts = -(-times // MOST)
    if parts.max() > 1:  # a count that fits no byte is entered in parts
        last, left = np.cumsum(parts) - 1, times - MOST * (parts - 1)
        own, place, times = np.repeat(own, parts), np.repeat(place, parts), np.full(parts.sum(), MOST, np.int32)
        times[last] = left
    cut = np.flatnonzero(np.diff(key[place], prepend=~key[place[:1]]))
    to = np.append(cut[1:], len(place))
    grams = c[place[cut][:, None] + np.arange(ORDER)].astype("<u4").tobytes()
    total = np.add.reduceat(times.astype(np.int64), cut)
    good = np.add.reduceat(times * target[own].astype(np.int64), cut)
    who, often = own.astype(np.uint16).tobytes(), times.astype(np.uint8).tobytes()
    spans = [*zip(cut.tolist(), to.tolist(), strict=True)]
    return [grams[k : k + 4 * ORDER] for k in range(0, len(grams), 4 * ORDER)], good, total, [who[2 * a : 2 * b] for a, b in spans], [often[a:b] for a, b in spans]


def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Arrow batches put together to batches of at most DOCS documents and, but for a longer text, CHARACTERS: the more
    documents a batch has, the fewer rows there are for each 4-gram."""
    held, n = [], 0
    for pdf in batches:
        lengths = pdf["text"].str.len().fillna(0).to_numpy(np.int64)
        start = 0
        for k in range(len(pdf)):
            if n and (n + lengths[k] > CHARACTERS or sum(map(len, held)) + k - start >= DOCS):
                yield pd.concat([*held, pdf.iloc[start:k]], ignore_index=True)
                held, n, start = [], 0, k
            n += int(lengths[k]) + 1
        held.append(pdf.iloc[start:])
    if held:
        yield pd.concat(held, ignore_index=True)


def grams_of(docs: DataFrame) -> DataFrame:
    """ROWS of (doc_id, text, target): per batch one row without gram, with the batch's ids, and one for each 4-gram."""

    def run(batches):
        for k, pdf in enumerate(joined(batches)):
            name = f"{TaskContext.get().partitionId()}-{k}"
            ids = [None if pd.isna(x) else int(x) for x in pdf["doc_id"].astype("Int64")]
            head = pd.DataFrame({"batch": [name], "gram": [None], "good": [0], "total": [0], "who": [None], "times": [None], "ids": [ids]})
            yield head
            at = np.flatnonzero([bool(t) for t in pdf["text"]])
            if not len(at):
                continue
            gram, good, total, who, times = batch_grams([pdf["text"].iloc[x] for x in at], pdf["target"].to_numpy(bool)[at])
            who = [at[np.frombuffer(w, np.uint16)].astype(np.uint16).tobytes() for w in who] if len(at) < len(pdf) else who
            for a in range(0, len(gram), 20_000):
                b = slice(a, a + 20_000)
                yield pd.DataFrame({"batch": name, "gram": gram[b], "good": good[b], "total": total[b], "who": who[b], "times": times[b], "ids": None})

    return docs.select("doc_id", "text", "target").mapInPandas(run, ROWS)


def shorter(table: DataFrame, start: int, length: int, *names: str) -> DataFrame:
    """Counts of the n-grams of `length` bytes from byte `start` of the table's on, as the columns names."""
    gram, good, total = names
    return table.groupBy(F.expr(f"substring(gram, {start + 1}, {length})").alias(gram)).agg(F.sum("good").alias(good), F.sum("total").alias(total))


def tables(rows: DataFrame) -> list[DataFrame]:
    """(gram, good, total) of the n-grams of each order 1..ORDER, over all documents."""
    longest = rows.where("gram is not null").groupBy("gram").agg(F.sum("good").alias("good"), F.sum("total").alias("total"))
    out = [stash(longest, "grams-4")]
    for k in range(ORDER - 1, 0, -1):
        out.insert(0, stash(shorter(out[0], 4, 4 * k, "gram", "good", "total"), f"grams-{k}"))
    return out


def probabilities(orders: list[DataFrame]) -> DataFrame:
    """(gram, lt, lb): -log of the target's and of the background's probability of each 4-gram's last token."""
    good, total = orders[0].agg(F.sum("good"), F.sum("total")).first()
    total, alphabet = total or 0, max(1, orders[0].count())
    match = (good or total) / max(1.0, total)
    sides = (("good" if good else "total", 1.0 if good else match, "pt"), ("total", match, "pb"))
    last = None
    for k, table in enumerate(orders):
        if last is None:
            p = [((F.col(c) * m + FLOOR) / (total * match + FLOOR * alphabet)).alias(name) for c, m, name in sides]
            last = stash(table.select("gram", *p), "p-1")
            continue
        before = stash(shorter(table, 0, 4 * k, "_before", "_good", "_total"), f"contexts-{k}")
        out = table.select("*", F.expr(f"substring(gram, 1, {4 * k})").alias("_before"), F.expr(f"substring(gram, 5, {4 * k})").alias("_short"))
        out = out.join(small(before, before.count()), "_before").join(small(last.withColumnsRenamed({"gram": "_short", "pt": "_pt", "pb": "_pb"}), last.count()), "_short")
        p = [((F.col(c) * m + PRIOR * F.col(f"_{name}")) / (F.col(f"_{c}") * m + PRIOR)).alias(name) for c, m, name in sides]
        last = stash(out.select("gram", *p), f"p-{k + 1}")
    return last.select("gram", (-F.log("pt")).alias("lt"), (-F.log("pb")).alias("lb"))


def counts(docs: DataFrame) -> tuple[dict, dict]:
    """(target, background) counts of (text, target) by n-gram, at SLOTS the total: for looking at small inputs."""
    orders = tables(grams_of(docs.withColumn("doc_id", F.lit(None).cast("long"))))
    rows = [r for t in orders for r in t.collect()]
    n = orders[0].agg(F.sum("good"), F.sum("total")).first()
    return ({bytes(r["gram"]): r[c] for r in rows} | {SLOTS: x} for c, x in zip(("good", "total"), n, strict=True))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ce_target, ce_background (nats a token), score (their difference)."""
    with scratch(docs.sparkSession):
        return batch_scores(docs, labels)


def batch_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    good = stash(labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("_good")).distinct(), "targets")
    rows = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    marked = rows.join(small(good, good.count()), F.col("doc_id") == F.col("_good"), "left").withColumn("target", F.col("_good").isNotNull())
    held = stash(grams_of(marked), "batch-grams", keep=True)
    logs = probabilities(tables(held.select("gram", "good", "total")))
    logs = stash(logs, "logs", keep=True)
    joined = held.select("batch", "gram", "who", "times", "ids").join(small(logs, logs.count()), "gram", "left").drop("gram")

    def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf["ids"].notna().to_numpy()
        ids, rest = [*pdf["ids"][head].iloc[0]], pdf[~head]
        who, times = np.frombuffer(b"".join(rest["who"]), np.uint16), np.frombuffer(b"".join(rest["times"]), np.uint8)
        many = rest["times"].str.len().to_numpy(np.int64) if len(rest) else np.zeros(0, np.int64)
        n = np.bincount(who, times, len(ids)).astype(np.int64)
        out = {"doc_id": pd.array([None if pd.isna(x) else int(x) for x in ids], "Int64"), "n_tokens": n}
        for c, name in (("lt", "ce_target"), ("lb", "ce_background")):
            sums = np.bincount(who, times * np.repeat(rest[c].to_numpy(float), many), len(ids))
            out[name] = pd.array([s / k if k else None for s, k in zip(sums.tolist(), n.tolist(), strict=True)], "Float64")
        return pd.DataFrame(out)

    out = joined.groupBy("batch").applyInPandas(add_up, "doc_id long, n_tokens long, ce_target double, ce_background double")
    return out.withColumn("score", F.col("ce_target") - F.col("ce_background"))
