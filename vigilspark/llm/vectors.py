"""Embedding near-duplicates by an inverted multi-index (operator 10).

Unit vectors are halved; each half has its own codebook, and the product of the codebooks is the grid of cells. A
vector is stored in the cell of its nearest codewords. As a query it walks the cells by growing sum of the two halves'
squared distances (multi-sequence traversal) for as many cells as it took, on a calibration sample, to reach the
target recall; what it meets is verified by cosine in double precision.

Spark side: equal vectors of a label collapse into one class first. Codebooks come from a bounded sample, their size
grows with the rows; every class is indexed and every class is a query. Cells are the join key: ids and one-byte codes
of their members and of the queries that visit them meet in blocks of bounded size, so neither a dense cell nor a hot
label gathers in one task. Only vectors that a code leaves in question, within a proven error bound, are fetched and
verified in the same blocks, which return counts per vector and a spanning forest of their links instead of all pairs. A
link that is met from one side only counts at both ends: a block tells from a member's own walk whether it meets the
asker itself.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with null label, link
with nothing; vectors of different length are compared within their length only; a cosine of exactly the threshold, as
computed for the pair alone, links; vectors of any finite size count, as they are scaled first; rows that repeat an id
are rows of their own; null ids never name a component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import components, hot_join, scratch, small, stash
from .near_dedup import forest

#: Bound of the sample that fits and calibrates the index. A codebook has at most as many words as the sample has vectors,
#: so the grid grows with the rows up to some 10**10 of them; beyond that its cells grow, which are met in blocks.
SAMPLE = 20_000
#: Share of the pairs at the threshold that are to be met.
RECALL = 0.97
#: Rows of a cell, on average.
CELL = 128
#: Members and queries of a block at most about so many each where codes are compared; vectors meet in blocks of an eighth.
BLOCK = 1024


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means on the rows of x with a fixed seed."""
    rng = np.random.default_rng(5)
    words = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([((words**2).sum(1)[None] - 2 * part @ words.T).argmin(1) for part in np.array_split(x, 1 + len(x) * k // 4_000_000)])
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(words)
        np.add.at(sums, near, x)
        words[n > 0] = sums[n > 0] / n[n > 0, None]
    return words


def walk(d1: np.ndarray, d2: np.ndarray, cells: int) -> tuple[list[tuple[int, int]], float]:
    """Multi-sequence traversal: the `cells` pairs (i, j) of smallest d1[i] + d2[j], nearest first, with all that are as
    near as the last, and the last one's distance."""
    o1, o2 = (nearest(d, cells) for d in (d1, d2))
    heap, seen, out, bar = [(d1[o1[0]] + d2[o2[0]], 0, 0)], {(0, 0)}, [], 0.0
    while heap and (len(out) < cells or heap[0][0] <= bar):
        bar, i, j = heapq.heappop(heap)
        out.append((int(o1[i]), int(o2[j])))
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(o1) and b < len(o2) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (d1[o1[a]] + d2[o2[b]], a, b))
    return out, float(bar)


def nearest(d: np.ndarray, n: int) -> np.ndarray:
    """Positions of the n smallest of d, and of those that equal the last of them, in order."""
    if n < len(d):
        at = np.flatnonzero(d <= np.partition(d, n - 1)[n - 1])
        return at[d[at].argsort(kind="stable")]
    return d.argsort(kind="stable")


class Grid:
    def __init__(self, first: np.ndarray, second: np.ndarray, cells: int = 1):
        self.words, self.half, self.cells = (first, second), first.shape[1], cells

    def far(self, u: np.ndarray, side: int, words: np.ndarray | None = None) -> np.ndarray:
        """Squared distances of the vectors' first or second half to the codewords (or to those numbered words). A value
        does not depend on what else is in the batch, so tasks agree on it to the last bit."""
        p, w = (u[:, : self.half], u[:, self.half :])[side], self.words[side] if words is None else self.words[side][words]
        out = np.empty((len(p), len(w)))
        step = max(1, 2_000_000 // max(1, w.size))
        for k in range(0, len(p), step):
            out[k : k + step] = ((p[k : k + step, None] - w[None]) ** 2).sum(-1)
        return out

    def cell(self, u: np.ndarray) -> np.ndarray:
        return self.far(u, 0).argmin(1) * len(self.words[1]) + self.far(u, 1).argmin(1)

    def visits(self, u: np.ndarray) -> list[tuple[list[int], float]]:
        """For each vector the cells it visits, nearest first, and the distance up to which it visits all."""
        n = len(self.words[1])
        walks = (walk(a, b, self.cells) for a, b in zip(self.far(u, 0), self.far(u, 1), strict=True))
        return [([i * n + j for i, j in found], bar) for found, bar in walks]

    def reaches(self, u: np.ndarray, bar: np.ndarray, homes: np.ndarray) -> np.ndarray:
        """Whether the vectors, which visit all up to bar, visit each of the cells homes."""
        sums = 0.0
        for side, part in enumerate(np.divmod(homes, len(self.words[1]))):
            words, at = np.unique(part, return_inverse=True)
            sums = self.far(u, side, words)[:, at] + sums
        return sums <= bar[:, None]


def unit(vectors) -> np.ndarray:
    """Rows of length 1; dividing by the largest component first keeps squares from overflowing or vanishing."""
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def coded(u: np.ndarray) -> list[bytes]:
    """Vectors as one byte a component, after their scale and the length of what rounding lost (two doubles)."""
    scale = np.abs(u).max(axis=1, keepdims=True) / 127
    code = np.rint(u / scale)
    lost = np.linalg.norm(u - code * scale, axis=1, keepdims=True)
    heads = np.concatenate([scale, lost], axis=1)
    return [h.tobytes() + c.tobytes() for h, c in zip(heads, code.astype(np.int8), strict=True)]


def maybe_near(x: list[bytes], y: list[bytes], threshold: float) -> np.ndarray:
    """Which pairs of codes can stand for vectors of at least that cosine: no such pair is left out."""
    sides = []
    for rows in (x, y):
        raw = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
        heads = np.ascontiguousarray(raw[:, :16]).view(np.float64)
        sides.append((raw[:, 16:].view(np.int8).astype(np.float32), heads[:, :1], heads[:, 1:]))
    (a, sa, la), (b, sb, lb) = sides
    return (a @ b.T) * sa * sb.T >= threshold - la - (1 + la) * lb.T - 1e-4


def near(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of unit vectors have at least that cosine; those at the threshold but for rounding are computed pair by
    pair, so that the answer does not depend on the block."""
    cos = x @ y.T
    hit = cos >= threshold
    for i, j in np.argwhere(np.abs(cos - threshold) < 1e-12):
        hit[i, j] = (x[i] * y[j]).sum() >= threshold
    return hit


def calibrated(sample: np.ndarray, labels: np.ndarray, rows: int, threshold: float, recall: float = RECALL) -> Grid:
    """A grid with about one cell per CELL rows, and the number of visited cells at which one vector of a pair visits the
    other's cell with the target recall, both for near pairs of the sample and for made pairs right at the threshold."""
    k = int(np.clip(round((rows / CELL) ** 0.5), 1, len(sample)))
    half = (sample.shape[1] + 1) // 2
    grid = Grid(codebook(sample[:, :half], k), codebook(sample[:, half:], k) if sample.shape[1] > half else np.zeros((1, 0)))
    rng = np.random.default_rng(9)
    u = sample[rng.choice(len(sample), min(500, len(sample)), replace=False)]
    noise = rng.normal(size=u.shape)
    noise -= (noise * u).sum(1, keepdims=True) * u
    length = np.linalg.norm(noise, axis=1, keepdims=True)
    made = np.where(length > 1e-9, threshold * u + (1 - threshold**2) ** 0.5 * noise / np.maximum(length, 1e-9), u)
    sets = [(u, made)]
    queries = rng.choice(len(sample), min(1000, len(sample)), replace=False)
    pairs = [(q, m) for q in queries for m in np.flatnonzero((sample @ sample[q] >= threshold) & (labels == labels[q]))[:50] if m != q]
    if pairs:
        a, b = np.array(pairs).T
        sets.append((sample[a], sample[b]))
    most = 1
    for left, right in sets:
        ranks = []
        for query, found in ((left, right), (right, left)):
            cell, d1, d2 = grid.cell(found), grid.far(query, 0), grid.far(query, 1)
            at = np.arange(len(query))
            own = d1[at, cell // len(grid.words[1])] + d2[at, cell % len(grid.words[1])]
            ranks.append([(np.searchsorted(np.sort(b), o - np.sort(a)[:5000]).sum() + 1) for a, b, o in zip(d1, d2, own, strict=True)])
        most = max(most, int(np.quantile(np.minimum(*ranks), recall, method="higher")))
    grid.cells = most
    return grid


def can_link() -> Column:
    """Whether a row's label and embedding allow any link."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))


def typed(vectors: DataFrame) -> DataFrame:
    given = vectors.schema["embedding"].dataType
    kind = "array<float>" if isinstance(given, ArrayType) and isinstance(given.elementType, FloatType) else "array<double>"
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast(kind).alias("embedding"))


def in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """rows (cell, id, query) dealt to blocks (cell, m, q) of about so many members and queries: members go to one of a
    cell's blocks of members and to each of its blocks of queries, queries the other way round."""
    count = lambda asks: F.ceil(F.sum((F.col("query") == asks).cast("int")) / block).cast("int")
    parts = stash(rows.groupBy("cell").agg(count(False).alias("mb"), count(True).alias("qb")).where("mb > 0 and qb > 0"), "blocks")
    spread = rows.join(small(parts, parts.count()), "cell")
    own = F.pmod(F.xxhash64("id"), F.when(F.col("query"), F.col("qb")).otherwise(F.col("mb"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("query"), F.col("mb")).otherwise(F.col("qb")) - 1))
    spread = spread.select("id", "cell", "query", own.alias("own"), other.alias("other"))
    at = lambda asks: F.when(F.col("query") == asks, F.col("own")).otherwise(F.col("other"))
    return spread.select("cell", at(False).alias("m"), at(True).alias("q"), "query", "id")


def links(classes: DataFrame, grid: Grid, threshold: float, block: int = BLOCK) -> DataFrame:
    """For each block of a cell: rows (a, b, n) with a's links there summed over copies, and forest edges a - b.

    classes: (id, label, size, embedding). n counts rows of other classes; edges have n = 0."""
    shared = classes.sparkSession.sparkContext.broadcast(grid)

    def place(batches):
        g = shared.value
        for pdf in batches:
            if len(pdf):
                u = unit(pdf["embedding"])
                walks = g.visits(u)
                yield pd.DataFrame({"id": pdf["id"], "label": pdf["label"], "size": pdf["size"], "home": [w[0] for w, _ in walks], "cells": [w for w, _ in walks], "bar": [b for _, b in walks], "code": coded(u)})

    placed = stash(classes.select("id", "label", "size", "embedding").mapInPandas(place, "id long, label string, size long, home long, cells array<long>, bar double, code binary"), "cells")
    members = placed.select(F.col("home").alias("cell"), "id", F.lit(False).alias("query"))
    asked = placed.select(F.explode("cells").alias("cell"), "id", F.lit(True).alias("query"))
    spread = in_blocks(members.unionByName(asked), block)
    thin = spread.join(placed.select("id", F.xxhash64("label").alias("kind"), "code"), "id").select("cell", "m", "q", "query", "id", "kind", "code")

    def prune(pdf: pd.DataFrame) -> pd.DataFrame:
        ask, have = pdf[pdf["query"]], pdf[~pdf["query"]]
        if not len(ask) or not len(have):
            return pdf[:0][["cell", "query", "id"]]
        hit = maybe_near([*ask["code"]], [*have["code"]], threshold)
        hit &= (ask["id"].to_numpy()[:, None] != have["id"].to_numpy()[None]) & (ask["kind"].to_numpy()[:, None] == have["kind"].to_numpy()[None])
        return pd.concat([ask[hit.any(axis=1)], have[hit.any(axis=0)]])[["cell", "query", "id"]]

    # What is left is often one dense group of a cell, so it is dealt anew to smaller blocks.
    left = thin.groupBy("cell", "m", "q").applyInPandas(prune, "cell long, query boolean, id long")
    left = in_blocks(stash(left.distinct(), "near-rows"), -(-block // 8))
    loaded = left.join(placed.select("id", "label", "size", "home", "bar"), "id").join(classes.select("id", "embedding"), "id")

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        ask, have = pdf[pdf["query"]], pdf[~pdf["query"]]
        if not len(ask) or not len(have):
            return pd.DataFrame({"a": [], "b": [], "n": []}, dtype="int64")
        x, y = unit(ask["embedding"]), unit(have["embedding"])
        qi, mi = ask["id"].to_numpy(), have["id"].to_numpy()
        hit = near(x, y, threshold) & (qi[:, None] != mi[None]) & (ask["label"].to_numpy()[:, None] == have["label"].to_numpy()[None])
        # A member that visits the asker's cell itself counts the link there; any other gets it counted here.
        missed = hit.T & ~shared.value.reaches(y, have["bar"].to_numpy(), ask["home"].to_numpy())
        ids, n = np.concatenate([qi, mi]), np.concatenate([hit @ have["size"].to_numpy(), missed @ ask["size"].to_numpy()])
        some = n > 0
        counts = pd.DataFrame({"a": ids[some], "b": ids[some], "n": n[some]})
        edges = pd.DataFrame(forest(hit, qi, mi), columns=["a", "b"]).assign(n=0)
        return pd.concat([counts, edges]).astype("int64")

    return loaded.groupBy("cell", "m", "q").applyInPandas(verify, "a long, b long, n long")


def near_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept (vec_id = component_id)."""
    every = typed(vectors)
    rest = every.where(~can_link()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    with scratch(vectors.sparkSession):
        linked = linkable(every.where(can_link()), threshold)
    return linked.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def linkable(good: DataFrame, threshold: float) -> DataFrame:
    """(vec_id, n_links, component_id) of vectors that can link."""
    keyed = good.select("vec_id", "label", "embedding", F.xxhash64("embedding").alias("h"), F.size("embedding").alias("dim"))
    keyed = stash(keyed.select("vec_id", F.concat_ws(":", "label", F.col("dim").cast("string")).alias("label"), "embedding", "h", "dim"), "vectors", keep=True)
    classes = keyed.groupBy("label", "h", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("size"))
    classes = stash(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    found = None
    for dim, n in sorted(classes.groupBy(F.size("embedding").alias("dim")).count().collect()):
        own = classes.where(F.size("embedding") == dim)
        some = own.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 20)) < min(1.0, SAMPLE / n) * (1 << 20)).select("label", "embedding").toPandas()
        if not len(some):
            some = own.limit(1).select("label", "embedding").toPandas()
        grid = calibrated(unit(some["embedding"]), some["label"].to_numpy(), n, threshold)
        part = links(own, grid, threshold)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return keyed.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    found = stash(found, "vector-links")
    counts = found.where("n > 0").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    roots = components(found.where("n = 0").select("a", "b"))
    rooted = classes.select("id", "label", "h", "embedding", "vec_id", "size").join(counts, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    rooted = stash(rooted.select("label", "h", "embedding", "vec_id", "size", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("root", "id").alias("root")), "rooted-vectors")
    smallest = stash(rooted.groupBy("root").agg(F.min("vec_id").alias("component_id"), F.count("*").alias("m")), "smallest")
    named = hot_join(rooted, smallest, ["root"], "m").select("label", "h", "embedding", "size", "n_links", "component_id")
    named = stash(named, "named-vectors", keep=True)
    return hot_join(keyed, named, ["label", "h", "embedding"], "size").select("vec_id", "n_links", "component_id")
