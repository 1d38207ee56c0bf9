"""MinHash near-deduplication with sequential Bayesian verification (operator 2).

1. Each text becomes its set of word shingles; equal sets collapse into one node named by a 128-bit fingerprint.
2. MinHash bands bucket the nodes. In a bucket every node is first compared with the bucket's least node, so a bucket
   of m nodes gives m - 1 pairs, not m * m; of its heads in several buckets, a node meets the least one first. After components are known, only pairs of one bucket that lie in different
   components are compared: nothing that could join two groups is left out, and groups of copies stay linear.
3. Candidates are verified sequentially: signatures are compared batch by batch, and a pair is pruned once the
   posterior probability of similarity >= threshold is under `miss` (uniform prior: the posterior tail is a binomial
   sum). Survivors are confirmed on their full sets.
4. Components of confirmed links give the groups.

Rows and bands are chosen so that a pair at the threshold shares no band with probability under 1e-5.

Sets are of 64-bit hashes of the shingles, equal sets are told by a 128-bit hash of theirs.

Defined cases: texts without words (null, empty, white space) have no shingles and link with nothing; texts with fewer
words than a shingle have their whole sequence as one; a text of any length is one set, and blocks of pairs are cut by
the bytes of their sets; a similarity of exactly the threshold links; rows that repeat an id are rows of their own and share a
component if their sets do; null ids never name a component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, components, hot_join, in_small_batches, lean, scratch, small, stash

PERMUTATIONS = 256
#: Signature values compared between two looks at the posterior.
BATCH = 32
#: Accepted probability of pruning a pair that is similar enough.
MISS = 1e-6
#: Buckets with up to so many members give their open pairs as rows; larger ones go through blocks of about BLOCK members
#: a side, and fewer if their sets would take more than BLOCK_BYTES.
FEW = 12
BLOCK = 256
BLOCK_BYTES = 16 << 20

SIGNED = "doc_id long, n_shingles long, fp binary, sig binary, bands array<long>"


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix (the splitmix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the different word shingles; words end at ASCII white space and fold A-Z."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.array([*map(xxhash.xxh3_64_intdigest, w)], np.uint64)
    if not len(h):
        return h
    n = max(1, len(h) - words + 1)
    s = np.full(n, min(words, len(h)), np.uint64)
    for k in range(min(words, len(h))):
        s = mixed(s * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(s)


@lru_cache(maxsize=8)
def layout(threshold: float, permutations: int = PERMUTATIONS, miss: float = 1e-5) -> tuple[int, int]:
    """(bands, rows): the longest bands that a pair at the threshold misses all with probability under miss."""
    for rows in range(permutations, 1, -1):
        bands = permutations // rows
        if (1 - threshold**rows) ** bands <= miss:
            return bands, rows
    return permutations, 1


@lru_cache(maxsize=8)
def multipliers(permutations: int) -> np.ndarray:
    return np.random.default_rng(20240).integers(0, 1 << 32, (permutations, 1), np.uint64).astype(np.uint32) | np.uint32(1)


def signature(s: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """MinHash values (uint32, multiplicative hashing) of a set of mixed hashes; long sets go through in slices."""
    a, x, out = multipliers(permutations), (s >> np.uint64(32)).astype(np.uint32), np.full(permutations, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 1024):
        np.minimum(out, (a * x[None, k : k + 1024]).min(axis=1), out=out)
    return out


def fingerprint(s: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def signed(docs: DataFrame, words: int, threshold: float, named: bool = False) -> DataFrame:
    """(doc_id, n_shingles, fp, sig, bands) of every row, and sha of its text if named; sets without shingles have null
    fp, sig and bands."""
    bands, rows = layout(threshold)

    def run(batches):
        for pdf in batches:
            out = []
            for key, text in zip(pdf["_id"], pdf["_text"], strict=True):
                s = shingles(text, words)
                if not len(s):
                    out.append((key, 0, None, None, None))
                    continue
                sig = signature(s)
                band = mixed(np.arange(bands, dtype=np.uint64))
                for k in range(rows):
                    band = mixed(band * np.uint64(0x9E3779B97F4A7C15) + sig[k : rows * bands : rows])
                out.append((key, len(s), fingerprint(s), sig.astype(np.uint16).tobytes(), band.view(np.int64).tolist()))
            done = pd.DataFrame(out, columns=["doc_id", "n_shingles", "fp", "sig", "bands"]).astype({"doc_id": "Int64"})
            yield done.assign(sha=pdf["_sha"].to_numpy()) if named else done

    own = [F.sha2("text", 256).alias("_sha")] if named else []
    texts = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"), *own)
    return texts.mapInPandas(lean(run), SIGNED + ", sha string" * named)


@lru_cache(maxsize=8)
def least_matches(threshold: float, miss: float, batch: int = BATCH, permutations: int = PERMUTATIONS) -> tuple[int, ...]:
    """For each look after n values: the fewest matches with P(similarity >= threshold | matches) >= miss.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose tail above t is P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(batch, permutations + 1, batch):
        tail = 0.0
        for m in range(n + 1):
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                out.append(m)
                break
    return tuple(out)


def with_heads(pairs: DataFrame, heads: DataFrame, how: str = "inner") -> DataFrame:
    """pairs (a, b, written) joined with heads, one row for each a. An a of very many pairs, the head of a large bucket, is
    dealt to parts by its b, and its row goes to each part: none brings much more than one in HOT_SHARE of the pairs, or
    1000 of them, to a task. Fewer than HOT_SHARE such a are broadcast, by name alone."""
    counts = stash(pairs.groupBy("a").agg(F.count("*").alias("m")), "pairs-of")
    total, most = counts.agg(F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.max("m"), F.lit(0))).first()
    bar = max(total / HOT_SHARE, 1000.0)
    if most <= bar:
        return pairs.join(heads, "a", how)
    hot = F.broadcast(counts.where(F.col("m") > bar).select("a", F.ceil(F.col("m") / bar).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    left = pairs.join(hot, "a", "left").withColumn("part", F.pmod(F.xxhash64("b"), parts).cast("int")).drop("parts")
    right = heads.join(hot, "a", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return left.join(right, ["a", "part"], how).drop("part")


def plausible(pairs: DataFrame, nodes: DataFrame, threshold: float, miss: float = MISS) -> DataFrame:
    """Of the pairs (a, b) of nodes, those that no look at the signature batches prunes."""
    least = least_matches(threshold, miss)

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            left, right = (np.frombuffer(b"".join(pdf[c]), np.uint16).reshape(len(pdf), -1) for c in ("sa", "sb"))
            keep, matches = np.arange(len(pdf)), np.zeros(len(pdf), np.int64)
            for k, m in enumerate(least):
                cut = slice(k * BATCH, (k + 1) * BATCH)
                matches[keep] += (left[keep, cut] == right[keep, cut]).sum(axis=1)
                keep = keep[matches[keep] >= m]
            yield pdf.iloc[keep][["a", "b"]]

    loaded = with_heads(pairs, nodes.select(F.col("fp").alias("a"), F.col("sig").alias("sa"))).join(nodes.select(F.col("fp").alias("b"), F.col("sig").alias("sb")), "b")
    return loaded.select("a", "b", "sa", "sb").mapInPandas(run, "a binary, b binary")


def full_sets(fps: DataFrame, docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(fp, s) with the full set of shingles of each of the different fps, computed again from their texts."""
    need = stash(fps.distinct(), "to-verify")
    ids = nodes.join(need, "fp", "left_semi").select(F.col("doc_id").alias("_need"))
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"))
    texts = texts.join(small(ids, need.count()), F.col("_id").eqNullSafe(F.col("_need")), "left_semi")

    def sets(batches):
        for pdf in batches:
            out = [(fingerprint(s), s.tobytes()) for s in (shingles(t, words) for t in pdf["_text"])]
            yield pd.DataFrame(out, columns=["fp", "s"]).dropna()

    return stash(texts.mapInPandas(lean(sets), "fp binary, s binary").join(need, "fp", "left_semi").dropDuplicates(["fp"]), "sets")


def confirmed(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, threshold: float) -> DataFrame:
    """Of the pairs of nodes, those whose full sets are similar enough (100 * intersection >= 100t * union)."""
    full = full_sets(pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))), docs, nodes, words)
    percent = round(100 * threshold)

    def run(batches):
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["x"], pdf["y"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pdf.loc[np.array(keep, bool), ["a", "b"]]

    loaded = with_heads(pairs, full.select(F.col("fp").alias("a"), F.col("s").alias("x"))).join(full.select(F.col("fp").alias("b"), F.col("s").alias("y")), "b")
    return loaded.select("a", "b", "x", "y").mapInPandas(lean(run), "a binary, b binary")


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left with every right set. Only shingles of both sides count; they become
    columns of 0/1 matrices, multiplied a slice at a time."""
    x, y = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(x, y)
    rows = [np.repeat(np.arange(len(side)), [len(s) for s in side]) for side in (left, right)]
    out = np.zeros((len(left), len(right)), np.float32)
    places = []
    for values, row in zip((x, y), rows, strict=True):
        at = np.searchsorted(common, values)
        own = at < len(common)
        own[own] = common[at[own]] == values[own]
        places.append((row[own], at[own]))
    for k in range(0, len(common), 4096):
        width = min(4096, len(common) - k)
        ones = []
        for (row, at), side in zip(places, (left, right), strict=True):
            m = np.zeros((len(side), width), np.float32)
            cut = (at >= k) & (at < k + width)
            m[row[cut], at[cut] - k] = 1
            ones.append(m)
        out += ones[0] @ ones[1].T
    return out


def in_blocks(strays: DataFrame, members: DataFrame, block: int, most: int) -> DataFrame:
    """(band, i, j, x, fp, root): each stray (x) with each block of members of its band and the other way round. Blocks
    are cut by number and by the bytes of the full sets."""
    parts = lambda df, c: df.groupBy("band").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("n_shingles") * 8 / most)).cast("int").alias(c))
    parts = stash(parts(strays, "xs").join(parts(members, "ys"), "band"), "bucket-blocks")
    sides = strays.withColumn("x", F.lit(True)).unionByName(members.withColumn("x", F.lit(False))).join(parts, "band")
    own = F.pmod(F.xxhash64("fp"), F.when(F.col("x"), F.col("xs")).otherwise(F.col("ys"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("x"), F.col("ys")).otherwise(F.col("xs")) - 1))
    sides = sides.select("band", "fp", "root", "x", own.alias("own"), other.alias("other"))
    at = lambda first: F.when(F.col("x") == first, F.col("own")).otherwise(F.col("other"))
    return sides.select("band", at(True).alias("i"), at(False).alias("j"), "x", "fp", "root")


def open_pairs(x: pd.DataFrame, y: pd.DataFrame, least: tuple[int, ...]) -> np.ndarray:
    """Which pairs of rows of x and y lie in different components and are pruned by no look at their signatures."""
    left, right = (np.frombuffer(b"".join(d["sig"]), np.uint16).reshape(len(d), -1) for d in (x, y))
    roots = pd.factorize(pd.concat([x["root"], y["root"]]))[0]
    alive = roots[: len(x), None] != roots[None, len(x) :]
    matches = np.zeros(alive.shape, np.int16)
    for k, m in enumerate(least):
        if not alive.any():
            break
        for c in range(k * BATCH, (k + 1) * BATCH):
            matches += left[:, c, None] == right[None, :, c]
        alive &= matches >= m
    return alive


def block_links(strays: DataFrame, members: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, threshold: float, block: int | None = None, most: int | None = None) -> DataFrame:
    """Links (a, b) between strays and members of the same band but of different components, both (band, fp, root,
    n_shingles): a spanning forest for each block. Blocks first hold signatures only; the full sets are fetched, and sent
    to the blocks, for those members alone that have a pair left."""
    least, percent = least_matches(threshold, MISS), round(100 * threshold)
    sides = in_blocks(strays, members, block or BLOCK, most or BLOCK_BYTES)
    signed = sides.join(nodes.select("fp", "sig"), "fp").select("band", "i", "j", "x", "fp", "root", "sig")

    def prune(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf["x"]], pdf[~pdf["x"]]
        if not len(x) or not len(y):
            return pdf[:0]
        alive = open_pairs(x, y, least)
        return pd.concat([x[alive.any(axis=1)], y[alive.any(axis=0)]])

    left = stash(signed.groupBy("band", "i", "j").applyInPandas(prune, signed.schema), "open-blocks")
    if left.isEmpty():
        return left.select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    loaded = left.join(full_sets(left.select("fp"), docs, nodes, words), "fp")

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf["x"]], pdf[~pdf["x"]]
        alive = open_pairs(x, y, least)
        sx, sy = ([np.frombuffer(s, np.uint64) for s in d["s"]] for d in (x, y))
        both = intersections(sx, sy)
        nx, ny = np.array([len(s) for s in sx]), np.array([len(s) for s in sy])
        hit = alive & (100 * both >= percent * (nx[:, None] + ny[None] - both))
        return pd.DataFrame(forest(hit, x["fp"].to_numpy(), y["fp"].to_numpy()), columns=["a", "b"], dtype=object)

    return loaded.groupBy("band", "i", "j").applyInPandas(verify, "a binary, b binary")


def forest(hit: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple]:
    """A spanning forest of the links hit between the names left and right, which may share names."""
    rows = {left[k]: k for k in np.flatnonzero(hit.any(axis=1))}
    cols = {right[k]: k for k in np.flatnonzero(hit.any(axis=0))}
    new_left, new_right, edges, done = np.ones(len(left), bool), np.ones(len(right), bool), [], set()
    for root in [*rows, *cols]:
        queue = [] if root in done else [root]
        done.add(root)
        while queue:
            name, found = queue.pop(), []
            if name in rows:
                new_left[rows[name]] = False
                found += right[hit[rows[name]] & new_right].tolist()
            if name in cols:
                new_right[cols[name]] = False
                found += left[hit[:, cols[name]] & new_left].tolist()
            for other in found:
                if other not in done:
                    done.add(other)
                    edges.append((name, other))
                    queue.append(other)
    return edges


def near_groups(docs: DataFrame, words: int = 5, threshold: float = 0.8, named: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest doc_id of its group, its own if alone),
    kept (doc_id = component_id). If named also sha (of its text) and root, which names the group whatever its ids are
    (null without shingles)."""
    with scratch(docs.sparkSession):
        rows, of_node = grouped(docs, words, threshold, named)
    out = hot_join(rows.where("fp is not null"), of_node, ["fp"], "copies")
    none = rows.where("fp is null").withColumn("component_id", F.col("doc_id"))
    out = out.unionByName(none.withColumn("root", F.lit(None).cast("binary")) if named else none)
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return out.select("doc_id", "n_shingles", "component_id", kept, *(["sha", "root"] if named else []))


def grouped(docs: DataFrame, words: int, threshold: float, named: bool) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, fp, and sha if named) of each row, and (fp, copies, component_id, and root if named) of each node."""
    rows = stash(signed(docs, words, threshold, named), "signed")
    sets = rows.where("fp is not null")
    nodes = stash(sets.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "nodes")
    banded = nodes.select("fp", F.explode("bands").alias("band"))
    heads = banded.groupBy("band").agg(F.min("fp").alias("head"), F.count("*").alias("m")).where("m > 1")
    members = stash(banded.join(stash(heads.select("band", "head"), "heads"), "band"), "members")

    # Each node meets the least of its heads first; its other heads only where that left them in different components.
    tested = stash(members.where("fp != head").select(F.col("head").alias("a"), F.col("fp").alias("b")).distinct(), "first-pairs")
    least = stash(tested.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "least-heads")
    links = stash(confirmed(stash(plausible(least, nodes, threshold), "least-survivors"), docs, nodes, words, threshold), "least-links")
    labels = components(links)
    side = lambda k, r: labels.select(F.col("node").alias(k), F.col("root").alias(r))
    apart = with_heads(tested, side("a", "ra"), "left").join(side("b", "rb"), "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b"))
    apart = stash(apart.select("a", "b").join(least, ["a", "b"], "left_anti"), "other-heads")
    if not apart.isEmpty():
        found = stash(confirmed(stash(plausible(apart, nodes, threshold), "other-survivors"), docs, nodes, words, threshold), "other-links")
        if not found.isEmpty():
            links = links.unionByName(found)
            labels = components(links)

    # Buckets that still hold several components: compare what lies outside the largest one with all of the bucket.
    lone = members.join(labels, members.fp == labels.node, "left").select("band", "fp", "head", F.coalesce("root", "fp").alias("root"))
    lone = stash(lone, "labelled")
    mixed_up = lone.groupBy("band").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 != r2").select("band")
    open_rows = stash(lone.join(mixed_up, "band"), "open")
    sizes = open_rows.groupBy("band", "root").count()
    most = sizes.groupBy("band").agg(F.max(F.struct("count", "root")).alias("most"), F.sum("count").alias("m")).select("band", F.col("most.root").alias("most"), "m")
    open_rows = stash(open_rows.join(most, "band"), "open-most")
    few, many = open_rows.where(F.col("m") <= FEW), open_rows.where(F.col("m") > FEW)
    strays = few.where("root != most and fp != head").select("band", F.col("fp").alias("x"), F.col("root").alias("rx"))
    others = few.where("fp != head").select("band", F.col("fp").alias("y"), F.col("root").alias("ry"))
    again = strays.join(others, "band").where("rx != ry").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    again = stash(again.join(tested, ["a", "b"], "left_anti"), "second-pairs")
    more = []
    if not again.isEmpty():
        more.append(stash(confirmed(stash(plausible(again, nodes, threshold), "second-survivors"), docs, nodes, words, threshold), "second-links"))
    if not many.isEmpty():
        many = stash(many.join(nodes.select("fp", "n_shingles"), "fp"), "open-many")
        cols = ["band", "fp", "root", "n_shingles"]
        more.append(stash(block_links(many.where("root != most").select(*cols), many.select(*cols), docs, nodes, words, threshold), "block-links"))
    for found in more:
        links = links.unionByName(found)
    if more:
        labels = components(links)

    # The smallest doc_id of each component, then one thin row per document.
    rooted = nodes.select("fp", "doc_id", "copies").join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "doc_id", "copies", F.coalesce("root", "fp").alias("root"))
    rooted = stash(rooted, "rooted")
    smallest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("m"))
    of_node = stash(hot_join(rooted, stash(smallest, "smallest"), ["root"], "m").select("fp", "copies", "component_id", *(["root"] if named else [])), "of-node", keep=True)
    thin = rows.select("doc_id", "n_shingles", "fp", *(["sha"] if named else []))
    return stash(thin, "near-thin", keep=True), of_node
