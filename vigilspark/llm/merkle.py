"""Merkle manifest of documents with inclusion proofs by pointer jumping (operator 11).

Every row is a leaf; the leaves of a language form a tree of runs of eight, the languages' roots form one more such tree.
Leaves are numbered by ranges, so no language is one task. Each inner node starts with a pointer to its parent and the
digests of its siblings; a self-join along the pointers doubles the distance and puts the two segments together, until
all pointers have reached the root after about log2(height) joins. A leaf has its siblings beside it in its run, so it
takes over its run's whole segment by one last join. Near the top few nodes are pointed at by all others: few nodes
are broadcast, of many the hot ones are.

Defined cases: a null field is `-`; rows of a null language are a tree of their own, before the others; a null doc_id comes
first and is never tampered with; repeated rows are leaves each, in any order among equal ones (their digests are equal,
their proofs are those of their places); empty texts are `0:`; long texts are hashed whole; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_join, lower_ascii, stash

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars")
#: Rows of a range in which one task numbers the leaves.
ROWS = 200_000
#: Up to so many nodes with their segments (at most about 1 kB for each level) are broadcast.
FEW_NODES = 4096
#: Name of the tree over the languages; theirs are empty (null) or begin with =, and sort as the languages do.
TOP = "^"
ID = ["tree", "level", "pos"]


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """Length in UTF-8 bytes and value; - for null."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column) -> Column:
    return digest(*[field(F.col(c)) for c in FIELDS], field(text))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (written) with pos, the place by order within tree from 0, and n, the rows of the tree. Dealt by ranges of about
    ROWS rows, which are numbered each and shifted by the ranges before."""
    ranges = max(1, -(-rows.count() // ROWS))
    cut = stash(rows.repartitionByRange(ranges, "tree", *order).withColumn("range", F.spark_partition_id()), "ranges")
    by = Window.partitionBy("tree")
    before = F.coalesce(F.sum("c").over(by.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = cut.groupBy("tree", "range").agg(F.count("*").alias("c")).select("tree", "range", before.alias("shift"), F.sum("c").over(by).alias("n"))
    own = F.row_number().over(Window.partitionBy("tree", "range").orderBy(*order)) - 1
    return cut.withColumn("own", own).join(shifts, ["tree", "range"]).withColumn("pos", F.col("own") + F.col("shift")).drop("own", "shift", "range")


def runs(nodes: DataFrame, level: int, *carried: str) -> DataFrame:
    """The nodes of trees with several, in runs: one row for each parent, with its hash and its children in order."""
    child = F.array_sort(F.collect_list(F.struct("pos", "hash", *carried)))
    made = nodes.where("n > 1").groupBy("tree", F.expr(f"pos div {FAN}").alias("pos")).agg(child.alias("children"), F.first("n").alias("n"))
    return made.select("tree", F.lit(level).alias("level"), "pos", F.ceil(F.col("n") / FAN).alias("n"), "children", digest(F.array_join("children.hash", "")).alias("hash"))


def siblings(children: Column, place: Column) -> Column:
    """The digests left and right of the child at place."""
    return F.struct(F.array_join(F.slice(children["hash"], 1, place), "").alias("left"), F.array_join(F.slice(children["hash"], place + 2, FAN), "").alias("right"))


def pointers(made: DataFrame, child: dict[str, Column], sub: Column) -> DataFrame:
    """The children of inner runs as nodes: id, the parent they point at, one segment of siblings, the language's root if it
    is known."""
    rows = made.select(*[F.col(c).alias(f"up_{c}") for c in ID], "children", F.posexplode("children").alias("k", "c"))
    return rows.select(*[child[c].alias(c) for c in ID], *[f"up_{c}" for c in ID], F.array(siblings(F.col("children"), F.col("k"))).alias("path"), sub.alias("subroot"))


def jumped(nodes: DataFrame) -> DataFrame:
    """nodes with whole paths: each self-join takes every pointer to where its target points."""
    ups = [f"up_{c}" for c in ID]
    while True:
        open_ = nodes.where("up_tree is not null")
        asked = open_.groupBy(*ups).agg(F.count("*").alias("asked"))
        to = nodes.select(*[F.col(c).alias(f"up_{c}") for c in ID], *[F.col(f"up_{c}").alias(f"next_{c}") for c in ID], F.col("path").alias("more"), F.col("subroot").alias("sub"))
        to = stash(asked.join(to, ups), "ancestors")
        if not (found := to.count()):
            return nodes
        met = open_.join(F.broadcast(to.drop("asked")), ups) if found <= FEW_NODES else hot_join(open_, to, ups, "asked")
        far = met.select(*ID, *[F.col(f"next_{c}").alias(f"up_{c}") for c in ID], F.concat("path", "more").alias("path"), F.coalesce("subroot", "sub").alias("subroot"))
        nodes = stash(far.unionByName(nodes.where("up_tree is null")), "jumped")


def heights(nodes: DataFrame) -> int:
    """Levels above the leaves of the largest tree."""
    most, levels = nodes.agg(F.max("n")).first()[0] or 0, 0
    while most > 1:
        most, levels = -(-most // FAN), levels + 1
    return levels


def proofs(docs: DataFrame, changed: Column | None = None, text: Column | None = None) -> DataFrame:
    """One row per row of docs: doc_id, leaf, subroot, root, path (from the leaf up: left and right siblings, as digests put
    together), claimed (the leaf, but where changed is true the leaf with the column text in place of its text)."""
    other = F.when(changed, leaf(text)) if changed is not None else F.lit(None).cast("string")
    own = docs.select(F.concat(F.lit("="), "lang").alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(F.col("text")).alias("hash"), other.alias("claimed"))
    own = stash(own.withColumns({"tree": F.coalesce("tree", F.lit("")), "tie": F.monotonically_increasing_id()}), "leaves")
    nodes = stash(numbered(own, ["doc_id", "hash", "tie"]), "numbered")
    levels = heights(nodes)
    lone = nodes.where("n = 1").select("tree", F.lit(0).alias("level"), "pos", F.array(F.struct("pos", "hash", "doc_id", "claimed")).alias("children"), "hash")
    bottom = stash(runs(nodes, 1, "doc_id", "claimed"), "runs-1")
    at, tops, inner = nodes.select("tree", "pos", "hash", "n"), [lone.select("tree", "level", "hash")], []
    for level in range(1, levels + 1):
        made = bottom if level == 1 else stash(runs(at, level), f"level-{level}")
        if level > 1:
            inner.append(pointers(made, {"tree": F.col("up_tree"), "level": F.lit(level - 1), "pos": F.col("c.pos")}, F.lit(None).cast("string")))
        tops.append(made.where("n = 1").select("tree", "level", "hash"))
        at = made.select("tree", "pos", "hash", "n")
    roots = tops[0]
    for t in tops[1:]:
        roots = roots.unionByName(t)
    roots = stash(roots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("of"), F.col("level").alias("top"), "hash"), "subroots")
    at = stash(numbered(roots, ["of"]), "subroots")
    if at.isEmpty():
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.lit("").alias(c) for c in ("leaf", "subroot", "root", "claimed")], F.array(F.struct(F.lit("").alias("left"), F.lit("").alias("right"))).alias("path")).limit(0)
    above = heights(at)
    root = at.select("of", "top", "hash").first() if not above else None
    for level in range(1, above + 1):
        made = stash(runs(at, level, *(("of", "top") if level == 1 else ())), f"top-{level}")
        child = {"tree": F.col("c.of"), "level": F.col("c.top"), "pos": F.lit(0)} if level == 1 else {"tree": F.lit(TOP), "level": F.lit(level - 1), "pos": F.col("c.pos")}
        inner.append(pointers(made, {k: v.cast("long") if k == "pos" else v for k, v in child.items()}, F.col("c.hash") if level == 1 else F.lit(None).cast("string")))
        at = made.select("tree", "pos", "hash", "n")
    none = [F.lit(None).cast(t).alias(f"up_{c}") for c, t in zip(ID, ("string", "int", "long"), strict=True)]
    if root is None:
        top, value = (TOP, above), at.first()["hash"]
    else:
        top, value = (root["of"], root["top"]), root["hash"]
    empty = F.array().cast("array<struct<left:string,right:string>>")
    table = docs.sparkSession.range(1).select(F.lit(top[0]).alias("tree"), F.lit(top[1]).alias("level"), F.lit(0).cast("long").alias("pos"), *none, empty.alias("path"), F.lit(value if root is not None else None).cast("string").alias("subroot"))
    for part in inner:
        table = table.unionByName(part)
    table = jumped(stash(table, "pointers")).select(*ID, "path", "subroot")
    leaves = bottom.drop("hash", "n").unionByName(lone.drop("hash")).join(table, ID)
    leaves = leaves.select("level", "path", "subroot", "children", F.posexplode("children").alias("k", "c"))
    whole = F.when(F.col("level") == 1, F.concat(F.array(siblings(F.col("children"), F.col("k"))), "path")).otherwise(F.col("path"))
    return leaves.select("c.doc_id", F.col("c.hash").alias("leaf"), "subroot", F.lit(value).alias("root"), F.coalesce("c.claimed", "c.hash").alias("claimed"), whole.alias("path"))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, start, lambda acc, s: digest(s["left"], acc, s["right"]))


def proof_digest(path: Column) -> Column:
    """One digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def audit(docs: DataFrame) -> DataFrame:
    """Proofs of all rows, checked after the texts of those whose id's crc32 is a multiple of 3 were lower-cased (A-Z)."""
    found = proofs(docs, F.crc32(F.col("doc_id").cast("string")) % 3 == 0, lower_ascii(F.col("text")))
    end = folded(F.col("claimed"), F.col("path"))
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), end.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
