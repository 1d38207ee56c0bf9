"""Exact deduplication by deterministic block naming (operator 5).

Texts are cut into blocks of a fixed number of characters. Different blocks are sorted into integer names; adjacent
names are then paired and the pairs sorted into new names, until each text has one name. Equal names mean equal texts,
with no chance of collision: a block's hash only orders and routes it, and blocks that share a hash get different
names by comparing their contents.

Spark side: block contents are shuffled once, after partial aggregation (so a text held by a third of all rows is sent
once per task); everything after that moves thin rows of integers. Names are written before use, so a lost executor
cannot renumber them.

A block, pair or group that a large share of the rows has (a hot key) is joined by broadcast, the others by a shuffle.

Defined cases: null counts as empty and all empty texts are equal; a text of any length is cut in one pass; rows that repeat id and text are all returned, count
in group_size, and are kept together with their id; null ids never stay if another id does; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, lower_ascii, scratch, stash

BLOCK = 4096


def blocks(docs: DataFrame, block: int) -> DataFrame:
    """(doc_id, sha, n, idx, h, content): every text's blocks; an empty text has one empty block."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lower_ascii(F.coalesce("text", F.lit(""))).alias("t"))
    n = F.greatest(F.lit(1), F.ceil(F.length("t") / F.lit(block))).cast("int")
    cut = text.select("doc_id", "t", n.alias("n"))
    parts = F.regexp_extract_all("t", F.lit("(?s).{1,%d}" % block), F.lit(0))  # one pass, however long the text
    out = cut.select("doc_id", "n", F.sha2("t", 256).alias("sha"), F.posexplode(F.when(F.col("n") == 1, F.array("t")).otherwise(parts)).alias("idx", "content"))
    return out.withColumn("h", F.xxhash64("content"))


def block_names(docs: DataFrame, block: int) -> DataFrame:
    """(h, m, content, name): integer names of the different blocks in sorted order, and how many blocks have the hash.
    content only where a hash is shared."""
    same_hash = blocks(docs, block).groupBy("h").agg(F.sort_array(F.collect_set("content")).alias("c"), F.count("*").alias("m"))
    alone = F.array(F.lit(None).cast("string"))
    thin = same_hash.select("h", "m", F.explode(F.when(F.size("c") == 1, alone).otherwise(F.col("c"))).alias("content"))
    thin = stash(thin, "blocks")
    return stash(thin.orderBy("h", "content").withColumn("name", F.monotonically_increasing_id()), "block-names")


def identities(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, sha, level, name), one row per row of docs; (level, name) are equal exactly for equal texts."""
    names = block_names(docs, block)
    rows = blocks(docs, block)
    if names.where("content is not null").isEmpty():
        named = hot_join(rows.select("doc_id", "sha", "n", "idx", "h"), names.select("h", "m", "name"), ["h"], "m")
    else:  # some hash is shared: compare contents as well
        named = rows.join(names.withColumnRenamed("content", "c"), "h").where("c is null or c = content")
    now = stash(named.select("doc_id", "sha", "n", "idx", "name", F.lit(1).alias("copies")), "names-0")
    out, level = now.where("n = 1").select("doc_id", "sha", F.lit(0).alias("level"), "name"), 0
    most = now.agg(F.max("n")).first()[0] or 0
    while most > 1:
        level, most = level + 1, (most + 1) // 2
        even = F.col("idx") % 2 == 0
        pairs = now.where("n > 1").groupBy("doc_id", "sha", F.expr("cast((n + 1) div 2 as int)").alias("n"), F.expr("cast(idx div 2 as int)").alias("idx"))
        pairs = pairs.agg(F.max(F.when(even, F.col("name"))).alias("l"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("r"), F.sum(F.when(even, F.col("copies"))).cast("int").alias("copies"))
        pairs = stash(pairs, f"pairs-{level}")
        new = stash(pairs.groupBy("l", "r").agg(F.count("*").alias("m")).orderBy("l", "r").withColumn("name", F.monotonically_increasing_id()), f"pair-names-{level}")
        now = stash(hot_join(pairs, new, ["l", "r"], "m").select("doc_id", "sha", "n", "idx", "name", "copies"), f"names-{level}")
        whole = now.where("n = 1").select("doc_id", "sha", F.lit(level).alias("level"), "name", F.explode(F.sequence(F.lit(1), "copies")))
        out = out.unionByName(whole.drop("col"))
    return out


def exact_groups(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256. Of equal texts the largest doc_id stays."""
    with scratch(docs.sparkSession):
        ids = stash(identities(docs, block), "identities", keep=True)
        groups = ids.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        groups = stash(groups.withColumn("m", F.col("group_size")), "groups", keep=True)
    out = hot_join(ids, groups, ["level", "name"], "m")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))
