"""A training-corpus pipeline: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes every stage's result to
the shared folder and reads it again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.llm import exact_dedup, language_id, near_dedup, packing, secrets
from vigilspark.llm.common import delete, place, save, scratch, small, stash
from vigilspark.llm.queries import tokenizer

#: Bits of one bitmap of Spark's bitmap functions; bits for each key marked, and of all bitmaps together at most.
BITMAP = 32768
BITS_EACH = 32
MOST_BITS = 1 << 26


def wrapped(docs: DataFrame, **more: Column) -> DataFrame:
    """docs with each row whole in one column `row`, beside columns of this module: no name in docs can clash with them."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *[c.alias(name) for name, c in more.items()])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects null texts, texts without a letter, and texts in no learned language: too few of their n-grams are known,
    by a bar set on labelled rows. Learns from docs itself; where nothing can be learned, texts with letters stay. Long
    texts are judged whole, repeated rows alike; an empty table stays empty; other columns are kept, whatever their names."""
    model = language_id.train(docs)
    least = language_id.least_known(docs, model) if model.langs else 0.0
    judged = language_id.with_known(wrapped(docs, text=F.col("text")), model, F.col("row"))
    return judged.where((F.col("_known") > 0) & (F.col("_known") >= least)).select("row.*")


def once(rows: DataFrame, again: DataFrame) -> DataFrame:
    """rows (row, id, sha), but of those with one of the keys again (id, sha) only the first of each key, by text and then
    the other columns; a null text comes last."""
    n = again.count()
    if not n:
        return rows.select("row.*")
    again = small(again.select(F.col("id").alias("again_id"), F.col("sha").alias("again_sha")), n)
    same = rows.id.eqNullSafe(F.col("again_id")) & (rows.sha == F.col("again_sha"))
    first = F.min(F.struct(F.col("row")["text"].isNull().alias("none"), F.col("row")["text"].alias("text"), F.col("row").alias("row")))
    firsts = rows.join(again, same).groupBy("again_id", "again_sha").agg(first.alias("first")).select("first.row")
    return rows.join(again, same, "left_anti").select("row").unionByName(firsts).select("row.*")


def maybe_in(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows with _maybe: false only if no row of gone (written) has the same sha. A bitmap of at most 8 MB says so, whose bits
    are hashes of gone's shas; about one other row in BITS_EACH is true beside those, more only once the bitmap is as
    large as it may be."""
    bits = BITMAP
    while bits < min(BITS_EACH * gone.count(), MOST_BITS):
        bits *= 2
    at = F.pmod(F.xxhash64("sha"), F.lit(bits))
    place, bit = F.floor(at / BITMAP), at % BITMAP
    bitmaps = gone.select(place.alias("_place"), bit.alias("_bit")).groupBy("_place").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    eight = F.conv(F.hex(F.substring("_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.join(F.broadcast(bitmaps), place == F.col("_place"), "left")
    return met.select(*rows.columns, F.coalesce(F.getbit(eight, (bit % 8).cast("int")) == 1, F.lit(False)).alias("_maybe"))


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows whose key (id, sha) is not one of gone (written). Only rows that may be among these are shuffled, with their
    texts, to be compared; all others stay where they are."""
    marked = maybe_in(rows, gone)
    gone = gone.select(F.col("id").alias("gone_id"), F.col("sha").alias("gone_sha"))
    left = marked.where("_maybe").join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("sha") == F.col("gone_sha")), "left_anti")
    return marked.where("not _maybe").unionByName(left).drop("_maybe")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z folded) one row stays: the largest doc_id (null only if there is no other), then the first text.
    A null text counts as empty; long texts are compared whole; an empty table stays empty; other columns are kept,
    whatever their names."""
    groups = stash(exact_dedup.exact_groups(docs).select(F.col("doc_id").alias("id"), "kept", F.col("text_sha256").alias("sha")), "exact-rows")
    rows = wrapped(docs, id=F.col("doc_id"), sha=F.sha2(exact_dedup.lower_ascii(F.coalesce("text", F.lit(""))), 256))
    copies = stash(groups.where("not kept").select("id", "sha").distinct(), "exact-copies")
    again = stash(groups.where("kept").groupBy("id", "sha").count().where("count > 1").select("id", "sha"), "exact-again")
    return once(without(rows, copies), again)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (5-word shingles, similarity 0.8 or more) stays: the smallest doc_id (null only
    if there is no other), then the first text. Rows are told apart by id and text, as ids may be null or repeat. Null
    and empty texts are near nothing; long texts are compared whole; an empty table stays empty; other columns are
    kept, whatever their names."""
    rows = wrapped(docs, id=F.col("doc_id"), sha=F.sha2("text", 256))
    groups = near_dedup.near_groups(docs, words=5, threshold=0.8, named=True).where("root is not null")
    groups = stash(groups.groupBy("root", "component_id", F.col("doc_id").alias("id"), "sha").count(), "near-rows")
    least = groups.where("id <=> component_id")
    first = stash(least.groupBy("root").agg(F.min("sha").alias("first"), F.count("*").alias("texts")), "near-first")
    tied = stash(least.join(first.where("texts > 1"), "root").select("root", F.col("id").alias("tied_id"), F.col("sha").alias("tied_sha")), "near-tied")
    if not tied.isEmpty():  # the smallest id has several texts of one group: only these are compared
        same = rows.id.eqNullSafe(F.col("tied_id")) & (rows.sha == F.col("tied_sha"))
        texts = rows.join(tied, same).groupBy("root").agg(F.min(F.struct(F.col("row")["text"].alias("text"), "sha")).alias("t"))
        first = stash(first.join(texts, "root", "left").select("root", F.coalesce("t.sha", "first").alias("first")), "near-first")
    stays = F.col("id").eqNullSafe(F.col("component_id")) & (F.col("sha") == F.col("first"))
    judged = groups.join(first.select("root", "first"), "root").select("id", "sha", "count", stays.alias("stays"))
    gone = stash(judged.where("not stays").select("id", "sha"), "near-copies")
    again = stash(judged.where("stays and count > 1").select("id", "sha"), "near-again")
    return once(without(rows, gone), again)


def secret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, and n_chars is counted anew where that changed a text; all else stays as it is, null
    and empty texts, repeated rows and other columns included. Long texts are scanned whole; an empty table stays empty."""
    clean = secrets.redact(wrapped(docs, doc_id=F.col("doc_id"), text=F.col("text")))
    old = lambda c: F.col("row")[c]
    changed = {"text": F.col("text"), "n_chars": F.when(old("text").eqNullSafe(F.col("text")), old("n_chars")).otherwise(F.length("text").cast("long"))}
    return clean.select(*[changed.get(c, old(c)).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, packed into sequences of 2048 tokens; null texts are empty, long ones are cut into pieces, an empty
    table gives no sequence."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("language ID", language), ("exact dedup", exact), ("MinHash near-dedup", near), ("secret scans", secret), ("best-fit packing", pack)]

#: Language ID, near-dedup, secrets and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. What a stage wrote on its way is deleted once its result is stored, and that result once the next one is;
    the last stage's input stays, as the packing that is returned still reads it."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = place(spark, name.replace(" ", "-"))
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            save(out, path)
        if before:
            delete(spark, before)
        docs, before = spark.read.schema(out.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
