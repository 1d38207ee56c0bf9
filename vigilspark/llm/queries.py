"""The registered queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_tree, exact_dedup, language_id, lm_score, matrices, merkle, near_dedup, packing, periods, pieces, secrets, url_filter, vectors
from .common import shared_dir


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(read(spark, sf_dir, "documents"), words=3, threshold=0.85)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predictions(read(spark, sf_dir, "documents"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(read(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"))


def op8_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written, then read back for the digests."""
    out = f"{shared_dir(spark)}/matrices-{uuid.uuid4().hex}"
    matrices.write_matrices(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), out)
    return matrices.read_matrices(spark, out).select(
        "sequence_id", "n_tokens", "doc_ids", "pieces", "cu_seqlens", F.crc32("ids").alias("ids_crc32"), F.crc32("position_ids").alias("positions_crc32")
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(read(spark, sf_dir, "embeddings"), threshold=0.93)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(read(spark, sf_dir, "documents"))


def op12_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.round_trip(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.report(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_best_fit_packing, op2_minhash_near_dedup, op3_language_id, op4_secret_scans, op5_exact_dedup,
        op6_sentencepiece, op7_url_filters, op8_token_matrices, op9_lm_scoring, op10_vector_near_dedup,
        op11_merkle_manifest, op12_bpe_tree, op13_periodic_runs,
    )
    return {f.__name__: f for f in found}


OP5_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256
FROM t
"""



def op11_sql(levels: int = 8, above: int = 3) -> str:
    """Every level of the trees as a table of its own: up to 8 ** levels documents of a language and 8 ** above languages."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(cast({c} AS varchar)) || ':' || {c} END"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    run = "OVER (PARTITION BY t, p // 8 ORDER BY p ROWS BETWEEN"

    def tree(name: str, depth: int) -> str:
        """name0 (t, p, h) upwards: name<k>s has each node's siblings, name<k> the next level; a lone node stays as it is."""
        out = ""
        for k in range(depth):
            out += f""",
{name}{k}s AS (SELECT *, count(*) OVER (PARTITION BY t) > 1 AS many, coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
        coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM {name}{k}),
{name}{k + 1} AS (SELECT t, p // 8 AS p, CASE WHEN max(many) THEN sha256(string_agg(h, '' ORDER BY p)) ELSE max(h) END AS h FROM {name}{k}s GROUP BY t, p // 8)"""
        return out

    joins = "".join(f" JOIN l{k}s ON l{k}s.t = l0.t AND l{k}s.p = l0.p // {8**k}" for k in range(levels)) + "".join(f" JOIN u{k}s ON u{k}s.p = u0.p // {8**k}" for k in range(above))
    steps = [f"l{k}s" for k in range(levels)] + [f"u{k}s" for k in range(above)]
    folds = ", f0 AS (SELECT *, claimed AS f FROM paths)"
    for k, s in enumerate(steps):
        folds += f", f{k + 1} AS (SELECT * REPLACE (CASE WHEN {s}_many THEN sha256({s}_a || f || {s}_b) ELSE f END AS f) FROM f{k})"
    crc = "list_reduce([4294967295] || list_transform(string_split(cast(doc_id AS varchar), ''), lambda c: cast(ascii(c) AS bigint)), lambda x, c: list_reduce([xor(x, c)] || range(8), lambda y, i: xor(y >> 1, (y & 1) * 3988292384)))"
    return f"""
WITH d AS (SELECT *, coalesce('=' || lang, '') AS t, coalesce(xor({crc}, 4294967295) % 3 = 0, false) AS tampered, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_text FROM documents),
h AS (SELECT doc_id, t, {leaf("text")} AS h, CASE WHEN tampered THEN {leaf("lower_text")} ELSE {leaf("text")} END AS claimed FROM d),
l0 AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, h) - 1 AS p FROM h){tree("l", levels)},
u0 AS (SELECT '' AS t, t AS of_t, row_number() OVER (ORDER BY t) - 1 AS p, h FROM l{levels}){tree("u", above)},
paths AS (SELECT l0.doc_id, l0.h AS leaf, l0.claimed, u0.h AS subroot, (SELECT h FROM u{above}) AS root, {", ".join(f"{s}.a AS {s}_a, {s}.b AS {s}_b, {s}.many AS {s}_many" for s in steps)}
          FROM l0 JOIN u0 ON u0.of_t = l0.t{joins}){folds}
SELECT doc_id, leaf, subroot, root, sha256({" || ".join(f"{s}_a || {s}_b" for s in steps)}) AS proof_sha256, f AS folded_root, f = root AS verified FROM f{len(steps)}
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": OP5_SQL, "op11_merkle_manifest": op11_sql()}
