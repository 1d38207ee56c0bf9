"""Packed token-id matrices (operator 8): best-fit-decreasing packing with a segment tree over capacities.

Each task packs what it reads in buffers of a fixed number of tokens, so ids are never shuffled, memory is bounded and
a lost task is simply run again. A buffer of B sequences leaves at most a fraction of one sequence unused.

Defined cases: null or empty text is a document of the end id alone; overlong documents of any length are cut into
consecutive pieces without loss; repeated rows and null or repeated ids are documents of their own; pieces of equal
length are placed in the order read; an empty table gives no sequences; other columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_small_batches
from .tokens import byte_bpe

CAPACITY = 2048
#: Tokens that a task holds before it packs them.
BUFFER = 4_000_000

MATRICES = "sequence_id long, ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, pieces array<int>, n_tokens int"


class Rooms:
    """A segment tree over rooms 0..capacity: how many open bins have each room; finds the smallest room that fits."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, b: int, by: int = 1) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += by
            at >>= 1
        if by > 0:
            self.bins[room].append(b)

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, bin) with the smallest room of at least need."""
        at = need + self.leaves
        while not self.count[at]:
            while at & 1:  # a right child: what lies right of it is under an ancestor's sibling
                at >>= 1
                if at <= 1:
                    return None
            at += 1
        while at < self.leaves:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.leaves
        b = self.bins[room].pop()
        self.add(room, b, -1)
        return room, b


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions of lengths, longest first, each into the bin with the smallest room that fits."""
    rooms, bins = Rooms(capacity), []
    for i in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        room, b = rooms.take(lengths[i]) or (capacity, len(bins))
        if b == len(bins):
            bins.append([])
        bins[b].append(i)
        rooms.add(room - lengths[i], b)
    return bins


def packed_matrices(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, buffer: int = BUFFER) -> DataFrame:
    """One row per sequence: ids (capacity little-endian uint32, padded with end_id), cumulative segment lengths
    from 0, positions that restart with each segment (uint16, 0 in the padding), and each segment's document and piece."""

    if capacity > 1 << 16:
        raise ValueError("positions are written as 16-bit numbers")

    def run(batches):
        first, made = TaskContext.get().partitionId() << 40, 0
        bpe, end = byte_bpe(path), np.array([end_id], "<u4").tobytes()
        held, tokens, ramp = [], 0, np.arange(capacity, dtype="<u2").tobytes()

        def packed():
            nonlocal made
            rows = []
            for b in best_fit_decreasing([len(x[2]) // 4 for x in held], capacity):
                parts = [held[i] for i in b]
                sizes = [len(x[2]) // 4 for x in parts]
                used = sum(sizes)
                positions = b"".join([ramp[: 2 * n] for n in sizes]) + bytes(2 * (capacity - used))
                cu = [0, *accumulate(sizes)]
                rows.append((first + made, b"".join(x[2] for x in parts) + end * (capacity - used), cu, positions, [x[0] for x in parts], [x[1] for x in parts], used))
                made += 1
            return pd.DataFrame(rows, columns=["sequence_id", "ids", "cu_seqlens", "position_ids", "doc_ids", "pieces", "n_tokens"])

        for pdf in batches:
            keys = [None if pd.isna(k) else int(k) for k in pdf["_id"]]
            for key, raw in zip(keys, bpe.encode(pdf["_text"].tolist()), strict=True):
                ids = raw + end
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[at : at + 4 * capacity]
                    if tokens + len(piece) // 4 > buffer and held:
                        yield packed()
                        held, tokens = [], 0
                    held.append((key, n, piece))
                    tokens += len(piece) // 4
        if held:
            yield packed()

    return in_small_batches(docs).select(F.col("doc_id").cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("_text")).mapInPandas(run, MATRICES)


def write_matrices(docs: DataFrame, path: str, out: str, **options) -> None:
    """Write the matrices as Parquet (zstd: the positions, which start anew with each segment, shrink to almost nothing)."""
    writer = packed_matrices(docs, path, **options).write.mode("overwrite").option("compression", "zstd")
    writer.option("parquet.compression.codec.zstd.level", "1").option("parquet.enable.dictionary", "false").parquet(out)


def read_matrices(spark: SparkSession, out: str) -> DataFrame:
    """What write_matrices wrote, one row per sequence."""
    return spark.read.schema(MATRICES).parquet(out)


def as_matrix(pdf: pd.DataFrame, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """The ids and the positions of some rows, each as a matrix."""
    return tuple(np.frombuffer(b"".join(pdf[c]), t).reshape(-1, capacity) for c, t in (("ids", "<u4"), ("position_ids", "<u2")))
