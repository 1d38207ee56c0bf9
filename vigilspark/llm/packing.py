"""Best-fit packing with swap-based local search (operator 1).

Spark side: tokenize each document in place, keep one thin row per piece (id, length, checksum; never the ids), write
those rows once, deal them evenly into groups of a few thousand by a salt that does not depend on any key, and pack each
group on its own. A group loses at most a fraction of one sequence against the volume bound, so thousands of groups
cost little and no group grows with the data.

The search has no limit on steps or on documents of a bin; its work is bounded by its neighbourhood. Exchanges are found
by size, not by bin: a bin offers each different sum of one or two documents once, bins of equal room are one row of a
table, and a pass visits every underfull bin once.

Defined cases: null or empty text is a document of the end id alone; repeated rows and null or repeated ids are packed
once per row; documents longer than a sequence, whatever their length, are cut into full sequences, the first piece
taking what is left over; of exchanges that leave a taker equally full the one of smallest size given, then of the
smallest room is made; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, lean, stash
from .tokens import byte_bpe

CAPACITY = 2048
#: Documents of a packing group, on average.
GROUP = 8192
#: Groups that a task packs, on average, at most.
GROUPS_A_TASK = 16

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of each document: start, length and checksum of its ids."""

    def run(batches):
        part, n = TaskContext.get().partitionId() << 40, 0
        bpe, end = byte_bpe(path), np.array([end_id], "<u4").tobytes()
        for pdf in batches:
            rows = []
            for key, raw in zip(pdf["_id"], bpe.encode(pdf["_text"].tolist()), strict=True):
                ids = raw + end
                total = len(ids) // 4
                first = (total - 1) % capacity + 1
                at = 0
                for k, stop in enumerate(range(first, total + 1, capacity)):
                    rows.append((key, k, at, stop - at, zlib.crc32(ids[4 * at : 4 * stop]), part + n))
                    at, n = stop, n + 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "salt"]).astype({"doc_id": "Int64"})
        bpe.forget()

    return in_small_batches(docs).select(F.col(id_col).cast("long").alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text")).mapInPandas(lean(run), PIECES)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each item goes to the fullest bin that it fits. Bins hold positions of lengths."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # a bit for each room that some bin has
    for i in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        need = lengths[i]
        fits = rooms >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            b, room = len(bins), capacity
            bins.append([])
        bins[b].append(i)
        by_room[room - need].append(b)
        rooms |= 1 << (room - need)
    return bins


class Underfull:
    """Bins with room, and for each room and each size the smallest size from there on that some bin of that room can
    give back for a document or two: one of its documents, two of them, or nothing (a move)."""

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.bins, self.lengths, self.capacity = bins, lengths, capacity
        self.fill = [sum(lengths[i] for i in b) for b in bins]
        self.sums: list[dict[int, list[int]]] = [{} for _ in bins]
        self.by_room: dict[int, dict[int, None]] = {}
        self.next = np.zeros((capacity, capacity + 2), np.int32)
        self.old = np.ones(capacity, bool)  # rooms whose row of next is out of date

    def options(self, b: int) -> dict[int, list[int]]:
        """The sums of one or two of a bin's documents; equal sums count once, so there are at most capacity."""
        one = {self.lengths[i]: i for i in self.bins[b]}
        twice = {n: i for i in self.bins[b] if i != one[n := self.lengths[i]]}
        sums = {n: [i] for n, i in one.items()}
        sizes = [*one]
        for k, m in enumerate(sizes):
            if m in twice:
                sums.setdefault(2 * m, [one[m], twice[m]])
            for n in sizes[k + 1 :]:
                sums.setdefault(m + n, [one[m], one[n]])
        return sums

    def add(self, b: int) -> None:
        room = self.capacity - self.fill[b]
        if 0 < room < self.capacity:
            self.sums[b] = self.options(b)
            self.by_room.setdefault(room, {})[b] = None
            self.old[room] = True

    def remove(self, b: int) -> None:
        room = self.capacity - self.fill[b]
        if b in self.by_room.get(room, ()):
            del self.by_room[room][b]
            if not self.by_room[room]:
                del self.by_room[room]
            self.old[room] = True

    def row(self, room: int) -> None:
        sizes = np.unique([0, *(n for b in self.by_room[room] for n in self.sums[b])])
        at = np.searchsorted(sizes, np.arange(self.capacity + 2))
        self.next[room] = np.append(sizes, 2 * self.capacity)[at]
        self.old[room] = False

    def step(self, d: int) -> tuple[int, list[int], list[int]] | None:
        """The exchange from bin d, which is not among the others now, that leaves its taker fullest:
        (taker, given, taken back), or None. Takers are at least as full as d."""
        rooms = np.array([r for r in self.by_room if r <= self.capacity - self.fill[d]], np.int64)
        if not len(rooms):
            return None
        for r in rooms[self.old[rooms]]:
            self.row(int(r))
        give = self.options(d)
        sizes = np.fromiter(give, np.int64, len(give))
        best = (self.capacity + 1, 0, 0, 0)
        for part in np.array_split(sizes, max(1, len(sizes) * len(rooms) // 1_000_000)):
            back = self.next[rooms[None], np.maximum(part[:, None] - rooms[None], 0)]
            left = np.where(back < part[:, None], rooms[None] - part[:, None] + back, self.capacity + 1)
            k, r = np.unravel_index(left.argmin(), left.shape)
            best = min(best, (int(left[k, r]), int(part[k]), int(rooms[r]), int(back[k, r])))
        left, size, room, back = best
        if left > self.capacity:
            return None
        taker = next(b for b in self.by_room[room] if not back or back in self.sums[b])
        return taker, give[size], self.sums[taker][back] if back else []


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Swap-based local search on the bins with room: moves of one or two documents and exchanges of one or two for one
    or two, each of which makes a bin fuller at the cost of an emptier one, so that the sum of squared fills grows.

    A pass drains the bins from the emptiest on, each until it is empty or can give nothing; passes go on while the last
    one emptied a bin and more bins than the volume needs are left. There is no other limit: a drain ends as it takes
    tokens from its bin at every step, and a pass looks at each bin once.
    """
    bins = [[*b] for b in bins]
    pool = Underfull(bins, lengths, capacity)
    least = -(-sum(pool.fill) // capacity)
    live = sum(1 for f in pool.fill if f)
    for b in range(len(bins)):
        pool.add(b)
    emptied = True
    while emptied and live > least:
        emptied = False
        for d in sorted((b for r in pool.by_room.values() for b in r), key=lambda b: (pool.fill[b], b)):
            pool.remove(d)
            while pool.fill[d] and live > least and (found := pool.step(d)):
                taker, give, back = found
                pool.remove(taker)
                bins[d] = [i for i in bins[d] if i not in give] + back
                bins[taker] = [i for i in bins[taker] if i not in back] + give
                gain = sum(lengths[i] for i in give) - sum(lengths[i] for i in back)
                pool.fill[d], pool.fill[taker] = pool.fill[d] - gain, pool.fill[taker] + gain
                pool.add(taker)
                if not pool.fill[d]:
                    live, emptied = live - 1, True
            pool.add(d)
            if live <= least:
                break
    return [b for b in bins if b]


def pack_group(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of positions: full items alone, the others by best fit, then local search among the underfull bins."""
    full = [[i] for i, n in enumerate(lengths) if n == capacity]
    rest = [i for i, n in enumerate(lengths) if n < capacity]
    own = [lengths[i] for i in rest]
    packed = local_search(best_fit(own, capacity), own, capacity)
    return full + [[rest[i] for i in b] for b in packed]


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, group: int = GROUP) -> DataFrame:
    """Every piece with its sequence and its place there; sequences hold at most capacity tokens and have no gaps."""
    thin = stash(pieces(docs, path, capacity, end_id), "pieces")
    groups = max(1, -(-thin.count() // group))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("salt", ignore_index=True)
        bins = pack_group(pdf["length"].tolist(), capacity)
        order = np.fromiter((i for b in bins for i in b), np.int64, len(pdf))
        out = pdf.iloc[order].reset_index(drop=True)
        number = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        ends = out["length"].groupby(number).cumsum()
        out["sequence_id"] = (int(pdf["_group"].iloc[0]) << 32) + number
        out["offset"] = ends - out["length"]
        return out[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]].astype({"doc_id": "Int64"})

    # A named number of partitions: packing is slow for its bytes, so small partitions must not be joined into one task.
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-groups // GROUPS_A_TASK))
    dealt = thin.withColumn("_group", F.pmod(F.xxhash64("salt"), F.lit(groups))).repartition(tasks, "_group")
    return dealt.groupBy("_group").applyInPandas(place, PACKED)
