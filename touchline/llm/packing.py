"""Packing of token streams into windows by multiway Karmarkar-Karp differencing."""
from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.tokens import encoder

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, tokens binary"
ROW = pa.schema([(c.split()[0], pa.binary() if c.endswith("binary") else pa.int64()) for c in SCHEMA.split(", ")])
#: Documents that a task holds as Python strings at once.
STEP = 500


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Split ``sizes`` into ``windows`` groups of near-equal sums; returns item indices by group.

    Each item starts as a partial partition (itself and empty groups). The two partitions with the largest spread are
    merged, the fullest group of one with the emptiest of the other, until one is left. Partitions keep only their
    non-empty groups in ascending order; the empty ones are implied. Ties are broken by creation order.
    """
    heap = []
    for i, size in enumerate(sizes):
        heapq.heappush(heap, (-size, i, [(size, [i])]))
    made = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        # ascending a meets descending b: with w groups, group j of a joins group w-1-j of b
        full_a, full_b = len(a), len(b)
        merged = []
        overlap = full_a + full_b - windows
        if overlap <= 0:
            merged = a + b
        else:
            merged = a[overlap:] + b[overlap:]
            for j in range(overlap):
                x, y = a[j], b[overlap - 1 - j]
                merged.append((x[0] + y[0], x[1] + y[1]))
        merged.sort(key=lambda g: g[0])
        least = merged[0][0] if len(merged) == windows else 0
        heapq.heappush(heap, (least - merged[-1][0], made, merged))
        made += 1
    groups = [g[1] for g in heap[0][2]] if heap else []
    return groups + [[] for _ in range(windows - len(groups))]


def near_equal_windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """The fewest near-equal windows tried that hold everything: one more whenever a window exceeds ``capacity``."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        groups = differencing(sizes, windows)
        if all(sum(sizes[i] for i in g) <= capacity for g in groups):
            return [g for g in groups if g]
        windows += 1


class Packer:
    """Pieces of one partition's documents; a group of pieces is packed when it fills ``group`` windows."""

    def __init__(self, capacity: int, piece: int, group: int, slack: int, first_sequence: int):
        self.capacity, self.piece = capacity, piece
        self.target = group * (capacity - slack)
        self.sequence = first_sequence
        self.waiting: list[tuple] = []
        self.total = 0
        self.rows: list[tuple] = []

    def _place(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, doc_tokens, ids in pieces:
            self.rows.append((doc, start, len(ids), doc_tokens, self.sequence, offset, ids.tobytes()))
            offset += len(ids)
        self.sequence += 1

    def _pack(self, capacity: int) -> None:
        for window in near_equal_windows([len(p[3]) for p in self.waiting], capacity):
            self._place([self.waiting[i] for i in window])
        self.waiting, self.total = [], 0

    def add(self, doc, ids: np.ndarray) -> None:
        """Full windows of a long document stand alone; its rest waits in pieces for the next group."""
        n, at = len(ids), 0
        while n - at >= self.capacity:
            self._place([(doc, at, n, ids[at : at + self.capacity])])
            at += self.capacity
        while at < n:
            take = min(self.piece, n - at, self.target - self.total)
            self.waiting.append((doc, at, n, ids[at : at + take]))
            self.total += take
            at += take
            if self.total == self.target:
                self._pack(self.capacity)

    def finish(self) -> None:
        """The last group fills its windows but for a rest, which needs no padding at powers of two."""
        rest, pieces = self.total % self.capacity, self.waiting
        body = self.total - rest
        parts: list[list[tuple]] = [[]]
        room = [body] if body else []
        room += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        at = 0
        for doc, start, n, ids in pieces:
            while len(ids):
                take = min(len(ids), room[at])
                parts[-1].append((doc, start, n, ids[:take]))
                room[at] -= take
                start, ids = start + take, ids[take:]
                if not room[at]:
                    at += 1
                    parts.append([])
        if body:
            self.waiting = parts.pop(0)
            self._pack(self.capacity)
        for part in parts:
            if part:
                self._place(part)

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(ROW)], schema=ROW)


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, piece: int = 128, group: int = 64, slack: int = 4) -> DataFrame:
    """Token pieces of every document with their place in a sequence of at most ``window`` tokens.

    ``docs`` needs doc_id and text; further columns are ignored. A document is its ids (special tokens not added) and
    then ``end_id``; a null or empty text is ``end_id`` alone. Repeated rows are packed each, null ids are kept. Each
    partition is packed as it streams by, without a shuffle: windows of a long document go out whole, rests are cut into
    pieces of at most ``piece`` tokens, and every ``group`` windows' worth of pieces is split near-equally. ``slack`` is
    the mean number of free tokens a window leaves the differencing to even out. ``tokens`` holds little-endian
    unsigned 32-bit ids. An empty table gives no rows. Sequence ids are unique, with gaps between partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window, piece, group, slack, TaskContext.get().partitionId() << 33)
        encode = encoder(tokenizer).encode
        for batch in batches:
            for a in range(0, len(batch), STEP):
                part = batch.slice(a, STEP)
                for doc, ids in zip(part["doc_id"].to_pylist(), encode(part["text"].to_pylist())):
                    packer.add(doc, np.append(ids, np.uint32(end_id)).astype("<u4"))
                yield packer.take()
        packer.finish()
        yield packer.take()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def digests(pieces: DataFrame) -> DataFrame:
    """The piece table with a checksum in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
