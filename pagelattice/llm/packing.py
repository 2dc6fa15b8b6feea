"""Packing token ids into windows by Karmarkar-Karp multiway differencing.

Each task tokenises its rows and gathers pieces: whole windows of long texts stand alone, what remains
is cut into pieces of at most ``PIECE`` ids. Every ``GROUP`` windows' worth of pieces is partitioned:
each piece starts as a partition with one loaded window; the two partitions of largest imbalance are
merged again and again, fullest windows with emptiest; the last one has near-equal windows. If one is
over capacity, the group is partitioned anew into one window more. Groups are closed within a
task, so nothing is shuffled and memory is that of one group, however large the table, a text apart.

A null or empty text is one end id. Repeated rows are packed one by one. An empty table gives an
empty result. Columns other than id and text are not read. A task packs its rows in the order
read, so a task run again gives the same windows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pagelattice.llm import arrays
from pagelattice.llm.bpe import encoder
from pagelattice.llm.common import ship

CAPACITY = 4096
PIECE = 1024
GROUP = 128
END_ID = 2


def _merged(a: list, b: list, windows: int) -> list:
    """Two partitions as one: windows sorted from fullest, absent ones empty; fullest meets emptiest."""
    overlap = len(a) + len(b) - windows
    if overlap <= 0:
        joined = a + b
    else:
        # b from its emptiest window: after windows - len(b) empty ones come its real ones, smallest first.
        first = windows - len(b)
        joined = a[:first] + [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[first:], b[::-1])] + b[::-1][overlap:]
    joined.sort(key=lambda w: -w[0])
    return joined


def differencing(lengths: list[int], windows: int) -> list[tuple[int, object]]:
    """``windows`` near-equal windows of the lengths, each (sum, nested pairs of item numbers)."""
    heap = []
    for i, length in enumerate(lengths):
        heapq.heappush(heap, (-length if windows > 1 else 0, i, [(length, i)]))
    count = len(lengths)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        joined = _merged(a, b, windows)
        spread = joined[0][0] - (joined[-1][0] if len(joined) == windows else 0)
        heapq.heappush(heap, (-spread, count, joined))
        count += 1
    return heap[0][2] if heap else []


def items(tree: object) -> Iterator[int]:
    stack = [tree]
    while stack:
        node = stack.pop()
        if isinstance(node, tuple):
            stack.extend(node)
        else:
            yield node


def partition(lengths: list[int], capacity: int) -> list[list[int]]:
    """Item numbers of each window; one window more as long as one is over capacity."""
    windows = -(-sum(lengths) // capacity)
    while True:
        found = differencing(lengths, windows) if lengths else []
        if not found or found[0][0] <= capacity:
            return [sorted(items(tree)) for _, tree in found]
        windows += 1


class _Packer:
    def __init__(self, capacity: int, base: int):
        self.capacity, self.next = capacity, base
        self.waiting: list[tuple] = []  # (id, start, ids, doc_tokens)
        self.held = 0
        self.rows: list[tuple] = []

    def add(self, doc: object, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.capacity:
            self._emit(doc, start, ids[start : start + self.capacity], total, 0)
            self.next += 1
            start += self.capacity
        rest = total - start
        if rest:
            limit = min(PIECE, self.capacity)
            for part in np.array_split(ids[start:], -(-rest // limit)):
                self.waiting.append((doc, start, part.copy(), total))
                start += len(part)
            self.held += rest
        if self.held >= GROUP * self.capacity:
            self.close()

    def _emit(self, doc, start, ids, total, offset) -> None:
        self.rows.append((doc, start, len(ids), ids.astype("<u4").tobytes(), total, self.next, offset))

    def close(self) -> None:
        for window in partition([len(w[2]) for w in self.waiting], self.capacity):
            offset = 0
            for i in window:
                doc, start, ids, total = self.waiting[i]
                self._emit(doc, start, ids, total, offset)
                offset += len(ids)
            self.next += 1
        self.waiting, self.held = [], 0

    def batch(self, kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * 7
        self.rows = []
        types = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids`` (little-endian 32-bit), ``doc_tokens``,
    ``sequence_id``, ``offset``. ``tokenizer`` is the vocabulary's path on the executors."""
    ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        encode = encoder(tokenizer)
        packer, kind = _Packer(capacity, TaskContext.get().partitionId() << 40), pa.int64()
        for batch in batches:
            kind = batch.column("id").type
            _, bounds = arrays.flat(batch.column("text"))
            for low, high in arrays.slices(bounds):
                names = batch.column("id")[low:high].to_pylist()
                ids, counts = encode.encode(batch.column("text")[low:high].to_pylist())
                at = 0
                for name, count in zip(names, counts):
                    packer.add(name, np.append(ids[at : at + count], END_ID))
                    at += count
                if packer.rows:
                    yield packer.batch(kind)
        packer.close()
        yield packer.batch(kind)

    id_type = docs.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    return docs.mapInArrow(run, schema).withColumnRenamed("id", id_col)
