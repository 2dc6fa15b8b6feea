"""Consistent-hash ring with virtual nodes and bounded loads.

The ring has ``2 ** RING_BITS`` cells. Every shard has ``VNODES`` virtual nodes on it, placed by hash, and takes
the keys of the cells between each and the node before. A cell may hold nodes of several shards, in the
order of the rest of their hashes, so every shard owns nodes however many there are. Rows are counted per cell; a walk around
the ring fills each shard up to its bound, and keys over the bound continue clockwise to the next
shard with room. With bounds of floor and ceiling of the mean, row counts differ by at most one.
The counts are ``2 ** RING_BITS`` numbers whatever the input, so they alone visit the driver; they
come back as a look-up table of the same bound. All row work is built-in functions.

A cell with many rows, for example one key repeated without end, is ranked in parts: rows are dealt
to parts by a row number, parts are counted, and a row's place is the part's start plus its rank
within the part. No task gets a cell or a shard whole.

A null text has no bytes; null keys share one place of the ring. Repeated rows are placed one by one.
An empty table gives an empty result. Other columns pass through, but for ``shard`` and ``slot``; names beginning with ``_ring``
are reserved.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, functions as F

from pagelattice.llm.common import small
from pagelattice.session import scratch_path

RING_BITS = 14
VNODES = 128
#: Rows of a cell that one task ranks.
PART_ROWS = 50_000


def ring(shards: int, bits: int = RING_BITS, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(cell, shard) of all virtual nodes in ring order."""
    places = sorted((int.from_bytes(hashlib.md5(f"{shard}/{v}".encode()).digest()[:8], "big"), shard) for shard in range(shards) for v in range(vnodes))
    return [(place >> (64 - bits), shard) for place, shard in places]


def cell_of(key: Column, bits: int = RING_BITS) -> Column:
    """The cell of a key: the first bits of its MD5."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.shiftright(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), 32 - bits).cast("int")


def fill(counts: dict[int, int], shards: int, bits: int = RING_BITS, bounds: list[int] | None = None) -> list[tuple[int, int, int, int]]:
    """(cell, rows to skip, shard, rows to take) in ring order, no shard over its bound."""
    nodes = ring(shards, bits)
    cells = [c for c, _ in nodes]
    total = sum(counts.values())
    room = list(bounds) if bounds else [total // shards + (s < total % shards) for s in range(shards)]
    if sum(room) < total:
        raise ValueError(f"bounds hold {sum(room)} of {total} rows")
    out = []
    # The next node of a shard with room, from each node on; full shards are passed over once.
    following = list(range(1, len(nodes))) + [0]

    def open_node(node: int) -> int:
        passed = []
        while not room[nodes[node][1]]:
            passed.append(node)
            node = following[node]
        for at in passed:
            following[at] = node
        return node

    for cell in sorted(counts):
        node, left, skipped = bisect_left(cells, cell) % len(nodes), counts[cell], 0
        while left:
            node = open_node(node)
            shard = nodes[node][1]
            take = min(left, room[shard])
            out.append((cell, skipped, shard, take))
            room[shard] -= take
            left, skipped = left - take, skipped + take
    return out


def assign(docs: DataFrame, shards: int, key_col: str = "doc_id", bits: int = RING_BITS) -> DataFrame:
    """``docs`` with ``shard`` and ``slot`` (gapless from 0 within the shard).

    Rows are numbered once and stored in the shared folder, so that a lost executor cannot deal
    them differently the second time.
    """
    spark = docs.sparkSession
    marked = docs.withColumn("_ring_cell", cell_of(F.col(key_col), bits)).withColumn("_ring_row", F.monotonically_increasing_id())
    path = scratch_path(spark, "ring")
    marked.write.parquet(path)
    marked = spark.read.schema(marked.schema).parquet(path)
    counts = {r[0]: r[1] for r in marked.groupBy("_ring_cell").agg(F.count("*")).collect()}
    taken: dict[int, int] = {}
    table: dict[int, list] = {}
    for cell, skip, shard, take in fill(counts, shards, bits):
        start = taken.get(shard, 0)
        table.setdefault(cell, []).append({"lo": skip, "hi": skip + take, "shard": shard, "base": start - skip})
        taken[shard] = start + take
    rows = [{"c": c, "parts": -(-counts[c] // PART_ROWS), "takes": t} for c, t in table.items()]
    lookup = spark.range(1).select(
        F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<c:int,parts:int,takes:array<struct<lo:bigint,hi:bigint,shard:int,base:bigint>>>>"))
    ).withColumnsRenamed({"c": "_ring_cell", "parts": "_ring_parts", "takes": "_ring_takes"})
    dealt = marked.join(F.broadcast(lookup), "_ring_cell").withColumn("_ring_part", F.pmod(F.xxhash64("_ring_row"), "_ring_parts").cast("int"))
    parts = dealt.groupBy("_ring_cell", "_ring_part").agg(F.count("*").alias("_ring_n"))
    starts = parts.select(
        "_ring_cell", "_ring_part",
        F.expr("coalesce(sum(_ring_n) over (partition by _ring_cell order by _ring_part rows between unbounded preceding and 1 preceding), 0)").alias("_ring_start"),
    )
    ranked = dealt.withColumn(
        "_ring_rank", F.expr("row_number() over (partition by _ring_cell, _ring_part order by _ring_row) - 1")
    ).join(small(starts, sum(r["parts"] for r in rows)), ["_ring_cell", "_ring_part"])
    place = F.col("_ring_start") + F.col("_ring_rank")
    taken_by = F.filter("_ring_takes", lambda t: (t["lo"] <= place) & (place < t["hi"]))[0]
    placed = ranked.withColumn("_ring_take", taken_by).withColumn("_ring_place", place)
    return placed.select(
        *[c for c in docs.columns if c not in ("shard", "slot")],
        F.col("_ring_take.shard").alias("shard"),
        (F.col("_ring_place") + F.col("_ring_take.base")).alias("slot"),
    )
