"""MinHash near-duplicates with sequential Bayesian verification.

1. One Arrow pass turns each text into its distinct word shingles: their number, a 128-bit digest of
   the set, band keys and a signature of one byte per MinHash. Texts of equal sets form a class; only
   classes go on.
2. Equal band keys give buckets. A bucket is never expanded into all pairs: its members are held
   against a hub, the member that meets most others in its buckets.
3. A pair's signatures are compared batch by batch. After each batch the posterior probability
   (uniform prior) that the similarity reaches the threshold is bounded; a pair below the chosen
   miss probability goes. Survivors are confirmed on their full shingle sets; links are joined into
   components.
4. Buckets that still hold several components are searched for links between these, so that a hub
   hides none, each pair in the first band it shares. Small buckets (``SMALL``) give their plausible pairs, at most
   ``SMALL`` for a member, to the same confirmation. Large ones are cut into blocks of bounded bytes, members
   with their full sets; a task meets two blocks, confirms on the sets what the bounds leave, and
   gives out only links that join components it has not joined yet, fewer than it has members. So rows
   stay in proportion to members even where thousands of texts lie just under the threshold.
5. Each text gets the smallest id of its component.

Banding misses a pair exactly at 0.85 with probability 4e-7 (25 bands of 5), at 0.80 with 5e-8
(32 bands of 4); verification misses with at most ``miss`` per batch.

Null, empty and word-less texts have no shingles and no link; their component is their own id. A text
of fewer words than a shingle is one shingle. Repeated rows fall into one class. A row without id
is linked only through an equal text that has one. Ids may be of any type that can be compared; rows of
one id with different texts are different texts. Ties between hubs and between ids of one component go to the
smallest. Extra columns are not read. An empty table gives an empty result. A task holds a slice of texts or
two blocks, or the longest text.
"""

from __future__ import annotations

from math import lgamma, log, log1p, exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagelattice.llm import arrays
from pagelattice.llm.common import Scratch, scratch, ship, small
from pagelattice.llm.components import components
from pagelattice.session import cut_lineage

HASHES = 384
BATCH = 32
MISS = 1e-5
#: Members of a bucket that give their pairs to the common confirmation.
SMALL = 16
#: Members, and bytes of their sets, that a block of a larger bucket has about.
BLOCK = 2048
BLOCK_BYTES = 1 << 23
#: Rows of small buckets that a task looks at together.
GROUP = 4096
_SEEDS = np.random.default_rng(20).integers(1, 1 << 32, size=(2, HASHES), dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def least_matches(threshold: float, miss: float, hashes: int = HASHES, batch: int = BATCH) -> list[int]:
    """After each batch, the fewest agreeing hashes at which P(similarity >= threshold) >= miss.

    With a uniform prior and m of n agreeing, that probability is P(Binomial(n + 1, threshold) <= m).
    Hashes are kept as one byte, so that different ones agree once in 256.
    """
    threshold += (1 - threshold) / 256
    out = []
    for n in range(batch, hashes + 1, batch):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += exp(
                lgamma(n + 2) - lgamma(m + 1) - lgamma(n + 2 - m) + m * log(threshold) + (n + 1 - m) * log1p(-threshold)
            )
        out.append(m)
    return out


def bands_of(percent: int) -> tuple[int, int]:
    """(bands, hashes in a band)."""
    return (25, 5) if percent >= 85 else (32, 4)


def _signatures(values: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and one byte of each MinHash, per set."""
    low = values.astype(np.uint32)
    high = (values >> np.uint64(32)).astype(np.uint32)
    signature = np.empty((len(starts), HASHES), dtype=np.uint8)
    keys = np.zeros((len(starts), bands), dtype=np.uint64)
    a, b = np.empty_like(low), np.empty_like(low)
    for i in range(HASHES):
        np.multiply(low, _SEEDS[0, i], out=a)
        np.multiply(high, _SEEDS[1, i], out=b)
        np.add(a, b, out=a)
        least = np.minimum.reduceat(a, starts)
        # The low byte of a minimum is mixed, since low bits of a product are weak.
        signature[:, i] = (least * np.uint32(0x9E3779B1)) >> np.uint32(24)
        if i < bands * rows:
            band = i // rows
            keys[:, band] = arrays.mix(keys[:, band] * np.uint64(0xFF51AFD7ED558CCD) + least + np.uint64(band + 1))
    return keys, signature


def _distinct(words: arrays.Runs, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all rows, one after another, and the number of each row's."""
    values, row, _ = arrays.shingles(words, size)
    cuts = np.searchsorted(row, np.arange(words.rows + 1))
    sets = [np.unique(values[cuts[i] : cuts[i + 1]]) for i in range(words.rows)]
    return np.concatenate(sets) if sets else values, np.array([len(s) for s in sets], dtype=np.int64)


def _keys(values: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """A digest of each set that does not depend on order."""
    one = np.add.reduceat(arrays.mix(values ^ np.uint64(0x2545F4914F6CDD1D)), starts)
    two = np.add.reduceat(arrays.mix(values * np.uint64(0xA24BAED4963EE407)), starts)
    return [x.tobytes() for x in np.stack((one, two), axis=1)]


def _scan(size: int, bands: int, rows: int):
    """Arrow task: (``id``, ``mark``, ``text``) to set size, set digest, band keys and signature."""

    def run(batches):
        for batch in batches:
            raw, bounds = arrays.flat(batch.column("text"))
            for low, high in arrays.slices(bounds):
                words = arrays.Runs(raw, bounds[low : high + 1], arrays.INK)
                values, counts = _distinct(words, size)
                full = np.flatnonzero(counts)
                starts = (np.cumsum(counts) - counts)[full]
                columns = [np.full(high - low, None, dtype=object) for _ in range(3)]
                if len(full):
                    keys, signature = _signatures(values, starts, bands, rows)
                    columns[0][full] = _keys(values, starts)
                    columns[1][full] = [x.tobytes() for x in keys]
                    columns[2][full] = [x.tobytes() for x in signature]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id")[low:high], batch.column("mark")[low:high], pa.array(counts), *[pa.array(c, pa.binary()) for c in columns]],
                    names=["id", "mark", "n", "key", "bands", "sig"],
                )

    return run


def _sets(size: int):
    """Arrow task: (``id``, ``text``) to set digest and set."""

    def run(batches):
        for batch in batches:
            raw, bounds = arrays.flat(batch.column("text"))
            for low, high in arrays.slices(bounds):
                values, counts = _distinct(arrays.Runs(raw, bounds[low : high + 1], arrays.INK), size)
                full = np.flatnonzero(counts)
                starts = (np.cumsum(counts) - counts)[full]
                keys = _keys(values, starts) if len(full) else []
                sets = [values[s : s + n].tobytes() for s, n in zip(starts, counts[full])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id")[low:high].take(pa.array(full)), pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], names=["id", "key", "set"]
                )

    return run


def _alive(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows (``i`` of ``a``, ``j`` of ``b``) that no batch of hashes rules out."""
    matches = np.zeros(len(i), dtype=np.int64)
    for step, need in enumerate(least):
        part = slice(step * BATCH, (step + 1) * BATCH)
        matches = matches + (a[i, part] == b[j, part]).sum(axis=1)
        keep = matches >= need
        i, j, matches = i[keep], j[keep], matches[keep]
    return i, j


def _plausible(percent: int, miss: float):
    """Arrow task: keeps the pairs whose signatures do not rule the threshold out."""
    least = least_matches(percent / 100, miss)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, HASHES) for c in ("sig_u", "sig_v"))
                row = np.arange(batch.num_rows)
                yield batch.select(["u", "v"]).take(pa.array(_alive(a, b, row, row, least)[0]))

    return run


class _Members:
    """Rows of buckets as arrays."""

    def __init__(self, rows: pa.Table):
        self.node, self.component, self.size = (rows.column(c).to_numpy() for c in ("node", "component", "n"))
        self.sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)
        self.bands = np.frombuffer(b"".join(rows.column("bands").to_pylist()), np.uint64).reshape(len(self.node), -1)

    def plausible(self, at: int, others: np.ndarray, band: int, percent: int, least: list[int]) -> np.ndarray:
        """Those of ``others`` that may be linked to row ``at`` and share no band before ``band`` with it."""
        fits = 100 * np.minimum(self.size[others], self.size[at]) >= percent * np.maximum(self.size[others], self.size[at])
        others = others[fits]
        others = _alive(self.sig, self.sig, np.full(len(others), at), others, least)[1]
        return others[(self.bands[others] == self.bands[at]).argmax(axis=1) == band] if len(others) else others


def _pairs(u: list, v: list) -> pa.Table:
    u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (u, v))
    return pa.table({"u": np.maximum(u, v), "v": np.minimum(u, v)})


def _among(percent: int, miss: float):
    """Arrow group: members of whole small buckets to the plausible pairs of different components."""
    least = least_matches(percent / 100, miss)

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("bucket")
        members, bucket, band = _Members(rows), rows.column("bucket").to_numpy(), rows.column("band").to_numpy()
        ends = np.searchsorted(bucket, bucket, side="right")
        us, vs = [], []
        for at in range(len(bucket)):
            others = np.arange(at + 1, ends[at])
            others = others[members.component[others] != members.component[at]]
            if len(others):
                others = members.plausible(at, others, int(band[at]), percent, least)
                us.append(np.full(len(others), members.node[at]))
                vs.append(members.node[others])
        return _pairs(us, vs)

    return run


def _between(percent: int, miss: float):
    """Arrow group: two blocks of a large bucket to links that join their components, confirmed on full sets."""
    least = least_matches(percent / 100, miss)

    def run(rows: pa.Table) -> pa.Table:
        members, band = _Members(rows), rows.column("band")[0].as_py() if rows.num_rows else 0
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in rows.column("set")]
        block, same = rows.column("block").to_numpy(), rows.column("block_a")[0].as_py() == rows.column("block_b")[0].as_py()
        joined, us, vs = members.component.copy(), [], []
        for at in range(len(block)):
            later = np.arange(at + 1, len(block))
            others = later[(joined[later] != joined[at]) & (same | (block[later] != block[at]))]
            if not len(others):
                continue
            others = members.plausible(at, others, band, percent, least)
            if not len(others):
                continue
            held = np.concatenate([sets[j] for j in others])
            found = sets[at][np.minimum(np.searchsorted(sets[at], held), len(sets[at]) - 1)] == held
            starts = np.cumsum([0] + [len(sets[j]) for j in others[:-1]])
            shared = np.add.reduceat(found, starts)
            for j in others[100 * shared >= percent * (members.size[others] + members.size[at] - shared)]:
                if joined[j] != joined[at]:
                    us.append(members.node[[at]])
                    vs.append(members.node[[j]])
                    joined[joined == joined[j]] = joined[at]
        return _pairs(us, vs)

    return run


def _confirmed(percent: int):
    """Arrow task: pairs whose full sets reach the threshold, in whole numbers."""

    def run(batches):
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("set_u"), batch.column("set_v"))):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    keep.append(i)
            yield batch.select(["u", "v"]).take(pa.array(keep, pa.int64()))

    return run


def _sets_of(nodes: DataFrame, classes: DataFrame, docs: DataFrame, size: int, tables: Scratch) -> DataFrame:
    """The stored full set of every class in ``nodes``: (``node``, ``set``)."""
    wanted = tables.store(nodes.distinct().join(classes.select("node", "key", "rep"), "node"), "wanted")
    texts = docs.select("id", "text").join(small(wanted.select(F.col("rep").alias("id")).distinct(), wanted.count()), "id", "left_semi")
    kind = docs.schema["id"].dataType.simpleString()
    sets = texts.mapInArrow(_sets(size), f"id {kind}, key binary, set binary")
    sets = sets.join(wanted.withColumnRenamed("rep", "id"), ["id", "key"]).dropDuplicates(["node"]).select("node", "set")
    return tables.store(sets, "sets")


def _exact(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int, tables: Scratch) -> DataFrame:
    """The stored pairs (``u``, ``v``) of classes that are links by their full sets."""
    sets = _sets_of(pairs.select(F.col("u").alias("node")).union(pairs.select("v")), classes, docs, size, tables)
    side = lambda s: sets.select(F.col("node").alias(s), F.col("set").alias(f"set_{s}"))
    held = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "set_u", "set_v")
    return tables.store(held.mapInArrow(_confirmed(percent), "u bigint, v bigint"), "links")


def _split_buckets(met: DataFrame, whole: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int, miss: float, tables: Scratch) -> DataFrame:
    """Links between the components that buckets still hold: (``u``, ``v``)."""
    named = met.join(whole.withColumnRenamed("node", "c_node"), F.col("node") == F.col("c_node"), "left").select(
        "bucket", "band", "size", "node", F.coalesce("component", "node").alias("component")
    )
    named = tables.store(named, "named_members")
    split = named.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    # Stored, so that the join below may deal the members of one bucket over tasks.
    open_ = tables.store(named.join(tables.store(split.select("bucket"), "split"), "bucket", "left_semi"), "open")
    about = classes.select("node", "n", "bands", "sig")
    few = open_.where(F.col("size") <= SMALL)
    groups = 1 + few.count() // GROUP
    few = few.join(about, "node").withColumn("dealt", F.pmod(F.xxhash64("bucket"), F.lit(groups)))
    found = few.groupBy("dealt").applyInArrow(_among(percent, miss), "u bigint, v bigint")
    links = _exact(tables.store(found.distinct(), "between"), classes, docs, size, percent, tables)
    many = open_.where(F.col("size") > SMALL)
    if many.isEmpty():
        return links
    bytes_ = many.join(classes.select("node", "n"), "node").groupBy("bucket").agg(F.sum(8 * F.col("n")).alias("bytes"), F.count("*").alias("members"))
    blocks = bytes_.select("bucket", F.ceil(F.greatest(F.col("bytes") / BLOCK_BYTES, F.col("members") / BLOCK)).cast("int").alias("blocks"))
    sets = _sets_of(many.select("node"), classes, docs, size, tables)
    placed = many.join(tables.store(blocks, "blocks"), "bucket").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    placed = placed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "bucket", "band", "node", "component", "block", F.least("block", "other").alias("block_a"), F.greatest("block", "other").alias("block_b")
    )
    held = placed.join(about, "node").join(sets, "node")
    joined = held.groupBy("bucket", "block_a", "block_b").applyInArrow(_between(percent, miss), "u bigint, v bigint")
    return links.unionByName(tables.store(joined, "joined"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, miss: float) -> DataFrame:
    """Per row ``id``, ``mark`` of the text, ``n`` shingles, ``component`` (null without), least ``low`` (id, mark) of it."""
    spark = docs.sparkSession
    ship(spark)
    bands, rows = bands_of(percent)
    docs = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col, F.octet_length(text_col)).alias("mark"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    with scratch(spark) as tables:
        scanned = docs.mapInArrow(_scan(shingle, bands, rows), f"id {kind}, mark bigint, n bigint, key binary, bands binary, sig binary")
        scanned = tables.store(scanned, "signatures")
        members = scanned.select("id", "mark", "n", "key")
        classes = scanned.where("key is not null").groupBy("key").agg(
            F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")
        )
        # Numbered once and stored: the numbers name the classes from here on.
        classes = tables.store(classes.where("rep is not null").withColumn("node", F.monotonically_increasing_id()), "classes")
        cut = [F.struct(F.lit(i).alias("band"), F.xxhash64(F.lit(i), F.expr(f"substring(bands, {8 * i + 1}, 8)")).alias("bucket")) for i in range(bands)]
        banded = classes.select("node", F.inline(F.array(*cut)))
        sizes = tables.store(banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
        met = tables.store(banded.join(sizes, "bucket"), "met")
        scores = met.groupBy("node").agg(F.sum("size").alias("score"))
        met = tables.store(met.join(scores, "node"), "scored")
        hubs = tables.store(met.groupBy("bucket").agg(F.max_by("node", F.struct("score", -F.col("node"))).alias("hub")), "hubs")
        pairs = met.join(hubs, "bucket").where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct()
        side = lambda s: classes.select(F.col("node").alias(s), F.col("sig").alias(f"sig_{s}"), F.col("n").alias(f"n_{s}"))
        held = pairs.join(side("u"), "u").join(side("v"), "v").where(100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v"))
        held = held.select("u", "v", "sig_u", "sig_v").mapInArrow(_plausible(percent, miss), "u bigint, v bigint")
        links = _exact(tables.store(held, "plausible"), classes, docs, shingle, percent, tables)
        whole = tables.store(components(links, tables), "components")
        more = _split_buckets(met, whole, classes, docs, shingle, percent, miss, tables)
        # The new links tie whole components together.
        n_whole = whole.count()
        place = lambda s: small(whole.select(F.col("node").alias(s), F.col("component").alias(f"c_{s}")), n_whole)
        tied = more.join(place("u"), "u", "left").join(place("v"), "v", "left").select(F.coalesce("c_u", "u").alias("u"), F.coalesce("c_v", "v").alias("v"))
        tied = tables.store(components(tied, tables), "tied")
        higher = small(tied.select(F.col("node").alias("t_node"), F.col("component").alias("higher")))
        member_nodes = classes.select("key", "node").join(small(whole, n_whole), "node", "left").withColumn("component", F.coalesce("component", "node"))
        member_nodes = member_nodes.join(higher, F.col("component") == F.col("t_node"), "left").select("key", F.coalesce("higher", "component").alias("component"))
        named = tables.store(members.join(member_nodes, "key", "left").select("id", "mark", "n", "component"), "named")
        # Both come back as a stored table, so that the join may split a large component over tasks.
        lowest = named.where("component is not null and id is not null").groupBy("component").agg(F.min(F.struct("id", "mark")).alias("low"))
        lowest = tables.store(lowest, "lowest")
        return cut_lineage(named.join(lowest, "component", "left"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, miss: float = MISS
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``component_id``, ``kept``.

    Texts are linked when 100 * shared shingles >= ``percent`` * all their shingles.
    """
    alone = F.col("component").isNull()
    return _grouped(docs, id_col, text_col, shingle, percent, miss).select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("id")).otherwise(F.col("low.id")).alias("component_id"),
        (alone | F.col("id").eqNullSafe(F.col("low.id"))).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, miss: float = MISS) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, the one of smallest id; all columns kept.

    Rows are told apart by id and text, so a text goes for its own group alone. Rows that share both are one
    document, of which one row stays. Rows without id stay. Names that begin with ``_near`` are reserved.
    """
    found = _grouped(docs, id_col, text_col, shingle, percent, miss)
    # (id, mark) may stand in many rows; what goes is counted before it is broadcast.
    gone = found.where("id is not null and component is not null and (id <> low.id or mark <> low.mark)")
    gone = gone.select(F.col("id").alias("_near_id"), F.col("mark").alias("_near_mark")).distinct()
    mark = F.xxhash64(text_col, F.octet_length(text_col))
    left = docs.join(small(gone), (F.col(id_col) == F.col("_near_id")) & (mark == F.col("_near_mark")), "left_anti")
    again = found.where("id is not null").groupBy("id", "mark").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("_near_id"), F.col("mark").alias("_near_mark"))
    if again.isEmpty():
        return left
    same = (F.col(id_col) == F.col("_near_id")) & (mark == F.col("_near_mark"))
    twice = left.join(again, same, "left_semi").withColumn("_near_mark", mark).dropDuplicates([id_col, "_near_mark"]).drop("_near_mark")
    return left.join(again, same, "left_anti").unionByName(twice)
