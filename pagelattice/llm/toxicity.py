"""Toxicity: a logistic classifier with a counterfactual penalty.

The score is a logistic function of the words and word beginnings present in the whole text: inflected
and compound forms share their beginning. Training minimises the log
loss of labelled texts, a quadratic penalty on the weights, and ``COUNTERFACTUAL`` times the mean
squared change of the score's argument when identity terms are swapped for others, with all their
beginnings: a text that
mentions a group must score like the same text about another group, so mentions by themselves
stop counting.

Labels are learned from at most about ``SAMPLE`` rows, drawn by a hash of the id, never from held-out
rows. Words are chosen by how unevenly toxic and other rows use them, at most ``WORDS`` of them,
plus all identity terms; these counts are made in Spark. The chosen words of the sample, a bounded
table, are fitted on the driver. Scoring reads every text whole, in Arrow tasks.

Null and empty texts score by the bias alone. Without labelled rows of both kinds all words weigh
nothing and the score is the share of toxic rows (0.0 without rows). Repeated rows are scored one by
one; labels repeated for an id count as often as they stand; rows without a label or text teach
nothing. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pagelattice.llm import arrays
from pagelattice.llm.common import scratch, ship

SAMPLE = 20_000
WORDS = 8192
#: How many standard errors apart a word's shares among toxic and other rows must be.
LEAST_Z = 4.0
#: Weight of the quadratic penalty, per labelled row.
RIDGE = 0.3
COUNTERFACTUAL = 1.0
STEPS = 300
#: Bytes of the word beginnings that are features besides whole words.
BEGINNINGS = (4, 5, 6, 7, 8, 10)

#: Groups of terms that may stand for one another.
IDENTITY_TERMS = [
    "women men girls boys".split(),
    "woman man girl boy".split(),
    "muslims christians jews hindus buddhists atheists".split(),
    "muslim christian jewish hindu buddhist atheist".split(),
    "black white asian latino african european american".split(),
    "gay lesbian straight bisexual transgender queer".split(),
    "immigrants refugees foreigners natives citizens".split(),
    "frauen männer".split(),
    "muslime christen juden".split(),
    "femmes hommes".split(),
    "musulmans chrétiens juifs".split(),
    "mujeres hombres".split(),
    "musulmanes cristianos judíos".split(),
]


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _term_hashes(terms: list[str]) -> np.ndarray:
    raw, bounds = arrays.flat(pa.array(terms, pa.string()))
    return arrays.Runs(raw, bounds, arrays.ALNUM).hashes()


def _present(batch: pa.RecordBatch):
    """Per slice: row numbers and hashes of all words and of their beginnings."""
    raw, bounds = arrays.flat(batch.column("text"))
    for low, high in arrays.slices(bounds):
        words = arrays.Runs(raw, bounds[low : high + 1], arrays.ALNUM)
        rows, hashes = [words.row], [words.hashes()]
        for size in BEGINNINGS:
            at = np.flatnonzero(words.end - words.start > size)
            rows.append(words.row[at])
            hashes.append(arrays.mix(arrays.span_hashes(words.data, words.start[at], words.start[at] + size)))
        yield low, high, np.concatenate(rows), np.concatenate(hashes)


def _counts(batches):
    """Partial counts of rows and toxic rows that hold each word."""
    for batch in batches:
        toxic = np.asarray(batch.column("toxic").to_pylist(), dtype=np.int64)
        for low, high, row, hashes in _present(batch):
            word, at = np.unique(hashes, return_inverse=True)
            once = np.unique(at * (high - low) + row)
            at, row = once // (high - low), once % (high - low)
            n = np.bincount(at, minlength=len(word)).astype(np.int64)
            t = np.bincount(at, weights=toxic[low:high][row], minlength=len(word)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n), pa.array(t)], names=["word", "n", "t"])


def _features(vocabulary: np.ndarray):
    """(row, feature) pairs of a slice, each once."""

    def find(row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(vocabulary, hashes), max(len(vocabulary) - 1, 0))
        good = vocabulary[at] == hashes if len(vocabulary) else np.zeros(len(hashes), bool)
        code = np.unique(row[good] * len(vocabulary) + at[good]) if len(vocabulary) else np.zeros(0, np.int64)
        return code // max(len(vocabulary), 1), code % max(len(vocabulary), 1)

    return find


def _rows(vocabulary: np.ndarray):
    find, swap = _features(vocabulary), _swap_rows(IDENTITY_TERMS, vocabulary)

    def run(batches):
        for batch in batches:
            swaps = swap([batch])
            for low, high, row, hashes in _present(batch):
                r, f = find(row, hashes)
                cuts = np.searchsorted(r, np.arange(high - low + 1))
                lists = [f[cuts[i] : cuts[i + 1]].astype(np.int32).tobytes() for i in range(high - low)]
                _, _, other, named = next(swaps)
                swapped = [o.tobytes() if m else None for o, m in zip(other, named)]
                yield pa.RecordBatch.from_arrays([batch.column("toxic")[low:high], pa.array(lists, pa.binary()), pa.array(swapped, pa.binary())], names=["toxic", "features", "swapped"])

    return run


def _forms(terms: list[str]) -> list[np.ndarray]:
    """Per term the hashes of all features a word of it has: itself and its beginnings."""
    forms = [np.zeros(0, np.uint64)] * len(terms)
    for _, _, row, hashes in _present(pa.RecordBatch.from_arrays([pa.array(terms, pa.string())], names=["text"])):
        forms = [hashes[row == i] for i in range(len(terms))]
    return forms


def _swap_rows(terms: list[list[str]], vocabulary: np.ndarray):
    """Per batch of texts that hold identity terms: features before and after the swap."""
    find, words = _features(vocabulary), [w for g in terms for w in g]
    own = np.concatenate([_term_hashes([w]) for w in words])
    order = np.argsort(own)
    forms = _forms(words)
    partner = np.concatenate([np.roll(np.arange(len(g)), -1) + sum(len(h) for h in terms[:k]) for k, g in enumerate(terms)])
    size = np.array([len(f) for f in forms])
    offset, flat_forms = np.concatenate(([0], np.cumsum(size)))[:-1], np.concatenate(forms)

    def run(batches):
        for batch in batches:
            raw, bounds = arrays.flat(batch.column("text"))
            for low, high in arrays.slices(bounds):
                runs = arrays.Runs(raw, bounds[low : high + 1], arrays.ALNUM)
                hashes = runs.hashes()
                at = order[np.minimum(np.searchsorted(own, hashes, sorter=order), len(own) - 1)]
                term = own[at] == hashes
                rows, found = [runs.row[~term]], [hashes[~term]]
                for length in BEGINNINGS:
                    longer = np.flatnonzero(~term & (runs.end - runs.start > length))
                    rows.append(runs.row[longer])
                    found.append(arrays.mix(arrays.span_hashes(runs.data, runs.start[longer], runs.start[longer] + length)))
                new = partner[at[term]]
                index = np.repeat(offset[new] - np.concatenate(([0], np.cumsum(size[new])))[:-1], size[new]) + np.arange(size[new].sum())
                rows.append(np.repeat(runs.row[term], size[new]))
                found.append(flat_forms[index])
                r, f = find(np.concatenate(rows), np.concatenate(found))
                cuts = np.searchsorted(r, np.arange(high - low + 1))
                yield low, high, [f[cuts[i] : cuts[i + 1]].astype(np.int32) for i in range(high - low)], np.bincount(runs.row[term], minlength=high - low) > 0

    return run


def swap_differences(rows: list[np.ndarray], swapped: list[np.ndarray | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Sparse (pair, feature, +-1) of each row minus the row with its identity terms swapped."""
    pair, feature, sign, pairs = [], [], [], 0
    for row, other in zip(rows, swapped):
        if other is None:
            continue
        lost, new = np.setdiff1d(row, other), np.setdiff1d(other, row)
        pair += [pairs] * (len(lost) + len(new))
        feature += [*lost, *new]
        sign += [1.0] * len(lost) + [-1.0] * len(new)
        pairs += 1
    return np.array(pair, np.int64), np.array(feature, np.int64), np.array(sign), pairs


def fit(rows: list[np.ndarray], toxic: np.ndarray, size: int, swapped: list[np.ndarray | None], penalty: float = COUNTERFACTUAL, ridge: float = RIDGE, steps: int = STEPS):
    """Weights and bias by Adam over the whole bounded sample."""
    n = len(rows)
    ridge = ridge / max(n, 1)
    share = float(np.mean(toxic)) if n else 0.0
    weights = np.zeros(size)
    if n == 0 or share in (0.0, 1.0):
        return weights, np.log((share + 1e-6) / (1 - share + 1e-6))
    lengths = np.array([len(r) for r in rows])
    row, feature = np.repeat(np.arange(n), lengths), np.concatenate(rows).astype(np.int64)
    pair, term, sign, pairs = swap_differences(rows, swapped)
    bias, moment, square = np.log(share / (1 - share)), np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        score = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights[feature], n) + bias, -40, 40)))
        off = (score - toxic) / n
        gradient = np.append(np.bincount(feature, off[row], size) + ridge * weights, off.sum())
        if pairs:
            change = np.bincount(pair, sign * weights[term], pairs)
            gradient[:size] += 2 * penalty / pairs * np.bincount(term, sign * change[pair], size)
        moment = 0.9 * moment + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        move = 0.1 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - move[:size], bias - move[size]
    return weights, bias


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, penalty: float = COUNTERFACTUAL):
    """(sorted word hashes, weights, bias), a model of bounded size."""
    ship(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where(
        F.col("toxic").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id"))
    )
    total = known.count()
    if total > sample:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * sample / total))
    with scratch(docs.sparkSession) as tables:
        texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
        drawn = tables.store(texts.join(F.broadcast(known), "id").select("toxic", "text"), "sample")
        sums = drawn.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
        n, t = int(sums[0]), int(sums[1])
        terms = [_term_hashes(g) for g in IDENTITY_TERMS]
        chosen = np.zeros(0, np.uint64)
        if 0 < t < n:
            used = drawn.mapInArrow(_counts, "word bigint, n bigint, t bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).where("n >= 2")
            gap = F.abs(F.col("t") / t - (F.col("n") - F.col("t")) / (n - t))
            spread = F.sqrt((F.col("n") / n) * (1.0001 - F.col("n") / n) * (1 / t + 1 / (n - t)))
            uneven = used.withColumn("z", gap / spread).where(F.col("z") >= LEAST_Z)
            best = uneven.orderBy(F.desc("z"), "word").limit(WORDS).select("word").collect()
            chosen = np.array([r[0] for r in best], dtype=np.int64).view(np.uint64)
        vocabulary = np.unique(np.concatenate([chosen, *terms]))
        rows = drawn.mapInArrow(_rows(vocabulary), "toxic int, features binary, swapped binary").collect()
    features = [np.frombuffer(r[1], np.int32) for r in rows]
    swapped = [None if r[2] is None else np.frombuffer(r[2], np.int32) for r in rows]
    weights, bias = fit(features, np.array([r[0] for r in rows], dtype=float), len(vocabulary), swapped, penalty)
    return vocabulary, weights, bias


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``held_out``, ``score``, ``predicted``."""
    ship(docs.sparkSession)
    vocabulary, weights, bias = model
    find = _features(vocabulary)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            for low, high, row, hashes in _present(batch):
                r, f = find(row, hashes)
                total = np.bincount(r, weights[f], high - low) + bias
                value = 1 / (1 + np.exp(-np.clip(total, -40, 40)))
                yield pa.RecordBatch.from_arrays([batch.column("id")[low:high], pa.array(value)], names=["id", "score"])

    kind = docs.schema["id"].dataType.simpleString()
    scored = docs.mapInArrow(run, f"id {kind}, score double")
    return scored.select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def drop_toxic(docs: DataFrame, model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows predicted toxic, row by row, all columns kept."""
    ship(docs.sparkSession)
    vocabulary, weights, bias = model
    find = _features(vocabulary)

    def run(batches):
        for batch in batches:
            total = np.zeros(batch.num_rows)
            for low, high, row, hashes in _present(pa.RecordBatch.from_arrays([batch.column(text_col)], names=["text"])):
                r, f = find(row, hashes)
                total[low:high] = np.bincount(r, weights[f], high - low) + bias
            yield batch.filter(pa.array(total < 0))

    return docs.mapInArrow(run, docs.schema)
