"""Quality rules on repetition by suffix arrays.

Words of a text are its letters. Suffixes of all texts of a slice are sorted by prefix doubling, each
text apart; the ranks of every doubling give the longest common prefix of neighbours. A suffix's
longest match in its own text is the larger of its two neighbours' prefixes: the maximal repeated
substrings are the intervals of these. Their spans of at least ``MIN_REPEAT`` words are united;
a text is rejected if they cover more than ``MAX_COVERED`` of its words, or if the longest repeat is
more than ``MAX_LONGEST`` of them. Fewer than ``MIN_WORDS`` words, or more than half the words in
repeated 3-word windows, also reject.

A null text has no words and is rejected as too short. Repeated rows give one result row each; an
empty table gives an empty result. Other columns are not read. Memory follows the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagelattice.llm import arrays
from pagelattice.llm.common import ship

WINDOW = 3
MIN_WORDS = 50
MIN_REPEAT = 8
MAX_COVERED = 0.4
MAX_LONGEST = 0.3

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def longest_repeats(letters: np.ndarray, row: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest run from there that also starts elsewhere in its row.

    ``letters`` are numbers from 0, ``row`` ascends, ``ends`` is the end of each position's row.
    """
    n = len(letters)
    if n == 0:
        return np.zeros(0, np.int64)
    key = row.astype(np.int64) * (int(letters.max()) + 1) + letters
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.append(True, sorted_key[1:] != sorted_key[:-1])
    group = np.flatnonzero(new)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.repeat(group, np.diff(np.append(group, n)))
    levels, step = [rank.astype(np.int32)], 1
    size = np.diff(np.append(group, n))
    active = order[np.repeat(size > 1, size)]
    while len(active):
        nxt = active + step
        second = np.where(nxt < ends[active], rank[np.minimum(nxt, n - 1)] + 1, 0)
        # Active positions are in rank order already; sort within equal ranks by what follows.
        pair = rank[active] * (n + 1) + second
        by = np.argsort(pair, kind="stable")
        active, pair = active[by], pair[by]
        old = rank[active]
        new_old = np.flatnonzero(np.append(True, old[1:] != old[:-1]))
        new_pair = np.append(True, pair[1:] != pair[:-1])
        start = np.flatnonzero(new_pair)
        count = np.diff(np.append(start, len(active)))
        old_start = np.repeat(new_old, np.diff(np.append(new_old, len(active))))
        rank = rank.copy()
        rank[active] = old + np.repeat(start, count) - old_start
        active = active[np.repeat(count > 1, count)]
        levels.append(rank.astype(np.int32))
        step *= 2
    suffixes = np.empty(n, dtype=np.int64)
    suffixes[rank] = np.arange(n)
    here, there = suffixes[:-1], suffixes[1:]
    pairs = np.flatnonzero(levels[0][here] == levels[0][there])
    here, there = here[pairs].copy(), there[pairs].copy()
    common = np.zeros(len(pairs), dtype=np.int64)
    limit_a, limit_b = ends[here], ends[there]
    for level in range(len(levels) - 2, -1, -1):
        length = 1 << level
        inside = (here + length <= limit_a) & (there + length <= limit_b)
        same = inside & (levels[level][np.minimum(here, n - 1)] == levels[level][np.minimum(there, n - 1)])
        common += same * length
        here += same * length
        there += same * length
    best = np.zeros(n, dtype=np.int64)
    np.maximum.at(best, suffixes[:-1][pairs], common)
    np.maximum.at(best, suffixes[1:][pairs], common)
    return best


def _covered(row: np.ndarray, starts: np.ndarray, lengths: np.ndarray, n: int, rows: int) -> np.ndarray:
    """Words per row in the union of the spans."""
    depth = np.zeros(n + 1, dtype=np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, starts + lengths, -1)
    return np.bincount(row[np.cumsum(depth[:-1]) > 0], minlength=rows)


def _measure(min_repeat: int):
    def run(batches):
        for batch in batches:
            raw, bounds = arrays.flat(batch.column("text"))
            for low, high in arrays.slices(bounds):
                words = arrays.Runs(raw, bounds[low : high + 1], arrays.INK, lower=False)
                rows, data, n = words.rows, words.data, len(words.start)
                per_row = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[words.bounds])
                chars = per_row(arrays.INK[data] & ((data & 0xC0) != 0x80))
                symbols = per_row(_SYMBOL[data])
                letters = np.unique(words.hashes(), return_inverse=True)[1]
                ends = words.first[words.row + 1] if n else np.zeros(0, np.int64)
                best = longest_repeats(letters, words.row, ends)
                triple = np.flatnonzero(best >= WINDOW)
                repeated = _covered(words.row, triple, np.full(len(triple), WINDOW), n, rows)
                span = np.flatnonzero(best >= min_repeat)
                covered = _covered(words.row, span, best[span], n, rows)
                longest = np.zeros(rows, dtype=np.int64)
                np.maximum.at(longest, words.row, best)
                # Lines between newlines, equal to an earlier one of their text.
                breaks = np.zeros(len(data) + 1, dtype=bool)
                breaks[1:] = data == 10
                breaks[words.bounds] = True
                breaks[-1] = False
                line = np.flatnonzero(breaks)
                line_row = np.searchsorted(words.bounds, line, side="right") - 1
                line_end = np.append(line[1:], len(data))[: len(line)]
                line_end = np.where((line_end > line) & (data[line_end - 1] == 10), line_end - 1, line_end) if len(line) else line_end
                full = np.searchsorted(words.start, line_end) > np.searchsorted(words.start, line)
                line, line_end, line_row = line[full], line_end[full], line_row[full]
                hashes = arrays.span_hashes(data, line, line_end)
                order = np.lexsort((hashes, line_row))
                again = (hashes[order][1:] == hashes[order][:-1]) & (line_row[order][1:] == line_row[order][:-1])
                duplicates = np.bincount(line_row[order][1:][again], minlength=rows)
                columns = [words.count, chars, symbols, duplicates, repeated, covered, longest]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id")[low:high], *[pa.array(c.astype(np.int64)) for c in columns]],
                    names=["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"],
                )

    return run


def repetition_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST
) -> DataFrame:
    """Per row: id, the counts, ``covered_words``, ``longest_repeat``, ``base_failed``, ``kept``."""
    ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    counts = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, covered_words bigint, longest_repeat bigint"
    measured = docs.mapInArrow(_measure(min_repeat), f"id {kind}, {counts}")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fine = (F.col("covered_words") <= max_covered * F.col("n_words")) & (F.col("longest_repeat") <= max_longest * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & fine).withColumnRenamed("id", id_col)
