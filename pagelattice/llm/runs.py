"""Runs of words that repeat with a period, found by recursive frequency splitting and a lag scan.

A run is a stretch of words with smallest period q, of at least ``max(least, 2 * q)`` words, that no
neighbouring word extends with that period. Words a whole number of periods after a run's first q words
are copies; the collapsed text leaves them out.

1. Splitting. Every word of a run stands there twice or more. A word that stands once in its
   segment, at first the whole text, is therefore in no run and splits the segment; segments under ``least``
   words go. The parts are split again, by what stands once in them, until nothing changes. Links to the
   previous and the next equal word tell this for all words of a slice of texts at once. Rounds
   look at changed segments only, up to ``ROUNDS`` times the words of the slice: splitting
   spares work and decides nothing, what is left over is scanned like the rest.
2. Lag scan. A run of period q agrees with itself, moved by q words, over ``max(least, 2 * q) - q``
   words or more, so it covers one of the anchors spaced by that number. All lags of all segments
   are scanned at their anchors, n log n of them, as arrays. Where word and moved word agree, the
   agreement is followed both ways by exact block numbers (prefix doubling), a few steps each way
   however long the run.
3. The same stretch found with several lags is one run with the least of them, since its other lags are
   multiples of its smallest period.

Texts without words, null ones included, have no runs and an empty collapsed text. Words are
case-sensitive runs of all but ASCII white space. Repeated rows give one result row each. A tie for the
longest run goes to the smallest start, then the smallest period. Extra columns are not read. An
empty table gives an empty result. Memory follows a slice of a few megabytes, or the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagelattice.llm import arrays
from pagelattice.llm.common import ship

LEAST = 12
ROUNDS = 64
#: Anchors looked at as one array.
ANCHORS = 1 << 21


def letters_of(words: arrays.Runs) -> np.ndarray:
    """A number for each word, equal for equal bytes."""
    total = len(words.start)
    if not total:
        return np.zeros(0, dtype=np.int64)
    lengths = words.end - words.start
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    ink = words.data[np.repeat(words.start - offsets[:-1], lengths) + np.arange(offsets[-1])]
    column = pa.Array.from_buffers(pa.large_binary(), total, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ink)])
    return column.dictionary_encode().indices.to_numpy().astype(np.int64)


def _links(letters: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the previous and next equal word of the same text; -1 and a large number if none."""
    n = len(letters)
    before, after = np.full(n, -1), np.full(n, n)
    order = np.lexsort((letters, row))
    same = (letters[order][1:] == letters[order][:-1]) & (row[order][1:] == row[order][:-1])
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    return before, after


def split(letters: np.ndarray, row: np.ndarray, first: np.ndarray, least: int = LEAST, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the segments that may hold runs; ``first`` bounds the texts."""
    before, after = _links(letters, row)
    low, high = first[:-1], first[1:]
    wide = high - low >= least
    low, high = low[wide], high[wide]
    done, work = [], rounds * len(letters)
    while len(low):
        size = high - low
        work -= int(size.sum())
        if work < 0:
            done.append((low, high))
            break
        upto = np.cumsum(size)
        at = np.arange(upto[-1]) + np.repeat(low - (upto - size), size)
        stays = (before[at] >= np.repeat(low, size)) | (after[at] < np.repeat(high, size))
        # Stretches of words that stay, each within its segment.
        edge = np.zeros(len(at) + 1, dtype=bool)
        edge[upto] = edge[0] = True
        begins = np.flatnonzero(stays & (edge[:-1] | ~np.append(False, stays[:-1])))
        ends = np.flatnonzero(stays & (edge[1:] | ~np.append(stays[1:], False))) + 1
        segment = np.searchsorted(upto, begins, side="right")
        whole = ends - begins == size[segment]
        wide = ends - begins >= least
        new_low = at[begins]
        new_high = new_low + (ends - begins)
        done.append((new_low[whole], new_high[whole]))
        low, high = new_low[~whole & wide], new_high[~whole & wide]
    if not done:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, high = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(low)
    return low[order], high[order]


class Blocks:
    """Numbers of blocks of 1, 2, 4 ... words: equal numbers for equal blocks, whatever their place."""

    def __init__(self, letters: np.ndarray):
        n = len(letters)
        self.levels, width = [letters], 1
        while 2 * width <= n:
            last = self.levels[-1]
            left, right = last[: n - 2 * width + 1], last[width:]
            # Only blocks whose halves stand twice can stand twice; others keep no number.
            active = np.flatnonzero((left >= 0) & (right >= 0))
            pair = left[active] * (int(last.max()) + 1) + right[active]
            level = np.full(n - 2 * width + 1, -1, dtype=np.int64)
            if not len(pair):
                break
            _, number, count = np.unique(pair, return_inverse=True, return_counts=True)
            if count.max() < 2:
                break
            again = count[number] > 1
            level[active[again]] = number[again]
            self.levels.append(level)
            width *= 2

    def _equal(self, k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the blocks of 2 ** k words from ``a`` and ``b`` exist and are equal."""
        level = self.levels[k]
        fits = (b >= 0) & (a >= 0) & (np.maximum(a, b) < len(level))
        x = level[np.where(fits, a, 0)]
        return fits & (x >= 0) & (x == level[np.where(fits, b, 0)])

    def forward(self, a: np.ndarray, b: np.ndarray, room: np.ndarray) -> np.ndarray:
        """Words from ``a`` and from ``b`` on that agree, at most ``room``."""
        done = np.zeros(len(a), dtype=np.int64)
        # The largest blocks may follow one another.
        active = np.arange(len(a))
        top = len(self.levels) - 1
        while len(active):
            step = 1 << top
            fits = done[active] + step <= room[active]
            same = fits & self._equal(top, a[active] + done[active], b[active] + done[active])
            active = active[same]
            done[active] += step
        for k in range(top - 1, -1, -1):
            step = 1 << k
            same = (done + step <= room) & self._equal(k, a + done, b + done)
            done[same] += step
        return done

    def backward(self, a: np.ndarray, b: np.ndarray, room: np.ndarray) -> np.ndarray:
        """Words before ``a`` and before ``b`` that agree, at most ``room``."""
        done = np.zeros(len(a), dtype=np.int64)
        active = np.arange(len(a))
        top = len(self.levels) - 1
        while len(active):
            step = 1 << top
            fits = done[active] + step <= room[active]
            same = fits & self._equal(top, a[active] - done[active] - step, b[active] - done[active] - step)
            active = active[same]
            done[active] += step
        for k in range(top - 1, -1, -1):
            step = 1 << k
            same = (done + step <= room) & self._equal(k, a - done - step, b - done - step)
            done[same] += step
        return done


def _lags(low: np.ndarray, high: np.ndarray, least: int):
    """Blocks of (segment, lag, number of anchors): all lags a run in the segment may have."""
    most = (high - low) // 2
    upto = np.cumsum(most)
    for begin in range(0, int(upto[-1]) if len(upto) else 0, ANCHORS):
        pair = np.arange(begin, min(begin + ANCHORS, int(upto[-1])))
        segment = np.searchsorted(upto, pair, side="right")
        lag = pair - (upto - most)[segment] + 1
        size = (high - low)[segment]
        fits = np.maximum(least, 2 * lag) <= size
        segment, lag, size = segment[fits], lag[fits], size[fits]
        gap = np.maximum(least - lag, lag)
        count = (size - lag - 1) // gap + 1
        total = np.cumsum(count)
        start = 0
        while start < len(lag):
            base = total[start - 1] if start else 0
            stop = max(int(np.searchsorted(total, base + ANCHORS, side="right")), start + 1)
            yield segment[start:stop], lag[start:stop], gap[start:stop], count[start:stop]
            start = stop


def runs_of(letters: np.ndarray, row: np.ndarray, first: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of every run of the texts, by start, then period."""
    low, high = split(letters, row, first, least)
    # Segments one after another; a word's place in the text is its place here plus ``moved``.
    size = high - low
    upto = np.cumsum(size)
    packed_low = upto - size
    at = np.arange(upto[-1] if len(upto) else 0) + np.repeat(low - packed_low, size)
    _, own = np.unique(letters[at], return_inverse=True)
    own = own.astype(np.int64)
    blocks = None
    found = []
    for segment, lag, gap, count in _lags(low, high, least):
        which = np.repeat(np.arange(len(lag)), count)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        here = packed_low[segment][which] + nth * gap[which]
        there = here + lag[which]
        hit = own[here] == own[there]
        here, there, which = here[hit], there[hit], which[hit]
        if not len(here):
            continue
        blocks = blocks or Blocks(own)
        begin, end = packed_low[segment[which]], upto[segment[which]]
        on = blocks.forward(here, there, end - there)
        back = blocks.backward(here, there, here - begin)
        enough = on + back >= gap[which]
        start, stop, period = (here - back)[enough], (there + on)[enough], lag[which][enough]
        # Anchors of one run follow one another.
        if len(start):
            new = np.append(True, (start[1:] != start[:-1]) | (stop[1:] != stop[:-1]) | (period[1:] != period[:-1]))
            found.append(np.stack((start[new], stop[new], period[new])))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, stop, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, stop, start))
    start, stop, period = start[order], stop[order], period[order]
    least_lag = np.append(True, (start[1:] != start[:-1]) | (stop[1:] != stop[:-1]))
    start, stop, period = start[least_lag], stop[least_lag], period[least_lag]
    moved = np.repeat(low - packed_low, size)[start]
    start, stop = start + moved, stop + moved
    order = np.lexsort((period, start))
    return start[order], stop[order], period[order]


def _collapse(least: int):
    """Arrow task: (``id``, ``text``) to word count, runs and collapsed text."""
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def task(batches):
        for batch in batches:
            raw, bounds = arrays.flat(batch.column("text"))
            for low, high in arrays.slices(bounds):
                words = arrays.Runs(raw, bounds[low : high + 1], arrays.INK, lower=False)
                start, stop, period = runs_of(letters_of(words), words.row, words.first, least)
                # Words after the first period of a run.
                depth = np.zeros(len(words.start) + 1, dtype=np.int64)
                np.add.at(depth, start + period, 1)
                np.add.at(depth, stop, -1)
                kept = np.cumsum(depth[:-1]) == 0
                # Kept words with a space after each but the last of a text.
                first, last, row = words.start[kept], words.end[kept], words.row[kept]
                length = last - first + 1
                offsets = np.concatenate(([0], np.cumsum(length)))
                source = np.arange(offsets[-1]) + np.repeat(first - offsets[:-1], length)
                spaced = np.append(words.data, np.uint8(32))[source] if len(source) else np.zeros(0, np.uint8)
                spaced[offsets[1:] - 1] = 32
                of_row = np.searchsorted(row, np.arange(words.rows + 1))
                filled = np.diff(of_row) > 0
                # The space after a text's last word goes.
                drop = offsets[of_row[1:][filled]] - 1
                spaced = np.delete(spaced, drop)
                ends = offsets[of_row] - np.concatenate(([0], np.cumsum(filled)))
                text = pa.Array.from_buffers(pa.large_string(), words.rows, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(spaced))])
                run_row = words.row[start] if len(start) else start
                run_bounds = np.searchsorted(run_row, np.arange(words.rows + 1)).astype(np.int32)
                runs = pa.StructArray.from_arrays([pa.array(start - words.first[run_row] if len(start) else start), pa.array(stop - start), pa.array(period)], fields=list(run_type))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id")[low:high], pa.array(words.count.astype(np.int64)), pa.ListArray.from_arrays(pa.array(run_bounds), runs), text.cast(pa.string())],
                    names=["id", "n_words", "runs", "collapsed"],
                )

    return task


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """Per row: id, ``n_words``, ``runs`` (array of start, length and period, in words) and ``collapsed``."""
    ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return docs.mapInArrow(_collapse(least), schema).withColumnRenamed("id", id_col)
