"""Wildcard URL rules as one bit-parallel automaton.

Each rule is a glob over the canonical form of a URL, ``.host#path``: ``*`` stands for any text, all
else for itself. Only ``#`` parts host and path, since neither can contain it; so ``*.org#/*`` fits
a host and its subdomains and nothing in a path. All globs are packed one after another into the
bits of a multiword mask. One Shift-And step per character moves all of them for a whole column of
URLs at once:

    D = (((D << 1) | start) & B[c]) | (D & loop)

``B[c]`` has the positions that character c may enter, ``loop`` those before a ``*``, which stay.
The longest rule among the matches decides; of equally long ones the first in the list.

A null URL or one without ``://`` has an empty host and path and falls to the default verdict, as do
URLs that no rule fits. Repeated rows give one result row each; an empty table an empty result.
Steps follow the longest URL of a batch, and finished URLs leave the batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pagelattice.llm import arrays
from pagelattice.llm.common import ship

_WORD = 64


@dataclass(frozen=True)
class Rule:
    verdict: str
    name: str
    glob: str
    weight: int


def host_rule(verdict: str, name: str) -> Rule:
    """A rule written ``host/path``: fits the host and its subdomains where the path starts so."""
    host, slash, path = name.partition("/")
    return Rule(verdict, name, f"*.{host}#{slash}{path}*", len(name))


#: Host and path rules of the query.
RULES = [
    host_rule("allow", "org/"),
    host_rule("block", "example.org/es/"),
    host_rule("block", "example.org/en/1"),
    host_rule("allow", "com/fr/"),
    host_rule("block", "com/de/"),
]

#: Globs without a name, for URLs that no named rule fits: file types that hold no prose.
OWN_RULES = [Rule("block", "", f"*.{kind}", 0) for kind in "jpg jpeg png gif zip exe pdf mp4".split()]


class Automaton:
    def __init__(self, rules: list[Rule]):
        self.rules = rules
        places = [[(c, star) for c, star in _parsed(rule.glob)] for rule in rules]
        bits = sum(len(p) + 1 for p in places)
        self.words = max(1, -(-bits // _WORD))
        self.enter = np.zeros((256, self.words), dtype=np.uint64)
        self.start, self.loop = np.zeros(self.words, np.uint64), np.zeros(self.words, np.uint64)
        self.final, at = [], 0
        for glob in places:
            # Bit ``at`` is the state before the first character; it is set at the start.
            self._set(self.start, at)
            for c, star in glob:
                if star:
                    self._set(self.loop, at)
                else:
                    at += 1
                    self._set(self.enter[c], at)
            self.final.append((at // _WORD, np.uint64(1 << (at % _WORD))))
            at += 1

    @staticmethod
    def _set(mask: np.ndarray, bit: int) -> None:
        mask[bit // _WORD] |= np.uint64(1 << (bit % _WORD))

    def matches(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Boolean (row, rule)."""
        lengths = np.diff(bounds)
        state = np.tile(self.start, (len(lengths), 1))
        order = np.argsort(-lengths, kind="stable")
        longest = lengths[order]
        one, carry = np.uint64(1), np.uint64(_WORD - 1)
        for step in range(int(longest[0]) if len(longest) else 0):
            rows = order[: int(np.searchsorted(-longest, -step, side="left"))]
            now = state[rows]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> carry
            state[rows] = (moved & self.enter[raw[bounds[rows] + step]]) | (now & self.loop)
        return np.stack([(state[:, w] & bit) != 0 for w, bit in self.final], axis=1) if self.final else np.zeros((len(lengths), 0), bool)


def _parsed(glob: str) -> list[tuple[int, bool]]:
    return [(byte, byte == 0x2A) for byte in glob.encode()]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #``, A-Z lower-cased; path: then up to ``? #``."""
    known = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    rest = F.expr("substr(_url, instr(_url, '://') + 3)")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    empty = F.lit("")
    return F.when(known, F.translate(host, upper, upper.lower())).otherwise(empty), F.when(known, path).otherwise(empty)


def url_verdicts(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[Rule] = RULES, own: list[Rule] = OWN_RULES, default: str = "allow"
) -> DataFrame:
    """Per row: id, ``host``, ``path``, the named ``rule`` that decides (or null) and the ``verdict``."""
    ship(pages.sparkSession)
    parts = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("_url"))
    host, path = host_and_path(F.col("_url"))
    parts = parts.select("id", host.alias("host"), path.alias("path"))
    ranked = sorted(rules, key=lambda r: -r.weight) + list(own)

    def run(batches):
        automaton = Automaton(ranked)
        names = np.array([r.name or None for r in ranked] + [None], dtype=object)
        verdicts = np.array([r.verdict for r in ranked] + [default], dtype=object)
        for batch in batches:
            raw, bounds = arrays.flat(batch.column("canonical"))
            for low, high in arrays.slices(bounds):
                hit = automaton.matches(raw, bounds[low : high + 1])
                first = np.where(hit.any(axis=1), hit.argmax(axis=1), len(ranked)) if ranked else np.zeros(high - low, int)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i)[low:high] for i in range(3)]
                    + [pa.array(names[first], pa.string()), pa.array(verdicts[first], pa.string())],
                    names=["id", "host", "path", "rule", "verdict"],
                )

    kind = parts.schema["id"].dataType.simpleString()
    canonical = parts.withColumn("canonical", F.concat(F.lit("."), "host", F.lit("#"), "path"))
    return canonical.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)
