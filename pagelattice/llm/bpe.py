"""Token ids of whole batches with a public word BPE vocabulary, exact and cached by chunk of text.

The vocabulary's normaliser and splitter treat white space as a border, so a text's ids are those of
its chunks between spaces and newlines. Chunks repeat a great deal; ids of the recent ones are kept
per worker. Chunks of plain Latin characters are split and merged by a byte-pair encoder with the
vocabulary's own merge order, where the end-of-word sign is a space; all others go to the
tokenizer itself. The vocabulary's added tokens, such as an end-of-text sign, are looked for in the text as
it stands, before anything else, as the tokenizer does; each has its own id.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import repeat

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

#: Chunks, and ids of theirs, beyond which a worker begins anew: an executor has a worker per core, and they
#: live on through the stages that follow. Most chunks come once, so a larger store spares little time.
CACHE_CHUNKS = 250_000
CACHE_IDS = 4_000_000
#: Marks a chunk as an added token; no chunk cut from a text begins with it and holds one.
_ADDED = "\ue000"
_PLAIN = re.compile(r"[!-~¡-¬®-ÿ]+")
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def _byte_names() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _lowered(text: str) -> str:
    """Latin-1 texts in lower case, as the normaliser has them; fewer chunks differ then."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


class Encoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model = whole["model"]
        self.exact = Tokenizer.from_file(path)
        self.added = {_ADDED + t["content"]: t["id"] for t in whole["added_tokens"]}
        longest = sorted((t["content"] for t in whole["added_tokens"]), key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        names, end = _byte_names(), model["end_of_word_suffix"]

        def raw(token: str) -> bytes:
            ended = token.endswith(end)
            return bytes(names[c] for c in (token[: -len(end)] if ended else token)) + b" " * ended

        vocab = model["vocab"]
        ranks, ids = {}, []
        single = [t for t in vocab if len(t) == 1] + [t for t in vocab if t.endswith(end) and len(t) == len(end) + 1]
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        for token in single + merged:
            if (key := raw(token)) not in ranks:
                ranks[key] = len(ids)
                ids.append(vocab[token])
        ranks.setdefault(b" ", len(ids))
        ids.append(-1)
        self.ids = np.array(ids, dtype=np.int64)
        self.ends = np.zeros(len(ids), dtype=bool)
        for key, rank in ranks.items():
            self.ends[rank] = key.endswith(b" ")
        self.merge = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.pool = np.zeros(1 << 20, dtype=np.uint32)
        self.starts = np.zeros(1 << 16, dtype=np.int64)
        self.starts[0] = self.used = 0

    def _learn(self, chunks: list[str]) -> None:
        plain, pieces, counts, other = [], [], [], []
        for c in chunks:
            if c in self.added:
                self._keep([c], np.array([self.added[c]], dtype=np.int64), np.array([1]))
                continue
            if not _PLAIN.fullmatch(c):
                other.append(c)
                continue
            # Letters alone, or with one sign after them, need no splitting.
            if c.isalpha():
                own = [c.lower()]
            elif c[:-1].isalpha() and c[-1] in ".,!?;:|":
                own = [c[:-1].lower(), c[-1]]
            else:
                own = _PIECE.findall(c.lower())
            plain.append(c)
            pieces += own
            counts.append(len(own))
        if plain:
            # All pieces at once; a piece ends with a token that ends a word.
            ranks = np.array(self.merge.encode_ordinary(" ".join(pieces) + " "), dtype=np.int64)
            last = np.flatnonzero(self.ends[ranks])[np.cumsum(counts) - 1]
            self._keep(plain, self.ids[ranks], np.diff(np.concatenate(([-1], last))))
        if other:
            each = [e.ids for e in self.exact.encode_batch_fast(other, add_special_tokens=False)]
            self._keep(other, np.array([i for ids in each for i in ids], dtype=np.int64), np.array([len(ids) for ids in each]))

    def _keep(self, chunks: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        n = len(self.known)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, max(2 * len(self.pool), self.used + len(ids)))
        if n + len(chunks) + 1 > len(self.starts):
            self.starts = np.resize(self.starts, max(2 * len(self.starts), n + len(chunks) + 1))
        self.pool[self.used : self.used + len(ids)] = ids
        self.starts[n + 1 : n + len(chunks) + 1] = self.used + np.cumsum(counts)
        self.used += len(ids)
        self.known.update(zip(chunks, range(n, n + len(chunks))))

    def _chunks(self, text: str) -> list[str]:
        if self.cut is None or not self.cut.search(text):
            return _lowered(text).replace("\n", " ").split(" ")
        out = []
        for i, part in enumerate(self.cut.split(text)):
            out += [_ADDED + part] if i % 2 else self._chunks(part)
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        if len(self.known) > CACHE_CHUNKS or self.used > CACHE_IDS:
            self._clear()
        each = [self._chunks(t or "") for t in texts]
        chunks = [c for cs in each for c in cs]
        index = np.array(list(map(self.known.get, chunks, repeat(-1))), dtype=np.int64)
        missing = np.flatnonzero(index < 0)
        if len(missing):
            self._learn(list(dict.fromkeys(chunks[i] for i in missing)))
            index[missing] = [self.known[chunks[i]] for i in missing]
        start = self.starts[index]
        length = self.starts[index + 1] - start
        upto = np.cumsum(length)
        total = int(upto[-1]) if len(upto) else 0
        ids = self.pool[np.repeat(start - (upto - length), length) + np.arange(total)]
        ends = np.cumsum([len(cs) for cs in each])
        reached = upto[ends - 1] if len(ends) else ends
        return ids, np.diff(np.concatenate(([0], reached)))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
