"""Plain Python versions of what the operators compute."""

import re
import zlib

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
INK = re.compile(r"[^\x20\x09-\x0D]+")


def alnum_words(text):
    return ALNUM.findall((text or "").translate(UPPER))


def ink_words(text, lower=True):
    text = text or ""
    return INK.findall(text.translate(UPPER) if lower else text)


def contamination(docs, benchmark, window=10):
    """{id: (n_words, hit positions, items)} of (id, text) rows."""
    grams = {}
    for item, text in benchmark:
        w = alnum_words(text)
        for i in range(max(len(w) - window + 1, 1) if w else 0):
            grams.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    sizes = {len(g) for g in grams}
    out = {}
    for doc, text in docs:
        w, hit, items = alnum_words(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if (found := grams.get(tuple(w[i : i + k]))) is not None:
                    hit.update(range(i, i + k))
                    items |= found
        out[doc] = (len(w), hit, items)
    return out


def phrase_places(text, phrases):
    w, out = alnum_words(text), []
    for phrase, label in phrases:
        p = phrase.split(" ")
        out += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return out


def repetition(text):
    w = ink_words(text, lower=False)
    chars = sum(map(len, w))
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if INK.search(line):
            again += line in seen
            seen.add(line)
    windows = {}
    for i in range(len(w) - 2):
        windows.setdefault(tuple(w[i : i + 3]), []).append(i)
    marked = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(3)}
    best = [0] * len(w)
    for i in range(len(w)):
        for j in range(len(w)):
            if i != j and w[i] == w[j]:
                k = 0
                while i + k < len(w) and j + k < len(w) and w[i + k] == w[j + k]:
                    k += 1
                best[i] = max(best[i], k)
    covered = {i + j for i, b in enumerate(best) if b >= 8 for j in range(b)}
    return len(w), chars, symbols, again, len(marked), len(covered), max(best, default=0)


def near_duplicates(docs, size, percent):
    """{id: (set size, component)} by comparing all pairs of distinct sets."""
    sets = {}
    for doc, text in docs:
        w = ink_words(text)
        sets[doc] = frozenset(tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))) if w else frozenset()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if not x or not y or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                continue
            shared = len(x & y)
            if 100 * shared >= percent * (len(x) + len(y) - shared):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), root(d)) for d in ids}


def crc32(data):
    return zlib.crc32(data)
