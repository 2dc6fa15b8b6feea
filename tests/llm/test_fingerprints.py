"""Weighted sampling, runs and the filter audit against brute force, with the awkward rows each must take."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from pagelattice.llm import filter_audit, runs, weighted
from pagelattice.llm.queries import QUERIES, with_periods
from tests.llm.brute import ink_words
from tests.llm.test_operators import FOLDER, documents, empty_docs, odd_docs, texts

# --- fingerprints ----------------------------------------------------------------------------


def jaccard(a, b):
    x, y = (Counter(ink_words(t, lower=False)) for t in (a, b))
    both = sum((x | y).values())
    return sum((x & y).values()) / both if both else 1.0


def expected_edits(rows):
    """{id: (n_chars, edited text, next text)} of (id, text) rows with distinct ids."""
    rows = sorted((d, t or "") for d, t in rows)
    out = {}
    for (doc, text), (_, other) in zip(rows, rows[1:] + rows[:1]):
        cut = len(text) // 4
        out[doc] = (len(text), text[: len(text) - cut] + other[:cut], other)
    return out


def test_fingerprints_of_documents(spark):
    own = dict(texts(spark))
    wanted = expected_edits(own.items())
    rows = {r["doc_id"]: r for r in QUERIES["op11_fingerprints"](spark, FOLDER).collect()}
    assert set(rows) == set(own)
    prints, off = {}, []
    for doc, r in rows.items():
        chars, edited, other = wanted[doc]
        assert r["n_chars"] == chars
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        off.append((r["near_edited"] - jaccard(own[doc], edited), r["near_next"] - jaccard(own[doc], other)))
        prints.setdefault(own[doc] or "", set()).add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())
    # The share of equal samples is an unbiased estimate.
    off = np.array(off)
    assert abs(off.mean(axis=0)).max() < 0.02
    assert abs(off).max() < 0.3 and off.std(axis=0).max() < 0.07


def test_collision_rate_is_the_weighted_similarity(spark):
    """One pair with repeated words, many samples: the rate meets sum of minima over sum of maxima."""
    a, b = "x x x x y y z " + "w " * 9, "x y y y z z v " + "w " * 3
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    one, two = (r["fingerprint"] for r in weighted.fingerprints(docs, samples=4096).orderBy("doc_id").collect())
    equal = np.mean([one[i : i + 4] == two[i : i + 4] for i in range(0, len(one), 4)])
    assert abs(equal - jaccard(a, b)) < 0.03


def test_next_text_over_many_ranges(spark):
    random.seed(8)
    rows = [(i * 7 % 503, "w" * random.randint(0, 9) + str(i)) for i in range(503)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = weighted.with_next(docs, ranges=40).where("not border").collect()
    wanted = expected_edits(rows)
    assert len({r["part"] for r in found}) > 10
    assert {r["id"]: r["next_text"] for r in found} == {d: w[2] for d, w in wanted.items()}


def test_fingerprints_of_odd_rows(spark):
    docs = odd_docs(spark)
    rows = weighted.edit_likeness(docs).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in docs.collect())
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[0]["fingerprint"] == by_id[1]["fingerprint"] == by_id[2]["fingerprint"] == ""
    assert by_id[0]["n_chars"] == 0 and by_id[0]["near_edited"] == 1.0
    assert by_id[50]["n_chars"] == 150_000
    assert weighted.edit_likeness(empty_docs(spark)).count() == 0
    single = weighted.edit_likeness(spark.createDataFrame([("only", "a b c d")], "doc_id string, text string")).collect()
    assert [(r["doc_id"], r["near_next"]) for r in single] == [("only", 1.0)]


def test_a_row_repeated_without_end_is_one_key(spark):
    docs = spark.range(300).select(F.lit(5).cast("bigint").alias("doc_id"), F.lit("a b c").alias("text")).union(spark.createDataFrame([(6, "d e f g")], "doc_id long, text string"))
    rows = weighted.edit_likeness(docs).collect()
    assert Counter(r["doc_id"] for r in rows) == {5: 300, 6: 1}
    assert {r["near_next"] for r in rows} == {0.0}


# --- runs ------------------------------------------------------------------------------------


def brute_runs(words, least=12):
    """(start, length, period) of all runs, lag by lag."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def found_runs(lists):
    letters = np.array([c for t in lists for c in t], dtype=np.int64)
    first = np.concatenate(([0], np.cumsum([len(t) for t in lists]))).astype(np.int64)
    row = np.repeat(np.arange(len(lists)), [len(t) for t in lists])
    out = [[] for _ in lists]
    for s, e, p in zip(*(x.tolist() for x in runs.runs_of(letters, row, first))):
        out[row[s]].append((s - int(first[row[s]]), e - s, p))
    return out


def test_runs_against_brute_force():
    random.seed(5)
    for _ in range(150):
        lists = []
        for _ in range(random.randint(1, 8)):
            n, k = random.choice([0, 1, 11, 12, 13, 30, 80, 200]), random.choice([1, 2, 3, 8, 50])
            words = [random.randrange(k) for _ in range(n)]
            if n and random.random() < 0.6:
                a = random.randrange(n)
                p = 1 + (n - a) // random.randint(2, 10)
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            lists.append(words * random.choice([1, 1, 2]))
        assert found_runs(lists) == [brute_runs(t) for t in lists]


def test_runs_of_regular_words():
    thue_morse = [bin(i).count("1") & 1 for i in range(500)]
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    for words in (thue_morse, thue_morse * 2, b, [0] * 300):
        assert found_runs([words]) == [brute_runs(words)]


def test_long_periods_and_work():
    rng = np.random.default_rng(2)
    words = np.minimum(rng.zipf(1.3, 60_000), 5000)
    words[20_000:35_000] = np.tile(words[20_000:25_000], 3)
    assert (20_000, 15_000, 5_000) in found_runs([words.tolist()])[0]


def test_splitting_keeps_every_run_and_stops():
    random.seed(6)
    for _ in range(100):
        words = [random.randrange(30) for _ in range(150)] + [1, 2, 3] * 5 + [random.randrange(30) for _ in range(40)]
        low, high = runs.split(np.array(words), np.zeros(len(words), np.int64), np.array([0, len(words)]))
        for s, n, _ in brute_runs(words):
            assert any(a <= s and s + n <= b for a, b in zip(low, high))
        # Stable: no word stands once in what is left.
        for a, b in zip(low, high):
            assert min(Counter(words[a:b]).values()) > 1
    # Cut short, larger segments are left and the runs are the same.
    low, high = runs.split(np.array(words), np.zeros(len(words), np.int64), np.array([0, len(words)]), rounds=0)
    assert list(low) == [0] and list(high) == [len(words)]


def brute_op12(doc, text):
    words, h = ink_words(text, lower=False), zlib.crc32(str(doc).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    dropped = {i for s, length, p in found for i in range(s + p, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    told = "".join(f"{s},{length},{p}\n" for s, length, p in found)
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(found), *top, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_periodic_runs_of_documents(spark):
    rows = QUERIES["op12_periodic_runs"](spark, FOLDER).collect()
    got = {r["doc_id"]: tuple(r[c] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in rows}
    own = texts(spark)
    short = [(d, t) for d, t in own if len(ink_words(t)) < 1500]
    assert len(got) == len(own) and len(short) > 0.9 * len(own)
    for doc, text in short:
        assert got[doc] == brute_op12(doc, text), doc
    assert sum(g[0] > 0 for g in got.values()) >= 10


def test_runs_of_odd_rows(spark):
    docs = odd_docs(spark)
    rows = runs.collapse_runs(docs).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in docs.collect())
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[0]["collapsed"] == by_id[2]["collapsed"] == "" and by_id[0]["runs"] == []
    assert [tuple(x) for x in by_id[50]["runs"]] == [(0, 30_000, 1)] and by_id[50]["collapsed"] == "word"
    assert by_id[8]["runs"] == [] and by_id[8]["collapsed"] == "tie tie tie tie"
    assert by_id[6]["collapsed"] == "x" * 5000
    assert runs.collapse_runs(empty_docs(spark)).count() == 0
    assert with_periods(odd_docs(spark)).count() == docs.count()


# --- filter audit ----------------------------------------------------------------------------


def brute_audit(rows, labels):
    """{(part, order, step): counts} of (id, text, source) rows."""
    first = {}
    for doc, text, _ in rows:
        if doc is not None:
            first[text or ""] = min(doc, first.get(text or "", doc))
    out, parts = {}, {}
    for doc, text, source in rows:
        text = text or ""
        words = ink_words(text, lower=False)
        fails = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
        fails += "C" * (100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text)) + "D" * any(c in "#$%&*|" for c in text)
        fails += "E" * (doc is not None and first[text] < doc)
        parts.setdefault(source or "", []).append((fails, labels.get(doc, (0, 0))))
    for part, docs in parts.items():
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                shapley[f] += len(gone)
                out[part, order, step] = [
                    len(left), len(gone), sum(f in d[0] for d in docs) - len(gone), sum(f == d[0] for d in docs),
                    sum(d[1][0] == 1 for d in gone), sum(d[1][1] == 1 for d in gone),
                ]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(shapley[order[step - 1]])
    return out


def audit_rows(df):
    return {(r[0], r[1], r[2]): list(r[3:]) for r in df.collect()}


def test_filter_audit_of_documents(spark):
    rows = [tuple(r) for r in documents(spark).select("doc_id", "text", "source").collect()]
    labels = {r[0]: (r[1], r[2]) for r in spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "quality", "toxic").collect()}
    got = audit_rows(QUERIES["op13_filter_audit"](spark, FOLDER))
    assert got == brute_audit(rows, labels)


def test_filter_audit_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(300))
    rows = [(0, None, "a"), (1, "", "a"), (2, long, None), (3, long, ""), (3, long, ""), (None, long, "b"), (None, long, "b"), (4, "A# " * 300, "b"), (5, long + " x" * 900_000, "c"), (6, " \t\n", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *[F.lit(1).alias(c) for c in ("id", "key", "part", "mask", "n", "good", "toxic", "first")])
    labels = spark.createDataFrame([(2, 1, 0), (4, 0, 1), (4, 0, 1), (None, 1, 1), (99, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = audit_rows(filter_audit.filter_audit(docs, labels))
    assert got == brute_audit(rows, {2: (1, 0), 4: (0, 1), 3: (0, 0)})
    assert filter_audit.filter_audit(docs.limit(0), labels).count() == 0
    assert filter_audit.filter_audit(docs, labels.limit(0)).count() == 600 * 4


def test_removal_steps_are_the_first_failing_filter():
    orders, fails, steps = filter_audit.removal_steps()
    assert len(orders) == 120 and len(fails) == 32
    for mask in range(32):
        for o, order in enumerate(orders):
            assert steps[mask, o] == next((i for i, f in enumerate(order) if mask >> f & 1), 5)


def test_shared_pieces_hold_the_words_of_both_texts(spark):
    texts = ["", " ", "a", "a b", "abcdefgh", "a b c d e f g h", "a  b\n\nc\td " * 9, "x" * 5000, "ä ö ü " * 50 + "end", " lead and trail "]
    rows = spark.createDataFrame([(i, t, o) for i, t in enumerate(texts) for o in ["", "q r", "no-gap", " é é " * 40]], "id int, text string, other string")
    rows = rows.withColumn("edit", weighted.edited(F.col("text"), F.col("other")))
    terms = weighted.with_terms(rows, weighted.shared_pieces(F.col("text"), F.col("edit")), "terms")
    for r in terms.collect():
        for place, text in enumerate((r["text"], r["edit"])):
            counts = Counter(re.findall(r"[^\x20\x09-\x0D]+", text))
            found = sorted(t[f"weight_{place}"] for t in r["terms"] if t[f"weight_{place}"])
            assert found == sorted(counts.values())
        assert len({t["term"] for t in r["terms"]}) == len(r["terms"])
