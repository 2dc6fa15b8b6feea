"""Operators of the llm folder against brute force, with the awkward rows each must take."""

import hashlib
import random
import re
import struct
import time
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pagelattice.llm import arrays, bpe, chat, components, decontaminate, grams, licenses, lines, neardup, packing, repetition, sharding, toxicity, url_rules
from pagelattice.llm.common import scratch
from pagelattice.llm.queries import QUERIES
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
ODD = [None, "", " \n\t ", "one", "a b", "ÉCOLE Straße ΑΣ", "x" * 5000, "\u00a0a\u2003b", "tie tie tie tie", "a\u0000b <|endoftext|> 'S don't 12 ２"]


def odd_docs(spark):
    rows = list(enumerate(ODD)) + [(3, "one"), (None, "one"), (50, "word " * 30_000)]
    frame = spark.createDataFrame(rows, DOCS)
    # Columns named like those that operators make.
    return frame.select("doc_id", "text", *[F.lit(7).alias(c) for c in ("id", "mark", "hash", "words", "shard", "slot", "rule", "score", "n_removed", "n")])


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def texts(spark):
    return [(r[0], r[1]) for r in documents(spark).select("doc_id", "text").collect()]


def test_span_hashes_tell_equal_bytes():
    random.seed(1)
    words = ["".join(random.choices("ab", k=random.randint(1, 6))) for _ in range(3000)]
    import pyarrow as pa

    raw, bounds = arrays.flat(pa.array([" ".join(words), None, "", "ab ab"], pa.string()))
    runs = arrays.Runs(raw, bounds, arrays.INK)
    assert list(runs.count) == [3000, 0, 0, 2]
    by_word = defaultdict(set)
    for w, h in zip(words + ["ab", "ab"], runs.hashes()):
        by_word[w].add(int(h))
    assert all(len(s) == 1 for s in by_word.values())
    assert len({h for s in by_word.values() for h in s}) == len(by_word)


# --- packing ---------------------------------------------------------------------------------


def exact_ids(text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]


def check_pieces(rows, wanted):
    """Every id of every document in one piece, windows full enough and gapless."""
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    windows = defaultdict(list)
    for doc, ids in wanted:
        assert doc in pieces
    for doc, own in pieces.items():
        copies = [ids for d, ids in wanted if d == doc]
        own.sort(key=lambda r: r["start"])
        assert sum(r["length"] for r in own) == sum(map(len, copies))
        if len(copies) == 1:
            got = [i for r in own for i in struct.unpack(f"<{r['length']}I", r["ids"])]
            assert got == copies[0]
            assert {r["doc_tokens"] for r in own} == {len(copies[0])}
    for r in rows:
        assert r["length"] == len(r["ids"]) // 4 > 0
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in windows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    return len(windows)


def test_pack_documents(spark):
    rows = packing.pack(documents(spark), public_tokenizers.path("word_bpe_49k.json")).collect()
    wanted = [(d, exact_ids(t)) for d, t in texts(spark)]
    windows = check_pieces(rows, wanted)
    total = sum(len(i) for _, i in wanted)
    assert total / (windows * packing.CAPACITY) > 0.98


def test_pack_odd_rows(spark):
    docs = odd_docs(spark)
    rows = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    check_pieces(rows, [(r[0], exact_ids(r[1])) for r in docs.select("doc_id", "text").collect()])
    assert packing.pack(empty_docs(spark), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_chunks_kept_by_a_worker_stay_few():
    """Workers of all cores of an executor, and its heap, share 3,000 MB; ids do not depend on what is kept."""
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, encode = Tokenizer.from_file(path), bpe.Encoder(path)
    for low in range(0, 400_000, 20_000):
        texts = [" ".join(f"w{i:x} the" for i in range(low + j, low + j + 100)) for j in range(0, 20_000, 100)]
        ids, counts = encode.encode(texts)
        assert len(encode.known) < 300_000
        expected = tokenizer.encode(texts[-1], add_special_tokens=False).ids
        assert ids[-counts[-1] :].tolist() == expected


def test_encoder_is_the_tokenizer():
    random.seed(3)
    signs = "abcXYZéßÑæ'sStT1239.,!?-_<>|&;:\u00aa\u00b5\u00ad\u0130ΣσςЖ中\u0301\u200b\u00a0\t😀"
    samples = ["".join(random.choices(signs + "  \n", k=random.randint(0, 60))) for _ in range(3000)]
    samples += ["<|endoftext|>", "a <|endoftext|> b", "É<|endoftext|>b<|startoftext|><|startoftext|>'s", "<|ENDOFTEXT|> <|endóftext|>", "\ue000<|endoftext|>", "\ue000", "<|startoftext|> a</w>", "don't we'll I'VE", "ﬁ ﬃ Å Å"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids, counts = bpe.Encoder(public_tokenizers.path("word_bpe_49k.json")).encode(samples)
    cuts = np.cumsum(counts)[:-1]
    for text, own in zip(samples, np.split(ids, cuts)):
        assert list(own) == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_differencing_is_balanced_and_whole():
    random.seed(4)
    lengths = [random.randint(1, 1024) for _ in range(900)]
    parts = packing.partition(lengths, 4096)
    assert sorted(i for p in parts for i in p) == list(range(900))
    sums = [sum(lengths[i] for i in p) for p in parts]
    assert max(sums) <= 4096 and len(parts) <= -(-sum(lengths) // 4096) + 1
    assert max(sums) - min(sums) <= 64
    # Three of 3000 do not fit two windows: the count rises.
    assert len(packing.partition([3000, 3000, 3000], 4096)) == 3
    assert sorted(s for s, _ in packing.differencing([8, 7, 6, 5, 4], 2)) == [14, 16]


def test_added_tokens_have_their_own_ids(spark):
    docs = spark.createDataFrame([(1, "a <|endoftext|> b"), (2, "<|startoftext|>")], DOCS)
    rows = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    ids = {r["doc_id"]: struct.unpack(f"<{r['length']}I", r["ids"]) for r in rows}
    assert ids == {1: (320, 49407, 321, 2), 2: (49406, 2)}


# --- decontamination -------------------------------------------------------------------------


def test_contamination(spark):
    bench = [(r[0], r[1]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    bench += [(900, "tie tie"), (901, None), (902, "..."), (None, "one two three"), (903, bench[0][1])]
    extra = [(1000 + i, t) for i, t in enumerate(ODD)] + [(2000, "One, two: THREE? tie-tie " + bench[1][1].upper())]
    docs = spark.createDataFrame(texts(spark) + extra, DOCS)
    frame = spark.createDataFrame(bench, "item_id long, text string")
    got = {r["id"]: r for r in decontaminate.contamination(docs, frame).collect()}
    want = brute.contamination(texts(spark) + extra, bench)
    assert len(got) == len(want) and sum(bool(h) for _, h, _ in want.values()) > 3
    for doc, (n, hit, items) in want.items():
        r = got[doc]
        assert (r["n_words"], r["n_hit"]) == (n, len(hit))
        assert {i for s in r["spans"] for i in range(s["start"], s["end"])} == hit
        assert set(r["items"]) == items - {"None"}


@pytest.mark.parametrize("limit", ["BROADCAST_ROWS", "BROADCAST_BYTES"])
def test_look_up_without_broadcast(spark, monkeypatch, limit):
    monkeypatch.setattr(grams, limit, 0)
    test_contamination(spark)
    test_contamination_repeats_and_empties(spark)
    test_license_phrases(spark)


@pytest.mark.parametrize("rows", [0, 500_000])
def test_look_up_across_blocks(spark, monkeypatch, rows):
    """Matches at the first and last words of blocks and over their borders, of several sizes."""
    monkeypatch.setattr(grams, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(grams, "BLOCK", 7)
    random.seed(3)
    docs = [(i, " ".join(random.choices("abc", k=n))) for i, n in enumerate([0, 1, 6, 7, 8, 13, 14, 15, 21, 60, 200])]
    bench = [(i, " ".join(random.choices("abc", k=k))) for i, k in enumerate([1, 3, 4, 5, 6, 10, 14])][1:]
    frames = spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, "item_id long, text string")
    got = {r["id"]: r for r in decontaminate.contamination(*frames, window=5).collect()}
    for doc, (n, hit, items) in brute.contamination(docs, bench, 5).items():
        assert (got[doc]["n_words"], got[doc]["n_hit"], sorted(got[doc]["items"])) == (n, len(hit), sorted(items))


def test_look_up_without_broadcast_moves_no_words(spark, monkeypatch):
    monkeypatch.setattr(grams, "BROADCAST_ROWS", 0)
    seen = []
    plain = grams.skew_join
    monkeypatch.setattr(grams, "skew_join", lambda left, *rest: seen.append(left) or plain(left, *rest))
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    decontaminate.contamination(documents(spark), bench)
    assert seen[0].dtypes == [("id", "bigint"), ("mark", "bigint"), ("start", "int"), ("block_words", "int"), ("place", "int"), ("probe", "bigint")]


def test_hot_passage_without_broadcast(spark, monkeypatch):
    """A window in every text is one hash of very many rows."""
    monkeypatch.setattr(grams, "BROADCAST_ROWS", 0)
    shared = " ".join(f"w{i}" for i in range(12))
    docs = spark.range(400).selectExpr("id AS doc_id", f"concat('own', id, ' {shared} end', id % 7) AS text")
    bench = spark.createDataFrame([(1, shared), (2, "nothing of it")], "item_id long, text string")
    rows = decontaminate.contamination(docs, bench).collect()
    assert len(rows) == 400 and all((r["n_hit"], r["items"], len(r["spans"])) == (12, ["1"], 1) for r in rows)


def test_spans_of_very_many_hits_are_linear(spark):
    bench = spark.createDataFrame([(1, "hit me")], "item_id long, text string")
    took = []
    for n in (20_000, 80_000):
        docs = spark.createDataFrame([(1, "hit me not " * n)], DOCS)
        start = time.time()
        (row,) = decontaminate.contamination(docs, bench).select("n_hit", F.size("spans")).collect()
        took.append(time.time() - start)
        assert tuple(row) == (2 * n, n)
    assert took[1] < 6 * took[0] + 5


def test_contamination_repeats_and_empties(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "x"), (None, None)], DOCS)
    bench = spark.createDataFrame([(5, "b c")], "item_id long, text string")
    rows = sorted((r["id"] or 0, r["n_words"], r["n_hit"]) for r in decontaminate.contamination(docs, bench).collect())
    assert rows == [(0, 0, 0), (1, 1, 0), (1, 3, 2), (1, 3, 2)]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, none).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(empty_docs(spark), bench).count() == 0
    assert decontaminate.contamination(odd_docs(spark), bench).count() == len(ODD) + 3


def test_removal(spark):
    bench = spark.createDataFrame([(5, "beta it")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "-Alpha BETA! It is, then."), (2, "beta"), (3, None)], DOCS).withColumn("id", F.lit(1))
    left = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(docs, bench).collect()}
    assert left == {1: "-Alpha is, then.", 2: "beta", 3: None}
    kept = decontaminate.remove_documents(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3]


# --- licenses --------------------------------------------------------------------------------


def test_license_phrases(spark):
    extra = [(1000 + i, t) for i, t in enumerate(ODD)]
    extra += [(2000, "GNU general PUBLIC-license gnu general public license cc by CC BY"), (2001, "gnu general license"), (2002, "mit  license, the Apache\nLicense"), (2003, "gnu gnu general public public license")]
    docs = spark.createDataFrame(texts(spark) + extra, DOCS)
    rows = {r["doc_id"]: r for r in licenses.license_scan(docs).collect()}
    assert len(rows) == len(texts(spark)) + len(extra)
    found = 0
    for doc, text in texts(spark) + extra:
        places, r = brute.phrase_places(text, licenses.PHRASES), rows[doc]
        at, found = sorted(i for i, _ in places), found + bool(places)
        assert (r["n_words"], r["n_base"]) == (len(brute.alnum_words(text)), len(places))
        assert (r["first_word"], r["last_word"]) == ((at[0], at[-1]) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted({lab for _, lab in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
    assert found >= 5


def test_license_notices_with_changed_words(spark):
    words = licenses.TEMPLATES[4][0].split(" ")
    changed = " ".join(words[:9] + ["whosoever", "it", "be"] + words[10:])
    docs = spark.createDataFrame([(1, "Intro. " + changed + " outro"), (2, "permission is hereby granted by the state")], DOCS)
    rows = {r["doc_id"]: r for r in licenses.license_scan(docs).collect()}
    assert rows[1]["labels"] == "mit" and rows[1]["base_labels"] == "" and 0.6 <= rows[1]["score"] < 1
    assert rows[2]["labels"] == ""


def test_license_odd_rows(spark):
    assert licenses.license_scan(odd_docs(spark)).count() == len(ODD) + 3
    assert licenses.license_scan(empty_docs(spark)).count() == 0


# --- toxicity --------------------------------------------------------------------------------


def made_labels(spark, n=600):
    random.seed(5)
    plain = ["".join(random.choices("abcdefgh", k=5)) for _ in range(200)]
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        words = random.choices(plain, k=30) + (["vile"] * 2 if toxic else []) + (["women"] if random.random() < (0.8 if toxic else 0.1) else [])
        random.shuffle(words)
        rows.append((i, " ".join(words), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int").cache()


def test_toxicity_held_out(spark):
    labelled = made_labels(spark)
    model = toxicity.train(labelled, labelled)
    rows = toxicity.score(labelled, model).join(labelled, "doc_id").collect()
    assert all(r["held_out"] == (brute.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    unseen = [r for r in rows if r["held_out"]]
    assert len(unseen) > 80 and np.mean([r["predicted"] == r["toxic"] for r in unseen]) > 0.97
    assert all((r["predicted"] == 1) == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)


def test_counterfactual_penalty_silences_mentions(spark):
    labelled = made_labels(spark)
    women = int(toxicity._term_hashes(["women"])[0])
    weight = {}
    for penalty in (0.0, 20.0):
        vocabulary, weights, _ = toxicity.train(labelled, labelled, penalty=penalty)
        weight[penalty] = weights[np.searchsorted(vocabulary, women)]
    assert weight[0.0] > 0.5 and abs(weight[20.0]) < 0.25 * weight[0.0]


def test_swapped_texts_score_alike(spark):
    """Beginnings of identity terms are swapped with them: 'wome' cannot say what 'women' may not."""
    labelled = made_labels(spark)
    before = labelled.where(F.col("text").rlike(r"\bwomen\b")).select("doc_id", "text")
    after = before.withColumn("text", F.regexp_replace("text", r"\bwomen\b", "men"))
    change = {}
    for penalty in (0.0, 20.0):
        model = toxicity.train(labelled, labelled, penalty=penalty)
        logit = F.log(F.col("score") / (1 - F.col("score")))
        a, b = ({r[0]: r[1] for r in toxicity.score(t, model).select("doc_id", logit).collect()} for t in (before, after))
        change[penalty] = np.mean([abs(a[k] - b[k]) for k in a])
    assert len(a) > 100 and change[0.0] > 1 and change[20.0] < 0.1 * change[0.0], change


def test_held_out_labels_do_not_matter(spark):
    labelled = made_labels(spark)
    turned = labelled.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(labelled, labelled), toxicity.train(labelled, turned)
    assert np.array_equal(a[0], b[0]) and np.allclose(a[1], b[1])


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (4, None), (77, 1)], "doc_id long, toxic int")
    docs = odd_docs(spark)
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.drop_toxic(docs, model).columns == docs.columns
    nothing = toxicity.train(docs, labels.limit(0))
    assert toxicity.score(docs, nothing).where("predicted = 1").count() == 0
    assert toxicity.drop_toxic(docs, nothing).count() == docs.count()
    assert toxicity.score(empty_docs(spark), nothing).count() == 0


def test_toxicity_learns_the_sample_tables(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    toxic = [r["score"] for r in rows if r["toxic"] == 1]
    clean = [r["score"] for r in rows if r["toxic"] == 0]
    # About one toxic row in ten holds no word that sets it apart, not even by a list of such words.
    assert np.mean([s >= 0.5 for s in toxic]) > 0.85 and np.mean([s >= 0.5 for s in clean]) < 0.02


# --- repetition ------------------------------------------------------------------------------


def test_repetition_counts(spark):
    random.seed(6)
    made = [" ".join(random.choices("abc", k=random.randint(1, 120))) for _ in range(60)]
    block = " ".join(f"w{i}" for i in range(40))
    made += [f"{block}\n{block}", "a a a a a a a a a a a a", "x\nx\n\n \nx\n y", "#|<b> & $5 %*é"] + ODD
    docs = spark.createDataFrame(list(enumerate(made)), DOCS)
    rows = {r["doc_id"]: r for r in repetition.repetition_rules(docs).collect()}
    for i, text in enumerate(made):
        r = rows[i]
        got = tuple(r[c] for c in "n_words word_chars n_symbols n_dup_lines n_repeat_words covered_words longest_repeat".split())
        assert got == brute.repetition(text), text
        assert r["base_failed"] == (got[0] < 50 or 100 * got[4] > 50 * got[0])
        assert r["kept"] == (not r["base_failed"] and got[5] <= 0.4 * got[0] and got[6] <= 0.3 * got[0])


def test_repetition_documents(spark):
    short = [(d, t) for d, t in texts(spark) if len(t) < 3000]
    rows = {r["doc_id"]: r for r in repetition.repetition_rules(spark.createDataFrame(short, DOCS)).collect()}
    for doc, text in short:
        got = tuple(rows[doc][c] for c in "n_words word_chars n_symbols n_dup_lines n_repeat_words covered_words longest_repeat".split())
        assert got == brute.repetition(text)


def test_repetition_odd_rows(spark):
    assert repetition.repetition_rules(odd_docs(spark)).count() == len(ODD) + 3
    assert repetition.repetition_rules(empty_docs(spark)).count() == 0


# --- sharding --------------------------------------------------------------------------------


def placed(spark, n, shards, keys=None):
    docs = spark.range(n).select((F.col("id") if keys is None else F.col("id") % keys).alias("doc_id"))
    return [(r["doc_id"], r["shard"], r["slot"]) for r in sharding.assign(docs, shards).collect()]


@pytest.mark.parametrize("keys", [None, 1, 3])
def test_ring_is_balanced_and_gapless(spark, monkeypatch, keys):
    monkeypatch.setattr(sharding, "PART_ROWS", 500)
    rows = placed(spark, 4003, 7, keys)
    slots = defaultdict(list)
    for _, shard, slot in rows:
        slots[shard].append(slot)
    sizes = [len(slots[s]) for s in range(7)]
    assert sum(sizes) == 4003 and max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_ring_moves_little(spark):
    before, after = dict((d, s) for d, s, _ in placed(spark, 8000, 8)), dict((d, s) for d, s, _ in placed(spark, 8000, 9))
    moved = sum(before[d] != after[d] for d in before) / len(before)
    assert moved < 0.35


def test_ring_of_thousands_of_shards():
    rng = random.Random(41)
    counts = {cell: rng.randint(0, 300) for cell in range(1 << sharding.RING_BITS)}
    for shards in (600, 3000):
        assert {s for _, s in sharding.ring(shards)} == set(range(shards))
        taken = Counter()
        for _, _, shard, n in sharding.fill(counts, shards):
            taken[shard] += n
        assert sum(taken.values()) == sum(counts.values()) and max(taken.values()) - min(taken.values()) <= 1


def test_ring_against_walk(spark):
    """A key goes to the first shard with room from its cell on, cells in ring order."""
    rows, shards = placed(spark, 3000, 5), 5
    nodes = sharding.ring(shards)
    cells = defaultdict(int)
    for doc in range(3000):
        cells[int(hashlib.md5(str(doc).encode()).hexdigest()[:8], 16) >> (32 - sharding.RING_BITS)] += 1
    room, want = [600] * 5, Counter()
    for cell in sorted(cells):
        at = next((i for i, (c, _) in enumerate(nodes) if c >= cell), 0)
        for _ in range(cells[cell]):
            k = at
            while room[nodes[k % len(nodes)][1]] == 0:
                k += 1
            room[nodes[k % len(nodes)][1]] -= 1
            want[cell, nodes[k % len(nodes)][1]] += 1
    got = Counter((int(hashlib.md5(str(d).encode()).hexdigest()[:8], 16) >> (32 - sharding.RING_BITS), s) for d, s, _ in rows)
    assert got == want


def test_ring_odd_rows(spark):
    docs = odd_docs(spark)
    got = sharding.assign(docs, 4)
    assert got.count() == docs.count() and got.columns == [c for c in docs.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    assert sharding.assign(empty_docs(spark), 4).count() == 0


# --- near duplicates -------------------------------------------------------------------------


def near_texts():
    """A hub and spokes: copies at falling distance, chains, exact copies, and texts apart."""
    random.seed(8)
    word = lambda: "".join(random.choices("abcdefghij", k=6))
    out = []
    for _ in range(6):
        base = [word() for _ in range(150)]
        for k in range(14):
            changed = list(base)
            for at in random.sample(range(150), k):
                changed[at] = word()
            out.append(" ".join(changed))
    chain = [word() for _ in range(200)]
    for k in range(20):
        chain = chain[5:] + [word() for _ in range(5)]
        out.append(" ".join(chain))
    return out + out[:5] + ODD


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, size, percent):
    rows = list(enumerate(near_texts()))
    got = {r["doc_id"]: r for r in neardup.near_duplicates(spark.createDataFrame(rows, DOCS), shingle=size, percent=percent).collect()}
    want = brute.near_duplicates(rows, size, percent)
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == want
    assert all(r["kept"] == (d == r["component_id"]) for d, r in got.items())


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """Every bucket cut into blocks of a few members gives the same groups."""
    monkeypatch.setattr(neardup, "SMALL", 1)
    monkeypatch.setattr(neardup, "BLOCK", 4)
    test_near_duplicates(spark, 3, 85)


def family(rng, texts, words, changed):
    """Texts that differ from one base, which is not among them, in some words each."""
    base = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(words)]
    out = []
    for _ in range(texts):
        own = list(base)
        for at in rng.sample(range(words), changed):
            own[at] = "".join(rng.choices("abcdefghij", k=6))
        out.append(" ".join(own))
    return out


def test_pairs_follow_members_just_under_the_threshold(spark, monkeypatch):
    handed = []
    exact = neardup._exact
    monkeypatch.setattr(neardup, "_exact", lambda pairs, *rest: handed.append(pairs.count()) or exact(pairs, *rest))
    for size in (150, 600):
        handed.clear()
        rows = list(enumerate(family(random.Random(31), size, 300, 8)))
        got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, DOCS), shingle=3, percent=85).collect()}
        if size == 150:
            assert got == {d: c for d, (_, c) in brute.near_duplicates(rows, 3, 85).items()}
        # Bands times the members of a small bucket, at most; far fewer in fact.
        assert sum(handed) <= 40 * size, handed


def test_recall_between_085_and_090(spark):
    """Every link of exact pairs is found in families whose texts are 0.80 to 0.92 alike."""
    rng, rows = random.Random(32), []
    for changed in (2, 3, 4, 5, 6):
        rows += family(rng, 25, 250, changed)
    rows = list(enumerate(rows))
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, DOCS), shingle=3, percent=85).collect()}
    assert got == {d: c for d, (_, c) in brute.near_duplicates(rows, 3, 85).items()}


def test_near_duplicates_go_by_text_and_id(spark):
    """An id on two texts: the copy goes, the other text and its group keep one row."""
    rng = random.Random(33)
    base, other = family(rng, 2, 200, 1), family(rng, 2, 200, 1)
    rows = [(3, base[0]), (5, base[1]), (5, other[0]), (9, other[1]), (9, other[1])]
    left = neardup.drop_near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(tuple(r) for r in left) == sorted([(3, base[0]), (5, other[0])])
    named = [("b", base[0]), ("a", base[1]), (None, base[0]), ("c", "x y z")]
    left = neardup.drop_near_duplicates(spark.createDataFrame(named, "doc_id string, text string")).collect()
    assert {r["doc_id"] for r in left} == {"a", None, "c"}


def test_near_duplicates_odd_rows(spark):
    docs = odd_docs(spark)
    rows = neardup.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    assert {r["component_id"] for r in rows if r["n_shingles"] == 0} == {0, 1, 2}
    left = neardup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert Counter(r["doc_id"] for r in left.collect())[3] == 1
    assert neardup.near_duplicates(empty_docs(spark)).count() == 0


def test_bayesian_bounds():
    least = neardup.least_matches(0.85, 1e-6)
    assert len(least) == neardup.HASHES // neardup.BATCH and least == sorted(least)
    # A pair at the threshold falls below a bound hardly ever.
    rng = np.random.default_rng(0)
    hits = rng.random((20_000, neardup.HASHES)) < 0.85
    counts = np.cumsum(hits, axis=1)[:, neardup.BATCH - 1 :: neardup.BATCH]
    assert (counts < np.array(least)).any(axis=1).sum() <= 2
    assert (np.cumsum(rng.random((2000, neardup.HASHES)) < 0.4, axis=1)[:, 63] < least[3]).mean() > 0.9


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(200, 200)]
    with scratch(spark) as tables:
        rows = components.components(spark.createDataFrame(edges, "u long, v long"), tables).collect()
    got = {r["node"]: r["component"] for r in rows}
    assert len(rows) == len(got)
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)}


# --- URL rules -------------------------------------------------------------------------------


def test_url_rules(spark):
    urls = [
        "http://a.org/x", "HTTP://A.ORG/x?y", "https://org/", "http://example.org/es/1", "http://www.example.org/es/", "http://example.org/en/12",
        "http://example.org/en/2", "http://notexample.org/es/", "http://x.com/fr/1", "http://x.com/de/", "http://x.com/y.org/z", "http://x.com",
        "http://x.org", "x.org/", None, "", "http://x.net/a.zip", "http://x.net/a.zip?b", "http://x.com/de/a://b.org/", "://x.org/#/", "http://x.net/" + "p" * 9000,
    ]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit(1)).withColumn("host", F.lit(1))
    rows = {urls[r["page_id"]]: (r["rule"], r["verdict"]) for r in url_rules.url_verdicts(frame).collect()}
    assert rows["http://a.org/x"] == rows["HTTP://A.ORG/x?y"] == rows["https://org/"] == rows["://x.org/#/"] == ("org/", "allow")
    assert rows["http://example.org/es/1"] == rows["http://www.example.org/es/"] == ("example.org/es/", "block")
    assert rows["http://example.org/en/12"] == ("example.org/en/1", "block")
    assert rows["http://example.org/en/2"] == rows["http://notexample.org/es/"] == ("org/", "allow")
    assert rows["http://x.com/fr/1"] == ("com/fr/", "allow")
    assert rows["http://x.com/de/"] == rows["http://x.com/de/a://b.org/"] == ("com/de/", "block")
    for other in ("http://x.com/y.org/z", "http://x.com", "http://x.org", "x.org/", None, ""):
        assert rows[other] == (None, "allow")
    assert rows["http://x.net/a.zip"] == rows["http://x.net/a.zip?b"] == (None, "block")
    assert url_rules.url_verdicts(frame.limit(0)).count() == 0


def test_automaton_against_fnmatch():
    import re

    import pyarrow as pa

    random.seed(9)
    globs = ["".join(random.choices("ab*", k=random.randint(1, 9))) for _ in range(60)]
    automaton = url_rules.Automaton([url_rules.Rule("allow", g, g, 0) for g in globs])
    assert automaton.words > 3
    samples = ["".join(random.choices("abc", k=random.randint(0, 14))) for _ in range(400)]
    got = automaton.matches(*arrays.flat(pa.array(samples)))
    for text, row in zip(samples, got):
        want = [re.fullmatch(g.replace("*", ".*"), text) is not None for g in globs]
        assert list(row) == want


# --- chat ------------------------------------------------------------------------------------


def said(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def read_back(frame, **sizes):
    numbered = chat.turns(frame)
    made = chat.windows(numbered, **sizes)
    rows = made.select("*", chat.turns_of_window().alias("own"), chat.loss_of_window().alias("losses")).collect()
    return numbered.collect(), rows


def test_chat_round_trip(spark):
    random.seed(10)
    rows = []
    for conv in range(12):
        if conv % 2:
            rows.append((conv, 0, "system", "Be <kind> & brief."))
        for t in range(1, 2 + 5 * conv):
            rows.append((conv, t, "user" if t % 2 else "assistant", " ".join(random.choices(["a<b", "&amp;", "</turn>\n", "<turn user>", "é", "word"], k=random.randint(0, 60)))))
    rows += [(None, None, None, None), (3, 2, "user", "tie"), (3, 2, "user", "tie"), (99, 5, "odd>role", "\\### Assistant: </turn> ok")]
    numbered, windows = read_back(said(spark, rows), budget=160, history=40, system=20)
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        own = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=order)]
        told, losses = [], []
        for w in windows:
            if w["conv"] == conv:
                told += [(t["n"], t["role"], t["text"]) for t in w["own"]]
                losses += [(t["n"], t["text"]) for t in w["losses"]]
                shown = w["formatted"]
                assert shown.count("<turn ") == shown.count("</turn>\n")
                if own[0][0] == "system":
                    assert shown.startswith("<turn system>\n")
        assert sorted(told) == [(n, *t) for n, t in enumerate(own)]
        assert sorted(losses) == [(n, t) for n, (r, t) in enumerate(own) if r == "assistant"]
    tokens = {(r["conv"], r["n"]): r["tokens"] for r in numbered}
    for w in windows:
        new = [tokens[w["conv"], n] for n in range(w["first"], w["last"] + 1)]
        assert sum(new) <= 100 or len(new) == 1
    assert any(w["formatted"].count("<turn ") > len(w["own"]) + 1 for w in windows)


def test_chat_blocks_agree(spark, monkeypatch):
    rows = [(1, t, "user", "word " * (t % 7)) for t in range(100)]
    want = sorted(tuple(r) for r in chat.turns(said(spark, rows)).collect())
    monkeypatch.setattr(chat, "BLOCK", 7)
    assert sorted(tuple(r) for r in chat.turns(said(spark, rows)).collect()) == want
    assert chat.windows(chat.turns(said(spark, []))).count() == 0


# --- line chunks -----------------------------------------------------------------------------


def sentence(rng, n=12):
    return " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n)) + "."


def test_repeated_passages_go(spark):
    rng = random.Random(11)
    passage = " ".join(sentence(rng) for _ in range(5))
    plain = [[sentence(rng) for _ in range(8)] for _ in range(12)]
    rows = []
    for i, own in enumerate(plain):
        own = list(own)
        if i % 2:
            own.insert(rng.randint(0, 8), passage)
        rows.append((i, "\n".join(own)))
    got = {r["doc_id"]: r["text"] for r in lines.drop_repeated_chunks(spark.createDataFrame(rows, DOCS)).collect()}
    assert passage in got[1] and got[1] == rows[1][1]
    for i, own in enumerate(plain):
        if i != 1:
            assert all(s not in got[i] for s in passage.split(". "))
            assert got[i].replace("\n", "") == "\n".join(own).replace("\n", "")


def test_shifted_chunks_are_found(spark):
    """A block of many sentences behind different first lines loses all but its edges."""
    rng = random.Random(12)
    block = [sentence(rng, 9) for _ in range(60)]
    rows = [(1, "\n".join(block)), (2, sentence(rng, 5) + "\n" + "\n".join(block[3:])), (3, "\n".join(block[:30] + [sentence(rng, 9)] + block[30:]))]
    got = {r["doc_id"]: r for r in lines.drop_repeated_chunks(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1]["text"] == rows[0][1]
    assert len(got[2]["text"]) < 0.2 * len(rows[1][1]) and len(got[3]["text"]) < 0.25 * len(rows[2][1])


M64 = (1 << 64) - 1


def mixed(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M64
    return x ^ x >> 31


def hashed(data):
    power, total = 1, 0
    for byte in data:
        total = (total + (byte + 1) * power) & M64
        power = power * 0x9E3779B97F4A7C15 & M64
    return mixed((total + len(data) * 0xD6E8FEB86659FD93) & M64)


def chunks_of(text, least=8, long_line=30, joins=16):
    """(place, bytes, words, from, to) of every chunk of enough words, by plain loops."""
    raw = (text or "").encode()
    units, at = [], 0  # begin, first word, end of last word, words, line, row of words in the line
    for number, line in enumerate(raw.split(b"\n")):
        in_line = len(re.findall(rb"[^\x20\x09-\x0D]+", line))
        for piece in re.split(rb"(?<=[.!?]\x20)", line):
            spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", piece)]
            if spans:
                units.append((at, at + spans[0][0], at + spans[-1][1], len(spans), number, in_line >= long_line))
            at += len(piece)
        at += 1
    section = [0] * len(units)
    for i in range(1, len(units)):
        long_edge = units[i][5] != units[i - 1][5] or (units[i][5] and units[i][4] != units[i - 1][4])
        section[i] = section[i - 1] + long_edge
    own = [hashed(raw[u[1] : u[2]]) for u in units]
    full = [u[3] >= least for u in units]
    rolling = []
    for i in range(len(units)):
        before = own[i - 1] if i and section[i - 1] == section[i] else 0
        rolling.append(mixed(own[i] if full[i] else (own[i] + before * 0xFF51AFD7ED558CCD) & M64))
    ends = []
    for i in range(len(units)):
        last = i + 1 == len(units) or section[i + 1] != section[i]
        if last or full[i]:
            ends.append(last or rolling[i] % joins != 0)
            continue
        if full[i + 1]:
            ends.append(True)
            continue
        low, high = i, i
        while low and section[low - 1] == section[i] and not full[low - 1]:
            low -= 1
        while high + 1 < len(units) and section[high + 1] == section[i] and not full[high + 1]:
            high += 1
        words = lambda x, y: sum(u[3] for u in units[x:y])
        fits = words(low, i + 1) >= least and words(i + 1, high + 1) >= least
        for j in range(low, high + 1):
            if j < i and words(j + 1, i + 1) < least:
                fits &= rolling[i] < rolling[j]
            elif j > i and words(i + 1, j + 1) < least:
                fits &= rolling[i] <= rolling[j]
        ends.append(fits)
    out, head = [], 0
    for i, end in enumerate(ends):
        if end:
            count = sum(u[3] for u in units[head : i + 1])
            if count >= least:
                to = units[i + 1][0] if i + 1 < len(units) else len(raw)
                out.append((len(out), raw[units[head][1] : units[i][2]], count, units[head][0], to))
            head = i + 1
    return out


def test_line_chunks_against_brute_force(spark):
    rows = texts(spark) + [(1000 + i, t) for i, t in enumerate(ODD)]
    first, want = {}, {}
    keyed = sorted((d, p, c, w) for d, t in rows for p, c, w, _, _ in chunks_of(t))
    for d, p, c, w in keyed:
        if w >= lines.LEAST_WORDS:
            first.setdefault(c, (d, p))
    for d, t in rows:
        out, at, raw = b"", 0, (t or "").encode()
        for p, c, w, a, b in chunks_of(t):
            if w >= lines.LEAST_WORDS and first[c] != (d, p):
                out, at = out + raw[at:a], b
        want[d] = None if t is None else (out + raw[at:]).decode()
    got = {r["doc_id"]: r["text"] for r in lines.drop_repeated_chunks(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == want
    assert sum(got[d] != t for d, t in rows) > 3


def test_line_chunks_odd_rows(spark):
    docs = odd_docs(spark)
    got = lines.drop_repeated_chunks(docs)
    assert got.count() == docs.count()
    assert got.columns == [c for c in docs.columns if c != "n_removed"] + ["n_removed"]
    assert lines.drop_repeated_chunks(empty_docs(spark)).count() == 0


def test_chunks_with_one_hash_and_different_bytes_stay(spark):
    """Thue-Morse words of 2,048 letters and their complements meet in any polynomial hash modulo 2 ** 64."""
    thue_morse = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
    other = thue_morse.translate(str.maketrans("ab", "ba"))
    line = "one two three {} four five six seven eight."
    assert hashed(line.format(thue_morse).encode()) == hashed(line.format(other).encode())
    rows = [(1, line.format(thue_morse)), (2, line.format(other)), (3, line.format(other)), (4, line.format(thue_morse))]
    got = {r["doc_id"]: r["text"] for r in lines.drop_repeated_chunks(spark.createDataFrame(rows, DOCS)).collect()}
    # Compared with the first: the equal one goes, the others stay.
    assert got == {1: rows[0][1], 2: rows[1][1], 3: rows[2][1], 4: ""}


def test_ids_of_any_type(spark):
    rng = random.Random(28)
    same = sentence(rng, 40)
    rows = [("b", same), ("a", same), (None, "x y"), ("c", sentence(rng, 40))]
    got = {r["doc_id"]: r["text"] for r in lines.drop_repeated_chunks(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"a": same, "b": "", None: "x y", "c": rows[3][1]}


def planted(spark, seed, shapes, join, around, trials=60):
    """Share of the words of passages, each in two unrelated documents, that are gone from the second; the least share of one."""
    rng, rows, passages = random.Random(seed), [], []
    line = lambda: " ".join(sentence(rng, rng.randint(4, 14)) for _ in range(rng.randint(1, 4)))
    for i in range(trials):
        parts = [sentence(rng, n) for n in shapes[i % len(shapes)]]
        passages.append(parts)
        for half in (0, 1):
            before, after = (around.join(line() for _ in range(3)) for _ in range(2))
            rows.append((i + half * trials, before + around + join.join(parts) + around + after))
    got = {r["doc_id"]: r["text"] for r in lines.drop_repeated_chunks(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[i] == rows[2 * i][1] for i in range(trials))
    gone = []
    for i, parts in enumerate(passages):
        left = Counter(got[i + trials].split())
        words = join.join(parts).split()
        gone.append(sum(left[w] == 0 for w in words) / len(words))
        # Nothing else goes.
        assert all(left[w] for w in set(rows[2 * i + 1][1].split()) - set(words))
    return np.mean(gone), min(gone)


def test_long_lines_go_wherever_they_stand(spark):
    assert planted(spark, 21, [[20] * 3, [14] * 4, [10] * 6, [7, 1, 7, 30, 9]], " ", "\n")[0] > 0.99


def test_passages_inside_a_line_and_over_short_lines_go(spark):
    shapes = [[20] * 3, [14] * 4, [10] * 6]
    for seed, join, around in ((22, " ", " "), (23, "\n", "\n")):
        share, least = planted(spark, seed, shapes, join, around)
        assert share >= 0.9 and least > 0


def test_passages_of_short_sentences_mostly_go(spark):
    shapes = [[3, 20, 2, 20, 7], [6] * 10, [1, 1, 50, 1], [7, 1, 7, 30, 2, 2]]
    for seed, join, around in ((24, " ", "\n"), (25, "\n", "\n"), (26, " ", " ")):
        assert planted(spark, seed, shapes, join, around)[0] >= 0.65


def test_borders_move_with_the_text(spark):
    """What stands before a passage changes its first chunk at most."""
    rng = random.Random(29)
    passage = "\n".join(sentence(rng, rng.randint(2, 12)) for _ in range(40))
    own = [c for _, c, *_ in chunks_of(passage)]
    for _ in range(20):
        moved = [c for _, c, *_ in chunks_of(sentence(rng, rng.randint(1, 9)) + "\n" + passage)]
        assert set(own[2:]) <= set(moved)


def test_texts_of_short_lines_lose_only_repeats(spark):
    rng = random.Random(27)
    units = ["la la la.", "do.", "re mi fa sol la ti do re mi.", "so so."]
    rows = [(i, "\n".join(rng.choices(units, k=rng.randint(1, 40)))) for i in range(30)]
    got = lines.drop_repeated_chunks(spark.createDataFrame(rows, DOCS)).collect()
    assert {u for _, t in rows for u in t.split("\n")} == {u for r in got for u in r["text"].split("\n") if u}
    before = dict(rows)
    assert all(len([u for u in r["text"].split("\n") if u]) == len(before[r["doc_id"]].split("\n")) - r["n_removed"] for r in got)
    assert sum(r["n_removed"] for r in got) > 20


# --- queries and pipeline --------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op2_decontamination", "op7_near_duplicates", "op8_url_rules", "op9_chat_windows", "op13_filter_audit"])
def test_query_matches_sql(spark, name):
    from compare import compare, connect

    outcome = compare(spark, connect(FOLDER), name, FOLDER)
    assert outcome.startswith("ok"), outcome


def test_queries_cover_whole_tables(spark):
    n = documents(spark).count()
    for name in ("op3_license_scan", "op4_toxicity", "op5_repetition_rules", "op6_ring_sharding", "op10_line_chunks"):
        assert QUERIES[name](spark, FOLDER).count() == n


def test_pipeline(spark):
    docs = documents(spark)
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, FOLDER)
        assert out.columns == docs.columns
        before = {r[0]: r[1] for r in kept.select("doc_id", "text").collect()}
        after = {r[0]: r[1] for r in out.select("doc_id", "text").collect()}
        assert set(after) <= set(before)
        if name != "line_dedup":
            assert all(before[d] == t for d, t in after.items())
        else:
            assert set(after) == set(before)
        if name == "near_dedup":
            groups = brute.near_duplicates(list(before.items()), 5, 80)
            assert set(after) == {d for d, (_, c) in groups.items() if c == d}
        if name == "decontamination":
            bench = [(r[0], r[1]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
            assert set(after) == {d for d, (_, hit, _) in brute.contamination(before.items(), bench).items() if not hit}
        kept = spark.createDataFrame(out.collect(), out.schema)
    check_pieces(corpus_pipeline.pack(spark, kept, FOLDER).collect(), [(r[0], exact_ids(r[1])) for r in kept.select("doc_id", "text").collect()])


def test_pipeline_odd_rows(spark, tmp_path):
    rows = list(enumerate(ODD)) + [(3, "one"), (None, "one")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= len(ODD) - 1
