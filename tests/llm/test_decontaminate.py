import hashlib
import random
import re
import time

import numpy as np

from pelagia.llm import decontaminate as D
from tests.llm.helpers import AWKWARD, awkward, clashing, empty

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(texts, items, window):
    wins = {}
    for name, text in items:
        w = words(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + k]), set()).add(name)
    out = []
    for t in texts:
        w = words(t)
        hit, names = [False] * len(w), set()
        for k in {len(x) for x in wins}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in wins:
                    names |= wins[tuple(w[i : i + k])]
                    hit[i : i + k] = [True] * k
        names = sorted(n for n in names if n is not None)
        out.append((len(w), sum(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), any(hit)))
    return out


def case(seed):
    random.seed(seed)
    vocabulary = [chr(97 + i) for i in range(random.choice([1, 2, 4]))] + ["É"]
    some = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    items = [(random.choice([str(i), None]), some(random.choice([0, 1, 2, 3, 5, 8]))) for i in range(random.randint(0, 5))] + [("x", None)]
    return [some(random.choice([0, 1, 5, 30])) + random.choice(["", " zz "]) + some(5) for _ in range(6)] + [None, ""], items


def test_suffix_array_is_sorted():
    for seed in range(30):
        ids = np.random.default_rng(seed).integers(0, 4, 60).astype(np.int32)
        ids = np.append(ids, 0)
        array = D.suffix_array(ids)

        def suffix(p, ids=ids):
            return ids[p : p + np.flatnonzero(ids[p:] == 0)[0]].tolist()

        found = [suffix(p) for p in array]
        assert found == sorted(found) and sorted(array.tolist()) == np.flatnonzero(ids).tolist()


def test_against_brute_force(spark):
    items_schema, docs_schema = "item_id STRING, text STRING", "doc_id LONG, text STRING"
    for seed in range(6):
        texts, items = case(seed)
        docs = spark.createDataFrame(list(enumerate(texts)), docs_schema).coalesce(1)
        bench = spark.createDataFrame(items, items_schema)
        want = brute(texts, items, 3)
        for shard, block in ((1 << 20, 1 << 20), (8, 16)):  # one shard and block, and many of both
            got = sorted(D.contamination(docs, bench, window=3, shard_words=shard, block_bytes=block).collect())
            assert [tuple(r)[1:] for r in got] == want
        clean = sorted(r.doc_id for r in D.decontaminated(docs, bench, window=3, shard_words=8).collect())
        assert clean == [i for i, w in enumerate(want) if not w[4]]


def test_matches_are_maximal(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, f"start {item} end"), (2, "zero " + " ".join(item.split()[1:11])), (3, "one two three")], "doc_id LONG, text STRING")
    bench = spark.createDataFrame([("q", item)], "item_id STRING, text STRING")
    got = sorted(map(tuple, D.matches(docs, bench).collect()))
    assert got == [(1, "q", 1, 0, 12), (2, "q", 1, 1, 10)]


def brute_matches(text, items, window):
    a, out = words(text), set()
    for name, item in items:
        b = words(item)
        k = min(window, len(b))
        for i in range(len(a)):
            for j in range(len(b)):
                if i and j and a[i - 1] == b[j - 1]:
                    continue
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                if b and n >= k and name is not None:
                    out.add((name, i, j, n))
    return out


def test_matches_against_brute_force(spark):
    for seed in range(6, 12):
        texts, items = case(seed)
        items = [(f"{n}-{k}" if n else None, t) for k, (n, t) in enumerate(items)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING").coalesce(1)
        got = [tuple(r) for r in D.matches(docs, spark.createDataFrame(items, "item_id STRING, text STRING"), window=3).collect()]
        want = {(k, *m) for k, t in enumerate(texts) for m in brute_matches(t, items, 3)}
        assert len(got) == len(set(got)) and set(got) == want


def test_one_word_over_and_over():
    """A million equal words against an item of ten thousand: by ranges, not by 10^10 pairs."""
    began = time.time()
    tests = D.TestSet([("x", "la " * 10_000), ("y", "la la")])
    shard = D.Shard(["la " * 1_000_000, "other", "la la la"], tests)
    found = D.Ranges(shard.ids, tests)
    assert len(found) == 2 and len(found.places()[0]) < 3_000_000
    rows = sum(len(a) for a, _, _ in D.longest(found, len(shard.ids), D.WINDOW))
    # of x a match per diagonal that holds a window; of y one at each place
    assert rows == (1_000_000 - 9) + (10_000 - 9) - 1 + (1_000_000 - 1) + 2
    assert time.time() - began < 60


def test_very_long_text_by_pieces(monkeypatch):
    text = "One two-three É " * 40_000
    whole, n = D.word_ids(text, {b"one": 1, "É".encode(): 2})
    monkeypatch.setattr(D, "PIECE_BYTES", 1000)
    again, m = D.word_ids(text, {b"one": 1, "É".encode(): 2})
    assert n == m == 160_000 and (whole == again).all()


def test_awkward_rows(spark):
    bench = spark.createDataFrame([(7, "goes on and on a long one goes on and"), (8, None), (None, "brown fox jumps")], "item_id LONG, text STRING")
    got = D.contamination(clashing(spark, "n_hit", "item_id"), bench).collect()
    assert len(got) == len(AWKWARD)
    assert {r.doc_id for r in got if r.contaminated} == {1, 5}
    assert all(r.n_items == 0 and r.n_hit == 24 for r in got if r.doc_id == 1)  # hit by an item without a name
    none = bench.limit(0)
    assert not any(r.contaminated for r in D.contamination(awkward(spark), none).collect())
    assert D.contamination(empty(spark), bench).collect() == []
    kept = D.decontaminated(clashing(spark, "x"), bench)
    assert kept.count() == len(AWKWARD) - 3 and kept.columns[-1] == "x"
