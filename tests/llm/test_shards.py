import heapq
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from pelagia.llm import shards
from tests.llm.helpers import AWKWARD, awkward, clashing, empty


def plain(sizes, n):
    """Loads of longest-processing-time scheduling, one group after another."""
    heap = [(0, j) for j in range(n)]
    for s in sorted(sizes, reverse=True):
        load, j = heap[0]
        heapq.heapreplace(heap, (load + s, j))
    return {j: load for load, j in heap}


def test_schedule_against_one_by_one():
    random.seed(4)
    for _ in range(300):
        sizes = [random.choice([1, 2, 3, 5, 8, 100, random.randint(1, 60)]) for _ in range(random.randint(0, 120))]
        n = random.randint(1, 9)
        classes = Counter(sizes)
        order = np.array(sorted(classes, reverse=True), np.int64)
        got = shards.schedule(order, np.array([classes[s] for s in order], np.int64), n)
        loads = {j: int((got[:, j] * order).sum()) for j in range(n)}
        assert loads == plain(sizes, n)
        assert got.sum(1).tolist() == [classes[s] for s in order.tolist()]


def check(rows, texts, n):
    assert len(rows) == len(texts)
    by_text, sizes = defaultdict(set), defaultdict(int)
    for r in rows:
        sizes[r.shard] += r.size
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    for r in rows:
        by_text[r.text_crc32, r.size].add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    groups = Counter()
    for _, t in texts:
        groups[t or ""] += len((t or "").encode()) + 1
    assert {j: sizes.get(j, 0) for j in range(n)} == plain(groups.values(), n)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    for bucket, band in ((7, 200), (10_000, 1 << 18)):  # ranks in many buckets and a plan in many bands, and in one
        check(shards.assign(docs, bucket=bucket, band=band).collect(), texts, 8)


def test_awkward_and_empty(spark):
    check(shards.assign(clashing(spark, "shard", "key", "total", "rank", "bucket"), shards=3).collect(), [r[:2] for r in AWKWARD], 3)
    got = shards.assign(empty(spark))
    assert got.collect() == [] and got.columns == shards.assign(awkward(spark)).columns
