import random

import numpy as np
import xxhash

from pelagia.llm import simhash
from pelagia.llm.components import components
from tests.llm.helpers import AWKWARD, awkward, clashing, empty


def plain_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints):
    """{id: least id reachable} for {id: fingerprint}."""
    label = {i: i for i in prints}
    moved = True
    while moved:
        moved = False
        for a in prints:
            for b in prints:
                if label[b] < label[a] and (prints[a] ^ prints[b]).bit_count() <= 3:
                    label[a], moved = label[b], True
    return label


def test_fingerprint():
    for _, text, *_ in AWKWARD:
        assert simhash.fingerprint(text) == plain_fingerprint(text)
    assert simhash.fingerprint("One TWO") == plain_fingerprint("one two")


def test_code_is_perfect():
    code = simhash.Golay.get()
    words = np.random.default_rng(0).integers(0, 1 << 23, 2000).astype(np.uint32)
    error = code.error[code.syndrome(words)]
    assert (code.syndrome(words ^ error) == 0).all()
    assert np.bitwise_count(error).max() == 3 and len(set(code.error.tolist())) == 2048


def table(spark, prints):
    return spark.createDataFrame([(simhash.signed(x),) for x in prints], "fp LONG")


def test_links_against_brute_force(spark):
    random.seed(3)
    prints = set()
    for _ in range(40):
        x = random.getrandbits(64)
        for _ in range(random.choice([1, 1, 5, 40])):
            y = x
            for _ in range(random.randint(0, 5)):
                y ^= 1 << random.randrange(64)
            prints.add(y)
            x = random.choice([x, y])
    by_id = dict(enumerate(sorted(prints, key=simhash.signed)))
    want = plain_classes(by_id)
    for block in (4, 2048):  # many blocks an anchor, and one
        found = components(simhash.links(table(spark, prints), block=block)).collect()
        ids = {simhash.signed(x): i for i, x in by_id.items()}
        got = {i: i for i in by_id} | {ids[r.node]: ids[r.label] for r in found}
        assert got == want


def test_links_are_no_more_than_stars(spark):
    base = 0x0123456789ABCDEF
    prints = {base ^ 1 << a ^ 1 << b for a in range(24) for b in range(a)} | {base}
    n = simhash.links(table(spark, prints)).count()
    assert n < 40 * len(prints)  # all pairs would be some 15,000


def test_near_duplicates_on_awkward_rows(spark):
    got = simhash.near_duplicates(awkward(spark)).collect()
    assert len(got) == len(AWKWARD)
    zero = [r for r in got if r.fingerprint == "0" * 16]
    assert len(zero) == 4 and {r.component_id for r in zero} == {2}
    assert sorted(r.fingerprint for r in got) == sorted(f"{plain_fingerprint(t):016x}" for _, t, *_ in AWKWARD)
    assert [r.component_id for r in got if r.doc_id == 1] == [1, 1]


def test_empty_and_clashing(spark):
    assert simhash.near_duplicates(empty(spark)).collect() == []
    assert simhash.one_of_each(empty(spark)).collect() == []
    assert simhash.near_duplicates(clashing(spark, "fp", "fingerprint", "label", "node")).count() == len(AWKWARD)


def test_one_of_each(spark):
    kept = simhash.one_of_each(clashing(spark, "label", "component_id"))
    assert kept.columns[-2:] == ["label", "component_id"]
    rows = kept.collect()
    # one of the twice-given 1, one of the empty class (the smallest id), and the others
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [1, 2, 5, 6]
    assert [r.text for r in rows if r.doc_id is None] == [AWKWARD[3][1]]


def test_components_of_a_long_chain(spark):
    links = spark.range(1, 300).selectExpr("id a", "id + 1 b").union(spark.createDataFrame([(1000, 1001), (1001, 1000), (5, 5)], "a LONG, b LONG"))
    got = {r.node: r.label for r in components(links).collect()}
    assert got == {i: 1 for i in range(1, 301)} | {1000: 1000, 1001: 1000}
