import random

import numpy as np

import corpus_pipeline as pipeline
from pelagia.llm import jaccard, simhash
from tests.llm.helpers import AWKWARD, awkward, empty


def plain_set(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_classes(texts):
    """{id: least id reachable} for {id: text}."""
    sets, label = {i: plain_set(x) for i, x in texts.items()}, {i: i for i in texts}
    alike = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    near = [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])]
    moved = True
    while moved:
        moved = False
        for a, b in near:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def planted():
    """Texts of their own words, copies with a few words changed on both sides of 0.8, chains, and a common line."""
    rng, texts = random.Random(5), []
    line = " ".join(f"line{k}" for k in range(12))
    for base in range(25):
        words = [f"w{base}x{rng.randrange(10**6)}" for _ in range(rng.choice([8, 60, 200, 400]))]
        for _ in range(rng.choice([1, 3, 12])):
            texts.append(" ".join(words) + (f" {line}" if rng.random() < 0.5 else ""))
            words = list(words)
            for _ in range(rng.randrange(1, 1 + max(1, len(words) // 25))):
                words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return dict(enumerate(texts))


def test_classes_against_brute_force(spark):
    texts = planted()
    got = {r.doc_id: r.component_id for r in jaccard.near_copies(spark.createDataFrame(list(texts.items()), "doc_id LONG, text STRING")).collect()}
    want = plain_classes(texts)
    assert got == want and 25 < len(set(want.values())) < len(texts)


def test_stage_takes_near_copies_that_fingerprints_miss(spark, sf):
    words = [f"word{k}" for k in range(200)]
    edited = words[:50] + ["one"] + words[51:120] + ["two"] + words[121:]  # 186 of 206 shingles shared: 0.90
    below = words[:20] + ["a"] + words[21:60] + ["b"] + words[61:100] + ["c"] + words[101:140] + ["d"] + words[141:180] + ["e"] + words[181:]  # 171 of 221
    rows = [(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(below))]
    assert (simhash.fingerprint(rows[0][1]) ^ simhash.fingerprint(rows[1][1])).bit_count() > simhash.THRESHOLD
    docs = spark.createDataFrame([(i, x, "en", "src0", len(x)) for i, x in rows], "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG")
    assert sorted(r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, sf).collect()) == [1, 3]


def test_histograms_never_rule_out_too_much():
    rng = np.random.default_rng(3)
    for n in (1, 40, 300, 5000):
        for _ in range(30):
            whole = rng.integers(-(1 << 62), 1 << 62, 2 * n)
            a, b = np.unique(whole[: n + rng.integers(0, n // 2 + 1)]), np.unique(whole[rng.integers(0, n // 3 + 1) : n + rng.integers(0, n + 1)])
            assert jaccard.apart(jaccard.histogram(a), jaccard.histogram(b)) <= len(np.setxor1d(a, b))
    few, many = np.arange(400) << 20, np.arange(3000) << 20  # all in one bin, over what a byte counts
    assert jaccard.apart(jaccard.histogram(few), jaccard.histogram(many)) <= 2600
    other = rng.integers(-(1 << 62), 1 << 62, 20_000)
    assert jaccard.apart(jaccard.histogram(other), jaccard.histogram(other ^ 0x5555555555)) > 0.23 * 20_000  # nothing in common: ruled out


def test_parities_tell_what_is_just_too_far():
    """Sets at 0.7 are ruled out at any size, by FEW parities too where they are small; counts of 64 bins let all of these pass."""
    rng = np.random.default_rng(9)
    for n in (150, 1000, 20_000):
        for _ in range(20):
            whole = np.unique(rng.integers(-(1 << 62), 1 << 62, n + n * 3 // 17))
            a, b = np.unique(whole[:n]), np.unique(whole[-n:])  # 14 of 20 parts shared
            assert 0.69 < len(np.intersect1d(a, b)) / len(np.union1d(a, b)) < 0.71
            assert 9 * jaccard.apart(jaccard.histogram(a), jaccard.histogram(b)) > 2 * n
            if n == 150:
                assert 9 * jaccard.apart(jaccard.parities(a, jaccard.FEW), jaccard.parities(b, jaccard.FEW)) > 2 * n


def group_of_copies(n=60, edits=28):
    """Copies of one text, each with so many words of its own: each to the text and each other less than 0.8."""
    rng, words = random.Random(6), [f"w{k}" for k in range(400)]
    out = {}
    for i in range(n):
        own = list(words)
        for k in rng.sample(range(0, 400, 5), edits // 2):
            own[k] = f"own{i}x{k}"
        out[i] = " ".join(own)
    return out


def test_pairs_of_a_group_leave_the_join_once_if_at_all(spark, monkeypatch):
    texts = group_of_copies()
    docs = spark.createDataFrame(list(texts.items()), "doc_id LONG, text STRING")
    counts, real = [], jaccard._meetings

    def counted(left, t):
        met = real(left, t)
        counts.append((met.count(), met.distinct().count(), left.alias("x").join(left.alias("y"), "key").where("x.node < y.node").count()))
        return met

    monkeypatch.setattr(jaccard, "_meetings", counted)
    got = {r.doc_id: r.component_id for r in jaccard.near_copies(docs).collect()}
    assert got == plain_classes(texts)
    ((rows, pairs, every),) = counts
    assert every > 10_000 and rows < 1770 // 4  # of all 1,770 pairs


def test_where_two_sets_first_meet_is_never_left_out(spark):
    """Rows of sets that meet at several shingles, alone or in runs: every pair is there, and once a run."""
    rng = random.Random(2)
    rows, meet = [], {}
    kept = {n: sorted(rng.sample(range(40), rng.randint(1, 12))) for n in range(30)}
    for n, keys in kept.items():
        rows += [(k, n, 100, i, n, keys[i - 1] if i else None, [0] * (jaccard.FEW // 64)) for i, k in enumerate(keys)]
    for a in kept:
        for b in kept:
            if a < b and (both := set(kept[a]) & set(kept[b])):
                before = {n: dict(zip(kept[n][1:], kept[n], strict=False)) for n in (a, b)}
                meet[a, b] = sum(1 for k in both if before[a].get(k) is None or before[a].get(k) != before[b].get(k))
    left = spark.createDataFrame(rows, "key LONG, node LONG, n INT, place INT, label LONG, prev LONG, few ARRAY<LONG>")
    got = {}
    for r in jaccard._meetings(left, jaccard.Fraction(4, 5)).collect():
        got[r.a, r.b] = got.get((r.a, r.b), 0) + 1
    assert got == meet and len(got) > 200


def test_sketch_is_the_fingerprint_of_texts_without_repeats():
    text = " ".join(f"w{k}" for k in range(90))
    assert jaccard.sketch(jaccard.shingles(text)) == simhash.signed(simhash.fingerprint(text, 5)) and jaccard.sketch(jaccard.shingles("")) == 0


def test_awkward_and_empty(spark):
    stage = lambda docs: simhash.one_of_each(docs, shingle=5, similarity=0.8)
    rows = stage(awkward(spark)).collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [1, 2, 5, 6]
    assert [r.text for r in rows if r.doc_id is None] == [AWKWARD[3][1]]
    assert stage(empty(spark)).collect() == []
