from collections import Counter, defaultdict

import pytest

import corpus_pipeline as pipeline
from pelagia.llm import mixing, quality, shards
from pelagia.llm.common import written
from tests.llm import test_mixing
from tests.llm.helpers import AWKWARD, awkward, clashing, empty
from tests.llm.test_decontaminate import brute
from tests.llm.test_jaccard import plain_classes
from tests.llm.test_shards import plain

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def run(spark, sf):
    """(documents, the rows that each stage gives)."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at, seen = docs, {}
    for name, stage in pipeline.STAGES:
        at = written(stage(spark, at, sf), name)
        seen[name] = at.collect()
        if name != "sharding":
            assert at.columns == COLUMNS
    return docs.collect(), seen


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_quality_by_the_scorer_text_by_text(spark, run):
    """The classifier's fit is held to brute force in test_quality; here each text is scored by itself, with plain sums."""
    docs, seen = run
    scorer = quality.fit(spark.createDataFrame(docs)).scorer
    kept = []
    for r in docs:
        look = quality.look(r.text)
        total = scorer.bias + sum(scorer.weights[b] * v for b, v in zip(look.buckets.tolist(), look.values.tolist(), strict=True))
        if look.n and total >= 0:
            kept.append(r.doc_id)
    assert ids(seen["quality"]) == sorted(kept) and 0 < len(kept) < len(docs)


def test_quality_on_labels(spark, run, sf):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = set(ids(run[1]["quality"]))
    good = [i in kept for i, r in labels.items() if r.quality == 1 and not r.toxic]
    bad = [i in kept for i, r in labels.items() if r.quality == 0]
    assert sum(good) / len(good) > 0.97 and (not bad or sum(bad) / len(bad) < 0.6)  # eleven of them; test_quality has more


def test_near_duplicates_against_all_pairs(run):
    texts = {r.doc_id: r.text for r in run[1]["quality"]}
    classes = plain_classes(texts)
    assert ids(run[1]["near_duplicates"]) == sorted(set(classes.values())) and len(set(classes.values())) < len(texts)


def test_decontamination_against_brute_force(spark, run, sf):
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before = run[1]["near_duplicates"]
    hit = [w[4] for w in brute([r.text for r in before], items, 10)]
    assert ids(run[1]["decontamination"]) == sorted(r.doc_id for r, h in zip(before, hit, strict=True) if not h) and any(hit)


def test_mixing_against_a_walk(run):
    """Domains, tokens, budgets and prefixes worked out row by row."""
    rows, total = [], defaultdict(int)
    for r in run[1]["decontamination"]:
        tail = (r.source or "").removeprefix("src")
        domain = ("web", "books", "reference", "forum")[int(tail) % 4] if tail.isdigit() else "other"
        leaf, n = (domain, r.lang or "", r.source or ""), len((r.text or "").split())
        rows.append((leaf, r.doc_id, n))
        total[leaf] += n
    plan = test_mixing.allocate(sum(total.values()), {k: mixing.MAX_EPOCHS * t for k, t in total.items()}, mixing.WEIGHTS)
    want = Counter({i: times for (_, i), times in test_mixing.brute(rows, plan, mixing.SEED).items()})
    assert Counter(r.doc_id for r in run[1]["mixing"]) == want and max(want.values()) > 1


def test_sharding_against_a_heap(run):
    mixed, dealt = run[1]["mixing"], run[1]["sharding"]
    assert Counter(r.doc_id for r in dealt) == Counter(r.doc_id for r in mixed)
    groups, of, loads, slots = Counter(), {r.doc_id: r.text for r in mixed}, Counter(), defaultdict(list)
    for r in mixed:
        groups[r.text or ""] += len((r.text or "").encode()) + 1
    together = defaultdict(set)
    for r in dealt:
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
        together[of[r.doc_id]].add(r.shard)
    assert {j: loads.get(j, 0) for j in range(shards.SHARDS)} == plain(groups.values(), shards.SHARDS)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in together.values())


def test_run_is_the_stages_one_after_another(spark, run, sf):
    assert Counter((r.doc_id, r.shard) for r in pipeline.run(spark, sf).collect()) == Counter((r.doc_id, r.shard) for r in run[1]["sharding"])
    assert [name for name, _ in pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]


@pytest.mark.parametrize("name, want", [
    ("near_duplicates", [None, 1, 2, 5, 6]),  # of the twice-given 1 and of the texts without words one each
    ("decontamination", [None, None, 1, 1, 2, 3, 4, 5, 6]),  # no benchmark passage in any
    ("mixing", None),
])
def test_stages_on_awkward_tables(spark, sf, name, want):
    stage = dict(pipeline.STAGES)[name]
    extra = clashing(spark, "label", "epochs_", "fp")
    rows = stage(spark, extra, sf).collect()
    if want is not None:
        assert sorted((r.doc_id for r in rows), key=lambda x: (x is not None, x)) == want
    else:  # rows with tokens come back whole epochs at a time, those without where their leaf gives something
        assert {r.doc_id for r in rows} <= {r[0] for r in AWKWARD} and len(rows) >= 4
    assert all(r.label == "clash" for r in rows)


def test_quality_and_sharding_on_awkward_tables(spark, sf):
    stages = dict(pipeline.STAGES)
    kept = stages["quality"](spark, awkward(spark), sf).collect()
    assert all(r.text and r.text.split() for r in kept) and len(kept) <= len(AWKWARD)
    dealt = stages["sharding"](spark, clashing(spark, "shard", "size"), sf).collect()
    assert len(dealt) == len(AWKWARD) and sum(r.size for r in dealt) == sum(len((t or "").encode()) + 1 for _, t, *_ in AWKWARD)


def test_stages_on_empty_tables(spark, sf):
    at = empty(spark)
    for name, stage in pipeline.STAGES:
        at = written(stage(spark, at, sf), name)
        assert at.count() == 0
    assert {"doc_id", "shard", "slot"} <= set(at.columns)
