import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from pelagia.llm import mixing, queries
from tests.conftest import as_rows, duck
from tests.llm.helpers import awkward, empty


def share(budget, children):
    """Budgets of children (name, weight, most), one filled after the other."""
    order = sorted(children, key=lambda c: (c[2] / c[1], c[0]))
    left, weight, out = budget, sum(c[1] for c in children), {}
    for k, (name, w, most) in enumerate(order):
        if most * weight > w * left:
            return out | {n: x * left // weight for n, x, _ in order[k:]}
        out[name] = most
        left, weight = left - most, weight - w
    return out


def allocate(budget, leaves, weights, depth=0):
    """Budgets of leaves (path -> most) by walking down the tree."""
    if depth == len(next(iter(leaves))):
        return {path: min(budget, most) for path, most in leaves.items()}
    below = defaultdict(dict)
    for path, most in leaves.items():
        below[path[depth]][path] = most
    got = share(budget, [(n, weights[depth].get(n, 1), sum(x.values())) for n, x in below.items()])
    return {p: b for name, part in below.items() for p, b in allocate(got[name], part, weights, depth + 1).items()}


def budgets(spark, budget, leaves, weights, epochs=1):
    names = [f"level{k}" for k in range(len(weights))]
    rows = spark.createDataFrame([(*k, t) for k, t in leaves.items()], ", ".join(f"{n} string" for n in names) + ", t long")
    return {tuple(r[n] for n in names): r.b for r in mixing.budgets(rows, names, budget, weights, epochs).collect()}


def test_shortage_goes_to_siblings_first(spark):
    leaves = {("web", "en"): 10, ("web", "de"): 1000, ("book", "en"): 1000}
    got = budgets(spark, 600, leaves, [{"web": 1, "book": 1}, {}])
    # web's half is 300: en can give 10, so de makes up for it and book gets no more than its own half
    assert got == {("web", "en"): 10, ("web", "de"): 290, ("book", "en"): 300}
    leaves[("web", "de")] = 20
    assert budgets(spark, 600, leaves, [{"web": 1, "book": 1}, {}]) == {("web", "en"): 10, ("web", "de"): 20, ("book", "en"): 570}


def test_budgets_against_a_walk(spark):
    random.seed(5)
    for _ in range(6):
        leaves = {(random.choice("abc"), random.choice("uvwxyz"), str(k)): random.randint(0, 50) * random.choice([1, 10**12]) for k in range(random.randint(1, 60))}
        weights = [{"a": 4, "b": 9}, {"u": 2, "z": 7}, {}]
        total = sum(leaves.values())
        for want in (0, total // 3, 3 * total):
            got = budgets(spark, want, leaves, weights, 2)
            assert got == allocate(want, {k: 2 * t for k, t in leaves.items()}, weights)
            assert min(want, 2 * total) - 3 * len(leaves) < sum(got.values()) <= min(want, 2 * total)


def test_more_leaves_than_a_driver_is_given(spark):
    """A leaf for each of 120,000 documents, met by a shuffle."""
    docs = spark.range(120_000).select(F.col("id").alias("doc_id"), (F.col("id") % 7 + 1).alias("n"), F.concat(F.lit("s"), "id").alias("s"))
    got = mixing.mix(docs, [F.lit("all"), F.col("s")], F.col("n"), [{}, {}], budget=10**6, max_epochs=2, broadcast_bytes=0)
    assert got.agg(F.sum(F.col("n") * F.col("epochs"))).first()[0] <= 10**6 and got.where("epochs = 2").count() > 10_000


def test_ties_at_the_cut(spark):
    """Rows of one id and one length: which of them is in the prefix doesn't depend on their order."""
    rows = [(1, 10, f"text {k}") for k in range(40)]
    seen = set()
    for k in range(3):
        random.shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id LONG, n LONG, text STRING").repartition(k + 1)
        seen.add(tuple(sorted(r.text for r in mixing.mix(docs, [F.lit("a")], F.col("n"), [{}], budget=155).collect())))
    assert len(seen) == 1 and len(seen.pop()) == 15


def brute(rows, budgets, seed):
    """{(leaf, id): times} by walking each leaf's order."""
    by = defaultdict(list)
    for leaf, name, n in rows:
        by[leaf].append((name, n))
    out = {}
    for leaf, docs in by.items():
        total = sum(n for _, n in docs)
        full, rest = divmod(budgets[leaf], total) if total else (0, 0)
        key = lambda d, full=full: (hashlib.md5(f"{seed}:{full}:{d[0]}".encode()).hexdigest(), d[1])
        used = 0
        for name, n in sorted(docs, key=key):
            used += n
            out[leaf, name] = full + (rest > 0 and used <= rest)
    return {k: v for k, v in out.items() if v}


def test_against_brute_force(spark):
    random.seed(9)
    rows = [((random.choice("ab"), random.choice("xyz")), i, random.choice([0, 1, 5, 30])) for i in range(800)]
    docs = spark.createDataFrame([(a, b, i, n, "e") for (a, b), i, n in rows], "d STRING, l STRING, doc_id LONG, n LONG, epochs STRING")
    weights = [{"a": 3}, {"x": 5}]
    total = defaultdict(int)
    for leaf, _, n in rows:
        total[leaf] += n
    for budget in (0, 100, 5000, sum(total.values()), 10**6):
        plan = allocate(budget, {k: 3 * t for k, t in total.items()}, weights)
        got = mixing.mix(docs, [F.col("d"), F.col("l")], F.col("n"), weights, budget=budget, max_epochs=3, seed=11)
        assert {((r.d, r.l), r.doc_id): r.epochs for r in got.collect()} == brute(rows, plan, 11)


def test_query_against_sql(spark, sf):
    got = queries.op1_mixing(spark, sf).toPandas()
    want = duck(sf).execute(queries.ORACLES["op1_mixing"]).df()
    assert as_rows(got) == as_rows(want)


def test_awkward_and_empty(spark):
    levels = [mixing.domain(), F.col("lang"), F.col("source")]
    got = mixing.mix(awkward(spark), levels, mixing.words("text"), mixing.WEIGHTS, share_of_corpus=4.0)
    assert got.where("epochs = 4").count() >= 5  # everything with tokens, as often as can be
    assert mixing.mix(empty(spark), levels, mixing.words("text"), mixing.WEIGHTS).collect() == []
