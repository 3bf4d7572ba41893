import numpy as np

from pelagia.llm import quality
from tests.llm.helpers import AWKWARD, awkward, clashing, empty


def test_em_recovers_accuracies():
    rng = np.random.default_rng(1)
    n, good = 20_000, rng.random(20_000) < 0.8
    sees = np.array([[0.5, 0.99], [0.35, 0.97], [0.6, 0.995], [0.3, 0.99]])  # right on bad, right on good
    votes = np.where(good[:, None], rng.random((n, 4)) < sees[:, 1], rng.random((n, 4)) >= sees[:, 0])
    said = rng.random((n, 4)) < 0.9
    patterns = ["".join("1" if v else "0" if s else "-" for v, s in zip(r, q)).replace("0-", "0-") for r, q in zip(votes, said)]
    patterns = ["".join(("1" if v else "0") if s else "-" for v, s in zip(r, q)) for r, q in zip(votes, said)]
    counts = {}
    for p in patterns:
        counts[p] = counts.get(p, 0) + 1
    model = quality.fit_votes(counts, 4)
    assert abs(model.good - 0.8) < 0.04
    assert np.abs(model.accuracy() - sees).max() < 0.08


def brute_em(votes, rounds):
    """The same model document by document, without patterns."""
    n, k = votes.shape
    good, says = 0.8, np.tile(np.array([[0.3, 0.7], [0.02, 0.98]]), (k, 1, 1))
    for _ in range(rounds):
        p = np.empty(n)
        for i in range(n):
            b, g = 1 - good, good
            for j in range(k):
                if votes[i, j] >= 0:
                    b *= says[j, 0, votes[i, j]]
                    g *= says[j, 1, votes[i, j]]
            p[i] = g / (b + g)
        says = np.ones((k, 2, 2))
        for i in range(n):
            for j in range(k):
                if votes[i, j] >= 0:
                    says[j, 0, votes[i, j]] += 1 - p[i]
                    says[j, 1, votes[i, j]] += p[i]
        says /= says.sum(2, keepdims=True)
        good = p.mean()
    return good, says


def test_em_against_document_by_document():
    rng = np.random.default_rng(2)
    votes = rng.integers(-1, 2, (200, 3))
    counts = {}
    for v in votes:
        key = "".join("-01"[x + 1] for x in v)
        counts[key] = counts.get(key, 0) + 1
    model = quality.fit_votes(counts, 3, rounds=5)
    good, says = brute_em(votes, 5)
    assert abs(model.good - good) < 1e-9 and np.abs(model.says - says).max() < 1e-9


def test_held_out_accuracy(spark):
    where = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet").toPandas()
    got = quality.classify(docs).toPandas().merge(labels, on="doc_id")  # labels took no part in the fit
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert good.kept.mean() > 0.99
    assert bad.kept.mean() < 0.1


def test_keep_good_is_classify(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = {r.doc_id for r in quality.classify(docs).where("kept").collect()}
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == kept


def test_awkward_and_empty(spark):
    got = quality.classify(clashing(spark, "kept", "score", "place", "votes")).collect()
    assert len(got) == len(AWKWARD)
    assert all(not r.kept and r.score == 0 for r in got if r.n_words == 0)
    assert quality.classify(empty(spark)).collect() == [] and quality.keep_good(empty(spark)).collect() == []
    assert quality.keep_good(awkward(spark)).columns == awkward(spark).columns


def test_a_text_is_judged_whole():
    plain = "Words of a plain and quiet sort go on here. " * 40
    tail = "### $$$ %%% " * 600
    assert quality.votes(quality.look(plain))[0] == "1" and quality.votes(quality.look(plain + tail))[0] == "0"
