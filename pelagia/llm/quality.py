"""Quality classifier from weak labels.

Heuristic labellers look at every document and say good (1), bad (0) or nothing
(-1); they overlap and contradict each other. Expectation-maximisation estimates
each labeller's accuracy for good and for bad documents and the share of good
ones (the Dawid-Skene model), and with them a posterior label for each pattern
of votes. It needs just the number of documents with each pattern: at most
3 ** labellers rows, counted over all documents. The posteriors of a sample of
at most ``sample`` documents train a linear scorer over hashed features; the
scorer judges every document.

Per document one pass over its words serves both the labellers and the
features: each distinct word's kind, shape and hashes are worked out once per
task and looked up after that.

Defined cases: a text without words (or null) is rejected, with score 0; a text
of under ``MIN_WORDS`` words gets no votes, and the scorer judges it; repeated
rows and repeated or null ids give a row each; an empty table gives an empty
table; extra columns are ignored by ``classify`` and kept by ``keep_good``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.llm.common import TASK_CACHES, arrow_map, map_batches, written

#: Buckets of the hashed features.
BUCKETS = 1 << 14
#: Documents that the scorer is trained on, at most.
SAMPLE = 4000
MIN_WORDS = 5
ROUNDS = 120
#: Distinct words that a task remembers, about.
REMEMBERED = 100_000

SYMBOL, BARE, SHOUT, BANG, PLAIN = 1, 2, 4, 8, 16
_SYMBOLS = re.compile(rb"[#*$%&|<>~^=_\\]{2,}")



def _shape(word: str) -> str:
    """Letters as w (C where capitals follow each other), digits as 9, the rest as it is, runs once."""
    out = "".join("C" if c.isupper() else "w" if c.isalpha() else "9" if c.isdigit() else c for c in word)
    return re.sub(r"(.)\1+", r"\1", out[:64].replace("Cw", "w"))


class Words(dict):
    """word (UTF-8) -> number << 40 | shape bucket << 22 | word bucket << 8 | flags; numbers count from 0."""

    def __missing__(self, word: bytes) -> int:
        text = word.decode("utf-8", "replace")
        core = text.strip(".,;:!?\"'()[]")
        loud = len(core) > 1 and core.isupper()
        if core.isalpha():  # most words
            flags = PLAIN | SHOUT * loud
            form = text.replace(core, "C" if loud else "w", 1)
        else:
            flags = (
                SYMBOL * bool(_SYMBOLS.search(word))
                | BARE * (not any(c.isalnum() for c in core))
                | SHOUT * loud
                | PLAIN * (bool(core) and core.replace("-", "").replace("'", "").isalpha())
            )
            form = _shape(text)
        if text[-2:] in ("!!", "??", "!?", "?!"):
            flags |= BANG
        shape = zlib.crc32(b"shape " + form.encode()) % BUCKETS
        value = len(self) << 40 | shape << 22 | zlib.crc32(core.lower().encode()) % BUCKETS << 8 | flags
        self[word] = value
        return value


_words = Words()
TASK_CACHES.append(_words)


@dataclass
class Look:
    """What a pass over a text gives."""

    n: int
    shares: dict[str, float]
    buckets: np.ndarray
    values: np.ndarray


def _sentences(raw: bytes) -> float:
    """Share of the text's bytes in sentences or lines (cut at . and line ends) that occurred before."""
    seen: set[bytes] = set()
    again = total = 0
    for part in re.split(rb"[.\n]+", raw):
        if part := part.strip():
            total += len(part)
            if part in seen:
                again += len(part)
            seen.add(part)
    return again / total if total else 0.0


def _bin(share: float) -> int:
    return int(min(share, 0.999) * 12)


def look(text: str | None) -> Look:
    """Shares that the labellers judge by, and hashed features: words and shapes by frequency, shares by bin."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return Look(0, {}, np.empty(0, np.int64), np.empty(0))
    if len(_words) > REMEMBERED:
        _words.clear()
    got = np.fromiter(map(_words.__getitem__, words), np.int64, n)
    flags = got & 0xFF
    _, ids = np.unique(got >> 40, return_inverse=True)
    distinct = int(ids.max()) + 1
    three = 0.0
    if n > 3:
        pair = np.unique(ids[:-1] * distinct + ids[1:], return_inverse=True)[1]
        times = np.unique(pair[:-1] * distinct + ids[2:], return_counts=True)[1]
        three = float(times[times > 1].sum() / times.sum())
    share = lambda flag: float(((flags & flag) > 0).mean())
    shares = {
        "symbols": share(SYMBOL),
        "bare": share(BARE),
        "shouts": share(SHOUT),
        "bangs": share(BANG),
        "plain": share(PLAIN),
        "doubled": float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0,
        "windows": three,
        "sentences": _sentences(raw),
        "distinct": distinct / n,
    }
    at = np.concatenate([got >> 22 & (BUCKETS - 1), got >> 8 & (BUCKETS - 1)])
    buckets, times = np.unique(at, return_counts=True)
    binned = np.array([zlib.crc32(f"{k} {_bin(v)}".encode()) % BUCKETS for k, v in shares.items() if k != "distinct"], np.int64)
    values = np.concatenate([times / n, np.full(len(binned), 0.5)])
    return Look(n, shares, np.concatenate([buckets, binned]), values)


@dataclass(frozen=True)
class Labeller:
    """Votes bad from ``bad`` on, good up to ``good``, nothing between (where good > bad the other way round).

    Says nothing about texts of fewer than ``least`` words, where one line or number makes the share.
    """

    of: str
    good: float
    bad: float
    least: int = MIN_WORDS

    def vote(self, n: int, shares: dict[str, float]) -> int:
        if n < self.least:
            return -1
        x = shares[self.of]
        if self.good > self.bad:
            return 1 if x >= self.good else 0 if x <= self.bad else -1
        return 1 if x <= self.good else 0 if x >= self.bad else -1


LABELLERS: tuple[Labeller, ...] = (
    Labeller("symbols", 0.02, 0.15),
    Labeller("bare", 0.03, 0.15),
    Labeller("shouts", 0.08, 0.3),
    Labeller("bangs", 0.03, 0.15),
    Labeller("plain", 0.85, 0.6, 20),
    Labeller("doubled", 0.05, 0.2),
    Labeller("windows", 0.25, 0.5, 40),
    Labeller("sentences", 0.2, 0.45, 40),
)


def votes(seen: Look, labellers: Sequence[Labeller] = LABELLERS) -> str:
    """The votes as a string of 1, 0 and -."""
    if seen.n < MIN_WORDS:
        return "-" * len(labellers)
    return "".join("0" if v == 0 else "1" if v == 1 else "-" for v in (x.vote(seen.n, seen.shares) for x in labellers))


@dataclass
class VoteModel:
    """share of good documents; (labellers, 2 classes bad and good, 2 votes bad and good) probabilities of a vote that
    is given. Whether one is given tells nothing: it hangs on the length."""

    good: float
    says: np.ndarray

    def posterior(self, pattern: str) -> float:
        bad, good = np.log(1 - self.good), np.log(self.good)
        for k, v in enumerate(pattern):
            if v == "-":
                continue
            j = int(v)
            bad += np.log(self.says[k, 0, j])
            good += np.log(self.says[k, 1, j])
        return float(1 / (1 + np.exp(np.clip(bad - good, -700, 700))))

    def accuracy(self) -> np.ndarray:
        """Of each labeller: how often a vote on a bad, and on a good document, is right."""
        return np.stack([self.says[:, 0, 0], self.says[:, 1, 1]], 1)


def fit_votes(counts: dict[str, int], n_labellers: int, rounds: int = 100, prior_good: float = 0.8) -> VoteModel:
    """Expectation-maximisation over vote patterns and the number of documents with each.

    A bad document has one defect or two, not all, so most labellers find nothing wrong with it: the start is that a
    labeller sees a quarter of the bad documents and blames few good ones. Laplace-smoothed; stops when no
    posterior moves.
    """
    says = np.tile(np.array([[0.3, 0.7], [0.02, 0.98]]), (n_labellers, 1, 1))
    model = VoteModel(prior_good, says)
    patterns = sorted(counts)
    if not patterns:
        return model
    n = np.array([counts[p] for p in patterns], float)
    seen = np.array([["01-".index(v) for v in p] for p in patterns]).reshape(len(patterns), n_labellers)
    before = None
    for _ in range(rounds):
        log = np.log(model.says)
        bad, good = np.full(len(n), np.log(1 - model.good)), np.full(len(n), np.log(model.good))
        for k in range(n_labellers):
            given = seen[:, k] < 2
            bad += np.where(given, log[k, 0, seen[:, k] % 2], 0)
            good += np.where(given, log[k, 1, seen[:, k] % 2], 0)
        p = 1 / (1 + np.exp(np.clip(bad - good, -700, 700)))
        if before is not None and np.abs(p - before).max() < 1e-9:
            break
        before = p
        says = np.ones((n_labellers, 2, 2))
        for k in range(n_labellers):
            for j in range(2):
                here = seen[:, k] == j
                says[k, 0, j] += (n * (1 - p))[here].sum()
                says[k, 1, j] += (n * p)[here].sum()
        model = VoteModel(float(np.clip((n * p).sum() / n.sum(), 1e-6, 1 - 1e-6)), says / says.sum(2, keepdims=True))
    return model


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, buckets: np.ndarray, values: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[buckets] @ values + self.bias, -30, 30))))


def fit_scorer(rows: Sequence[tuple[np.ndarray, np.ndarray, float]], rounds: int = ROUNDS, rate: float = 0.5, decay: float = 1e-5) -> Scorer:
    """Logistic regression on posterior labels, full-batch AdaGrad with weight decay; the same rows give the same scorer."""
    weights, bias = np.zeros(BUCKETS), 0.0
    if not rows:
        return Scorer(weights, bias)
    at = np.concatenate([r[0] for r in rows])
    values = np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    label = np.array([r[2] for r in rows])
    squares, square = np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(rounds):
        off = 1 / (1 + np.exp(-np.clip(np.bincount(row, values * weights[at], len(rows)) + bias, -30, 30))) - label
        slope = np.bincount(at, values * off[row], BUCKETS) / len(rows) + decay * weights
        squares += slope**2
        weights -= rate * slope / np.sqrt(squares)
        square += off.mean() ** 2
        bias -= rate * off.mean() / np.sqrt(square)
    return Scorer(weights, float(bias))


@dataclass
class Classifier:
    model: VoteModel
    scorer: Scorer


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Classifier:
    """Labellers over all documents, EM over their patterns, the scorer from a sample by hash of id and text."""

    def rows(part: dict[str, list]) -> dict[str, list]:
        seen = [look(t) for t in part["text"]]
        # features leave the worker for documents that may be in the sample only
        return {
            "votes": [votes(s) if s.n else "" for s in seen],
            "place": part["place"],
            "at": [s.buckets.tolist() if p < edge else None for s, p in zip(seen, part["place"], strict=True)],
            "value": [s.values.tolist() if p < edge else None for s, p in zip(seen, part["place"], strict=True)],
        }

    # about 1.3 samples' worth of documents, by hash; the first of them by hash are the sample
    n = docs.count()
    edge = 1 << 62 if n <= sample else int((1 << 62) * min(1.0, 1.3 * sample / n))
    place = F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 62))
    looked = written(
        map_batches(
            docs.select(place.alias("place"), F.col(text_col).alias("text")),
            rows,
            "votes string, place long, at array<long>, value array<double>",
        ),
        "votes",
    )
    counts = {r["votes"]: r["n"] for r in looked.where("votes <> ''").groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = fit_votes(counts, len(LABELLERS))
    chosen = looked.where("at is not null and votes <> '' and votes <> '" + "-" * len(LABELLERS) + "'").orderBy("place", "votes", "at").limit(sample).select("at", "value", "votes").collect()
    train = [(np.array(r["at"], np.int64), np.array(r["value"]), model.posterior(r["votes"])) for r in chosen]
    return Classifier(model, fit_scorer(train))


SCORES = "n_words long, votes string, posterior double, score double, kept boolean"


def classify(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, classifier: Classifier | None = None
) -> DataFrame:
    """Per row: id, n_words, votes, posterior (from the votes), score (from the scorer), kept (score >= threshold)."""
    judge = classifier or fit(docs, id_col=id_col, text_col=text_col)
    model, scorer = judge.model, judge.scorer
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(part: dict[str, list]) -> dict[str, list]:
        seen = [look(t) for t in part[text_col]]
        said = [votes(s) for s in seen]
        scores = [scorer.score(s.buckets, s.values) if s.n else 0.0 for s in seen]
        return {
            id_col: part[id_col],
            "n_words": [s.n for s in seen],
            "votes": said,
            "posterior": [model.posterior(v) for v in said],
            "score": scores,
            "kept": [s.n > 0 and x >= threshold for s, x in zip(seen, scores, strict=True)],
        }

    return map_batches(docs.select(id_col, text_col), rows, f"{id_col} {kind}, {SCORES}")


def keep_good(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier keeps."""
    import pyarrow as pa

    scorer = fit(docs, id_col=id_col, text_col=text_col).scorer
    where = docs.columns.index(text_col)
    kinds = docs.schema

    def run(batches):
        for batch in batches:
            step = max(1, int(batch.num_rows * (1 << 20) / max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                seen = [look(t) for t in part.column(where).to_pylist()]
                good = [s.n > 0 and scorer.score(s.buckets, s.values) >= threshold for s in seen]
                yield part.filter(pa.array(good, pa.bool_()))

    return arrow_map(docs, run, kinds)
