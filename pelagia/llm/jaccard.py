"""Near copies by the exact Jaccard similarity of shingle sets.

Two texts link if their sets of 5-word shingles have a similarity of 0.8 or
more. The search is complete: no pair at or above the threshold is missed.

What fingerprints can reach comes first: sets get a SimHash fingerprint, the
anchors of ``simhash.links`` find those within 3 bits, an exact comparison of the
sets follows, and what links is a class from then on. Fingerprints of sets at 0.8
differ in some 10 bits, though, so the rest is found by shared shingles:

* Shingles are put in one order, those common in a sample of the texts last. Of
  two similar sets each has a shared shingle among its first (1 - t) n + 1, so
  only those prefixes are dealt by shingle. The place of the first shared
  shingle bounds what two sets can share after it, their sizes how similar they
  can be; the sample decides how many candidates there are, never a result.
* Candidates go through parities: a bit for each of many bins, set where a set has an
  odd number of shingles. As many bits as differ between two sets, so many shingles
  at least has just one of them. With two to four bits a shingle that tells sets at
  0.77 from those at 0.8, at any size, and little is shuffled; the join itself looks
  at ``FEW`` bits of each set.
* A pair leaves the join where its sets first meet. Each row carries the shared
  shingle before its own in its set's order: where that is the same for both, they
  have met there, under the same conditions or easier ones.
* What is left is compared set by set; only those sets are shuffled.

Pairs of a prefix shingle are first those with its hub, the one of its sets that
meets the most others over all its shingles: of copies of one text that is the
text, or what is nearest to it, to which they are more alike than to each other.
Links of hubs and of fingerprints make classes, and then all pairs of different
classes follow, so a large class of near copies isn't paired up. Equal sets are one from the start. Sets
are of 64-bit hashes, cut to 48 bits where they are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pelagia.llm import simhash
from pelagia.llm.common import arrow_map, discard, map_batches, written
from pelagia.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
#: Bits of parities: so many in a join, at least so many for each shingle where candidates are checked, and the most.
FEW, PER_SHINGLE, MOST_BITS = 512, 2, 1 << 19
WIDTH = 6
#: One text of so many shows which shingles are common: in more than COMMON of those texts.
SAMPLE = 8
COMMON = 16
MOST_COMMON = 200_000
BROADCAST_BYTES = 16 << 20


def shingles(text: str | None, shingle: int = SHINGLE, seed: int = simhash.SEED) -> np.ndarray:
    """Distinct hashes of the word shingles of a text, sorted; words and short texts as in simhash.fingerprint."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.int64)
    digest = xxhash.xxh64_digest
    n = max(1, len(words) - shingle + 1)
    return np.unique(np.frombuffer(b"".join([digest(b" ".join(words[i : i + shingle]), seed) for i in range(n)]), np.int64))


def node(hashes: np.ndarray) -> int:
    """One long for a set of shingles."""
    return simhash.signed(xxhash.xxh64_intdigest(hashes.tobytes(), simhash.SEED))


def sketch(hashes: np.ndarray) -> int:
    """SimHash fingerprint of a set of shingles, as a signed long; zero for the empty set."""
    if not len(hashes):
        return 0
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return simhash.signed(int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big"))


def _near_prints(sets: DataFrame) -> DataFrame:
    """Candidates (a, b): sets with one fingerprint, and the least sets of two that the anchors link."""
    least = written(sets.groupBy("print").agg(F.min("node").alias("least")), "prints")
    same = sets.select("node", "print").join(least.hint("merge"), "print").select(F.col("least").alias("a"), F.col("node").alias("b"))
    of = lambda end: least.select(F.col("print").alias(end), F.col("least").alias(f"{end}_node")).hint("merge")
    linked = written(simhash.links(least.withColumnRenamed("print", "fp")), "near")
    near = linked.join(of("a"), "a").join(of("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    return same.unionByName(near).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def packed(hashes: np.ndarray) -> bytes:
    """The lower WIDTH bytes of each hash: what is shuffled of a set. Of two sets of 20,000 shingles each one in a
    million pairs has two different shingles that are alike in 48 bits."""
    return hashes.view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()


def unpacked(raw) -> np.ndarray:
    wide = np.zeros((len(raw) // WIDTH, 8), np.uint8)
    wide[:, :WIDTH] = np.frombuffer(raw, np.uint8).reshape(-1, WIDTH)
    return wide.view(np.int64).ravel()


def parities(hashes: np.ndarray, m: int) -> bytes:
    """A bit for each of ``m`` bins (a power of two, by the low bits of a hash): whether it holds an odd number of them."""
    return np.packbits(np.bincount(hashes & (m - 1), minlength=m) & 1, bitorder="little").tobytes()


def histogram(hashes: np.ndarray) -> bytes:
    """Parities of a set's hashes, with bins in step with its size."""
    m = FEW
    while m < PER_SHINGLE * len(hashes) and m < MOST_BITS:
        m *= 2
    return parities(hashes, m)


def apart(x: bytes, y: bytes) -> int:
    """No more than the number of shingles that just one of two sets has, by their parities: a bin whose parities differ
    has such a shingle."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) != len(b):  # the low bits of fewer bins are the same: fold the longer one
        if len(a) < len(b):
            a, b = b, a
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _prefix(n: int, t: Fraction) -> int:
    return n + 1 - -(-t.numerator * n // t.denominator)


def _rows(docs: DataFrame, text_col: str, shingle: int, t: Fraction, common: np.ndarray | None) -> DataFrame:
    """(key, node, n, place, print, bins, few): the prefix of each text's set, with fingerprint, parities and FEW of them
    at its first place.
    Without ``common``, keys in the order of their hashes."""
    common = np.empty(0, np.int64) if common is None else common

    def rows(part: dict[str, list]) -> dict[str, list]:
        keys, nodes, sizes, places, prints, bins, few = [np.empty(0, np.int64)], [], [], [], [], [], []
        for text in part[text_col]:
            s = shingles(text, shingle)
            if not len(s):
                continue
            first = s[np.argsort(np.isin(s, common, assume_unique=True), kind="stable")] if len(common) else s
            k = _prefix(len(s), t)
            keys.append(first[:k])
            nodes += [node(s)] * k
            sizes += [len(s)] * k
            places += range(k)
            prints += [sketch(s)] + [None] * (k - 1)
            bins += [histogram(s)] + [None] * (k - 1)
            few += [np.frombuffer(parities(s, FEW), np.int64)] + [None] * (k - 1)
        return {"key": np.concatenate(keys), "node": nodes, "n": sizes, "place": places, "print": prints, "bins": bins, "few": few}

    return map_batches(docs.select(text_col), rows, "key long, node long, n int, place int, print long, bins binary, few array<long>")


def _similar(t: Fraction):
    """(a, b, as, bs) -> (a, b) of the pairs whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = unpacked(x.as_buffer()), unpacked(y.as_buffer())
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(t.denominator * both >= t.numerator * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(pairs: DataFrame, sizes: DataFrame, docs: DataFrame, text_col: str, shingle: int, t: Fraction) -> DataFrame:
    """Of candidates (a, b), those that are similar."""
    of = lambda rows, end, *names: rows.select(F.col("node").alias(end), *[F.col(n).alias(f"{end}_{n}") for n in names]).hint("merge")
    # similar sets differ in (1 - t) / (1 + t) of their sizes' sum at most
    less, more = t.denominator - t.numerator, t.denominator + t.numerator

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = (np.asarray(batch.column(2)).astype(np.int64) + np.asarray(batch.column(3))) * less
            keep = [apart(x.as_buffer(), y.as_buffer()) * more <= most for x, y, most in zip(batch.column(4), batch.column(5), both.tolist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    met = pairs.join(of(sizes, "a", "n", "bins"), "a").join(of(sizes, "b", "n", "bins"), "b")
    met = met.where(F.least("a_n", "b_n") * t.denominator >= F.greatest("a_n", "b_n") * t.numerator).select("a", "b", "a_n", "b_n", "a_bins", "b_bins")
    likely = written(arrow_map(met, near, simhash.LINKS), "likely")
    discard(pairs)
    wanted = written(likely.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "wanted")
    sets = _sets(docs, text_col, shingle, wanted)
    met = likely.join(of(sets, "a", "set"), "a").join(of(sets, "b", "set"), "b").select("a", "b", "a_set", "b_set")
    found = written(arrow_map(met, _similar(t), simhash.LINKS), "similar")
    discard(sets, likely, wanted)
    return found


def _sets(docs: DataFrame, text_col: str, shingle: int, wanted: DataFrame) -> DataFrame:
    """(node, set) of the wanted nodes."""

    def rows(part: dict[str, list]) -> dict[str, list]:
        found = [shingles(x, shingle) for x in part[text_col]]
        return {"node": [node(s) for s in found], "set": [packed(s) for s in found]}

    every = map_batches(docs.select(text_col), rows, "node long, set binary")
    small = wanted.count() * 16 <= BROADCAST_BYTES
    met = every.join(F.broadcast(wanted) if small else wanted.hint("merge"), "node", "left_semi")
    # rows of a node are equal: any will do
    return written(met.groupBy("node").agg(F.first("set").alias("set")), "sets")


def _met(docs: DataFrame, text_col: str, shingle: int, t: Fraction) -> tuple[DataFrame, DataFrame]:
    """(key, node, n, place, times) of the prefix shingles that several sets share, and how often they are; and (node,
    print, n, bins, few) of those sets."""
    some = docs.where(F.pmod(F.xxhash64(text_col), F.lit(SAMPLE)) == 0)
    often = _rows(some, text_col, shingle, t, None).groupBy("key").count().where(F.col("count") > COMMON)
    common = np.array([r.key for r in often.orderBy(F.desc("count"), "key").limit(MOST_COMMON).collect()], np.int64)
    prefixes = written(_rows(docs, text_col, shingle, t, common), "prefixes")
    shared = prefixes.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y"), F.count(F.lit(1)).alias("times")).where("x <> y").select("key", "times")
    shared = written(shared, "shared")
    discard()
    met = prefixes.select("key", "node", "n", "place").join(shared.hint("merge"), "key")
    met = written(met.groupBy("key", "node", "n", "place").agg(F.first("times").alias("times")), "met")
    wanted = written(met.select("node").distinct(), "wanted")
    first = prefixes.where("place = 0").join(wanted.hint("merge"), "node", "left_semi")
    sizes = written(first.groupBy("node").agg(*[F.first(c).alias(c) for c in ("print", "n", "bins", "few")]), "sizes")
    discard(prefixes, shared, wanted)
    return met, sizes


def _pairs(met: DataFrame, found: DataFrame, sizes: DataFrame, t: Fraction) -> DataFrame:
    """Candidates (a, b) that share a prefix shingle and aren't in one class of the links that are ``found``."""
    classes = components(found).select("node", "label")
    of_class = met.join(classes.hint("merge"), "node", "left").select(
        "key", "node", "n", "place", F.coalesce("label", "node").alias("label"), F.lag("key").over(Window.partitionBy("node").orderBy("place")).alias("prev")
    )
    of_class = written(of_class, "of_class")
    split = of_class.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    left = of_class.join(written(split, "split").hint("merge"), "key").join(sizes.select("node", "few").hint("merge"), "node")
    left = written(left, "left")
    discard(met, of_class)
    more = written(_meetings(left, t).distinct(), "pairs")
    discard(left)
    return more


def _meetings(left: DataFrame, t: Fraction) -> DataFrame:
    """(a, b) of rows (key, node, n, place, label, prev, few) with one key and different labels, a pair at the first place
    of each run of keys that both have. What the place, the sizes and the few parities rule out doesn't leave the join.

    Two sets with one ``prev`` have met at that key. Their places are earlier there and nothing else differs, so they
    passed if they pass here; the first key of all is never left out.
    """
    x, y = left.alias("x"), left.alias("y")
    few = reduce(add, [F.bit_count(F.col("x.few")[i].bitwiseXOR(F.col("y.few")[i])) for i in range(FEW // 64)])
    share = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    pairs = x.join(y.hint("merge"), F.col("x.key") == F.col("y.key")).where(
        (F.col("x.node") < F.col("y.node"))
        & (F.col("x.label") != F.col("y.label"))
        & (F.least("x.n", "y.n") * t.denominator >= F.greatest("x.n", "y.n") * t.numerator)
        & (share * (t.denominator + t.numerator) >= (F.col("x.n") + F.col("y.n")) * t.numerator)
        & F.coalesce(F.col("x.prev") != F.col("y.prev"), F.lit(True))
        & (few * (t.denominator + t.numerator) <= (F.col("x.n") + F.col("y.n")) * (t.denominator - t.numerator))
    )
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def links(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): links between nodes of similar sets, enough to span each class."""
    t = Fraction(str(similarity))
    if not 0 < t <= 1:
        raise ValueError("a similarity is over 0 and 1 at most")
    met, sizes = _met(docs, text_col, shingle, t)
    # sets with near fingerprints, and the hub of each shingle against the others
    meets = written(met.groupBy("node").agg(F.sum("times").alias("meets")), "meets")
    hubs = met.join(meets.hint("merge"), "node").groupBy("key").agg(F.max(F.struct("meets", "node")).alias("hub")).select("key", F.col("hub.node").alias("end"))
    stars = met.select("key", "node").join(written(hubs, "hubs").hint("merge"), "key").where("node <> end")
    stars = stars.select(F.least("node", "end").alias("a"), F.greatest("node", "end").alias("b"))
    found = _verified(written(stars.unionByName(_near_prints(sizes)).distinct(), "stars"), sizes, docs, text_col, shingle, t)
    return found.unionByName(_verified(_pairs(met, found, sizes, t), sizes, docs, text_col, shingle, t))


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Per row: id, fingerprint (of the set, 16 hex digits), component_id (smallest id reachable). Cases as in
    simhash.near_duplicates; texts without words have the empty set and are one class."""
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(part: dict[str, list]) -> dict[str, list]:
        return {id_col: part[id_col], "fp": [node(shingles(x, shingle)) for x in part[text_col]]}

    prints = map_batches(docs.select(id_col, text_col), rows, f"{id_col} {kind}, fp long")
    return simhash.classed(prints, lambda distinct: links(docs, text_col, shingle, similarity), id_col)
