"""SimHash near-duplicates by anchor points of a covering code.

A fingerprint has 64 bits; two link at ``THRESHOLD`` (3) or fewer differing
bits. Then their left or their right halves differ in one bit at most, so each
half is a covering problem of its own with threshold 1. The anchors of a half
of 32 bits are the words of a covering code: the perfect binary Golay code
(covering radius 3) on 23 bits, times all words on the other 9 (radius 0).

* At home a fingerprint is at its nearest anchor, within the covering radius.
* It is replicated to every anchor at which a fingerprint one bit away can be at
  home, all within radius plus threshold: those of its own half and of the 32
  halves that differ from it in one bit (some 14 distinct ones).

So of two linked fingerprints each meets the other where that one is at home.
Per anchor, fingerprints at home are compared to all those replicated there. An
anchor with many at home is cut to blocks of them; every block meets all the
replicas, in numpy, a slice at a time. What leaves a block are links of a
star, one per member, never its pairs. Equal fingerprints are one from the start.

Classes come from connected components over those links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pelagia.llm.common import arrow_map, map_batches, written
from pelagia.llm.components import components

THRESHOLD = 3
SEED = 42
#: Fingerprints at home in one block of an anchor, about; more make more blocks.
BLOCK = 2048
# Fixed value: generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GOLAY = 0b110001110101


def fingerprint(text: str | None, shingle: int = 3, seed: int = SEED) -> int:
    """SimHash of the word shingles of a whole text, repeats included.

    Words ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased; fewer words than a
    shingle make one shingle of all; no words (or null) make 0. A bit is 1 if it
    is set in over half of the shingles' XXH64.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    n = max(1, len(words) - shingle + 1)
    total = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # a slice of the shingles: memory doesn't follow the text's length times 64
        raw = b"".join([digest(b" ".join(words[i : i + shingle]), seed) for i in range(at, min(n, at + (1 << 16)))])
        total += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the fingerprint as a signed long, a row for each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(part: dict[str, list]) -> dict[str, list]:
        return {id_col: part[id_col], "fp": [signed(fingerprint(t, shingle)) for t in part[text_col]]}

    return map_batches(docs.select(id_col, text_col), rows, f"{id_col} {kind}, fp long")


class Golay:
    """The nearest word of the code, for each 23-bit word: its 12 information bits."""

    _one: Golay | None = None

    def __init__(self) -> None:
        # error pattern of each of the 2048 syndromes: all patterns of up to 3 bits, each with its own (perfect code)
        self.error = np.zeros(1 << 11, np.uint32)
        bits = [1 << i for i in range(23)]
        for i in range(23):
            for j in range(i, 23):
                for k in range(j, 23):
                    e = bits[i] | bits[j] | bits[k]
                    self.error[self.syndrome(np.array([e], np.uint32))[0]] = e

    @classmethod
    def get(cls) -> Golay:
        cls._one = cls._one or cls()
        return cls._one

    @staticmethod
    def syndrome(words: np.ndarray) -> np.ndarray:
        left = words.astype(np.uint32)
        for bit in range(22, 10, -1):
            left = left ^ ((left >> np.uint32(bit) & np.uint32(1)) * np.uint32(GOLAY << (bit - 11)))
        return left

    def nearest(self, words: np.ndarray) -> np.ndarray:
        return (words.astype(np.uint32) ^ self.error[self.syndrome(words)]) >> np.uint32(11)


def anchors(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of 32-bit halves: the anchor at home, and (n, 33) the anchors of it and of each half one bit away."""
    near = halves[:, None] ^ np.concatenate([[0], 1 << np.arange(32)]).astype(np.uint32)[None, :]
    code = Golay.get().nearest((near & np.uint32((1 << 23) - 1)).ravel()).reshape(near.shape)
    every = (near >> np.uint32(23)).astype(np.int64) << 12 | code.astype(np.int64)
    return every[:, 0], every


def _replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """fp -> anchor (its lowest bit tells the half), home, fp."""
    for whole_batch in batches:
        for at in range(0, whole_batch.num_rows, 20_000):
            fp = np.asarray(whole_batch.slice(at, 20_000).column(0)).astype(np.int64)
            for half in (0, 1):
                bits = (fp.view(np.uint64) >> np.uint64(32 * half) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                home, every = anchors(bits)
                every = np.sort(every, axis=1)
                keep = np.ones(every.shape, bool)
                keep[:, 1:] = every[:, 1:] != every[:, :-1]
                row, _ = np.nonzero(keep)
                anchor = every[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor * 2 + half), pa.array(anchor == home[row]), pa.array(fp[row])], ["anchor", "home", "fp"]
                )


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) reduced to one from each node to the least of its class."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (a, b):
            np.minimum.at(new, end, low)
            np.minimum.at(new, label[end], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def _linked(key: np.ndarray, home: np.ndarray, fp: np.ndarray, threshold: int, pairs: int = 1 << 21):
    """Compare, within each run of equal keys, the rows at home to the others; yield links, slice by slice."""
    if not len(key):
        return
    order = np.lexsort((home, key))  # per key: replicas, then those at home
    key, home, fp = key[order], home[order], fp[order]
    start = np.searchsorted(key, key[home])
    others = np.searchsorted(key, key[home], side="right") - start
    here = np.flatnonzero(home)
    group_homes = np.bincount(np.unique(key[home], return_inverse=True)[1]) if len(here) else here
    others = others - np.repeat(group_homes, group_homes)
    done = np.cumsum(others)
    at = 0
    while at < len(here):
        upto = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + pairs, side="right")))
        n = others[at:upto]
        left = np.repeat(here[at:upto], n)
        right = np.repeat(start[at:upto] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        apart = np.bitwise_count(fp[left].view(np.uint64) ^ fp[right].view(np.uint64))
        close = (apart <= threshold) & (apart > 0)
        if close.any():
            yield _stars(fp[left[close]], fp[right[close]])
        at = upto


LINKS = "a long, b long"


def _compare(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.empty((0,), np.int64), np.empty((0,), np.int64), np.empty((0,), bool), np.empty((0,), np.int64)]

        def out(rows):
            block = np.unique(np.stack([rows[0], rows[1]]), axis=1, return_inverse=True)[1].ravel() if len(rows[0]) else rows[0]
            for a, b in _linked(block, rows[2], rows[3], threshold):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:  # sorted by anchor and block: the last one of a batch may go on in the next
            held = [np.concatenate([x, np.asarray(batch.column(i))]) for i, x in enumerate(held)]
            if len(held[0]):
                last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
                cut = int(last[-1]) + 1 if len(last) else 0
                yield from out([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        yield from out(held)

    return run


def links(distinct: DataFrame, threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp), enough to span each class."""
    if not 0 <= threshold <= 3:
        raise ValueError("the two halves cover thresholds of 0 to 3")
    spread = written(arrow_map(distinct.select("fp"), _replicas, "anchor long, home boolean, fp long"), "replicas")
    # anchors with more than a block of rows; AQE broadcasts this table only if it turns out small
    sizes = (
        spread.groupBy("anchor")
        .agg(F.sum(F.col("home").cast("long")).alias("homes"), F.count(F.lit(1)).alias("all"))
        .where((F.col("homes") > block) | (F.col("all") > block))
        .select(
            "anchor",
            F.ceil(F.col("homes") / block).cast("long").alias("hs"),
            F.ceil(F.col("all") / block).cast("long").alias("rs"),
        )
    )
    one = F.lit(1).cast("long")
    met = spread.join(sizes, "anchor", "left").withColumns(
        {"hs": F.greatest("hs", one), "rs": F.greatest("rs", one)}
    ).withColumns(
        {"h": F.pmod(F.xxhash64("fp"), F.col("hs")), "r": F.pmod(F.xxhash64("fp"), F.col("rs"))}
    )
    as_replica = F.transform(F.sequence(F.lit(0), F.col("hs") - 1), lambda h: F.struct((h * F.col("rs") + F.col("r")).alias("at"), F.lit(False).alias("home")))
    at_home = F.transform(F.sequence(F.lit(0), F.col("rs") - 1), lambda r: F.struct((F.col("h") * F.col("rs") + r).alias("at"), F.lit(True).alias("home")))
    dealt = (
        met.select("anchor", "fp", F.explode(F.when(F.col("home"), F.concat(as_replica, at_home)).otherwise(as_replica)).alias("x"))
        .select("anchor", "x.at", "x.home", "fp")
        .repartition("anchor", "at")
        .sortWithinPartitions("anchor", "at")
    )
    return arrow_map(dealt, _compare(threshold), LINKS)


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, threshold: int = THRESHOLD, block: int = BLOCK
) -> DataFrame:
    """Per row: id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Defined cases: null and texts without words have fingerprint zero and link
    like any other; rows with a null id get a fingerprint, and their class's
    smallest id (null if the class has none); repeated rows give a row each; an
    empty table gives an empty table; other columns are ignored. Ids are integers.
    """
    return classed(fingerprints(docs, id_col, text_col, shingle), lambda distinct: links(distinct, threshold, block), id_col)


def classed(prints: DataFrame, link: Callable[[DataFrame], DataFrame], id_col: str) -> DataFrame:
    """Per row of (id, fp): id, fingerprint, component_id, by the links (a, b) that ``link`` gives between fingerprints."""
    prints = written(prints.select(F.col(id_col).cast("long").alias("id"), "fp"), "prints")
    distinct = written(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    classes = components(link(distinct))
    # only fingerprints with a link to another need their class
    of_class = written(distinct.join(classes.withColumnRenamed("node", "fp").hint("merge"), "fp").select("fp", "label", "least"), "of_class")
    # both sides are written, so a class with most of the fingerprints is on the side that AQE can split
    least = written(of_class.groupBy("label").agg(F.min("least").alias("class_least")), "least")
    linked = of_class.join(least.hint("merge"), "label").select("fp", "class_least")
    labelled = distinct.join(linked.hint("merge"), "fp", "left").select("fp", F.coalesce("class_least", "least").alias("component_id"))
    labelled = written(labelled, "labelled")
    return prints.join(labelled.hint("merge"), "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, threshold: int = THRESHOLD, similarity: float | None = None
) -> DataFrame:
    """The rows of ``docs``, all columns, less near-duplicates: of each class the row with the smallest id stays.

    Fingerprints link at ``threshold`` bits. With ``similarity`` it is sets of shingles that link, at that Jaccard
    similarity: links by fingerprints are checked exactly, and those out of their reach are found by shared shingles.

    Of rows that share that id and fingerprint the least (by its columns) stays. Only ids of dropped rows are
    joined to the documents; rows whose id repeats, usually none, are settled apart by id and fingerprint.
    """
    if similarity is None:
        classes = near_duplicates(docs, id_col=id_col, text_col=text_col, shingle=shingle, threshold=threshold)
        return least_of_each(docs, classes, lambda text: fingerprint(text, shingle), id_col, text_col)
    from pelagia.llm import jaccard  # it builds on this module

    classes = jaccard.near_copies(docs, id_col=id_col, text_col=text_col, shingle=shingle, similarity=similarity)
    return least_of_each(docs, classes, lambda text: jaccard.node(jaccard.shingles(text, shingle)), id_col, text_col)


def least_of_each(docs: DataFrame, classes: DataFrame, mark: Callable[[str | None], int], id_col: str, text_col: str) -> DataFrame:
    """one_of_each for ``classes`` as near_duplicates gives them; ``mark`` is a text's fingerprint."""
    classes = written(classes, "classes")
    # null ids count as one repeated id
    repeated = classes.groupBy(F.col(id_col).alias("again")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 or again is null").select("again")
    repeated = written(repeated, "repeated")
    by_class = classes.withColumn("class", F.col("component_id"))
    best = by_class.groupBy("class").agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "fingerprint")).alias("w"))
    best = written(best.select("class", "w.id", "w.fingerprint"), "best")
    best_ids = best.where("id is not null").select(F.col("id").alias("best_id"))
    lost = classes.select(id_col).distinct().join(best_ids, F.col(id_col) == F.col("best_id"), "left_anti").select(F.col(id_col).alias("lost"))
    out = written(lost.unionByName(repeated.select(F.col("again").alias("lost"))).distinct(), "lost")
    single = docs.where(F.col(id_col).isNotNull()).join(out.hint("merge"), F.col(id_col).cast("long") == F.col("lost"), "left_anti")
    if not repeated.limit(1).count():
        return single

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(where).to_pylist()
            yield batch.append_column("_print", pa.array([f"{mark(t) & (1 << 64) - 1:016x}" for t in texts], pa.string()))

    again = docs.join(repeated.hint("merge"), F.col(id_col).cast("long").eqNullSafe(F.col("again")), "left_semi")
    where = again.columns.index(text_col)
    again = arrow_map(again, marked, StructType([*again.schema.fields, StructField("_print", StringType())]))
    won = best.select(F.col("id").alias("_id"), F.col("fingerprint").alias("_won"))
    again = again.join(won.hint("merge"), F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & (F.col("_print") == F.col("_won")), "left_semi")
    kept = again.groupBy(F.col(id_col).alias("_id"), "_print").agg(F.min(F.struct(*docs.columns)).alias("_row"))
    return single.unionByName(kept.select(*[F.col("_row")[c].alias(c) for c in docs.columns]))
