"""Benchmark decontamination with suffix arrays of the training text.

The training texts go through Python workers in shards of about SHARD_WORDS
words (a longer text is a shard of its own). Per shard a suffix array is built
over word numbers; every suffix of every test item is binary-searched in it.
The suffixes with its window as prefix are a range of the array, and their
places are the window's occurrences. Neighbouring windows that occur at
neighbouring places make up the longest verbatim matches. Documents with an
occurrence are contaminated.

Work is by ranges, never by pairs of a place and a test suffix: equal windows
have one range, ranges of one length don't overlap, and whether a match goes on
is decided per pair of neighbouring ranges. A text and an item that repeat one
word ten thousand times cost as much as others of their length.

Words that no item holds get number 0. They end every match, so the array holds
just the runs of known words that are at least as long as the shortest window;
no occurrence lies elsewhere.

The test items are the stated query set. They are cut to blocks of BLOCK_BYTES,
each broadcast on its own, and each shard meets one block after the other: what
is held at once stays bounded, however large the benchmark.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.llm.common import WORD_BYTES, alnum_words, arrow_map, pa_schema

WINDOW = 10
SHARD_WORDS = 1 << 20
BLOCK_BYTES = 32 << 20
PIECE_BYTES = 1 << 20


class TestSet:
    """The suffixes of a block of test items: word numbers, windows, vocabulary."""

    __test__ = False

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[str | None] = []
        ids: list[int] = []
        item: list[int] = []
        left: list[int] = []
        need: list[int] = []
        for name, text in items:
            words = alnum_words(text)
            if not words:
                continue
            n, w = len(words), min(window, len(words))
            ids += [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in words] + [0]
            item += [len(self.names)] * (n + 1)
            left += [*range(n, -1, -1)]  # words from here to the item's end
            need += [w] * (n - w + 1) + [0] * w  # a window's length where one starts, else 0
            self.names.append(name)
        self.ids = np.array([*ids, 0], np.int32)
        self.item = np.array(item, np.int64)
        self.left = np.array(left, np.int64)
        self.need = np.array(need, np.int64)
        self.suffixes = np.flatnonzero(self.need)
        self.shortest = int(self.need[self.suffixes].min()) if len(self.suffixes) else 0
        self.start = np.searchsorted(self.item, self.item)  # where the item of each place begins


def word_ids(text: str | None, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """Word numbers of a whole text (0: unknown), translated piece by piece."""
    if not text:
        return np.empty(0, np.int32), 0
    plain = text.encode().translate(WORD_BYTES)
    if len(plain) <= PIECE_BYTES:
        words = plain.split()
        return np.fromiter(map(vocabulary.get, words, repeat(0)), np.int32, len(words)), len(words)
    parts, at = [], 0
    while at < len(plain):
        end = plain.find(b" ", at + PIECE_BYTES)
        end = len(plain) if end < 0 else end
        words = plain[at:end].split()
        parts.append(np.fromiter(map(vocabulary.get, words, repeat(0)), np.int32, len(words)))
        at = end
    found = np.concatenate(parts)
    return found, len(found)


def suffix_array(ids: np.ndarray) -> np.ndarray:
    """Places of the non-zero words, ordered by the suffix up to the next 0 (equal ones in a fixed order).

    Prefix doubling: after a round with step h the ranks tell suffixes apart by
    their first 2h words.
    """
    zero = np.flatnonzero(ids == 0)
    ends = np.diff(np.concatenate([[-1], zero, [len(ids)]])).max() if len(ids) else 0
    rank = ids.astype(np.int64)
    h = 1
    while h < ends:
        ahead = np.zeros_like(rank)
        ahead[:-h] = rank[h:]
        _, new = np.unique(np.where(rank > 0, rank * (rank.max() + 1) + ahead, 0), return_inverse=True)
        new = new.ravel() + (1 if rank.min() > 0 else 0)
        if new.max() == rank.max() and h > 1:
            break
        rank, h = new, 2 * h
    order = np.argsort(rank, kind="stable")
    return order[np.count_nonzero(rank == 0) :]


def _common(ids: np.ndarray, at: np.ndarray, test: np.ndarray, q: np.ndarray, most: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Words that the suffixes at ``at`` share with the test suffixes at ``q``; ``known`` are shared for sure."""
    n = known.copy()
    live = np.flatnonzero(n < most)
    while len(live):
        a = ids[at[live] + n[live]]
        same = (a == test[q[live] + n[live]]) & (a != 0)
        live = live[same]
        n[live] += 1
        live = live[n[live] < most[live]]
    return n


def search(ids: np.ndarray, array: np.ndarray, test: np.ndarray, q: np.ndarray, length: np.ndarray, after: bool) -> tuple[np.ndarray, np.ndarray]:
    """Binary search of test suffixes, cut to ``length`` words: the first place in the array whose suffix is
    not less (``after``: greater than, with equal prefixes counting as equal), and the longest match met at
    the two neighbours of that place. ``ids`` ends in a 0."""
    lo, hi = np.zeros(len(q), np.int64), np.full(len(q), len(array), np.int64)
    # words shared with the neighbours below and above: all between share the lesser of both
    low, high = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
    live = np.flatnonzero(lo < hi)
    while len(live):
        mid = (lo[live] + hi[live]) // 2
        at = array[mid]
        n = _common(ids, at, test, q[live], length[live], np.minimum(low[live], high[live]))
        full = n == length[live]
        less = np.where(full, after, ids[at + n] < test[q[live] + np.minimum(n, length[live] - 1)])
        up, down = live[less], live[~less]
        lo[up], low[up] = mid[less] + 1, n[less]
        hi[down], high[down] = mid[~less], n[~less]
        live = live[lo[live] < hi[live]]
    return lo, np.maximum(low, high)


class Ranges:
    """The ranges of a shard's suffix array that begin with a window, one for each different window that occurs."""

    def __init__(self, ids: np.ndarray, tests: TestSet) -> None:
        self.array = suffix_array(ids)
        q = tests.suffixes
        none = np.empty(0, np.int64)
        self.first = self.last = self.need = self.q = self.of = none
        if not len(self.array) or not len(q):
            return
        first, _ = search(ids, self.array, tests.ids, q, tests.need[q], False)
        last, _ = search(ids, self.array, tests.ids, q, tests.need[q], True)
        found = last > first
        q, first, last = q[found], first[found], last[found]
        if not len(q):
            return
        distinct, of = np.unique(np.stack([tests.need[q], first, last]), axis=1, return_inverse=True)
        self.need, self.first, self.last = distinct
        order = np.argsort(of.ravel(), kind="stable")
        #: The test suffixes, by range and then by place, and the range of each.
        self.q, self.of = q[order], of.ravel()[order]

    def __len__(self) -> int:
        return len(self.need)

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """(place, range): at most one of each length for a place."""
        n = self.last - self.first
        spot = np.repeat(self.first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.array[spot], np.repeat(np.arange(len(n)), n)


class Shard:
    """Known runs of the words of some documents, and what the test sets hit in them."""

    def __init__(self, texts: list[str | None], tests: TestSet) -> None:
        kept: list[np.ndarray] = []
        self.n_words: list[int] = []
        docs: list[np.ndarray] = []
        places: list[np.ndarray] = []
        for d, text in enumerate(texts):
            ids, n = word_ids(text, tests.vocabulary)
            self.n_words.append(n)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], (ids > 0).astype(np.int8), [0]])))
            for a, b in zip(edge[::2], edge[1::2], strict=True):
                if b - a >= tests.shortest:
                    kept.append(np.append(ids[a:b], np.int32(0)))
                    docs.append(np.full(b - a + 1, d))
                    places.append(np.arange(a, b + 1))
        self.ids = np.concatenate([*kept, np.zeros(1, np.int32)])
        self.doc = np.concatenate([*docs, [len(texts)]]).astype(np.int64)
        self.place = np.concatenate([*places, [0]]).astype(np.int64)


#: The built test set that this worker holds, by its block's key; kept while the benchmark is a single block.
_built: dict[tuple[str, int], TestSet] = {}


def _tests(block: tuple, alone: bool, window: int) -> TestSet:
    key, sent = block
    if (key, window) not in _built:
        found = TestSet(sent.value, window)
        if not alone:
            vars(sent).pop("_value", None)  # the worker's copy; the next use reads the broadcast's file again
            return found
        _built.clear()
        _built[key, window] = found
    return _built[key, window]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> list:
    """Blocks of about block_bytes each: (key, broadcast list of (item id, text))."""
    items = benchmark.select(F.col(item_col).cast("string").alias("name"), F.col(text_col).alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    n = max(1, -(-int(total) // block_bytes))
    if n == 1:
        parts = [items]
    else:
        parts = [items.where(F.pmod(F.xxhash64("name", "text"), F.lit(n)) == k) for k in range(n)]
    context = benchmark.sparkSession.sparkContext
    return [(uuid.uuid4().hex, context.broadcast([tuple(r) for r in part.collect()])) for part in parts]


def _sha256(names: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def _shards(batches: Iterator[pa.RecordBatch], shard_words: int) -> Iterator[tuple[list, list]]:
    ids, texts, size = [], [], 0
    for batch in batches:
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(name)
            texts.append(text)
            size += len(text or "") + 64
            if size >= 6 * shard_words:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    shard_words: int = SHARD_WORDS,
    block_bytes: int = BLOCK_BYTES,
    keep: list[str] | None = None,
) -> DataFrame:
    """Per row of ``docs``: id, n_words, n_hit (words inside an occurrence of a window), n_items (items with
    an occurring window), items_sha256 (of their ids, sorted as strings, comma-joined), contaminated (n_hit > 0).

    A window is ``window`` consecutive words of an item; an item of fewer words is one window. Defined cases: a
    null or empty text has no words and is not contaminated; an item with a null id hits words but is not listed;
    repeated rows give a row each; empty tables give no rows or no hits; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    kinds = pa_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _shards(batches, shard_words):
            total = np.zeros(len(ids), np.int64)
            hits: list[list[np.ndarray]] = [[] for _ in ids]
            names: list[set[str]] = [set() for _ in ids]
            n_words = [0] * len(ids)
            for block in blocks:
                tests = _tests(block, len(blocks) == 1, window)
                shard = Shard(texts, tests)
                n_words = shard.n_words
                found = Ranges(shard.ids, tests)
                at, of = found.places()
                cover = np.zeros(len(shard.ids) + 1, np.int64)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + found.need[of], -1)
                items = [set() for _ in range(len(found))]
                for r, i in np.unique(np.stack([found.of, tests.item[found.q]]), axis=1).T.tolist():
                    if tests.names[i] is not None:
                        items[r].add(tests.names[i])
                for d, r in np.unique(np.stack([shard.doc[at], of]), axis=1).T.tolist():
                    names[d] |= items[r]
                covered = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
                if len(blocks) == 1:
                    total += np.bincount(shard.doc[covered], minlength=len(ids))[: len(ids)]
                else:
                    for d in np.unique(shard.doc[covered]).tolist():
                        hits[d].append(shard.place[covered][shard.doc[covered] == d])
            if len(blocks) > 1:
                total = np.array([len(np.unique(np.concatenate(h))) if h else 0 for h in hits], np.int64)
            out = [ids, n_words, total, [len(x) for x in names], [_sha256(x) for x in names], total > 0]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, kinds, strict=True)], schema=kinds)

    return arrow_map(docs.select(id_col, text_col), run, schema)


def longest(found: Ranges, n_places: int, window: int, part: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, test suffix, words) of the longest matches, in parts of about ``part`` rows.

    An item shorter than a window is a match as it is. Of windows, a match begins at a place and a suffix where the
    suffix before has no occurrence at the place before, and ends likewise; begins and ends on one diagonal
    alternate, so the k-th of both belong together.
    """
    at, of = found.places()
    starts = np.searchsorted(found.of, np.arange(len(found) + 1))
    suffixes = lambda r: found.q[starts[r] : starts[r + 1]]
    short = found.need[of] < window
    for r in np.unique(of[short]).tolist():
        places, q = at[short & (of == r)], suffixes(r)
        for k in range(0, len(places), max(1, part // len(q))):
            some = places[k : k + max(1, part // len(q))]
            yield np.repeat(some, len(q)), np.tile(q, len(some)), np.full(len(some) * len(q), found.need[r])
    # the range at each place, -1 for none
    kind = np.full(n_places + 2, -1, np.int64)
    kind[at[~short] + 1] = of[~short]
    place = np.sort(at[~short])

    def edges(step: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, suffix) without the neighbour at ``step``."""
        here, near = kind[place + 1], kind[place + 1 + step]
        pairs, which = np.unique(np.stack([here, near]), axis=1, return_inverse=True)
        some = [suffixes(h) if m < 0 else suffixes(h)[~np.isin(suffixes(h) + step, suffixes(m))] for h, m in pairs.T.tolist()]
        size = np.array([len(x) for x in some], np.int64)
        every = np.concatenate([*some, np.empty(0, np.int64)])
        which, begin = which.ravel(), np.cumsum(size) - size
        n = size[which]
        return np.repeat(place, n), every[np.repeat(begin[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    if not len(place):
        return
    (a, b), (c, d) = edges(-1), edges(1)
    first, last = np.lexsort((a, a - b)), np.lexsort((c, c - d))
    a, b, n = a[first], b[first], c[last] - a[first] + window
    for k in range(0, len(a), part):
        yield a[k : k + part], b[k : k + part], n[k : k + part]


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    shard_words: int = SHARD_WORDS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The longest verbatim matches and their places: id, item_id (string), doc_start, item_start, n_words.

    A match is a run of shared words that neither side can extend and that holds a window. Cases as in
    ``contamination``; items with a null id are not listed.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, item_id string, doc_start long, item_start long, n_words long"
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    kinds = pa_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _shards(batches, shard_words):
            for block in blocks:
                tests = _tests(block, len(blocks) == 1, window)
                shard = Shard(texts, tests)
                for a, b, n in longest(Ranges(shard.ids, tests), len(shard.ids), window):
                    named = [k for k, i in enumerate(tests.item[b].tolist()) if tests.names[i] is not None]
                    a, b, n = a[named], b[named], n[named]
                    out = [
                        [ids[d] for d in shard.doc[a].tolist()],
                        [tests.names[i] for i in tests.item[b].tolist()],
                        shard.place[a],
                        b - tests.start[b],
                        n,
                    ]
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, kinds, strict=True)], schema=kinds)

    return arrow_map(docs.select(id_col, text_col), run, schema)


def decontaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    shard_words: int = SHARD_WORDS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs``, all columns, that no window of the benchmark occurs in."""
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    where = docs.columns.index(text_col)

    def clean(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [t for batch in held for t in batch.column(where).to_pylist()]
        hit = np.zeros(len(texts) + 1, bool)
        for block in blocks:
            tests = _tests(block, len(blocks) == 1, window)
            shard = Shard(texts, tests)
            hit[shard.doc[Ranges(shard.ids, tests).places()[0]]] = True
        at = 0
        for batch in held:
            yield batch.filter(pa.array(~hit[at : at + batch.num_rows]))
            at += batch.num_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for whole_batch in batches:
            step = max(1, int(whole_batch.num_rows * shard_words * 6 / max(whole_batch.nbytes, 1)))
            for at in range(0, whole_batch.num_rows, step):
                held.append(whole_batch.slice(at, step))
                size += held[-1].nbytes
                if size >= 6 * shard_words:
                    yield from clean(held)
                    held, size = [], 0
        if held:
            yield from clean(held)

    return arrow_map(docs, run, docs.schema)
