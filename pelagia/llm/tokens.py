"""Token counts of whole texts; huge texts by overlap resynchronisation.

A text of up to ``chunk_chars`` characters is encoded at once. A longer one is
encoded in chunks that overlap. Two neighbouring chunks are spliced at a place
in their overlap where

* both encodings have a token boundary, by their offsets, and
* the boundary is proven to be one of the whole text: the character before is
  no white space and the next one is. The vocabulary's pre-tokeniser never
  matches white space after another character, has no look-behind, and looks
  ahead over white space only, so it always cuts there, and what follows does
  not depend on what came before.

Where an overlap holds no such place it is doubled, to the end of the text if
need be; then the rest is encoded at once. Special strings hold no white space,
so no such place lies inside one.

Defined cases: null counts as the empty text (0 bytes, 0 tokens); repeated rows
and repeated or null ids give a row each; an empty table gives an empty table;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
from functools import lru_cache

from pyspark.sql import DataFrame

from pelagia.llm.common import map_batches, tokenizer_file

CHUNK_CHARS = 1 << 16
OVERLAP_CHARS = 1 << 10


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of a ``.json`` file, one thread, no truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(tokenizer_file(path))
    found.no_truncation()
    found.no_padding()
    return found


def boundaries(text: str, start: int, encoding) -> dict[int, int]:
    """Proven boundaries of an encoded chunk of ``text``: position -> tokens of the chunk before it."""
    found = {}
    for k, (at, end) in enumerate(encoding.offsets):
        p = start + at
        if 0 < at < end and text[p] in " \t\n\r" and not text[p - 1].isspace():
            found.setdefault(p, k)
    return found


def count_spliced(text: str, encode, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> tuple[int, int, int]:
    """Tokens of a long text, splices made, and times that an overlap was widened.

    ``encode`` gives a str's encoding, with offsets in characters.
    """
    total = splices = widened = 0
    start, n = 0, len(text)
    here = encode(text[: min(n, chunk + overlap)])
    end = min(n, chunk + overlap)
    while end < n:
        lap = overlap
        while True:
            begin = max(start + 1, end - lap)
            stop = min(n, begin + chunk + lap)
            after = encode(text[begin:stop])
            mine = {p: k for p, k in boundaries(text, start, here).items() if p > begin}
            both = mine.keys() & boundaries(text, begin, after).keys()
            both = {p for p in both if p < end}
            if both:
                break
            if begin == start + 1:  # nothing to splice at: a longer chunk instead
                end = min(n, 2 * end - start)
                here = encode(text[start:end])
                if end == n:
                    break
                lap = overlap
            lap *= 2
            widened += 1
        if not both:
            break
        cut = max(both)
        total += mine[cut]
        skipped = boundaries(text, begin, after)[cut]
        splices += 1
        # from here on the chunk after, less what lies before the cut
        total -= skipped
        start, end, here = begin, stop, after
    return total + len(here.ids), splices, widened


def count_tokens(
    docs: DataFrame,
    vocabulary: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 1024,
    chunk: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
) -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), n_splices, n_widened.

    ``vocabulary``: a byte-level BPE ``tokenizers`` file readable on every executor, or the name of a public one.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(part: dict[str, list]) -> dict[str, list]:
        encoder = tokenizer(vocabulary)
        texts = [t or "" for t in part[text_col]]
        counts: list = [None] * len(texts)
        short = [i for i, t in enumerate(texts) if len(t) <= chunk]
        for i, e in zip(short, encoder.encode_batch_fast([texts[i] for i in short], add_special_tokens=False), strict=True):
            counts[i] = (len(e), 0, 0)
        for i, t in enumerate(texts):
            if counts[i] is None:
                counts[i] = count_spliced(t, lambda s: encoder.encode(s, add_special_tokens=False), chunk, overlap)
        return {
            id_col: part[id_col],
            "n_bytes": [len(t.encode()) for t in texts],
            "n_tokens": [c[0] for c in counts],
            "over_limit": [c[0] > limit for c in counts],
            "n_splices": [c[1] for c in counts],
            "n_widened": [c[2] for c in counts],
        }

    return map_batches(
        docs.select(id_col, text_col),
        rows,
        f"{id_col} {kind}, n_bytes long, n_tokens long, over_limit boolean, n_splices long, n_widened long",
    )
