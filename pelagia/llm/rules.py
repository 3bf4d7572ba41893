"""Quality rules: word and repetition counts, then tokeniser fertility with bands per language or script.

The base rules reject texts of fewer than ``min_words`` words and texts of
which over half of the words lie in 3-word windows that occur twice or more.
Texts that pass are encoded with two public vocabularies and measured:
characters per token and entropy of the tokens in bits with a byte-level BPE
vocabulary for many languages, and the share of byte-fallback tokens with a
piece vocabulary that spells a character it doesn't know in bytes. A text
outside of its band is rejected. The band is that of the ``lang`` column's
language, or for other languages (and null) of the text's main script.

Memory follows the longest text. The vocabulary's pattern takes a run of white
space as one piece, but for its last character where a word follows; on runs of
about a million characters its matcher fails. So runs of ``RUN`` characters and
more are handed over as the piece that they are, which gives the same tokens.

Defined cases: null is the empty text, which the base rules reject; repeated
rows and repeated or null ids give a row each; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagia.llm.common import map_batches, tokenizer_file

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\r\x0b\f"
RUN = 1000
# Fixed value: Unicode's white space, which the vocabulary's pattern goes by.
_WHITE = "\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A long run of white space less its last character, or a whole one at the end.
_LONG_RUN = re.compile(rf"(?<![{_WHITE}])([{_WHITE}]{{{RUN},}}\Z|[{_WHITE}]{{{RUN},}}(?=[{_WHITE}]))")


@dataclass(frozen=True)
class Band:
    """What a text's measures must lie in."""

    chars_per_token: tuple[float, float]
    max_fallback: float
    min_entropy: float


#: From some way below what clean text of the language measures with vocabularies that weren't made for it, up to one
#: token a word. Of 3,243 documents labelled clean at sf0.1 the least characters per token were 2.33 (en), 2.52 (de),
#: 2.12 (fr) and 2.30 (es), the least entropy 5.55 bits, the greatest fallback share 0.044.
LANGUAGE_BANDS = {
    "en": Band((2.2, 8.0), 0.08, 5.2),
    "de": Band((2.35, 9.0), 0.08, 5.2),
    "fr": Band((2.0, 8.0), 0.08, 5.2),
    "es": Band((2.15, 8.0), 0.08, 5.2),
}
#: By script, for languages without a band: around what a sentence or two of its languages measure (Polish, Vietnamese,
#: Turkish and Finnish; Russian; Greek; Chinese, Japanese and Korean; Arabic; Hebrew; Hindi and Tamil; Thai), wide, as
#: a sentence is little. "other" holds all scripts that aren't listed, and texts without letters.
SCRIPT_BANDS = {
    "latin": Band((1.5, 9.0), 0.15, 4.2),
    "cyrillic": Band((1.8, 7.0), 0.15, 4.2),
    "greek": Band((1.2, 7.0), 0.15, 4.2),
    "cjk": Band((0.6, 3.0), 0.45, 4.2),
    "arabic": Band((1.2, 7.0), 0.15, 4.2),
    "hebrew": Band((1.1, 7.0), 0.15, 4.2),
    "indic": Band((0.5, 5.0), 0.35, 3.8),
    "thai": Band((0.7, 5.0), 0.15, 4.0),
    "other": Band((0.2, 9.0), 0.5, 3.0),
}
# First and last code point of the letters that tell a script.
SCRIPTS = (
    ("latin", 0x41, 0x24F),
    ("greek", 0x370, 0x3FF),
    ("cyrillic", 0x400, 0x52F),
    ("hebrew", 0x590, 0x5FF),
    ("arabic", 0x600, 0x6FF),
    ("indic", 0x900, 0xDFF),
    ("thai", 0xE00, 0xE7F),
    ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x1F00, 0x1FFF),
    ("cjk", 0x3040, 0x30FF),
    ("cjk", 0x3400, 0x9FFF),
    ("cjk", 0xAC00, 0xD7AF),
)


@lru_cache(maxsize=2)
def vocabulary(path: str):
    """The encoding of a ``.tiktoken`` file."""
    import public_tokenizers
    import tiktoken

    with open(tokenizer_file(path), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def pieces(path: str):
    """(processor, bool per id: a byte) of a ``.model`` file."""
    import sentencepiece

    found = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(path))
    return found, np.array([found.is_byte(k) for k in range(found.vocab_size())])


def encode(encoding, text: str) -> np.ndarray:
    if len(text) < RUN:
        return np.array(encoding.encode_ordinary(text), np.int64)
    ids: list[int] = []
    for k, part in enumerate(_LONG_RUN.split(text)):
        ids += encoding._encode_single_piece(part) if k % 2 else encoding.encode_ordinary(part)
    return np.array(ids, np.int64)


def fertility(text: str, path: str, piece_path: str) -> tuple[float, float, float]:
    """Characters per token, byte-fallback share, entropy of the tokens in bits; zeros for an empty text."""
    ids = encode(vocabulary(path), text)
    if not len(ids):
        return 0.0, 0.0, 0.0
    processor, is_byte = pieces(piece_path)
    spelled = np.array(processor.encode(text), np.int64)
    p = np.unique(ids, return_counts=True)[1] / len(ids)
    return len(text) / len(ids), float(is_byte[spelled].mean()) if len(spelled) else 0.0, float(-(p * np.log2(p)).sum())


def script(text: str) -> str:
    """The script of most of the text's letters that SCRIPTS knows; "other" if there are none."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    count: dict[str, int] = {}
    for name, a, b in SCRIPTS:
        count[name] = count.get(name, 0) + int(((points >= a) & (points <= b)).sum())
    best = max(count, key=count.get)
    return best if count[best] else "other"


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words inside a window of ``width`` words that occurs twice or more, its first occurrence included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    key, size = ids[:n], len(seen)
    for k in range(1, width):
        if size * len(seen) >= 1 << 62:
            values, key = np.unique(key, return_inverse=True)
            size = len(values)
        key, size = key * len(seen) + ids[k : k + n], size * len(seen)
    _, where, times = np.unique(key, return_inverse=True, return_counts=True)
    again = times[where] > 1
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[k : k + n] |= again
    return int(covered.sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode()
    words = raw.split()
    seen: set[bytes] = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line.strip():
            dup += line in seen
            seen.add(line)
    return (
        len(words),
        len(text) - (len(raw) - len(raw.translate(None, SPACE))),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        dup,
        repeated_words(words),
    )


def quality(
    docs: DataFrame,
    path: str,
    piece_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str | None = "lang",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    languages: dict[str, Band] = LANGUAGE_BANDS,
    scripts: dict[str, Band] = SCRIPT_BANDS,
) -> DataFrame:
    """``path`` and ``piece_path``: the byte-level and the piece vocabulary, as files or names of public ones.

    Per row: id, the base counts, base_failed, kept, and chars_per_token, fallback_share and token_entropy
    (null where the base rules reject, as the text isn't encoded then)."""
    kind = docs.schema[id_col].dataType.simpleString()
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")

    def rows(part: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in names}
        for name, text, language in zip(part["id"], part["text"], part["lang"], strict=True):
            text = text or ""
            n_words, chars, symbols, dup, repeat = base_counts(text)
            failed = n_words < min_words or 100 * repeat > max_repeat_percent * n_words
            cpt = share = entropy = None
            if not failed:
                cpt, share, entropy = fertility(text, path, piece_path)
                band = languages.get(language) or scripts[script(text)]
            kept = not failed and (
                band.chars_per_token[0] <= cpt <= band.chars_per_token[1]
                and share <= band.max_fallback
                and entropy >= band.min_entropy
            )
            row = (name, n_words, chars, symbols, dup, repeat, failed, kept, cpt, share, entropy)
            for k, v in zip(names, row, strict=True):
                out[k].append(v)
        return out

    schema = (
        f"{id_col} {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, chars_per_token double, fallback_share double, token_entropy double"
    )
    names = [x.split()[0] for x in schema.split(", ")]
    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), lang.alias("lang")), rows, schema)
