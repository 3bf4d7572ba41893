import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pelagia.llm import tokens
from tests.llm.helpers import AWKWARD, awkward, clashing, empty

PATH = public_tokenizers.path("byte_bpe_50k.json")
ENCODER = tokens.tokenizer(PATH)


def encode(text):
    return ENCODER.encode(text, add_special_tokens=False)


@pytest.mark.parametrize("seed", range(4))
def test_splices_give_the_whole_texts_count(seed):
    random.seed(seed)
    pool = [" ", "  ", "\n", "a", "don't", "<|endoftext|>", "é", "日本", "🙂", "...", "12", "\t  ", "x" * 9, "'s", "<|endof", "\x85", "\x1c", " "]
    spliced = 0
    for _ in range(150):
        text = "".join(random.choice(pool) for _ in range(random.randint(0, 300)))
        n, splices, _ = tokens.count_spliced(text, encode, random.choice([7, 20, 50]), random.choice([1, 4, 16]))
        assert n == len(encode(text).ids), text
        spliced += splices
    assert spliced > 100


def test_a_text_without_white_space_widens_to_its_end():
    n, splices, widened = tokens.count_spliced("ab" * 2000, encode, 100, 10)
    assert (n, splices) == (len(encode("ab" * 2000).ids), 0) and widened > 0


def test_table(spark):
    plain = Tokenizer.from_file(PATH)
    got = tokens.count_tokens(awkward(spark), PATH, limit=50, chunk=1000, overlap=50).collect()
    want = sorted((d, len((t or "").encode()), len(plain.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in AWKWARD if d is not None)
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got if r.doc_id is not None) == want
    assert len(got) == len(AWKWARD) and all(r.over_limit == (r.n_tokens > 50) for r in got)
    assert max(r.n_splices for r in got) > 50


def test_empty_and_clashing(spark):
    assert tokens.count_tokens(empty(spark), PATH).collect() == []
    assert tokens.count_tokens(clashing(spark, "n_tokens", "n_bytes"), PATH).count() == len(AWKWARD)
