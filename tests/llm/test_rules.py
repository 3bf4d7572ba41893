import math
import random
import re

import public_tokenizers
import sentencepiece

from pelagia.llm import rules
from tests.llm.helpers import AWKWARD, clashing, empty

PATHS = "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"

TEXT = "Plain words with some 日本語 and ∮ 🙂 marks"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = [], 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.append(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_counts():
    random.seed(6)
    texts = ["".join(random.choice(["a", "b", "A", " ", "\n", "\t", "#", "é", "\x0b", "\x1c", "\xa0", "🙂"]) for _ in range(random.randint(0, 120))) for _ in range(200)]
    for t in [*texts, "", "a b c a b c", "x x x x", "l\nl\n\n\nl\r\nl"]:
        assert rules.base_counts(t) == brute(t), repr(t)


def test_fertility():
    ids = rules.vocabulary(PATHS[0]).encode_ordinary(TEXT)
    processor = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PATHS[1]))
    spelled = [processor.id_to_piece(i) for i in processor.encode(TEXT)]
    cpt, share, entropy = rules.fertility(TEXT, *PATHS)
    times = {i: ids.count(i) / len(ids) for i in ids}
    assert cpt == len(TEXT) / len(ids) and abs(entropy + sum(p * math.log2(p) for p in times.values())) < 1e-9
    assert abs(share - sum(bool(re.fullmatch("<0x..>", p)) for p in spelled) / len(spelled)) < 1e-12 and 0 < share < 0.5
    assert rules.fertility("", *PATHS) == (0.0, 0.0, 0.0)
    assert rules.fertility("a" + " " * 1_500_000 + "b", *PATHS)[2] < 1  # a run that the pattern alone can't take


def test_long_runs_of_white_space_as_the_library_has_them():
    random.seed(4)
    encoding = rules.vocabulary(PATHS[0])
    runs = [" ", "\n", " \n\t", "\u3000 ", "\xa0", "\x1c", "\r\n"]
    for n in (900, 999, 1000, 1001, 1500, 40_000):
        for run in runs:
            space = (run * n)[:n]
            for text in (f"a{space}word here", f"a{space}", f"{space}7", f"a{space}", f"a {space}'s{space} .{space}é"):
                assert rules.encode(encoding, text).tolist() == encoding.encode_ordinary(text)
    for _ in range(30):
        text = "".join(random.choice(["a", " 1", "don't", ".", "\n", *(r * random.randint(300, 1500) for r in runs)]) for _ in range(12))
        assert rules.encode(encoding, text).tolist() == encoding.encode_ordinary(text)


def test_script():
    texts = ("word", "слово и ещё", "λόγος", "日本語", "عربي", "עברית", "हिन्दी", "ไทย", "ქართული", "123 🙂", "")
    assert [rules.script(t) for t in texts] == ["latin", "cyrillic", "greek", "cjk", "arabic", "hebrew", "indic", "thai", "other", "other", "other"]


def test_bands_of_scripts(spark):
    """Sentences stay in the band of their script; the same bytes read as another script's letters don't."""
    clean = {
        "ru": "Сегодня утром рыбаки вышли в море раньше обычного, потому что ветер стих и вода была спокойной. ",
        "el": "Σήμερα το πρωί οι ψαράδες βγήκαν στη θάλασσα νωρίτερα από το συνηθισμένο, γιατί ο άνεμος είχε κοπάσει. ",
        "pl": "Dziś rano rybacy wypłynęli w morze wcześniej niż zwykle, ponieważ wiatr ucichł i woda była spokojna. ",
        "ar": "خرج الصيادون هذا الصباح إلى البحر أبكر من المعتاد لأن الريح هدأت وكان الماء ساكنا. ",
    }
    for name, text in clean.items():
        band = rules.SCRIPT_BANDS[rules.script(text)]
        cpt, share, entropy = rules.fertility(text, *PATHS)
        assert band.chars_per_token[0] <= cpt <= band.chars_per_token[1] and share <= band.max_fallback and entropy >= band.min_entropy, name
    for bad in (clean["ru"].encode().decode("latin-1"), "".join(chr(0x16A0 + k % 70) + " " * (k % 5 == 0) for k in range(300))):
        band = rules.SCRIPT_BANDS[rules.script(bad)]
        cpt, share, entropy = rules.fertility(bad, *PATHS)
        assert not (cpt >= band.chars_per_token[0] and share <= band.max_fallback), (cpt, share)


def test_clean_documents_stay(spark):
    where = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet").toPandas()
    got = rules.quality(docs, *PATHS).toPandas().merge(labels, on="doc_id")
    passed = got[~got.base_failed]
    assert passed[passed.quality == 1].kept.mean() > 0.995
    assert passed[passed.quality == 0].kept.mean() < 0.5
    texts = {r.doc_id: r.text for r in docs.limit(60).collect()}
    for r in got[got.doc_id.isin(texts)].itertuples():
        want = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_awkward_and_empty(spark):
    got = rules.quality(clashing(spark, "kept", "id", "n_words"), *PATHS).collect()
    assert len(got) == len(AWKWARD) and all(r.base_failed and not r.kept for r in got if r.n_words == 0)
    assert rules.quality(empty(spark), *PATHS).collect() == []
