"""Secret scans: fixed patterns, and guess-cost scoring of values in a credential context.

Base spans come from three patterns (assign, access, hex). Besides, a wider
pattern finds values in a credential context (``pwd: ...``, ``passphrase is
...``, ``Bearer ...``), and each value's guess cost is the least over all ways to
cut it into dictionary words, dates, repeats, keyboard walks and brute-force
spans, by dynamic programming over its characters. A value that costs at least
``min_cost`` decimal digits of guesses (``weak_cost`` where the context is a word
of many meanings, as in ``key: ...``), and that no base span touches, is a span of
kind ``guess``. Every value of six characters or more that a context names is
scored, but for references to variables, which hold no value.

The dictionary is that of public vocabularies: their whole-word entries, a word's
rank being its place among them, as vocabularies list what is frequent first. A
few common passwords come before all words.

Each step of the programme looks back over a bounded number of characters for
words, dates and repeats, and over one character for walks and brute force
(whose runs go on at a cost per character), so time is linear in the value's
length and values of any length are scored whole.

Defined cases: null is the empty text, without spans; repeated rows and
repeated or null ids give a row each; an empty table gives an empty table;
other columns are ignored. Places are code points, ends exclusive.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import re
from functools import lru_cache

from pyspark.sql import DataFrame

from pelagia.llm.common import map_batches, tokenizer_file

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the maximal runs of 24 and more
CONTEXT = re.compile(
    r"""(?<![A-Za-z0-9])(?:user_?|db_?|admin_?|client_?|access_?|private_?)?"""
    r"""(?P<name>pass(?:word|wd|phrase|code)?|pwd|pin|secret(?:_?key)?|token|api_?key|key|credentials?|auth(?:orization)?|bearer)"""
    r"""["']?(?:\s{0,3}(?::=|=>|[:=])\s{0,3}(?:bearer\s|basic\s)?|\s(?:is|was)\s|(?<=bearer)\s)["'`]?(?P<value>[^\s"'`<>]{6,})""",
    re.I | re.A,
)
#: Where a program says which variable to read, and not what is in it.
REFERENCE = re.compile(r"\$\{[A-Za-z_][\w.:-]*\}?|\$[A-Z_][A-Z0-9_]*|\{\{.*|%\(\w+\)s|(?:os\.environ|os\.getenv|process\.env|env|config|settings)[\[.(].*|[A-Za-z_][\w.]*\(\)?")
#: Names that are said of many things.
WEAK = {"pass", "pin", "key", "credential", "credentials", "auth", "authorization", "bearer", "token"}
#: A text without one of these (A-Z lower-cased) holds no assign or context match.
HINTS = (b"pass", b"pwd", b"pin", b"secret", b"token", b"key", b"credential", b"auth", b"bearer")

# Words that guesses try first, most used first.
COMMON = (
    "password 123456 12345678 qwerty abc123 monkey letmein dragon iloveyou trustno1 master sunshine ashley "
    "shadow superman michael football baseball welcome login admin princess solo passw0rd starwars hello "
    "freedom whatever charlie secret changeme default guest root test user pass example sample demo temp "
    "access server system summer winter spring autumn monday friday love money killer pepper hunter orange "
    "apple banana cookie coffee cheese flower family house happy lucky magic matrix mustang ninja soccer "
    "the and for you with that this from your have not are was will can all new key token string value null "
    "none true false undefined required placeholder redacted xxxxxx insert here enter your-password"
).split()
#: Public vocabularies whose words guesses try.
VOCABULARIES = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json")
LEET = str.maketrans("@4301$57", "aaeoisst")
# Fixed value: rows of a keyboard, and the alphabet.
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz", "!@#$%^&*()")
NEXT = {a + b for row in ROWS for a, b in zip(row, row[1:])} | {b + a for row in ROWS for a, b in zip(row, row[1:])}
NEXT |= {a + b for up, down in (ROWS[3:4] + ROWS[:1], ROWS[:2], ROWS[1:3]) for x, y in zip(up, down) for a, b in ((x, y), (y, x))}
DATE = re.compile(
    r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d"
)
SEPARATORS = set("-_./:,+")
YEARS = 120
PERIODS = 8
#: Decimal digits of guesses that each further segment adds (which kind comes next, and where).
JOIN = 0.6
SEPARATOR = 0.3
#: Decimal digits of guesses from which a value is a secret: a billion guesses, and many more after a weak name.
MIN_COST, WEAK_COST = 9.0, 17.0


@lru_cache(maxsize=2)
def dictionary(vocabularies: tuple[str, ...] = VOCABULARIES) -> tuple[dict[str, float], int]:
    """(decimal digits of the guesses that a word costs, length of the longest word)."""
    rank: dict[str, float] = {}
    for name in vocabularies:
        with open(tokenizer_file(name), "rb") as lines:
            if name.endswith(".json"):
                ids = json.load(lines)["model"]["vocab"]
                # word ends are marked, and bytes beyond ASCII have stand-ins, so only plain words are taken
                words = [t.removesuffix("</w>") for t in sorted(ids, key=ids.get) if t.endswith("</w>") and t.isascii()]
            else:
                words = [base64.b64decode(line.split()[0]).decode("utf-8", "replace").removeprefix(" ") for line in lines]
        found = dict.fromkeys(w.lower() for w in words if len(w) >= 3 and w.isalpha())
        for k, w in enumerate(found):
            rank[w] = min(rank.get(w, math.inf), math.log10(len(COMMON) + k + 2))
    for k, w in enumerate(COMMON):
        rank[w] = math.log10(k + 2)
    return rank, max(map(len, rank))


def _brute(c: str) -> float:
    n = 10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100
    return math.log10(n)


def guess_cost(value: str) -> float:
    """Decimal digits of the guesses that the cheapest segmentation of a value needs; 0 for the empty value."""
    n = len(value)
    ranks, longest = dictionary()
    low = value.lower()
    plain = low.translate(LEET)
    # best: any segmentation that ends here; brute and walk: the last segment is one of those and may go on
    best = [0.0] + [math.inf] * n
    brute, walk = [math.inf] * (n + 1), [math.inf] * (n + 1)
    run = [0] * (PERIODS + 1)  # characters so far that equal the one a period before
    for end in range(1, n + 1):
        c = value[end - 1]
        brute[end] = min(brute[end - 1], best[end - 1] + JOIN) + _brute(c)
        cost = brute[end]
        if c in SEPARATORS and 1 < end < n:  # between segments it is one of a few, and the next is like it
            cost = min(cost, best[end - 1] + SEPARATOR)
        if end > 1 and low[end - 2 : end] in NEXT:
            start = best[end - 2] + JOIN + 1.3  # a key to start at
            walk[end] = min(walk[end - 1], start + 0.3) + 0.3
            cost = min(cost, walk[end])
        for length in range(3, min(longest, end) + 1):
            begin = end - length
            word = low[begin:end]
            rank, extra = ranks.get(word), 0.0
            if rank is None and plain[begin:end] != word:
                rank, extra = ranks.get(plain[begin:end]), 0.5
            if rank is not None:
                shape = value[begin:end]
                extra += 0.0 if shape == word else 0.3 if shape in (word.capitalize(), word.upper()) else 0.3 * length
                cost = min(cost, best[begin] + JOIN + rank + extra)
        for length in (4, 8, 10):
            if length <= end and DATE.fullmatch(value, end - length, end):
                cost = min(cost, best[end - length] + JOIN + math.log10(YEARS * (1 if length == 4 else 365)))
        for period in range(1, PERIODS + 1):
            run[period] = run[period] + 1 if end > period and value[end - 1] == value[end - 1 - period] else 0
            times = run[period] // period
            if times:  # the unit before the run, once, and how often it comes again
                begin = end - (run[period] // period) * period
                cost = min(cost, best[begin] + math.log10(times + 1))
        best[end] = cost
    return max(0.0, best[n] - JOIN) if n else 0.0


def find_secrets(text: str | None, min_cost: float = MIN_COST, weak_cost: float = WEAK_COST) -> tuple[list[tuple[int, int, int]], list[float]]:
    """Spans (start, rank of the kind, end) in order, and the guess costs of the context values scored."""
    if not text:
        return [], []
    spans: list[tuple[int, int, int]] = []
    costs: list[float] = []
    raw = text.encode().lower()
    hinted = any(h in raw for h in HINTS)
    if hinted:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"akia" in raw:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if hinted:
        base = sorted((a, b) for a, _, b in spans)
        for m in CONTEXT.finditer(text):
            value = m["value"].rstrip(".,;:!?)]}")
            if len(value) < 6 or REFERENCE.fullmatch(value):
                continue
            cost = guess_cost(value)
            costs.append(cost)
            a, b = m.start("value"), m.start("value") + len(value)
            if cost >= (weak_cost if m["name"].lower() in WEAK else min_cost) and not any(x < b and a < y for x, y in base):
                spans.append((a, 3, b))
    return sorted(spans), costs


def scan(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_cost: float = MIN_COST, weak_cost: float = WEAK_COST
) -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, n_guess, base_sha256, spans ("kind:start:end", comma-joined, by
    start, then kind), n_scored (context values scored) and max_cost (the highest of their guess costs, or null)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(part: dict[str, list]) -> dict[str, list]:
        found = [find_secrets(t, min_cost, weak_cost) for t in part[text_col]]
        said = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
        count = lambda k: [sum(x[1] == k for x in spans) for spans, _ in found]
        return {
            id_col: part[id_col],
            "n_assign": count(0),
            "n_access": count(1),
            "n_hex": count(2),
            "n_guess": count(3),
            "base_sha256": [hashlib.sha256(said([x for x in spans if x[1] < 3]).encode()).hexdigest() for spans, _ in found],
            "spans": [said(spans) for spans, _ in found],
            "n_scored": [len(costs) for _, costs in found],
            "max_cost": [max(costs, default=None) for _, costs in found],
        }

    return map_batches(
        docs.select(id_col, text_col),
        rows,
        f"{id_col} {kind}, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string, n_scored long, max_cost double",
    )
