"""Secret scans: fixed patterns, and password guess cost in credential contexts.

Base kinds (assign, access, hex) are patterns with a length test. Beyond them
the scan looks at values in a credential context (a word such as password,
pwd, passphrase or api key, then a separator) and asks how many guesses the
value stands: dynamic programming over its characters finds the cheapest cut
into common words (by rank, with a factor for capitals and for look-alike
digits), dates and years, repeats, keyboard walks and brute-force spans (by
the size of the character class). A value of `least_log10` (10) or more is
added as kind `guess`, unless a base span overlaps it; base spans stay
whatever they cost. Offsets are in code points, ends excluded.

The words are common ones of passwords and then `words.txt`: the 38,132 words
and word parts of three or more ASCII letters in the vocabulary of the public
tokenizer `word_bpe_49k.json`, in its order (of merges, so about by
frequency), without repeats of one letter. Rarer words are cut into parts;
words of other languages are mostly costed by their characters.

Null text counts as empty. Every text is scanned whole, and a value is taken
and costed to its end, however long it is.
"""

from __future__ import annotations

import hashlib
import importlib.resources
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .kernels import frugal

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase|code)|pwd|secret|token|credentials?|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key)["']?[\x20\t]{0,3}(?:[:=]|=>|:=|\bis\b)[\x20\t]{0,3}["'`]?([^\s"'`,;<>(){}\[\]]{6,})""", re.IGNORECASE | re.ASCII)
HINTS = ("passw", "passp", "passc", "pwd", "secret", "token", "credential", "key")

#: Common words of passwords, most frequent first.
WORDS = """password admin welcome login monkey dragon master letmein football baseball shadow superman michael
sunshine princess iloveyou trustno flower hello freedom whatever qazwsx starwars batman summer winter spring autumn
secret changeme default guest root user test temp example sample demo pass word pass1 token key api value string none
null true false your here insert replace placeholder dummy foobar foo bar baz system server database backup manager
service account private public company office money love god angel baby cookie ginger pepper hunter killer soccer
hockey tiger jordan charlie daniel thomas robert jessica jennifer ashley amanda andrew joshua george""".split()
COMMON = importlib.resources.files(__package__).joinpath("words.txt").read_text().split()
RANK = {w: i + 1 for i, w in enumerate(dict.fromkeys([*WORDS, *COMMON]))}
LONGEST = max(map(len, RANK))
#: Characters that stand for letters.
LOOKALIKE = str.maketrans("@4301$57!", "aaeoissti")
#: Rows of the keyboard.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_PLACE = {c: (r, i + r * 0.5) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
_DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d")


def _near(a: str, b: str) -> bool:
    if a not in _PLACE or b not in _PLACE:
        return False
    (r, x), (s, y) = _PLACE[a], _PLACE[b]
    return a != b and abs(r - s) <= 1 and abs(x - y) <= 1


def _char_cost(c: str) -> float:
    if c.isdigit():
        return 1.0
    if c.isascii() and c.isalpha():
        return math.log10(26)
    return math.log10(33 if c.isascii() else 1000)


class _Run:
    """Spans inside a run of equal labels, at a cost of start + log10(length).

    The cheapest start is found without looking at all: once an earlier start is no dearer than a later one, it stays so.
    """

    def __init__(self, labels: list, least: int):
        self.labels, self.least, self.begin, self.starts = labels, least, 0, []

    def cheapest(self, j: int, best: list[float], back: float) -> float:
        """Of the spans that end at j, one after the other; back: what the start at j - least saves."""
        if j < 2 or not self.labels[j - 1]:
            self.starts = []
            return math.inf
        if self.labels[j - 1] != self.labels[j - 2]:
            self.begin, self.starts = j - 2, []
        i = j - self.least
        if i >= self.begin:
            self.starts.append((best[i] - back, i))
        kept, low, least = [], math.inf, math.inf
        for b, i in self.starts:
            cost = b + math.log10(j - i)
            if cost < least:
                least = cost
                kept.append((b, i))
        # a start that is dearer than a later one from the outset never gets cheaper
        self.starts = []
        for b, i in reversed(kept):
            if b < low:
                low = b
                self.starts.append((b, i))
        self.starts.reverse()
        return least


def guess_cost(value: str) -> float:
    """log10 of the guesses that the cheapest segmentation needs."""
    n, low = len(value), value.lower()
    plain = low.translate(LOOKALIKE)
    spans: dict[int, list[tuple[int, float]]] = {}
    for i in range(n):
        for j in range(i + 3, min(n, i + LONGEST) + 1):
            for text, extra in ((low, 0.0), (plain, math.log10(4))):
                if rank := RANK.get(text[i:j]):
                    capitals = sum(c.isupper() for c in value[i:j])
                    spans.setdefault(j, []).append((i, math.log10(rank + 1) + extra + (math.log10(2) if capitals in (1, j - i) and capitals else 0.3 * capitals)))
                    break
        if m := _DATE.match(value, i):
            spans.setdefault(m.end(), []).append((i, math.log10(365 * 150 if m.end() - i > 4 else 150)))
    row = [_PLACE[c][0] if c in _PLACE else 0 for c in low]
    same, walk, step, turned = [False] * n, [False] * n, [0] * n, [0] * (n + 1)  # of each character and the one before; turns of the walk so far
    for j in range(1, n):
        same[j] = value[j] == value[j - 1]
        walk[j] = _near(low[j - 1], low[j])
        turned[j] = turned[j - 1] + (walk[j] and walk[j - 1] and row[j] - row[j - 1] != row[j - 1] - row[j - 2])
        d = ord(value[j]) - ord(value[j - 1])
        step[j] = d if d in (1, -1) and value[j].isalnum() else 0
    turned[n] = turned[n - 1]
    turn = math.log10(4)
    runs = (_Run(same, 3), _Run(walk, 4), _Run(step, 3))
    best = [0.0] + [math.inf] * n
    for j in range(1, n + 1):
        best[j] = best[j - 1] + _char_cost(value[j - 1])
        for i, cost in spans.get(j, ()):
            best[j] = min(best[j], best[i] + cost + 0.3)  # the factor for one more part
        i = j - 4
        for run, own, back in ((runs[0], _char_cost(value[j - 1]), 0.0), (runs[1], math.log10(47 * 4) + turn * turned[j - 1], turn * turned[i + 1] if i >= 0 else 0.0), (runs[2], math.log10(62 * 2), 0.0)):
            best[j] = min(best[j], run.cheapest(j, best, back) + own + 0.3)
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), ordered."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def scan_text(text: str | None, least_log10: float = 10.0) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], float]:
    """(base spans, all spans, largest log10 of guesses among costed values)."""
    if not text:
        return [], [], 0.0
    low = text.lower()
    hinted = any(h in low for h in HINTS)
    base = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    more, most = [], 0.0
    if hinted:
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
        for m in CONTEXT.finditer(text):
            cost = guess_cost(m[1])
            most = max(most, cost)
            if cost >= least_log10 and not any(s < m.end(1) and m.start(1) < e for s, _, e in base):
                more.append((m.start(1), 3, m.end(1)))
    return sorted(base), sorted(base + more), most


def join_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame, *, text_col: str = "text", least_log10: float = 10.0) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess, max_log10_guesses."""

    @frugal
    def run(batches):
        for b in batches:
            counts, digests, spans, most = ([], [], [], []), [], [], []
            for text in b.column(1):
                base, every, cost = scan_text(text.as_py(), least_log10)
                for k in range(4):
                    counts[k].append(sum(x[1] == k for x in every))
                digests.append(hashlib.sha256(join_spans(base).encode()).hexdigest())
                spans.append(join_spans(every))
                most.append(cost)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in counts[:3]], pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(counts[3], pa.int64()), pa.array(most, pa.float64())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess", "max_log10_guesses"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", text_col).mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, max_log10_guesses double")


def mask_secrets(docs: DataFrame, *, text_col: str = "text", least_log10: float = 10.0, mark: str = "[secret]") -> DataFrame:
    """docs with every span replaced by mark; null stays null."""
    own, at = docs.columns, docs.columns.index(text_col)

    def clean(text):
        if text is None:
            return None
        out, last = [], 0
        for s, _, e in scan_text(text, least_log10)[1]:
            if s >= last:
                out += [text[last:s], mark]
            last = max(last, e)
        return "".join([*out, text[last:]])

    @frugal
    def run(batches):
        for b in batches:
            cols = list(b.columns)
            cols[at] = pa.array([clean(x.as_py()) for x in cols[at]], pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=own)

    return docs.mapInArrow(run, docs.schema)


__all__ = ["base_spans", "guess_cost", "mask_secrets", "scan_secrets", "scan_text"]
