"""Secret scans: fixed patterns, and a battery of randomness tests for what no pattern names.

The patterns (fixed values of the task): an assignment to a secret's name, an access key id, and a run of
lower-case hex digits.  They are searched in the whole text; a match that is too short is dropped and
what it covered is not searched again.

Beside them every run of 16 or more characters of ``[A-Za-z0-9+/_-]``, with the ``=`` that pad its end, is a
candidate, and so are its parts of that length between ``/`` and ``+``, between ``_`` and ``-``, and between any of the
four.  From its characters an encoding is inferred (``ENCODINGS``, the narrowest that has them all) and three
tests ask whether it looks drawn at random from that alphabet:

* chi-squared on the use of the alphabet, over its characters and, as these are sparse in short candidates,
  over cells of them (kinds of characters, common and rare letters);
* the number of runs of characters of one cell;
* the serial correlation of neighbours, in an order of the alphabet that puts vowels first.

Fisher's method combines them to one statistic, which is small for random strings and grows with the length
of ordinary ones.  Its distribution over ordinary strings (words joined as names, paths and numbers are) is
simulated once for each encoding and length, with a fixed seed, and fitted by a gamma law.  A candidate's
p-value is the chance that an ordinary string of its encoding and length looks as random.  The candidates of
a document pass together by Benjamini and Hochberg at ``fdr``, each weighted by its length: longer candidates
get more of the errors that are allowed.  A candidate must also not be rejected as random (``CHANCE_LEVEL``).  Of
candidates that pass and lie in one another the widest counts.  Spans that overlap a pattern's are dropped.

Defined cases: null counts as the empty text; offsets are code points, ends exclusive; repeated rows give
repeated results.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kind, pattern, group to measure, least length.
PATTERNS = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # runs are maximal, so this finds the runs of [0-9a-f]+ that are long enough
]
#: What a text must contain for its pattern to match at all, in RE2's syntax.
_HINTS = [r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "AKIA[A-Z0-9]", r"[0-9a-f]{24}", r"[A-Za-z0-9+/_=-]{16}"]
# "(?i:" also folds the Kelvin sign and the long s; the letters meant are ASCII.
_COMPILED = [(kind, re.compile(pattern, re.ASCII), group, least) for kind, pattern, group, least in PATTERNS]
#: A run with its padding; a sign with more of the run behind it separates a name from a value.
_RUN = re.compile(r"[A-Za-z0-9+/_-]+(?:=+(?![A-Za-z0-9+/_=-]))?")
_PARTS = [re.compile(r"[A-Za-z0-9_=-]+"), re.compile(r"[A-Za-z0-9+/=]+"), re.compile(r"[A-Za-z0-9=]+")]
LEAST = 16

#: Letters by how common they are in ordinary text, vowels and then consonants, with percentages.
VOWELS = {"e": 12.7, "a": 8.2, "o": 7.5, "i": 7.0, "u": 2.8, "y": 2.0}
CONSONANTS = {
    "t": 9.1, "n": 6.7, "s": 6.3, "h": 6.1, "r": 6.0, "d": 4.3, "l": 4.0, "c": 2.8, "m": 2.4, "w": 2.4,
    "f": 2.2, "g": 2.0, "p": 1.9, "b": 1.5, "v": 1.0, "k": 0.8, "j": 0.15, "x": 0.15, "q": 0.1, "z": 0.07,
}
DIGITS = "0123456789"
_LOWER = "".join([*VOWELS, *CONSONANTS])
_UPPER = _LOWER.upper()
_COMMON = set("eaoitnshrdl")

#: Encodings by their alphabets, the narrowest first.
ENCODINGS = [
    ("hex", DIGITS + "abcdef"),
    ("HEX", DIGITS + "ABCDEF"),
    ("lower", _LOWER),
    ("UPPER", _UPPER),
    ("base32", _UPPER + "234567"),
    ("base36", _LOWER + DIGITS),
    ("BASE36", _UPPER + DIGITS),
    ("letters", _LOWER + _UPPER),
    ("base62", _LOWER + _UPPER + DIGITS),
    ("base64", _LOWER + _UPPER + DIGITS + "+/"),
    ("base64url", _LOWER + _UPPER + DIGITS + "-_"),
]
LENGTHS, SAMPLES, SEED = (16, 20, 24, 32, 48, 64, 96, 128, 192, 256), 4000, 11
CHANCE_LEVEL, FDR = 0.0005, 0.01


class Alphabet:
    """An alphabet with the place of each character, its value for the serial test, and its cell."""

    def __init__(self, name: str, chars: str):
        self.name, self.chars, self.size = name, chars, len(chars)
        self.place = {c: i for i, c in enumerate(chars)}
        cells = [self._cell(c) for c in chars]
        names = sorted(set(cells))
        self.cell = np.array([names.index(c) for c in cells])
        self.share = np.bincount(self.cell) / self.size
        # Neighbouring values are alike in kind: vowels, consonants, digits, signs, whatever their case.
        rank = [_LOWER.find(c.lower()) if c.isalpha() else 26 + (DIGITS.find(c) if c.isdigit() else 10) for c in chars]
        self.value = np.array(rank, np.float64)
        self.value -= self.value.mean()

    def _cell(self, c: str) -> str:
        if c.isdigit():
            return ("digit 0-4" if c < "5" else "digit 5-9") if self.name.lower() == "hex" else "digit"
        if not c.isalpha():
            return "sign"
        if self.name.lower() == "hex":
            return "letter"
        return ("lower" if c.islower() else "upper") + (" common" if c.lower() in _COMMON else " vowel" if c.lower() in VOWELS else " rare")


_ALPHABETS = [Alphabet(*e) for e in ENCODINGS]


def infer_encoding(token: str) -> Alphabet | None:
    """The narrowest encoding that has all characters of the token, or None."""
    used = set(token)
    return next((a for a in _ALPHABETS if used <= a.place.keys()), None)


def _erfc(z: np.ndarray) -> np.ndarray:
    return np.array([math.erfc(x) for x in z])


def _two_sided(z: np.ndarray) -> np.ndarray:
    return _erfc(np.abs(z) / math.sqrt(2))


def _chi_squared_p(x: np.ndarray, df: int) -> np.ndarray:
    """The upper tail by Wilson and Hilferty's approximation."""
    return 0.5 * _erfc(((np.maximum(x, 1e-9) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)) / math.sqrt(2))


def _counts(rows: np.ndarray, size: int) -> np.ndarray:
    n = len(rows)
    return np.bincount((rows + size * np.arange(n)[:, None]).ravel(), minlength=n * size).reshape(n, size)


def uniformity_p(places: np.ndarray, alphabet: Alphabet) -> np.ndarray:
    """Chi-squared over characters and over cells; the lesser of both, doubled.  A row for each token."""
    n = places.shape[1]
    x = (_counts(places, alphabet.size).astype(np.float64) ** 2).sum(1) * alphabet.size / n - n
    y = (_counts(alphabet.cell[places], len(alphabet.share)) ** 2 / (n * alphabet.share)).sum(1) - n
    return np.minimum(1, 2 * np.minimum(_chi_squared_p(x, alphabet.size - 1), _chi_squared_p(y, len(alphabet.share) - 1)))


def runs_p(places: np.ndarray, alphabet: Alphabet) -> np.ndarray:
    """The number of runs of one cell against its law for independent characters, two-sided."""
    cells, n = alphabet.cell[places], places.shape[1]
    two, three = float((alphabet.share**2).sum()), float((alphabet.share**3).sum())
    q = 1 - two
    var = (n - 1) * q * (1 - q) + 2 * (n - 2) * (1 - 2 * two + three - q * q)
    changes = (cells[:, 1:] != cells[:, :-1]).sum(1)
    return _two_sided(np.maximum(0, np.abs(changes - (n - 1) * q) - 0.5) / math.sqrt(var))


def serial_p(places: np.ndarray, alphabet: Alphabet) -> np.ndarray:
    """The correlation of neighbours, two-sided."""
    v = alphabet.value[places]
    v = v - v.mean(1, keepdims=True)
    scale = (v * v).sum(1)
    r = np.divide((v[:, 1:] * v[:, :-1]).sum(1), scale, out=np.ones(len(v)), where=scale > 0)
    return _two_sided((r + 1 / v.shape[1]) * math.sqrt(v.shape[1]))


def evidence(places: np.ndarray, alphabet: Alphabet) -> np.ndarray:
    """Fisher's statistic of the three tests: 2 times the sum of -log p; near 6 for random tokens."""
    tests = (uniformity_p(places, alphabet), runs_p(places, alphabet), serial_p(places, alphabet))
    return -2 * sum(np.log(np.maximum(p, 1e-300)) for p in tests)


def ordinary(alphabet: Alphabet, n: int, samples: int, rng: np.random.Generator) -> np.ndarray:
    """Places of ordinary strings of n characters: words in which vowels and consonants take turns, joined with
    capitals, digits or signs as the encoding has them; for hex, numbers with few letters."""
    letters = [c for c in alphabet.chars if c.isalpha()]
    digits, signs = [c for c in alphabet.chars if c.isdigit()], [c for c in alphabet.chars if not c.isalnum()]
    both = len({c.isupper() for c in letters}) == 2
    if alphabet.name.lower() == "hex":
        chars = np.where(rng.random((samples, n)) < 0.08, rng.integers(10, 16, (samples, n)), rng.integers(0, 10, (samples, n)))
        repeat = rng.random((samples, n)) < 0.2
        for i in range(1, n):
            chars[:, i] = np.where(repeat[:, i], chars[:, i - 1], chars[:, i])
        return chars
    case = str.upper if letters[0].isupper() else str.lower
    drawn = []  # for vowels and for consonants: places in lower (or the only) case
    for kind in (VOWELS, CONSONANTS):
        weight = np.array(list(kind.values()))
        drawn.append(rng.choice([alphabet.place[case(c)] for c in kind], (samples, n), p=weight / weight.sum()))
    number = rng.choice([alphabet.place[c] for c in digits], (samples, n)) if digits else None
    sign = alphabet.place[rng.choice(signs)] if signs else None
    raised = np.arange(alphabet.size)
    if both:
        raised = np.array([alphabet.place[c.upper()] for c in alphabet.chars])
    capitals = rng.random(samples) < (0.2 if signs else 1)  # names with signs are mostly of one case
    with_numbers = rng.random(samples) < 0.7
    out = np.empty((samples, n), np.int64)
    left, vowel = np.zeros(samples, np.int64), np.zeros(samples, bool)
    mode = np.zeros(samples, np.int64)  # 0 word, 1 number, 2 sign next
    for i in range(n):
        new = left <= 0
        to_number = new & (mode != 1) & with_numbers & (rng.random(samples) < 0.3) if digits else np.zeros(samples, bool)
        put_sign = new & (mode != 2) & (i > 0) & ~to_number if signs else np.zeros(samples, bool)
        mode = np.where(to_number, 1, np.where(put_sign, 2, np.where(new, 0, mode)))
        left = np.where(to_number, rng.integers(1, 5, samples), np.where(put_sign, 1, np.where(new, rng.integers(3, 10, samples), left)))
        vowel = np.where(new, rng.random(samples) < 0.3, rng.random(samples) < np.where(vowel, 0.15, 0.6))
        letter = np.where(vowel, drawn[0][:, i], drawn[1][:, i])
        letter = np.where(new & (mode == 0) & capitals & both, raised[letter], letter)
        out[:, i] = letter
        if digits:
            out[:, i] = np.where(mode == 1, number[:, i], out[:, i])
        if signs:
            out[:, i] = np.where(mode == 2, sign, out[:, i])
        left -= 1
    return out


def null_laws() -> dict[str, tuple[list[float], list[float]]]:
    """Mean and standard deviation of the evidence over ordinary strings, by encoding and length of LENGTHS."""
    laws = {}
    for k, alphabet in enumerate(_ALPHABETS):
        strings = ordinary(alphabet, LENGTHS[-1], SAMPLES, np.random.default_rng(SEED + k))
        found = [evidence(strings[:, :n], alphabet) for n in LENGTHS]
        laws[alphabet.name] = [float(x.mean()) for x in found], [float(x.std()) for x in found]
    return laws


def _gamma_below(x: float, mean: float, deviation: float) -> float:
    """P that a gamma variable of this mean and deviation is at most x; 1 from the mean on."""
    shape, scale = (mean / deviation) ** 2, deviation**2 / mean
    x /= scale
    if x >= shape:
        return 1.0
    if x <= 0:
        return 0.0
    total = term = 1.0
    k = shape
    while term > total * 1e-12:
        k += 1
        term *= x / k
        total += term
    return math.exp(shape * math.log(x) - x - math.lgamma(shape + 1)) * total


def ordinary_p(found: float, name: str, n: int, laws: dict) -> float:
    """P that an ordinary string of this encoding and length has at most this evidence against chance."""
    means, deviations = laws[name]
    if n >= LENGTHS[-1]:  # the evidence adds up over the length
        return _gamma_below(found, means[-1] * n / LENGTHS[-1], deviations[-1] * math.sqrt(n / LENGTHS[-1]))
    return _gamma_below(found, float(np.interp(n, LENGTHS, means)), float(np.interp(n, LENGTHS, deviations)))


_AT_ONCE = 4096  # tokens


def batteries(tokens: list[str], laws: dict) -> list[tuple[float, float] | None]:
    """Of each token (p of chance, p of an ordinary string), None without a known encoding; equal lengths of one encoding are tested together."""
    found: list[tuple[float, float] | None] = [None] * len(tokens)
    alike: dict[tuple[str, int], list[tuple[int, str]]] = {}
    alphabets = {a.name: a for a in _ALPHABETS}
    for i, token in enumerate(tokens):
        core = token.rstrip("=")
        alphabet = infer_encoding(core)
        if alphabet is not None and len(core) >= LEAST // 2:
            alike.setdefault((alphabet.name, len(core)), []).append((i, core))
    for (name, n), listed in alike.items():
        alphabet = alphabets[name]
        for at in range(0, len(listed), _AT_ONCE):
            some = listed[at : at + _AT_ONCE]
            for (i, _), x in zip(some, evidence(np.array([[alphabet.place[c] for c in core] for _, core in some]), alphabet).tolist()):
                half = x / 2
                found[i] = math.exp(-half) * (1 + half + half * half / 2) if half < 700 else 0.0, ordinary_p(x, name, max(n, LEAST), laws)
    return found


def battery(token: str, laws: dict) -> tuple[float, float] | None:
    return batteries([token], laws)[0]


def pattern_spans(text: str, hints: tuple[bool, ...] = (True,) * 4) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the fixed patterns; hints: which can match."""
    return sorted(
        (m.start(), n, m.end())
        for n, (_, pattern, group, least) in enumerate(_COMPILED)
        if hints[n]
        for m in pattern.finditer(text)
        if m.end(group) - m.start(group) >= least
    )


def candidates(text: str) -> list[tuple[int, int]]:
    """Start and end of the runs and of their parts."""
    found: dict[tuple[int, int], None] = {}
    for m in _RUN.finditer(text):
        if m.end() - m.start() >= LEAST:
            found[m.span()] = None
            found.update((p.span(), None) for part in _PARTS for p in part.finditer(text, *m.span()) if p.end() - p.start() >= LEAST)
    return list(found)


def random_spans(text: str, taken: list[tuple[int, int, int]], fdr: float, laws: dict) -> list[tuple[int, int, int]]:
    """Candidates beside the spans taken (in order) that pass the battery."""
    starts = [a for a, _, _ in taken]
    furthest = list(accumulate((b for _, _, b in taken), max))  # of all spans up to here
    covered = lambda start, end: (n := bisect_left(starts, end)) > 0 and furthest[n - 1] > start
    free = [(start, end) for start, end in candidates(text) if not covered(start, end)]
    judged = [(start, end, found) for (start, end), found in zip(free, batteries([text[start:end] for start, end in free], laws))]
    total = sum(end - start for start, end, _ in judged)
    weighted = sorted((found[1] * total / (len(judged) * (end - start)) if found else 1.0, start, end, found) for start, end, found in judged)
    passed = max((k for k, x in enumerate(weighted, 1) if x[0] <= fdr * k / len(weighted)), default=0)
    spans: list[tuple[int, int, int]] = []
    for _, start, end, found in sorted(weighted[:passed], key=lambda x: (x[1], -x[2])):
        if found and found[0] >= CHANCE_LEVEL and (not spans or end > spans[-1][2]):
            spans.append((start, len(PATTERNS), end))
    return spans


def scan_text(text: str, laws: dict, hints: tuple[bool, bool, bool, bool] = (True,) * 4, fdr: float = FDR) -> tuple[list, list]:
    """The pattern spans, and all spans, as (start, number of the kind, end); laws: of ``null_laws``."""
    base = pattern_spans(text, hints)
    return base, sorted(base + random_spans(text, base, fdr, laws)) if hints[3] else base


KINDS = [kind for kind, *_ in PATTERNS] + ["random"]


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[n]}:{start}:{end}" for start, n, end in spans)


def scan_secrets(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """Of each document: doc_id, and the spans as arrays of (kind, start, end): ``base`` and ``spans``."""
    laws = null_laws()

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        as_rows = lambda spans: [{"kind": KINDS[n], "start": a, "end": b} for a, n, b in spans]
        for batch in batches:
            text = pc.fill_null(batch.column("text"), "")
            hints = zip(*(pc.match_substring_regex(text, hint).to_pylist() for hint in _HINTS))
            found = [scan_text(t.as_py(), laws, h, fdr) if any(h) else ([], []) for t, h in zip(text, hints)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([as_rows(x) for x, _ in found], kind), pa.array([as_rows(x) for _, x in found], kind)], ["doc_id", "base", "spans"])

    span = "array<struct<kind:string,start:long,end:long>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scanned, f"doc_id long, base {span}, spans {span}")
