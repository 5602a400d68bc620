"""Toxicity by a support vector machine over a gap-weighted subsequence kernel, trained on labelled sentences.

A text is cut at ends of sentences into runs of at most ``WORDS`` words, called sentences here, and these into units:
their lower-cased words without signs.  What white space divides is joined again: runs of single characters, and two neighbouring fragments of
at most ``FRAGMENT`` characters, and three of at most two.  When texts are scored, a unit of ``HALVED`` characters or more
also stands for its two halves of every second character, with the square of their kernels: a word with any characters put in at every
place is whole in one of them.

The kernel of two units sums over all subsequences of three characters that they share, each weighted
by ``DECAY`` to the length it spans in either, and is normalised; characters put in between or left out
lower it a little only.  Nystrom features come from landmarks: a sentence's kernel with a landmark is that of its
nearest unit, to the power ``POWER``; the kernels times the inverse root of the landmarks' own kernel matrix are
its features.  A linear machine with squared hinge loss scores sentences; a text has the score of its
highest sentence, and a logistic law fitted to texts turns it into a probability.

Training takes a bounded sample of labelled rows (``per_class`` of each class, chosen by a hash of the
id).  Labels hold for texts, so which sentences bear a toxic text's label is learned with the machine, in alternation: at
first all do, then those with a unit that covers toxic texts (below), those that the machine finds toxic, and at least
the one that scores highest.  All sentences of
clean texts are clean.  The toxic sentences are repeated with a character put into their nearest unit, two put in,
or one left out.  Landmarks are the units that cover most
toxic texts not yet covered, less three times the clean texts that have them, and the clean units that come nearest.

The power lets the large kernels decide.  One under ``FLOOR`` counts as 0; its power is less than 0.008, where 1 is equality.
Units are passed over only where the least norm that they can have shows that
all their kernels are under it, so no kernel that counts is ever left out.  Units of more than ``WIDTH``
characters are cut in overlapping windows, all of which count.

Defined cases: empty and null texts score as texts without units; without labels of both classes all score
0; null labels and ids are not learned from, of several labels of an id the highest holds; repeated rows
have equal scores.
"""

from __future__ import annotations

import functools
import heapq
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, held_out

ORDER, DECAY, POWER, WIDTH, FLOOR, LANDMARKS, MEMO = 3, 0.8, 3, 32, 0.2, 64, 600_000
WORDS, FRAGMENT, HALVED = 12, 3, 9
_SIGNS = re.compile(r"[\W_]+")
_AT_ONCE = 20_000  # words
_TEXTS, _CHARS = 1000, 1_000_000  # at once, but one text at least
_SUMS = 1 << 17
_PATTERNS = 200_000  # whose norms are remembered


class Cut(NamedTuple):
    """Texts cut in sentences: distinct raw units, the number of the unit at each place, where each sentence begins, and the number of its text."""

    units: list[str]
    places: np.ndarray
    starts: np.ndarray
    text: np.ndarray


def numbering() -> defaultdict[str, int]:
    """Gives each new name the next number."""
    number: defaultdict[str, int] = defaultdict()
    number.default_factory = number.__len__
    return number


def cut(texts: list[str]) -> Cut:
    """The sentences of texts; those of units joined across white space stand behind all others."""
    words = [text.lower().split() for text in texts]
    text = np.repeat(np.arange(len(texts)), [len(w) for w in words])
    coded = pa.array(list(chain.from_iterable(words)), pa.large_string()).dictionary_encode()
    del words
    units, places = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64)
    size = np.array([len(u) for u in units], np.int64)[places]
    total = len(places)
    until = np.searchsorted(text, text, side="right")
    # From each place on: back to the end of a sentence, if there is one in the second half.
    at = np.arange(total)
    stop = np.maximum.accumulate(np.where(np.array([u[-1] in ".!?" for u in units], bool)[places], at + 1, 0))
    end = np.minimum(at + WORDS, until)
    back = stop[end - 1]
    after, starts, place = np.where((end < until) & (back > at + WORDS // 2), back, end).tolist(), [], 0
    while place < total:
        starts.append(place)
        place = after[place]
    run, begin, names = joined(units, places, size, text)
    number = numbering()
    behind = np.fromiter(map(number.__getitem__, names), np.int64, len(names)) + len(units)
    rank = np.arange(len(run)) - np.searchsorted(run, run)
    more = np.flatnonzero(rank % WORDS == 0)
    owner = np.concatenate([text[np.array(starts, np.int64)], text[begin[more]]])
    return Cut(units + list(number), np.concatenate([places, behind]), np.concatenate([np.array(starts, np.int64), total + more]), owner)


def joined(units: list[str], places: np.ndarray, size: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """What is joined across white space: the run of fragments it lies in, where it begins, and itself; by runs, pairs first, triples last."""
    short = np.flatnonzero(size <= FRAGMENT)
    size, parts = size[short], [units[n] for n in places[short].tolist()]
    follows = np.zeros(len(short), bool)
    follows[1:] = (np.diff(short) == 1) & (np.diff(text[short]) == 0)
    run = np.cumsum(~follows)
    two = np.flatnonzero(follows) - 1
    small = size < 3
    three = np.flatnonzero(follows[1:-1] & follows[2:] & small[:-2] & small[1:-1] & small[2:])
    lone = np.flatnonzero(size == 1)
    heads = np.flatnonzero(~((np.diff(lone, prepend=-2) == 1) & follows[lone]))
    tails = np.append(heads[1:], len(lone))[: len(heads)]
    long = np.flatnonzero(tails - heads > 2)
    first, beyond = lone[heads[long]], lone[tails[long] - 1] + 1
    names = [parts[i] + parts[i + 1] for i in two.tolist()]
    names += ["".join(parts[a:b]) for a, b in zip(first.tolist(), beyond.tolist())]
    names += [parts[i] + parts[i + 1] + parts[i + 2] for i in three.tolist()]
    begin = np.concatenate([two, first, three])
    kind = np.repeat(np.arange(3), [len(two), len(first), len(three)])
    order = np.lexsort((begin, kind, run[begin]))
    return run[begin[order]], short[begin[order]], [names[i] for i in order.tolist()]


def sentences(text: str) -> list[list[str]]:
    """The raw units of each sentence; those joined across white space stand in lists of their own."""
    found = cut([text])
    flat, starts = [found.units[n] for n in found.places.tolist()], found.starts.tolist()
    return [flat[a:b] for a, b in zip(starts, [*starts[1:], len(flat)])]


def gathered(listed: list[list[list[str]]]) -> Cut:
    """Of texts whose sentences are given as lists of raw units."""
    number, found = numbering(), [s for x in listed for s in x]
    size = np.array([len(s) for s in found], np.int64)
    places = np.fromiter(map(number.__getitem__, chain.from_iterable(found)), np.int64, int(size.sum()))
    return Cut(list(number), places, np.cumsum(size) - size, np.repeat(np.arange(len(listed)), [len(x) for x in listed]))


def windows(unit: str) -> list[str]:
    """A unit without signs, in windows of at most WIDTH characters; none for less than ORDER characters."""
    unit = unit if unit.isalnum() else _SIGNS.sub("", unit)
    if len(unit) < ORDER:
        return []
    return [unit[i : i + WIDTH] for i in range(0, len(unit) - WIDTH // 2, WIDTH // 2)] if len(unit) > WIDTH else [unit]


def halves(whole: list[str]) -> list[str]:
    """The characters at even and at odd places of each window that is long enough."""
    return [w[k::2] for w in whole if len(w) >= HALVED for k in (0, 1)]


def coded(words: list[str]) -> np.ndarray:
    """Code points between a mark of the beginning and one of the end, in rows padded with 0."""
    return np.array([f"\x02{w}\x03" for w in words], dtype=f"U{WIDTH + 2}").view(np.uint32).reshape(len(words), WIDTH + 2)


def subsequence_kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Unnormalised kernel of each row of a with the same row of b (zeros are no characters).

    ``inner[i, j]`` holds the weight of the subsequences of the order so far that the first i and j characters
    share, counted to both ends; each order is one pass over a's characters.  Pairs lie along the last axis.
    """
    n, la, lb = len(a), int((a > 0).sum(1).max(initial=0)), int((b > 0).sum(1).max(initial=0))
    x, y = np.ascontiguousarray(a[:, :la].T), np.ascontiguousarray(b[:, :lb].T)
    match = ((x[:, None, :] == y[None, :, :]) & (x[:, None, :] > 0)).astype(np.float32) * np.float32(DECAY * DECAY)
    inner = np.ones((la + 1, lb + 1, n), np.float32)
    decay = np.float32(DECAY)
    for _ in range(ORDER - 1):
        new = np.zeros_like(inner)
        row = np.zeros((lb + 1, n), np.float32)
        for i in range(la):
            hit = match[i] * inner[i, :lb]
            for j in range(lb):
                np.multiply(row[j], decay, out=row[j + 1])
                row[j + 1] += hit[j]
            np.multiply(new[i], decay, out=new[i + 1])
            new[i + 1] += row
        inner = new
    return (match * inner[:la, :lb]).sum((0, 1)).astype(np.float64)


@functools.cache
def _places(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The triples of places in a word of n characters (a row each), and their weights."""
    i, j, k = np.meshgrid(*[np.arange(n)] * 3, indexing="ij")
    rising = (i < j) & (j < k)
    places = np.stack([i[rising], j[rising], k[rising]])
    return places, (DECAY ** (places[2] - places[0] + 1)).astype(np.float32)


def own_norms(first: np.ndarray) -> np.ndarray:
    """The roots of the kernels of words with themselves; of each character the first place in its word is given, a word a row.

    The weights of equal triples are summed, and the sums squared.
    """
    n = first.shape[1]
    (i, j, k), weights = _places(n)
    out = np.zeros(len(first))
    for at in range(0, len(first), step := max(1, _SUMS // n**3)):
        c = first[at : at + step].T.astype(np.int64)
        key = (c[i] * n + c[j]) * n + c[k] + np.arange(c.shape[1]) * n**3
        sums = np.bincount(key.reshape(-1), np.repeat(weights, c.shape[1]), c.shape[1] * n**3).reshape(-1, n**3)
        out[at : at + step] = np.sqrt((sums * sums).sum(1))
    return out


def spread(begin: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers from each beginning on, as many as it has."""
    return np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())


class Machine:
    """Landmarks, the whitening of their kernel, and the machine's weights.

    The kernels of a word with all landmarks are one sum over the word's triples of characters: each triple
    is a row of a table that holds its weight in each landmark, over the landmark's norm.
    A word's kernel with itself depends on which of its characters are equal only, and is kept by that pattern.
    """

    def __init__(self, landmarks: list[str]):
        self.names = landmarks
        codes = coded(landmarks)
        norms = np.sqrt(subsequence_kernel(codes, codes))
        self.chars = np.unique(codes[codes > 0])
        size, lengths, m = len(self.chars) + 1, (codes > 0).sum(1), len(landmarks)
        numbers = self.numbered(codes)
        self.row_of = np.zeros(size**3, np.int32)
        triples: dict[int, np.ndarray] = {}
        for w in range(m):
            (i, j, k), weights = _places(int(lengths[w]))
            for t, x in zip(((numbers[w, i] * size + numbers[w, j]) * size + numbers[w, k]).tolist(), weights):
                triples.setdefault(t, np.zeros(m))[w] += x / norms[w]
        self.table = np.concatenate([np.zeros((1, m)), np.stack(list(triples.values()))]).astype(np.float32)
        self.row_of[list(triples)] = np.arange(1, len(triples) + 1)
        self.norms: dict[bytes, float] = {}
        gram = self.kernels(landmarks)
        values, vectors = np.linalg.eigh((gram + gram.T) / 2)
        keep = values > 1e-6
        self.whiten = vectors[:, keep] / np.sqrt(values[keep])
        self.weights, self.bias, self.slope, self.shift = np.zeros(m), 0.0, 0.0, -30.0

    def numbered(self, codes: np.ndarray) -> np.ndarray:
        """Numbers of the characters among the landmarks', 0 for others."""
        at = np.minimum(np.searchsorted(self.chars, codes), len(self.chars) - 1)
        return np.where(self.chars[at] == codes, at + 1, 0)

    def kernels(self, words: list[str]) -> np.ndarray:
        """Normalised kernels of words with the landmarks, to the power; those under FLOOR are 0.

        A word's kernel with itself is at least the sum of its triples' squared weights, so it is computed only where that
        least one would not put all kernels under FLOOR.
        """
        out = np.zeros((len(words), len(self.names)), np.float32)
        for at in range(0, len(words), _AT_ONCE):
            self._kernels(words[at : at + _AT_ONCE], out[at : at + _AT_ONCE])
        return out

    def _kernels(self, words: list[str], out: np.ndarray) -> None:
        codes, m = coded(words), len(self.names)
        lengths, numbers, size = (codes > 0).sum(1), self.numbered(codes), len(self.chars) + 1
        for n in np.unique(lengths):
            (i, j, k), weights = _places(int(n))
            least = float(np.sqrt((weights.astype(np.float64) ** 2).sum()))
            first, second = np.triu_indices(n, 1)
            pair = (i * (2 * n - i - 1) >> 1) + j - i - 1  # the number of each triple's first two places
            order = np.argsort(k - i, kind="stable")
            pair, k, weights, length = pair[order], k[order], weights[order], (k - i)[order]
            spans = [(weights[a], list(zip(pair[a:b].tolist(), k[a:b].tolist()))) for a, b in zip(np.searchsorted(length, range(2, n)), np.searchsorted(length, range(3, n + 1)))]
            mine = np.flatnonzero(lengths == n)
            for some in np.array_split(mine, -(-len(mine) // 1024)):
                c = np.ascontiguousarray(numbers[some, :n].T)
                pairs = (c[first] * size + c[second]) * size
                # Plain sums, as a product would start threads in each task; triples of one span have one weight.  Row 0 is of zeros.
                # Both ways add in the same order, so a word has the same kernels among few and among many.
                raw, part, span = np.zeros((3, len(some), m), np.float32)
                if len(some) < 48:
                    for word, rows in enumerate(self.row_of.take(pairs[pair] + c[k]).T):
                        hit = np.flatnonzero(rows)
                        own, begin = self.table.take(rows[hit], axis=0), np.flatnonzero(np.diff(length[hit], prepend=0)).tolist()
                        for a, b in zip(begin, [*begin[1:], len(hit)]):
                            raw[word] += own[a:b].sum(0) * weights[hit[a]]
                else:
                    for weight, members in spans:
                        for number, (before, last) in enumerate(members):
                            self.table.take(self.row_of.take(pairs[before] + c[last]), axis=0, out=part if number else span, mode="clip")
                            if number:
                                span += part
                        span *= weight
                        raw += span
                near = np.flatnonzero(raw.max(1) >= FLOOR * least * (1 - 1e-4))
                value = raw[near] / self.norm(codes[some[near], :n])[:, None]
                word, landmark = np.nonzero(value >= FLOOR)
                out[some[near[word]], landmark] = value[word, landmark] ** POWER

    def norm(self, words: np.ndarray) -> np.ndarray:
        """The roots of the kernels of words of equal length with themselves."""
        first = (words[:, :, None] == words[:, None, :]).argmax(2).astype(np.uint8)
        listed = first.view(f"V{words.shape[1]}")[:, 0].tolist()
        if len(self.norms) > _PATTERNS:
            self.norms.clear()
        new = {pattern: n for n, pattern in enumerate(listed) if pattern not in self.norms}
        self.norms.update(zip(new, own_norms(first[list(new.values())]).tolist()))
        return np.array([self.norms[pattern] for pattern in listed], np.float32)

    def fit(self, x: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> None:
        """x: kernels of sentences with the landmarks."""
        whiten = self.whiten.astype(np.float32)
        x, given = np.ones((len(x), whiten.shape[1] + 1), np.float32), x
        np.matmul(given, whiten, out=x[:, :-1])
        w = np.zeros(x.shape[1])
        w[-1] = -1
        penalty = np.full(len(w), ridge)
        penalty[-1] = 1e-3
        for _ in range(50):
            inside = np.flatnonzero(target * (x @ w.astype(np.float32)) < 1)
            square, right = np.diag(penalty), np.zeros(len(w))
            for some in np.array_split(inside, 1 + len(inside) // _AT_ONCE):
                a = x[some].astype(np.float64)
                square += (a * weight[some, None]).T @ a
                right += a.T @ (weight[some] * target[some])
            new = np.linalg.solve(square, right)
            if np.allclose(new, w, atol=1e-6):
                break
            w = new
        self.weights, self.bias = self.whiten @ w[:-1], float(w[-1])

    def calibrate(self, z: np.ndarray, toxic: np.ndarray) -> None:
        """Platt's logistic law with smoothed targets."""
        up, down = int(toxic.sum()), int((~toxic).sum())
        target = np.where(toxic, (up + 1) / (up + 2), 1 / (down + 2))
        a, b = 1.0, 0.0
        for _ in range(100):
            p = 1 / (1 + np.exp(-(a * z + b)))
            g = np.array([((p - target) * z).sum() + 1e-3 * a, (p - target).sum()])
            v = np.maximum(p * (1 - p), 1e-9)
            h = np.array([[(v * z * z).sum() + 1e-3, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-6]])
            step = np.linalg.solve(h, g)
            step *= min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-8:
                break
        self.slope, self.shift = float(a), float(b)

    def probability(self, z: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -700, 700))))


def enlarged(values: np.ndarray, size: int) -> np.ndarray:
    """Values with room for as many, and more where it had to grow."""
    if size <= len(values):
        return values
    grown = np.zeros(max(size, 2 * len(values)), values.dtype)
    grown[: len(values)] = values
    return grown


class Scorer:
    """Kernels of sentences and scores of texts; remembers units, up to ``most`` of them.  halved: whether halves count."""

    def __init__(self, machine: Machine, most: float = MEMO, halved: bool = True):
        self.machine, self.most, self.halved = machine, most, halved
        self.forget()

    def forget(self) -> None:
        """Of each unit a number, 0 if it has no kernels; those of a number lie from its place on: landmarks and values."""
        self.memo: dict[str, int] = {}
        self.begin, self.used = np.zeros(1024, np.int64), 1
        self.landmark, self.value = np.zeros(4096, np.int16), np.zeros(4096, np.float32)

    def learn(self, new: list[str]) -> None:
        """Units that are equal but for signs share what they have; so do equal halves, while units are learned."""
        plain = [unit if unit.isalnum() else _SIGNS.sub("", unit) for unit in new]
        listed = [unit for unit in dict.fromkeys(plain) if unit not in self.memo]
        for at in range(0, len(listed), _AT_ONCE):
            self.memo.update(zip(listed[at : at + _AT_ONCE], self.numbers(listed[at : at + _AT_ONCE])))
        self.memo.update(zip(new, map(self.memo.__getitem__, plain)))

    def numbers(self, fresh: list[str]) -> list[int]:
        """The numbers of units without signs that are new."""
        size, number = [len(unit) for unit in fresh], numbering()
        whole = [i for i, n in enumerate(size) if ORDER <= n <= WIDTH]
        long = [i for i in whole if size[i] >= HALVED] if self.halved else []
        names = [fresh[i] for i in whole] + [fresh[i][::2] for i in long] + [fresh[i][1::2] for i in long]
        owner, half = whole + long + long, [False] * len(whole) + [True] * 2 * len(long)
        for i in [i for i, n in enumerate(size) if n > WIDTH]:
            parts = windows(fresh[i])
            both = parts + (halves(parts) if self.halved else [])
            names += both
            owner += [i] * len(both)
            half += [False] * len(parts) + [True] * (len(both) - len(parts))
        pieces = np.fromiter(map(number.__getitem__, names), np.int64, len(names))
        kernels = self.machine.kernels(list(number))
        word, landmark = np.nonzero(kernels)
        value = kernels[word, landmark]
        # What each piece has goes to its unit; of equal landmarks the greatest value counts.
        begin = np.searchsorted(word, np.arange(len(number) + 1))
        many = np.diff(begin)[pieces]
        at = spread(begin[pieces], many)
        key = np.repeat(np.array(owner, np.int64), many) * len(self.machine.names) + landmark[at]
        value = np.where(np.repeat(np.array(half, bool), many), value[at] ** 2, value[at])
        order = np.lexsort((value, key))
        key, value = key[order], value[order]
        top = np.flatnonzero(np.diff(key, append=-1))
        unit, landmark = np.divmod(key[top], len(self.machine.names))
        owners, each = np.unique(unit, return_counts=True)
        rows = np.zeros(len(fresh), np.int64)
        rows[owners] = self.used + np.arange(len(owners))
        end, first = self.used + len(owners), int(self.begin[self.used])
        self.begin, self.landmark, self.value = enlarged(self.begin, end + 1), enlarged(self.landmark, first + len(unit)), enlarged(self.value, first + len(unit))
        self.landmark[first : first + len(unit)], self.value[first : first + len(unit)] = landmark, value[top]
        self.begin[self.used + 1 : end + 1] = first + np.cumsum(each)
        self.used = end
        return rows.tolist()

    def near(self, cut: Cut) -> tuple[np.ndarray, np.ndarray]:
        """The kernels of the sentences that have any, and the numbers of these sentences."""
        rows = np.fromiter(map(self.memo.get, cut.units, repeat(-1)), np.int64, len(cut.units))
        missing = np.flatnonzero(rows < 0).tolist()
        if len(self.memo) + len(missing) > self.most:
            self.forget()
            missing = range(len(rows))
        new = [cut.units[i] for i in missing]
        self.learn(new)
        rows[missing] = np.fromiter(map(self.memo.__getitem__, new), np.int64, len(new))
        rows = rows[cut.places]
        active = np.flatnonzero(rows)
        if not len(active):
            return np.zeros((0, len(self.machine.names)), np.float32), np.zeros(0, np.int64)
        sentence = np.repeat(np.arange(len(cut.starts)), np.diff(cut.starts, append=len(cut.places)))[active]
        starts = np.flatnonzero(np.diff(sentence, prepend=-1))
        return self.greatest(rows[active], starts), sentence[starts]

    def greatest(self, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The greatest kernels with each landmark among the rows from each start to the next."""
        out = np.zeros((len(starts), len(self.machine.names)), np.float32)
        many = self.begin[rows + 1] - self.begin[rows]
        at = spread(self.begin[rows], many)
        own = np.repeat(np.arange(len(starts)) * out.shape[1], np.diff(starts, append=len(rows)))
        np.maximum.at(out.reshape(-1), np.repeat(own, many) + self.landmark[at], self.value[at])
        return out

    def scores(self, cut: Cut, texts: int) -> np.ndarray:
        """The score of each text: its highest sentence's, the bias for a text without any kernel."""
        kernels, sentence = self.near(cut)
        best = np.full(texts, self.machine.bias)
        np.maximum.at(best, cut.text[sentence], kernels @ self.machine.weights + self.machine.bias)
        return best

    def margins(self, listed: list[list[list[str]]]) -> np.ndarray:
        """The scores of texts whose sentences are given as lists."""
        return self.scores(gathered(listed), len(listed))


def without_copies(bags: list[set[str]], bands: int = 8) -> list[set[str]]:
    """One bag of each group of near copies: those that share a pair of minimal hashes."""
    seen: set[tuple] = set()
    kept = []
    for bag in bags:
        hashes = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in sorted(bag)] or [0], np.uint64)
        least = [int(((hashes * np.uint64(2 * k + 0x9E3779B1)) & np.uint64(0xFFFFFFFF)).min()) for k in range(2 * bands)]
        keys = {(k, least[2 * k], least[2 * k + 1]) for k in range(bands)}
        if not keys & seen:
            kept.append(bag)
        seen |= keys
    return kept


def witnesses(toxic: list[set[str]], clean: Counter, least: float = 2.0) -> Counter:
    """Units that bear the label, each with what it covered when it was chosen.

    A text counts half as much for each unit chosen that it has, so that a second insult is still found and
    words that merely stand beside insults are not.
    """
    where: dict[str, list[int]] = {}
    for n, bag in enumerate(toxic):
        for w in bag:
            where.setdefault(w, []).append(n)
    counts = [1.0] * len(toxic)
    worth = lambda w: sum(counts[n] for n in where[w]) - 3 * clean[w]
    queue = [(-gain, len(w), w) for w, ns in where.items() if (gain := len(ns) - 3 * clean[w]) >= least]
    heapq.heapify(queue)
    found: Counter = Counter()
    while queue:
        _, size, w = heapq.heappop(queue)
        now = worth(w)
        if now < least:
            continue
        if queue and now < -queue[0][0]:
            heapq.heappush(queue, (-now, size, w))
            continue
        found[w] = now
        for n in where[w]:
            counts[n] /= 2
    return found


def misspelt(word: str) -> list[str]:
    """The word with a character put in (its neighbour or a foreign one), with two put in, and with one left out."""
    n = len(word)
    out = [word[:i] + c + word[i:] for i in range(1, n) for c in (word[i - 1], "xzqk"[(i + n) % 4])]
    out += [word[:i] + "xzqk"[i % 4] + word[i : i + 2] + "xzqk"[n % 4] + word[i + 2 :] for i in range(1, n - 2)]
    out += [word[:i] + word[i + 1 :] for i in range(1, n - 1) if n > 4]
    return [w[:WIDTH] for w in out]


def train(toxic_texts: list[str], clean_texts: list[str], landmarks: int = LANDMARKS, rounds: int = 4) -> Machine | None:
    toxic_texts, clean_texts = sorted(set(toxic_texts)), sorted(set(clean_texts))
    if not toxic_texts or not clean_texts:
        return None
    one: dict[str, str] = {}  # equal units share their memory
    toxic, clean = ([[[one.setdefault(u, u) for u in s] for s in sentences(t)] for t in texts] for texts in (toxic_texts, clean_texts))
    bag = lambda cut: {w for u in set().union(*cut) for w in windows(u)}
    in_clean = Counter(w for cut in clean for w in bag(cut))
    bags = without_copies([bag(cut) for cut in toxic])
    bearing = witnesses(bags, in_clean) or witnesses(bags, in_clean, least=1.0)
    if not bearing:
        return None
    machine = Machine([w for w, _ in sorted(bearing.items(), key=lambda x: (-x[1], x[0]))[:landmarks]])
    fit_sentences(machine, toxic, clean, in_clean, bearing, rounds)
    # Clean words that come closest become landmarks too, and the machine is fitted again.
    words = sorted(in_clean)
    high = np.concatenate([machine.kernels(words[i : i + 20_000]) @ machine.weights for i in range(0, len(words), 20_000)])
    nearest = [words[i] for i in np.argsort(-high, kind="stable")[: landmarks // 2] if high[i] > 0]
    machine = Machine(list(dict.fromkeys([*machine.names, *nearest])))
    scorer = fit_sentences(machine, toxic, clean, in_clean, bearing, rounds)
    z = np.concatenate([scorer.margins(cut[i : i + 100]) for cut in (toxic, clean) for i in range(0, len(cut), 100)])
    machine.calibrate(z, np.arange(len(z)) < len(toxic_texts))
    return machine


def fit_sentences(machine: Machine, toxic: list, clean: list, in_clean: Counter, bearing: Counter, rounds: int) -> Scorer:
    """Fits the machine to sentences; of each toxic text those count that have a bearing unit or are found toxic so far, or the highest."""
    scorer = Scorer(machine, float("inf"), halved=False)  # the sample is bounded

    def near(cut: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
        kernels, owner, units = [], [], []
        for i in range(0, len(cut), 100):
            part = cut[i : i + 100]
            found, kept = scorer.near(given := gathered(part))
            listed = [s for x in part for s in x]
            kernels, owner, units = [*kernels, found], [*owner, i + given.text[kept]], units + [listed[k] for k in kept.tolist()]
        return np.concatenate(kernels), np.concatenate(owner), units

    up, owner, units = near(toxic)
    down, _, _ = near(clean)
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    none = np.zeros((1, len(machine.names)), np.float32)
    marked = np.array([any(w in bearing for u in filter(scorer.memo.__getitem__, s) for w in windows(u)) for s in units], bool)
    nearest: dict[int, str] = {}
    copied: dict[str, np.ndarray] = {}
    for n in range(rounds if len(starts) else 0):
        score = up @ machine.weights + machine.bias
        chosen, times = np.arange(len(up)), Counter()
        share = np.where(marked, 1.0, np.repeat(1 / np.diff(starts, append=len(up)), np.diff(starts, append=len(up))))
        if n:
            highest = [part[np.argmax(score[part])] for part in np.split(chosen, starts[1:])]
            chosen = np.union1d(np.flatnonzero((score > 0) | marked), highest)
            share = np.ones(len(chosen))
            of_unit = scorer.greatest(np.arange(scorer.used), np.arange(scorer.used)) @ machine.weights
            nearest.update((k, max(filter(scorer.memo.__getitem__, units[k]), key=lambda u: of_unit[scorer.memo[u]])) for k in set(chosen.tolist()) - nearest.keys())
            times = Counter(nearest[k] for k in chosen.tolist())
            new = sorted(times.keys() - copied.keys())  # units to misspell, all at once
            listed = [[w for w in misspelt(windows(u)[0]) if w not in in_clean] for u in new]
            made = machine.kernels([w for x in listed for w in x])
            copied.update(zip(new, np.split(made, np.cumsum([len(x) for x in listed])[:-1])))
        copies = [copied[u] for u in times]
        x = np.concatenate([up[chosen], *copies, down, none])
        target = np.r_[np.ones(len(chosen) + sum(map(len, copies))), -np.ones(len(down) + 1)]
        repeated = np.concatenate([np.full(len(c), 5 * k / max(1, len(c))) for c, k in zip(copies, times.values())] or [np.empty(0)])
        weight = np.r_[share / len(starts), repeated / len(starts), np.full(len(down), 2 / len(clean)), 1.0] * 1000
        machine.fit(x, target, weight)
    return scorer


def portions(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch, so many texts as are scored at once, and their texts; null counts as empty."""
    texts = [t.as_py() or "" for t in batch.column("text")]
    begin = size = 0
    for n, text in enumerate(texts):
        if n - begin == _TEXTS or n > begin and size + len(text) > _CHARS:
            yield batch.slice(begin, n - begin), texts[begin:n]
            begin, size = n, 0
        size += len(text)
    if texts:
        yield batch.slice(begin), texts[begin:]


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[list[str], list[str]]:
    """Whole texts of about per_class toxic and clean rows among those that may be learned from."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return [], []
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.filter(draw < F.when(F.col("toxic") == 1, F.lit(min(1.0, per_class / counts[1]))).otherwise(min(1.0, per_class / counts[0])))
    # The ids chosen go to all tasks, after a check of their number, so that no text moves but theirs.
    side = F.broadcast(chosen) if chosen.count() <= 8 * per_class else chosen
    rows = docs.select("doc_id", "text").join(side, "doc_id").select("toxic", "text").collect()
    texts: tuple[list[str], list[str]] = [], []
    for r in rows:
        texts[1 - r["toxic"]].append(r["text"] or "")
    return texts


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = 1500) -> DataFrame:
    """Of each document: doc_id, held_out, score and predicted."""
    machine = docs.sparkSession.sparkContext.broadcast(train(*labelled_sample(docs, labels, per_class)))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(machine.value) if machine.value else None
        for batch in batches:
            for part, texts in portions(batch):
                scores = [machine.value.probability(z) for z in scorer.scores(cut(texts), len(texts)).tolist()] if scorer else [0.0] * len(texts)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])
        scorer = None
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(scored, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are not predicted toxic, with the columns of docs; one pass, no join."""
    threshold, per_class = options.get("threshold", 0.3), options.get("per_class", 1500)
    machine = docs.sparkSession.sparkContext.broadcast(train(*labelled_sample(docs, labels, per_class)))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(machine.value) if machine.value else None
        for batch in batches:
            for part, texts in portions(batch):
                if scorer:
                    part = part.filter(pa.array([machine.value.probability(z) < threshold for z in scorer.scores(cut(texts), len(texts)).tolist()], pa.bool_()))
                yield part
        scorer = None
        give_back()

    return docs.mapInArrow(kept, docs.schema)
