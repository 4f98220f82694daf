"""How close two spellings of a name are: component scores, and bounds on them.

A spelling has four forms: its key (letters and digits), the key without doubled
letters, its tokens, and its longest token. Each pair of forms has a score, and
every score has a bound that needs letter counts alone. `Table` holds the forms
of many names as arrays and bounds the score of one name with each of them.

Names that score enough have something in common that an index finds: a longest
token that is like some token of the other, nearly equal loose keys, or, where
one has no token, nearly equal keys. `index_keys` turns "nearly equal" into keys
to join by.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher
from functools import cached_property, lru_cache
from itertools import combinations, groupby
from math import ceil, comb, floor
from typing import NamedTuple

import numpy as np

#: Fixed values of the rule: equal tokens, sure spelling, what contained names score and gain for each token.
TOKEN, SURE, INSIDE, EACH = 0.80, 0.95, 0.86, 0.07
SHORT, LONG = ("st", "ste"), "saint"
#: Letters of two texts whose blocks are searched without difflib.
BRIEF = 40
#: What stands for each digit of a number that a body leaves open.
OPEN = "#"
#: Letters of numbers that are looked up, and of texts whose letters fit in a machine word, at most.
LOOKED, WORD = 9, 60
_WORDS = re.compile("[a-z0-9]+")


class Spelling(NamedTuple):
    key: str
    loose: str
    tokens: tuple[str, ...]
    lead: str


@lru_cache(100_000)
def spelling(name: str) -> Spelling:
    words = _WORDS.findall(name.lower())
    key = "".join(words)
    tokens = tuple(w for w in words if len(w) > 1)
    return Spelling(key, "".join(c for c, _ in groupby(key)), tokens, max(tokens, key=len, default=""))


def _matched(a: str, b: str) -> int:
    """Letters in matching blocks: the longest block, first in a, then in b, and those to its left and right."""
    for n in range(min(len(a), len(b)), 0, -1):
        for i in range(len(a) - n + 1):
            j = b.find(a[i : i + n])
            if j >= 0:
                return n + _matched(a[:i], b[:j]) + _matched(a[i + n :], b[j + n :])
    return 0


def ratio(a: str, b: str) -> float:
    """Matching blocks over lengths; the order of arguments matters."""
    if a == b:
        return 1.0
    # Short texts are sooner searched than set up for difflib.
    return 2.0 * _matched(a, b) / (len(a) + len(b)) if len(a) + len(b) <= BRIEF else SequenceMatcher(None, a, b).ratio()


def in_order(a: str, b: str) -> int:
    """Length of the longest common subsequence, which matching blocks never pass; rows of the table are bits of a number."""
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    row, every = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        met = row & places.get(c, 0)
        row = ((row + met) | (row - met)) & every
    return len(a) - row.bit_count()


def reaches(a: str, b: str, least: float) -> bool:
    """Is ratio(a, b) at least that?"""
    return 2 * in_order(a, b) >= (least - 1e-9) * (len(a) + len(b)) and ratio(a, b) >= least


_known_ratio = lru_cache(200_000)(ratio)


def token_ratio(a: str, b: str) -> float:
    """The ratio of two tokens, which come again with every name that has them."""
    return 0.0 if set(a).isdisjoint(b) else _known_ratio(a, b)


def same_token(x: str, y: str) -> bool:
    """Does token x count as y?"""
    return token_ratio(x, y) >= TOKEN or x in SHORT and y.startswith(LONG) or y in SHORT and x.startswith(LONG)


class Likeness:
    """The component scores of two spellings, each computed when it is asked for."""

    def __init__(self, a: Spelling, b: Spelling) -> None:
        self.a, self.b = a, b

    @cached_property
    def whole(self) -> float:
        return ratio(self.a.key, self.b.key)

    @cached_property
    def loose(self) -> float:
        return ratio(self.a.loose, self.b.loose)

    @cached_property
    def lead(self) -> float:
        return ratio(self.a.lead, self.b.lead)

    @cached_property
    def spread(self) -> float:
        """The mean of every token's best score, from both sides."""
        best = lambda p, q: sum(max(token_ratio(x, y) for y in q) for x in p) / len(p)
        return (best(self.a.tokens, self.b.tokens) + best(self.b.tokens, self.a.tokens)) / 2

    @cached_property
    def inside(self) -> float:
        """The score of all tokens of the name with fewer being in the other, or 0."""
        few, many = sorted((self.a.tokens, self.b.tokens), key=len)
        met = bool(few) and all(any(same_token(x, y) for y in many) for x in few)
        return min(1.0, INSIDE + EACH * len(few)) if met else 0.0


def similarity(left: str, right: str, least: float = 0.0) -> float:
    """How close two names are, 0 to 1; 1 for equal letters and digits. A score under least may come out lower still."""
    a, b = spelling(left), spelling(right)
    if not (a.key and b.key):
        return 0.0
    if a.key == b.key:
        return 1.0
    parts = Likeness(a, b)
    most = lambda x, y: 2 * in_order(x, y) / (len(x) + len(y)) if least else 1.0
    if most(a.loose, b.loose) >= SURE and parts.loose >= SURE:
        return parts.loose
    if not (a.tokens and b.tokens):
        return parts.whole
    if parts.lead < TOKEN:
        return max(parts.lead / 2, parts.inside)
    counts = [parts.spread, parts.inside]
    if most(a.key, b.key) >= least:
        counts.append(parts.whole)
    if most(a.loose, b.loose) >= least:
        counts.append(parts.loose)
    return max(counts)


def _letters(texts: list[str]) -> np.ndarray:
    """How often each of the 36 letters and digits (rows) is in each text (columns)."""
    out = np.zeros((36, len(texts)), dtype=np.int16)
    for k, text in enumerate(texts):
        for c in text.replace(OPEN, ""):
            out[int(c, 36), k] += 1
    return out


def _shared(text: str, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What ratio is at most: letters in common, in any order, over lengths."""
    common = np.zeros(len(sizes), dtype=np.int16)
    for c in set(text):
        common += np.minimum(others[int(c, 36)], text.count(c))
    return 2 * common / np.maximum(len(text) + sizes, 1)


def _codes(texts: list[str]) -> np.ndarray:
    """Letters as numbers, a line for each place; 36 past the end of a text."""
    out = np.full((max(map(len, texts), default=0), len(texts)), 36, dtype=np.int8)
    for k, text in enumerate(texts):
        out[: len(text), k] = [int(c, 36) for c in text.replace(OPEN, "")] + [36] * text.count(OPEN)
    return out


def _in_order_all(text: str, codes: np.ndarray) -> np.ndarray:
    """in_order of a text of WORD letters at most with each of the texts that the codes stand for."""
    places, every = np.zeros(37, dtype=np.int64), (1 << len(text)) - 1
    for k, c in enumerate(text):
        places[int(c, 36)] |= 1 << k
    row = np.full(codes.shape[1], every, dtype=np.int64)
    for line in codes:
        met = row & places[line]
        row = ((row + met) | (row - met)) & every
    return len(text) - np.bitwise_count(row).astype(np.int64)


class Table:
    """Spellings of many names as arrays, with a bound on what each can score with another name."""

    def __init__(self, names: list[str]) -> None:
        forms = [spelling(n) for n in names]
        texts = [f.key for f in forms], [f.loose for f in forms]
        self.keys, self.orders = [_letters(t) for t in texts], [_codes(t) for t in texts]
        self.sizes = [k.sum(axis=0) for k in self.keys]
        self._take([f.tokens for f in forms])

    def _take(self, tokens: list[tuple[str, ...]]) -> None:
        self.words = sorted({t for row in tokens for t in row})
        at = {t: k for k, t in enumerate(self.words)}
        self.n = np.array([len(row) for row in tokens], dtype=np.int64)
        # a line for each place of a token; past a row's tokens, the place after the last word
        self.at = np.full((max(1, max(self.n, default=0)), len(tokens)), len(self.words))
        for k, row in enumerate(tokens):
            self.at[: len(row), k] = [at[t] for t in row]
        self.lead = np.array([at[max(row, key=len)] if row else len(self.words) for row in tokens], dtype=np.int64)
        self.real = self.at < len(self.words)
        self.order = _codes(self.words)
        self.lengths = np.array([len(w) for w in self.words], dtype=np.int64)
        self.saints = np.array([w.startswith(LONG) for w in self.words], dtype=bool)
        self.short = np.array([w in SHORT for w in self.words], dtype=bool)
        self.known: dict[str, np.ndarray] = {}
        self.index: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @cached_property
    def numbers(self) -> tuple[np.ndarray, np.ndarray]:
        """The rows by number, and the words that are their numbers."""
        place, row = np.nonzero(self.real)
        word = self.at[place, row]
        number = np.array([w.isdigit() for w in self.words], dtype=bool)[word]
        order = word[number].argsort(kind="stable")
        return row[number][order], word[number][order]

    def _indexed(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the index keys that numbers have for texts of a size, in order, with the words; numbers of many letters have none."""
        if size not in self.index:
            words = [int(w) for w in np.unique(self.numbers[1]) if self.lengths[w] <= LOOKED]
            keys = [[hash(c) for c in index_keys(self.words[w], TOKEN, False, (size,))] for w in words]
            hashes = np.array([h for k in keys for h in k], dtype=np.int64)
            order = hashes.argsort(kind="stable")
            self.index[size] = hashes[order], np.repeat(np.array(words, dtype=np.int64), [len(k) for k in keys])[order]
        return self.index[size]

    def near_numbers(self, name: str) -> np.ndarray:
        """Rows that have a number which may be like some token of the name: all such rows, and few others."""
        rows, words = self.numbers
        met = [np.unique(words[self.lengths[words] > LOOKED])]
        for t in spelling(name).tokens:
            if any(map(str.isdigit, t)):
                hashes, places = self._indexed(len(t))
                own = np.array([hash(c) for c in set(index_keys(t, TOKEN, True, self.sorts))], dtype=np.int64)
                spans = zip(hashes.searchsorted(own, "left").tolist(), hashes.searchsorted(own, "right").tolist())
                met += [places[i:j] for i, j in spans if i < j]
        found = np.unique(np.concatenate(met))
        spans = zip(words.searchsorted(found, "left").tolist(), words.searchsorted(found, "right").tolist())
        return np.unique(np.concatenate([rows[i:j] for i, j in spans] or [rows[:0]]))

    @cached_property
    def sorts(self) -> list[int]:
        """Lengths of the numbers."""
        return sorted({int(n) for n in self.lengths[self.numbers[1]] if n <= LOOKED}) or [0]

    def _token(self, t: str) -> np.ndarray:
        """Bound of each word's likeness to t; 0 behind the last word."""
        if t not in self.known:
            if len(self.known) >= 256:
                self.known.clear()
            u = self._like(t)
            u[self.saints & (t in SHORT) | self.short & t.startswith(LONG)] = 1
            self.known[t] = np.append(u, 0.0)
        return self.known[t]

    def _like(self, t: str) -> np.ndarray:
        met = _in_order_all(t, self.order) if len(t) <= WORD else np.minimum(self.lengths, len(t))
        return 2 * met / np.maximum(self.lengths + len(t), 1)

    def _whole(self, own: Spelling, least: float) -> list[np.ndarray]:
        """Bounds of the likeness of keys and of loose keys: by letters in any order, and in order where these reach the least that counts."""
        out = []
        for text, letters, sizes, codes in zip((own.key, own.loose), self.keys, self.sizes, self.orders):
            most = _shared(text, letters, sizes)
            close = np.flatnonzero(most >= least - 1e-9)
            if len(close) and len(text) <= WORD:
                most[close] = 2 * _in_order_all(text, codes[:, close]) / (len(text) + sizes[close])
            out.append(most)
        return out

    def bounds(self, name: str, least: float = TOKEN, apart: bool = False) -> np.ndarray:
        """For each row, a number that its similarity with name does not pass, if that is TOKEN or more, close only from least on; apart: of rows without a number that is like a token of the name."""
        own = spelling(name)
        key, loose = self._whole(own, least)
        most = np.maximum(key, loose)
        if own.tokens:
            words = [self._token(t) for t in own.tokens]
            lead = self._token(own.lead)
            if apart:
                held = np.append(np.array([w[0] == OPEN for w in self.words], dtype=bool), False)
                words = [np.where(held, np.minimum(w, TOKEN - 1e-7), w) for w in words]
                lead = np.where(held, np.minimum(lead, TOKEN - 1e-7), lead)
            each = [w[self.at] for w in words]
            mine, theirs = [e.max(axis=0) for e in each], np.maximum.reduce(each)
            mean = (sum(mine) / len(each) + theirs.sum(axis=0) / np.maximum(self.n, 1)) / 2
            few, bound = len(each), TOKEN - 1e-9
            inside = (few <= self.n) & (np.minimum.reduce(mine) >= bound) | (self.n <= few) & ((theirs >= bound) | ~self.real).all(axis=0)
            contained = np.where(inside, np.minimum(1.0, INSIDE + EACH * np.minimum(few, self.n)), 0.0)
            # Only where the longest tokens are alike does the rest count, but for sure spellings.
            rest = np.where(lead[self.lead] >= bound, np.maximum(most, mean), np.where(loose >= SURE - 1e-9, loose, 0.0))
            most = np.where(self.n > 0, np.maximum(rest, contained), most)
        return most + 1e-9


class Bodies(Table):
    """Bodies of names, whose numbers are left open but for their lengths, with a bound on what any row of a body can score with a name.

    A number that is left open may have any digits that the name has. The other
    words have no digits, so names that differ in digits alone, with keys and
    loose keys of one length, have the same bounds.
    """

    def __init__(self, bodies: list[str]) -> None:
        words = [b.split() for b in bodies]
        told = [[w for w in row if w[0] != OPEN] for row in words]
        self.open = np.array([b.count(OPEN) for b in bodies], dtype=np.int64)
        texts = ["".join(row) for row in told], ["".join("".join(c for c, _ in groupby(w)) for w in row) for row in told]
        self.keys, self.orders = [_letters(t) for t in texts], [_codes(t) for t in texts]
        # A loose key also loses a letter where one word ends as the next begins.
        lost = [sum(x[-1] == y[0] for x, y in zip(row, row[1:])) for row in words]
        self.sizes = [self.keys[0].sum(axis=0), self.keys[1].sum(axis=0) - np.array(lost, dtype=np.int64)]
        self._take([tuple(w for w in row if len(w) > 1) for row in words])

    def _like(self, t: str) -> np.ndarray:
        digits = sum(map(str.isdigit, t))
        left = np.array([2 * min(len(w), digits) / (len(w) + len(t)) if w[0] == OPEN else 0.0 for w in self.words])
        return np.maximum(super()._like(t) if len(t) <= WORD else 1.0, left)

    def _whole(self, own: Spelling, least: float) -> list[np.ndarray]:
        out = []
        for text, letters, sizes, codes, whole in zip((own.key, own.loose), self.keys, self.sizes, self.orders, (True, False)):
            if len(text) <= WORD:
                common = _in_order_all(text, codes)
            else:
                common = sum((np.minimum(letters[int(c, 36)], text.count(c)).astype(np.int64) for c in set(text)), np.zeros(len(sizes), dtype=np.int64))
            # More matched digits of an open number bring more than they cost, up to the whole text.
            met = np.minimum(np.minimum(self.open, sum(map(str.isdigit, text))), np.maximum(len(text) - common, 0))
            out.append(2 * np.minimum(common + met, len(text)) / np.maximum(len(text) + sizes + (self.open if whole else met), 1))
        return out


#: Letters and digits in the order in which index keys take them, the rarer ones first, and how many a key has.
RARE, PICKED = "9876543210qzxjkvwybpgfmucdlhrnsitoae", 4
#: Texts that are short of the letters in common in at most so many ways are indexed by what then is left.
WAYS = 128


def index_keys(text: str, least: float, left: bool, lengths: range | None = None) -> list[str]:
    """Keys of which two texts share one if their ratio is at least ``least``; one text is left, the other not.

    A ratio of r needs r * (n + m) / 2 letters in common, in any order. The
    first of these, in a fixed order of letters, stand near the front of both
    texts' sorted letters, so only choices of PICKED from these fronts are keys,
    for every length that the other text may have.

    Matching blocks stand in the same order in both texts, so the letters in
    common are also left when the others are struck out. Where there are few ways
    to do that, what is left are the keys: numbers, which have few letters but
    many orders, then meet only their neighbours.
    """
    seen: dict[str, int] = {}
    letters = []
    for c in sorted(text, key=RARE.index):
        seen[c] = seen.get(c, 0) + 1
        letters.append(f"{c}{seen[c]}" if seen[c] > 1 else c)
    n = len(letters)
    keys = []
    # min(n, m) letters in common at most
    for m in lengths or range(ceil(n * least / (2 - least) - 1e-9), floor(n * (2 - least) / least + 1e-9) + 1):
        common = ceil(least * (n + m) / 2 - 1e-9)
        if 0 < common <= min(n, m) and max(comb(n, common), comb(m, common)) <= WAYS:
            keys += {(f"{n}.{m}=" if left else f"{m}.{n}=") + "".join(c) for c in combinations(text, common)}
        elif 0 < common <= min(n, m):
            k = min(PICKED, common)
            pair = f"{n}.{m}." if left else f"{m}.{n}."
            keys += [pair + "".join(c) for c in combinations(letters[: n - common + k], k)]
    return keys


def token_keys(token: str, left: bool) -> list[str]:
    """Index keys of a token; short and long forms of saint share one more."""
    return index_keys(token, TOKEN, left) + (["saint"] if token in SHORT or token.startswith(LONG) else [])


def alike(t: str, u: str) -> bool:
    """Do two tokens count as the same, from either side?"""
    return reaches(t, u, TOKEN) or reaches(u, t, TOKEN) or t in SHORT and u.startswith(LONG) or u in SHORT and t.startswith(LONG)
