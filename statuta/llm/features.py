"""Features of words for a classifier of texts: one word at a time, or those a model has in many words at once."""

from __future__ import annotations

import re
from itertools import chain

import numpy as np

from statuta.llm.words import Memo, stretches

SHAPE = 12
#: Bytes of a task's store of words beyond Latin letters.
ROOM = 64 << 20
#: Characters that are looked at together, one word at least.
TOGETHER = 1 << 18
#: Code points from here on (the end of the Latin blocks) are read one word at a time.
LATIN = 0x250


def _shape(c: str) -> str:
    return "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c


_SHAPES = {i: _shape(chr(i)) for i in range(LATIN)}
_AGAIN = re.compile(r"(.)\1+")
_LETTERS = re.compile(r"[^\W\d_]+")
#: Letters of scripts that put no blanks between words: Thai to Tibetan, Burmese, Khmer, kana and Han.
_UNSPACED = re.compile("[฀-࿿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff]")


def word_features(word: str) -> list[str]:
    """Of each run of letters, in lower case: the whole, its beginnings, and its grams, which also tell words inside a
    text without blanks; and the word's shape (letters as A or a, digits as 9, runs once), in parts."""
    found = []
    for letters in _LETTERS.findall(word):
        low = letters.lower()
        found.append("w " + low)
        found += ["p " + low[:n] for n in range(4, min(8, len(low) + 1))]
        if _UNSPACED.search(low):
            grams = [low[i : i + (2 if _UNSPACED.match(c) else 4)] for i, c in enumerate(low)]
            found += ["g " + g for g in grams if len(g) == (2 if _UNSPACED.match(g) else 4)]
        else:
            found += ["g " + low[i : i + 4] for i in range(len(low) - 3)]
    shape = word.translate(_SHAPES) if max(word, default="") < chr(LATIN) else "".join(map(_shape, word))
    shape = _AGAIN.sub(r"\1", shape)
    found += ["s " + shape[i : i + SHAPE] for i in range(0, len(shape), SHAPE)]
    return found


_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.array([ord(c) if len(c) == 1 else 0 for c in map(str.lower, map(chr, range(LATIN)))], np.uint64)
_LETTER = np.array([_LETTERS.match(chr(i)) is not None for i in range(LATIN)])
_SHAPED = np.array([ord(_SHAPES[i]) for i in range(LATIN)], np.uint64)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, _BASE))


def _hash(s: str) -> np.uint64:
    """The polynomial in 64 bits over a string's code points, from which its beginnings' values follow by sums."""
    return (np.array([*map(ord, s)], np.uint64) * _powers(len(s))).sum()


class _Table:
    """Feature numbers by hash, behind a sieve of the hash's upper bits."""

    def __init__(self, features: dict[str, int]):
        told = sorted((int(_hash(s)), i) for s, i in features.items())
        self.keys, self.numbers = np.array([h for h, _ in told], np.uint64), np.array([i for _, i in told], np.int64)
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[self.keys >> np.uint64(48)] = True

    def find(self, hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        maybe = np.flatnonzero(self.sieve[hashes >> np.uint64(48)])
        hashes = hashes[maybe]
        at = np.searchsorted(self.keys, hashes)
        hit = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == hashes) if len(self.keys) else at
        return owner[maybe[hit]], self.numbers[at[hit]]


class Finder:
    """The features of `word_features` that a model has, for lists of words.

    Words of Latin letters and signs are read together, as arrays of code points: a feature is found by a
    64-bit hash. All others go through `word_features`, with a store bounded by bytes.
    """

    def __init__(self, features: dict[str, int]):
        self.by_kind = {k: _Table({f[2:]: i for f, i in features.items() if f[:2] == k + " "}) for k in "wpgs"}
        self.others = Memo(lambda w: [features[f] for f in word_features(w) if f in features], ROOM, entry=300)

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(size, flat): how many features each word has, and their numbers, word after word."""
        places = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
        sizes, flats = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in stretches(places, TOGETHER):
            owner, number = self._some(words[lo:hi], np.diff(places[lo : hi + 1]))
            sizes.append(np.bincount(owner, minlength=hi - lo))
            flats.append(number[np.argsort(owner, kind="stable")])
        return np.concatenate(sizes), np.concatenate(flats)

    def _some(self, words: list[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        owner = np.repeat(np.arange(len(words)), size)
        other = (codes >= LATIN) | (codes == 0x130)  # the one Latin letter whose lower case is two characters
        found = []
        if other.any():
            apart = np.zeros(len(words), bool)
            apart[owner[other]] = True
            for w in np.flatnonzero(apart):
                numbers = self.others[words[w]]
                found.append((np.full(len(numbers), w), np.array(numbers, np.int64)))
            rest = ~apart[owner]
            codes, owner = codes[rest], owner[rest]
        if len(codes):
            found += self._letters(codes, owner)
            found.append(self._shapes(codes, owner))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _letters(self, codes: np.ndarray, owner: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        letter, low, n = _LETTER[codes], _LOWER[codes], len(codes)
        first = letter.copy()
        first[1:] &= ~(letter[:-1] & (owner[1:] == owner[:-1]))
        begin = np.flatnonzero(first)
        if not len(begin):
            return []
        at = np.arange(n)
        place = at - np.maximum.accumulate(np.where(first, at, 0))  # in its run, for letters
        size = np.bincount(np.cumsum(first)[letter] - 1, minlength=len(begin))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(np.where(letter, _powers(int(size.max()))[np.where(letter, place, 0)] * low, np.uint64(0)), out=sums[1:])
        whole = owner[begin]
        found = [self.by_kind["w"].find(sums[begin + size] - sums[begin], whole)]
        for k in range(4, 8):
            long = size >= k
            b = begin[long]
            found.append(self.by_kind["p"].find(sums[b + k] - sums[b], whole[long]))
        grams = np.flatnonzero(letter & (place >= 3)) - 3
        if len(grams):
            hashes = sum(low[grams + i] * p for i, p in enumerate(_powers(4)))
            found.append(self.by_kind["g"].find(hashes, owner[grams]))
        return found

    def _shapes(self, codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shape = _SHAPED[codes]
        new = np.ones(len(codes), bool)
        new[1:] = owner[1:] != owner[:-1]
        kept = new.copy()
        kept[1:] |= shape[1:] != shape[:-1]
        shape, owner, new = shape[kept], owner[kept], new[kept]
        at = np.arange(len(shape))
        place = (at - np.maximum.accumulate(np.where(new, at, 0))) % SHAPE
        begin = np.flatnonzero(place == 0)
        return self.by_kind["s"].find(np.add.reduceat(shape * _powers(SHAPE)[place], begin), owner[begin])
