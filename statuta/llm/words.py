"""Splitting of texts that several operators share, with the byte-level BPE file's own rules.

A piece is an optional blank with the run of other characters behind it, or white space that no such run
takes along. The pre-tokeniser of the vocabulary never joins characters of two pieces, so a result found for
a piece holds wherever the piece occurs and can be kept.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# white space as the tokeniser's pattern engine sees it (Unicode White_Space); Python's \s has four more
BLANK = "\t-\r \x85\xa0  -     　"
PIECE = re.compile(f" ?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")
#: Bytes of a store, and what an entry takes beside the letters of its key: the objects and their slot.
ROOM = 128 << 20
ENTRY = 200
KEEP_CHARS = 48
#: Bytes of text whose distinct words are looked up together.
SLICE = 6 << 20


# the pattern of the byte-level vocabulary's pre-tokeniser: a fixed value
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Memo(dict):
    """Results by piece, computed when first met; long pieces are not kept.

    The store is bounded by bytes. When half of them are used, what is kept becomes the older half, which is
    looked up once more before it goes; so pieces that come often stay.
    """

    def __init__(self, compute: Callable, room: int = ROOM, chars: int = KEEP_CHARS, entry: int = ENTRY):
        super().__init__()
        self.compute, self.half, self.chars, self.entry = compute, room // 2, chars, entry
        self.older: dict = {}
        self.used = 0

    def __missing__(self, piece):
        found = self.older.get(piece)
        if found is None:
            found = self.compute(piece)
        if len(piece) <= self.chars:
            self.used += self.entry + len(piece)
            if self.used > self.half:
                self.older, self.used = dict(self), 0
                self.clear()
            self[piece] = found
        return found

    def free(self) -> None:
        """Gives the memory back, as a worker outlives its tasks."""
        self.clear()
        self.older, self.used = {}, 0


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable bytes for themselves, the
    others for the code points from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.lru_cache(maxsize=4)
def special_pattern(specials: tuple[str, ...]) -> re.Pattern | None:
    if not specials:
        return None
    return re.compile("|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True)))


def slices(texts: pa.Array, room: int = SLICE):
    """A batch of texts in parts of about `room` bytes, one text at least, so that a part's words stay few."""
    ends, lo = np.cumsum(pc.binary_length(texts).to_numpy()), 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + room, "right")))
        yield texts.slice(lo, hi - lo)
        lo = hi


def given_back(batches: Callable) -> Callable:
    """For a function over batches: Arrow gives its free memory back when the task ends, as the worker lives on."""

    @functools.wraps(batches)
    def run(found):
        try:
            yield from batches(found)
        finally:
            pa.default_memory_pool().release_unused()

    return run


def distinct_words(texts: pa.Array, blank: str | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(words, index, places): the distinct words of a batch of texts, the words of all texts one after another
    as numbers of these, and where each text's begin (one place more than texts).

    Words are parted by white space, or by `blank` alone; where that stands at an end or twice, there are
    empty words.
    """
    listed = pc.utf8_split_whitespace(texts) if blank is None else pc.split_pattern(texts, blank)
    places, words = np.asarray(listed.offsets), listed.flatten().dictionary_encode()
    return words.dictionary.to_pylist(), words.indices.to_numpy(), places - places[0]


def stretches(places: np.ndarray, room: int):
    """(lo, hi) of runs of texts of about `room` words, one text at least."""
    lo, n = 0, len(places) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(places, places[lo] + room, "right")) - 1)
        yield lo, hi
        lo = hi


def gathered(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of the items of several lists in the flat array that holds them: list i has `size[i]` from `begin[i]` on."""
    ends = np.cumsum(size)
    return np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
