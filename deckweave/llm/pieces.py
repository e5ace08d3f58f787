"""Texts cut into the pieces that byte-level BPE encodes one by one, and ids kept by piece."""

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

#: Fixed value: the pattern of the byte-level vocabularies, in the syntax of the regex package.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: No match of the pattern looks at more than so many characters after the place where it ends.
LOOK_AHEAD = 3
#: Entries of each of the two generations of a worker's store; results do not depend on it.
STORE_ENTRIES = 500_000

_any = regex.compile(PATTERN)
# The same matches by the faster standard module, for texts of the characters below only.
_latin = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
# Characters that the two modules class alike: below U+0250 without four separators and six numerals.
_other = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]")


def split(text: str) -> list[str]:
    """The matches of the pattern, which together are the whole text."""
    return (_any if _other.search(text) else _latin).findall(text)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Of every code point: 0 white space, 1 a letter, 2 a number, 3 anything else, as the regex package has it."""
    every, kinds = "".join(map(chr, range(0x110000))), np.full(0x110000, 3, np.uint8)
    for kind, members in enumerate((r"\s+", r"\p{L}+", r"\p{N}+")):
        for found in regex.finditer(members, every):
            kinds[found.start() : found.end()] = kind
    return kinds


def split_all(texts: list[str]) -> tuple[pa.LargeStringArray, np.ndarray]:
    """The matches of the pattern in all texts, one after the other, and how many there are up to the end of each.

    The same as ``split``, but without a Python object per match: a match begins where the kind of
    character changes, save for the blank before a word, the last of several white spaces, and contractions.
    """
    whole, ends = "".join(texts), np.cumsum([len(text) for text in texts], dtype=np.int64)
    size = len(whole)
    points = np.frombuffer((whole + "\0\0").encode("utf-32-le"), "<u4")
    kinds = _kinds()[points[:size]]
    first = np.zeros(size + 2, bool)  # of a text, or past the last one
    first[0] = first[size:] = True
    first[ends] = True
    begins = first[: size + 1].copy()
    begins[1:size] |= kinds[1:] != kinds[:-1]
    last = np.flatnonzero((kinds[:-1] == 0) & (kinds[1:] != 0) & ~first[1:size])
    begins[last] = True
    begins[last[points[last] == ord(" ")] + 1] = False
    quotes = np.flatnonzero(points[:size] == ord("'"))
    quotes = quotes[begins[quotes] & ~first[quotes + 1]]
    one, two = points[quotes + 1], points[quotes + 2]
    short = quotes[np.isin(one, [ord(c) for c in "stmd"])]
    pairs = (np.isin(one, [ord("r"), ord("v")]) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    long = quotes[pairs & ~first[quotes + 2]]
    begins[short + 1] = begins[long + 1] = False
    begins[short + 2] = begins[long + 3] = True
    cuts = np.flatnonzero(begins)
    counts, content = np.searchsorted(cuts, ends), whole.encode()
    if len(content) > size:
        points = points[:size]
        before = np.zeros(size + 1, np.int64)  # bytes
        np.cumsum(1 + (points >= 0x80).view(np.int8) + (points >= 0x800) + (points >= 0x10000), out=before[1:])
        cuts = before[cuts]
    return pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(content)), counts


class Store(dict):
    """Values computed once per key in a worker, bounded in entries.

    A full store becomes the older generation and a new one begins; keys that are asked for again
    move over, so frequent ones stay.
    """

    def __init__(self, make: Callable, entries: int = STORE_ENTRIES):
        super().__init__()
        self._make, self._older, self._entries = make, {}, entries

    def __missing__(self, key):
        value = self._older.get(key)
        if value is None:
            value = self._make(key)
        if len(key) <= 64:
            if len(self) >= self._entries:
                self._older = dict(self)
                self.clear()
            self[key] = value
        return value

    def empty(self) -> None:
        self._older = {}
        self.clear()
