"""Exact token counts; huge texts are encoded in overlapping chunks that are spliced."""

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from deckweave.llm.arrow import map_rows, typed
from deckweave.llm.pieces import Store
from deckweave.llm.vocabularies import tokenizer

#: Texts of more characters are encoded in chunks of so many.
CHUNK_CHARS = 65_536
#: Characters that neighbouring chunks share at first.
OVERLAP_CHARS = 256
#: Characters behind a word's end that decide where it ends, at most: a contraction has three.
LOOK_AHEAD = 3
_GAPS = str.maketrans("\t\n\r", "   ")


class _Chunk:
    """A chunk's encoding: where its words begin in the text, and its tokens before each."""

    def __init__(self, use, text: str, start: int, end: int):
        self.start, self.end = start, end
        found = use.encode(text[start:end], add_special_tokens=False)
        words = np.array([-1 if word is None else word for word in found.word_ids], np.int64)
        offsets = np.array(found.offsets, np.int64).reshape(-1, 2)
        self.tokens = len(words)
        # A word that begins within what one character became begins at no place of the text.
        apart = offsets[1:, 0] >= offsets[:-1, 1]
        self._before = np.flatnonzero(np.r_[True, (words[1:] != words[:-1]) & apart][: self.tokens])
        self.begins = start + offsets[self._before, 0]

    def before(self, place: int) -> int:
        """Tokens before a word that begins at a place."""
        return int(self._before[np.searchsorted(self.begins, place)])


class Counter:
    """Token counts by one ``tokenizers`` file whose words are matches of a pattern, without white space.

    Texts of usual length are taken apart at blanks, tabs and line ends: the tokenizer splits there
    whatever stands around, drops white space, and neither its special strings nor a normal form joins
    characters across them. So a run between two of them has the same tokens in every text, and its count
    can be kept. A file that doesn't do so is refused.
    """

    def __init__(self, path: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS):
        self._tokenizer = tokenizer(path)
        self._chunk, self._overlap = max(2, chunk_chars), max(1, overlap_chars)
        special = [len(token.content) for token in self._tokenizer.get_added_tokens_decoder().values()]
        self._margin = max([LOOK_AHEAD, *special])
        self._store = Store(lambda run: len(self._tokenizer.encode(run, add_special_tokens=False).ids))
        self._store[""] = 0
        probe = "It's a b1 of\tDON'T!!'s\n12 ab."
        whole = self._tokenizer.encode(probe, add_special_tokens=False)
        if len(whole.ids) != sum(map(self._store.__getitem__, probe.split())) or None in whole.word_ids:
            raise ValueError(f"{path} does not encode words apart from their white space")

    def count(self, text: str) -> int:
        """The tokens of a text, equal to encoding it in one go.

        A text beyond the chunk is encoded in overlapping chunks. The first begins where the text does, so
        its words are those of the text, but for the last characters: where a word begins is decided
        by what stands before and by a few characters behind, a special string at most. From a place on
        at which both a chunk with such words and the next one begin a word, the next one has the words
        of the text as well, as nothing before a word's beginning changes what follows. The count goes
        over at the first such place in the overlap. Without one the overlap doubles, up to the whole
        left chunk, and then the left chunk is made longer, which only a word of its length brings about.
        """
        if len(text) <= self._chunk:
            return sum(map(self._store.__getitem__, text.translate(_GAPS).split(" ")))
        left = _Chunk(self._tokenizer, text, 0, self._chunk)
        total, proven = 0, 0
        while left.end < len(text):
            right, common = None, ()
            overlap = self._overlap
            while not len(common):
                back = max(proven + 1, left.end - overlap)
                right = _Chunk(self._tokenizer, text, back, min(len(text), max(back + self._chunk, left.end + 1)))
                sure = left.begins[(left.begins > proven) & (left.begins <= left.end - self._margin)]
                common = np.intersect1d(sure, right.begins)
                if back == proven + 1:
                    break
                overlap *= 2
            if len(common):
                total += left.before(common[0]) - (left.before(proven) if proven else 0)
                proven, left = int(common[0]), right
            else:
                left = _Chunk(self._tokenizer, text, left.start, min(len(text), 2 * left.end - left.start))
        return total + left.tokens - (left.before(proven) if proven else 0)


@lru_cache(maxsize=2)
def counter(path: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> Counter:
    return Counter(path, chunk_chars, overlap_chars)


def token_counts(
    docs: DataFrame,
    path: str,
    limit: int = 2048,
    text: str = "text",
    doc_id: str = "doc_id",
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """Rows ``doc_id, n_bytes, n_tokens, over_limit``, one for each row of ``docs`` in any order.

    Tokens are those of the tokenizer file at ``path`` (which every executor has) for the whole
    text without begin, end or added special tokens; special strings inside a text are the one
    token that the library makes of them. A null text counts as empty. Null or repeated ids keep
    their rows, other columns are not carried, an empty table gives an empty table.
    """

    def rows(part):
        use, made = counter(path, chunk_chars, overlap_chars), []
        for key, value in part:
            n = use.count(value or "")
            made.append((key, len((value or "").encode()), n, n > limit))
        return made

    fields = [
        pa.field(doc_id, pa.int64()), pa.field("n_bytes", pa.int64()),
        pa.field("n_tokens", pa.int64()), pa.field("over_limit", pa.bool_()),
    ]
    return map_rows(
        docs.select(typed(docs, doc_id, "bigint"), typed(docs, text, "string")),
        rows, fields, f"`{doc_id}` bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    )
