"""Examples packed into sequences of tokens by vector bin packing.

A sequence has three limits at once: tokens, segments (pieces of examples), and tokens that bear loss.
The first token of a segment is predicted from nothing and bears none. A task fills one sequence after
the other from a window of waiting pieces: of those that fit, the one with the greatest dot product of
its size and the room left, both in shares of the limits (Panigrahy et al., 2011), goes next.

Nothing is shuffled: each task packs the rows of its own partition, and what is left at its end is cut
into sequences of powers of two, which need no padding.
"""

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deckweave.llm.arrow import ROWS, typed
from deckweave.llm.pieces import Store
from deckweave.llm.vocabularies import tokenizer

#: Pieces that wait in a task, each of at most one sequence.
WINDOW = 1024
#: Gaps of fewer tokens are left as padding, so that no example is cut for a few tokens.
LEAST_PIECE = 16
#: Runs of more characters are taken apart where the tokenizer does so whatever stands around.
LONG_RUN = 4096

# A number character is a token of its own: nothing joins over a digit's end, or from a letter to a digit.
_SAFE_CUT = re.compile(r"(?<=[0-9])(?=[0-9A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[.,;:!?。、，])(?=[0-9A-Za-z一-鿿])")


# Fixed value: the words of the tokenizer after lower-casing, for the characters that `plain` texts hold.
_WORDS = re.compile(r"'(?:[stmd]|re|ve|ll)|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
# Characters for which the standard library's classes, its lower case and the tokenizer's are the same and
# no normal form differs: below U+0250 without four separators and six numerals.
_OTHER = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]")
# A byte that is not printable stands for itself plus an offset in vocabularies of this kind.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_NAMES = {byte: 256 + i for i, byte in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class WordEncoder:
    """Ids of whole texts by a ``tokenizers`` file that lowers case and drops white space.

    Texts of plain characters are taken apart into the tokenizer's words, whose ids are kept; the
    file's model is asked for new ones only. Other texts are taken apart at blanks, tabs and line ends
    alone, over which no special string and no normal form reaches, and the library encodes each new
    run. A file that doesn't take texts apart in this way is refused.
    """

    def __init__(self, path: str):
        self._tokenizer = tokenizer(path)
        self._model = self._tokenizer.model
        self._special = [token.content for token in self._tokenizer.get_added_tokens_decoder().values()]
        self._words, self._runs = Store(self._word), Store(self._run)
        self._runs[""] = b""
        probe = "It's a \x1btest_1 of\tDON'T!!'s É²ß\n12 ab."
        if self._library(probe) != b"".join(map(self._library, probe.split())) or self._library(
            probe.replace("²", "")
        ) != self._plain(probe.replace("²", "")):
            raise ValueError(f"{path} does not take texts apart into lower-case words without white space")

    def _library(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        named = word if word.isascii() and word.isalnum() else word.encode().decode("latin-1").translate(_BYTE_NAMES)
        found = self._model.tokenize(named)
        return struct.pack(f"<{len(found)}I", *[token.id for token in found])

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self._words.__getitem__, _WORDS.findall(text.lower())))

    def _run(self, run: str) -> bytes:
        if len(run) <= LONG_RUN:
            return self._library(run)
        return b"".join(map(self._library, _long_parts(run)))

    def encode(self, text: str) -> bytes:
        if not _OTHER.search(text) and not any(token in text for token in self._special):
            return self._plain(text)
        blanks = text.replace("\t", " ").replace("\n", " ").replace("\r", " ")
        return b"".join(map(self._runs.__getitem__, blanks.split(" ")))


def _long_parts(run: str) -> Iterator[str]:
    """A run in parts of about ``LONG_RUN`` characters, whole where it has no place to cut."""
    start = 0
    for cut in _SAFE_CUT.finditer(run):
        if cut.start() - start >= LONG_RUN:
            yield run[start : cut.start()]
            start = cut.start()
    yield run[start:]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


@dataclass(frozen=True)
class Limits:
    """What one sequence holds at most. ``loss`` counts the tokens that bear loss."""

    tokens: int = 4096
    segments: int = 128
    loss: int = 4096

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("limits start at 1")


@dataclass(slots=True)
class Piece:
    """Ids of a document from ``start`` on, of ``doc_tokens`` in all; each as four bytes."""

    doc_id: int | None
    doc_tokens: int
    bears_loss: bool
    start: int
    ids: bytes

    @property
    def length(self) -> int:
        return len(self.ids) // 4

    @property
    def loss(self) -> int:
        return self.length - 1 if self.bears_loss else 0

    def split(self, length: int) -> tuple["Piece", "Piece"]:
        head, rest = self.ids[: 4 * length], self.ids[4 * length :]
        same = (self.doc_id, self.doc_tokens, self.bears_loss)
        return Piece(*same, self.start, head), Piece(*same, self.start + length, rest)


class Packer:
    """Fills sequences from a window of pieces; gives them as lists of pieces.

    With ``cut`` the gap of a sequence that nothing fits is filled with the head of a waiting piece,
    and a sequence that is full by another limit ends at a power of two. Without it only examples
    beyond the limits are cut, and gaps stay.
    """

    def __init__(self, limits: Limits, cut: bool = True, window: int = WINDOW):
        self._limits, self._cut, self._window = limits, cut, max(1, window)
        self._caps = np.array([limits.tokens, limits.segments, limits.loss], np.float64)
        self._waiting: list[Piece] = []
        self._sizes = np.zeros((self._window + limits.segments + 8, 3), np.int64)

    def _wait(self, piece: Piece) -> None:
        if len(self._waiting) == len(self._sizes):
            self._sizes = np.concatenate([self._sizes, np.zeros_like(self._sizes)])
        self._sizes[len(self._waiting)] = piece.length, 1, piece.loss
        self._waiting.append(piece)

    def _take(self, at: int) -> Piece:
        """The piece at a place; the last one moves there."""
        piece, last = self._waiting[at], self._waiting.pop()
        if at < len(self._waiting):
            self._waiting[at] = last
            self._sizes[at] = self._sizes[len(self._waiting)]
        return piece

    def add(self, key, ids: bytes, bears_loss: bool = True) -> Iterator[list[Piece]]:
        """Take an example and give the sequences that are full by then."""
        size = len(ids) // 4
        longest = min(self._limits.tokens, self._limits.loss + 1) if bears_loss else self._limits.tokens
        for start in range(0, size, longest):
            # Copies of their part, so that a long document is not held for its last piece.
            piece = Piece(key, size, bears_loss, start, ids[4 * start : 4 * (start + longest)])
            if piece.length == self._limits.tokens:
                yield [piece]
            else:
                self._wait(piece)
        while len(self._waiting) >= self._window:
            yield from self._filled()

    def finish(self) -> Iterator[list[Piece]]:
        while self._waiting:
            yield from self._filled()

    def _filled(self) -> Iterator[list[Piece]]:
        """One sequence from the window, or several short ones where that empties it."""
        room = np.array([self._limits.tokens, self._limits.segments, self._limits.loss], np.int64)
        chosen: list[Piece] = []

        def put(piece: Piece) -> None:
            chosen.append(piece)
            room[:] -= piece.length, 1, piece.loss

        while self._waiting and room[0] and room[1]:
            sizes = self._sizes[: len(self._waiting)]
            fits = (sizes <= room).all(axis=1)
            if not fits.any():
                break
            value = (sizes / self._caps) @ (room / self._caps)
            put(self._take(int(np.where(fits, value, -1.0).argmax())))
        if self._cut and self._waiting and room[0] >= LEAST_PIECE and room[1]:
            # Nothing fits, so every piece is longer than the room for its tokens or loss.
            sizes = self._sizes[: len(self._waiting)]
            head = np.where(sizes[:, 2] > 0, np.minimum(room[0], room[2] + 1), room[0])
            head = np.minimum(head, sizes[:, 0] - 1)
            best = int(np.lexsort((sizes[:, 0], head))[-1])
            if head[best] >= LEAST_PIECE:
                first, rest = self._take(best).split(int(head[best]))
                put(first)
                self._wait(rest)
        gap = int(room[0])
        if not self._cut or gap < LEAST_PIECE:
            yield chosen
        else:
            yield from self._by_powers(chosen)

    def _by_powers(self, chosen: list[Piece]) -> Iterator[list[Piece]]:
        """Sequences of powers of two from the pieces; while others wait, what is over waits again."""
        while chosen:
            size = 1 << (sum(piece.length for piece in chosen).bit_length() - 1)
            made, left = [], size
            while left:
                piece = chosen.pop(0)
                if piece.length > left:
                    piece, rest = piece.split(left)
                    chosen.insert(0, rest)
                made.append(piece)
                left -= piece.length
            yield made
            if self._waiting:
                for piece in chosen:
                    self._wait(piece)
                return


_FIELDS = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("loss_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
])
_SCHEMA = ", ".join(f"{field.name} bigint" for field in _FIELDS)


def pack(
    docs: DataFrame,
    path: str,
    end_id: int | None = None,
    limits: Limits = Limits(),
    cut: bool = True,
    text: str = "text",
    doc_id: str = "doc_id",
    bears_loss: str | None = None,
    with_ids: bool = True,
    window: int = WINDOW,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, loss_tokens, sequence_id, offset, ids``.

    Texts are encoded whole by the tokenizer file at ``path`` without added special tokens, and
    ``end_id`` follows each, if given. A piece has the ids of its document from ``start`` on and
    stands in its sequence from ``offset`` on; pieces of a sequence follow each other without gaps.
    Each id lies in one piece. ``bears_loss`` names a boolean column: tokens of rows where it is not
    true bear no loss, as those of prompts; without it all rows' tokens do. ``with_ids`` adds the
    ids, as little-endian unsigned 32-bit integers.

    A null text counts as empty; an empty one is its end token alone, or no piece without an end id.
    Rows with null or repeated ids are examples of their own. A document beyond the limits is cut
    into whole sequences first, whatever ``cut`` says. Other columns are not carried. An empty table
    gives no row. Sequence ids are unique, but not gapless; which documents share a sequence depends
    on the partitions of ``docs``, which have to come back in the same order if a task is repeated, as
    those of files do.
    """
    columns = [typed(docs, doc_id, "bigint").alias("doc_id"), typed(docs, text, "string").alias("text")]
    columns += [typed(docs, bears_loss, "boolean").alias("bears_loss")] if bears_loss else [F.lit(True).alias("bears_loss")]
    fields = pa.schema([*_FIELDS, ("ids", pa.binary())]) if with_ids else _FIELDS
    end = b"" if end_id is None else np.uint32(end_id).astype("<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, packer = word_encoder(path), Packer(limits, cut, window)
        sequence, made = TaskContext.get().partitionId() << 32, []

        def noted(chosen: list[Piece]) -> None:
            nonlocal sequence
            offset = 0
            for piece in chosen:
                row = (
                    piece.doc_id, piece.start, piece.length, crc32(piece.ids),
                    piece.doc_tokens, piece.loss, sequence, offset,
                )
                made.append((*row, piece.ids) if with_ids else row)
                offset += piece.length
            sequence += 1

        def table() -> pa.RecordBatch:
            arrays = [pa.array(values, field.type) for values, field in zip(zip(*made), fields)]
            made.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=fields)

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                for key, value, bears in zip(*(part.column(i).to_pylist() for i in range(3))):
                    for chosen in packer.add(key, use.encode(value or "") + end, bool(bears)):
                        noted(chosen)
                if len(made) >= ROWS:
                    yield table()
        for chosen in packer.finish():
            noted(chosen)
        if made:
            yield table()

    return docs.select(*columns).mapInArrow(run, _SCHEMA + (", ids binary" if with_ids else ""))
