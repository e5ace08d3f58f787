"""Byte-level BPE encoding and decoding as a reduction over halves of the text."""

from functools import lru_cache
from hashlib import sha256
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from deckweave.llm.arrow import map_rows, typed
from deckweave.llm.pieces import LOOK_AHEAD, Store, split
from deckweave.llm.vocabularies import rank_encoding

#: Pieces of each of the two generations of a worker's store; results do not depend on it.
STORE_PIECES = 100_000
#: Characters of a leaf, which is split and encoded in one go.
LEAF_CHARS = 8192
#: Ids of a leaf of the decoding tree.
LEAF_IDS = 8192


class Node:
    """Encoded span of a text: its pieces and the ids of each as little-endian 32-bit integers."""

    __slots__ = ("pieces", "codes")

    def __init__(self, pieces: list[str], codes: list[bytes]):
        self.pieces, self.codes = pieces, codes


class TreeCodec:
    """Encoder and decoder by one rank file."""

    def __init__(self, path: str, leaf_chars: int = LEAF_CHARS):
        self._bpe = rank_encoding(path)
        self._leaf = max(1, leaf_chars)
        self._store = Store(lambda piece: np.array(self._bpe.encode_ordinary(piece), "<u4").tobytes(), STORE_PIECES)

    def _leaf_node(self, text: str) -> Node:
        pieces = split(text)
        return Node(pieces, list(map(self._store.__getitem__, pieces)))

    def _node(self, text: str, start: int, end: int) -> Node:
        if end - start <= self._leaf:
            return self._leaf_node(text[start:end])
        middle = (start + end) // 2
        return self.join(self._node(text, start, middle), self._node(text, middle, end))

    def join(self, left: Node, right: Node) -> Node:
        """The node of both spans together, equal to encoding them in one go.

        The window starts at a piece of the left span behind which more characters follow than a
        match looks ahead, so that every piece before it stays as it is. It ends where a piece of
        the re-encoded window begins at the same place as a piece of the right span, again with
        that margin: matching has no memory, so all pieces from there on are those of the right
        span. Where there is no such place, the window grows to twice its pieces.
        """
        if not left.pieces or not right.pieces:
            return left if left.pieces else right
        back, margin = 0, 0
        while back < len(left.pieces) and margin < LOOK_AHEAD:
            back += 1
            margin += len(left.pieces[-back])
        head = left.pieces[len(left.pieces) - back :]
        before = sum(map(len, head))
        ahead = 4
        while True:
            tail = right.pieces[:ahead]
            whole = len(tail) == len(right.pieces)
            window = self._leaf_node("".join(head + tail))
            if whole:
                used, kept = len(window.pieces), len(tail)
                break
            ends = list(accumulate(map(len, window.pieces)))
            known = {before + at: i + 1 for i, at in enumerate(accumulate(map(len, tail)))}
            last = before + sum(map(len, tail)) - LOOK_AHEAD
            found = next((i for i, at in enumerate(ends) if at in known and at <= last), None)
            if found is not None:
                used, kept = found + 1, known[ends[found]]
                break
            ahead *= 2
        stay = len(left.pieces) - back
        return Node(
            left.pieces[:stay] + window.pieces[:used] + right.pieces[kept:],
            left.codes[:stay] + window.codes[:used] + right.codes[kept:],
        )

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(self._node(text, 0, len(text)).codes)

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids; spans of ids decode on their own and concatenate up the tree."""
        level = [
            self._bpe.decode_bytes(np.frombuffer(ids[at : at + 4 * LEAF_IDS], "<u4").tolist())
            for at in range(0, len(ids), 4 * LEAF_IDS)
        ]
        while len(level) > 1:
            level = [b"".join(level[at : at + 2]) for at in range(0, len(level), 2)]
        return level[0] if level else b""


@lru_cache(maxsize=2)
def codec(path: str, leaf_chars: int = LEAF_CHARS) -> TreeCodec:
    """One codec per Python worker and file."""
    return TreeCodec(path, leaf_chars)


def encode_documents(
    docs: DataFrame, ranks: str, text: str = "text", doc_id: str = "doc_id", leaf_chars: int = LEAF_CHARS
) -> DataFrame:
    """Rows ``doc_id, ids`` (array<int>), one for each row of ``docs`` in any order.

    ``ranks`` is the path of a rank file that every executor has. A text is encoded whole, in one
    task without a shuffle; ids are those of encoding each match of the pattern separately. A null
    text counts as empty and has no ids; null or repeated ids of documents keep their rows. Other
    columns are not carried. An empty table gives an empty table.
    """

    def rows(part):
        use = codec(ranks, leaf_chars)
        return [(key, np.frombuffer(use.encode(value or ""), "<i4")) for key, value in part]

    fields = [pa.field(doc_id, pa.int64()), pa.field("ids", pa.list_(pa.int32()))]
    return map_rows(
        docs.select(typed(docs, doc_id, "bigint"), typed(docs, text, "string")),
        rows, fields, f"`{doc_id}` bigint, ids array<int>",
    )


def decode_documents(encoded: DataFrame, ranks: str, ids: str = "ids", doc_id: str = "doc_id") -> DataFrame:
    """Rows ``doc_id, content`` (binary) from arrays of ids; null ids give empty content."""

    def rows(part):
        use = codec(ranks)
        return [(key, use.decode(np.array(value or [], "<u4").tobytes())) for key, value in part]

    fields = [pa.field(doc_id, pa.int64()), pa.field("content", pa.binary())]
    return map_rows(
        encoded.select(typed(encoded, doc_id, "bigint"), typed(encoded, ids, "array<bigint>")),
        rows, fields, f"`{doc_id}` bigint, content binary",
    )


def round_trip_digests(
    docs: DataFrame, ranks: str, text: str = "text", doc_id: str = "doc_id", leaf_chars: int = LEAF_CHARS,
    with_ids: bool = False,
) -> DataFrame:
    """Rows ``doc_id, n_tokens, ids_sha256, decoded_sha256``: encoding and decoding in one pass.

    ``with_ids`` adds the ids themselves (array<int>). Digests are those of the ids as little-endian unsigned 32-bit integers and of the decoded
    bytes. Nulls, repeated rows and other columns as in ``encode_documents``.
    """

    def rows(part):
        use, made = codec(ranks, leaf_chars), []
        for key, value in part:
            ids = use.encode(value or "")
            row = (key, len(ids) // 4, sha256(ids).hexdigest(), sha256(use.decode(ids)).hexdigest())
            made.append((*row, np.frombuffer(ids, "<i4")) if with_ids else row)
        return made

    fields = [
        pa.field(doc_id, pa.int64()), pa.field("n_tokens", pa.int64()),
        pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string()),
    ] + [pa.field("ids", pa.list_(pa.int32()))] * with_ids
    schema = f"`{doc_id}` bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_rows(docs.select(typed(docs, doc_id, "bigint"), typed(docs, text, "string")), rows, fields, schema)
