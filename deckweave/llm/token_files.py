"""Token ids as compressed binary blocks with a shared dictionary, and their reader.

A folder holds Parquet files whose rows are blocks of documents in ascending order of their ids:

``shard``, ``block``      place of the block; shards ascend with the ids of documents, blocks in a shard
``dictionary_sha256``     which dictionary its frames need; ``dictionary/`` in the folder holds it
``doc_ids``               ids of the documents of the block
``first_id``, ``last_id`` least and greatest of them, null where all are
``offsets``               offset index: where the frame of each document begins in ``frames``, and the end
``n_tokens``              ids of each document
``start``                 ids of the shard before the block
``frames``                one Zstandard frame per document, its ids as little-endian unsigned 32-bit integers

A short document is read by its offset alone, without decompressing the others.
"""

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deckweave.llm.arrow import ROWS, map_rows, typed
from deckweave.llm.pieces import STORE_ENTRIES, split_all
from deckweave.llm.sampling import sample_by_hash
from deckweave.llm.vocabularies import tokenizer

#: Documents whose ids train the dictionary, and ids of each that count: bounds of the training sample.
SAMPLE_DOCUMENTS = 1000
SAMPLE_IDS = 4096
DICTIONARY_BYTES = 64 * 1024
#: A block ends after so many bytes of ids or so many documents.
BLOCK_BYTES = 1 << 20
BLOCK_DOCUMENTS = 1024
LEVEL = 3
#: Texts are encoded together up to so many characters; 64 more count for each document.
CALL_CHARACTERS = 1 << 22
#: Bytes of the pieces that a worker keeps between calls, besides ``STORE_ENTRIES`` of them.
STORE_BYTES = 64 << 20
#: Shares into which rows with one id may be split between shards.
TIES = 1024

_BLOCKS = (
    "shard int, block int, dictionary_sha256 string, first_id bigint, last_id bigint, doc_ids array<bigint>, offsets array<bigint>, "
    "n_tokens array<bigint>, start bigint, frames binary"
)
_BLOCK_FIELDS = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("dictionary_sha256", pa.string()),
    ("first_id", pa.int64()), ("last_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())),
    ("n_tokens", pa.list_(pa.int64())), ("start", pa.int64()), ("frames", pa.binary()),
])


# Printable bytes stand for themselves, the others for the characters from 256 on, in order.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARACTERS = {byte: 256 + i for i, byte in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_BLANK = chr(_BYTE_CHARACTERS[ord(" ")])


class Encoder:
    """Ids of whole texts by a byte-level ``tokenizers`` file.

    The tokenizer encodes each match of its pattern on its own, so the ids of a match are asked
    from it once and kept: matches and ids of all texts of a call are columns, looked up together.
    Texts that hold one of its special strings go to it as they are.
    """

    def __init__(self, path: str, entries: int = STORE_ENTRIES):
        self._tokenizer = tokenizer(path)
        self._special = [token.content for token in self._tokenizer.get_added_tokens_decoder().values()]
        self._bpe, self._entries = self._tokenizer.model, entries
        self._pieces = pa.array([], pa.large_string())
        self._ids, self._ends = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _whole(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> list[int]:
        """Ids of one match of the pattern by the tokenizer's model, which reads bytes as characters."""
        if piece.isascii() and piece.lstrip(" ").isalnum():
            named = piece.replace(" ", _BLANK)
        else:
            named = piece.encode().decode("latin-1").translate(_BYTE_CHARACTERS)
        return [token.id for token in self._bpe.tokenize(named)]

    def _places(self, pieces: pa.LargeStringArray) -> np.ndarray:
        """Places of pieces in the store, which takes in those that it doesn't have."""
        places = pc.index_in(pieces, value_set=self._pieces)
        missing = places.is_null()
        places = places.fill_null(-1).to_numpy().astype(np.int64)
        if (places < 0).any():
            coded = pieces.filter(missing).dictionary_encode()
            places[places < 0] = len(self._pieces) + coded.indices.to_numpy()
            found = [self._piece(piece) for piece in coded.dictionary.to_pylist()]
            self._ids = np.concatenate([self._ids, np.fromiter(chain.from_iterable(found), "<u4")])
            self._ends = np.concatenate([self._ends, self._ends[-1] + np.cumsum([len(ids) for ids in found])])
            self._pieces = pa.concat_arrays([self._pieces, coded.dictionary])
        return places

    def _trim(self, places: np.ndarray) -> None:
        """A full store keeps the short pieces of the latest texts, as frequent ones are among them."""
        if len(self._pieces) <= self._entries and self._pieces.nbytes <= STORE_BYTES:
            return
        used = np.unique(places)
        lengths = pc.utf8_length(self._pieces).to_numpy()
        used = used[lengths[used] <= 64]
        sizes = np.diff(self._ends)[used]
        self._ids = _gathered(self._ids, self._ends[used], sizes)
        self._ends = np.concatenate([[0], np.cumsum(sizes)])
        self._pieces = self._pieces.take(pa.array(used))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        special = {i for i, text in enumerate(texts) if any(token in text for token in self._special)}
        pieces, counts = split_all(["" if i in special else text for i, text in enumerate(texts)])
        places = self._places(pieces)
        sizes = self._ends[places + 1] - self._ends[places]
        ids, ends = _gathered(self._ids, self._ends[places], sizes), np.concatenate([[0], np.cumsum(sizes)])[counts]
        self._trim(places)
        starts = [0, *ends[:-1].tolist()]
        return [
            self._whole(text) if i in special else ids[start:end].tobytes()
            for i, (text, start, end) in enumerate(zip(texts, starts, ends.tolist()))
        ]


def _gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """Runs of values, each from its start on, one after the other."""
    parts = []
    for at in range(0, len(starts), step):
        size = sizes[at : at + step]
        ends = np.cumsum(size)
        parts.append(values[np.repeat(starts[at : at + step] - ends + size, size) + np.arange(ends[-1])])
    return np.concatenate([values[:0], *parts])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=2)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    if not dictionary:
        return zstandard.ZstdCompressor(level=LEVEL)
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data)


@lru_cache(maxsize=2)
def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    if not dictionary:
        return zstandard.ZstdDecompressor()
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))


def train_dictionary(docs: DataFrame, path: str, end_id: int, text: str = "text", doc_id: str = "doc_id") -> bytes:
    """A dictionary from the documents with the smallest hashes of their ids.

    At most ``SAMPLE_DOCUMENTS`` documents are used, and of each at most ``SAMPLE_IDS`` ids in a row,
    from a place by their hash. Where they are too few to train on, their ids as they are, the
    last ``DICTIONARY_BYTES``, are the dictionary; of an empty table it is empty.
    """

    def rows(part):
        use, end, made = encoder(path), np.uint32(end_id).astype("<u4").tobytes(), []
        for code in use.encode([value or "" for (value,) in part]):
            ids = code + end
            first = crc32(ids) % max(1, len(ids) // 4 - SAMPLE_IDS + 1)
            made.append((ids[4 * first : 4 * (first + SAMPLE_IDS)],))
        return made

    named = docs.select(typed(docs, doc_id, "bigint").alias("doc_id"), typed(docs, text, "string").alias("text"))
    chosen = sample_by_hash(named, SAMPLE_DOCUMENTS, "doc_id", "text")
    sample = map_rows(chosen.select("text"), rows, [pa.field("ids", pa.binary())], "ids binary")
    samples = sorted(bytes(row.ids) for row in sample.collect())
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few samples, or bytes of them
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _in_order(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    keyed = docs.select(
        typed(docs, doc_id, "bigint").alias("doc_id"),
        typed(docs, text, "string").alias("text"),
    ).withColumns({"tie": F.xxhash64("text"), "share": F.monotonically_increasing_id() % TIES})
    order = [F.col("doc_id").asc_nulls_first(), "tie", "share"]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of the next documents, of about ``CALL_CHARACTERS``, or one longer document."""
    keys, texts, size = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            for key, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                value = value or ""
                if keys and size + len(value) > CALL_CHARACTERS:
                    yield keys, texts
                    keys, texts, size = [], [], 0
                keys.append(key)
                texts.append(value)
                size += len(value) + 64
    if keys:
        yield keys, texts


def write_tokens(
    docs: DataFrame, path: str, folder: str, end_id: int, text: str = "text", doc_id: str = "doc_id"
) -> None:
    """Encode ``docs`` by the tokenizer file at ``path`` and write ``folder`` in the format above.

    ``end_id`` follows the ids of each document. A null text counts as empty and has the end id
    alone. Rows with a null id come first; rows with the same id stay apart, in the order of their
    texts' hashes. Other columns are not carried. An empty table writes no block.
    """
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, path, end_id, text, doc_id)
    name = sha256(dictionary).hexdigest()
    spark.createDataFrame([(name, bytearray(dictionary))], "dictionary_sha256 string, content binary").coalesce(
        1
    ).write.parquet(f"{folder}/dictionary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, pack, end = encoder(path), _compressor(dictionary), np.uint32(end_id).astype("<u4").tobytes()
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        ids, frames, sizes, raw = [], [], [], 0

        def made():
            offsets = np.concatenate([[0], np.cumsum([len(frame) for frame in frames])]).astype(np.int64)
            known = [key for key in ids if key is not None]
            ends = [[min(known, default=None)], [max(known, default=None)]]
            row = [[shard], [block], [name], *ends, [ids], [offsets], [sizes], [start], [b"".join(frames)]]
            return pa.RecordBatch.from_arrays(
                [pa.array(value, field.type) for value, field in zip(row, _BLOCK_FIELDS)], schema=_BLOCK_FIELDS
            )

        for keys, texts in _together(batches):
            for key, code in zip(keys, use.encode(texts)):
                code += end
                ids.append(key)
                frames.append(pack.compress(code))
                sizes.append(len(code) // 4)
                raw += len(code)
                if raw >= BLOCK_BYTES or len(ids) >= BLOCK_DOCUMENTS:
                    yield made()
                    block, start = block + 1, start + sum(sizes)
                    ids, frames, sizes, raw = [], [], [], 0
        if ids:
            yield made()

    blocks = _in_order(docs, text, doc_id).select("doc_id", "text").mapInArrow(run, _BLOCKS)
    blocks.write.option("compression", "none").parquet(f"{folder}/blocks")


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks")


def read_dictionary(spark: SparkSession, folder: str) -> bytes:
    """The dictionary of a folder, checked against its hash."""
    row = spark.read.parquet(f"{folder}/dictionary").first()
    content = bytes(row.content)
    if sha256(content).hexdigest() != row.dictionary_sha256:
        raise ValueError(f"the dictionary of {folder} does not have the hash that it was written with")
    return content


def _frames(folder_name: str, part: tuple) -> Iterator[tuple]:
    """Documents of a block: id, ids of the shard before it, number of ids, frame."""
    shard, name, doc_ids, offsets, sizes, start, frames = part
    if name != folder_name:
        raise ValueError(f"a block of shard {shard} needs the dictionary {name}")
    view = memoryview(frames)
    for i, key in enumerate(doc_ids):
        yield shard, key, start, sizes[i], view[offsets[i] : offsets[i + 1]]
        start += sizes[i]


def read_documents(spark: SparkSession, folder: str, only: list[int] | None = None) -> DataFrame:
    """Rows ``doc_id, ids`` (array<bigint>) from the files; of the documents ``only``, if given.

    Blocks without a wanted document are not decompressed, nor are the other frames of a block.
    """
    dictionary = read_dictionary(spark, folder)
    name, wanted = sha256(dictionary).hexdigest(), None if only is None else set(only)

    def rows(part):
        unpack = _decompressor(dictionary)
        return [
            (key, np.frombuffer(unpack.decompress(frame), "<u4").astype(np.int64))
            for block in part
            for _, key, _, _, frame in _frames(name, block)
            if wanted is None or key in wanted
        ]

    blocks = read_blocks(spark, folder)
    if only is not None:
        # Blocks are in the order of ids: their bounds are in the files' statistics.
        inside = F.exists(
            F.array(*[F.lit(x).cast("bigint") for x in only]), lambda x: (x >= F.col("first_id")) & (x <= F.col("last_id"))
        )
        least, most = min(only, default=0), max(only, default=-1)
        blocks = blocks.where((F.col("last_id") >= least) & (F.col("first_id") <= most) & inside)
    columns = ("shard", "dictionary_sha256", "doc_ids", "offsets", "n_tokens", "start", "frames")
    fields = [pa.field("doc_id", pa.int64()), pa.field("ids", pa.list_(pa.int64()))]
    return map_rows(blocks.select(*columns), rows, fields, "doc_id bigint, ids array<bigint>")


def document_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Rows ``doc_id, start, n_tokens, ids_crc32`` from the files.

    ``start`` is the number of ids of all documents before; it needs the sums of shards only.
    """
    dictionary = read_dictionary(spark, folder)
    name = sha256(dictionary).hexdigest()

    def rows(part):
        unpack, made = _decompressor(dictionary), []
        for block in part:
            for shard, key, start, size, frame in _frames(name, block):
                content = unpack.decompress(frame)
                if len(content) != 4 * size:
                    raise ValueError(f"document {key} has {len(content) // 4} ids in place of {size}")
                made.append((shard, key, start, size, crc32(content)))
        return made

    fields = [pa.field("shard", pa.int32()), pa.field("doc_id", pa.int64()), pa.field("start", pa.int64()),
              pa.field("n_tokens", pa.int64()), pa.field("ids_crc32", pa.int64())]
    blocks = read_blocks(spark, folder)
    columns = ("shard", "dictionary_sha256", "doc_ids", "offsets", "n_tokens", "start", "frames")
    found = map_rows(
        blocks.select(*columns), rows, fields,
        "shard int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    )
    ends = blocks.groupBy("shard").agg(
        F.max(F.col("start") + F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("ids")
    )
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = ends.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    return found.join(bases, "shard").select(
        "doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32"
    )
