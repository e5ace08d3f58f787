"""Encoders against their libraries on whole texts."""

import random
from hashlib import sha256
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest

from deckweave.llm import pieces, token_counts, token_files, tree_bpe
from deckweave.llm.vocabularies import rank_encoding, tokenizer
from deckweave.session import scratch_path

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["the", " ", "  ", "\n", "\t", "'s", "'l", "l", "'", "ll", "é", "é", "ß", "²", "12", " ", "\x1c",
         "日本", "🙂", "...", "_", "<|endoftext|>", "<|startoftext|>", "I'll", " ", "́", "A" * 40]
TEXTS = [None, "", " ", "a", "x" * 3000, " " * 3000, "'" * 500, "don't stop", "<|endoftext|>"] + [
    "".join(random.Random(seed).choices(PARTS, k=seed * 3)) for seed in range(1, 90)
]
SCHEMA = "doc_id bigint, text string, ids string, n_tokens string, start string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, text, "x", "y", "z") for i, text in enumerate(TEXTS)]
    rows += [(None, "no id", None, None, None), (3, "a", None, None, None), (3, "a", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("leaf", [1, 2, 3, 7, 64, 8192])
def test_tree_equals_library(leaf):
    use, library = tree_bpe.TreeCodec(RANKS, leaf), rank_encoding(RANKS)
    for text in filter(None, TEXTS):
        ids = use.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), text
        assert use.decode(ids) == text.encode()


def test_pieces_are_the_same_by_both_modules():
    for code in [*range(0x250), 0x3A9, 0x4E00, 0x1F642]:
        text = f"x{chr(code)}y 1{chr(code)}2 .{chr(code)}, {chr(code)}{chr(code)}z"
        assert pieces.split(text) == pieces._any.findall(text)


def test_round_trip_job(docs):
    library = rank_encoding(RANKS)
    found = sorted(map(tuple, tree_bpe.round_trip_digests(docs, RANKS, leaf_chars=16).collect()), key=str)
    expected = []
    for row in docs.collect():
        text = row.text or ""
        ids = library.encode_ordinary(text)
        expected.append((row.doc_id, len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256(text.encode()).hexdigest()))
    assert found == sorted(expected, key=str)
    encoded = tree_bpe.encode_documents(docs, RANKS)
    texts = sorted(bytes(row.content) for row in tree_bpe.decode_documents(encoded, RANKS).collect())
    assert texts == sorted((row.text or "").encode() for row in docs.collect())
    assert tree_bpe.encode_documents(docs.limit(0), RANKS).count() == 0


@pytest.mark.parametrize(("chunk", "overlap"), [(2, 1), (5, 2), (16, 4), (64, 8), (16384, 256)])
def test_counts_equal_library(chunk, overlap):
    use, library = token_counts.Counter(WORDS, chunk, overlap), tokenizer(WORDS)
    for text in filter(None, TEXTS):
        assert use.count(text) == len(library.encode(text, add_special_tokens=False).ids), text


def _long_texts():
    draw = random.Random(8)
    parts = [*PARTS, "İ", "é́", "日。本", "<|endoftext|>", "<|end", "oftext|>", "'s", "a1", ".", "Σ"]
    yield "".join(draw.choices(parts, k=700))
    yield "".join(draw.choices([part for part in parts if not part.isspace()], k=900))
    yield "".join(draw.choices(["<|endoftext|>", "x", "́", "1"], k=500))
    yield "ab" * 400 + "." + "c" * 300 + " " * 300 + "d"
    yield "́" * 300 + "<|endoftext|>" * 60


@pytest.mark.parametrize(("chunk", "overlap"), [(2, 1), (17, 3), (40, 8), (200, 20), (1000, 256)])
def test_spliced_counts_equal_library(chunk, overlap):
    use, library = token_counts.Counter(WORDS, chunk, overlap), tokenizer(WORDS)
    for text in _long_texts():
        assert use.count(text) == len(library.encode(text, add_special_tokens=False).ids), text[:200]


def test_chunks_stay_short_without_white_space(monkeypatch):
    """Ten million characters without a blank: no call gets more than a chunk."""
    draw = random.Random(3)
    piece = "".join(draw.choices(["word", "é", "1", "--", "日本", "'s", ".", "<|endoftext|>"], k=40_000))
    text = piece * (10_000_000 // len(piece))
    calls, plain = [], token_counts._Chunk.__init__

    def noted(self, use, whole, start, end):
        calls.append(end - start)
        plain(self, use, whole, start, end)

    monkeypatch.setattr(token_counts._Chunk, "__init__", noted)
    use = token_counts.Counter(WORDS)
    size, copies = len(piece), len(text) // len(piece)
    one, two = use.count(piece), use.count(piece * 2)
    assert len(piece) > use._chunk and one == len(tokenizer(WORDS).encode(piece, add_special_tokens=False).ids)
    calls.clear()
    assert use.count(text) == one + (copies - 1) * (two - one)
    assert max(calls) <= use._chunk and sum(calls) < 1.02 * size * copies


def test_other_kinds_of_files_are_refused():
    with pytest.raises(ValueError):
        token_counts.Counter(BYTES)


def test_counts_job(docs):
    library = tokenizer(WORDS)
    found = sorted(map(tuple, token_counts.token_counts(docs, WORDS, limit=20).collect()), key=str)
    expected = []
    for row in docs.collect():
        n = len(library.encode(row.text or "", add_special_tokens=False).ids)
        expected.append((row.doc_id, len((row.text or "").encode()), n, n > 20))
    assert found == sorted(expected, key=str)
    assert token_counts.token_counts(docs.limit(0), WORDS).count() == 0


@pytest.mark.parametrize("copies", [1, 40])
def test_files(spark, docs, copies):
    many = docs.crossJoin(spark.range(copies)).drop("id") if copies > 1 else docs
    folder = scratch_path(spark, "token-test")
    token_files.write_tokens(many, BYTES, folder, end_id=2)
    dictionary = token_files.read_dictionary(spark, folder)
    # Trained ones begin with the magic number of the format.
    assert dictionary[:4] == b"\x37\xa4\x30\xec"
    library = tokenizer(BYTES)
    rows = many.collect()
    ids = {row.text: [*library.encode(row.text or "", add_special_tokens=False).ids, 2] for row in rows}
    found = token_files.document_digests(spark, folder).orderBy("start").collect()
    assert len(found) == len(rows)
    assert [row.doc_id for row in found] == sorted((row.doc_id for row in rows), key=lambda x: (x is not None, x))
    start = 0
    for row in found:
        assert row.start == start
        start += row.n_tokens
    crc = {text: (len(x), crc32(np.array(x, "<u4").tobytes())) for text, x in ids.items()}
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in found) == sorted((str(r.doc_id), *crc[r.text]) for r in rows)
    some = token_files.read_documents(spark, folder, only=[5, 20]).collect()
    assert {row.doc_id: row.ids for row in some} == {i: ids[TEXTS[i]] for i in (5, 20)}
    assert token_files.read_documents(spark, folder, only=[]).count() == 0
    plan = token_files.read_documents(spark, folder, only=[5, 20])._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(last_id), IsNotNull(first_id)" in plan.split("PushedFilters: ")[1]


def test_files_of_few_texts(spark):
    """Too few to train on: their ids are the dictionary."""
    texts = ["one text", "one text and more", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    folder, library = scratch_path(spark, "token-test"), tokenizer(BYTES)
    token_files.write_tokens(docs, BYTES, folder, end_id=2)
    dictionary = token_files.read_dictionary(spark, folder)
    assert dictionary and dictionary[:4] != b"\x37\xa4\x30\xec"
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    assert {row.doc_id: row.ids for row in token_files.read_documents(spark, folder).collect()} == ids


def test_files_of_an_empty_table(spark, docs):
    folder = scratch_path(spark, "token-test")
    token_files.write_tokens(docs.limit(0), BYTES, folder, end_id=2)
    assert token_files.document_digests(spark, folder).count() == 0


def test_a_worker_keeps_a_bounded_number_of_pieces():
    """Ids are the same when pieces leave the store, which the codec bounds well below the usual number."""
    import public_tokenizers
    from deckweave.llm import pieces, tree_bpe

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    small, usual = tree_bpe.TreeCodec(path, 64), tree_bpe.TreeCodec(path, 64)
    assert usual._store._entries == tree_bpe.STORE_PIECES < pieces.STORE_ENTRIES
    small._store._entries = 3
    text = "one two three four five six seven one two " * 20
    assert small.encode(text) == usual.encode(text) and small.decode(small.encode(text)) == text.encode()
    assert len(small._store) <= 3 and len(small._store._older) <= 3


def _grouped(parts, seed, n=400):
    draw = random.Random(seed)
    return [["".join(draw.choices(parts, k=draw.randint(0, 12))) for _ in range(draw.randint(0, 4))] for _ in range(n)]


def test_pieces_of_many_texts_are_those_of_each():
    parts = [*PARTS, "'re", "'v", "e", "\x85", "\xa0", "　", "½", "٣", "​", "\0", "'S", "\U0001d7d9", "d"]
    for texts in [[text or "" for text in TEXTS], *_grouped(parts, 1)]:
        found, counts = pieces.split_all(texts)
        starts = [0, *counts.tolist()]
        assert [found[a:b].to_pylist() for a, b in zip(starts, starts[1:])] == [pieces.split(text) for text in texts]


@pytest.mark.parametrize("entries", [3, 500_000])
def test_many_texts_are_encoded_as_by_the_library(entries):
    use, library = token_files.Encoder(BYTES, entries), tokenizer(BYTES)
    for texts in [[text or "" for text in TEXTS], [], [""], *_grouped(PARTS, 2, 100)]:
        expected = [library.encode(text, add_special_tokens=False).ids for text in texts]
        assert [np.frombuffer(ids, "<u4").tolist() for ids in use.encode(texts)] == expected


def test_a_full_store_keeps_short_pieces_of_the_latest_texts():
    use = token_files.Encoder(BYTES, entries=3)
    use.encode([" ".join(f"word{i}x" for i in range(500))])
    use.encode(["one two one", "b" * 65])
    assert sorted(use._pieces.to_pylist()) == [" one", " two", "one"]
    assert len(use._ends) == 4 and use._ends[-1] == len(use._ids)


def test_texts_go_to_the_encoder_in_bounded_groups(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_files, "CALL_CHARACTERS", 1000)
    texts = [None, "a" * 5000, "", *["b" * 100] * 300]
    batches = pa.table({"doc_id": range(len(texts)), "text": texts}).to_batches(max_chunksize=200)
    groups = list(token_files._together(iter(batches)))
    assert [key for keys, _ in groups for key in keys] == list(range(len(texts)))
    assert [text for _, some in groups for text in some] == [text or "" for text in texts]
    assert all(len(some) == 1 or sum(map(len, some)) <= 1000 for _, some in groups) and len(groups) < 60


def test_known_pieces_cost_less_than_one_by_one():
    """A file's ids by columns take less CPU than the same pieces asked from a dictionary one by one."""
    from time import process_time

    draw = random.Random(4)
    known = ["".join(draw.choices("aeionrst", k=draw.randint(2, 9))) for _ in range(20_000)]
    texts = [" ".join(draw.choices(known, k=600)) + ".\n" for _ in range(500)]
    use = token_files.Encoder(BYTES)
    expected = use.encode(texts)
    store = {piece: np.array(use._piece(piece), "<u4").tobytes() for piece in {p for text in texts for p in pieces.split(text)}}

    def least(run):
        spent = []
        for _ in range(3):
            before = process_time()
            assert run() == expected
            spent.append(process_time() - before)
        return min(spent)

    plain = least(lambda: [b"".join(map(store.__getitem__, pieces.split(text))) for text in texts])
    assert least(lambda: use.encode(texts)) < 0.8 * plain
