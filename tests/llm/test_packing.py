"""Packing: every id in one piece, limits kept, little padding, ids as the library gives them."""

import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest

from deckweave.llm import packing
from deckweave.llm.packing import Limits, Packer
from deckweave.llm.vocabularies import tokenizer

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def _library(text: str) -> list[int]:
    return tokenizer(WORDS).encode(text, add_special_tokens=False).ids


def _power(n: int) -> bool:
    return n & (n - 1) == 0


def _sequences(packer: Packer, examples) -> list:
    made = []
    for key, (size, bears) in enumerate(examples):
        made += packer.add(key, np.arange(size, dtype="<u4").tobytes(), bears)
    return made + list(packer.finish())


def _check(made, examples, limits):
    """Ids of each example, gathered from its pieces, are those that went in."""
    got = defaultdict(list)
    for pieces in made:
        assert 0 < sum(p.length for p in pieces) <= limits.tokens and len(pieces) <= limits.segments
        assert sum(p.loss for p in pieces) <= limits.loss
        for piece in pieces:
            got[piece.doc_id].append((piece.start, np.frombuffer(piece.ids, "<u4").tolist()))
    for key, (size, _) in enumerate(examples):
        ids = [i for _, part in sorted(got[key]) for i in part]
        assert ids == list(range(size))


@pytest.mark.parametrize("limits", [Limits(), Limits(4096, 4, 4096), Limits(4096, 64, 700), Limits(64, 2, 9), Limits(100, 8, 80), Limits(1, 1, 1)])
@pytest.mark.parametrize("cut", [True, False])
@pytest.mark.parametrize("window", [1, 7, 200])
def test_limits_and_ids(limits, cut, window):
    draw = random.Random(limits.segments * 10 + window)
    examples = [(draw.choice([0, 1, 3, 40, 500, 900, 4095, 4096, 9000]), draw.random() < 0.7) for _ in range(60)]
    if limits.tokens == 1:
        examples = [(size % 50, bears) for size, bears in examples]
    made = _sequences(Packer(limits, cut, window), examples)
    _check(made, examples, limits)
    if cut and limits.loss >= limits.tokens:
        for pieces in made:
            size = sum(p.length for p in pieces)
            assert _power(size) or limits.tokens - size < packing.LEAST_PIECE
    if not cut:
        whole = {key for key, (size, bears) in enumerate(examples) if 0 < size <= min(limits.tokens, limits.loss + bears)}
        assert all(p.length == p.doc_tokens for pieces in made for p in pieces if p.doc_id in whole)


def test_dot_product_prefers_what_fits_the_room_left():
    """Long examples with little loss stand with short ones of much loss."""
    limits = Limits(tokens=100, segments=4, loss=49)
    examples = [(50, False), (50, True)] * 20
    made = _sequences(Packer(limits, cut=False), examples)
    assert len(made) == 20 and all(sorted(p.bears_loss for p in pieces) == [False, True] for pieces in made)


def test_padding_is_little_and_few_are_cut():
    draw = random.Random(3)
    examples = [(max(1, int(draw.lognormvariate(6, 1))), True) for _ in range(4000)]
    made = _sequences(Packer(Limits()), examples)
    _check(made, examples, Limits())
    padding = sum(4096 - n for n in (sum(p.length for p in pieces) for pieces in made) if not _power(n))
    assert padding < 0.003 * sum(size for size, _ in examples)
    cut = {p.doc_id for pieces in made for p in pieces if p.doc_tokens <= 4096 and p.length < p.doc_tokens}
    assert len(cut) < 0.05 * len(examples)


TEXTS = [None, "", " ", "a", "\t\n\r x  y", "Don't STOP", "x" * 30, "a<|endoftext|>b <|startoftext|>", "é é ́x", "日本語。日本", "\xa0z y\x1cw"]


def test_encoder_equals_library():
    use, draw = packing.word_encoder(WORDS), random.Random(1)
    parts = ["a", "B", "é", "́", "1", "22", "'s", "'", " ", "\n", "\xa0", ".", "!?", "<|endoftext|>", "|", "日", "。", "ß", "Σ", "🙂", "x" * 90]
    texts = [t or "" for t in TEXTS] + ["".join(draw.choices(parts, k=k)) for k in range(1, 200)]
    # Runs of more characters than are given to the library at once.
    texts += ["".join(draw.choices(["ab1", "z.", "9", "é", "日。日", "<|endoftext|>", "'s", "́"], k=6000)) for _ in range(3)]
    texts += [f"x{chr(c)}y 1{chr(c)}2 .{chr(c)}, {chr(c)}{chr(c)}Z '{chr(c)}'s" for c in [*range(0x250), 0x3A3, 0x1E9E, 0x4E00]]
    texts += ["<|ENDOFTEXT|> <|EndOfText|>", "I'LL WE'RE 'S'T", "!'s _'m__ 'll"]
    for text in texts:
        assert np.frombuffer(use.encode(text), "<u4").tolist() == _library(text), text[:80]
    assert max(map(len, packing._long_parts("ab1." * 100_000))) < 2 * packing.LONG_RUN


def test_a_file_that_keeps_white_space_is_refused():
    with pytest.raises(ValueError):
        packing.WordEncoder(BYTES)


def test_job(spark):
    rows = [(i, text, "x", 1) for i, text in enumerate(TEXTS + ["wort " * 5000, "lang" * 3000])]
    rows += [(None, "no id", "x", 1), (3, "a", "x", 1), (3, "a", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, sequence_id int").repartition(3)
    pieces = packing.pack(docs, WORDS, end_id=2).collect()
    sequences = defaultdict(list)
    for p in pieces:
        assert crc32(bytes(p.ids)) == p.ids_crc32 and len(p.ids) == 4 * p.length
        sequences[p.sequence_id].append(p)
    for held in sequences.values():
        held.sort(key=lambda p: p.offset)
        ends = np.cumsum([p.length for p in held])
        assert [p.offset for p in held] == [0, *ends[:-1]] and ends[-1] <= 4096
    expected = sorted([2 if k == len(ids) else ids[k] for k in range(len(ids) + 1)] for ids in (_library(row[1] or "") for row in rows))
    got, open_ids = [], defaultdict(list)
    for p in sorted(pieces, key=lambda p: (str(p.doc_id), p.start)):
        ids = np.frombuffer(bytes(p.ids), "<u4").tolist()
        if p.length == p.doc_tokens:
            got.append(ids)
        else:
            open_ids[p.doc_id].append((p.start, ids))
    for key, parts in open_ids.items():
        got.append([i for _, ids in sorted(parts) for i in ids])
    assert sorted(got) == expected
    assert packing.pack(docs.limit(0), WORDS, 2).count() == 0


def test_prompts_bear_no_loss(spark):
    turns = spark.createDataFrame([(1, "ask this", False), (2, "answer that", True), (3, "who", None)], "doc_id bigint, text string, answer boolean")
    limits = Limits(tokens=8, segments=2, loss=3)
    rows = packing.pack(turns.coalesce(1), WORDS, 2, limits, cut=False, bears_loss="answer", with_ids=False).collect()
    assert {r.doc_id: r.loss_tokens for r in rows} == {1: 0, 2: 2, 3: 0} and "ids" not in rows[0]
    with pytest.raises(ValueError):
        Limits(tokens=0)
