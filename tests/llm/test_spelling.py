"""Spelling groups against every pair of words compared."""

import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from deckweave.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def _edits(word):
    """All that one edit makes of a word, from its own letters and a few others."""
    letters = "abcdeéà"
    made = {word[:i] + word[i + 1 :] for i in range(len(word))}
    made |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    made |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}
    return made - {word}


def _one_apart(one, two):
    if len(one) > len(two):
        one, two = two, one
    if len(one) == len(two):
        return sum(x != y for x, y in zip(one, two)) == 1
    return len(one) + 1 == len(two) and any(two[:i] + two[i + 1 :] == one for i in range(len(two)))


def _plain(counts):
    near = {w: [v for v in counts if _one_apart(w, v)] for w in counts}
    form = {}
    for word, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[word] = best if best is not None and counts[best] >= 2 * counts[word] else None
    rows = set()
    for word in counts:
        root = word
        while form[root] is not None:
            root = form[root]
        held = form[word]
        rows.add((word, held, root, counts[word], len(near[word]), None if held is None else counts[held]))
    return rows


def _groups(spark, counts, **options):
    words = spark.createDataFrame(sorted(counts.items()), "word string, n bigint").repartition(3)
    found = [tuple(row) for row in spelling.groups(words, **options).collect()]
    assert len(found) == len(counts)
    return set(found)


def _vocabulary(seed, size):
    draw = random.Random(seed)
    words = {"".join(draw.choices("abcdeéà", k=draw.choice([5, 5, 6, 6, 7, 9]))) for _ in range(size // 3)}
    for word in sorted(words):
        words |= set(draw.sample(sorted(_edits(word)), 2))
    words |= {"x" * k for k in (5, 6, 7, 300, 301, 302)} | {"y" * 300 + "a", "y" * 300 + "b", "z" * 4000, "z" * 3999 + "a", "×÷×÷×", "×÷×÷÷"}
    words = {word for word in words if len(word) >= 5}
    return {word: draw.choice([3, 3, 4, 6, 8, 8, 16, 33, 70]) for word in sorted(words)}


@pytest.mark.parametrize("part_words", [spelling.PART_WORDS, 5])
def test_groups_equal_all_pairs(spark, part_words):
    counts = _vocabulary(1, 450)
    assert _groups(spark, counts, part_words=part_words) == _plain(counts)


def test_chains_end_at_their_root(spark):
    words = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb", "bbbbbb", "bbbbbbb", "bbbbbbbb"]
    counts = {word: 3 * 2**i for i, word in enumerate(words)}
    found = _groups(spark, counts)
    assert found == _plain(counts) and {row[2] for row in found} == {words[-1]}


def test_one_bucket_of_many_words(spark, monkeypatch):
    """Words of the same letters are one bucket: parts meet each other and lose no pair."""
    base = "aabbccdd"
    draw = random.Random(4)
    words = {"".join(draw.sample(base, 8)) for _ in range(250)} | {"aabbccd", "aabbccdda", "aabbccde"}
    counts = {word: draw.randrange(3, 40) for word in sorted(words)}
    assert _groups(spark, counts, part_words=40) == _plain(counts)


def test_blocks_hold_whole_groups(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(spelling, "BLOCK_WORDS", 10)
    sizes = [3, 4, 2, 25, 1, 1, 9, 30, 2]
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    n = len(bucket)
    zeros = np.zeros(n, np.int64)
    rows = pa.RecordBatch.from_arrays(
        [pa.array(bucket), pa.array(zeros), pa.array(zeros), pa.array(zeros), pa.array(zeros), pa.array([f"wörd{'a' * (i % 3)}" for i in range(n)]), pa.array(zeros)],
        names=["bucket", "low", "high", "part", "role", "word", "n"],
    )
    for step in (1, 7, n):
        parts = [rows.slice(i, step) for i in range(0, n, step)]
        blocks = [set(block.bucket.tolist()) for block in spelling._blocks(iter(parts))]
        assert sorted(b for block in blocks for b in block) == list(range(len(sizes)))


def test_one_edit():
    assert spelling.one_edit("abcde", "abxde") == ord("c") and spelling.one_edit("abxde", "abcde") == ord("x")
    assert spelling.one_edit("abcd", "abccd") == ord("c") == spelling.one_edit("abccd", "abcd")
    assert {spelling.one_edit(*p) for p in [("abcd", "abdc"), ("abcd", "abcd"), ("ab", "abcd"), ("abc", "xabd")]} == {-1}


def test_counts_of_words(spark):
    texts = ["Wörter wörter WÖRTER Wœrter", None, "", "aaaaa1aaaaa_aaaaa-aaaa", "straße×straße ÷ŸÿÀ" * 3, "naïve " * 400]
    draw = random.Random(2)
    texts += [" ".join(draw.choices(["letters", "Letters", "mots", "façade", "facade", "wordsworth"], k=200)) for _ in range(40)]
    rows = [(i, text, "x", 1) for i, text in enumerate(texts)] + [(None, "letters letters", "x", 1), (7, texts[7], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, word string, n int").repartition(4)
    for every in (None, 97):
        expected = Counter()
        for key, text, *_ in rows:
            for run in RUN.findall(text or ""):
                run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
                code = crc32(f"{'' if key is None else key}:{run}".encode())
                if every and code % every == 0:
                    run = run[: code % len(run)] + run[code % len(run) + 1 :]
                expected[run] += 1
        kept = {(w, n) for w, n in expected.items() if len(w) >= 5 and n >= 3}
        assert {tuple(r) for r in spelling.word_counts(docs, drop_every=every).collect()} == kept
    assert spelling.spelling_groups(docs.limit(0)).count() == 0
