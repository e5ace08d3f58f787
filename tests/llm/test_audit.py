"""Filter interaction audit against plain counting, order by order."""

import itertools
import random
import re
from collections import Counter, defaultdict

import pytest

from deckweave.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _plain(docs, labels):
    """Every order applied step by step to the documents themselves."""
    good = {i for i, quality, _ in labels if quality == 1 and i is not None}
    toxic = {i for i, _, toxic in labels if toxic == 1 and i is not None}
    seen = defaultdict(set)
    for doc_id, text, _ in docs:
        if doc_id is not None:
            seen[text or ""].add(doc_id)
    failed = []
    for doc_id, text, _ in docs:
        text = text or ""
        words = WORD.findall(text)
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text):
            fails.add("C")
        if re.search("[#$%&*|]", text):
            fails.add("D")
        if doc_id is not None and min(seen[text]) < doc_id:
            fails.add("E")
        failed.append(fails)
    rows, shares = {}, Counter()
    for part in {row[2] or "" for row in docs}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [i for i, row in enumerate(docs) if (row[2] or "") == part]
            gone = []
            for step, name in enumerate(order, 1):
                out = [i for i in left if name in failed[i]]
                left = [i for i in left if name not in failed[i]]
                shares[part, name] += len(out)
                rows[part, order, step] = (
                    len(left), len(out), sum(name in failed[i] for i in gone),
                    sum(failed[i] == {name} for i, row in enumerate(docs) if (row[2] or "") == part),
                    sum(docs[i][0] in good for i in out), sum(docs[i][0] in toxic for i in out),
                )
                gone += out
    return {(*key, *value, shares[key[0], key[1][key[2] - 1]]) for key, value in rows.items()}


def _documents():
    draw = random.Random(5)
    texts = [None, "", " \t\r\n", "A", "a $", "\x1c \x85 \xa0", "Ä " * 300, "wort " * 250, "LOUD " * 220 + "&"]
    texts += [" ".join(f"w{draw.randrange(k * 60)}{draw.choice(['', 'X', '#'])}" for _ in range(k * 40)) for k in range(1, 12)]
    rows = [(i, draw.choice(texts), draw.choice(["one", "two", "", None])) for i in range(150)]
    # Repeated rows, ids on several texts, and rows without an id.
    return rows + rows[:9] + [(3, "a $", "two"), (3, None, "one"), (None, "", "two"), (None, "a $", None), (None, "a $", None)]


LABELS = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 150, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (900, 1, 1)]


def test_audit_equals_plain_counting(spark):
    docs = _documents()
    frame = spark.createDataFrame([(*row, "x", 1, 2) for row in docs], "doc_id bigint, text string, source string, part string, code int, good int")
    labels = spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")
    rows = filter_audit.audit_documents(frame.repartition(5), labels).collect()
    assert len(rows) == 3 * 600 and {tuple(row) for row in rows} == _plain(docs, LABELS)


def test_no_rows_and_no_labels(spark):
    docs = spark.createDataFrame([(1, "a", None)], "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit_documents(docs.limit(0), labels).count() == 0
    assert {tuple(row) for row in filter_audit.audit_documents(docs, labels).collect()} == _plain([(1, "a", None)], [])


def test_a_long_text_is_one_row(spark):
    text = "Alpha beta " * 500_000 + "#"
    docs = spark.createDataFrame([(1, text, "s")], "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert {tuple(row) for row in filter_audit.audit_documents(docs, labels).collect()} == _plain([(1, text, "s")], [(1, 1, 1)])


@pytest.mark.parametrize("code", [0, 1, 2, 4, 8, 16, 18, 31])
def test_every_cell_is_found_by_its_bits(spark, code):
    counts = spark.createDataFrame([("p", code, 7, 3, 2)], "part string, code int, n bigint, good bigint, toxic bigint")
    rows = filter_audit.audit(counts).where("filter_order = 'ABCDE'").collect()
    first = next((k + 1 for k in range(5) if code >> k & 1), None)
    assert {row.step: row.removed for row in rows} == {k: 7 * (k == first) for k in range(1, 6)}
