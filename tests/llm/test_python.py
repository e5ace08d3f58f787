"""Near duplicates, languages, page texts and the pipeline against brute force and held-out rows."""

import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from deckweave.llm import boosting, components, decontaminate, dom, html_text, language, near_dups, quality
from deckweave.llm.components import connected_components

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, nd_k1 string, bucket string, node string"


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", None, "k", "b", "n") for i, t in zip(ids, texts)], DOC)


def text_of(rng, n):
    return [f"w{rng.randint(0, 5000)}" for _ in range(n)]


def varied(rng, words, edits):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"e{rng.randint(0, 10**9)}"
    return words


def plain_similarity(a, b):
    """The definition, term by term."""
    (x, n), (y, m) = a, b
    p, q = dict(zip(x.tolist(), n.tolist())), dict(zip(y.tolist(), m.tolist()))
    total = 0.0
    for i in p.keys() & q.keys():
        total += 1 / sum(max(p.get(j, 0) / p[i], q.get(j, 0) / q[i]) for j in p.keys() | q.keys())
    return total


def test_similarity_by_its_definition():
    rng = random.Random(4)
    for _ in range(60):
        words = text_of(rng, rng.randint(5, 40)) * rng.choice([1, 1, 2])
        other = varied(rng, words, rng.randint(0, 4))
        a, b = near_dups.shingles(" ".join(words)), near_dups.shingles(" ".join(other))
        assert near_dups.similarity(a, b) == pytest.approx(plain_similarity(a, b))
    assert near_dups.similarity(a, near_dups.shingles("")) == 0


def test_sketches_estimate_the_similarity():
    rng = random.Random(6)
    for edits in (0, 3, 10):
        words = text_of(rng, 150) + ["again and again and again"] * 6
        a, b = near_dups.shingles(" ".join(words)), near_dups.shingles(" ".join(varied(rng, words, edits)))
        made = near_dups.sketches([a, b], 4000)
        assert np.mean(made[0] == made[1]) == pytest.approx(plain_similarity(a, b), abs=0.04)
    together = near_dups.sketches([a, b, near_dups.shingles("x")], 64)
    assert (together[:1] == near_dups.sketches([a], 64)).all()


def brute_classes(texts, ids):
    keys = [" ".join(decontaminate_words(t)) or (t or "") for t in texts]
    sets = [near_dups.shingles(" ".join(decontaminate_words(t))) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if (keys[i] and keys[i] == keys[j]) or near_dups.similarity(sets[i], sets[j]) >= near_dups.THRESHOLD:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, doc in enumerate(ids):
        if doc is not None:
            root = find(i)
            least[root] = min(least.get(root, doc), doc)
    return [least.get(find(i)) for i in range(len(texts))]


def decontaminate_words(text):
    import re

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").translate(lower))


def near_texts():
    rng = random.Random(8)
    texts = [None, "", "!!!", "!!!", "???", "one", "One!", "two words", "a b c d e", "A b, c d e."]
    for size in (40, 120, 400):
        for _ in range(6):
            base = text_of(rng, size)
            texts.append(" ".join(base))
            for edits in (0, 1, 1, 2, 3, size // 40, size // 30, size // 20):
                texts.append(" ".join(varied(rng, base, min(edits, size))))
    chain = text_of(rng, 200)  # each similar to the next, the ends are not
    for step in range(8):
        texts.append(" ".join(chain))
        chain = varied(rng, chain, 3)
    shared = text_of(rng, 60)  # one passage in many texts that are no duplicates
    texts += [" ".join(shared + text_of(rng, 40)) for _ in range(25)]
    texts += ["a long passage that repeats itself " * 30, "a long passage that repeats itself " * 31]
    return texts + texts[:14]


def test_classes_by_brute_force(spark):
    texts = near_texts()
    order = list(range(len(texts)))
    random.Random(1).shuffle(order)
    ids = [None if i % 17 == 16 else i for i in order]
    expected = sorted(zip(map(str, ids), map(str, brute_classes(texts, ids))))
    found = near_dups.near_duplicates(frame(spark, texts, ids).repartition(5))
    assert sorted((str(r.doc_id), str(r.class_id)) for r in found.collect()) == expected


def test_one_of_each_class(spark):
    texts = near_texts()
    ids = list(range(len(texts)))
    classes = brute_classes(texts, ids)
    docs = frame(spark, texts, ids)
    docs = docs.unionAll(docs.where("doc_id in (5, 20, 21)"))
    kept = near_dups.one_of_each(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted(row.doc_id for row in rows) == sorted(i for i, c in zip(ids, classes) if i == c)
    assert all(row.text == texts[row.doc_id] and (row.nd_k1, row.bucket, row.node) == ("k", "b", "n") for row in rows)
    assert near_dups.one_of_each(docs.limit(0)).count() == 0
    # One id on two texts of a class: one row stays.
    same = frame(spark, [texts[10], texts[11]], [7, 7])
    assert near_dups.one_of_each(same).count() == (1 if brute_classes(texts[10:12], [7, 8]) == [7, 7] else 2)


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 3), (5, 6), (7, 7), (20, 21), (21, 22), (22, 23), (23, 24), (24, 25), (30, 20)]
    links += [(100, 100 + i) for i in range(1, 40)]
    found = {row.node: row.label for row in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    expected = {n: 1 for n in (1, 2, 3, 9)} | {5: 5, 6: 5} | {n: 20 for n in (20, 21, 22, 23, 24, 25, 30)}
    assert found == expected | {n: 100 for n in range(100, 140)}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_sketching_steps_are_bounded_in_characters(monkeypatch):
    """Every text is in one step, in order; long texts do not add up in one."""
    import pyarrow as pa

    monkeypatch.setattr(near_dups, "SKETCH_CHARS", 100)
    monkeypatch.setattr(near_dups, "SKETCH_ROWS", 4)
    texts = ["x" * n for n in (60, 60, 10, 30, 250, 1, 1, 1, 1, 1, 99, 1)] + ["ü" * 99]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["node", "words"])
    parts = [part.column(1).to_pylist() for part in near_dups.steps(batch)]
    assert sum(parts, []) == texts
    assert all(len(p) <= 4 and (len(p) == 1 or sum(map(len, p)) <= 100) for p in parts)
    assert list(near_dups.steps(batch.slice(0, 0))) == []
    assert near_dups._words()._entries == near_dups.STORE_WORDS


def test_components_take_no_round_more_than_they_change(spark, monkeypatch):
    """Links that one round makes stars are written twice, and scanned twice a round."""
    written = []

    def kept(df, name):
        written.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation"))
        return cut(df, name)

    cut = components.cut_lineage
    monkeypatch.setattr(components, "cut_lineage", kept)
    links = [(1, i) for i in range(2, 9)] + [(11, 10), (None, 4), (5, None), (6, 6)]
    found = {row.node: row.label for row in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {i: 1 for i in range(1, 9)} | {10: 10, 11: 10}
    assert len(written) == 2 and written[1] <= 4


def test_components_of_random_links(spark):
    rng = random.Random(5)
    links = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1040)]
    label = {x: x for a, b in links if a != b for x in (a, b)}
    for _ in label:
        for a, b in links:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    rows = connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert len(rows) == len(label) and {row.node: row.label for row in rows} == label


def plain_viterbi(scores, switch):
    """The best path by trying all, for short texts."""
    from itertools import product

    n, k = scores.shape
    return max(
        (sum(scores[t, p] for t, p in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:])))
        for path in product(range(k), repeat=n)
    )


def test_viterbi_by_brute_force():
    rng = np.random.default_rng(2)
    many = [rng.normal(0, 3, (n, 3)) for n in (0, 1, 2, 7, 5, 7, 1)]
    for scores, path in zip(many, language.viterbi(many, 2.0)):
        assert len(path) == len(scores)
        value = scores[np.arange(len(path)), path].sum() - 2.0 * np.count_nonzero(np.diff(path))
        if len(path):
            assert value == pytest.approx(plain_viterbi(scores, 2.0))


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame(
        [(None, None, None), (100001, "", "en"), (100002, "123 ... ²", "en"), (100003, "the and of", None), (100003, "the and of", None)],
        "doc_id bigint, text string, lang string",
    )
    both = docs.select("doc_id", "text", "lang").unionAll(odd)
    rows = language.predictions(both).join(docs.select("doc_id", "lang"), "doc_id", "left").collect()
    assert len(rows) == docs.count() + 5
    for row in rows:
        assert row.held_out == (row.doc_id is not None and crc32(str(row.doc_id).encode()) % 3 == 1)
        assert 0 <= row.score <= 1
    tested = [row for row in rows if row.held_out and row.lang]
    assert np.mean([row.lang == row.lang_pred for row in tested]) > 0.97
    special = {row.doc_id: row.lang_pred for row in rows if row.doc_id is None or row.doc_id > 100000}
    assert special == {None: "und", 100001: "und", 100002: "und", 100003: "en"}
    # Held-out texts and their languages change nothing.
    hidden = language.held_out()
    changed = both.withColumn("lang", F.when(hidden, "xx").otherwise(F.col("lang")))
    assert sorted(map(str, language.predictions(changed).collect())) == sorted(map(str, language.predictions(both).collect()))
    assert {row.lang_pred for row in language.predictions(both.limit(0)).collect()} == set()


def test_rare_languages_keep_their_words(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_WORDS", 3)
    texts = [("the house of rivers", "en")] * 30 + [("la domo de riveroj", "eo")]
    docs = spark.createDataFrame([(i, *row) for i, row in enumerate(texts)], "doc_id bigint, text string, lang string")
    assert language.learn(docs).languages == ["en", "eo"]


def test_spans_of_mixed_texts_and_scripts(spark):
    counts = {("en", w): 50 for w in "the of and house river".split()} | {("de", w): 50 for w in "der und haus fluss nicht".split()}
    counts |= {("ru", w): 50 for w in "река дом и не что".split()}
    model = language.Model(counts)
    text = "the house of the river and the house. Der Fluss und das Haus und der Fluss nicht. Река и дом, что не река."
    spans = language.language_spans(frame(spark, [text, None, "", "12"]), model).orderBy("start").collect()
    assert [row.lang for row in spans] == ["en", "de", "ru"]
    assert text[spans[1].start : spans[1].end].startswith("Der Fluss") and spans[0].doc_id == 0
    assert int(np.argmax(model.score("дама"))) == model.languages.index("ru")


def test_pages_of_the_tables(spark):
    """On the given pages the article element holds the main text: read it by plain rules."""
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = html_text.learn(pages)
    texts = {row.page_id: row.html for row in pages.collect()}
    right = 0
    for row in html_text.extract(pages, model).collect():
        article = re.search(r"<article>(.*?)</article>", texts[row.page_id], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        right += row.text == "\n\n".join(b for b in blocks if b)
        assert row.n_chars == len(row.text)
    assert right >= 0.98 * len(texts)


@pytest.fixture(scope="module")
def page_model():
    make = html_text.Composer([], seed=1)
    return html_text.fit_pages([html_text.Page(make.page()) for _ in range(900)])


def test_composed_pages_that_were_not_trained_on(page_model):
    """Other layouts with other names, a third of them missing, meaningless or misleading."""
    other = html_text.Composer([], seed=2)
    whole = near = 0
    for _ in range(150):
        page = html_text.Page(other.page())
        wanted = Counter(page.text(np.where(page.labels(), 50.0, -50.0)).split("\n\n"))
        got = Counter(page.text(page_model.margins([page])).split("\n\n"))
        same = sum((wanted & got).values())
        whole += wanted == got
        near += 2 * same >= 0.9 * (sum(wanted.values()) + sum(got.values()))
    assert whole >= 0.6 * 150 and near >= 0.8 * 150


_SAID = "The river had risen during the night, and the lower fields were under water. Nobody could remember it."
_ARTICLE = "<h1>The title of the article</h1>" + "".join(f"<p>{_SAID} Number {i} of them.</p>" for i in range(5))
_NAV = "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>"
_FOOT = "<footer>&copy; 2024 Somebody</footer>"


def _comments(name="", own=""):
    items = "".join(f"<div{own}><b>Anna {k}</b><p>I do not think so at all, thanks.</p></div>" for k in range(4))
    return f"<div{name}>{items}</div>"


@pytest.mark.parametrize("body", [
    f'{_NAV}<div class="content-header-wrap">{_ARTICLE}</div>{_FOOT}',
    f'{_NAV}<div class="page-with-sidebar"><div class="post">{_ARTICLE}</div><aside><p>Read more here</p></aside></div>{_FOOT}',
    f'{_NAV}<div id="legal-news"><article>{_ARTICLE}</article></div>{_FOOT}',
    f'{_NAV}<article>{_ARTICLE}</article>{_comments(" class=user-posts")}{_FOOT}',
    f'{_NAV}<article>{_ARTICLE}</article>{_comments(" class=kommentare", " class=eintrag")}{_FOOT}',
    f"{_NAV}<article>{_ARTICLE}</article>{_comments()}{_FOOT}",
    f'{_NAV}<article>{_ARTICLE}<p hidden>secret words</p><div style="display: none">more <p>secrets</p></div></article>{_FOOT}',
])
def test_names_do_not_decide_alone(page_model, body):
    """Misleading names around articles, names that no training page has, and hidden elements."""
    page = html_text.Page(f"<html><body>{body}</body></html>")
    blocks = page.text(page_model.margins([page])).split("\n\n")
    assert [block for block in blocks if block != "The title of the article"] == [f"{_SAID} Number {i} of them." for i in range(5)]


def test_decoding_is_consistent_and_best():
    from itertools import product

    page = html_text.Page("<div><p>a</p><p>b</p></div><ul><li>c<li>d</ul>e")
    n = len(page.nodes)
    for seed in range(20):
        margins = np.random.default_rng(seed).normal(0, 2, n)
        best, texts = -np.inf, set()
        for kept in product([False, True], repeat=n - 1):
            kept = (True, *kept)
            if any(kept[i] and not kept[page.parents[i]] for i in range(1, n)):
                continue
            value = sum((m if k else 0) - np.logaddexp(0, m) for k, m in zip(kept, margins))
            text = "\n\n".join(page.nodes[i].text[0] for i in range(n) if kept[i] and page.nodes[i].tag == "#")
            if value > best + 1e-9:
                best, texts = value, {text}
        assert page.text(margins) in texts


ODD_PAGES = [None, "", "plain text", "<p>a<p>b", "<script>var x='<p>no</p>'</script><p>yes", "<div", "<a href='x", "< 5 and > 3",
             "<!-- open", "<p title=\"un>closed>text", "</p></div>x", "&amp;&#233;&nbsp;y", "<style>p{}", "<p>" * 3000 + "deep",
             "<div>" * 3000 + "deep", "<table><tr><td>1<td>2<tr><td>3</table>", "<li>1<li>2", "\x00<p>\x00a"]


def test_odd_pages(spark):
    model = html_text.Model({}, boosting.fit(np.zeros((4, len(html_text.FEATURES)), np.float32), np.array([True, True, True, False])))
    pages = spark.createDataFrame([(i, None, h, "t") for i, h in enumerate(ODD_PAGES)], "page_id bigint, url string, html string, text string")
    found = {row.page_id: row.text for row in html_text.extract(pages, model).collect()}
    assert len(found) == len(ODD_PAGES)
    assert (found[0], found[1], found[2], found[3], found[4]) == ("", "", "plain text", "a\n\nb", "yes")
    assert found[11] == "&é y" and found[15] == "1\n\n2\n\n3" and found[16] == "1\n\n2"
    assert dom.parse("<ul><li>a<ul><li>b</ul><li>c</ul>").children[0].tag == "ul"
    assert html_text.extract(pages.limit(0), html_text.learn(pages.limit(0), training_pages=30)).count() == 0


@pytest.mark.parametrize("page, text", [
    ("<html><head><title>x</title><p>article</p>more", ["article", "more"]),
    ("<head><title>x</title><body><p>article", ["article"]),
    ("<head><meta a=b><noscript><p>no</p></noscript></head>article", ["article"]),
    ("<head><title>x</title>article", ["article"]),
    *[(f"<div><p>a</p><{t}>Menu</div><p>b", ["a", "b"]) for t in ("button", "select", "object", "svg", "noscript", "template")],
    *[(f"<{t}>Menu<p>a</p><p>b</p>", ["a", "b"]) for t in ("button", "select", "object", "svg", "noscript", "template")],
    ("<button>Menu<p>a</p><button>Ok</button><p>b", ["a", "b"]),
    ("<p>a <button><div>no</div></button> b</p>", ["a  b"]),
])
def test_unseen_elements_without_an_end(page, text):
    def texts(node):
        return ["".join(node.text)] if node.tag == "#" else [x for child in node.children for x in texts(child)]

    assert [x for x in texts(dom.parse(page)) if x.strip()] == text


def test_pipeline_by_its_parts(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = {row.doc_id for row in quality.verdicts(docs).where("kept").collect()}
    rows = sorted((row for row in docs.collect() if row.doc_id in good), key=lambda r: r.doc_id)
    classes = brute_classes([row.text for row in rows], [row.doc_id for row in rows])
    single = [row.doc_id for row, c in zip(rows, classes) if row.doc_id == c]
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    hit = {row.doc_id for row in decontaminate.hit_digests(docs, benchmark).where("contaminated").collect()}
    expected = sorted(set(single) - hit)
    found = corpus_pipeline.run(spark, folder).collect()
    assert sorted(row.doc_id for row in found) == expected
    assert len(corpus_pipeline.STAGES) == 5
