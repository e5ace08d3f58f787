"""Quality rules, decontamination, URL filters and secret scans against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from deckweave.llm import decontaminate, quality, secret_forest, url_templates

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, words string, stats string, key string, id string, found string"


def frame(spark, texts, langs=("en",)):
    rows = [(i, text, langs[i % len(langs)], f"s{i % 2}", None, "row", "w", None, "k", "i", "f") for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def hits(text, items):
    words, covered, found = words_of(text), set(), set()
    for item, item_text in items:
        parts = words_of(item_text)
        size = min(10, len(parts))
        grams = {tuple(parts[i : i + size]) for i in range(len(parts) - size + 1)} if parts else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in grams:
                covered.update(range(i, i + size))
                if item is not None:
                    found.add(item)
    return len(words), covered, found


VOCABULARY = ["alpha", "Beta", "GAMMA", "délta", "É", "x1", "2", "kappa-lambda", "MÜ"]


def test_hits_by_brute_force(spark):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choices(VOCABULARY, k=k))) for i, k in enumerate([1, 2, 3, 5, 9, 10, 11, 15, 30])]
    items += [(20, items[6][1]), (None, items[7][1] + " tail"), (6, items[6][1]), (21, None), (22, ""), (23, "... --")]
    texts = [None, "", "...", "alpha"] + [
        " ".join(rng.choices(VOCABULARY, k=rng.randint(1, 30)) + (words_of(rng.choice(items[:9])[1]) if i % 3 else []) * rng.randint(1, 2))
        for i in range(60)
    ]
    docs = frame(spark, texts + texts[:8])
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    expected = []
    for i, text in enumerate(texts + texts[:8]):
        n, covered, found = hits(text, items)
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        expected.append((i, n, len(covered), len(found), digest, bool(covered)))
    assert sorted(map(tuple, decontaminate.hit_digests(docs, benchmark).collect())) == expected
    # Beyond the bound of the broadcast there are several passes, with the same rows.
    bound, decontaminate.BROADCAST_WINDOWS = decontaminate.BROADCAST_WINDOWS, 20
    try:
        passes = decontaminate.hit_digests(docs, benchmark)
        assert passes._jdf.queryExecution().optimizedPlan().toString().count("posexplode") > 2
        assert sorted(map(tuple, passes.collect())) == expected
    finally:
        decontaminate.BROADCAST_WINDOWS = bound
    kept = decontaminate.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(row.doc_id for row in kept.collect()) == [row[0] for row in expected if not row[5]]


def test_long_texts_take_time_in_proportion(spark):
    """Half a million words in one row: each window is looked up, none is copied with its text."""
    rng = random.Random(6)
    words = [f"w{rng.randrange(5000)}" for _ in range(500_000)]
    items = [(1, " ".join(words[1000:1015])), (2, " ".join(words[-10:])), (3, "never there at all")]
    docs = frame(spark, [" ".join(words), "short"])
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.find_hits(docs, benchmark)
    row = found.where("n_words > 1").first()
    assert (row.n_words, row.n_hit, row["items"]) == (500_000, 25, [1, 2])
    assert [tuple(s) for s in row.spans] == [(1000 + i, 10) for i in range(6)] + [(499_990, 10)]
    # Nothing is shuffled before the lookup, and Spark adds no test that writes all steps out in one.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter (size(concat" not in plan


def test_spans_are_removed(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    docs = frame(spark, [f"Before it, {passage.upper()}! After.", "Clean one.", None, "", passage])
    benchmark = spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    cleaned = decontaminate.decontaminate(docs, benchmark, remove="spans")
    assert [row.text for row in cleaned.orderBy("doc_id").collect()] == ["Before it! After.", "Clean one.", None, "", ""]
    assert cleaned.columns == docs.columns
    nothing = benchmark.limit(0)
    assert decontaminate.decontaminate(docs, nothing).count() == 5
    assert decontaminate.decontaminate(docs.limit(0), benchmark).count() == 0


def base_of(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {i + k for i in range(len(words) - 4) for k in range(5) if grams[tuple(words[i : i + 5])] > 1}
    symbols = sum(c in "#*$%&|<>" for c in text)
    n = len(words)
    failed = n < 10 or 100 * len(repeated) > 20 * n
    return n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(repeated), failed


def plain_texts(n, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(400)]
    return [" ".join(rng.choices(vocabulary, k=rng.randint(30, 90))) for _ in range(n)]


def test_base_statistics_by_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t ", "a b c d e", "a b c d e a b c d e", "x\n\n x \nx\x0b", "é# * | <b>", "a\x1fb c\x85d", "one two\n" * 30]
    texts += ["".join(rng.choices(["a", "b", " ", "\n", "#", "é"], k=rng.randint(1, 120))) for _ in range(60)]
    docs = frame(spark, texts)
    found = {row.doc_id: tuple(row)[1:7] for row in quality.verdicts(docs).collect()}
    assert found == {i: base_of(text) for i, text in enumerate(texts)}


def test_outliers_are_rejected_by_group(spark):
    clean = plain_texts(700)
    odd = [re.sub(" ", "### ", text) for text in plain_texts(30, 7)]
    docs = frame(spark, clean + odd, ("en", None))
    found = {row.doc_id: row for row in quality.verdicts(docs).collect()}
    assert sum(found[i].kept for i in range(700)) >= 697
    assert not any(found[i].kept for i in range(700, 730))
    again = {row.doc_id: row for row in quality.verdicts(docs.repartition(7, "text")).collect()}
    assert again == found
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert {row.doc_id for row in kept.collect()} == {i for i, row in found.items() if row.kept}


def in_lines(words, size=9):
    return "\n".join(" ".join(words[i : i + size]) for i in range(0, len(words), size))


def test_copied_lines_and_repeated_words_are_outliers_alone(spark):
    clean = [in_lines(text.split()) for text in plain_texts(400)]
    # Short copies between longer lines: no window of five words occurs twice.
    lines = [in_lines(text.split()).split("\n") for text in plain_texts(10, 21)]
    copied = ["\n".join(part for line in text for part in ("Read on", line)) for text in lines]
    repeating = [text.split() for text in plain_texts(20, 22)]
    repeating = [in_lines(words[:60] + words[:5]) for words in repeating if len(words) >= 60]
    assert len(repeating) > 3
    found = {row.doc_id: row for row in quality.verdicts(frame(spark, clean + copied + repeating)).collect()}
    assert not any(found[i].base_failed for i in range(len(found)))
    assert all(found[i].n_repeat_words == 0 for i in range(400, 410))
    assert all(found[i].n_dup_lines == 0 for i in range(410, len(found)))
    assert sum(found[i].kept for i in range(400)) >= 398
    assert not any(found[i].kept for i in range(400, len(found)))


def test_small_groups_are_judged_by_larger_ones(spark):
    odd = re.sub(" ", "### ", plain_texts(1, 7)[0])
    clean = [(text, "en", "large") for text in plain_texts(260)]
    # A small source of a large language, and a small language: neither has an estimate of its own.
    small = [(odd, "en", "small"), (odd, "eo", "large")] + [(text, lang, "small") for text in plain_texts(5, 8) for lang in ("en", "eo")]
    docs = spark.createDataFrame([(i, *row) for i, row in enumerate(clean + small)], "doc_id bigint, text string, lang string, source string")
    found = {row.doc_id: row for row in quality.verdicts(docs).collect()}
    assert len(found) == 272 and all(row.distance is not None for row in found.values())
    assert not found[260].kept and not found[261].kept
    assert all(found[i].kept for i in range(262, 272))


def test_a_repeated_line_is_no_outlier(spark):
    """One boilerplate line twice in a text of usual length, among texts without any."""
    texts = plain_texts(500)
    clean = [in_lines((texts[i] + " " + texts[i + 250]).split()) for i in range(250)]
    line = "all rights reserved by the owners of this page"
    twice = [f"{line}\n{text}\n{line}" for text in clean[:60]]
    found = {row.doc_id: row for row in quality.verdicts(frame(spark, clean + twice)).collect()}
    assert all(found[i].n_dup_lines == 1 and found[i].n_repeat_words >= 18 for i in range(250, 310))
    left = [row for row in found.values() if not row.base_failed]
    assert len(left) > 290 and sum(row.kept for row in left) >= 0.99 * len(left)


def test_the_estimate_is_near_the_least_determinant(spark):
    """On 60 texts, a third of them odd: no subset of three quarters found by many random starts is tighter."""
    draw = np.random.default_rng(4)
    texts = plain_texts(45) + [re.sub(" ", "## ", text) for text in plain_texts(15, 3)]
    docs = frame(spark, texts)
    scored = quality.cut_lineage(
        quality.with_statistics(docs.select("text")).select(F.lit("=a").alias("lang_key"), F.lit("=b").alias("source_key"), "stats"), "scored"
    )
    groups = quality.cut_lineage(quality._groups(scored, "stats"), "groups")
    found = quality.estimates(scored, "stats", groups).first()
    rows = np.array([tuple(r) for r in scored.where(~quality.base_failed("stats")).select(*quality._vector("stats")).collect()])
    floor = np.array([[quality._floor(max(i, j), min(i, j)) for j in range(4)] for i in range(4)])
    size = math.ceil(quality.SUBSET * len(rows))

    def concentrated(chosen):
        for _ in range(20):
            part = rows[chosen]
            mean, cov = part.mean(axis=0), np.cov(part.T, bias=True) + floor
            off = rows - mean
            chosen = np.argsort(np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off), kind="stable")[:size]
        return np.linalg.slogdet(cov)[1]

    best = min(concentrated(draw.choice(len(rows), 5, replace=False)) for _ in range(300))
    # The three levels hold the same texts here, so that nothing is drawn anywhere.
    assert found.logdet <= best + 0.1


def test_a_concentration_step_joins_the_estimates_alone(spark, monkeypatch):
    """A step reads the written vectors and the last estimates, and its change needs no join."""
    joins, cut = [], quality.cut_lineage

    def kept(df, name):
        joins.append((name, df._jdf.queryExecution().optimizedPlan().toString().count("Join ")))
        return cut(df, name)

    monkeypatch.setattr(quality, "cut_lineage", kept)
    found = quality.verdicts(frame(spark, plain_texts(40) + ["## " * 30, None], ("en", "de"))).collect()
    assert len(found) == 42 and [name for name, _ in joins].count("vectors") == 1
    first, *steps, shrunk, last = [n for name, n in joins if name == "estimates"]
    assert first == 1 and steps and set(steps) == {1}


def test_few_texts_are_judged_as_well(spark):
    docs = frame(spark, plain_texts(20) + ["### " * 40])
    assert [row.kept for row in quality.verdicts(docs).orderBy("doc_id").collect()] == [True] * 20 + [False]
    assert quality.verdicts(docs.limit(0)).count() == 0


@pytest.mark.parametrize("p", [0.5, 0.9, 0.9999])
def test_quantiles_of_the_chi_squared_distribution(p):
    rng = random.Random(3)
    q = quality.chi_squared_quantile(p, 4)
    share = sum(sum(rng.gauss(0, 1) ** 2 for _ in range(4)) <= q for _ in range(40_000)) / 40_000
    assert abs(share - p) < 0.01


URLS = [
    None, "", "no scheme/path", "http://", "http://Example.ORG", "http://example.org/es/1", "https://a.example.org/en/12?x=1",
    "https://badexample.org/es/1", "http://x.com/fr/1#t", "http://x.com/de/2", "http://x.com", "http://x.net/en/3/",
    "x://y://z/a", "http://org/q", "http://h.net/?u=http://x.com/fr/", "http://x.com#/fr/",
]


def parts_of(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host) :]).group()


def test_hosts_paths_and_rules_by_brute_force(spark):
    rows = [(i, url, "v", 1) for i, url in enumerate(URLS + URLS[:3])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, verdict string, rate int")
    for row in url_templates.judge(pages).collect():
        host, path = parts_of((URLS + URLS[:3])[row.page_id])
        fitting = [r for r in url_templates.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fitting, key=lambda r: len(r.text), default=None)
        assert (row.host, row.path, row.rule) == (host, path, best.text if best else None)
        if best:
            assert row.verdict == best.verdict
    assert url_templates.judge(pages.limit(0)).count() == 0


def test_templates_are_rejected_by_their_labels(spark):
    rows = []
    for i in range(400):
        section = ("news", "casino", "about")[i % 3]
        labelled = i < 300
        rows.append((i, f"http://h.net/{section}/{i}.html", (section == "casino") if labelled else None))
    rows += [(1000 + i, f"http://other.net/p/{i}", None) for i in range(50)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, bad boolean")
    expected = {i: "block" if "casino" in url else "allow" for i, url, _ in rows}
    for bound in (url_templates.BROADCAST_TEMPLATES, 0):
        before, url_templates.BROADCAST_TEMPLATES = url_templates.BROADCAST_TEMPLATES, bound
        try:
            found = url_templates.judge(pages, rules=(), label=F.col("bad")).collect()
        finally:
            url_templates.BROADCAST_TEMPLATES = before
        assert {row.page_id: row.verdict for row in found} == expected
    templates = {row.template for row in found if row.host == "h.net"}
    assert {"news/*/", "casino/*/"} <= templates | {"news/*/", "casino/*/"} and all("{n}" not in t for t in templates)


def test_a_small_branch_of_a_large_host_stays(spark):
    """60 sections of 100 pages each; one has bad labels only, and a few more pages without any."""
    rows = []
    for i in range(6000):
        section, labelled = i % 60, i % 7 != 0
        rows.append((i, f"http://big.net/s{chr(97 + section // 26)}{chr(97 + section % 26)}/{i}", section == 17 if labelled else None))
    pages = spark.createDataFrame(rows, "page_id bigint, url string, bad boolean")
    found = url_templates.judge(pages, rules=(), label=F.col("bad")).collect()
    assert {row.page_id for row in found if row.verdict == "block"} == set(range(17, 6000, 60))
    assert len({row.template for row in found}) < 10


def secret_texts(n):
    rng = random.Random(9)
    hexa = lambda k: "".join(rng.choices("0123456789abcdef", k=k))
    texts, secrets = [], []
    for i, text in enumerate(plain_texts(n, 11)):
        kind = i % 6
        value = hexa(40)
        added = {
            0: f'token = "{value}"', 1: "".join(rng.choices("0123456789", k=16)), 2: f"{rng.randint(10, 99)}@mail{i % 9}.example.com",
            3: f"commit {hexa(40)}", 4: "", 5: f"see /usr/share/doc{i}/readme-text.txt",
        }[kind]
        texts.append(f"{text[:80]} {added} {text[80:]}")
        secrets.append(value if kind == 0 else None)
    return texts, secrets


def test_secrets_are_found_and_replaced(spark):
    texts, secrets = secret_texts(300)
    texts += [None, "", 'again token = "' + secrets[0] + '" and token = "' + secrets[6] + '"']
    secrets += [None, None, None]
    docs = frame(spark, texts)
    found = secret_forest.findings(docs).collect()
    true = {(row.doc_id, row.value_sha256) for row in found if row.is_secret}
    wanted = {(i, hashlib.sha256(s.encode()).hexdigest()) for i, s in enumerate(secrets) if s}
    wanted |= {(302, hashlib.sha256(secrets[i].encode()).hexdigest()) for i in (0, 6)}
    assert true == wanted
    for row in found:
        value = texts[row.doc_id][row.start : row.start + row.n_chars]
        assert hashlib.sha256(value.encode()).hexdigest() == row.value_sha256
    assert len(found) > len(true)
    cleaned = secret_forest.redact(docs)
    assert cleaned.columns == docs.columns
    expected = [t if t is None else re.sub('token = "[0-9a-f]{40}"', 'token = "[SECRET]"', t) for t in texts]
    assert [row.text for row in cleaned.orderBy("doc_id").collect()] == expected


FORMS = [
    ("export API_KEY=abcd1234abcd1234ef", "abcd1234abcd1234ef", "export API_KEY="),
    ("https://x.io/cb?token=abc123abc123abc123&a=1", "abc123abc123abc123", "?token="),
    ('password = "Tr0ub4dor&3xyz"', "Tr0ub4dor&3xyz", 'password = "'),
    ('db_password = "correcthorsebattery"', "correcthorsebattery", 'db_password = "'),
    ("/".join(["path"] * 30) + "/API_KEY=abcd1234abcd1234ef", "abcd1234abcd1234ef", "API_KEY="),
    ("AWS_S3_SECRET_ACCESS_KEY=abcd1234abcd1234ef+/", "abcd1234abcd1234ef+/", "AWS_S3_SECRET_ACCESS_KEY="),
    ('{"access_token": "abcdEFGH12"}', "abcdEFGH12", '"access_token": "'),
    ("Authorization: Bearer eyJhbGciOi.J9x", "eyJhbGciOi.J9x", "Authorization: Bearer "),
    ("value YWJjZGVmZ2hpamtsbW5vcA0=.", None, ""),
    ("x" * 100 + "1", "x" * 100 + "1", ""),
]


def test_candidates_are_values_without_their_names(spark):
    docs = spark.createDataFrame([(i, form[0]) for i, form in enumerate(FORMS)], "doc_id bigint, text string")
    found, name = secret_forest.candidates(docs)
    rows = found.select("doc_id", f"{name}.*").collect()
    for row in rows:
        assert FORMS[row.doc_id][0][row.start : row.start + len(row.value)] == row.value
        assert FORMS[row.doc_id][0][: row.start].endswith(row.before)
    for i, (_, value, before) in enumerate(FORMS):
        if value is not None:
            assert any(row.doc_id == i and row.value == value and row.before.endswith(before) for row in rows), i


def test_words_of_all_texts_are_counted(spark):
    # One text in many copies, and a small language behind it.
    texts = [("common words of the first language", "en")] * 3000 + [("vortoj de malgranda lingvo", "eo")]
    docs = spark.createDataFrame([(i, *row) for i, row in enumerate(texts)], "doc_id bigint, text string, lang string")
    assert {"common", "language", "vortoj", "malgranda"} <= set(secret_forest.Language(docs).words)


def test_secrets_in_other_forms_are_found(spark):
    rng = random.Random(31)
    draw = lambda k, letters="abcdefghijkmnpqrstuvwxyzABCDEFGHJK0123456789": "".join(rng.choices(letters, k=k))
    forms = ("password: {}", "Authorization: Bearer {}", "export API_KEY={}", "https://b.org/in?access_token={}&b=2", '{{"secret": "{}"}}')
    secrets = [draw(rng.randint(24, 40)) for _ in range(60)]
    texts = [forms[i % len(forms)].format(value) for i, value in enumerate(secrets)]
    keys = ["AKIA" + draw(16, "ABCDEFGHIJKLMNOP234567") for _ in range(10)]
    texts += [f"then {value} follows" for value in keys]
    harmless = [f"commit {draw(40, '0123456789abcdef')}" for _ in range(20)] + ["the secret: everything about it"] * 5
    docs = frame(spark, secret_texts(120)[0] + texts + harmless)
    found = {row.doc_id: row for row in secret_forest.findings(docs).where("is_secret").collect()}
    right = [i for i, value in enumerate(secrets + keys, 120) if i in found and found[i].value_sha256 == hashlib.sha256(value.encode()).hexdigest()]
    assert len(right) >= 0.9 * 70
    assert not any(i in found for i in range(190, 215))


def test_no_candidates(spark):
    docs = frame(spark, [None, "", "plain"])
    assert secret_forest.findings(docs).count() == 0
    assert [row.text for row in secret_forest.redact(docs).orderBy("doc_id").collect()] == [None, "", "plain"]
    assert secret_forest.redact(docs.limit(0)).count() == 0


HELD_OUT_SECRETS = (
    "postgres://app:{}@db.example.net/main", "pw={}", 'connect(user="me", password="{}")', 'AUTH_TOKEN: "{}"',
    "curl -H 'X-Auth-Token: {}' https://a.example", "client_secret => '{}'", "redis-cli -a x --secret {}=", "set PRIVATE_KEY={}",
)
HELD_OUT_HARMLESS = (
    '<script integrity="sha384-{}"></script>', '<img src="data:image/png;base64,{}{}{}">', 'API_KEY_HEADER2 = "X-Api-Key2-Header"',
    'author = "Maximilian1987"', "Build {} finished, md5 {}", "see https://b.example/wiki/Some_long_page_title_2024", "the token is described below, see chapter12",
)


def test_forms_that_were_not_trained_on(spark):
    """Other forms of secrets and of what only looks like one than those that the forest is composed of."""
    rng = random.Random(8)
    draw = lambda k: "".join(rng.choices("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789", k=k))
    secrets = [draw(rng.randint(20, 40)) for _ in range(6 * len(HELD_OUT_SECRETS))]
    texts = [HELD_OUT_SECRETS[i % len(HELD_OUT_SECRETS)].format(value) for i, value in enumerate(secrets)]
    harmless = [form.format(*[draw(44) for _ in range(3)]) for form in HELD_OUT_HARMLESS for _ in range(6)]
    docs = frame(spark, secret_texts(120)[0] + texts + harmless)
    found = secret_forest.findings(docs).where("is_secret").collect()
    true = {(row.doc_id, row.value_sha256) for row in found}
    right = sum((i, hashlib.sha256(value.encode()).hexdigest()) in true for i, value in enumerate(secrets, 120))
    false = sorted(row.doc_id for row in found if row.doc_id >= 120 + len(texts))
    missed = [texts[i][:40] for i, value in enumerate(secrets) if (120 + i, hashlib.sha256(value.encode()).hexdigest()) not in true]
    assert right >= 0.85 * len(secrets), missed
    assert len(false) <= 0.05 * len(harmless), sorted({harmless[i - 120 - len(texts)] for i in false})


def test_offsets_of_many_candidates(spark):
    """Twenty thousand candidates in one text, at the places where they stand."""
    rng = random.Random(1)
    parts, starts, at = [], [], 0
    for i in range(20_000):
        gap = "é " * rng.randint(1, 3)
        value = f"{i:05d}" + "a1b2c3d4e5f6g7"
        starts.append(at + len(gap))
        parts += [gap, value]
        at += len(gap) + len(value)
    found, name = secret_forest.candidates(frame(spark, ["".join(parts), "none", None]))
    rows = found.select(f"{name}.place", f"{name}.start", f"{name}.value").orderBy("place").collect()
    assert [row.start for row in rows] == starts and [row.value for row in rows] == parts[1::2]
