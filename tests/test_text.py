import html
import random
from decimal import ROUND_HALF_UP, Decimal
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from deckweave import schemas
from deckweave.functions import numbers, text

PAGES = {
    "several lines": '<p>\nvar cardsjson = [\n {"id": "1", "nEN": "A"},\n {"id": 2, "p1a": 1.5}\n];\n</p>',
    "no array": "<p>a card</p>",
    "broken": 'var cardsjson = [{"id": ];',
    "trailing comma": 'var cardsjson = [{"id": "1"},];',
    "empty": "var cardsjson = [];",
    "bracket in text": 'var cardsjson = [{"id": "1", "nEN": "x];y"}];',
    "first of two": 'var cardsjson = [{"id": "1"}]; var cardsjson = [{"id": "2"}];',
    "never ends": 'var cardsjson = [{"id": "1"}]',
    "single quotes": "var cardsjson = [{'id': '1'}];",
    "control character": 'var cardsjson = [{"id": "1\n2"}];',
    "null page": None,
}


def test_embedded_rows(spark):
    pages = spark.createDataFrame(list(PAGES.items()), "kind string, html string")
    rows = pages.select("kind", F.inline(text.embedded_rows("html", schemas.MARKET_ROW)))
    got = {}
    for row in rows.collect():
        got.setdefault(row.kind, []).append((row.id, row.nEN, row.p1a))
    assert got == {
        "several lines": [("1", "A", None), ("2", None, "1.5")],
        "first of two": [("1", None, None)],
    }


def test_unescape_matches_the_standard_library(spark):
    texts = ["a &amp; b", "&eacute;&#233;&#xe9;", "&amp;quot;", "no entity", "&unknown;", "&ampx", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.u for r in df.select("i", text.unescape_html("t").alias("u")).orderBy("i").collect()]
    assert got == [None if t is None else html.unescape(t) for t in texts]


def _browser_fixed(value: float, digits: int) -> str:
    exact = Decimal(value).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)
    return f"{exact:f}"


@pytest.mark.parametrize("digits", [1, 2])
def test_fixed_rounds_the_exact_value(spark, digits):
    values = [0.0, 1.005, 0.125, 0.375, -0.125, 0.25, 0.35, 0.05, 2.675, 1234567.125, 99.995, 1e-9, -2.5, 12.25]
    values += [i / 16 for i in range(-40, 40)] + [i / 100 for i in range(0, 200, 7)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for row in df.select("v", numbers.fixed(F.col("v"), digits).alias("t")).collect():
        assert row.t == _browser_fixed(row.v, digits), row


def test_texts_of_the_view(spark):
    # 0.8765 * 100 is 87.64999… in double, so the browser shows 87.6.
    df = spark.sql("""
        SELECT * FROM VALUES
          (0.8765D, 'Pokémon', array('Basic', 'EX'), 'Ann', 1.5D),
          (NULL, 'Trainer', array(), '', NULL),
          (0.0D, NULL, array('x'), NULL, 0.125D)
        AS t(score, kind, subs, artist, price)""")
    rows = df.select(
        text.percent_match(F.col("score")),
        text.type_line(F.col("kind"), F.col("subs")),
        text.or_default(F.col("artist"), "Unknown"),
        text.money_text(F.col("price")),
    ).collect()
    assert [tuple(r) for r in rows] == [
        ("87.6% Match", "Pokémon - Basic, EX", "Ann", "$1.50 (Market)"),
        (None, "Trainer - ", "Unknown", None),
        ("0.0% Match", None, "Unknown", "$0.13 (Market)"),
    ]


def test_composed_addresses(spark):
    row = spark.range(1).select(
        text.image_url(F.lit("https://x/1")),
        text.image_url(F.lit(None).cast("string")),
        text.image_url(F.lit("a"), "high", "webp", "%s_%s.%s"),
        text.image_path(F.lit("2024-01-02"), F.lit("s1"), F.lit("c1")),
        text.number_line(F.lit("4"), F.lit(102)),
        text.variation_url(F.lit("alta"), numbers.period_code(F.lit("semana"))),
        text.url_parameter(F.lit("https://x/?a=1&b=&c=3"), "c"),
        text.url_parameter(F.lit("not an address"), "c"),
        text.data_url_bytes(F.lit("data:image/png;base64,aGk=")),
    ).first()
    assert list(row[:8]) == [
        "https://x/1/low.png",
        None,
        "a_high.webp",
        "images/2024-01-02_s1_c1_low.png",
        "4/102",
        "https://www.ligapokemon.com.br/?view=cards/variacao&show=alta&formato=&order=2",
        "3",
        None,
    ]
    assert bytes(row[8]) == b"hi"


def test_numbers(spark):
    nan = float("nan")
    df = spark.createDataFrame(
        [(0.25, 0.0, 2.0), (0.35, nan, 0.0), (1.15, None, None), (-0.45, 3.0, 1.0)],
        "v double, holo double, normal double",
    )
    rows = df.select(
        numbers.round_half_even(F.col("v"), 1), numbers.preferred(F.col("holo"), F.col("normal"))
    ).collect()
    import numpy as np

    assert [r[0] for r in rows] == [float(np.round(v, 1)) for v in (0.25, 0.35, 1.15, -0.45)]
    assert [r[1] for r in rows] == [2.0, None, None, 3.0]


def test_waits(spark):
    attempts = spark.range(1, 7)
    rows = attempts.orderBy("id").select(
        numbers.exponential_wait_ms(F.col("id")), numbers.linear_wait_ms(F.col("id")), numbers.page_wait_seconds(F.col("id") - 1)
    ).collect()
    assert [r[0] for r in rows] == [1000.0, 2000.0, 4000.0, 8000.0, 10000.0, 10000.0]
    assert [r[1] for r in rows] == [10, 20, 30, 40, 50, 60]
    assert [r[2] for r in rows] == [5, 8, 11, 14, 17, 20]


def test_leading_text(spark):
    row = spark.range(1).select(text.leading_text(F.lit("é" * 60), 50), text.leading_text(F.lit("ab"), 200)).first()
    assert row[0] == "é" * 50 and row[1] == "ab"


def test_references_as_in_the_standard_library(spark):
    rng = random.Random(1)
    texts = [
        None, "", "&", "&&", "&amp;lt;", "a &lt b", "&notit;", "&#0;", "&#x80;", "&#128;x", "&#150", "&#xD800;", "&#1114112;",
        "&#99999999999999999999;", "&#11;", "&#xFDD0;", "&#x1FFFF;", "&#129;", "&#13;", "&#x1F600;", "&#00065;", "&#x;", "&#;",
        "&nosuch;", "&ampx", "&copy2024", "&acE;", "& amp;", "&" + "a" * 50, "&éx;", "x&ngE;y", "&fjlig;",
    ]
    texts += [f"x&{name}y &{name[:-1]}z" for name in rng.sample(sorted(html5), 150)]
    parts = ["&", "amp", "lt", ";", "#", "x", "41", "233", " ", "é", "not", "in", "AMP;", "&copy", "&#x"]
    texts += ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(150)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = dict(map(tuple, rows.select("i", text.unescape_html("t")).collect()))
    assert got == {i: None if t is None else html.unescape(t) for i, t in enumerate(texts)}
    assert "ArrowEvalPython" not in rows.select(text.unescape_html("t"))._jdf.queryExecution().executedPlan().toString()
