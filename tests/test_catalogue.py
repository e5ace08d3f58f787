import json

import pytest
from pyspark.sql import functions as F

from deckweave import schemas
from deckweave.operators import frames
from deckweave.operators.attempts import resolve_attempts
from deckweave.plans import catalogue
from deckweave.sources import catalogue as card_source
from deckweave.sources import sets as set_source


def _card(card_id, set_id="base1", artist="Ann", rarity="Rare", prices=None, **more):
    card = {
        "id": card_id,
        "name": f"Card {card_id}",
        "supertype": "Pokémon",
        "subtypes": ["Stage 2", "EX"],
        "hp": "80",
        "set": {"id": set_id, "name": set_id.title(), "printedTotal": 102, "images": {"symbol": "s.png"}},
        "number": card_id.split("-")[1],
        "artist": artist,
        "rarity": rarity,
        "images": {"small": "s", "large": "l"},
        "abilities": [{"name": "Trick", "text": "t", "type": "Power"}],
        "tcgplayer": None if prices is None else {"url": "u", "prices": prices},
    }
    return {**card, **more}


CARDS = [
    _card("base1-1", prices={"holofoil": {"market": 10.5, "low": 1}, "normal": {"market": 2}}),
    _card("base1-2", prices={"normal": {"market": 2.25}}, artist="", rarity=None),
    _card("base1-3", prices={"holofoil": {"market": 0}, "normal": {"market": 3}}),
    _card("base1-4", artist=None, rarity=""),
    _card("base1-5", prices={"1stEdition": {"market": 99.0}}),
    _card("base1-6", prices={"holofoil": {"market": 1.005}}),
    _card("gym-1", set_id="gym", nationalPokedexNumbers=[4, 5], level="12"),
]
ENVELOPE = {"data": CARDS, "page": 1, "pageSize": 7, "count": 7, "totalCount": 102}


@pytest.fixture(scope="module")
def cards(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("envelope")
    (folder / "one.json").write_text(json.dumps(ENVELOPE, indent=2))
    (folder / "empty.json").write_text(json.dumps({"data": [], "page": 2}, indent=2))
    (folder / "missing.json").write_text(json.dumps({"page": 3}, indent=2))
    return card_source.read_envelopes(spark, str(folder))


def test_envelope(cards):
    assert cards.count() == 3
    rows = card_source.envelope_cards(cards).collect()
    assert [r.id for r in rows] == [c["id"] for c in CARDS]
    assert rows[4].tcgplayer.prices["1stEdition"].market == 99.0
    assert rows[6].nationalPokedexNumbers == [4, 5] and rows[6].level == "12"
    assert rows[0].abilities[0].name == "Trick"
    counts = card_source.envelope_pages(cards).where("page = 1").first()
    assert tuple(counts) == (1, 7, 7, 102)


def test_envelopes_of_texts(spark):
    bodies = spark.createDataFrame([(json.dumps(ENVELOPE),), ("{broken",), (None,)], "body string")
    assert card_source.envelope_cards(card_source.parse_envelopes(bodies)).count() == len(CARDS)


def test_page(cards):
    all_cards = card_source.envelope_cards(cards)
    page = catalogue.catalogue_page(all_cards, F.col("set.id") == "base1", page=2, size=4)
    rows = page.select("id", "page", "pageSize", "count", "totalCount").collect()
    assert [tuple(r) for r in rows] == [("base1-5", 2, 4, 2, 6), ("base1-6", 2, 4, 2, 6)]
    assert catalogue.catalogue_page(all_cards, page=5, size=4).count() == 0
    assert catalogue.catalogue_page(all_cards).count() == 5
    with pytest.raises(ValueError):
        catalogue.catalogue_page(all_cards, page=0)


def test_fallback(spark, cards):
    all_cards = card_source.envelope_cards(cards).select("id", "name")
    none = all_cards.where(F.col("id") == "no such card")
    some = all_cards.where(F.col("id") == "gym-1")
    assert card_source.with_fallback(none, all_cards).count() == len(CARDS)
    assert card_source.with_fallback(some, all_cards).count() == 1
    assert card_source.with_fallback(none, none).count() == 0
    page = catalogue.catalogue_page(all_cards, F.col("id") == "x", fallback=all_cards)
    assert page.count() == len(CARDS)


def test_fallback_on_failure(spark):
    primary = spark.createDataFrame([("p",)], "id string")
    fallback = spark.createDataFrame([("f",), ("g",)], "id string")

    def given(*statuses, rows=primary):
        attempts = [("k", i + 1, s, None) for i, s in enumerate(statuses)]
        outcome = resolve_attempts(spark.createDataFrame(attempts, schemas.ATTEMPT))
        got = card_source.with_fallback_on_failure(rows, fallback, outcome)
        return sorted(r.id for r in got.collect())

    assert given(503, 200) == ["p"]
    assert given(503, 503, 503) == ["f", "g"]
    assert given(404) == ["f", "g"]
    assert given(200, rows=primary.where("false")) == []


def test_card_view(cards):
    view = catalogue.card_view(card_source.envelope_cards(cards), F.lit(0.5))
    rows = {r.id: r for r in view.collect()}
    first = rows["base1-1"]
    assert (first.match, first.type_line, first.number_line) == ("50.0% Match", "Pokémon - Stage 2, EX", "1/102")
    assert (first.set_symbol, first.set_name, first.image) == ("s.png", "Base1", "l")
    assert {i: r.price for i, r in rows.items()} == {
        "base1-1": "$10.50 (Market)",
        "base1-2": "$2.25 (Market)",
        "base1-3": "$3.00 (Market)",
        "base1-4": None,
        "base1-5": None,
        "base1-6": "$1.00 (Market)",
        "gym-1": None,
    }
    assert (rows["base1-2"].artist, rows["base1-2"].rarity) == ("Unknown", "Common")
    assert (rows["base1-4"].artist, rows["base1-4"].rarity) == ("Unknown", "Common")
    plain = catalogue.card_view(card_source.envelope_cards(cards))
    assert {r.match for r in plain.collect()} == {None}


@pytest.fixture(scope="module")
def sets(spark):
    rows = [
        ("s1", "One", "2024-01-01", ("sv",), [("c1", "a"), ("c2", "b"), ("gone", "x")], ["t"]),
        ("s2", "Two", "2024-02-01", ("sv",), [("c1", "a"), ("c1", "a")], ["t"]),
        ("s3", "Pocket", "2025-01-01", ("tcgp",), [("c1", "a")], ["t"]),
        ("s4", "Empty", "2024-03-01", ("sv",), [], ["t"]),
        ("s5", "Null", None, ("sv",), None, ["t"]),
        ("s6", "No series", "2026-01-01", (None,), [("c1", "a")], ["t"]),
    ]
    return spark.createDataFrame(
        rows,
        "id string, name string, releaseDate string, serie struct<id: string>, "
        "cards array<struct<id: string, name: string>>, tags array<string>",
    )


@pytest.fixture(scope="module")
def details(spark):
    rows = [
        ("c1", "Card 1", "https://x/c1", 10, ["fire"], (True, False, [1])),
        ("c2", "Card 2", None, 20, None, (False, None, None)),
        ("c3", "Card 3", "https://x/c3", 30, None, None),
    ]
    return spark.createDataFrame(
        rows,
        "id string, name string, image string, hp int, types array<string>, "
        "variants struct<normal: boolean, holo: boolean, nested: array<int>>",
    )


def test_set_listing(sets):
    assert [r.id for r in set_source.set_listing(sets).collect()] == ["s4", "s2", "s1", "s5"]
    assert [r.id for r in set_source.first_sets(set_source.set_listing(sets), 2).collect()] == ["s4", "s2"]


def test_catalogue_flat(sets, details):
    flat = catalogue.catalogue_flat(sets, details, with_image_path=True)
    assert flat.columns == [
        "set_id", "set_name", "set_releaseDate", "id", "name", "image", "hp", "image_url",
        "image_path", "variants_normal", "variants_holo",
    ]
    rows = sorted(tuple(r) for r in flat.fillna("", ["image", "image_url"]).collect())
    path = "images/%s_%s_%s_low.png"
    c1 = ("c1", "Card 1", "https://x/c1", 10, "https://x/c1/low.png")
    assert rows == [
        ("s1", "One", "2024-01-01", *c1, path % ("2024-01-01", "s1", "c1"), True, False),
        ("s1", "One", "2024-01-01", "c2", "Card 2", "", 20, "", path % ("2024-01-01", "s1", "c2"), False, None),
        ("s2", "Two", "2024-02-01", *c1, path % ("2024-02-01", "s2", "c1"), True, False),
        ("s2", "Two", "2024-02-01", *c1, path % ("2024-02-01", "s2", "c1"), True, False),
    ]
    newest = catalogue.catalogue_flat(sets, details, first=2)
    assert {r.set_id for r in newest.collect()} == {"s2"}
    assert "image_path" not in newest.columns


def test_card_detail(details):
    assert set_source.card_detail(details, "c2").first().name == "Card 2"


def test_scalar_fields_and_merge(spark):
    df = spark.sql("SELECT struct(1 AS a, 'x' AS b, array(1) AS c, struct(1 AS z) AS d, true AS e, "
                   "date'2024-01-01' AS f, NULL AS g) AS s, 5 AS top")
    fields = frames.scalar_fields(df, "s", "p_")
    assert list(fields) == ["p_a", "p_b", "p_e", "p_g"]
    merged = df.select(*frames.merged_record(fields, {"p_a": F.col("top"), "new": F.lit(1)}))
    assert merged.columns == ["p_a", "p_b", "p_e", "p_g", "new"]
    assert merged.first().p_a == 5


def test_flatten_and_count(spark):
    df = spark.sql("SELECT array(array(struct(1 AS a), struct(1 AS a)), array(struct(2 AS a))) AS r")
    assert [r.a for r in frames.flatten_rows(df, "r").collect()] == [1, 1, 2]
    assert frames.row_count(df).first().rows == 1


def test_pages_behind_the_last_row_meet_every_row_once(spark):
    rows = [(i, None if i % 7 == 0 else "abc"[i % 3], float(i % 2)) for i in range(41)]
    cards = spark.createDataFrame(rows, "id int, `a.name` string, price double").repartition(4)
    order = ("a.name", "price", "id")
    key = lambda r: (r[1] is not None, r[1] or "", r[2], r[0])
    met, last = [], None
    for _ in range(9):
        page = frames.page_after(cards, last, 5, order)
        met += [tuple(r) for r in page.collect()]
        last = frames.last_key(page, order)
    assert met == sorted(rows, key=key) and frames.page_after(cards, last, 5, order).count() == 0
    assert frames.last_key(cards.limit(0), order) is None
    with pytest.raises(ValueError):
        frames.page_after(cards, {"id": 1}, 5, order)
    with pytest.raises(ValueError):
        frames.page_after(cards, None, 0, order)
