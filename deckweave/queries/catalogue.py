"""Catalogue queries: orders as sets, customers and parts as cards."""

from pyspark.sql import functions as F

from deckweave.functions import numbers, text
from deckweave.operators import frames
from deckweave.operators.attempts import resolve_attempts
from deckweave.plans import catalogue
from deckweave.queries import query, table
from deckweave.session import scratch_path
from deckweave.sources import catalogue as card_source
from deckweave.sources import files
from deckweave.sources import sets as set_source


def _sets(spark, folder):
    """Orders as sets of two cards: the customer's, and one without a full record."""
    orders = table(spark, folder, "orders")
    brief = lambda key: F.struct(key.alias("id"), F.lit("brief").alias("name"))
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("Set "), F.col("o_orderkey").cast("string")).alias("name"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("releaseDate"),
        F.struct(
            F.when(F.col("o_orderstatus") == "P", set_source.EXCLUDED_SERIES)
            .when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))
            .alias("id")
        ).alias("serie"),
        F.when(
            F.col("o_orderpriority") != "1-URGENT",
            F.array(brief(F.col("o_custkey")), brief(-1 - F.col("o_custkey"))),
        ).alias("cards"),
    )


def _details(spark, folder):
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("https://img.example/"), F.col("c_custkey").cast("string")).alias("image"),
        F.col("c_acctbal").alias("price"),
        F.array("c_mktsegment").alias("types"),
        F.struct(
            (F.col("c_acctbal") > 0).alias("normal"),
            (F.col("c_mktsegment") == "BUILDING").alias("holo"),
            F.array(F.lit(1)).alias("nested"),
        ).alias("variants"),
    )


_LISTED = "o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW'"
_FLAT = """
    SELECT o_orderkey AS set_id, 'Set ' || o_orderkey AS set_name,
           strftime(o_orderdate, '%Y-%m-%d') AS "set_releaseDate",
           c_custkey AS id, c_name AS name, 'https://img.example/' || c_custkey AS image,
           c_acctbal AS price,
           'https://img.example/' || c_custkey || '/low.png' AS image_url,
           'images/' || strftime(o_orderdate, '%Y-%m-%d') || '_' || o_orderkey || '_'
               || c_custkey || '_low.png' AS image_path,
           c_acctbal > 0 AS variants_normal, c_mktsegment = 'BUILDING' AS variants_holo
"""


@query(
    "C1 C2 C3 B8 B9 B10 H12 H7 A8",
    f"""{_FLAT}
    FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE {_LISTED} AND o_orderpriority <> '1-URGENT'""",
)
def catalogue_flat(spark, folder):
    return catalogue.catalogue_flat(
        _sets(spark, folder), _details(spark, folder), with_image_path=True
    )


@query(
    "C2",
    """
    SELECT l_orderkey AS set_id, l_linenumber AS set_line, part.p_partkey AS id, p_name AS name
    FROM (SELECT *, CASE WHEN l_linenumber <= 2 THEN 1 ELSE l_partkey END AS card FROM lineitem)
    JOIN part ON card = p_partkey WHERE p_partkey % 10 <> 0""",
)
def hot_cards(spark, folder):
    """Order lines as sets of one card, half of them of the same one."""
    hot = F.when(F.col("l_linenumber") <= 2, 1).otherwise(F.col("l_partkey"))
    briefs = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("set_id"), F.col("l_linenumber").alias("set_line"), F.struct(hot.alias("id")).alias("brief")
    )
    details = table(spark, folder, "part").where("p_partkey % 10 <> 0").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name")
    )
    joined = catalogue.with_full_card(briefs, details, even=True)
    return joined.select("set_id", "set_line", "card.id", "card.name")


@query(
    "A7 F3 C1 C2 C3 B8 B9",
    f"""
    WITH chosen AS (
        SELECT * FROM orders WHERE {_LISTED}
        ORDER BY o_orderdate DESC, o_orderkey LIMIT 40)
    {_FLAT}
    FROM chosen JOIN customer ON o_custkey = c_custkey
    WHERE o_orderpriority <> '1-URGENT'""",
)
def catalogue_flat_newest(spark, folder):
    return catalogue.catalogue_flat(
        _sets(spark, folder), _details(spark, folder), first=40, with_image_path=True
    )


@query(
    "A7 B10 F2",
    f"""
    SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS "releaseDate",
           o_orderpriority AS serie
    FROM orders WHERE {_LISTED} ORDER BY o_orderdate DESC, o_orderkey""",
)
def set_listing(spark, folder):
    listed = set_source.set_listing(_sets(spark, folder))
    return listed.select("id", "releaseDate", F.col("serie.id").alias("serie"))


@query(
    "B10 F2 F3",
    f"""
    SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS "releaseDate"
    FROM orders WHERE {_LISTED} ORDER BY o_orderdate DESC, o_orderkey LIMIT 20""",
)
def first_sets(spark, folder):
    listed = set_source.set_listing(_sets(spark, folder))
    return set_source.first_sets(listed, 20).select("id", "releaseDate")


@query(
    "D5",
    """
    SELECT 'sets' AS name, count(*) AS rows FROM orders
    UNION ALL SELECT 'cards', count(*) FROM customer
    UNION ALL SELECT 'index', count(*) FROM embeddings""",
)
def row_counts(spark, folder):
    tables = {"sets": "orders", "cards": "customer", "index": "embeddings"}
    return frames.concat_frames(
        frames.row_count(table(spark, folder, source)).select(F.lit(name).alias("name"), "rows")
        for name, source in tables.items()
    )


@query(
    "A8",
    """
    SELECT c_custkey AS id, c_name AS name, c_acctbal AS price
    FROM customer WHERE c_custkey = (SELECT max(o_custkey) FROM orders)""",
)
def card_detail(spark, folder):
    newest = table(spark, folder, "orders").agg(F.max("o_custkey")).scalar()
    details = _details(spark, folder)
    return set_source.card_detail(details, newest).select("id", "name", "price")


@query(
    "B8",
    """
    SELECT c_custkey, n_nationkey AS nation_n_nationkey, n_name AS nation_n_name,
           n_nationkey >= 10 AS nation_late
    FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def scalar_prefix(spark, folder):
    nation = table(spark, folder, "nation").select(
        F.struct(
            "n_nationkey",
            "n_name",
            (F.col("n_nationkey") >= 10).alias("late"),
            F.array("n_name").alias("names"),
            F.struct("n_regionkey").alias("region"),
        ).alias("nation")
    )
    customers = table(spark, folder, "customer")
    joined = customers.join(nation, F.col("c_nationkey") == F.col("nation.n_nationkey"))
    fields = frames.scalar_fields(joined, "nation", "nation_")
    return joined.select("c_custkey", *frames.merged_record(fields))


@query(
    "B9",
    """
    SELECT c_custkey AS id, n_name AS name, c_acctbal AS price
    FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def record_merge(spark, folder):
    nations = table(spark, folder, "nation")
    joined = table(spark, folder, "customer").join(
        nations, F.col("c_nationkey") == F.col("n_nationkey")
    )
    customer = {"id": F.col("c_custkey"), "name": F.col("c_name"), "price": F.col("c_acctbal")}
    return joined.select(*frames.merged_record(customer, {"name": F.col("n_name")}))


@query(
    "A11 H7",
    """
    SELECT 'images/2024-01-01_' || lang || '_' || doc_id || '_low.png' AS image_path,
           strlen(text) AS bytes, md5(text) AS digest
    FROM documents""",
)
def image_store(spark, folder):
    images = table(spark, folder, "documents").select(
        F.encode("text", "UTF-8").alias("content"), "lang", F.col("doc_id").cast("string").alias("id")
    )
    path = scratch_path(spark, "images")
    name = text.image_path(F.lit("2024-01-01"), F.col("lang"), F.col("id"))
    files.write_images(images, path, name)
    return spark.read.parquet(path).select(
        "image_path", F.length("content").alias("bytes"), F.md5("content").alias("digest")
    )


@query(
    "A9",
    """
    SELECT doc_id, text, lang, n_chars FROM documents""",
)
def csv_sink_texts(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang", "n_chars")
    path = scratch_path(spark, "raw-csv")
    files.write_csv(documents, path, mark=True)
    return files.read_csv(spark, path, documents.schema, multi_line=True)


@query(
    "A10",
    """
    SELECT c_custkey AS id, c_name AS name, c_acctbal AS price, c_acctbal > 0 AS variants_normal
    FROM customer""",
)
def csv_sink_catalogue(spark, folder):
    details = _details(spark, folder)
    flat = details.select("id", "name", "price", F.col("variants.normal").alias("variants_normal"))
    path = scratch_path(spark, "cards-csv")
    files.write_csv(flat, path)
    return files.read_csv(spark, path, flat.schema)


def _cards(spark, folder):
    """Parts as nested cards; each type lacks something."""
    price = lambda value: F.struct(value.alias("market"), F.col("p_retailprice").alias("low"))
    kind = F.col("p_type")
    variants = (
        F.when(kind == "LARGE", F.create_map(F.lit("holofoil"), price(F.col("p_retailprice"))))
        .when(kind == "MEDIUM", F.create_map(F.lit("normal"), price(F.col("p_retailprice") / 8)))
        .when(
            kind == "SMALL",
            F.create_map(
                F.lit("holofoil"), price(F.lit(0.0)), F.lit("normal"), price(F.col("p_retailprice") / 7)
            ),
        )
        .when(kind == "PROMO", F.create_map(F.lit("foil1st"), price(F.col("p_retailprice"))))
    )
    words = F.split("p_name", " ")
    return table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("id"),
        F.col("p_name").alias("name"),
        kind.alias("supertype"),
        words.alias("subtypes"),
        F.struct(
            F.col("p_brand").alias("id"),
            F.col("p_brand").alias("name"),
            F.col("p_size").alias("printedTotal"),
            F.struct(
                F.when(kind != "ECONOMY", F.col("p_brand")).otherwise("").alias("symbol")
            ).alias("images"),
        ).alias("set"),
        F.col("p_partkey").cast("string").alias("number"),
        F.when(kind == "PROMO", "").when(kind != "LARGE", words[1]).alias("artist"),
        F.when(kind == "SMALL", "").when(kind != "MEDIUM", words[0]).alias("rarity"),
        F.struct(F.concat(F.lit("https://img.example/"), "p_name").alias("large")).alias("images"),
        F.struct(variants.alias("prices")).alias("tcgplayer"),
        (F.col("p_size") / 16).alias("score"),
    )


def _fixed_sql(value: str, digits: int) -> str:
    """printf rounds the exact value, ties to even: a tie is moved away from zero first."""
    tie = f"abs(({value}) * {2 ** (digits + 1)} % 2) = 1"
    moved = f"({value}) + CASE WHEN {tie} THEN sign({value}) * {2.0 ** -(4 * digits + 4)} ELSE 0 END"
    return f"printf('%.{digits}f', CAST({moved} AS DOUBLE))"


@query(
    "B17 H5 H6 H7 H8 H9 H10 H11",
    f"""
    SELECT CAST(p_partkey AS VARCHAR) AS id, 'https://img.example/' || p_name AS image,
           {_fixed_sql("p_size / 16.0 * 100", 1)} || '% Match' AS match, p_name AS name,
           p_type || ' - ' || replace(p_name, ' ', ', ') AS type_line,
           p_partkey || '/' || p_size AS number_line,
           CASE WHEN p_type <> 'ECONOMY' THEN p_brand END AS set_symbol, p_brand AS set_name,
           CASE WHEN p_type IN ('PROMO', 'LARGE') THEN 'Unknown'
                ELSE split_part(p_name, ' ', 2) END AS artist,
           CASE WHEN p_type IN ('SMALL', 'MEDIUM') THEN 'Common'
                ELSE split_part(p_name, ' ', 1) END AS rarity,
           CASE p_type WHEN 'LARGE' THEN '$' || {_fixed_sql("p_retailprice", 2)} || ' (Market)'
                       WHEN 'MEDIUM' THEN '$' || {_fixed_sql("p_retailprice / 8", 2)} || ' (Market)'
                       WHEN 'SMALL' THEN '$' || {_fixed_sql("p_retailprice / 7", 2)} || ' (Market)'
           END AS price
    FROM part""",
)
def card_view(spark, folder):
    return catalogue.card_view(_cards(spark, folder), F.col("score"))


@query(
    "H9",
    """
    SELECT l_orderkey, l_linenumber, coalesce(nullif(l_discount, 0), nullif(l_tax, 0)) AS price
    FROM lineitem""",
)
def preferred_price(spark, folder):
    chosen = numbers.preferred(F.col("l_discount"), F.col("l_tax"))
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", chosen.alias("price"))


@query(
    "H5 H10",
    f"""
    SELECT event_id, {_fixed_sql("value / 100 * 100", 1)} || '% Match' AS percent,
           '$' || {_fixed_sql("value / 8", 2)} || ' (Market)' AS money
    FROM events""",
)
def fixed_texts(spark, folder):
    value = F.col("value")
    return table(spark, folder, "events").select(
        "event_id",
        text.percent_match(value / 100).alias("percent"),
        text.money_text(value / 8).alias("money"),
    )


def _responses(spark, folder):
    """Parts as catalogue responses; economy parts come without data, promo parts with none."""
    card = F.struct(
        F.col("p_partkey").cast("string").alias("id"),
        F.col("p_name").alias("name"),
        F.split("p_name", " ").alias("subtypes"),
        F.struct(F.col("p_brand").alias("id"), F.col("p_size").alias("printedTotal")).alias("set"),
        F.struct(
            F.create_map("p_type", F.struct(F.col("p_retailprice").alias("market"))).alias("prices")
        ).alias("tcgplayer"),
    )
    envelope = F.struct(
        F.when(F.col("p_type") == "PROMO", F.slice(F.array(card), 1, 0))
        .when(F.col("p_type") != "ECONOMY", F.array(card))
        .alias("data"),
        F.lit(1).alias("page"),
        F.col("p_size").alias("pageSize"),
        F.lit(1).alias("count"),
        F.col("p_partkey").alias("totalCount"),
    )
    return table(spark, folder, "part").select(F.to_json(envelope).alias("body"))


@query(
    "A1 H2",
    """
    SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_brand AS set_id,
           p_size AS printed, replace(p_name, ' ', '|') AS subtypes, p_retailprice AS market
    FROM part WHERE p_type NOT IN ('ECONOMY', 'PROMO')""",
)
def envelope_cards(spark, folder):
    cards = card_source.envelope_cards(card_source.parse_envelopes(_responses(spark, folder)))
    price = F.coalesce(
        *[F.col("tcgplayer.prices")[kind]["market"] for kind in ("STANDARD", "MEDIUM", "LARGE", "SMALL")]
    )
    return cards.select(
        "id",
        "name",
        F.col("set.id").alias("set_id"),
        F.col("set.printedTotal").alias("printed"),
        F.array_join("subtypes", "|").alias("subtypes"),
        price.alias("market"),
    )


@query(
    "A2",
    """
    SELECT 1 AS page, p_size AS "pageSize", 1 AS count, p_partkey AS "totalCount" FROM part""",
)
def envelope_counts(spark, folder):
    return card_source.envelope_pages(card_source.parse_envelopes(_responses(spark, folder)))


def _large_file(spark, folder):
    """All parts as one pretty-printed envelope: a head, a card each, a tail."""
    line = lambda name, value: F.concat(F.lit(f'      "{name}": '), value)
    card = F.concat_ws(
        ",\n",
        line("id", F.concat(F.lit('"'), F.col("p_partkey"), F.lit('"'))),
        line("name", F.concat(F.lit('"{'), F.col("p_name"), F.lit('}\\n    }"'))),
        line("set", F.concat(F.lit('{\n        "id": "'), F.col("p_brand"), F.lit('"\n      }'))),
    )
    parts = table(spark, folder, "part")
    last = parts.agg(F.max("p_partkey")).scalar()
    after = F.when(F.col("p_partkey") == last, "").otherwise(",")
    cards = parts.select(F.col("p_partkey").alias("at"), F.concat(F.lit("    {\n"), card, F.lit("\n    }"), after).alias("value"))
    ends = spark.createDataFrame([(-1, '{\n  "page": 1,\n  "data": ['), (1 << 40, '  ],\n  "pageSize": 250,\n  "totalCount": 7\n}')], "at bigint, value string")
    path = scratch_path(spark, "large-envelope")
    cards.unionByName(ends).repartition(1).sortWithinPartitions("at").select("value").write.text(path)
    return card_source.read_large_envelopes(spark, path)


@query(
    "A1",
    r"""
    SELECT CAST(p_partkey AS VARCHAR) AS id, '{' || p_name || '}' || chr(10) || '    }' AS name, p_brand AS set_id FROM part""",
)
def large_envelope_cards(spark, folder):
    cards = card_source.large_envelope_cards(_large_file(spark, folder))
    return cards.select("id", "name", F.col("set.id").alias("set_id"))


@query("A2", 'SELECT 1 AS page, 250 AS "pageSize", CAST(NULL AS INTEGER) AS count, 7 AS "totalCount"')
def large_envelope_counts(spark, folder):
    return card_source.large_envelope_pages(_large_file(spark, folder)).drop("file")


@query(
    "A1 A2",
    """
    SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_size AS "pageSize"
    FROM part WHERE p_type NOT IN ('ECONOMY', 'PROMO')""",
)
def envelope_files(spark, folder):
    path = scratch_path(spark, "envelopes")
    _responses(spark, folder).write.text(path)
    envelopes = card_source.read_envelopes(spark, path, multi_line=False)
    return envelopes.select("pageSize", F.explode("data").alias("card")).select(
        "card.id", "card.name", "pageSize"
    )


def _part_cards(spark, folder):
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.struct(F.col("p_brand").alias("id")).alias("set")
    )


@query(
    "B11 F4 D5",
    """
    SELECT p_partkey AS id, p_name AS name, 2 AS page, 5 AS "pageSize",
           greatest(0, least(5, (SELECT count(*) FROM part WHERE p_brand = 'Brand#2') - 5)) AS count,
           (SELECT count(*) FROM part WHERE p_brand = 'Brand#2') AS "totalCount"
    FROM part WHERE p_brand = 'Brand#2' ORDER BY p_partkey LIMIT 5 OFFSET 5""",
)
def catalogue_page(spark, folder):
    cards = _part_cards(spark, folder)
    return catalogue.catalogue_page(cards, F.col("set.id") == "Brand#2", page=2, size=5).drop("set")


@query(
    "F4",
    """
    SELECT 100000 AS page, 5 AS "pageSize", 0 AS count, count(*) AS "totalCount"
    FROM part WHERE p_brand = 'Brand#2'""",
)
def catalogue_page_past_end(spark, folder):
    cards = _part_cards(spark, folder).where(F.col("set.id") == "Brand#2")
    return frames.page_counts(cards, page=100000, size=5)


@query(
    "F4",
    """
    SELECT p_partkey AS id, p_name AS name,
           (SELECT count(*) FROM part WHERE p_brand = 'Brand#7') AS "totalCount"
    FROM part WHERE p_brand = 'Brand#7' ORDER BY p_partkey LIMIT 5""",
)
def catalogue_first_page(spark, folder):
    cards = _part_cards(spark, folder)
    page = catalogue.catalogue_page(cards, F.col("set.id") == "Brand#7")
    return page.select("id", "name", "totalCount")


@query(
    "F4 B11",
    """
    SELECT p_partkey AS id, p_name AS name FROM part WHERE p_brand <> 'Brand#7'
    ORDER BY p_name, p_partkey LIMIT 7 OFFSET 14""",
)
def catalogue_page_after(spark, folder):
    """The third page, each found behind the last row of the one before."""
    cards, last, page = _part_cards(spark, folder), None, None
    for _ in range(3):
        page = catalogue.catalogue_page_after(cards, last, F.col("set.id") != "Brand#7", 7, ("name", "id"))
        last = frames.last_key(page, ("name", "id"))
    return page.select("id", "name")


@query(
    "A12 C7",
    """
    SELECT c_custkey AS id, c_name AS name FROM customer""",
)
def fallback_used(spark, folder):
    orders = table(spark, folder, "orders").where(F.col("o_totalprice") < 0)
    primary = orders.select(F.col("o_orderkey").alias("id"), F.lit("").alias("name"))
    customers = table(spark, folder, "customer")
    fallback = customers.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return card_source.with_fallback(primary, fallback)


@query(
    "A12 C7",
    """
    SELECT o_orderkey AS id, o_orderpriority AS name FROM orders WHERE o_totalprice > 300000""",
)
def fallback_unused(spark, folder):
    orders = table(spark, folder, "orders").where(F.col("o_totalprice") > 300000)
    primary = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"))
    customers = table(spark, folder, "customer")
    fallback = customers.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return card_source.with_fallback(primary, fallback)


@query(
    "A12 E1",
    """
    SELECT s_suppkey AS id, s_name AS name FROM supplier
    WHERE NOT EXISTS (SELECT 1 FROM conversations WHERE turn < 3 AND role = 'assistant')
    UNION ALL
    SELECT c_custkey, c_name FROM customer
    WHERE EXISTS (SELECT 1 FROM conversations WHERE turn < 3 AND role = 'assistant')""",
)
def fallback_on_failure(spark, folder):
    """Every conversation is a request; one that succeeded is enough."""
    outcome = resolve_attempts(
        table(spark, folder, "conversations").select(
            F.col("conv_id").alias("key"),
            (F.col("turn") + 1).alias("attempt"),
            F.when(F.col("role") == "assistant", 200).otherwise(503).alias("status"),
            F.col("role").alias("error"),
        )
    )
    primary = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name")
    )
    fallback = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")
    )
    return card_source.with_fallback_on_failure(primary, fallback, outcome)
