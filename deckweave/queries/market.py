"""Market queries: lineitem, part, events, pages and orders as captured pages and market rows."""

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from deckweave.functions import numbers, text
from deckweave.operators import frames
from deckweave.plans import market
from deckweave.queries import query, table
from deckweave.session import scratch_path
from deckweave.sources import files
from deckweave.sources import pages as page_source


def _totals(spark, folder):
    """Totals by brand: lineitem is added up by part before it meets part."""
    items = table(spark, folder, "lineitem").select(
        "l_partkey",
        F.col("l_orderkey").alias("id"),
        F.col("l_shipdate").cast("date").alias("date"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("preco_min"),
        F.col("l_extendedprice").alias("preco_mean"),
        (F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("preco_max"),
    )
    parts = table(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("colecao"))
    per_part = market.partial_totals(items, "l_partkey")
    joined = per_part.join(parts, per_part["l_partkey"] == parts["p_partkey"])
    return market.add_totals(joined)


_SUMMARY = """
    WITH market AS (
        SELECT p_brand AS colecao, l_orderkey AS id, l_shipdate AS date,
               l_extendedprice * (1 - l_discount) AS preco_min,
               l_extendedprice AS preco_mean,
               l_extendedprice * (1 + l_tax) AS preco_max
        FROM lineitem JOIN part ON l_partkey = p_partkey),
    totals AS (
        SELECT colecao, count(id) AS num_cards, min(date) AS date, sum(preco_min) AS preco_min,
               sum(preco_mean) AS preco_mean, sum(preco_max) AS preco_max
        FROM market WHERE colecao IS NOT NULL GROUP BY colecao)
"""


@query(
    "D1 F1 D2",
    _SUMMARY
    + """
    SELECT colecao, num_cards, strftime(date, '%Y-%m-%d') AS date,
           round(preco_min, 2) AS preco_min, round(preco_mean, 2) AS preco_mean,
           round(preco_max, 2) AS preco_max,
           round(preco_min / num_cards, 4) AS preco_min_mean,
           round(preco_mean / num_cards, 4) AS preco_mean_mean,
           round(preco_max / num_cards, 4) AS preco_max_mean
    FROM totals ORDER BY totals.date DESC, colecao""",
)
def collection_summary(spark, folder):
    summary = market.summary_of(_totals(spark, folder))
    return summary.select(
        "colecao",
        "num_cards",
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        *[F.round(c, 2).alias(c) for c in market.SUMMED],
        *[F.round(c, 4).alias(c) for c in market.MEANS],
    )


@query(
    "H13 B14 D2 F1",
    _SUMMARY
    + """
    SELECT colecao, round_even(preco_min / num_cards, 1) AS preco_min_mean,
           round_even(preco_mean / num_cards, 1) AS preco_mean_mean,
           round_even(preco_max / num_cards, 1) AS preco_max_mean
    FROM totals""",
)
def summary_chart(spark, folder):
    return market.chart_rows(market.summary_of(_totals(spark, folder), digits=1))


@query(
    "D1 D2 D5",
    """
    SELECT o_orderstatus AS colecao, count(*) AS num_cards,
           strftime(min(o_orderdate), '%Y-%m-%d') AS date,
           round(coalesce(sum(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END), 0.0), 2)
               AS preco_min,
           round(sum(o_totalprice), 2) AS preco_mean,
           round(coalesce(sum(CASE WHEN o_totalprice > 250000 THEN o_totalprice END), 0.0), 2)
               AS preco_max
    FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY o_orderstatus""",
)
def summary_missing_prices(spark, folder):
    price = F.col("o_totalprice")
    rows = table(spark, folder, "orders").select(
        F.col("o_orderstatus").alias("colecao"),
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.when(F.col("o_orderstatus") != "P", price).alias("preco_min"),
        price.alias("preco_mean"),
        F.when(price > 250000, price).otherwise(float("nan")).alias("preco_max"),
    )
    return market.collection_totals(rows).select(
        "colecao",
        "num_cards",
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        *[F.round(c, 2).alias(c) for c in market.SUMMED],
    )


@query(
    "H13",
    """
    SELECT l_orderkey, l_linenumber, l_extendedprice, round_even(l_extendedprice, 1) AS price
    FROM lineitem""",
)
def round_half_even(spark, folder):
    price = numbers.round_half_even(F.col("l_extendedprice"), 1).alias("price")
    items = table(spark, folder, "lineitem")
    return items.select("l_orderkey", "l_linenumber", "l_extendedprice", price)


_EVENT_ROW = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "sSigla", "p1a", "dt")])


def _event_pages(spark, folder):
    """One captured page per event: a one-row table, or a page of another kind."""
    row = F.struct(
        F.col("event_id").cast("string").alias("id"),
        F.col("event_type").alias("sSigla"),
        F.col("value").alias("p1a"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("dt"),
    )
    carrying = F.concat(
        F.lit("<html>\n<script>var cardsjson = "), F.to_json(F.array(row)), F.lit(";\n</script></html>")
    )
    kind = F.col("event_type")
    html = (
        F.when(kind == "error", F.lit("<html>Checking your browser</html>"))
        .when(kind == "signup", F.lit("<html>A CARD of yours</html>"))
        .when(kind == "view", F.lit("<html><script>var cardsjson = [{\"id\": 1,}];</script></html>"))
        .otherwise(carrying)
    )
    return table(spark, folder, "events").select(
        F.concat(F.lit("https://shop.example/event/"), F.col("event_id").cast("string")).alias("url"),
        F.lit(200).alias("status"),
        html.alias("html"),
    )


@query(
    "H1 H2 B1",
    """
    SELECT CAST(event_id AS VARCHAR) AS id, event_type AS kind, value AS price,
           strftime(ts, '%Y-%m-%d %H:%M:%S') AS seen,
           'https://shop.example/event/' || event_id AS url
    FROM events WHERE event_type IN ('click', 'purchase')""",
)
def embedded_table(spark, folder):
    rows = market.market_rows(_event_pages(spark, folder), row=_EVENT_ROW)
    return rows.select(
        "id",
        F.col("sSigla").alias("kind"),
        F.col("p1a").cast("double").alias("price"),
        F.col("dt").alias("seen"),
        "url",
    )


@query(
    "B15",
    """
    SELECT 'https://shop.example/event/' || event_id AS url, event_type <> 'error' AS accepted
    FROM events""",
)
def page_acceptance(spark, folder):
    pages = _event_pages(spark, folder)
    return pages.select("url", page_source.has_card_content("html").alias("accepted"))


def _titled_pages(spark, folder):
    """The web pages as they are, each with a table of its own title at the end.

    Pages without transport security stand for refused ones.
    """
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    row = F.struct(
        F.parse_url("url", F.lit("HOST")).alias("sSigla"),
        F.col("page_id").cast("string").alias("id"),
        title.alias("nEN"),
        F.length("html").cast("string").alias("p1a"),
        F.concat(F.date_format(_page_date(), "yyyy-MM-dd"), F.lit(" 10:30:00")).alias("dt"),
        F.lit("x").alias("unknown"),
    )
    script = F.concat(F.lit("<script>var cardsjson = "), F.to_json(F.array(row)), F.lit(";</script>"))
    return table(spark, folder, "pages").select(
        "url",
        F.when(F.startswith("url", F.lit("http://")), 403).otherwise(200).alias("status"),
        F.concat("html", script).alias("html"),
    )


def _page_date():
    return F.date_add(F.lit("2024-01-01").cast("date"), F.length("url"))


_TITLE = "regexp_extract(html, '<title>(.*?)</title>', 1)"
_PLAIN = (
    "regexp_replace(replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), "
    "'&quot;', '\"'), '&amp;?', '&', 'g')"
)


@query(
    "A3 B15 H1 B1 B7 J2 H4 B2 B3 B4 B5 B6",
    f"""
    SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS colecao,
           CAST(page_id AS VARCHAR) AS id, {_PLAIN.format(_TITLE)} AS nome_en,
           CAST(length(html) AS DOUBLE) AS preco_min,
           strftime(DATE '2024-01-01' + CAST(length(url) AS INTEGER), '%Y-%m-%d') AS date
    FROM pages WHERE NOT starts_with(url, 'http://') AND {_TITLE} NOT LIKE '%];%'""",
)
def market_clean(spark, folder):
    clean = market.market_clean(market.market_rows(_titled_pages(spark, folder)))
    return clean.select(
        "colecao", "id", "nome_en", "preco_min", F.date_format("date", "yyyy-MM-dd").alias("date")
    )


def _flow_pages(spark, folder):
    """Pages whose rows have three prices and a field that no declared row knows."""
    row = F.struct(
        F.parse_url("url", F.lit("HOST")).alias("sSigla"),
        F.col("page_id").cast("string").alias("id"),
        F.length("html").cast("string").alias("p1a"),
        F.length("url").cast("string").alias("p1b"),
        (F.length("url") * 2).alias("p1c"),
        F.concat(F.date_format(_page_date(), "yyyy-MM-dd"), F.lit(" 10:30:00")).alias("dt"),
        F.concat(F.lit('say "'), F.col("page_id"), F.lit('", or not')).alias("novo"),
    )
    script = F.concat(F.lit("<script>var cardsjson = "), F.to_json(F.array(row)), F.lit(";</script>"))
    return table(spark, folder, "pages").select("url", F.lit(200).alias("status"), script.alias("html"), "page_id")


_NAMES, _NAMES_OF_PAGE = 1200, 12


def _wild_pages(spark, folder):
    """The same with names that differ only in case, a repeated name, and 1,200 names in all pages together."""
    number = lambda k: (F.col("page_id") * _NAMES_OF_PAGE + k) % _NAMES
    others = F.transform(
        F.sequence(F.lit(0), F.lit(_NAMES_OF_PAGE - 1)),
        lambda k: F.concat(F.lit('"x'), number(k), F.lit('": "'), F.col("page_id"), F.lit("-"), k, F.lit('"')),
    )
    more = F.concat(
        F.lit(',"ID":"other '), F.col("page_id"), F.lit('","sN":"first","sN":"'), F.col("page_id"), F.lit('",'),
        F.concat_ws(",", others), F.lit("}];"),
    )
    return _flow_pages(spark, folder).withColumn("html", F.replace("html", F.lit("}];"), more))


def _raw_csv(spark, folder, pages=_flow_pages):
    raw = market.raw_rows(pages(spark, folder))
    path = scratch_path(spark, "market-csv")
    files.write_csv(raw, path, mark=True)
    return files.read_csv(spark, path, raw.schema)


@query(
    "A9",
    f"""
    WITH others AS (
        SELECT page_id, ({_NAMES_OF_PAGE} * page_id + k) % {_NAMES} AS name, page_id || '-' || k AS value
        FROM pages, (SELECT unnest(range({_NAMES_OF_PAGE})) AS k)),
    joined AS (
        SELECT page_id, string_agg(value, ';' ORDER BY name) AS others FROM others GROUP BY page_id)
    SELECT CAST(page_id AS VARCHAR) AS id, 'other ' || page_id AS id_2, CAST(page_id AS VARCHAR) AS sn,
           CAST(length(html) AS VARCHAR) AS p1a, CAST(2 * length(url) AS VARCHAR) AS p1c,
           'say "' || page_id || '", or not' AS novo, url, others,
           10 + (SELECT count(DISTINCT name) FROM others) AS fields
    FROM pages JOIN joined USING (page_id)""",
)
def csv_sink_market(spark, folder):
    back = _raw_csv(spark, folder, _wild_pages)
    others = sorted((c for c in back.columns if re.fullmatch("x[0-9]+", c)), key=lambda c: int(c[1:]))
    return back.select(
        "id", F.col("ID_2").alias("id_2"), F.col("sN").alias("sn"), "p1a", "p1c", "novo", "url",
        F.concat_ws(";", *others).alias("others"), F.lit(len(back.columns)).cast("bigint").alias("fields"),
    )


@query(
    "A9",
    f"""
    SELECT url, 'x' || (({_NAMES_OF_PAGE} * page_id + k) % {_NAMES}) AS field, page_id || '-' || k AS value
    FROM pages, (SELECT unnest(range({_NAMES_OF_PAGE})) AS k)
    UNION ALL SELECT url, 'ID', 'other ' || page_id FROM pages
    UNION ALL SELECT url, 'sN', CAST(page_id AS VARCHAR) FROM pages""",
)
def market_fields(spark, folder):
    fields = market.raw_fields(_wild_pages(spark, folder)).drop("row")
    return fields.where(F.col("field").rlike("^(x[0-9]+|ID|sN)$"))


@query(
    "A3 A9 B2 B3 B4 B5 B6 B7 H1 D1 D2 F1 H13",
    """
    WITH market AS (
        SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS colecao, page_id AS id,
               DATE '2024-01-01' + CAST(length(url) AS INTEGER) AS date,
               length(html) AS a, length(url) AS b, 2 * length(url) AS c
        FROM pages)
    SELECT colecao, count(*) AS num_cards, strftime(min(date), '%Y-%m-%d') AS date,
           CAST(sum(a) AS DOUBLE) AS preco_min, CAST(sum(b) AS DOUBLE) AS preco_mean, CAST(sum(c) AS DOUBLE) AS preco_max,
           round_even(sum(a) / count(*), 1) AS preco_min_mean, round_even(sum(b) / count(*), 1) AS preco_mean_mean,
           round_even(sum(c) / count(*), 1) AS preco_max_mean
    FROM market GROUP BY colecao""",
)
def market_flow(spark, folder):
    """Captured pages to raw CSV, to clean rows, to the summary."""
    summary = market.collection_summary(market.market_clean(_raw_csv(spark, folder)), digits=1)
    return summary.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query(
    "A3",
    """
    SELECT url, 403 AS status, 'Response status code != 200' AS error
    FROM pages WHERE starts_with(url, 'http://')""",
)
def rejected_pages(spark, folder):
    return page_source.rejected(_titled_pages(spark, folder)).select("url", "status", "error")


@query(
    "H1",
    r"""
    SELECT page_id, CAST(regexp_extract(html, 'track\((\d+)\)', 1) AS BIGINT) AS track FROM pages""",
)
def embedded_scalar(spark, folder):
    found = text.embedded_json("html", r"track\((\d+)\)")
    return table(spark, folder, "pages").select("page_id", found.cast("bigint").alias("track"))


@query(
    "H2",
    """
    SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k FROM events""",
)
def json_fields(spark, folder):
    parsed = F.from_json("props", "k int")
    return table(spark, folder, "events").select("event_id", parsed["k"].alias("k"))


@query(
    "J2 H4 B7",
    f"""
    SELECT page_id, url, length({_PLAIN.format("html")}) AS characters,
           md5({_PLAIN.format("html")}) AS digest
    FROM pages""",
)
def html_unescape(spark, folder):
    plain = frames.map_texts_together(table(spark, folder, "pages"), text.unescape_html)
    return plain.select(
        "page_id", "url", F.length("html").alias("characters"), F.md5("html").alias("digest")
    )


@query(
    "B2 B3 B4 B5 B6",
    """
    SELECT o_orderpriority AS colecao, CAST(o_orderkey AS VARCHAR) AS id,
           o_totalprice AS preco_min, o_totalprice / 2 AS preco_max,
           coalesce(nullif(o_orderstatus, 'P'), o_orderpriority) AS num_raridade,
           strftime(o_orderdate, '%Y-%m-%d') AS date
    FROM orders""",
)
def rename_select_cast(spark, folder):
    raw = table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("sSigla"),
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_totalprice").cast("string").alias("p1a"),
        (F.col("o_totalprice") / 2).cast("string").alias("p1c"),
        F.nullif("o_orderstatus", F.lit("P")).alias("iR"),
        F.col("o_orderpriority").alias("iRaridade"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("dt"),
        F.col("o_custkey").alias("not_wanted"),
    )
    kept = frames.keep_columns(frames.rename_present(raw, market.RENAMES), market.RENAMES.values())
    cast = frames.cast_columns(kept, frames.columns_matching(kept, "preco"))
    dated = frames.to_dates(cast, ["date"])
    return dated.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query(
    "G1 B1",
    """
    SELECT o_orderkey, o_totalprice, NULL AS o_orderpriority, 'status F' AS url
    FROM orders WHERE o_orderstatus = 'F'
    UNION ALL
    SELECT o_orderkey, NULL, o_orderpriority, 'status O' FROM orders WHERE o_orderstatus = 'O'
    UNION ALL
    SELECT o_orderkey, o_totalprice, o_orderpriority, 'status P'
    FROM orders WHERE o_orderstatus = 'P'""",
)
def concat_by_name(spark, folder):
    columns = {
        "F": ["o_orderkey", "o_totalprice"],
        "O": ["o_orderkey", "o_orderpriority"],
        "P": ["o_orderkey", "o_totalprice", "o_orderpriority"],
    }
    orders = table(spark, folder, "orders")
    return frames.concat_frames(
        frames.with_source(
            orders.where(F.col("o_orderstatus") == status).select(*names), f"status {status}"
        )
        for status, names in columns.items()
    )


@query(
    "G2",
    """
    SELECT l_orderkey AS id, unnest([l_extendedprice, l_extendedprice, l_quantity]) AS price
    FROM lineitem""",
)
def flatten_lists(spark, folder):
    row = lambda price: F.struct(F.col("l_orderkey").alias("id"), F.col(price).alias("price"))
    lists = F.array(
        F.array(row("l_extendedprice"), row("l_extendedprice")), F.array(row("l_quantity"))
    )
    nested = table(spark, folder, "lineitem").select(lists.alias("rows"))
    return frames.flatten_rows(nested, "rows")


@query(
    "C8",
    """
    SELECT c_custkey, n_name AS url FROM customer JOIN nation ON c_nationkey = n_nationkey
    WHERE n_name IN (SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey
                     WHERE r_name IN ('ASIA', 'EUROPE'))""",
)
def semi_collections(spark, folder):
    nations = table(spark, folder, "nation")
    regions = table(spark, folder, "region").where(F.col("r_name").isin("ASIA", "EUROPE"))
    listed = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    rows = table(spark, folder, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    named = rows.select("c_custkey", F.col("n_name").alias("url"))
    return page_source.in_collections(named, listed.select(F.col("n_name").alias("url")))


def _brand_pages(spark, folder):
    """One captured page per part; brands 1 to 12 stand for the listed collections."""
    number = F.substring("p_brand", 7, 2).cast("int")
    listed = F.array(*[F.lit(url) for url in page_source.COLLECTIONS])
    row = F.struct(
        F.col("p_brand").alias("sSigla"),
        F.col("p_partkey").cast("string").alias("id"),
        F.col("p_name").alias("nEN"),
        F.col("p_retailprice").cast("string").alias("p1a"),
    )
    return table(spark, folder, "part").select(
        F.coalesce(F.get(listed, number - 1), F.lit("https://other.example/")).alias("url"),
        F.lit(200).alias("status"),
        F.concat(F.lit("<script>var cardsjson = "), F.to_json(F.array(row)), F.lit(";</script>")).alias("html"),
    )


_URLS = ", ".join(f"({i}, '{url}')" for i, url in enumerate(page_source.COLLECTIONS, 1))


@query(
    "A4 A6 C8 H1",
    f"""
    SELECT c.url, p_brand AS colecao, count(*) AS num_cards,
           round(sum(p_retailprice), 2) AS preco_min
    FROM part JOIN (VALUES {_URLS}) AS c(number, url)
      ON CAST(substring(p_brand, 7) AS INTEGER) = c.number
    GROUP BY c.url, p_brand""",
)
def crawl_collections(spark, folder):
    listed = page_source.collection_list(spark)
    rows = market.market_rows(_brand_pages(spark, folder), listed)
    priced = rows.select(
        "url", F.col("sSigla").alias("colecao"), F.col("p1a").cast("double").alias("preco_min")
    )
    return priced.groupBy("url", "colecao").agg(
        F.count(F.lit(1)).alias("num_cards"), F.round(F.sum("preco_min"), 2).alias("preco_min")
    )


@query(
    "A6",
    """
    SELECT p_brand AS "sSigla", CAST(p_partkey AS VARCHAR) AS id, p_name AS "nEN"
    FROM part WHERE p_brand = 'Brand#3'""",
)
def set_page(spark, folder):
    rows = market.set_rows(_brand_pages(spark, folder), page_source.COLLECTIONS[2])
    return rows.select("sSigla", "id", "nEN")


def _variation_pages(spark, folder):
    """Events as variation pages: the type gives the direction, the value the period."""
    kind = F.col("event_type")
    direction = F.when(kind.isin("click", "purchase"), "alta").when(kind != "error", "queda")
    value = F.col("value")
    period = F.when(value < 10, "dia").when(value < 30, "semana").otherwise("mes")
    row = F.struct(
        F.col("event_id").cast("string").alias("id"), F.col("value").cast("string").alias("p1a")
    )
    return table(spark, folder, "events").select(
        F.coalesce(
            text.variation_url(direction, numbers.period_code(period)), F.lit("not an address")
        ).alias("url"),
        F.lit(200).alias("status"),
        F.concat(F.lit("var cardsjson = "), F.to_json(F.array(row)), F.lit(";")).alias("html"),
    )


@query(
    "A5 H7 H14",
    """
    SELECT CAST(event_id AS VARCHAR) AS id, value AS price,
           'https://www.ligapokemon.com.br/?view=cards/variacao&show=queda&formato=&order=3' AS url
    FROM events WHERE event_type IN ('view', 'signup') AND value >= 30""",
)
def variation_rows(spark, folder):
    rows = market.variation_rows(_variation_pages(spark, folder), "queda", "mes")
    return rows.select("id", F.col("p1a").cast("double").alias("price"), "url")


@query(
    "A5",
    """
    SELECT page_id,
           nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page,
           nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS ref
    FROM pages""",
)
def url_parameters(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id",
        text.url_parameter("url", "page").alias("page"),
        text.url_parameter("url", "ref").alias("ref"),
    )
