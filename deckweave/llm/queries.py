"""The registered queries of this subpackage and the SQL that checks them."""

from collections.abc import Callable
from dataclasses import dataclass

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from deckweave.llm import decontaminate, filter_audit, html_text, language, near_dups, packing, quality, secret_forest, spelling, token_counts, token_files, tree_bpe, url_templates
from deckweave.session import scratch_path


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "tokens")
    docs = table(spark, sf_dir, "documents")
    token_files.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), folder, end_id=2)
    return token_files.document_digests(spark, folder)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_forest.findings(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.token_counts(docs, public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op8_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge(table(spark, sf_dir, "pages")).drop("rate")


def _level_sql(k: int) -> str:
    """A level of the tree: branches that are frequent and apart keep their segment."""
    return f"""
a{k} AS (SELECT *, coalesce(seg[{k + 1}], '/') AS segment FROM t{k}),
b{k} AS (
  SELECT *, sum(n) OVER p AS p_n, sum(labels) OVER p AS p_labels, sum(blocked) OVER p AS p_blocked,
    sum(n) OVER b AS b_n, sum(labels) OVER b AS b_labels, sum(blocked) OVER b AS b_blocked
  FROM a{k} WINDOW p AS (PARTITION BY host, template), b AS (PARTITION BY host, template, segment)),
c{k} AS (
  SELECT *, (p_blocked + 0.5::DOUBLE) / (p_labels + 1::DOUBLE) AS pooled, greatest(b_labels, 1) AS known FROM b{k}),
d{k} AS (
  SELECT host, seg, n, labels, blocked, rate AS above, list_append(template, CASE WHEN segment = '/' THEN ''
    WHEN b_n >= 3 AND b_labels > 0
      AND abs(b_blocked / known - pooled) > 2::DOUBLE * sqrt(pooled * (1 - pooled) / known) THEN segment
    ELSE '*' END) AS template
  FROM c{k}),
t{k + 1} AS (
  SELECT host, seg, n, labels, blocked, template,
    (sum(blocked) OVER t + 4::DOUBLE * above) / (sum(labels) OVER t + 4::DOUBLE) AS rate
  FROM d{k} WINDOW t AS (PARTITION BY host, template))"""


OP8_SQL = (
    r"""
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule,
    list_transform(string_split(regexp_replace(path, '^/', ''), '/'), lambda s: CASE
      WHEN regexp_full_match(s, '[0-9]+') THEN '{n}'
      WHEN regexp_full_match(s, '[0-9a-fA-F-]{8,}') AND regexp_matches(s, '[0-9]') THEN '{hex}'
      WHEN regexp_matches(s, '[0-9]') THEN regexp_replace(s, '[0-9]+', '{n}', 'g') ELSE s END) AS parts
  FROM u),
p AS (
  SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS decided,
    CASE WHEN len(parts) > 3 THEN list_append(parts[1:2], array_to_string(parts[3:], '/')) ELSE parts END AS seg
  FROM r),
counted AS (
  SELECT host, seg, count(*) AS n, count(decided) AS labels, count(*) FILTER (decided = 'block') AS blocked
  FROM p GROUP BY host, seg),
whole AS (SELECT (sum(blocked) + 0.5::DOUBLE) / (sum(labels) + 1::DOUBLE) AS overall FROM counted),
t0 AS (
  SELECT host, seg, n, labels, blocked, CAST([] AS VARCHAR[]) AS template,
    (sum(blocked) OVER h + 4::DOUBLE * overall) / (sum(labels) OVER h + 4::DOUBLE) AS rate
  FROM counted, whole WINDOW h AS (PARTITION BY host)),"""
    + ",".join(map(_level_sql, range(3)))
    + """
SELECT page_id, host, path, rule,
  coalesce(decided, CASE WHEN rate > 0.8::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict,
  array_to_string(template, '/') AS template
FROM p JOIN t3 USING (host, seg)
"""
)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predictions(table(spark, sf_dir, "documents"))


def op10_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return tree_bpe.round_trip_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.learn(pages))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hit_digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP7_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS gram
  FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM (SELECT *, least(len(w), 10) AS size FROM b WHERE len(w) > 0))),
dw AS (
  SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS gram
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)),
hits AS (SELECT doc_id, i, size, item_id FROM dw JOIN bw USING (size, gram)),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM hits))
  GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL)
  GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"), drop_every=97)


# The polynomial of the unsigned crc32 by eight halvings for each byte of a table, then byte by byte.
_CRC_STEP = "list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)"
OP11_SQL = f"""
WITH RECURSIVE bits AS (SELECT list_transform(range(256), lambda b: CAST({_CRC_STEP} AS BIGINT)) AS crc_of),
runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY doc_id, run),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(strlen(name)), lambda i: CAST('0x' || hex(name)[2 * i + 1:2 * i + 2] AS BIGINT))),
      lambda c, b: xor(c // 256, crc_of[xor(c % 256, b) + 1]))) AS h
  FROM (SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS name FROM runs), bits),
words AS (
  SELECT word, sum(n) AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2)
               ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (
  SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, w.word FROM cut a JOIN words w ON a.rest = w.word
  UNION SELECT w.word, a.word FROM cut a JOIN words w ON a.rest = w.word),
ranked AS (
  SELECT near.word, other, o.n AS other_n, w.n,
    count(*) OVER (PARTITION BY near.word) AS n_near,
    row_number() OVER (PARTITION BY near.word ORDER BY o.n DESC, other) AS place
  FROM near JOIN words w ON near.word = w.word JOIN words o ON other = o.word),
formed AS (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * words.n THEN other END AS form,
    CASE WHEN other_n >= 2 * words.n THEN other_n END AS form_n
  FROM words LEFT JOIN ranked ON words.word = ranked.word AND place = 1),
ways AS (
  SELECT word, word AS here, 0 AS step FROM formed
  UNION ALL
  SELECT ways.word, form, step + 1 FROM ways JOIN formed ON here = formed.word WHERE form IS NOT NULL)
SELECT formed.word, form, root, CAST(n AS BIGINT) AS n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n
FROM formed JOIN (SELECT word, max_by(here, step) AS root FROM ways GROUP BY word) USING (word)
"""


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, with_ids=False)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# The counts of the cells by part, then every order and step beside them.
OP13_SQL = """
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
    min(doc_id) OVER (PARTITION BY text) AS first_id
  FROM t),
marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (CASE WHEN len(words) < 200 THEN 'A' ELSE '' END)
    || (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN doc_id > first_id THEN 'E' ELSE '' END) AS fails
  FROM w LEFT JOIN marks USING (doc_id)),
cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
orders AS (
  SELECT '' AS filter_order
  UNION ALL
  SELECT filter_order || name FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS name)
  WHERE NOT contains(filter_order, name)),
steps AS (
  SELECT filter_order, step, filter_order[step] AS name, filter_order[1:step - 1] AS earlier
  FROM orders, (SELECT unnest(range(1, 6)) AS step) WHERE length(filter_order) = 5),
summed AS (
  SELECT part, filter_order, step, name,
    sum(n) FILTER (translate(fails, earlier || name, '') = fails) AS kept,
    sum(n) FILTER (contains(fails, name) AND translate(fails, earlier, '') = fails) AS removed,
    sum(n) FILTER (contains(fails, name) AND translate(fails, earlier, '') <> fails) AS redundant,
    sum(n) FILTER (fails = name) AS unique_fails,
    sum(good) FILTER (contains(fails, name) AND translate(fails, earlier, '') = fails) AS good_lost,
    sum(toxic) FILTER (contains(fails, name) AND translate(fails, earlier, '') = fails) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, name)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept,
  CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
  CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, name) AS BIGINT) AS shapley
FROM summed
"""


def load() -> dict[str, Query]:
    return {
        "op1_token_files": Query(op1_token_files),
        "op2_secrets": Query(op2_secrets),
        "op3_quality": Query(op3_quality),
        "op4_token_counts": Query(op4_token_counts),
        "op5_html_text": Query(op5_html_text),
        "op6_near_duplicates": Query(op6_near_duplicates),
        "op7_decontaminate": Query(op7_decontaminate, OP7_SQL),
        "op8_url_templates": Query(op8_url_templates, OP8_SQL),
        "op9_language": Query(op9_language),
        "op10_tree_bpe": Query(op10_tree_bpe),
        "op11_spelling_groups": Query(op11_spelling_groups, OP11_SQL),
        "op12_packing": Query(op12_packing),
        "op13_filter_audit": Query(op13_filter_audit, OP13_SQL),
    }
