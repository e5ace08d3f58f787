"""DuckDB, pandas and numpy for four headline jobs, to compare ``bench.py`` with.

``python tests/single_node.py [FOLDER]`` prints one JSON line. Each job reads its Parquet files.
"""

import html
import json
import sys
import time

import duckdb
import numpy as np
import pandas as pd

FOLDER = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"


def collection_summary():
    return duckdb.sql(f"""
        SELECT p_brand, count(*) AS num_cards, min(l_shipdate) AS date,
               sum(l_extendedprice * (1 - l_discount)) AS preco_min, sum(l_extendedprice) AS preco_mean,
               sum(l_extendedprice * (1 + l_tax)) AS preco_max
        FROM '{FOLDER}/lineitem.parquet' JOIN '{FOLDER}/part.parquet' ON l_partkey = p_partkey
        GROUP BY p_brand ORDER BY date DESC""").arrow()


def embedded_table():
    return duckdb.sql(f"""
        WITH pages AS (
            SELECT '<html>' || chr(10) || '<script>var cardsjson = [{{"id": "' || event_id || '", "p1a": ' || value || '}}];'
                   || chr(10) || '</script></html>' AS page
            FROM '{FOLDER}/events.parquet'),
        found AS (SELECT unnest(CAST(regexp_extract(page, 'var cardsjson = (\\[.*?\\]);', 1, 's') AS JSON[])) AS row FROM pages)
        SELECT row->>'id' AS id, row->>'p1a' AS p1a FROM found""").arrow()


def html_unescape():
    pages = pd.read_parquet(f"{FOLDER}/pages.parquet")
    return pages["html"].map(html.unescape)


def best_match():
    """One matrix product."""
    rows = pd.read_parquet(f"{FOLDER}/embeddings.parquet")["embedding"]
    index = np.stack([np.asarray(v, dtype=np.float64) for v in rows])
    queries = index + 0.5 * index[:, ::-1]
    scores = (queries / np.linalg.norm(queries, axis=1, keepdims=True)) @ (index / np.linalg.norm(index, axis=1, keepdims=True)).T
    return scores.argmax(axis=1), scores.max(axis=1)


def main():
    spent = {}
    for job in (collection_summary, embedded_table, html_unescape, best_match):
        start = time.perf_counter()
        job()
        spent[job.__name__] = round(time.perf_counter() - start, 3)
    print(json.dumps(spent))


if __name__ == "__main__":
    main()
