"""The queries against the SQL that states their results, at the smallest scale and on planted links."""

from __future__ import annotations

from pathlib import Path

import duckdb
import numpy as np
import pytest

from zonecast.llm import queries

DATA = Path("/root/testdata/sf0.001")


def compare(spark, folder, name):
    sql = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        sql.execute(f"create view {path.stem} as select * from read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    df = queries.QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    found = sql.execute(f"select {', '.join(columns)} from ({queries.ORACLE_SQL[name]})").fetchall()
    got = sorted(tuple(map(str, (r[c] for c in columns))) for r in df.collect())
    assert got == sorted(tuple(map(str, r)) for r in found)
    return got


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    assert compare(spark, DATA, name)


def test_planted_vectors(spark, tmp_path):
    """Pairs at cosines from 0.90 to 0.99, chains and copies among others, with the query's own parameters."""
    rng = np.random.default_rng(41)
    rows = rng.standard_normal((400, 48))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    for k in range(0, 200, 2):
        other = rng.standard_normal(48)
        other -= (other @ rows[k]) * rows[k]
        cosine = 0.90 + 0.09 * k / 200
        rows[k + 1] = cosine * rows[k] + np.sqrt(1 - cosine**2) * other / np.linalg.norm(other)
    rows[300:305] = rows[1]
    table = spark.createDataFrame([(k, v.astype(np.float32).tolist(), None) for k, v in enumerate(rows)], "vec_id long, embedding array<float>, label int")
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    linked = compare(spark, tmp_path, "op1_embedding_dedup")
    assert len(linked) == 400 and any(r != linked[0] for r in linked)


def test_planted_urls(spark, tmp_path):
    """Rules, odd urls, labelled and unlabelled ones."""
    from tests.llm.test_pages import URLS
    from zonecast.llm import url_filter

    urls = [*URLS, *(u for u, _ in url_filter.labelled_urls()), "http://x.org/a\nb/😀?q"]
    spark.createDataFrame([(k, u, "") for k, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert len(compare(spark, tmp_path, "op8_url_filter")) == len(urls)
