"""Every query with SQL gives what DuckDB gives; the others give rows. The corpus queries have their own tests."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from pagewright.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    return None if value is None or isinstance(value, float) and math.isnan(value) else value


def rows(frame):
    return sorted((tuple(map(plain, x)) for x in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, name):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    if name not in catalog.ORACLE_SQL:
        assert len(got)
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["docx_shred", "docx_extract", "docx_rebuild"])
def test_documents_hold_whole_texts(spark, sf_dir, name):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").toPandas()
    text = {(x.conv_id, f"{x.turn:08X}"): f"{x.text or ''} end".replace("\n", " ") for x in turns.itertuples()}
    assert max(map(len, text.values())) > 1004
    got = catalog.QUERIES[name](spark, sf_dir).toPandas().groupby(["conv_id", "para_id"])["text"].agg("".join)
    assert set(got.index) == set(text) and all(text[at] in x for at, x in got.items())


def test_contract(spark):
    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
