"""Every registered query with an oracle gives the oracle's rows on the smallest tables."""

import duckdb
import pytest

from sievewright.plans import candidate_queries, catalogue, collect_queries, field_queries, gate_queries, io_queries, memory_queries, oracle, policy_queries, quality_queries, streams  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(row, columns):
    out = []
    for c in columns:
        v = row[c]
        v = v.item() if hasattr(v, "item") else v
        out.append("" if v is None or v != v else repr(round(float(v), 6)) if isinstance(v, (bool, int, float)) else str(v))
    return tuple(out)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_matches_its_oracle(spark, duck, name):
    mine = catalogue.QUERIES[name](spark, SF).toPandas()
    theirs = duck.sql(oracle.SQL[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    rows = lambda df: sorted(plain(r, columns) for r in df.to_dict("records"))
    assert rows(mine) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(oracle.SQL)))
def test_query_without_oracle_gives_rows(spark, name):
    got = catalogue.QUERIES[name](spark, SF)
    assert got.count() > 0 and len(set(got.columns)) == len(got.columns)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
