"""Driver contract: entry() runs at sf0.001, every query has a unique name."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["doc_id", "term", "weight"]
    assert df.count() > 0


def test_oracles_belong_to_queries():
    qs, orc = E.queries(), E.oracle_sql()
    assert set(orc) <= set(qs)
    assert len(qs) >= 90


def test_every_oracle_binds_in_duckdb():
    """Each oracle statement parses and binds against the driver's tables."""
    import duckdb

    from spanfold.sources.tables import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    for name, sql in E.oracle_sql().items():
        cols = [r[0] for r in con.sql(f"DESCRIBE {sql}").fetchall()]
        assert cols, name
