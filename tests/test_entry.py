"""Driver contract and a sample of oracle checks at sf0.001."""

import duckdb

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events"]


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["source_id", "avg_trust_score", "avg_completeness",
                          "avg_accuracy"]
    assert len(rows) == 5


def test_oracles_are_a_subset_of_queries():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)


def test_sample_of_oracles_match(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    q, o = entry.queries(), entry.oracle_sql()
    for name in ["trust_by_source", "rolling_reputation_bucketed",
                 "sliding_reputation", "unify_feeds", "json_roundtrip"]:
        a = sorted(repr(tuple(r)) for r in q[name](spark, SF).collect())
        cur = con.execute(o[name])
        b = sorted(repr(tuple(r)) for r in cur.fetchall())
        assert len(a) == len(b), name
        assert a == b, name
