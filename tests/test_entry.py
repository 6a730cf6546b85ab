"""Driver contract and a few oracle comparisons at sf0.001."""

import duckdb

import __spark_entry__ as E
from msgscreen.sources.tables import TABLES
from tools.check_oracle import digest

from .conftest import SF0001


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "spam_type" in df.columns


def test_every_query_has_oracle_or_is_documented():
    rows_only = {"m3_text_classifier", "m3_loss_curve", "m3_minibatch_classifier"}  # trained: compared with plain trainers
    assert set(E.QUERIES) - set(E.oracle_sql()) == rows_only


def test_oracle_small(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    for name in ["h8_batch_classify", "u2_u11_url_features", "c7_stratified_split", "t7_spend_gate",
                 "e1_e6_model_metrics"]:
        df = E.queries()[name](spark, SF0001)
        rel = con.sql(E.oracle_sql()[name])
        a = digest(df.columns, [tuple(r) for r in df.collect()])[0]
        b = digest(rel.columns, rel.fetchall())[0]
        assert a == b, name
