"""SQL of the recursive queries against Spark on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as registered

DATA = "/root/testdata/sf0.001"


def _sorted(rows):
    return sorted((tuple("-" if v is None or v != v else round(v, 5) + 0.0 if isinstance(v, float) else str(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", ["daily_volatility", "triple_barrier_scaled", "dagostino", "stochastic_rsi", "pivots_by_volatility", "anchored_vwap", "frac_diff_expanding"])
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for table in ("lineitem", "events"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DATA}/{table}.parquet')")
    found = registered.queries()[name](spark, DATA)
    columns = sorted(found.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({registered.oracle_sql()[name]})").fetchall()
    assert _sorted(map(tuple, found.select(columns).collect())) == _sorted(want)
