"""Every registered relational query against its SQL oracle on the smallest data."""

import duckdb
import pytest

from binweave.plans import catalog

from conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = catalog.oracle_sql()
QUERIES = catalog.queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def normal(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rel = con.sql(ORACLES[name])
    assert sorted(rel.columns) == columns
    got = normal(tuple(r[c] for c in columns) for r in df.collect())
    at = [rel.columns.index(c) for c in columns]
    want = normal(tuple(r[i] for i in at) for r in rel.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-6) for x, y in zip(a, b, strict=True)), (a, b)


def test_model_queries_run_their_operators_defaults(spark, monkeypatch):
    """m4_boosted and m20_mlp pass no smaller job than the operators' own parameters."""
    from binweave.operators import boosting, network

    class Seen(Exception):
        pass

    def settings(*args, **named):
        raise Seen(named)

    for name, module, operator in (("m4_boosted", boosting, "rolling_trees"), ("m20_mlp", network, "fit")):
        monkeypatch.setattr(module, operator, settings)
        with pytest.raises(Seen) as seen:
            QUERIES[name](spark, SF)
        assert seen.value.args == ({},)


def test_scalar_subquery_compares_parts_of_a_second(spark, con, tmp_path):
    """The limit has microseconds: a row just below it, in the same second, stays out."""
    import datetime as dt

    first = dt.datetime(2024, 1, 1, 0, 0, 11, 172425)
    us = dt.timedelta(microseconds=1)
    rows = [(0, first, "error"), (1, first + dt.timedelta(days=10) - us, "view"), (2, first + dt.timedelta(days=10), "view"), (3, first + dt.timedelta(days=10) + us, "click"), (4, None, "view")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    sql = ORACLES["p19_scalar_subquery"].replace("from events", f"from '{tmp_path}/events.parquet/*.parquet'")
    got = sorted(r.event_id for r in QUERIES["p19_scalar_subquery"](spark, str(tmp_path)).collect())
    assert got == sorted(r[0] for r in con.sql(sql).fetchall()) == [2, 3]
