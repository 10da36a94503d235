"""Every query of the mail engine against its SQL in DuckDB, at the smallest scale."""

import numbers

import duckdb
import pandas as pd
import pytest

from mailcorpus.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    show = lambda v: "NULL" if v is None or pd.isna(v) else f"{float(v):.6f}" if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v)
    return sorted(tuple(show(v) for v in row) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_domain_tokens_of_whole_bodies(spark, duck):
    """Bodies without a planted link hold hosts, too."""
    got = {r.path: r.n for r in registry.QUERIES["body_domain_tokens"](spark, SF).collect()}
    planted = {r.path: 2 if "/m" in r.path and int(r.path.split("/m")[1].split(".")[0]) % 11 == 5 else 0 for r in registry.QUERIES["recipient_count"](spark, SF).collect()}
    assert set(got) == set(planted) and any(got[p] > n for p, n in planted.items())
    assert all(got[p] >= n for p, n in planted.items())
