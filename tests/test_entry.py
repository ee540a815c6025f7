import pathlib

import pytest

import __spark_entry__ as entry

DATA = pathlib.Path("/root/testdata/sf0.001")


def test_names_agree():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names
    assert "entry_pairing" in names


@pytest.mark.skipif(not DATA.is_dir(), reason="test tables are not there")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not DATA.is_dir(), reason="test tables are not there")
@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not n.startswith("op")])
def test_query_equals_sql(spark, name):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    got = entry.queries()[name](spark, str(DATA)).toPandas()
    want = con.execute(entry.oracle_sql()[name]).fetch_df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)

    def plain(df):
        value = lambda v: "" if pd.isna(v) else f"{v:.6g}" if isinstance(v, float) else str(v)
        return sorted(tuple(value(v) for v in row) for row in df[columns].astype(object).itertuples(index=False))

    a, b = plain(got), plain(want)
    number = lambda x: float(x) if x.replace(".", "", 1).replace("-", "").isdigit() else None
    same = lambda x, y: x == y or (number(x) is not None and number(y) is not None and abs(number(x) - number(y)) <= 1e-4 * max(1, abs(number(x))))
    assert len(a) == len(b)
    assert all(all(map(same, x, y)) for x, y in zip(a, b, strict=True))
