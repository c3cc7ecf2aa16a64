import duckdb
import pytest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="session")
def agree():
    """Holds a query against SQL over the same folder: names, and rows in any order."""

    def check(df, sql, sf_dir):
        con = duckdb.connect()
        for t in TABLES.split():
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
        want = con.execute(sql)
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(df.columns)
        rows = sorted(map(repr, want.fetchall()))
        assert sorted(repr(tuple(r)) for r in df.select(*names).collect()) == rows
        return len(rows)

    return check
