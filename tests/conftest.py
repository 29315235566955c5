import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from tidegauge.session import session

    return session(8)


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def medium():
    return f"{DATA}/sf0.01"


@pytest.fixture(scope="session")
def duck(medium):
    import duckdb

    con = duckdb.connect()
    for path in Path(medium).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.fixture(scope="session")
def same(spark, duck, medium):
    """Holds a registered query against its SQL, row for row."""
    import __spark_entry__

    def check(name):
        df = __spark_entry__.queries()[name](spark, medium)
        columns = sorted(df.columns)
        found = duck.execute(__spark_entry__.oracle_sql()[name])
        assert sorted(x[0] for x in found.description) == columns
        order = [[x[0] for x in found.description].index(c) for c in columns]
        want = sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=repr)
        got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
        assert got == want, [x for x in zip(got, want) if x[0] != x[1]][:3]

    return check
