import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), *filter(None, [os.environ.get("PYTHONPATH")])])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    folder = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(folder / "warehouse"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tiny():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def same_as_sql(tiny):
    """A check that a DataFrame has the rows of a DuckDB query over the tables of a folder."""
    import duckdb

    def plain(value):
        if isinstance(value, float):
            return round(value, 9)
        return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value

    def check(df, sql, folder=None, tables=None):
        con = duckdb.connect()
        for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{(tables or {}).get(name) or f'{folder or tiny}/{name}.parquet'}')")
        expected = con.sql(sql)
        columns = sorted(expected.columns)
        assert sorted(df.columns) == columns
        at = [expected.columns.index(c) for c in columns]
        want = sorted(repr(tuple(plain(r[i]) for i in at)) for r in expected.fetchall())
        have = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
        assert have == want

    return check
