import datetime
import math
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

from tables import SF

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def rows_of(table) -> list:
    names = sorted(table.column_names)
    return sorted((tuple(plain(r[n]) for n in names) for r in table.to_pylist()), key=repr)


@pytest.fixture(scope="session")
def same_as_sql():
    """Compares a query with its SQL on the tables of a folder: names, rows, values."""

    def compare(df, sql, folder=SF):
        con = duckdb.connect()
        for p in Path(folder).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
        got = con.execute(sql)
        want = got.to_arrow_table() if hasattr(got, "to_arrow_table") else got.fetch_arrow_table()
        have = df.toArrow()
        assert sorted(have.column_names) == sorted(want.column_names)
        assert rows_of(have) == rows_of(want)

    return compare
