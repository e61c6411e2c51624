import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


def rows_of(columns: list[str], rows) -> list[str]:
    return sorted("|".join(repr(r[c].tolist() if hasattr(r[c], "tolist") else r[c]) for c in columns) for r in rows)


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Runs a query and its SQL over the smallest tables and compares all rows."""
    import duckdb

    con = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")

    def check(query, sql):
        a = query(spark, SMALL).toPandas()
        b = con.execute(sql).df()
        columns = sorted(a.columns)
        assert columns == sorted(b.columns)
        assert rows_of(columns, a.to_dict("records")) == rows_of(columns, b.to_dict("records"))

    return check
