import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def same():
    """Whether a Spark query and its SQL over the same tables give the same rows."""
    import duckdb

    def norm(v):
        if isinstance(v, float):
            return f"{v:.9g}"
        if isinstance(v, (list, tuple)):
            return [norm(x) for x in v]
        return str(v)

    def check(df, sql, sf_dir):
        con = duckdb.connect()
        for f in Path(sf_dir).glob("*.parquet"):
            con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
        r = con.execute(sql)
        names = [d[0] for d in r.description]
        assert sorted(names) == sorted(df.columns)
        want = sorted(str([norm(row[names.index(c)]) for c in sorted(names)]) for row in r.fetchall())
        got = sorted(str([norm(row[c]) for c in sorted(names)]) for row in df.collect())
        assert got == want

    return check
