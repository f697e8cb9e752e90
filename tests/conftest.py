import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ["PYTHONPATH"] = str(Path(__file__).resolve().parent.parent) + ":" + os.environ.get("PYTHONPATH", "")
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Compare a query with its SQL on the same tables: columns, and rows as multisets."""
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")

    def plain(v):
        return repr(v) if not isinstance(v, float) else ("nan" if v != v else repr(v))

    def check(query, sql):
        df = query(spark, SF)
        columns = sorted(df.columns)
        mine = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
        found = con.sql(sql)
        assert sorted(found.columns) == columns
        at = [found.columns.index(c) for c in columns]
        theirs = sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
        assert mine == theirs
        assert mine

    return check
