import os
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[1])
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, str(Path(__file__).resolve().parent), os.environ.get("PYTHONPATH", "")])  # workers import functions of tests as well
sys.path.insert(0, ROOT)

import duckdb  # noqa: E402
import pytest  # noqa: E402

from tessella.plans.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", 4, **{"spark.sql.shuffle.partitions": "4", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.driver.memory": "3g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def plain(x):
    """A value that compares across engines."""
    if isinstance(x, (list, tuple)) and not hasattr(x, "asDict"):
        return tuple(map(plain, x))
    return x


def rows_of(df) -> list:
    """Sorted rows of a Spark DataFrame, columns by name."""
    cols = sorted(df.columns)
    return sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)


def oracle(sql: str, sf_dir: str = SF) -> tuple[list[str], list]:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)


def assert_same(df, sql: str, sf_dir: str = SF) -> None:
    names, expected = oracle(sql, sf_dir)
    assert sorted(df.columns) == names
    assert rows_of(df) == expected
