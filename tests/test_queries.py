"""Every query with SQL gives the same rows as DuckDB, over whole tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else 0.0 if v == 0 else v
    return columns, sorted((tuple(map(plain, r)) for r in frame[columns].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, oracle, name):
    got, want = rows(__spark_entry__.queries()[name](spark, SF).toPandas()), rows(oracle.sql(SQL[name]).df())
    assert got[0] == want[0]
    assert got[1] == want[1] and got[1]


@pytest.mark.parametrize("name", ["true_peak", "wsola", "lead_expand"])
def test_queries_without_sql_run(spark, name):
    rows_ = __spark_entry__.queries()[name](spark, SF).collect()
    assert rows_ and not any(getattr(r, "error", None) for r in rows_)


def test_streams_do_not_depend_on_how_files_are_cut(spark, tmp_path):
    """The same events in one file and in five, in order of time."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    cuts = [None, *(r.ts for r in events.select("ts").orderBy("ts").collect()[200::200]), None]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = events if a is None else events.where(events.ts >= a)
        part = part if b is None else part.where(part.ts < b)
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
        for f in (tmp_path / "events.parquet").glob("*.parquet"):
            if f.stat().st_mtime > 1e9 + 100:
                os.utime(f, (1e9 + k, 1e9 + k))
    for name in ("stream_meter", "stream_limiter"):
        one, many = (rows(__spark_entry__.queries()[name](spark, sf).toPandas()) for sf in (SF, str(tmp_path)))
        assert one == many and one[1]


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).columns == ["doc_a", "doc_b", "similarity", "containment"]


def test_import_without_the_optional_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    shutil.copytree(f"{root}/tempograph", tmp_path / "tempograph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert set(e.queries()) - set(e.oracle_sql()) == {'true_peak', 'wsola', 'lead_expand'} and not any(q.startswith('op') or q == 'pipeline' for q in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}).returncode == 0
