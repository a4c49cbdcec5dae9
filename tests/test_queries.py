"""Every query against its SQL on the smallest tables."""

import math
import os
import pkgutil
import subprocess
import sys

import duckdb
import pytest

from tidemark import plans
from tidemark.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    return f"{v:.5g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, DIR)
    want = con.execute(catalog.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    rows = sorted(tuple(plain(r[c]) for c in order) for r in got.collect())
    assert rows == sorted(tuple(plain(r[names.index(c)]) for c in order) for r in want.fetchall())


@pytest.mark.parametrize("name", [m.name for m in pkgutil.iter_modules(plans.__path__)])
def test_a_worker_can_import_each_module_alone(name):
    """A query's function is unpickled where nothing else of the package is loaded."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", f"import tidemark.plans.{name}"], cwd=root, check=True, timeout=120)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
