"""Every query of the library against its DuckDB twin; a few of a minute each only if SIGSTAB_ALL is set."""

import math
import os
from functools import cache
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from sigstab import catalog, final_queries, queries

#: Queries that fit models for a minute or so; their operators have tests of their own.
SLOW = {"rank_scores_all_types", "double_cross_validation_oversampled", "ridge_grid_search", "svm_weights_rank"}
CHOSEN = sorted(catalog.QUERIES if os.environ.get("SIGSTAB_ALL") else catalog.QUERIES.keys() - SLOW)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.fixture(scope="module", autouse=True)
def one_search():
    """The ranks and the search of a folder are worked out once for all queries that begin with them."""
    with pytest.MonkeyPatch.context() as patch:
        for name in ("ranked_of", "searched"):
            once = cache(getattr(queries, name))
            for module in (queries, final_queries):
                patch.setattr(module, name, once)
        yield


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}" if v else "0"
    return [plain(x) for x in v] if isinstance(v, list) else str(v)


def table(rows, names, columns):
    at = [names.index(c) for c in columns]
    return sorted(repr([plain(r[i]) for i in at]) for r in rows)


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, duck, small, name):
    df = catalog.QUERIES[name](spark, small)
    rows = [tuple(r) for r in df.collect()]
    spark.catalog.clearCache()
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    found = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    columns = sorted(df.columns)
    assert sorted(names) == columns
    assert table(rows, df.columns, columns) == table(found.fetchall(), names, columns)


def test_driver_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
    assert catalog.QUERIES.keys() <= __spark_entry__.queries().keys()
