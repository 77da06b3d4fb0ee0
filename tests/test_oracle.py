"""Every catalogue query against its DuckDB SQL on the smallest tables; the Spark side runs several queries at a time."""

import os
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from mediagrain import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries without SQL, each tested against a plain version elsewhere.
PLAIN = {"c11_merge_credits", "sim1b_block_ratio"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def collected(spark, request):
    """A function of a query's name that gives its columns and rows, which are being collected meanwhile, with whole-stage code generation as users have it."""
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    asked = [x.callspec.params["name"] for x in request.session.items if x.name.startswith("test_matches_sql")]

    def run(name):
        got = plans.queries()[name](spark, SF)
        return got.columns, [x.asDict() for x in got.collect()]

    with ThreadPoolExecutor(6) as pool:
        found = {name: pool.submit(run, name) for name in asked}
        yield lambda name: found[name].result()
    spark.conf.set("spark.sql.codegen.wholeStage", "false")


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return v.replace(tzinfo=None) if getattr(v, "tzinfo", None) else v


def rows(dicts):
    return sorted(repr([(k, plain(v)) for k, v in sorted(d.items())]) for d in dicts)


NAMES = sorted(plans.oracle_sql())


def test_every_query_has_sql():
    assert set(plans.queries()) - PLAIN == set(NAMES)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(collected, duck, name):
    columns, got = collected(name)
    r = duck.execute(plans.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(columns)
    assert rows(got) == rows(dict(zip(names, x, strict=True)) for x in r.fetchall())
