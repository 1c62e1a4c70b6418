"""Every library query beside its SQL, on the smallest tables."""

import duckdb
import pytest

from prismloom.plans import coverage_queries, more_queries, pixel_queries, rich_queries, scale_queries  # noqa: F401  register their queries
from prismloom.plans import queries as library

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(small):
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return connection


def rows(frame, columns):
    return sorted(tuple("%.6g" % x if isinstance(x, float) else str(x) for x in r) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(library.ORACLES))
def test_query_equals_sql(name, spark, small, sql):
    found, want = library.QUERIES[name](spark, small).toPandas(), sql.sql(library.ORACLES[name]).df()
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    assert rows(found, columns) == rows(want, columns)


@pytest.mark.parametrize("name", sorted(set(library.QUERIES) - set(library.ORACLES)))
def test_query_without_sql_has_rows(name, spark, small):
    assert library.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["image_id", "label", "image", "conversations"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_draws_do_not_depend_on_partitions(spark, small):
    from prismloom.functions import draws
    from prismloom.plans.scene import driver_scene

    objects = driver_scene(spark, small).objects
    first = draws.sample_groups(objects, ["image_id"], 2, "t", ["obj_idx"])
    second = draws.sample_groups(objects.repartition(7), ["image_id"], 2, "t", ["obj_idx"])
    assert sorted(map(str, first.collect())) == sorted(map(str, second.collect()))
