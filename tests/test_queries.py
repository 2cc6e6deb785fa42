"""Every registered query on the smallest tables, against DuckDB where it has SQL."""

import duckdb
import pytest

import __spark_entry__ as entry_points

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

QUERIES = entry_points.queries()
SQL = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def tables(folder):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, folder, tables, name):
    result = QUERIES[name](spark, folder)
    columns = sorted(result.columns)
    expected = tables.sql(SQL[name])
    assert sorted(expected.columns) == columns
    listed = ", ".join(f'"{column}"' for column in columns)
    found = [tuple(row[c] for c in columns) for row in result.toArrow().to_pylist()]
    assert sorted(found, key=repr) == sorted(
        (tuple(row) for row in expected.select(listed).fetchall()), key=repr
    )
    assert found


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_has_rows(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


def test_entry(spark):
    rows = entry_points.entry(spark)
    assert rows.columns == ["source", "word", "tf", "df", "weight", "rank"]
    assert rows.groupBy("source").count().where("count <> 20").count() == 0


@pytest.mark.parametrize("partitions", ["2", "8"])
def test_rows_do_not_depend_on_the_number_of_partitions(spark, folder, tables, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for name in ("user_word_weights", "unseen_pairs", "stratified_split"):
            test_query_equals_sql(spark, folder, tables, name)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
