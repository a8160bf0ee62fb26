import duckdb
import pytest

from loomtext import more_queries, queries
from loomtext.sources import readers as rd
from loomtext.sources import writers as wr

TEXTS = [None, "", " ", " a ", "★", "\n", "a\r\nb\r", '"', '""', 'a",\n"b', "\\", '\\"', "a\0b", '\0"x', '"\0"', "null", "NaN", ",", "﻿a"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents of odd texts, languages and sizes, all of them labelled."""
    root = str(tmp_path_factory.mktemp("odd"))
    rows = [(k, t, ["", None, "en", '"', '\0"'][k % 5], f"s{k % 2}", None if k % 7 == 6 else 10**k % 10**9) for k, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(len(TEXTS))], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


def check(spark, odd, name):
    connection = duckdb.connect()
    for table in ("documents", "labels"):
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{odd}/{table}.parquet/*.parquet'")
    want = connection.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, odd).select(*want.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall())) and len(got) == len(TEXTS)


def test_csv_round_trip_tells_empty_from_null(spark, odd):
    check(spark, odd, "q_csv_round_trip")


def test_feature_table_tells_empty_from_null(spark, odd):
    assert more_queries
    check(spark, odd, "q_feature_table")


def test_older_transcripts_tell_empty_from_null(spark, odd):
    check(spark, odd, "q_older_transcripts")


def test_blanks(spark, tmp_path):
    wr.write_csv(spark.createDataFrame([("1", "", None), ("2", None, "")], "id string, a string, b string"), str(tmp_path / "t"))
    read = lambda **more: sorted(map(tuple, rd.csv_table(spark, str(tmp_path / "t"), **more).collect()))
    assert read() == [("1", None, None), ("2", None, None)]
    assert read(blanks=True) == [("1", "", None), ("2", None, "")]
    assert rd.csv_table(spark, str(tmp_path / "t"), "id int, a string, b int", blanks=True).filter("b IS NULL").count() == 2
