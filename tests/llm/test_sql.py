"""Registered queries against DuckDB, and quotations on rows that do quote."""

from __future__ import annotations

import duckdb
import pytest

from matewise.llm import catalogue, quotes

SF = "/root/testdata/sf0.001"
ROWS = [
    (1, 0, "a", "Hello  there\n\nSecond part\nwrapped"),
    (1, 1, "b", "> hello THERE\nI agree"),
    (1, 2, "c", ">> hello there\n> I agree\nMe too"),
    (1, 3, "a", "> second part\n> wrapped\n\n> unknown words\nok"),
    (1, 4, "b", " > > hello there\n>me too"),
    (2, 0, "a", "> I agree\nfrom another conversation"),
    (2, 1, "a", None),
    (2, 1, "a", None),
    (2, 300, "b", "far on"),
    (None, None, None, "lost"),
]


def same(frame, relation):
    names = sorted(frame.columns)
    assert sorted(relation.columns) == names
    key = lambda r: tuple((x is None, str(x)) for x in r)
    mine = sorted((tuple(r) for r in frame.select(*names).collect()), key=key)
    assert mine == sorted(relation.project(", ".join(f'"{c}"' for c in names)).fetchall(), key=key)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    same(catalogue.queries()[name](spark, SF), con.sql(catalogue.oracle_sql()[name]))


def test_quotations_equal_sql(spark):
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", ROWS)
    frame = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    same(quotes.threads(frame)[0].withColumnRenamed("conv", "conv_id"), con.sql(catalogue.oracle_sql()["op1_quotation_threads"]))


def test_every_operator_has_a_query():
    names = list(catalogue.queries())
    assert [n for n in range(1, 14) if sum(q.startswith(f"op{n}_") for q in names) != 1] == []
