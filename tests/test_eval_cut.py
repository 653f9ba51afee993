"""Known-item search where the gate drops what is ranked before the expected document."""

import duckdb
import pytest

from marlstone.plans import QUERIES

WORDS = "the council has read the report on harvest and water in the northern valley and finds that nothing is missing from the account of the year "


@pytest.fixture
def made(spark, tmp_path):
    """Documents 100 and 200 are found behind copies in another language: 100 behind one, 200 behind four."""
    copies = {1: "first", 11: "second", 12: "second", 13: "second", 14: "second", 100: "first", 200: "second"}
    rows = [(i, "en" if i >= 100 else "bn", f"{w} {w}a {w}b {w}c {w}d {w}e {w}f {w}g {w}h {w}i {WORDS}\n{WORDS}") for i, w in copies.items()]
    rows += [(1000 + i, "en", f"note {i} of the office\n{WORDS}") for i in range(1, 20)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    return str(tmp_path), con


def test_cascade_cuts_by_ranks_of_the_fusion(spark, made):
    path, con = made
    run, sql = QUERIES["q_eval_cascade"]
    found = con.sql(sql)
    got = {tuple(r[c] for c in found.columns) for r in run(spark, path).collect()}
    assert got == set(found.fetchall())
    assert {(q, gate, cut) for q, _, _, _, gate, cut, _ in got} == {(100, 2, 1), (200, 5, None)}


def test_families_count_what_the_cut_loses(spark, made):
    path, con = made
    run, sql = QUERIES["q_eval_families"]
    found = con.sql(sql)
    got = {tuple(r[c] for c in found.columns) for r in run(spark, path).collect()}
    assert got == set(found.fetchall())
    assert [(f, cases, passed, gate, cut) for f, cases, passed, *_, gate, cut in got] == [("en", 2, 1, 0, 1)]
