"""Every registered query of the document engine against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from leafwright.plans import slate

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(slate.oracle_sql()))
def test_equals_sql(spark, db, name):
    found = slate.queries()[name](spark, SF)
    names = sorted(found.columns)
    mine = sorted((tuple(plain(r[c]) for c in names) for r in found.collect()), key=repr)
    asked = db.execute(slate.oracle_sql()[name])
    at = {d[0]: k for k, d in enumerate(asked.description)}
    assert sorted(at) == names
    theirs = sorted((tuple(plain(r[at[c]]) for c in names) for r in asked.fetchall()), key=repr)
    assert len(mine) == len(theirs) and mine == theirs


@pytest.mark.parametrize("name", sorted(set(slate.queries()) - set(slate.oracle_sql())))
def test_has_rows(spark, name):
    assert slate.queries()[name](spark, SF).count() > 0


@pytest.mark.parametrize("texts", [["One.\nTwo.", None, "", " \n\t\n", "x", "Last one."], ["", None], []])
@pytest.mark.parametrize("name", ["q77_text_books", "q91_text_files"])
def test_documents_without_paragraphs_give_no_rows(spark, tmp_path, name, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, slate.queries()[name](spark, str(tmp_path)).collect())) == sorted(con.execute(slate.oracle_sql()[name]).fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
