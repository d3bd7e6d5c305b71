"""Fixtures and helpers that the tests of the corpus operators import."""

import duckdb
import pytest


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def frame(spark):
    """Documents from (doc_id, text[, lang, source]) tuples."""
    def make(rows):
        full = [(*r, *(None,) * (4 - len(r))) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string")

    return make


@pytest.fixture
def duck_docs():
    """Run SQL over `documents` made of (doc_id, text[, lang, source]) tuples."""
    def make(rows, sql):
        con = duckdb.connect()
        con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
        if rows:
            con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [(*r, *(None,) * (4 - len(r))) for r in rows])
        cursor = con.execute(sql)
        return [d[0] for d in cursor.description], cursor.fetchall()

    return make


@pytest.fixture
def agrees(frame, duck_docs):
    """Whether an operator gives the rows of the SQL on the same documents."""
    def check(operator, rows, sql):
        names, want = duck_docs(rows, sql)
        got = operator(frame(rows)).select(*names)
        assert rows_of(got) == sorted(want, key=repr)

    return check
