"""Every query of the library against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from spanloom.plans import catalog

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    out = []
    for r in df.itertuples(index=False):
        out.append(tuple("~" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v) for v in r))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, sf_dir, name):
    got = catalog.queries()[name](spark, sf_dir).toPandas()
    want = duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    if len(got):
        assert rows(got) == rows(want)
    else:
        assert not len(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_runs_without_sql(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0


def test_boundaries_keep_lines(spark, sf_dir):
    q = catalog.queries()
    text_of = lambda df, order: {k: "".join(g.sort_values(order).piece) for k, g in df.toPandas().groupby(["doc_id", "page_idx", "block_no", "line_no"])}
    assert text_of(q["style_boundaries"](spark, sf_dir), ["piece_no"]) == text_of(q["style_map"](spark, sf_dir), ["seg_no", "run_idx"])


def test_queries_have_rows(duck):
    """No comparison is empty on both sides."""
    assert [n for n in sorted(SQL) if duck.execute(SQL[n]).fetchone() is None] == []
