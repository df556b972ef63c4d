"""Every query against its SQL in DuckDB; those without SQL run and give a stable schema."""

import re
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from murmura.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def rows(df):
    names = sorted(df.columns)
    plain = lambda v: None if v is None or pd.isna(v) else int(v) if isinstance(v, float) and v.is_integer() else v
    return names, sorted(str(tuple(plain(v) for v in r)) for r in df[names].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, small, name):
    got = catalogue.QUERIES[name](spark, small).toPandas()
    if name in catalogue.SQL:
        assert rows(got) == rows(duck.execute(catalogue.SQL[name]).df())
    else:
        assert len(got.columns) and len(got)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_library_stands_alone():
    """Nothing outside of the training-text subpackage imports it."""
    root = Path(__spark_entry__.__file__).parent
    for path in (root / "murmura").rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"murmura\.llm|from \.llm|import llm", path.read_text()), path


@pytest.mark.parametrize("name", ["label_intervals", "split_points", "asof_speaker_fallback", "knn_spread", "weighted_silhouette"])
def test_no_cartesian_product(spark, small, name):
    df = catalogue.QUERIES[name](spark, small)
    assert "CartesianProduct" not in df._jdf.queryExecution().toString()


def test_flagship_shuffles_once(spark, small):
    plan = catalogue.QUERIES["transcript_paragraphs"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(") <= 2


def test_columns_are_pruned(spark, small):
    plan = catalogue.QUERIES["never_completed"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_linestatus), EqualTo(l_linestatus,F)" in plan and "l_comment" not in plan and "l_shipdate" not in plan
