"""Every query against the SQL that it must agree with, on the smallest tables."""

import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from turnstone import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
catalog.load()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def cell(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(cell, v)) + "]"
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    return f"{float(v):.9g}" if isinstance(v, (float, np.floating, int, np.integer)) else str(v)


def rows(df):
    return sorted("|".join(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_agrees(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_quoted_pairs_with_any_white_space(spark, tmp_path):
    x = "x" * 30
    texts = ["\none two\n and more of it", "one\t" + x, x[:19] + "\n" + x, x[:18] + " \n" + x, "\n " + x[:17] + " ", "\u00a0one\u3000", "\u2003 \n two", "\n" * 25 + "x", "\u00a0" * 25 + "x", " " * 25 + "x", " \t ", "", None, "\U0001f926\u200d\u2642\ufe0f" * 9, "say \"\\hi\"\x1c\x85", "\u2028one\u200b"]
    # every text meets every class of pairs, on either side; the last ids are beyond a double's integers
    rows = [(36 * i + 3 * k + side + far, texts[i] if side == t else "plain text") for far in (0, 3 * 2**58) for i in range(len(texts)) for k in range(12) for t in [k // 6] for side in (0, 1)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = c.execute(catalog.ORACLE_SQL["pair_classification"])
    names = [d[0] for d in want.description]
    got = catalog.QUERIES["pair_classification"](spark, str(tmp_path)).select(*names)
    order = lambda r: r[:2]
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want.fetchall(), key=order)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_long_conversations_are_extracted_whole(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of talk {c}") for c, n in ((0, 70), (1, 3)) for t in range(n)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(2).write.parquet(f"{tmp_path}/conversations.parquet")
    c = duckdb.connect()
    c.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = c.execute(catalog.ORACLE_SQL["extraction"])
    names = [d[0] for d in want.description]
    got = catalog.QUERIES["extraction"](spark, str(tmp_path)).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
