"""Every registered query of the core on the smallest tables, against its SQL where it has one."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from plenarium.plans import annotated, catalog, dyads, files, reports

#: These run from the facts on; the others of both tracks share one table of mentions each, and one folder of files.
WHOLE = {"c_annotated_labels", "d2_topic_mentions"}


@pytest.fixture(scope="module")
def duck(smallest):
    con = duckdb.connect()
    for p in Path(smallest).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.fixture(scope="module")
def shared(spark, smallest):
    return annotated._mentions(spark, smallest).cache(), dyads._resolved(spark, smallest).cache(), files._fact_files(spark, smallest)


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return round(float(x), 5) + 0.0
    if isinstance(x, pd.Timestamp):
        return str(x.date()) if x == x.normalize() else str(x)
    return str(x)


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(repr([plain(v) for v in r]) for r in df[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, smallest, duck, shared, monkeypatch, name):
    if name not in WHOLE:
        for module in (annotated, reports):
            monkeypatch.setattr(module, "_mentions", lambda *_: shared[0])
        for module in (dyads, reports):
            monkeypatch.setattr(module, "_resolved", lambda *_: shared[1])
        monkeypatch.setattr(files, "_fact_files", lambda *_: shared[2])
    got = catalog.QUERIES[name](spark, smallest).toPandas()
    if name in catalog.ORACLE:
        assert rows(got) == rows(duck.execute(catalog.ORACLE[name]).fetchdf())
    else:
        assert len(got) > 0
