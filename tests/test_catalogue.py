"""Every registered query with SQL against DuckDB, on tables large enough for ties and rounding to show."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from shotlattice.plans import catalogue

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{LARGER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def normal(df: pd.DataFrame) -> pd.DataFrame:
    out = {}
    for c in sorted(df.columns):
        x = df[c]
        if str(x.dtype).startswith("datetime"):
            out[c] = x.astype("datetime64[us]").astype(str)
        elif x.dtype == object and not all(v is None or isinstance(v, (int, float, bool, np.number)) or type(v).__name__ == "Decimal" for v in x):
            out[c] = x.map(lambda v: "~" if v is None or isinstance(v, float) and v != v else str(v))
        else:
            out[c] = pd.to_numeric(x.astype(object).where(x.notna(), np.nan)).astype(float)
    return pd.DataFrame(out).sort_values(sorted(out), ignore_index=True)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(spark, con, name):
    got = normal(catalogue.queries()[name](spark, LARGER).toPandas())
    want = normal(con.sql(catalogue.oracle_sql()[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9, atol=1.1e-6)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs_alike_twice(spark, name):
    f = catalogue.queries()[name]
    a, b = (normal(f(spark, SF).toPandas()) for _ in range(2))
    assert len(a)
    pd.testing.assert_frame_equal(a, b)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pair_queries_see_every_event(spark):
    e = pd.read_parquet(f"{SF}/events.parquet")
    start = pd.Timestamp("2024-01-01")
    places = e.assign(hour=(e.ts - start) // pd.Timedelta(hours=1)).groupby("hour").user_id.agg(lambda u: sorted(set(u)))
    want = pd.Series([(a, b) for users in places for i, a in enumerate(users) for b in users[i + 1 :]]).value_counts().to_dict()
    q = catalogue.queries()
    assert {(r.a, r.b): r.n for r in q["co_presence"](spark, SF).collect()} == want
    for name in ("synchrony", "placement"):
        assert {(r.a, r.b) for r in q[name](spark, SF).collect()} == set(want)
    assert sum(r.n for r in q["looks_at"](spark, SF).collect()) == sum(want.values())
    degrees = pd.Series([x for pair in want for x in pair]).value_counts()
    assert sorted(r.degree for r in q["graph_degrees"](spark, SF).collect()) == sorted(degrees.nlargest(8))
    early = (e.ts - start).dt.days < 16
    labels = [e[x].groupby("user_id").event_type.agg(set).to_dict() for x in (early, ~early)]
    got = {r.video: r for r in q["fuzzy_topic_overlap"](spark, SF).collect()}
    assert set(got) == set(e.user_id)
    for v, r in got.items():
        a, b = (x.get(v, set()) for x in labels)
        near = lambda x, ys: any(x[0] == y[0] for y in ys)
        assert (r.only_first, r.common, r.only_second) == (sum(not near(x, b) for x in a), sum(near(x, b) for x in a), sum(not near(x, a) for x in b))
