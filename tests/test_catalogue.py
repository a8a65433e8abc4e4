"""Every catalogue query with SQL gives the SQL's rows."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from breakwater.plans import catalogue

SF = "/root/testdata/sf0.001"


def rows(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        df[c] = df[c].map(lambda x: None if x is None or x != x else str(float(x)) if isinstance(x, float) else str(x))
    return sorted(map(tuple, df.astype(object).where(df.notna(), None).values.tolist()), key=str)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_as_sql(spark, db, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), db.execute(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    for c in got:
        if pd.api.types.is_numeric_dtype(got[c]) and not pd.api.types.is_bool_dtype(got[c]):
            got[c], want[c] = got[c].astype("float64").round(6), want[c].astype("float64").round(6)
    assert rows(got) == rows(want)


def test_entry_point_without_the_corpus_part(spark):
    import __spark_entry__

    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns


def test_shared_read_events_against_a_loop(spark):
    cand = catalogue.view(spark, SF, "cand").toPandas().sort_values(["chrom", "start", "stop", "sv_type"])
    want = []
    for chrom, g in cand.groupby("chrom"):
        rows_, taken = [(r.start, r.stop, {f"r{r.call_id % 3 + i}" for i in range(5)}, r.mapq, r.sv_type) for r in g.itertuples()], set()
        for i, (start, stop, reads, _, _) in enumerate(rows_):
            if i in taken:
                continue
            near = [i]
            for j in range(i + 1, len(rows_)):
                gap = rows_[j][0] - stop
                if gap <= 1000:
                    near.append(j)
                elif gap > 2000:
                    break
            n = sum(sum(r in rows_[j][2] for j in near) >= 2 for r in set().union(*(rows_[j][2] for j in near)))
            if len(near) >= 2 and n >= 4:
                want.append((chrom, min(rows_[j][0] for j in near), max(rows_[j][1] for j in near), len(near)))
                taken |= set(near)
    got = catalogue.QUERIES["shared_read_events"](spark, SF).toPandas()
    assert sorted(zip(got.chrom, got.start, got.stop, got.components.map(lambda x: len(x.split(","))), strict=True)) == sorted(want)


def test_matches_against_a_loop(spark):
    cand = catalogue.view(spark, SF, "cand").toPandas()
    truth, calls = cand[cand.caller % 2 == 0], cand[cand.caller % 2 == 1]
    pairs = []
    for (chrom, kind), t in truth.groupby(["chrom", "sv_type"]):
        c = calls[(calls.chrom == chrom) & (calls.sv_type == kind)]
        for x in t.itertuples():
            for y in c.itertuples():
                a, b = sorted((max(x.size, 1), max(y.size, 1)))
                if abs(x.start - y.start) <= 500 and a / b >= 0.7:
                    pairs.append((abs(x.start - y.start), x.call_id, y.call_id))
    met, used = {}, set()
    for _, x, y in sorted(pairs):
        if x not in met and y not in used:
            met[x] = y
            used.add(y)
    got = catalogue.QUERIES["benchmark_matches"](spark, SF).toPandas()
    tp = got[got.state == "TP"]
    assert dict(zip(tp.truth_id.astype(int), tp.call_id.astype(int), strict=True)) == met
    assert (got.state == "FN").sum() == len(truth) - len(met) and (got.state == "FP").sum() == len(calls) - len(met)
