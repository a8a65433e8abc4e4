"""Hard negatives against brute force: nulls, ties, copies, repeated rows, mixed widths, large and tiny numbers, one hot vector, clustered data."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from breakwater.llm import negatives, queries

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows):
    ok = {(k, tuple(v), (lab + 1) % 10 if k % 7 == 0 else lab) for k, v, lab in rows if k is not None and v is not None and lab is not None and all(x is not None and math.isfinite(x) for x in v)}
    whole = {v: [math.floor(256 * x) for x in v] for _, v, _ in ok}
    out = []
    for a, va, la in ok:
        if a % 100:
            continue
        found = [(-sum(p * q for p, q in zip(whole[va], whole[v], strict=True)), k, lab) for k, v, lab in ok if k != a and len(v) == len(va)]
        for s, k, _ in sorted(x for x in found if x[2] == la)[:5]:
            hits = sorted(x for x in found if x[2] != la and 80 * -s <= 100 * -x[0] <= 100 * -s)[:5]
            out += [(a, k, rank, n, -s, -t) for rank, (t, n, _) in enumerate(hits, 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 8))
    out = [(i, (centres[i % 6] + 0.3 * rng.normal(size=8)).tolist(), int(rng.integers(0, 4))) for i in range(1500)]
    hot = centres[0].tolist()
    out += [(i, hot, i % 3) for i in range(1500, 2300)]  # a third has one vector: ties by id
    out += [(2300, None, 1), (2400, hot, None), (2500, [1.0, None] * 4, 1), (2600, [math.nan] * 8, 1), (2700, [math.inf] * 8, 1), (None, hot, 1), (2800, [0.0] * 8, 1), (2801, [0.0] * 8, 2)]
    out += [(i, [0.1 * (i % 5), 1.0, 0.5], i % 2) for i in range(2900, 2930)] + [(3000, [1e-9] * 3, 0), (3001, [-1e-9] * 3, 1), (3100, [], 0), (3101, [], 1)]
    return out + out[:50] + [(100, hot, 2), (100, (2 * centres[1]).tolist(), 1)]


def test_against_all_pairs(spark, rows, monkeypatch):
    table = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("cell", "away", "akey", "grp", "side", "key", "part")})
    expected = brute(rows)
    assert len(expected) > 200
    assert found(negatives.mine(table)) == expected
    monkeypatch.setattr(negatives, "GROUP", 3)  # many groups of few anchors, many parts of few candidates
    monkeypatch.setattr(negatives, "PART", 100)
    assert found(negatives.mine(table)) == expected
    assert negatives.mine(table.limit(0)).collect() == []


def test_numbers_beyond_doubles(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=4) * 3e5 + 1e6).tolist(), i % 2) for i in range(0, 900, 4)]
    assert found(negatives.mine(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_bounds_leave_cells_out(spark):
    """Clusters far apart: a group of anchors gets the candidates of its own cluster, not all."""
    rng = np.random.default_rng(4)
    at = 50 * np.eye(16)
    rows = [(i, (at[i % 16] + rng.normal(size=16)).tolist(), 1 + i % 2) for i in range(4000)]
    table = negatives.stored(negatives.usable(spark.createDataFrame(rows, SCHEMA)), "rows")
    space = negatives._space(table)
    cells = negatives._in_cells(table, space, False)
    anchors = negatives._in_cells(table.where("vec_id % 100 = 0"), space, True).withColumns({"akey": F.col("vec_id").cast("string"), "own": F.lit(1).cast("bigint"), "near": F.lit(0.0), "far": F.lit(None).cast("double")})
    routes = negatives._routes(anchors.withColumn("grp", F.concat_ws(":", "label", "dim", "cell")), cells, ["label", "dim"], space, 5)
    served = routes.agg(F.sum("n")).first()[0]
    assert 0 < served < 0.5 * routes.select("grp").distinct().count() * len(rows) / 2
    assert found(negatives.mine(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_the_sql_says_the_same(spark):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    expected = sorted(tuple(int(x) for x in r) for r in db.execute(negatives.ORACLE).df()[cols].itertuples(index=False))
    assert found(queries.op12_hard_negatives(spark, sf)) == expected
