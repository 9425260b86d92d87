"""Running sums, percentiles and coverage against plain loops."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import ranks as K


def test_running_sums_in_groups(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), k, rng.randrange(-5, 9)) for k in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k int, n long").withColumn("extra", F.lit("x"))
    at, want = defaultdict(int), set()
    for g, k, n in sorted(rows, key=lambda r: r[1]):
        want.add((g, k, n, at[g]))
        at[g] += n
    got = K.running(df.repartition(7), [F.col("k")], "n", "before", ["g"])
    assert got.columns == ["g", "k", "n", "extra", "before"] and {(r["g"], r["k"], r["n"], r["before"]) for r in got.collect()} == want
    total = {(r["k"], r["before"]) for r in K.running(df, [F.col("k").desc()], "n", "before").collect()}
    assert (499, 0) in total and len(total) == 500 and K.running(df.limit(0), [F.col("k")], "n", "before").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_percentiles_are_values_that_happened(spark, seed):
    rng = random.Random(seed)
    rows = [("hot", 5.0)] * 400 + [(rng.choice(["hot", "cold", None, "one"]), rng.choice([None, rng.random() * 9, 5.0, 1.0])) for _ in range(200)] + [("single", 2.5), ("none", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "kind string, secs double").withColumn("n", F.lit("clash"))
    by = defaultdict(list)
    for g, v in rows:
        by[g] += [v] if v is not None else []
    want = {(g, *(sorted(v)[max(1, -(-p * len(v) // 100)) - 1] if v else None for p in (0, 1, 50, 95, 100))) for g, v in by.items()}
    got = {tuple(r) for r in K.percentiles(df, "kind", "secs", (0, 1, 50, 95, 100)).collect()}
    assert got == want and K.percentiles(df.limit(0), "kind", "secs", (50,)).count() == 0


def test_coverage_by_a_sweep(spark):
    rng = random.Random(4)
    points = [(rng.choice([None, *range(30)]), rng.randrange(4)) for _ in range(300)]
    spans = [(k, rng.choice([None, *range(-3, 33)]), rng.choice([None, *range(-3, 33)])) for k in range(80)] + [(80, 7, 7), (81, 9, 3), (82, None, None)]
    want = {(k, sum(n for at, n in points if at is not None and (a is None or at >= a) and (b is None or at <= b))) for k, a, b in spans}
    p, s = spark.createDataFrame(points, "at int, n long"), spark.createDataFrame(spans, "id int, low int, high int")
    assert {tuple(r) for r in K.covered(p, s).collect()} == want
    assert {r["covers"] for r in K.covered(p.limit(0), s).collect()} == {0} and K.covered(p, s.limit(0)).count() == 0
