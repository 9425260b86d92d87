"""The grid's one pass against the detectors themselves, and the bands of single entries."""

import datetime

from pyspark.sql import functions as F

from ledgerloom.operators import band as B
from ledgerloom.operators import calibrate as K
from ledgerloom.operators import detect as T

V = "company_key string, id string, date date, party string, narration string, debit_account string, credit_account string, amount_paise long, gst_paise long, seq long"


def rows(spark, n, seed):
    import random

    r = random.Random(seed)
    return spark.createDataFrame([(f"c{i % 4}", f"{seed}-{i}", datetime.date(2024, 1, 1) + datetime.timedelta(days=r.randint(0, 20) + (15 if seed else 0)), f"v{r.randint(0, 5)} ltd", "n", f"A{r.choice([0, 0, 0, 1, 2 + seed])}", "Bank", r.choice([100, 150, 900, 2000]), r.choice([None, 5]) if seed else None, i) for i in range(n)], V)


def test_levels_are_what_the_detectors_say(spark):
    history, entries = rows(spark, 60, 0), rows(spark, 80, 1)
    fired = K.fired(entries, history).cache()
    assert fired.count() == 80
    level = lambda c: {r["id"]: r[c] for r in fired.select("id", c).collect()}
    got = level("vendor_switch")
    for k, n in enumerate(dict(K.GRID)["vendor_switch"]):
        assert {i for i, x in got.items() if x > k} == {r["id"] for r in T.vendor_switch(entries, history, min_postings=n).collect()}
    got = level("magnitude")
    for k, p in enumerate(dict(K.GRID)["magnitude"]):
        assert {i for i, x in got.items() if x > k} == {r["id"] for r in T.magnitude(entries, history, min_observations=2, over_percent=p).collect()}
    for name in ("first_use", "gst_anomaly"):
        assert {i for i, x in level(name).items() if x} == {r["id"] for r in T.DETECTORS[name](entries, history).collect()}


def test_calibration_is_greedy_and_inside_the_target(spark):
    history, entries = rows(spark, 60, 0), rows(spark, 80, 1)
    fired = K.fired(entries, history).cache()
    chosen = K.calibrate(fired)
    kept = {c["detector"]: dict(K.GRID)[c["detector"]].index(c["setting"]) for c in chosen if c["kept"]}
    half = fired.filter(F.col("company_key").isin("c0", "c2"))
    union = half.filter(" OR ".join(f"{d} > {k}" for d, k in kept.items()) or "false").count()
    assert union * 100 <= 10 * half.count()
    assert [c["detector"] for c in chosen] == [d for d, _ in K.GRID] and all(c["clean"] == half.count() for c in chosen)


def test_bands(spark):
    good = dict(laws=["PASS"], checked_paise=5, written_paise=5, asked=0, has_tax=False, tax_read=False, period_open=True, party_known=True, debit_account="A", credit_account="B", amount_confidence=0.99, party_confidence=0.99, tax_confidence=0.1, date_confidence=0.99, kind="invoice", repaired=False, tiers=["typed_text"], needs_person=False, ambiguous=0)
    cases = [({}, "POST", 0), ({"has_tax": None}, "BLOCK", 3), ({"laws": ["INDETERMINATE", "FAIL"]}, "BLOCK", 2), ({"period_open": None}, "BLOCK", 1), ({"written_paise": 6}, "BLOCK", 1), ({"asked": 5}, "BLOCK", 1), ({"tax_read": True}, "BLOCK", 1), ({"credit_account": "A"}, "BLOCK", 1), ({"tiers": []}, "ASK", 1), ({"repaired": True, "ambiguous": 1}, "ASK", 2), ({"party_confidence": 0.8}, "ASK", 1), ({"date_confidence": 0.1}, "BLOCK", 2), ({"date_confidence": 0.1, "kind": "receipt"}, "POST", 0), ({"debit_account": ""}, "ASK", 1)]
    schema = "laws array<string>, checked_paise long, written_paise long, asked int, has_tax boolean, tax_read boolean, period_open boolean, party_known boolean, debit_account string, credit_account string, amount_confidence double, party_confidence double, tax_confidence double, date_confidence double, kind string, repaired boolean, tiers array<string>, needs_person boolean, ambiguous int, n int"
    df = spark.createDataFrame([tuple((good | change).values()) + (i,) for i, (change, _, _) in enumerate(cases)], schema)
    got = {r["n"]: (r["band"], len(r["reasons"])) for r in B.decided(df).collect()}
    assert [got[i] for i in range(len(cases))] == [(b, n) for _, b, n in cases]
    words = spark.createDataFrame([([90, 80], True), ([90], False), ([], True), ([101], True)], "w array<int>, v boolean")
    assert [r[0] for r in words.select(B.confidence(F.col("w"), F.col("v"))).collect()] == [0.8, 0.0, 0.0, None]
