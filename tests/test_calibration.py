"""Order statistics against sorted lists, in large and small groups, with ties, nulls and hot values."""

import math
import random

import pytest

from attestry.operators import calibration as C


@pytest.mark.parametrize("small", [0, 10**9])
def test_ranked_values(spark, monkeypatch, small):
    monkeypatch.setattr(C, "SMALL", small)
    r = random.Random(2)
    groups = {"many": [r.gauss(0, 1) for _ in range(6000)], "ties": [float(r.randint(0, 3)) for _ in range(3000)], "one": [4.0], "two": [1.0, 2.0], None: [float(i) for i in range(101)], "hot": [7.0] * 2500 + [float(i) for i in range(30)]}
    if not small:  # bounds by sketch hold for groups that are not tiny
        groups = {k: v for k, v in groups.items() if len(v) > 1000}
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("many", None), ("none", None)], "g string, v double")
    got = {x["g"]: x for x in C.upper_median(rows, ["g"], "v").collect()}
    assert {g: (x["upper_median"], x["n"]) for g, x in got.items()} == {g: (sorted(v)[len(v) // 2], len(v)) for g, v in groups.items()}
    for fpr in (0.01, 0.25, 1.0):
        got = {x["g"]: x["threshold"] for x in C.threshold_at_fpr(rows, ["g"], "v", fpr).collect()}
        assert got == {g: sorted(v)[::-1][math.floor(len(v) * fpr)] + C.EPSILON if math.floor(len(v) * fpr) < len(v) else math.inf for g, v in groups.items()}
