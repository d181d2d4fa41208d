"""Cues are few and in the right places; heights go evenly along an edge."""

import pytest
from pyspark.sql import functions as F

from trailmark.operators.cues import cues, with_heights

M = 1 / 110540.0


def test_cues(spark):
    pts = [(0, 0), (0, 100), (100, 100), (110, 105), (200, 100), (300, 100)]
    names = ["A", "B", "B", "C", "C"]
    rows = [("r", i, n, a[1] * M, a[0] / 111320, b[1] * M, b[0] / 111320) for i, (n, a, b) in enumerate(zip(names, pts, pts[1:], strict=False))]
    got = cues(spark.createDataFrame(rows, "route_id string, ord int, name string, ulat double, ulon double, vlat double, vlon double")).orderBy("ord").collect()
    assert [c.text for c in got] == ["Start on A", "Turn right onto B", "Slight left onto B", "End"] and got[1].sym == "Right"
    assert got[0].sym == "Flag, Green" and got[-1].ord == 5


def test_heights(spark):
    line = F.array(*[F.struct(F.lit(0.0).alias("lon"), F.lit(y * M).alias("lat")) for y in (0.0, 25.0, 100.0)])
    got = spark.range(1).select(with_heights(line, F.lit(10.0), F.lit(30.0)).alias("p")).first().p
    assert [x.ele for x in got] == pytest.approx([10, 15, 30])
