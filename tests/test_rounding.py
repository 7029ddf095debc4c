"""Rounding of doubles that stand for a half of the last digit."""

from frameloom.functions import expr as X
from frameloom.operators import active
from pyspark.sql import functions as F


def test_halves_go_up_whatever_their_shortest_text(spark):
    df = spark.createDataFrame([(9.108812499999999,), (-9.108812499999999,), (1.25,), (0.1,), (None,), (float("nan"),)], "v double")
    got = [r[0] for r in df.select(X.rounded(F.col("v"), 6)).collect()]
    assert got[:5] == [9.108813, -9.108813, 1.25, 0.1, None] and got[5] != got[5]


def test_tasks_round_halves_up(spark):
    rows = spark.createDataFrame([(1, 9.108812499999999, "")], "candidate_id long, priority_score double, state string")
    assert active.candidate_tasks(rows).first().priority_score == 9.108813
