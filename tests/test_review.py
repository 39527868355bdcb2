import random

from pyspark.sql import functions as F

from plumbline.operators import anomaly, explain


def test_rows_are_scored_once(spark, numbered, capsys):
    """What reads a review needs no trees any more, and sees the scores that the trees give."""
    rng = random.Random(2)
    rows = [(rng.random(), rng.gauss(0, 1), "x") for _ in range(400)] + [(9.0, 9.0, None), (None, 1.0, "y"), (float("nan"), 1.0, "z")]
    df = numbered(rows, "a double, b double, c string")
    found = anomaly.review(df)
    assert found.forest is not None
    assert found.scored.columns == [*df.columns, "forest_score", "votes", "signals"]
    capsys.readouterr()
    for frame in (found.scored, explain.row_interpretation(found), explain.explain_rows(found)):
        frame.explain()
        assert "EvalPython" not in capsys.readouterr().out
    anew = df.select("row_number", found.forest.score(df).alias("s"))
    assert sorted(found.scored.select("row_number", "forest_score").collect()) == sorted(anew.collect())
    assert found.scored.filter(F.col("forest_score").isNull()).count() == 2
    assert found.row(401).drop("signals").collect() == found.scored.filter("row_number = 401").drop("signals").collect()
