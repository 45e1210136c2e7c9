"""Values that equal a threshold but for rounding."""

import numpy as np

from aforo.operators import isolation as IF
from catalog.queries import NODES


def test_a_value_off_a_threshold_by_rounding_lies_on_it(spark):
    names = ["a", "b", "c", "d", "e"]
    above = float(np.nextafter(0.5, 1.0))
    df = spark.createDataFrame([(1, 30.0, 1.0, 30.0, 1.0, 0.5), (2, 30.0, 1.0, 30.0, 1.0, above), (3, 30.0, 1.0, 30.0, 1.0, 0.51)],
                               "id int, a double, b double, c double, d double, e double")
    got = {r["id"]: r["score"] for r in IF.isolation_forest_score(df, names, spark.createDataFrame(NODES, IF.NODE_SCHEMA)).collect()}
    assert got[1] == got[2] != got[3]
