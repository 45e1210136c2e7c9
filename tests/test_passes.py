"""Tables laid out for passes that are repeated many times."""

from aforo.operators import trees as B
from aforo.session import stored_for_passes


def test_small_tables_take_one_task_a_pass(spark):
    df = spark.range(0, 1000, 1, 16).selectExpr("id", "id * 2.0 as v")
    laid = stored_for_passes(df, "passes", ["id"])
    assert laid.rdd.getNumPartitions() == 1
    assert [r["id"] for r in laid.collect()] == list(range(1000))


def test_boosting_reads_few_partitions(spark, monkeypatch):
    seen = []

    class Regressor(B.GBTRegressor):
        def fit(self, rows):
            seen.append(rows.rdd.getNumPartitions())
            return super().fit(rows)

    monkeypatch.setattr(B, "GBTRegressor", Regressor)
    rows = spark.range(0, 300, 1, 16).selectExpr(
        "cast(id % 5 as int) coddis", "cast(2000 + id % 20 as int) nuanio", "cast(1 + id % 12 as int) nummes",
        "concat('D', id % 5) nomdis", "cast(id as int) mes_absoluto", "id * 1.5 consumo_promedio",
    )
    B.boosted_trees(rows, "C", maxIter=2, maxDepth=2)
    assert seen == [1]
