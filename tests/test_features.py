"""Edge rows of the feature tables."""

import pytest
from pyspark.sql import functions as F

from aforo.functions import measures as M
from aforo.operators.features import features_connection, features_district_month, features_unit


def test_ratio_guards(spark):
    df = spark.createDataFrame([(4.0, -2.0), (5.0, 0.0), (6.0, 3.0)], "n double, d double")
    positive = [r[0] for r in df.select(M.safe_ratio("n", "d")).collect()]
    nonzero = [r[0] for r in df.select(M.safe_ratio("n", "d", "nonzero")).collect()]
    assert positive == [None, None, 2.0]
    assert nonzero == [-2.0, None, 2.0]
    with pytest.raises(ValueError):
        M.safe_ratio("n", "d", "other")


def test_seasons_and_missing_month(spark):
    df = spark.createDataFrame([(m,) for m in [*range(1, 13), None]], "m int")
    got = [r[0] for r in df.select(M.season("m")).collect()]
    v, o, i, p = "Verano", "Otono", "Invierno", "Primavera"
    assert got == [v, v, o, o, o, i, i, i, p, p, p, v, p]


def test_zero_consumption_counts_but_has_no_tariff(bills):
    row = features_unit(bills(dict(volfac=0.0, imagua=5.0), dict(volfac=2.0, imagua=5.0))).first()
    assert row.registros_totales == 2
    assert row.tarifa_efectiva == 2.5


def test_negative_consumption(bills):
    df = bills(dict(volfac=-2.0, imagua=4.0))
    assert features_unit(df).first().tarifa_efectiva is None
    assert features_unit(df, guard="nonzero").first().tarifa_efectiva == -2.0


def test_one_row_group(bills):
    row = features_unit(bills(dict(volfac=3.0))).first()
    assert row.consumo_std is None and row.coef_variacion is None
    assert row.consumo_rango == 0.0 and row.consumo_mediana == 3.0


def test_all_null_group_keeps_the_row(bills):
    row = features_unit(bills(dict(volfac=None), dict(volfac=None))).first()
    assert row.consumo_total is None and row.consumo_mediana is None
    assert row.registros_totales == 2


def test_null_bill_component_leaves_the_total(bills):
    row = features_unit(bills(dict(imagua=1.0, imalca=None, imcafi=3.0), dict())).first()
    assert row.importe_total == 3.0


def test_null_subsidy_status_is_zero(bills):
    row = features_unit(bills(dict(situdu=None))).first()
    assert row.es_subsidiado == 0
    assert features_connection(bills(dict(situdu=None))).first().registros_subsidiados == 0


def test_first_values_tie_by_value(bills):
    df = bills(dict(nomdis="b", nummes=1), dict(nomdis="a", nummes=1), dict(nomdis="0", nummes=2))
    assert features_unit(df).first().distrito == "a"


def test_null_is_not_a_distinct_value(bills):
    df = bills(dict(codcat="102", codudu=1), dict(codcat=None, codudu=None))
    row = features_connection(df).first()
    assert (row.num_categorias, row.num_unidades_uso) == (1, 1)
    c = features_district_month(df).first()
    assert (c.num_unidades, c.num_conexiones, c.n_domestico) == (1, 1, 1)


def test_share_scales_differ(bills):
    df = bills(dict(situdu="1"), dict(situdu="2"))
    assert features_connection(df).first().pct_subsidiado == 0.5
    assert features_district_month(df).first().pct_subsidiado == 50.0


def test_size_classes(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 4, 5, 10, 11)], "n long")
    got = [r[0] for r in df.select(M.size_bucket("n")).collect()]
    assert got == ["Unifamiliar", "Pequeno", "Pequeno", "Mediano", "Mediano", "Grande"]


def test_district_quantiles_and_spread(bills):
    row = features_district_month(bills(*[dict(volfac=float(v)) for v in (1, 2, 4, 8)])).first()
    assert (row.consumo_p25, row.consumo_mediana, row.consumo_p75) == (1.75, 3.0, 5.0)
    assert row.iqr_consumo == 3.25
    assert row.mes_absoluto == 1


def test_ids_may_be_text(bills):
    df = bills(dict(codudu=1), dict(codudu=2)).withColumn("codudu", F.concat(F.lit("u-"), "codudu"))
    assert features_district_month(df).first().num_unidades == 2
    assert features_unit(df).count() == 2


def test_missing_keys_form_a_group(bills):
    df = bills(dict(nomdis=None, volfac=2.0), dict(nomdis=None, volfac=4.0))
    row = features_district_month(df).first()
    assert (row.num_registros, row.consumo_mediana, row.num_unidades) == (2, 3.0, 1)


@pytest.mark.parametrize("table", [features_unit, features_district_month])
def test_hot_group_gives_the_same_table(spark, bills, table):
    """A third of all rows in one group, and a null key among the hot ones."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("codudu"),
        ((F.col("id") * 7919) % 1009 / 7.0).alias("volfac"),
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.lit("D")).alias("nomdis"),
        (F.col("id") % 12 + 1).cast("int").alias("nummes"),
    )
    rest = bills(dict()).drop("codudu", "volfac", "nomdis", "nummes")
    df = rows.join(rest)
    plain = table(df, hot_rows=None).drop("consumo_std", "coef_variacion").toPandas()
    hot = table(df, hot_rows=100).drop("consumo_std", "coef_variacion").toPandas()
    order = ["codudu"] if "codudu" in plain else ["nomdis", "nummes"]
    a = plain.sort_values(order, ignore_index=True).round(9)
    b = hot.sort_values(order, ignore_index=True)[a.columns].round(9)
    assert a.equals(b)


def test_partitioning_does_not_matter(spark, bills):
    df = bills(*[dict(codudu=i % 5, volfac=float(i), nummes=i % 12 + 1) for i in range(60)])
    one = features_unit(df.coalesce(1)).orderBy("codudu").toPandas().round(9)
    many = features_unit(df.repartition(8)).orderBy("codudu").toPandas().round(9)
    assert one.equals(many)
