"""Report arithmetic on model outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MONTHS = 12


def excess_loss(comparison: DataFrame, tariff: float, feature: str = "consumo_promedio") -> DataFrame:
    """Yearly value of the flagged units' consumption above the normal mean."""
    excess = F.col("n_anomalias") * (F.col("anomalia") - F.col("normal"))
    return comparison.filter(F.col("feature") == feature).select(
        "feature",
        excess.alias("exceso_mensual_m3"),
        (excess * tariff).alias("perdida_mensual"),
        (excess * tariff * MONTHS).alias("perdida_anual"),
    )


def policy_impact(effects: DataFrame, tariff: float, effect: str = "coef", units: str = "n_units") -> DataFrame:
    """Yearly billing from an effect per unit and month over the affected units."""
    monthly = F.col(units) * F.col(effect)
    return effects.withColumns(
        {
            "volumen_mensual_m3": monthly,
            "facturacion_mensual": monthly * tariff,
            "facturacion_anual": monthly * tariff * MONTHS,
        }
    )


def deviation_alerts(
    predictions: DataFrame, actual: str, predicted: str, tolerance: float = 0.10
) -> DataFrame:
    """Rows whose actual value is off the prediction by more than the tolerance."""
    deviation = F.abs(F.try_divide(F.col(actual) - F.col(predicted), F.abs(F.col(predicted))))
    return predictions.withColumn("desviacion", deviation).filter(F.col("desviacion") > tolerance)
